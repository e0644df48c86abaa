"""Replication messages written from a table of their fields."""

# The fields of each message in order; a number is a width in bytes, "z" text
# ended by a zero byte, "row" a counted list of cells, "cols" a counted list of columns.
LAYOUT = {
    "B": [("lsn", 8), ("micros", 8), ("xid", 4)],
    "C": [("flags", 1), ("lsn", 8), ("end", 8), ("micros", 8)],
    "R": [("rel", 4), ("schema", "z"), ("table", "z"), ("identity", 1), ("columns", "cols")],
    "I": [("rel", 4), ("new", "row")],
    "U": [("rel", 4), ("old", "row"), ("new", "row")],
    "D": [("rel", 4), ("old", "row")],
}
REL = 16400


def _number(value, width):
    return value.to_bytes(width, "big", signed=value < 0)


def _cell(value):
    """None is NULL, an ellipsis a value that is not sent."""
    if value is None or value is ...:
        return b"n" if value is None else b"u"
    raw = value.encode()
    return b"t" + _number(len(raw), 4) + raw


def _column(name, flag):
    return _number(flag, 1) + name.encode() + b"\0" + _number(20, 4) + _number(-1, 4)


def message(kind, **fields):
    out = [kind.encode()]
    for name, form in LAYOUT[kind]:
        value = fields[name]
        if form == "z":
            out.append(value.encode() + b"\0")
        elif form == "cols":
            out += [_number(len(value), 2), *[_column(*c) for c in value]]
        elif form == "row":
            if value is not None:
                marker, cells = value
                out += [marker, _number(len(cells), 2), *map(_cell, cells)]
        else:
            out.append(_number(value, form))
    return b"".join(out)


def begin(lsn=100, xid=7):
    return message("B", lsn=lsn, micros=0, xid=xid)


def commit(lsn=100, micros=1_000_000):
    return message("C", flags=0, lsn=lsn, end=lsn + 20, micros=micros)


def relation(rel=REL, table="orders", columns=(("order_id", 1), ("status", 0))):
    return message("R", rel=rel, schema="shop", table=table, identity=ord("d"), columns=columns)


def insert(*cells, rel=REL):
    return message("I", rel=rel, new=(b"N", cells))


def update(new, old=None, marker=b"K", rel=REL):
    return message("U", rel=rel, old=old and (marker, old), new=(b"N", new))


def delete(*cells, marker=b"K", rel=REL):
    return message("D", rel=rel, old=(marker, cells))


def landed(spark, *messages, batch=1):
    """As a poll lands them: every message with the position of the commit that ends its transaction."""
    rows, lsn = [], 100
    for n in range(len(messages) - 1, -1, -1):
        if messages[n][:1] == b"C":
            lsn = int.from_bytes(messages[n][2:10], "big")
        rows.append((batch, n, f"0/{lsn:X}", bytearray(messages[n])))
    return spark.createDataFrame(rows[::-1], "batch_id bigint, msg_no bigint, lsn string, data binary")
