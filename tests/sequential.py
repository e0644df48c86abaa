"""Changes applied one after another, as the definition the set rules are checked against."""


def fold_rows(changes, stored=None):
    """changes: (pk, op, version, value) in order -> {pk: (version, value)}"""
    rows = dict(stored or {})
    for pk, op, version, value in changes:
        if op == "D":
            rows.pop(pk, None)
        elif pk not in rows or rows[pk][0] <= version:
            rows[pk] = (version, value)
    return rows


def fold_periods(changes, opened=None):
    """changes: (pk, op, ts, status) in order -> sorted [(pk, status, from, to)]"""
    current = dict(opened or {})
    closed = []
    for pk, op, ts, status in changes:
        new = None if op == "D" else status
        old = current.get(pk)
        if (old[0] if old else None) == new:
            continue
        if old:
            closed.append((pk, old[0], old[1], ts))
            del current[pk]
        if new is not None:
            current[pk] = (new, ts)
    return sorted(closed + [(pk, s, t, None) for pk, (s, t) in current.items()], key=str)
