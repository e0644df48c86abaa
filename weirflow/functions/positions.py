"""Log positions: LSN text and numbers, the server's epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: microseconds from 1970-01-01 to 2000-01-01, the epoch of the log's timestamps.
SERVER_EPOCH_MICROS = 946_684_800_000_000
_WORD = 1 << 32


def parse_lsn(lsn: Column | str) -> Column:
    """'HI/LO' hexadecimal text to BIGINT; NULL above the signed 64-bit range."""
    text = F.col(lsn) if isinstance(lsn, str) else lsn

    def word(part: int) -> Column:
        return F.conv(F.split_part(text, F.lit("/"), F.lit(part)), 16, 10).cast("decimal(20,0)")

    return (word(1) * F.lit(_WORD).cast("decimal(20,0)") + word(2)).try_cast("bigint")


def format_lsn(value: Column | str) -> Column:
    """BIGINT to upper-case 'HI/LO' without padding."""
    number = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    high = F.hex(F.shiftrightunsigned(number, 32))
    low = F.hex(number.bitwiseAND(F.lit(_WORD - 1)))
    return F.concat(high, F.lit("/"), low)


def lsn_distance(newer: Column | str, older: Column | str) -> Column:
    """Bytes of log between two LSN texts."""
    return parse_lsn(newer) - parse_lsn(older)


def server_micros_to_timestamp(micros: Column | str) -> Column:
    """Microseconds since the server's epoch to TIMESTAMP."""
    value = F.col(micros) if isinstance(micros, str) else micros
    return F.timestamp_micros(value + F.lit(SERVER_EPOCH_MICROS))


def parse_lsn_text(lsn: str) -> int:
    """Driver-side counterpart for saved positions."""
    high, _, low = lsn.partition("/")
    return int(high, 16) * _WORD + int(low, 16)


def format_lsn_text(value: int) -> str:
    return "{:X}/{:X}".format(*divmod(value, _WORD))
