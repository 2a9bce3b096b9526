"""Column helpers for dirty cells: text, amounts and naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that count as surrounding white space.
BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Exact type of summed amounts: 20 digits before and 18 after the point.
AMOUNT = T.DecimalType(38, 18)

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(col: Column) -> Column:
    """Text without surrounding white space; null if nothing is left."""
    bare = F.btrim(col, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, bare)


def amount(col: Column) -> Column:
    """Amount text as exact decimal; null unless it is one finite decimal number.

    Plain and exponent notation and a sign are read. What doesn't fit 20 digits
    before the point is null, digits beyond the 18th after it are rounded.
    """
    bare = F.btrim(col, F.lit(BLANKS))
    return F.when(bare.rlike(_NUMBER), bare).try_cast(AMOUNT)


def micros(name: str) -> Column:
    """Microseconds since 1970 of a naive timestamp column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{name}` AS TIMESTAMP_NTZ))")
