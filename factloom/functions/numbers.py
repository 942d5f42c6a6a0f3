"""Column expressions for numbers: parsing, exact rounding, agreement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

RELATIVE, ABSOLUTE = 0.01, 0.05


def cleaned(c: Column) -> Column:
    """A messy numeral without blanks (no-break ones too) and apostrophes."""
    return F.regexp_replace(strip(F.regexp_replace(c, "\u00a0", " ")), "[ ']", "")


def numeral(s: Column) -> Column:
    """The double in a cleaned numeral, null where there is none.

    A comma is a thousands mark beside a point or in `d,ddd` to `ddd,ddd`, else the
    decimal mark.  Infinities and not-a-number are no numbers here.
    """
    thousands = s.rlike(r"^-?\d{1,3},\d{3}$|,.*\.|\..*,")
    point = F.replace(s, F.lit(","), F.when(thousands, "").otherwise("."))
    return F.when(point.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), point.try_cast("double"))


def parse_number(c: Column) -> Column:
    """The double in a number as people write it; where many are read, clean first and keep that as a column."""
    return numeral(cleaned(c))


def round3(x: Column) -> Column:
    """x in [0, 1] rounded to 3 decimals by its exact binary value, halves to even.

    x * 2**60 is an exact integer for doubles from 2**-8 on; its product with 1000
    is divided by 2**60 in two 30-bit halves, so nothing overflows or rounds.
    """
    bits, mask = 30, (1 << 30) - 1
    n = (x * F.lit(float(1 << 60))).cast("bigint")
    high, low = F.shiftright(n, bits) * F.lit(1000), n.bitwiseAND(F.lit(mask)) * F.lit(1000)
    upper = high + F.shiftright(low, bits)
    whole = F.shiftright(upper, bits)
    rest = upper.bitwiseAND(F.lit(mask)) * F.lit(1 << bits) + low.bitwiseAND(F.lit(mask))
    half = F.lit(1 << 59)
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    return (whole + up.cast("bigint")) / F.lit(1000.0)


def tolerance(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(RELATIVE) * F.greatest(F.abs(low), F.abs(high)), F.lit(ABSOLUTE))


def agree(a: Column, b: Column) -> Column:
    """Two numbers within 1 %, or 0.05; null agrees with nothing."""
    return F.coalesce(F.abs(a - b) <= tolerance(a, b), F.lit(False))
