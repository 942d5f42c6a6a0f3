"""Column expressions for text: numbers in messages, white space, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (Spark's trim knows blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain_number(x: Column) -> Column:
    """A double as people write it: whole numbers without a point, no exponent."""
    whole = F.format_string("%.0f", x)
    parts = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    return F.when(x == F.floor(x), whole).when(x.isNotNull(), parts)


def shortest(x: Column) -> Column:
    """A double with at least one decimal: 25.0, 0.127, 12000000.0."""
    whole = F.concat(F.format_string("%.0f", x), F.lit(".0"))
    small = F.regexp_replace(F.format_string("%.6f", x), "0+$", "")
    return F.when(x.isNull(), F.lit(None).cast("string")).when(x == F.floor(x), whole).when((F.abs(x) < 0.001) | (F.abs(x) >= 1e7), small).otherwise(x.cast("string"))


def general(x: Column) -> Column:
    """Six significant digits without trailing zeros; an exponent beyond them."""
    size = F.abs(x)
    fixed = F.lit(None).cast("string")
    for exponent in range(-4, 6):
        low, high = 10.0**exponent, 10.0 ** (exponent + 1)
        digits = 5 - exponent
        near = high - 0.5 * 10.0**-digits  # from here on it rounds up to one more digit
        low = low - 0.5 * 10.0 ** -(digits + 1) if exponent > -4 else low
        text = F.format_string(f"%.{digits}f", x)
        fixed = F.when((size >= low) & (size < near), text).otherwise(fixed)
    trimmed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    exponent_form = F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e")
    return F.when(x == 0, F.lit("0")).otherwise(F.coalesce(trimmed, exponent_form))


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def slug(c: Column) -> Column:
    """Letters, digits, dot, underscore and dash; `product` where nothing is left."""
    s = F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^[.-]+|[.-]+$", ""), F.lit("")), F.lit("product"))


def script_safe_json(json: Column) -> Column:
    """JSON that may stand inside an HTML script element."""
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))
