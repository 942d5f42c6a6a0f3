"""Observations to comparable keys: numbers in canonical units, domain values, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cleaned, numeral
from ..functions.text import strip
from ..functions.units import canonical, converted

# Seal suffixes of a part number; digits that OCR confuses with letters
SEAL_SUFFIX = r"(?i)[-/]?(?:2RSH?|2RS1?|2Z|ZZ|RS|2RU|2LS|NSE|DDU)$"
OCR_DIGITS, OCR_LETTERS = "01582", "olsbz"


def string_key(value: Column, field: Column) -> Column:
    """Lower case, single blanks; a part number without its seal suffix."""
    s = F.lower(strip(F.regexp_replace(value, r"(?U)\s+", " ")))
    return F.when(field == "part_number", F.regexp_replace(F.regexp_replace(s, SEAL_SUFFIX, ""), "[ /-]+$", "")).otherwise(s)


def closest_target(value: Column, candidates: Column) -> Column:
    """The one target with a candidate in reach that is closest; null on a tie."""
    measured = F.transform(candidates, lambda c: F.struct(F.levenshtein(value, c["token"]).alias("d"), c["target"].alias("target"), c["reach"].alias("reach")))
    near = F.filter(measured, lambda c: c["d"] <= c["reach"])
    best = F.array_min(near)
    tied = F.exists(near, lambda c: (c["d"] == best["d"]) & (c["target"] != best["target"]))
    return F.when((F.size(near) > 0) & ~tied, best["target"])


def domain_value(value: Column, synonyms: Column, enum: Column, candidates: Column) -> Column:
    """The canonical value by spelling, by domain, each again with OCR digits read as letters, then by edits.

    Values that stay unresolved give their lower-case text.
    """
    v = F.lower(strip(value))
    ocr = F.translate(v, OCR_DIGITS, OCR_LETTERS)
    inside = lambda x: F.element_at(F.filter(enum, lambda e: F.lower(e) == x), 1)
    found = lambda x: F.coalesce(F.try_element_at(synonyms, x), F.when(F.exists(enum, lambda e: F.lower(e) == x), inside(x)))
    return F.when(v == "", v).otherwise(F.coalesce(found(v), found(ocr), closest_target(v, candidates), v))


def normalize(observations: DataFrame, fields: DataFrame) -> DataFrame:
    """observations of known fields with key_num, key_str and the effective confidence.

    Both keys are null where the value can't be read; key_str is null for numbers.
    """
    of_field = fields.select("category", "field", "field_ord", "label", "type", "canonical_unit", "enum", "synonyms", "candidates")
    rows = observations.join(F.broadcast(of_field), ["category", "field"])
    # A column per step: an expression that is used more than once isn't written out more than once.
    numeric = F.col("type") == "number"
    rows = rows.withColumn("numeral", F.when(numeric, cleaned(F.col("value")))).withColumn("said_unit", F.when(numeric, canonical(F.col("unit"))))
    rows = rows.withColumn("number", numeral(F.col("numeral"))).withColumn("wanted_unit", F.when(numeric, canonical(F.col("canonical_unit"))))
    text = F.when(F.col("type") == "enum", domain_value(F.col("value"), F.col("synonyms"), F.col("enum"), F.col("candidates"))).otherwise(string_key(F.col("value"), F.col("field")))
    return rows.select(
        *[c for c in observations.columns], "field_ord", "label", "type", "canonical_unit", "enum",
        F.when(numeric, converted(F.col("number"), F.col("said_unit"), F.col("wanted_unit"))).alias("key_num"),
        F.when(~numeric, text).alias("key_str"),
        (F.coalesce("authority", F.lit(0.8)) * F.col("confidence")).alias("eff"),
    )
