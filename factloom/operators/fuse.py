"""Fusion: a field's normalized observations to one value, or a conflict.

Values of one field agree if all lie within a tolerance of each other: for numbers
the largest less the least, for others one distinct key.  That is a plain
aggregate, so partial sums, minima and maxima are combined before the shuffle.
Disagreement gives no value; no source wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round3, tolerance
from ..functions.text import plain_number, quoted, shortest, strip

MOST_CONFIDENCE, BOOST, ALONE, IN_CONFLICT, VERIFIED = 0.98, 0.08, 0.95, 0.40, 0.75
UNREADABLE = "[unparseable value excluded from merge]"


def fused_confidence(n: Column, best: Column, rounded: Callable[[Column], Column] = round3) -> Column:
    boosted = F.least(F.lit(MOST_CONFIDENCE), best + F.lit(BOOST) * (n - 1))
    return rounded(boosted * F.when(n == 1, F.lit(ALONE)).otherwise(F.lit(1.0)))


def fuse_numbers(normalized: DataFrame, *key: str, rounded: Callable[[Column], Column] = round3) -> DataFrame:
    """(key, n, value, confidence, conflict, best_source) of numeric observations."""
    order = F.struct("eff", (-F.col("src_ord")).alias("s"))
    got = normalized.where("key_num is not null").groupBy(*key).agg(
        F.count("*").alias("n"), F.min("key_num").alias("low"), F.max("key_num").alias("high"),
        F.max_by(F.struct("key_num", "eff", "source_id"), order).alias("best"),
    )
    conflict = F.col("high") - F.col("low") > tolerance(F.col("low"), F.col("high"))
    return got.select(
        *key, "n", F.when(~conflict, F.col("best.key_num")).alias("value"),
        F.when(conflict, F.lit(IN_CONFLICT)).otherwise(fused_confidence(F.col("n"), F.col("best.eff"), rounded)).alias("confidence"),
        conflict.alias("conflict"), F.col("best.source_id").alias("best_source"),
    )


def fuse(normalized: DataFrame) -> DataFrame:
    """One row per product and field with at least one readable value.

    value_num holds numbers, value_str other values; `display` is either as text.
    `sources` and `dropped` list the observations in source and rule order.
    """
    said = F.struct("src_ord", "rule_ord", "field", "value", "unit", "confidence", "method", "source_id", "snippet", "line_start", "line_end", "reasoning", "eff")
    noted = F.concat(F.when(F.col("reasoning") != "", F.concat("reasoning", F.lit(" "))).otherwise(""), F.lit(UNREADABLE))
    lost = F.struct("src_ord", "rule_ord", "field", "value", "unit", "confidence", "method", "source_id", "snippet", "line_start", "line_end", noted.alias("reasoning"), "eff")
    readable = F.coalesce(F.col("key_num").isNotNull(), F.lit(False)) | F.col("key_str").isNotNull()
    order = F.struct("eff", (-F.col("src_ord")).alias("s"), (-F.col("rule_ord")).alias("r"))
    best = F.max_by(F.when(readable, F.struct("key_num", "key_str", "eff", "value", "source_id")), F.when(readable, order))
    got = normalized.groupBy("product_id", "category", "field", "field_ord", "label", "type", "canonical_unit", "enum").agg(
        F.count_if(readable).alias("n"), F.min("key_num").alias("low"), F.max("key_num").alias("high"), F.min("key_str").alias("first"), F.max("key_str").alias("last"),
        best.alias("best"), F.sort_array(F.collect_list(F.when(readable, said))).alias("sources"), F.sort_array(F.collect_list(F.when(~readable, lost))).alias("dropped"),
    ).where("n > 0")
    numeric = F.col("type") == "number"
    conflict = F.when(numeric, F.col("high") - F.col("low") > tolerance(F.col("low"), F.col("high"))).otherwise(F.col("first") != F.col("last"))
    known = F.element_at(F.filter("enum", lambda e: F.lower(e) == F.lower(F.col("best.key_str"))), 1)
    known = F.when(F.exists("enum", lambda e: F.lower(e) == F.lower(F.col("best.key_str"))), known)
    text = F.when(F.col("type") == "enum", F.coalesce(known, strip(F.col("best.value")))).otherwise(F.col("best.value"))
    named = F.transform("sources", lambda s: strip(F.concat(s["source_id"], F.lit("="), s["value"], F.lit(" "), F.coalesce(s["unit"], F.lit("")))))
    reason = F.concat(F.lit("Sources disagree on "), "label", F.lit(": "), F.concat_ws("; ", named))
    confidence = F.when(conflict, F.lit(IN_CONFLICT)).otherwise(fused_confidence(F.col("n"), F.col("best.eff")))
    got = got.select("*", conflict.alias("conflict"), reason.alias("reason"), confidence.alias("fused"))
    key = F.when(numeric, shortest(F.col("best.key_num"))).otherwise(quoted(F.col("best.key_str")))
    two = lambda c: F.format_string("%.2f", c)
    agreed = F.concat(F.col("n").cast("string"), F.lit(" sources agree on "), "label", F.lit(" (normalized "), key, F.lit("); confidence boosted from "), two(F.col("best.eff")), F.lit(" to "), two(F.col("fused")), F.lit("."))
    alone = F.concat(F.lit("Single source ("), "best.source_id", F.lit(") provides "), "label", F.lit("; effective confidence "), two(F.col("fused")), F.lit("."))
    values = F.transform("sources", lambda s: F.struct(s["source_id"].alias("source_id"), s["value"].alias("value"), F.coalesce(s["unit"], F.col("canonical_unit")).alias("unit")))
    empty = F.array().cast("array<struct<field:string,reason:string,values:array<struct<source_id:string,value:string,unit:string>>>>")
    value_num = F.when(numeric & ~F.col("conflict"), F.col("best.key_num"))
    value_str = F.when(~numeric & ~F.col("conflict"), text)
    return got.select(
        "product_id", "category", "field", "field_ord", "label", "type", "canonical_unit", "enum", "n", value_num.alias("value_num"), value_str.alias("value_str"),
        F.coalesce(plain_number(value_num), value_str).alias("display"), F.col("fused").alias("confidence"), "conflict",
        F.when(F.col("conflict"), F.array(F.lit("conflict"))).when(F.col("n") > 1, F.array(F.lit("multi_source"))).otherwise(F.array(F.lit("single_source"))).alias("flags"),
        F.when(F.col("conflict"), F.array(F.struct("field", "reason", values.alias("values")))).otherwise(empty).alias("conflicts"),
        F.when(F.col("conflict"), F.col("reason")).when(F.col("n") > 1, agreed).otherwise(alone).alias("reasoning"), "sources", "dropped",
    )


def conversion_diff(normalized: DataFrame, fused: DataFrame) -> DataFrame:
    """Observations whose unit isn't the field's canonical one, with the converted value."""
    from ..functions.units import canonical

    differs = F.col("unit").isNotNull() & F.col("canonical_unit").isNotNull() & (canonical(F.col("unit")) != F.col("canonical_unit")) & F.col("key_num").isNotNull()
    rows = normalized.where(differs).join(fused.select("product_id", "field"), ["product_id", "field"], "left_semi")
    return rows.select("product_id", "field", "source_id", F.col("value").alias("raw_value"), F.col("unit").alias("raw_unit"), F.col("key_num").alias("converted"), F.col("canonical_unit").alias("unit"))
