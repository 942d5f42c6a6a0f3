"""The registry as small DataFrames of fixed size, which joins broadcast."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import categories, extraction_rules, units
from .categories import Category

FIELD_SCHEMA = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("category_label", T.StringType()),
        T.StructField("field_ord", T.IntegerType()),
        T.StructField("field", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("canonical_unit", T.StringType()),
        T.StructField("enum", T.ArrayType(T.StringType())),
        T.StructField("synonyms", T.MapType(T.StringType(), T.StringType())),
        T.StructField("candidates", T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("target", T.StringType()), T.StructField("reach", T.IntegerType())]))),
    ]
)


def field_table(spark: SparkSession, of: Iterable[Category] | None = None) -> DataFrame:
    """One row per field of each category, with what resolving its values needs."""
    known, rows = units.synonyms(), []
    for c in of if of is not None else categories.builtin():
        for i, f in enumerate(c.fields):
            spellings = known.get(f.name, {})
            # A token reaches values within one edit, or two if it is longer than four.
            tokens = [*spellings.items(), *((e.lower(), e) for e in f.enum)]
            reach = [(t, target, 1 if len(t) <= 4 else 2) for t, target in tokens]
            rows.append((c.name, c.label, i, f.name, f.label, f.type, f.unit, list(f.enum), spellings, reach if f.type == "enum" else []))
    return spark.createDataFrame(rows, FIELD_SCHEMA)


RULE_SCHEMA = "category string, source_type string, rule_ord int, field string, group int, step string, constant string, rule_unit string, unit_group int, rule_confidence double, method string, pattern string"


def rule_table(spark: SparkSession, of: Iterable[Category] | None = None) -> DataFrame:
    """Extraction rules whose field its category has."""
    known = {(c.name, f.name) for c in (of if of is not None else categories.builtin()) for f in c.fields}
    rows = [(r.category, r.source_type, order, r.field, r.group, r.step, r.constant, r.unit, r.unit_group, r.confidence, r.method, r.pattern) for order, r in enumerate(extraction_rules.builtin()) if (r.category, r.field) in known]
    return spark.createDataFrame(rows, RULE_SCHEMA)
