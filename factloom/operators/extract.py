"""Rule-based extraction: blocks and rules to observations, and its model counterpart.

`observations` has one row per extracted value with its citation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..registry.tables import rule_table


class Extractor(Protocol):
    """What turns blocks into observations."""

    def extract(self, blocks: DataFrame) -> DataFrame: ...


def _matched(text: Column, group: str) -> Column:
    """The pattern's capture group in the text; both are columns."""
    return F.expr(f"regexp_extract(stripped, pattern, {group})")


class RuleExtractor:
    """The first line of a source that matches a rule gives the rule's value."""

    def __init__(self, rules: DataFrame | None = None):
        self.rules = rules

    def extract(self, blocks: DataFrame) -> DataFrame:
        rules = self.rules if self.rules is not None else rule_table(blocks.sparkSession)
        lines = blocks.withColumn("stripped", strip(F.col("text")))
        # Patterns are literals of the plan, each compiled once; a line meets the rules of its own kind of source only.
        by_kind: dict[tuple[str, str], list[Column]] = {}
        for r in rules.select("category", "source_type", "rule_ord", "pattern").collect():  # the registry: of fixed size
            by_kind.setdefault((r["category"], r["source_type"]), []).append(F.when(F.rlike("stripped", F.lit(f"(?U){r['pattern']}")), F.lit(r["rule_ord"])))
        matched = F.when(F.lit(False), F.array().cast("array<int>"))
        for (category, kind), found in by_kind.items():
            matched = matched.when((F.col("category") == category) & (F.col("source_type") == kind), F.array_compact(F.array(*found)))
        hits = lines.withColumn("rule_ord", F.explode(matched)).join(F.broadcast(rules), ["category", "source_type", "rule_ord"])
        key = ["product_id", "category", "src_ord", "source_id", "authority", "rule_ord"]
        said = F.struct("line_start", "line_end", "text", "stripped", "field", "pattern", "group", "step", "constant", "rule_unit", "unit_group", "rule_confidence", "method")
        # Minima are combined before the shuffle, so a long source sends one row per rule.
        first = hits.groupBy(*key).agg(F.min_by(said, "line_start").alias("hit")).select(*key, "hit.*")
        first = first.withColumn("pattern", F.concat(F.lit("(?U)"), "pattern"))
        raw = _matched(F.col("stripped"), "group")
        value = (
            F.when(F.col("group") == 0, F.col("constant"))
            .when(F.col("step") == "nospace", F.replace(raw, F.lit(" "), F.lit("")))
            .when(F.col("step") == "strip", strip(raw))
            .when(F.col("step") == "title", F.initcap(raw))
            .when(F.col("step") == "after", F.concat("constant", raw))
            .otherwise(raw)
        )
        unit = F.when(F.col("unit_group") > 0, _matched(F.col("stripped"), "unit_group")).otherwise(F.col("rule_unit"))
        why = F.concat(F.lit("Pattern matched on line "), F.col("line_start").cast("string"), F.lit(": "), "stripped")
        return first.select(
            "product_id", "category", "src_ord", "rule_ord", "source_id", "authority", "field", value.alias("value"), unit.alias("unit"),
            F.col("rule_confidence").alias("confidence"), "method", F.col("text").alias("snippet"), "line_start", "line_end", why.alias("reasoning"),
        )


class ModelExtractor:
    """Extraction by a model: one call per source, its answer sanitised like any other.

    `call(prompt) -> json text` runs on the workers; it must be picklable.  Answers are
    kept as a table, so each source is asked once however many stages read them.  A
    call that raises gives no values; `failures` then has its product, source and error,
    by which the whole plan fails that product alone.
    """

    def __init__(self, call: Callable[[str], str], render: Callable[[str, str, str], str], fields: DataFrame, folder: str | None = None):
        """folder: where answers are kept; a new one that executors share where it isn't given."""
        self.call, self.render, self.fields, self.folder = call, render, fields, folder
        self.failures: DataFrame | None = None

    def extract(self, blocks: DataFrame) -> DataFrame:
        from ..sources.documents import line_numbered
        from ..workers import shared_folder
        from .sanitize import sanitize

        call, render, spark = self.call, self.render, blocks.sparkSession
        about = blocks.select("product_id", "source_id", "category", "src_ord", "authority").distinct()
        asked = line_numbered(blocks).join(about, ["product_id", "source_id"])

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                answers, errors = [], []
                for category, source, text in zip(batch["category"], batch["source_id"], batch["numbered"], strict=True):
                    try:
                        answers.append(call(render(category, source, text)))
                        errors.append(None)
                    except Exception as e:
                        answers.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield batch.drop(columns="numbered").assign(response=answers, error=errors)

        answered = asked.mapInPandas(ask, "product_id string, source_id string, category string, src_ord int, authority double, response string, error string")
        folder = self.folder or shared_folder(spark, "answers")
        answered.write.mode("overwrite").parquet(folder)
        answered = spark.read.schema(answered.schema).parquet(folder)
        self.failures = answered.where("error is not null").select("product_id", "source_id", "error")
        return sanitize(answered.drop("error"), self.fields)
