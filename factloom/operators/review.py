"""Review texts for queued fields: a template, or a model behind the same shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fuse import VERIFIED

# Fixed value: how the agreement tolerance is described
TOLERANCE = "1% (relative, with a 0.05 absolute floor)"


class Reviewer(Protocol):
    def review(self, queue: DataFrame, sources: DataFrame) -> DataFrame: ...


class TemplateReviewer:
    """Deterministic texts by the kind of trouble: conflict, then validation, then low confidence."""

    def review(self, queue: DataFrame, sources: DataFrame) -> DataFrame:
        """queue with kind, review and suggested_action."""
        titled = F.map_from_entries(F.collect_list(F.struct("source_id", F.struct(F.coalesce("title", "source_id").alias("title"), F.coalesce("authority", F.lit(0.8)).alias("authority")))))
        # A product's sources, deduplicated by id, as one small map.
        named = sources.where("source_id is not null").select("product_id", "source_id", "title", "authority").dropDuplicates(["product_id", "source_id"]).groupBy("product_id").agg(titled.alias("about"))
        rows = queue.join(named, "product_id", "left")

        def called(s):
            known = F.try_element_at(F.col("about"), s)
            return F.concat(F.coalesce(known["title"], s), F.lit(" (authority "), F.format_string("%.2f", F.coalesce(known["authority"], F.lit(0.8))), F.lit(")"))

        two = F.format_string("%.2f", "confidence")
        kind = F.when(F.array_contains("flags", "conflict"), "conflict").when(F.array_contains("flags", "validation"), "validation").otherwise("low_confidence")
        rows = rows.withColumn("kind", kind).withColumn("named", F.concat_ws(", ", F.transform("sources", called)))
        review = (
            F.when(F.col("kind") == "conflict", F.concat(F.lit("Cross-source conflict on "), "label", F.lit(": "), "reason", F.lit(f". The values disagree beyond the {TOLERANCE} agreement tolerance, so neither can be auto-published without human judgment.")))
            .when(F.col("kind") == "validation", F.concat("label", F.lit(" failed a validation rule: "), "reason", F.lit(". The value is physically implausible or not in the schema enum.")))
            .otherwise(F.concat("label", F.lit(" is backed by only "), F.size("sources").cast("string"), F.lit(" source(s) with effective confidence "), two, F.lit(f", below the {VERIFIED:.2f} verification threshold. With no second independent source there is no cross-check.")))
        )
        action = (
            F.when(F.col("kind") == "conflict", F.concat(F.lit("Check the highest-authority source ("), "named", F.lit(") for a typo or a different operating condition, then record the single correct value.")))
            .when(F.col("kind") == "validation", F.lit("Correct the value at the source, or confirm it is genuinely correct before overriding the rule."))
            .otherwise(F.concat(F.lit("Confirm "), "label", F.lit(f" from an additional independent source to raise confidence above {VERIFIED:.2f}.")))
        )
        return rows.select(*queue.columns, "kind", review.alias("review"), action.alias("suggested_action"))


class ModelReviewer:
    """Reviews by a model: `call(prompt) -> {"reviews": [{field, review, suggested_action}]}` as JSON text.

    Fields that the answer doesn't name, and answers that can't be read, fall back to the template.
    """

    def __init__(self, call: Callable[[str], str]):
        self.call = call

    def review(self, queue: DataFrame, sources: DataFrame) -> DataFrame:
        call = self.call
        basis = TemplateReviewer().review(queue, sources)
        asked = basis.groupBy("product_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("queue_key", "field", "label", "reason")))).alias("prompt"))

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                answers = []
                for prompt in batch["prompt"]:
                    try:
                        answers.append(call(prompt))
                    except Exception:
                        answers.append(None)
                yield batch[["product_id"]].assign(response=answers)

        answers = asked.mapInPandas(ask, "product_id string, response string")
        listed = F.from_json("response", "struct<reviews:array<struct<field:string,review:string,suggested_action:string>>>")
        given = answers.select("product_id", F.explode(listed["reviews"]).alias("r")).select("product_id", F.col("r.field").alias("field"), F.col("r.review").alias("said"), F.col("r.suggested_action").alias("advised"))
        given = given.dropDuplicates(["product_id", "field"])
        rows = basis.join(given, ["product_id", "field"], "left")
        return rows.select(*queue.columns, "kind", F.coalesce("said", "review").alias("review"), F.coalesce("advised", "suggested_action").alias("suggested_action"))


def review_summary(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, summary, fields_reviewed, all_clear, reviews) for every product."""
    entry = F.struct("queue_key", "field", "label", "flags", "confidence", "type", "display", "review", "suggested_action")
    got = reviews.groupBy("product_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "conflict").alias("conflicts"), F.count_if(F.col("kind") == "low_confidence").alias("low"),
        F.count_if(F.col("kind") == "validation").alias("invalid"), F.sort_array(F.collect_list(entry)).alias("reviews"),
    )
    rows = products.select("product_id").join(got, "product_id", "left")
    n = F.coalesce("n", F.lit(0))
    text = F.concat(F.lit("Reviewed "), n.cast("string"), F.lit(" field(s): "), F.col("conflicts").cast("string"), F.lit(" conflict(s), "), F.col("low").cast("string"), F.lit(" low-confidence, "), F.col("invalid").cast("string"), F.lit(" validation. None can auto-publish until resolved."))
    clear = F.lit("No fields were routed to review - every extracted field was verified.")
    return rows.select("product_id", F.when(n > 0, text).otherwise(clear).alias("summary"), n.alias("fields_reviewed"), (n == 0).alias("all_clear"), "reviews")
