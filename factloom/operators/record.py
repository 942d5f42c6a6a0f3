"""One nested record per product, and its JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .marketing import NOTE

VERSION = "1.0.0"
RULE_NOTE = "Explicit category rule table (not ML); rules only run on extracted fields."
REVIEW_NOTE = "deterministic template review (offline)"


def records(sources: DataFrame, source_counts: DataFrame, fields: DataFrame, routed: DataFrame, validated: DataFrame, queue: DataFrame, reviewed: DataFrame, copy: DataFrame, observed: DataFrame, mode: str = "mock") -> DataFrame:
    """product_id, category and the record's parts, for products whose sources could all be read.

    Lists are in the order of the schema, the manifest or the queue.  source_counts has
    a product's lines and fields_extracted as maps by src_ord.
    """
    info = F.struct("src_ord", F.col("source_id").alias("id"), F.col("source_type").alias("type"), F.coalesce("title", "source_id").alias("title"), F.coalesce("authority", F.lit(0.8)).alias("authority"), "path")
    products = sources.groupBy("product_id", "category", "product_ord").agg(F.sort_array(F.collect_list(info)).alias("sources"), F.max("error").alias("error"))
    products = products.where("error is null").drop("error").join(source_counts, "product_id", "left")
    counted = lambda c, s: F.coalesce(F.try_element_at(F.col(c), s["src_ord"]), F.lit(0)).alias(c)
    listed = lambda s: F.struct(*[s[k].alias(k) for k in ("id", "type", "title", "authority")], *[counted(c, s) for c in ("lines", "fields_extracted")], s["path"].alias("path"))
    bare = lambda s: s.dropFields("src_ord", "rule_ord", "eff")
    one = F.struct(
        "field_ord", "field", "label", F.col("canonical_unit").alias("unit"), "type", "display", "confidence", "status", "flags",
        F.transform("sources", bare).alias("sources"), "conflicts", "reasoning", F.transform("dropped", bare).alias("dropped"), "validation_issues",
    )
    fused = routed.groupBy("product_id").agg(
        F.sort_array(F.collect_list(one)).alias("fields"), F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.count_if("conflict").alias("conflicts"), F.count("*").alias("extracted"),
    )
    queued = queue.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("queue_key", "field", "label", "confidence", "flags", "reason", "type", "display", "sources"))).alias("queue"))
    schema = fields.groupBy("category").agg(F.first("category_label").alias("category_label"), F.sort_array(F.collect_list(F.struct("field_ord", "field"))).alias("schema_fields"))
    seen = observed.groupBy("product_id").agg(F.collect_set("field").alias("seen"))
    rows = products.join(F.broadcast(schema), "category", "left")
    for part in (fused, validated, queued, reviewed, copy, seen):
        rows = rows.join(part, "product_id", "left")
    missing = F.filter(F.transform("schema_fields", lambda f: f["field"]), lambda f: ~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), f))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "product_id", "product_ord", "category", F.coalesce("category_label", "category").alias("category_label"), F.lit(mode).alias("mode"),
        F.transform("sources", listed).alias("sources"), F.coalesce("fields", F.array().cast(rows.schema["fields"].dataType)).alias("fields"),
        F.coalesce("passed", F.lit(True)).alias("passed"), zero("rules_run").alias("rules_run"), F.coalesce("issues", F.array().cast(rows.schema["issues"].dataType)).alias("issues"),
        F.coalesce("queue", F.array().cast(rows.schema["queue"].dataType)).alias("needs_review_queue"), "description", "citations", "sentences_skipped",
        F.col("summary").alias("review_summary"), "fields_reviewed", "all_clear", F.coalesce("reviews", F.array().cast(rows.schema["reviews"].dataType)).alias("reviews"),
        F.size("schema_fields").alias("total_fields"), zero("extracted").alias("extracted"), missing.alias("omitted"), zero("verified").alias("verified"), zero("needs_review").alias("needs_review"), zero("conflicts").alias("conflicts"),
    )


def record_json(rows: DataFrame) -> DataFrame:
    """(product_id, category, json): the record as a JSON document without its run time."""
    # A value is a JSON number or text by its field's type, hence a variant.
    text = lambda x: F.when(x["type"] == "number", F.parse_json(x["display"])).otherwise(F.try_variant_get(F.to_variant_object(F.array(x["display"])), "$[0]", "variant")).alias("value")
    field = lambda x: F.struct(*[x[k].alias(k) for k in ("field", "label", "unit")], text(x), *[x[k].alias(k) for k in ("confidence", "status", "flags", "sources", "conflicts", "reasoning", "dropped", "validation_issues")])
    queued = lambda x: F.struct(*[x[k].alias(k) for k in ("field", "label", "confidence", "flags", "reason")], text(x), x["sources"].alias("sources"))
    review = lambda x: F.struct(*[x[k].alias(k) for k in ("field", "label", "flags", "confidence")], text(x), x["review"].alias("review"), x["suggested_action"].alias("suggested_action"))
    note = F.when(F.col("mode") == "mock", F.lit("deterministic mock (offline)")).otherwise(F.concat("mode", F.lit(" structured output")))
    document = F.struct(
        "product_id", "category", "category_label", F.struct(F.lit(VERSION).alias("version"), "mode", note.alias("provider_note")).alias("pipeline"), "sources",
        F.transform("fields", field).alias("fields"), F.struct("passed", "rules_run", "issues", F.lit(RULE_NOTE).alias("note")).alias("validation"),
        F.transform("needs_review_queue", queued).alias("needs_review_queue"), F.struct("description", "citations", "sentences_skipped", F.lit(NOTE).alias("note")).alias("marketing"),
        F.struct(F.col("total_fields").alias("total_fields_in_schema"), "extracted", F.col("omitted").alias("omitted_not_found"), "verified", "needs_review", "conflicts", "rules_run").alias("summary"),
        F.struct("mode", F.lit(REVIEW_NOTE).alias("provider_note"), F.transform("reviews", review).alias("reviews"), F.col("review_summary").alias("summary"), "fields_reviewed", "all_clear").alias("ai_review"),
    )
    return rows.select("product_id", "category", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))
