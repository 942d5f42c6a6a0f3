"""The whole plan: sources to records, for all products in one job."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import catalog_rows
from ..operators.extract import Extractor, RuleExtractor
from ..operators.fuse import fuse
from ..operators.marketing import marketing
from ..operators.normalize import normalize
from ..operators.record import records
from ..operators.review import Reviewer, TemplateReviewer, review_summary
from ..operators.route import review_queue, route_checked
from ..operators.validate import check_rules, checks_run, validated
from ..registry.categories import Category
from ..registry.tables import field_table, rule_table
from ..sources.documents import blocks


@dataclass(frozen=True)
class FusionResult:
    blocks: DataFrame
    observations: DataFrame
    normalized: DataFrame
    fused: DataFrame
    checks: DataFrame
    routed: DataFrame
    queue: DataFrame
    reviews: DataFrame
    records: DataFrame
    catalog: DataFrame


Keep = Callable[[str, DataFrame], DataFrame]


def tables_in(folder: str, parts: int | None = None) -> Keep:
    """Keeps a stage as a Parquet table, so that later stages read it instead of planning it anew.

    With parts the table is in so many buckets by product: stages that group or join by
    product read it as it lies.  Its name goes from the session's catalog at once, its files stay.
    """

    def keep(name: str, df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, f"{folder}/{name}"
        if parts is None:
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        table = f"factloom_{name}_{uuid.uuid4().hex}"
        df.repartition(parts, "product_id").write.mode("overwrite").bucketBy(parts, "product_id").option("path", path).saveAsTable(table)
        kept = spark.table(table)
        spark.sql(f"DROP TABLE {table}")
        return kept

    return keep


def _by_source(rows: DataFrame, name: str) -> DataFrame:
    """(product_id, name): how many rows each source of a product has, as a map by src_ord."""
    counted = rows.groupBy("product_id", "src_ord").agg(F.count("*").alias("n"))
    return counted.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("src_ord", "n"))).alias(name))


def run(sources: DataFrame, categories: Iterable[Category] | None = None, extractor: Extractor | None = None, reviewer: Reviewer | None = None, mode: str = "mock", keep: Keep | None = None, parts: int | None = None) -> FusionResult:
    """Every stage lazily; what is asked for decides what runs.

    Registry tables are of fixed size and broadcast.  Several later stages read the
    observations and the routed fields: for large inputs give parts and
    `keep=tables_in(shared folder, parts)`, some thousand products to a part.  Sources are
    then dealt out by product once, both tables are written once, and nothing else of the
    data's size is shuffled.
    """
    keep = keep or (lambda name, df: df)
    spark = sources.sparkSession
    categories = list(categories) if categories is not None else None
    fields = field_table(spark, categories)
    lines = blocks(sources, parts)
    extractor = extractor or RuleExtractor(rule_table(spark, categories))
    observed = keep("observations", extractor.extract(lines))
    failures = getattr(extractor, "failures", None)
    if failures is not None:
        told = failures.withColumnRenamed("error", "told")
        sources = sources.join(told, ["product_id", "source_id"], "left").withColumn("error", F.coalesce("error", "told")).select(*sources.columns)
    if parts is not None:
        sources = sources.repartition(parts, "product_id")
    normalized = normalize(observed, fields)
    fused = fuse(normalized)
    ran = checks_run(categories)
    routed = keep("routed", route_checked(fused, ran=ran))
    checks = check_rules(routed, ran=ran)
    queue = review_queue(routed)
    reviews = (reviewer or TemplateReviewer()).review(queue, sources)
    products = sources.select("product_id").distinct()
    counted = _by_source(lines, "lines").join(_by_source(observed, "fields_extracted"), "product_id", "left")
    rows = records(sources, counted, fields, routed, validated(routed, ran=ran), queue, review_summary(reviews, products), marketing(routed), observed, mode)
    return FusionResult(lines, observed, normalized, fused, checks, routed, queue, reviews, rows, catalog_rows(sources, rows))
