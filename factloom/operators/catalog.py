"""The catalog index: a row per product, totals, upserts and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ("verified", "needs_review", "conflicts", "rules_run")


def catalog_rows(sources: DataFrame, record_rows: DataFrame, outputs: str = "output") -> DataFrame:
    """One row per product of the catalog; products with an unreadable source have failed."""
    asked = sources.groupBy("product_id", "product_ord").agg(F.max("error").alias("error"))
    rows = asked.join(record_rows.select("product_id", "category", "category_label", *COUNTERS, "extracted", F.col("omitted").alias("omitted_not_found")), "product_id", "left")
    failed = F.col("error").isNotNull()
    return rows.select(
        "product_id", "product_ord", F.when(~failed, F.col("category")).alias("category"), F.when(~failed, F.col("category_label")).alias("category_label"), F.when(failed, "failed").otherwise("ok").alias("status"),
        *[F.when(~failed, F.coalesce(c, F.lit(0))).alias(c) for c in (*COUNTERS, "extracted")], F.when(~failed, F.col("omitted_not_found")).alias("omitted_not_found"),
        F.concat(F.lit(f"{outputs}/"), "product_id", F.lit("_product.json")).alias("output"), "error",
    )


def catalog_totals(rows: DataFrame) -> DataFrame:
    """One row: products, ok, failed and the counters over ok products."""
    ok = F.col("status") == "ok"
    return rows.agg(F.count("*").alias("products"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in COUNTERS])


def published(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(product_id, category, json) of the products that didn't fail: their records by product."""
    return records.join(rows.where("status = 'ok'").select("product_id"), "product_id", "left_semi")


def upsert(index: DataFrame, batch: DataFrame, key: str = "product_id", order: str = "product_ord") -> DataFrame:
    """index without the batch's products, and the batch after it: replaced products move to the end."""
    last = index.agg(F.coalesce(F.max(order), F.lit(-1)).alias("last"))
    placed = batch.crossJoin(F.broadcast(last)).withColumn(order, F.col(order) + F.col("last") + 1).drop("last")  # one row
    return index.join(batch.select(key), key, "left_anti").select(*index.columns).unionByName(placed.select(*index.columns))
