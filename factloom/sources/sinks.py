"""Where records and catalogs go: JSON documents, the index, and its CSV snapshot."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.catalog import COUNTERS, catalog_totals
from ..operators.record import VERSION, record_json


def write_records(records: DataFrame, folder: str) -> None:
    """One JSON document per line, a folder per category; nulls are kept, text isn't escaped."""
    rows = record_json(records)
    rows.select("category", F.col("json").alias("value")).write.mode("overwrite").partitionBy("category").text(folder)


def write_catalog_csv(rows: DataFrame, folder: str) -> None:
    """A header and one row per product in catalog order; blanks where a product failed."""
    out = rows.orderBy("product_ord").select("product_id", "category", "status", *COUNTERS, "extracted", "output")
    out.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


def catalog_index(rows: DataFrame, catalog_id: str, name: str, mode: str = "mock", workers: int = 1) -> DataFrame:
    """One row: the index document as JSON, with the time of the run."""
    kept = F.struct("product_ord", "product_id", "category", "category_label", "status", *COUNTERS, "extracted", "omitted_not_found", "output", "error")
    # The document holds the whole catalog by definition; use the table for large ones.
    listed = rows.agg(F.sort_array(F.collect_list(kept)).alias("p")).select(F.transform("p", lambda p: p.dropFields("product_ord")).alias("products"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    pipeline = F.struct(F.lit(VERSION).alias("version"), F.lit(mode).alias("mode"), F.lit(workers).alias("max_workers"), now.alias("run_at"))
    totals = catalog_totals(rows)
    doc = totals.select(F.struct(*totals.columns).alias("totals")).crossJoin(listed)  # one row each
    return doc.select(F.to_json(F.struct(F.lit(catalog_id).alias("catalog_id"), F.lit(name).alias("name"), pipeline.alias("pipeline"), "totals", "products"), {"ignoreNullFields": "false"}).alias("json"))


def write_sources(sources: DataFrame, folder: str) -> None:
    """What came in, as it came in: appended, a folder per category."""
    sources.write.mode("append").partitionBy("category").parquet(folder)


def read_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """A catalog table if it is there and can be read; None otherwise, so that a first ingest starts anew."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def summary(rows: DataFrame, name: str = "catalog") -> str:
    """A catalog's totals as one line of text."""
    t = catalog_totals(rows).first()
    return f"{name}: {t['products']} products ({t['ok']} ok / {t['failed']} failed), {t['verified']} verified fields, {t['needs_review']} need review, {t['conflicts']} conflicts, {t['rules_run']} rules run"


def product_reports(records: DataFrame) -> DataFrame:
    """(product_id, report): each record as a table of text: counters, fields, queue, description and review."""
    amount = lambda value, unit: strip(F.concat_ws(" ", value, unit))
    values = lambda f: F.concat_ws(" / ", F.flatten(F.transform(f["conflicts"], lambda c: F.transform(c["values"], lambda v: amount(v["value"], v["unit"])))))
    shown = lambda f: F.when(F.size(f["conflicts"]) > 0, values(f)).otherwise(amount(f["display"], f["unit"]))
    line = lambda f: F.format_string("%-26s %-18s %5.2f  %s", f["label"], shown(f), f["confidence"], F.upper(f["status"]))
    queued = lambda q: F.concat(F.lit("  - ["), F.concat_ws(", ", q["flags"]), F.lit("] "), q["label"], F.lit(": "), q["reason"])
    omitted = F.coalesce(F.nullif(F.concat_ws(", ", "omitted"), F.lit("")), F.lit("-"))
    counters = F.format_string("%d verified, %d to review, %d conflicts; %d rules run, passed: %s; not found: %s", "verified", "needs_review", "conflicts", "rules_run", F.col("passed").cast("string"), omitted)
    head = F.array(F.concat_ws("  ", "product_id", "category_label", F.concat(F.lit("("), "mode", F.lit(")"))), counters)
    queue = F.when(F.size("needs_review_queue") > 0, F.concat(F.array(F.lit("To review:")), F.transform("needs_review_queue", queued))).otherwise(F.array().cast("array<string>"))
    skipped = F.transform("sentences_skipped", lambda x: F.concat(F.lit("  - "), x))
    tail = F.concat(F.array(F.concat(F.lit("Description: "), F.coalesce("description", F.lit("")))), F.coalesce(skipped, F.array().cast("array<string>")), F.array(F.concat(F.lit("Review: "), "review_summary")))
    return records.select("product_id", F.concat_ws("\n", F.concat(head, F.transform("fields", line), queue, tail)).alias("report"))


def catalog_report(rows: DataFrame) -> DataFrame:
    """(product_ord, line): a line of text per product of the catalog; failed ones with their error."""
    fine = F.format_string("%-14s%-28s%4d%5d%5d  ok", "product_id", F.substring(F.coalesce("category_label", "category"), 1, 27), "verified", "needs_review", "conflicts")
    failed = F.format_string("%-14s%-28s%4s%5s%5s  FAILED  %s", "product_id", F.lit("-"), F.lit("-"), F.lit("-"), F.lit("-"), "error")
    return rows.select("product_ord", F.when(F.col("status") == "ok", fine).otherwise(failed).alias("line"))
