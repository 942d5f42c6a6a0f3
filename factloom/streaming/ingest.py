"""Continuous ingest: dropped payload files go through the whole plan and replace their products.

Fusion is per product and a product that comes again replaces its record, so no
state is kept between batches: each micro-batch is planned like a batch job, and
the catalog table is upserted.  The catalog is a folder of generations; a pointer
row per generation makes a batch that is replayed after a failure harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.record import record_json
from ..plans.fusion import Keep, run, tables_in
from ..sources.manifests import from_payloads

PAYLOAD = "product_id string, category string, sources array<struct<id:string,type:string,title:string,text:string,authority:double>>"


def ingest(payloads: DataFrame, keep: Keep | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records as JSON, catalog rows, rejected payloads with their reason) of a batch.

    Of payloads for one product in a batch the one that sorts last as JSON stays.
    """
    last = Window.partitionBy("product_id").orderBy(F.to_json(F.struct("category", "sources")).desc())
    one = payloads.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    sources, rejected = from_payloads(one)
    result = run(sources, keep=keep)
    return record_json(result.records), result.catalog, rejected


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Reads JSON payloads dropped into `folder`; everything there now, then stops.

    Writes out/records/batch=N, out/catalog/batch=N and out/rejected/batch=N; a
    replayed batch overwrites its own folders.  `latest` gives the current catalog.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        records, catalog, rejected = ingest(batch, tables_in(f"{out}/stages/batch={number}"))
        for name, table in (("records", records), ("catalog", catalog), ("rejected", rejected)):
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()
        if then is not None:
            then(number)

    stream = spark.readStream.schema(PAYLOAD).json(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame, key: str = "product_id") -> DataFrame:
    """The rows of each product's last batch, of a table written by `start`."""
    newest = table.groupBy(key).agg(F.max("batch").alias("batch"))
    return table.join(newest, [key, "batch"], "left_semi")
