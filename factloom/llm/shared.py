"""Pieces the corpus operators share: scratch tables, fresh column names, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java regex of a word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound what they get at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *have])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder that goes at exit;
    any other session must set it, as no other folder is known to be shared.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = getattr(sc, "_factloom_shared", None)
    if known is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
        known = sc._factloom_shared = f"file://{known}"
    return known


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor, and reading it back gives
    both sides of a later join an exchange, which adaptive execution can split
    where a key is hot.  They stay until release(), as results read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        spark.sparkContext.__dict__.setdefault("_factloom_scratch", []).append(self.base)

    def keep(self, df: DataFrame, label: str = "t", options: dict[str, str] | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:02d}-{label}"
        df.write.options(**options or {}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, label: str) -> None:
        """Rows of one of many blocks, gathered in one table."""
        df.write.mode("append").parquet(f"{self.base}/{label}")

    def added(self, schema: T.StructType, label: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{label}")


def release(spark: SparkSession) -> int:
    """Delete the session's scratch tables, once all results made from them are written; how many there were."""
    made, sc = spark.sparkContext.__dict__.pop("_factloom_scratch", []), spark.sparkContext
    for base in made:
        path = sc._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names like `bases` that df doesn't have (names compare without case)."""
    have, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, i = base, 0
        while name.lower() in have:
            i += 1
            name = f"{base}_{i}"
        have.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ids_clash(rows: DataFrame, id_col: str) -> bool:
    """Whether some id is null or repeats; only ids and their counts are shuffled."""
    seen = rows.select(col(id_col).cast("string").alias("id")).groupBy("id").count()
    return not seen.where("id is null or count > 1").isEmpty()


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo `modulus` (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component_id) of each vertex of edges(a, b): the smallest id it reaches.

    Each round maps a vertex to its neighbour (or itself) of least priority and
    contracts the graph by that map: ids order the first round, hashes the later
    ones, so long chains shrink geometrically too.  Minima are combined before
    they are shuffled and every join has an exchange on both sides, so a vertex
    with very many edges is split over tasks.  Only counts reach the driver.
    """
    graph = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    turn = 0
    while turn == 0 or not graph.isEmpty():
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: c) if turn == 0 else (lambda c, t=turn: F.xxhash64(F.lit(t), c))
        best = F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("v"))).alias("m")
        own = F.struct(rank(F.col("a")).alias("r"), F.col("a").alias("v"))
        step = both.groupBy("a").agg(best).select("a", F.least("m", own)["v"].alias("to"))
        step = scratch.keep(step, "step")
        maps.append(step)
        graph = (
            graph.join(step.withColumnRenamed("to", "x"), "a")
            .join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct()
        )
        graph = scratch.keep(graph, "edges")
        turn += 1
    labels = maps[0].select(F.col("a").alias("id"), F.col("to").alias("label"))
    for step in maps[1:]:
        step = step.select(F.col("a").alias("label"), "to")
        labels = scratch.keep(labels.join(step, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    least = scratch.keep(labels.groupBy("label").agg(F.min("id").alias("component_id")), "least")
    return labels.join(least, "label").select("id", "component_id")
