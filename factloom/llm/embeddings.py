"""Near-duplicate embeddings: an exact metric range join by pivots.

Angles between vectors are a metric, and cosine >= COSINE is an angle of at most
EPS.  A vector's home cell is that of its nearest pivot, within its label and
dimension.  By the triangle inequality a vector can only have a partner at home in
cell j if its angle to pivot j is at most its angle to its own pivot plus 2 EPS,
and at most cell j's radius plus EPS; it is replicated to just those cells.  Cells
are joined independently: blocks of home vectors meet blocks of all vectors sent to
the cell, so no task holds more than two blocks however large a cell grows.

Equal vectors of a label are one node with a count, so copies aren't compared.
A block pair gives each home vector's number of links and a spanning forest of the
links it found, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, col, connected_components

COSINE = 0.93
#: A little over the angle, so that rounding loses no pair; cosines decide.
EPS = float(np.arccos(COSINE)) + 1e-6
#: Home vectors of a cell aimed at, and bounds of the pivots in number and bytes.
CELL = 2048
MOST_PIVOTS, PIVOT_BYTES = 4096, 32_000_000
#: Vectors in a block: with 64 components, half a megabyte.
BLOCK = 1024
#: Rows of the table of cells (24 bytes each) up to which it is broadcast.
BROADCAST_CELLS = 500_000
#: Numbers from here on stand for vectors without an id.
NAMELESS = 1 << 62


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, scaled first so that squares don't overflow."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles to the pivots, both padded with zeros to one dimension."""
    d = min(unit.shape[1], pivots.shape[1])
    return np.arccos(np.clip(unit[:, :d] @ pivots[:, :d].T, -1.0, 1.0))


def _stack(column: pa.Array) -> np.ndarray:
    """The vectors (all of one length) of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_dimension(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose vectors have equal length."""
    lengths = pc.list_value_length(batch.column(place)).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        yield batch if (lengths == d).all() else batch.take(pa.array(np.flatnonzero(lengths == d)))


CELLS = T.StructType([T.StructField("group", T.StringType()), T.StructField("home", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("radius", T.DoubleType())])
SIZES = T.StructType([T.StructField("group", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())])
FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def _counted(group: pa.Array, cell: np.ndarray, angle: np.ndarray | None = None) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Per group: cells, how many rows each has, and their largest angles."""
    names = group.dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    for code, name in enumerate(names.dictionary.to_pylist()):
        mine = codes == code
        cells, inverse, n = np.unique(cell[mine], return_inverse=True, return_counts=True)
        most = np.zeros(cells.size)
        if angle is not None:
            np.maximum.at(most, inverse, angle[mine])
        yield name, cells, n, most


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, smallest id of its component) for links i-j between positions."""
    label = ids.copy()
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != ids)
    return label[moved], ids[moved]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link counts (b null) and forest edges (n null) of pairs of blocks."""
    for batch in batches:
        for at in range(batch.num_rows):
            a, b = (batch.column(side).slice(at, 1).flatten() for side in (0, 1))
            va, vb = (_unit(m.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)) for m in (a, b))
            na, nb = (m.field("node").to_numpy(zero_copy_only=False) for m in (a, b))
            copies = b.field("copies").to_numpy(zero_copy_only=False)
            linked = (va @ vb.T >= COSINE) & (na[:, None] != nb[None, :])
            counts = linked @ copies
            some = np.flatnonzero(counts)
            i, j = np.nonzero(linked)
            ids, inverse = np.unique(np.concatenate([na, nb]), return_inverse=True)
            low, high = _forest(ids, inverse[i], inverse[na.size + j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([na[some], low])), pa.array([None] * some.size + high.tolist(), pa.int64()), pa.array(counts[some].tolist() + [None] * low.size, pa.int64())],
                FOUND.names,
            )


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Null vectors, vectors that are empty or zero, and those with a null or
    non-finite component link with nothing, nor do rows with a null label or
    vectors of different length.  Repeated rows count as other vectors that are
    linked.  A null id takes part in no component: its component is null, kept is
    false, its number of links counts all the same.  A table without rows gives an
    empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    # Components are kept as they are given; workers compute in double precision.
    number = "float" if vectors.select(col(vector_col)).dtypes[0][1] == "array<float>" else "double"
    raw = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).cast(f"array<{number}>").alias("v"), col(label_col).cast("string").alias("label"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value.
    raw = raw.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0).cast(number))))
    there, group = F.col("v").isNotNull(), F.concat_ws("|", F.size("v"), "label")
    # Two hashes of 64 bits stand for a vector and its label.
    raw = raw.select("id", "v", F.when(there, group).alias("group"), *[F.when(there, F.xxhash64(F.lit(k), group, "v")).alias(f"d{k}") for k in (1, 2)])
    rows = scratch.keep(raw.select("id", "d1", "d2"), "rows")
    nodes = raw.where(there).groupBy("d1", "d2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.any_value("group").alias("group"), F.any_value("v").alias("v"))
    # A node without any id gets a number above all ids, made from its hash.
    nodes = scratch.keep(nodes.withColumn("node", F.coalesce("least", F.shiftrightunsigned("d1", 2) + F.lit(NAMELESS))), "nodes")

    largest = nodes.groupBy("group").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).agg(F.max("n").alias("n"), F.max("width").alias("width")).first()
    wanted = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * (largest["width"] or 1)), -(-(largest["n"] or 0) // CELL)))
    picked = nodes.orderBy("d1", "d2").limit(wanted).select("v").collect()
    if picked:
        width = max(len(r["v"]) for r in picked)
        pivots = _unit(np.array([[*r["v"], *[0.0] * (width - len(r["v"]))] for r in picked]))
    else:
        pivots = np.ones((1, 1))
    shared = spark.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_dimension(whole, 1):
                angles = _angles(_unit(_stack(batch.column(1))), shared.value)
                home = angles.argmin(axis=1)
                for name, cells, n, most in _counted(batch.column(0), home, angles[np.arange(len(home)), home]):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * cells.size, pa.string()), pa.array(cells, pa.int32()), pa.array(n, pa.int64()), pa.array(most)], CELLS.names)

    cells = scratch.keep(nodes.select("group", "v").mapInArrow(homes, CELLS).groupBy("group", "home").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")), "cells")
    reached = _Reach(cells, shared, cells.count() <= BROADCAST_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, at, cell in reached(batches):
            for name, cells, n, _ in _counted(batch.column(0).take(pa.array(at)), cell):
                yield pa.RecordBatch.from_arrays([pa.array([name] * cells.size, pa.string()), pa.array(cells, pa.int32()), pa.array(n, pa.int64())], SIZES.names)

    kind = nodes.schema["v"].dataType
    sent_type = T.StructType([T.StructField("group", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("at_home", T.BooleanType()), T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("v", kind)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, home, at, cell in reached(batches):
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell.astype(np.int32)), pa.array(cell == home[at]), part.column(2), part.column(3), part.column(1)], sent_type.names)

    asked = reached.rows(nodes.select("group", "v", "node", "copies"))
    sizes = scratch.keep(asked.mapInArrow(count, SIZES).groupBy("group", "cell").agg(F.sum("n").alias("size")), "sizes")
    parts = F.ceil(F.col("size") / F.lit(BLOCK))
    dealt = asked.mapInArrow(send, sent_type).join(sizes, ["group", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), parts))
    blocks = dealt.groupBy("group", "cell", "at_home", "part").agg(F.collect_list(F.struct("node", "copies", "v")).alias("block"))
    blocks = scratch.keep(blocks, "blocks")
    left = blocks.where("at_home").select("group", "cell", F.col("block").alias("left"))
    right = blocks.select("group", "cell", F.col("block").alias("right"))
    found = scratch.keep(left.join(right, ["group", "cell"]).select("left", "right").mapInArrow(_compare, FOUND), "found")
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("b is not null").select("a", "b"), scratch)
    known = nodes.select("d1", "d2", "node", "copies").join(counts, "node", "left").join(components.withColumnRenamed("id", "node"), "node", "left")
    component = F.coalesce("component_id", "node")
    known = known.select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.when(component < NAMELESS, component).alias("component"))
    known = scratch.keep(known, "known")
    out = rows.join(known, ["d1", "d2"], "left")
    component = F.when(F.col("d1").isNull(), F.col("id")).otherwise(F.col("component"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


class _Reach:
    """Which cells each vector is sent to: by its angles to the pivots and the radii of its group's cells.

    Called with batches of (group, v, ...), gives (batch, homes, rows, cells): the
    i-th of rows goes to the i-th of cells.  radii come from a broadcast, or, where the
    table of cells is too large for that, with the rows as two further columns.
    """

    def __init__(self, cells: DataFrame, shared: Broadcast, few: bool):
        self.shared, self.known = shared, None
        if few:
            table: dict[str, tuple[list, list]] = {}
            for r in cells.select("group", "home", "radius").collect():  # BROADCAST_CELLS at most
                own = table.setdefault(r["group"], ([], []))
                own[0].append(r["home"])
                own[1].append(r["radius"])
            self.known = cells.sparkSession.sparkContext.broadcast({g: (np.array(h, np.int64), np.array(x)) for g, (h, x) in table.items()})
            self.cells = None
        else:
            pairs = F.sort_array(F.collect_list(F.struct("home", "radius")))  # as many as there are pivots at most
            self.cells = cells.groupBy("group").agg(pairs.alias("p")).select("group", F.transform("p", lambda x: x["home"]).alias("homes"), F.transform("p", lambda x: x["radius"]).alias("radii"))

    def rows(self, rows: DataFrame) -> DataFrame:
        return rows if self.cells is None else rows.join(self.cells, "group")

    def __getstate__(self) -> dict:
        return {"shared": self.shared, "known": self.known}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        pivots = self.shared.value
        for whole in batches:
            for batch in _by_dimension(whole, 1):
                names = batch.column(0).dictionary_encode()
                codes = names.indices.to_numpy(zero_copy_only=False)
                angles = _angles(_unit(_stack(batch.column(1))), pivots)
                home = angles.argmin(axis=1)
                own = angles[np.arange(len(home)), home]
                at, to = [], []
                for code, name in enumerate(names.dictionary.to_pylist()):
                    mine = np.flatnonzero(codes == code)
                    if self.known is not None:
                        cells, radii = self.known.value[name]
                    else:
                        cells, radii = (batch.column(batch.schema.get_field_index(c)).slice(mine[0], 1).flatten().to_numpy(zero_copy_only=False) for c in ("homes", "radii"))
                    goes = angles[np.ix_(mine, cells)] <= np.minimum(own[mine, None] + 2 * EPS, radii + EPS)
                    goes |= cells == home[mine, None]
                    i, j = np.nonzero(goes)
                    at.append(mine[i])
                    to.append(cells[j])
                yield batch, home, np.concatenate(at), np.concatenate(to).astype(np.int64)


def op10(vectors: DataFrame) -> DataFrame:
    """The contract's rows: vec_id, n_links, component_id, kept."""
    return near_duplicates(vectors)
