"""Packed token matrices: best-fit-decreasing with capacity search in a segment tree.

Each task packs the documents that it reads, in shards of about SHARD_BYTES of text:
nothing is shuffled, and copies of a text are rows like any others.  A shard's texts
are encoded, cut without loss into pieces of at most CONTEXT tokens, and
packed in falling order of length, each into the fullest row that still has room.
A row is a fixed-width row of ids with the cumulative lengths of its segments and
positions that start anew at each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PATTERN
from .shared import col, text_bytes

CONTEXT = 2048
PAD = 50256
SHARD_BYTES = 4_000_000


_ENCODERS: dict[str, object] = {}


def ranked_encoder(path: str):
    """The worker's encoder for a file of ranked tokens; added tokens are ordinary text to it."""
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


class Capacities:
    """How many open rows have each free capacity, summed in a segment tree.

    `fit(n)` finds the least capacity from n on that some row has, in O(log CONTEXT).
    """

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.sums = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, change: int) -> None:
        at = capacity + self.size
        while at:
            self.sums[at] += change
            at >>= 1

    def put(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def fit(self, need: int) -> int | None:
        """Takes a row of the least sufficient capacity out; None if there is none."""
        at = need + self.size
        if not self.sums[at]:
            # Up to the first right-hand neighbour that holds a row, then down to its first leaf.
            while at > 1 and (at & 1 or not self.sums[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.sums[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._add(capacity, -1)
        return self.rows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Rows of piece numbers; ties in length go by number."""
    order = np.lexsort((np.arange(lengths.size), -lengths))
    free, rows, left = Capacities(most), [], []
    for i in order.tolist():
        n = int(lengths[i])
        row = free.fit(n) if n < most else None
        if row is None:
            row = len(rows)
            rows.append([])
            left.append(most)
        rows[row].append(i)
        left[row] -= n
        if left[row]:
            free.put(row, left[row])
    return rows


PACKED = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("positions", T.BinaryType()),
    ]
)


def _packed(shard: int, found: list[tuple[int | None, bytes]], encoder, context: int, pad: int) -> pa.RecordBatch:
    """A shard's rows."""
    found.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    pieces: list[tuple[int | None, int, np.ndarray]] = []
    for doc, text in found:
        ids = np.array(encoder.encode_ordinary(text.decode()), np.uint32)
        pieces += [(doc, s, ids[s : s + context]) for s in range(0, ids.size, context)]
    out = {k: [] for k in PACKED.names}
    for r, members in enumerate(best_fit_decreasing(np.array([p[2].size for p in pieces], np.int64), context)):
        parts = [pieces[i] for i in members]
        ends = np.cumsum([p[2].size for p in parts])
        fill = context - int(ends[-1])
        ids = np.concatenate([*(p[2] for p in parts), np.full(fill, pad, np.uint32)]).astype("<u4")
        positions = np.concatenate([*(np.arange(p[2].size) for p in parts), np.zeros(fill, np.int64)]).astype("<u4")
        for k, v in zip(PACKED.names, (shard, r, [p[0] for p in parts], [p[1] for p in parts], [0, *ends.tolist()], int(ends[-1]), ids.tobytes(), positions.tobytes()), strict=True):
            out[k].append(v)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in zip(PACKED.names, kinds, strict=True)], PACKED.names)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, pad: int = PAD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed rows of all texts; path is a file of ranked tokens.

    doc_ids and starts say of which document, and from which of its tokens on, each
    segment is; cu_seqlens has 0 and the end of each segment.  ids and positions
    are `context` little-endian unsigned 32-bit numbers; the rest of a row is `pad`
    at position 0.  Null and empty texts have no tokens and so no segment.  Null
    ids stay null in doc_ids.  Repeated rows are packed as often as they occur, and a
    text longer than a row, or a shard, in as many pieces as it takes.  A shard's
    number is its task's, times 2 ** 32, and its place in it: the same files read
    alike give the same rows.
    """
    rows = docs.select(col(id_col).cast("long"), col(text_col).cast("string")).where(col(text_col) != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = ranked_encoder(path), TaskContext.get().partitionId() << 32
        found, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                found.append((doc, text))
                size += len(text)
                if size >= shard_bytes:
                    yield _packed(shard, found, encoder, context, pad)
                    found, size, shard = [], 0, shard + 1
        if found:
            yield _packed(shard, found, encoder, context, pad)

    return rows.mapInArrow(run, PACKED)


def write(packed: DataFrame, folder: str) -> None:
    """The rows as Parquet, one file group per shard order; ids and positions stay binary matrices' rows."""
    packed.sortWithinPartitions("shard", "row").write.mode("overwrite").parquet(folder)


def matrix(rows: list, column: str = "ids") -> np.ndarray:
    """Collected rows' ids (or positions) as one matrix, a row for each."""
    return np.stack([np.frombuffer(r[column], "<u4") for r in rows]) if rows else np.zeros((0, 0), "<u4")


def op7(docs: DataFrame, path: str) -> DataFrame:
    """Each packed row with its segments and the digests of its ids and positions."""
    p = pack(docs.select("doc_id", "text"), path)
    return p.select("shard", "row", "doc_ids", "starts", "cu_seqlens", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))
