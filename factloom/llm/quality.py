"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded, windows of WIDTH bytes every STRIDE bytes meet learned filters,
and chunks of CHUNK windows, whose bytes overlap by WIDTH - STRIDE, cover the whole
document.  Each chunk keeps every filter's maximum.  The largest and the mean of
these maxima over all chunks go through one hidden layer to one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, col, fold, fresh, text_bytes

FOLDS, HELD_OUT = 3, 1
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 2, 24, 12
CHUNK = 128
#: Windows worked on at once, a multiple of CHUNK; bounds memory for very long texts.
SLAB = 64 * CHUNK
#: Bounds of the training sample in rows, half of them for each label, and in bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 32_000_000
EPOCHS, BATCH, RATE, DECAY = 6, 16, 0.01, 1e-4


@dataclass
class Net:
    """Parameters; the last byte embedding stands for what lies past the end."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float = 0.0

    NAMES = ("embed", "filters", "bias", "w1", "b1", "w2", "b2")

    @classmethod
    def new(cls, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(f(257, EMBED, scale=0.5), f(WIDTH * EMBED, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32), f(2 * FILTERS, HIDDEN, scale=0.2), np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=0.3), np.zeros(1, np.float32))

    def chunk_maxima(self, text: bytes, want_at: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(chunks x filters maxima after the ramp, and the windows they come from)."""
        windows = max(1, -(-(len(text) - WIDTH + STRIDE) // STRIDE))
        tops, places = [], []
        for at in range(0, windows, SLAB):
            count = min(SLAB, windows - at)
            raw = np.full((count - 1) * STRIDE + WIDTH, 256, np.int64)
            piece = np.frombuffer(text[at * STRIDE : at * STRIDE + raw.size], np.uint8)
            raw[: piece.size] = piece
            vectors = self.embed[raw]
            view = np.lib.stride_tricks.as_strided(vectors, (count, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
            out = view @ self.filters
            starts = np.arange(0, count, CHUNK)
            tops.append(np.maximum.reduceat(out, starts, axis=0))
            if want_at:
                ends = [*starts[1:], count]
                places += [at + s + out[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)]
        top = np.concatenate(tops) + self.bias
        return np.maximum(top, 0), np.array(places) if want_at else None

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        both = np.concatenate([pooled.max(axis=0), pooled.mean(axis=0)])
        hidden = np.tanh(both @ self.w1 + self.b1)
        return both, hidden, float(hidden @ self.w2 + self.b2[0])

    def score(self, text: bytes | None) -> float:
        """Probability that the document is of label 1."""
        z = self.head(self.chunk_maxima(text or b"")[0])[2] + self.prior
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _gradients(net: Net, text: bytes, label: int, grads: dict[str, np.ndarray], weight: float) -> None:
    pooled, places = net.chunk_maxima(text, want_at=True)
    both, hidden, z = net.head(pooled)
    dz = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label)
    dh = dz * net.w2 * (1 - hidden * hidden)
    grads["w2"] += dz * hidden
    grads["b2"] += dz
    grads["w1"] += both[:, None] * dh
    grads["b1"] += dh
    d = net.w1 @ dh
    dp = np.repeat(d[None, FILTERS:] / len(pooled), len(pooled), axis=0)
    dp[pooled.argmax(axis=0), np.arange(FILTERS)] += d[:FILTERS]
    dp *= pooled > 0
    grads["bias"] += dp.sum(axis=0)
    c, f = np.nonzero(dp)
    if not c.size:
        return
    raw = np.frombuffer(text, np.uint8)
    at = places[c, f][:, None] * STRIDE + np.arange(WIDTH)
    byte = np.where(at < raw.size, raw[np.minimum(at, max(raw.size - 1, 0))] if raw.size else 256, 256)
    step = dp[c, f][:, None]
    np.add.at(grads["filters"].T, f, net.embed[byte].reshape(c.size, -1) * step)
    np.add.at(grads["embed"], byte, (net.filters.T[f] * step).reshape(c.size, WIDTH, EMBED))


def train(rows: list[tuple[bytes, int]], log_odds: float | None = None) -> Net:
    """Adam over rows of (text, label) in a fixed order.

    log_odds of label 1 among all labelled rows corrects for the sample's balance.
    Without rows nothing is known, and every document scores 0.5.
    """
    net = Net.new()
    ones = sum(y for _, y in rows)
    if not rows:
        net.w2[:] = 0
        return net
    shift = float(np.log((ones + 1) / (len(rows) - ones + 1)))
    if 0 < ones < len(rows):
        first = {k: np.zeros_like(getattr(net, k)) for k in Net.NAMES}
        second = {k: np.zeros_like(getattr(net, k)) for k in Net.NAMES}
        step, total = 0, EPOCHS * -(-len(rows) // BATCH)
        for epoch in range(EPOCHS):
            order = np.random.default_rng(epoch).permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                grads = {k: np.zeros_like(getattr(net, k)) for k in Net.NAMES}
                part = order[at : at + BATCH]
                for i in part:
                    _gradients(net, *rows[i], grads, 1 / len(part))
                step += 1
                rate = RATE * (1 - step / (total + 1)) + 1e-4
                for k in Net.NAMES:
                    value = getattr(net, k)
                    g = grads[k] + DECAY * value
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    value -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    else:
        net.w2[:] = 0
        net.b2[:] = shift
    net.prior = 0.0 if log_odds is None else log_odds - shift
    return net


MODEL = T.StructType([T.StructField("part", T.StringType()), T.StructField("values", T.BinaryType())])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Net:
    """Train on rows of the learning folds whose label is 0 or 1.

    Each label gets the rows whose id hashes below a share that gives it half of
    sample_rows; the join is with these few rows only.  Of documents that repeat an
    id one is learned, the one whose text sorts first; an id with both labels is
    learned with each.  In the order of their hashes, documents are learned up to
    sample_bytes of text.  Null ids are never learned from, and neither is a null
    text.  With labels of one kind only, every document gets that kind's share.
    Where nothing is left to learn from, every document scores 0.5, and keep_good
    drops none.
    """
    spark = docs.sparkSession
    marks = labels.select(col(label_id).alias("id"), col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    marks = marks.where(fold(F.col("id"), FOLDS) != HELD_OUT).withColumn("h", F.xxhash64(F.col("id").cast("string")))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if not counts:
        return train([])
    share = None
    for y, n in counts.items():
        this = (F.col("y") == y) & (F.pmod("h", F.lit(1 << 30)) < int(min(1.0, sample_rows / 2 / n) * (1 << 30)))
        share = this if share is None else share | this
    scratch = Scratch(spark, "quality")
    chosen = scratch.keep(marks.where(share).dropDuplicates(["id", "y"]), "chosen")
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").cast("binary").alias("text")).where("text is not null")
    # About sample_rows rows of ids and labels: a bounded broadcast.
    sample = texts.join(F.broadcast(chosen), "id").groupBy("h", "y").agg(F.min("text").alias("text"))
    # About sample_rows rows by now, so one window may order them.
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("h", "y"))
    sizes = scratch.keep(sample, "sample").withColumn("upto", upto)
    sample = sizes.where(F.col("upto") <= sample_bytes).drop("upto")
    log_odds = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        net = train([(text, y) for _, y, text in rows], log_odds)
        parts = [*Net.NAMES, "prior"]
        yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array([np.asarray(getattr(net, k), np.float64 if k == "prior" else np.float32).tobytes() for k in parts], pa.binary())], MODEL.names)

    got = {r["part"]: r["values"] for r in sample.repartition(1).mapInArrow(run, MODEL).collect()}
    net = train([])
    if got:
        for k in Net.NAMES:
            setattr(net, k, np.frombuffer(got[k], np.float32).reshape(getattr(net, k).shape))
        net.prior = float(np.frombuffer(got["prior"], np.float64)[0])
    return net


def assess(docs: DataFrame, net: Net, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the probability of label 1, from the text alone.

    Null and empty texts are scored alike, as an empty document.  The added name
    avoids those of docs; the other columns pass through.
    """
    (name,) = fresh(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = [net.score(t) for t in text_bytes(part.column(place))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema), {"score": name}


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **columns: str) -> DataFrame:
    """docs without those whose probability of label 1 is below `least`."""
    found, names = assess(docs, fit(docs, labels, **columns), columns.get("text_col", "text"))
    return found.where(F.col(names["score"]) >= least).select(*map(col, docs.columns))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted.  A null id is held out."""
    found, names = assess(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True))
    score = F.col(names["score"])
    return found.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
