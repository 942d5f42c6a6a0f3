"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Texts become runs of letters with single blanks between; character 1- to 3-grams
are hashed into BUCKETS features.  The model is trained with follow-the-regularised-
leader (per-coordinate rates, an L1 penalty that zeroes weights and an L2 penalty)
on a bounded sample of labelled rows, with document frequencies counted over all
texts of the learning folds, and a temperature fitted on a part of the
sample that training leaves out makes its top probability a confidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, col, fold, fresh, text_bytes

FOLDS, HELD_OUT = 5, 0
BUCKETS_LOG2 = 15
BUCKETS = 1 << BUCKETS_LOG2
#: Bound of the training sample in rows, dealt evenly over languages; features of a row
#: are bounded by BUCKETS.  And bound of the languages, whose weights are trained together.
SAMPLE_ROWS = 3200
MOST_LANGUAGES = 256
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 0.1, 2e-3, 1e-3
#: One row in so many of the sample sets the temperature and trains nothing.
CALIBRATE = 5
SLICE = 1 << 18
UNDETERMINED = "und"

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_SALTS = np.array([0x1B873593, 0xCC9E2D51, 0x38B34AE5], np.uint32)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters, made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_counts(text: str) -> np.ndarray | None:
    """How often each hashed 1- to 3-gram occurs in the whole text; None without letters.

    The text is taken in slices that carry the last two symbols over, so memory
    doesn't grow with its length and no n-gram is lost or counted twice.
    """
    letters, total, seen = _letters(), np.zeros(BUCKETS, np.int64), False
    carry = np.array([32], np.uint32)
    shift = np.uint32(32 - BUCKETS_LOG2)
    for at in range(0, max(len(text), 1), SLICE):
        last = at + SLICE >= len(text)
        x = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[x]
        seen = seen or bool(is_letter.any())
        x = np.concatenate([carry, np.where(is_letter, x, np.uint32(32)), np.full(int(last), 32, np.uint32)])
        blank = x == 32
        drop = np.zeros(x.size, bool)
        drop[1:] = blank[1:] & blank[:-1]
        drop[: carry.size] = False
        x = x[~drop]
        old = carry.size if at else 0
        one = x[old:] * _A
        two = (x[:-1] * _B + x[1:]) * _A
        three = (x[:-2] * _C + x[1:-1] * _B + x[2:]) * _A
        # n-grams that lie in the carried symbols were counted with the slice before
        grams = [one, two[max(old - 1, 0) :], three[max(old - 2, 0) :]]
        hashed = np.concatenate([(g ^ (g >> np.uint32(15))) * _C + salt for g, salt in zip(grams, _SALTS, strict=True)])
        total += np.bincount((hashed >> shift).astype(np.int64), minlength=BUCKETS)
        carry = x[-2:]
    return total if seen else None


def _tf(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


@dataclass
class Model:
    """Languages, inverse document frequencies, weights (features x languages), bias, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        return (x / np.sqrt(x @ x)) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNDETERMINED, 0.0
        at = np.flatnonzero(counts)
        p = _softmax(self.logits(at, _tf(counts[at])) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(max(p[best], 0.0), 1.0))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], corpus: tuple[int, np.ndarray] | None = None) -> Model:
    """rows: feature indices, their tf, and the language, in a fixed order.

    corpus: number of documents and each feature's document frequency; those of rows if None.
    """
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    if corpus is None:
        corpus = len(rows), np.bincount(np.concatenate([at for at, _, _ in rows]), minlength=BUCKETS)
    size, df = corpus
    idf = np.log((1 + size) / (1 + df)) + 1
    data = []
    for at, tf, lang in rows:
        x = tf * idf[at]
        data.append((np.append(at, BUCKETS), np.append(x / np.sqrt(x @ x), 1.0)[:, None], languages.index(lang)))
    apart = [d for i, d in enumerate(data) if i % CALIBRATE == 0] if len(data) >= 4 * CALIBRATE else []
    fit = [d for i, d in enumerate(data) if i % CALIBRATE or not apart]
    z, n = np.zeros((BUCKETS + 1, len(languages))), np.zeros((BUCKETS + 1, len(languages)))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, (np.sign(zz) * L1 - zz) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(fit)):
            at, x, y = fit[i]
            w = weights(at)
            p = _softmax((x * w).sum(axis=0))
            p[y] -= 1.0
            g = x * p
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    w = weights(slice(None))
    model = Model(languages, idf, w[:-1], w[-1], 1.0)
    if apart:
        logits = np.array([(x * w[at]).sum(axis=0) for at, x, _ in apart])
        truth = np.array([y for _, _, y in apart])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        low, high = np.log(0.05), np.log(20.0)
        for _ in range(40):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


SAMPLE = T.StructType([T.StructField("h", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("count", T.BinaryType())])
MODEL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("language", T.StringType()), T.StructField("values", T.BinaryType())])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for h, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            counts = ngram_counts(text.decode())
            if counts is not None:
                at = np.flatnonzero(counts)
                out.append((h, lang, at.astype(np.uint16 if BUCKETS <= 1 << 16 else np.uint32).tobytes(), counts[at].astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_pylist([dict(zip(SAMPLE.names, x, strict=True)) for x in out], schema=pa.schema([("h", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("count", pa.binary())]))


FREQUENCIES = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("n", T.LongType())])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies; feature BUCKETS stands for its documents with letters."""
    df = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for text in text_bytes(batch.column(0)):
            counts = ngram_counts(text.decode())
            if counts is not None:
                df[:BUCKETS] += counts > 0
                df[BUCKETS] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], FREQUENCIES.names)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts(text) with letters, and how many of them have each feature."""
    df = np.zeros(BUCKETS + 1, np.int64)
    # A row per feature, whatever the number of texts.
    for feature, n in texts.where("text is not null").select("text").mapInArrow(_frequencies, FREQUENCIES).groupBy("feature").agg(F.sum("n")).collect():
        df[feature] = n
    return int(df[BUCKETS]), df[:BUCKETS]


def _train(batches: Iterator[pa.RecordBatch], corpus: tuple[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r)
    model = train([(np.frombuffer(at, np.uint16).astype(np.int64), _tf(np.frombuffer(count, np.int32)), lang) for _, lang, at, count in rows], corpus)
    # Any text may be a language, the empty one too, so a column says what a row is.
    kinds = ["head", "idf", *["weights"] * len(model.languages)]
    values = [np.array([model.temperature, *model.bias]), model.idf, *model.weights.T]
    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([None, None, *model.languages], pa.string()), pa.array([np.asarray(v, np.float64).tobytes() for v in values], pa.binary())], MODEL.names)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES) -> Model:
    """Train on rows of the learning folds that have a text and a language.

    The sample holds each language's rows whose id hashes below a share that gives
    it sample_rows over the number of languages; of more languages than
    most_languages only the most frequent are learned, as all weights stay in one
    worker's memory.  Of rows that repeat an id and a language one is learned, the
    one whose text sorts first.  An empty language is one like any other.  Document
    frequencies are those of all texts of the learning folds, with a language or
    without.  Rows with a null id are never learned from.  Very long texts are
    learned whole, as counts of features.
    """
    learn = docs.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"))
    everything = learn.where(fold(F.col("id"), FOLDS) != HELD_OUT)
    learn = everything.where("lang is not null")
    learn = learn.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    counts = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return train([])
    quota = max(1, sample_rows // len(counts))
    share = None
    for r in counts:
        this = (F.col("lang") == r["lang"]) & (F.pmod("h", F.lit(1 << 30)) < int(min(1.0, quota / r["count"]) * (1 << 30)))
        share = this if share is None else share | this
    # About sample_rows rows, however often an id repeats: minima are combined before the shuffle.
    sample = learn.where(share & F.col("text").isNotNull()).groupBy("h", "lang").agg(F.min("text").alias("text")).mapInArrow(_featurize, SAMPLE)
    kept = Scratch(docs.sparkSession, "langid").keep(sample, "sample")
    corpus = document_frequencies(everything)
    got: dict[str, dict] = {}
    for r in kept.repartition(1).mapInArrow(lambda batches: _train(batches, corpus), MODEL).collect():
        got.setdefault(r["kind"], {})[r["language"]] = np.frombuffer(r["values"], np.float64)
    if "weights" not in got:
        return train([])
    head, idf, languages = got["head"][None], got["idf"][None], sorted(got["weights"])
    weights = np.stack([got["weights"][x] for x in languages], axis=1)
    return Model(languages, idf, weights.astype(np.float32), head[1:], float(head[0]))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the predicted language and its confidence, from the text alone.

    Null texts and texts without a letter get `und` and 0.0.  Added names avoid
    those of docs; the other columns pass through.
    """
    names = dict(zip(("lang_pred", "score"), fresh(docs, "lang_pred", "score"), strict=True))
    schema = T.StructType([*docs.schema.fields, T.StructField(names["lang_pred"], T.StringType()), T.StructField(names["score"], T.DoubleType())])
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x MOST_LANGUAGES floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [m.predict(None if t is None else t.decode()) for t in text_bytes(part.column(place))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], schema.names)

    return docs.mapInArrow(run, schema), names


#: A filter rejects a document of no known language, or whose confidence is below this.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, **columns: str) -> DataFrame:
    """docs without those that have no language (null, no letters) or a confidence below `least`."""
    found, names = identify(docs, fit(docs, **columns), columns.get("text_col", "text"))
    good = (F.col(names["lang_pred"]) != UNDETERMINED) & (F.col(names["score"]) >= least)
    return found.where(good).select(*map(col, docs.columns))


def op3(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score.  A null id is held out."""
    model = fit(docs)
    found, names = identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), F.col(names["lang_pred"]).alias("lang_pred"), F.col(names["score"]).alias("score"))
