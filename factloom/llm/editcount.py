"""Token counts that follow edits: a segment tree of pre-tokens per document, kept.

A byte-level tokenizer cuts a text into pre-tokens, left to right, and encodes each
alone, so a text's token count is the sum over its pre-tokens.  The leaves of a
document's tree are runs of LEAF pre-tokens; every node sums characters and tokens.
`plant` counts a corpus once and keeps each document's leaves beside its text, as
columns that can be written and read again.  `apply_edits` takes trees, whenever
they were planted, finds an edit's place by descending on characters, cuts anew from
the leaf boundary a little before the edit until a cut meets an old leaf boundary,
encodes just the pre-tokens between, and updates the sums on the way up.  Documents
without edits aren't cut again at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Bpe, chunks, tokenizer
from .shared import Scratch, col, fresh

#: Pre-tokens of a leaf.
LEAF = 8
#: A cut before position p depends on the text up to p + LOOKAHEAD at most.
LOOKAHEAD = 3


def _sums(leaves: np.ndarray) -> np.ndarray:
    """A segment tree over leaves: node i sums nodes 2 i and 2 i + 1, the leaves come last."""
    size = 1 << max(leaves.size - 1, 0).bit_length()
    tree = np.zeros(2 * size, np.int64)
    tree[size : size + leaves.size] = leaves
    while size > 1:
        tree[size // 2 : size] = tree[size : 2 * size].reshape(-1, 2).sum(axis=1)
        size //= 2
    return tree


def _leaves(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each run of LEAF pre-tokens."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(0, len(words), LEAF)
    return np.add.reduceat(np.fromiter(map(len, words), np.int64, len(words)), at), np.add.reduceat(counts, at)


class CountedText:
    """A text with its token count, kept right under edits.

    Added tokens are ordinary text here.
    """

    def __init__(self, bpe: Bpe, text: str, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        """leaves: the text's leaves as they were kept; without them it is cut and counted."""
        self.bpe, self.recut, self._text = bpe, 0, text
        if leaves is None:
            words = bpe.pattern.findall(text)
            leaves = _leaves(words, bpe.counts(words) if words else np.zeros(0, np.int64))
        self._build(*leaves)

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves, self.chars, self.tokens = chars.size, _sums(chars), _sums(tokens)
        self.size = self.chars.size // 2

    @property
    def count(self) -> int:
        return int(self.tokens[1])

    def __len__(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return self._text

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """The leaves, to be kept beside the text."""
        return self.chars[self.size : self.size + self.leaves], self.tokens[self.size : self.size + self.leaves]

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf, its first character's position) of the leaf that has this position; the last one beyond the end."""
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if position >= before + self.chars[at] and self.chars[at + 1]:
                before += int(self.chars[at])
                at += 1
        return at - self.size, before

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace text[start:stop] by `new`; the new token count.  Positions are clipped to the text."""
        self.commit(self.cut(start, stop, new))
        return self.count

    def cut(self, start: int, stop: int, new: str) -> tuple:
        """An edit's new pre-tokens (the last part) and where they go; changes nothing yet."""
        start = min(max(start, 0), len(self))
        stop = min(max(stop, start), len(self))
        # The boundary before a leaf that begins LOOKAHEAD or more before the edit stays.
        first, at = self._leaf_at(max(0, start - LOOKAHEAD))
        last, end = self._leaf_at(stop)
        ends: list[int] = []
        shift, more = len(new) - (stop - start), 4
        while True:
            # The old boundaries from the edit's end on, some more leaves of them at each turn.
            take = self.chars[self.size + last : self.size + min(last + more, self.leaves)]
            ends = (end + np.cumsum(take)).tolist()
            whole = last + more >= self.leaves
            upto = len(self) if whole else ends[-1]
            fresh_text = self._text[at:start] + new + self._text[stop:upto]
            goals = {e + shift: i for i, e in enumerate(ends) if e >= stop}
            words: list[str] = []
            for m in self.bpe.pattern.finditer(fresh_text):
                # A match that looks past what is at hand can't be trusted.
                if not whole and m.end() + LOOKAHEAD > len(fresh_text):
                    break
                words.append(m[0])
                met = goals.get(at + m.end())
                if met is not None:
                    return start, stop, new, first, last + met, words
            if whole:
                return start, stop, new, first, max(self.leaves - 1, first - 1), words
            more *= 4

    def commit(self, change: tuple) -> None:
        """Put an edit's pre-tokens in place and update the sums above them."""
        start, stop, new, first, last, words = change
        self.recut += sum(map(len, words))
        self._text = self._text[:start] + new + self._text[stop:]
        chars, tokens = _leaves(words, self.bpe.counts(words) if words else np.zeros(0, np.int64))
        if chars.size == last + 1 - first:
            for tree, leaves in ((self.chars, chars), (self.tokens, tokens)):
                tree[self.size + first : self.size + last + 1] = leaves
                low, high = self.size + first, self.size + last
                while low > 1:
                    low, high = low // 2, high // 2
                    tree[low : high + 1] = tree[2 * low : 2 * high + 2].reshape(-1, 2).sum(axis=1)
            return
        old = self.kept()
        self._build(*(np.concatenate([x[:first], y, x[last + 1 :]]) for x, y in zip(old, (chars, tokens), strict=True)))


EDIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("text", T.StringType())])
#: A tree's columns beside the text: its leaves as little-endian 32-bit numbers.
TREE = {"leaf_chars": T.BinaryType(), "leaf_tokens": T.BinaryType(), "n_tokens": T.LongType()}


def _packed(leaves: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<i4").tobytes() for x in leaves], pa.binary())


def plant(docs: DataFrame, path: str, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with each text's tree: leaf_chars, leaf_tokens, n_tokens (names that docs has get a number).

    Null and empty texts have no leaves and no tokens.  Rows are planted one by one,
    repeated ones each for itself; a table without rows stays empty.  Very long texts
    are cut whole, by one worker, in memory of some times their length.
    """
    names = dict(zip(TREE, fresh(docs, *TREE), strict=True))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[k], t) for k, t in TREE.items())])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part, texts in chunks(batch, place):
                cut = [bpe.pattern.findall(t) for t in texts]
                bpe.learn(cut)
                leaves = [_leaves(words, bpe.counts(words)) if words else (np.zeros(0, np.int64),) * 2 for words in cut]
                added = [_packed([c for c, _ in leaves]), _packed([t for _, t in leaves]), pa.array([int(t.sum()) for _, t in leaves], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], schema.names)

    return docs.mapInArrow(run, schema), names


def with_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """trees with the column edits of edits(id_col, edits), null where there are none.

    Of rows that repeat an id in edits, the list that sorts first holds.  Null ids
    match nothing.  Every tree of an id gets its edits.
    """
    one = edits.select(col(id_col), F.col("edits").cast(T.ArrayType(EDIT))).groupBy(col(id_col)).agg(F.min("edits").alias("edits"))
    return trees.join(one, id_col, "left")


def apply_edits(trees: DataFrame, names: dict[str, str], path: str, text_col: str = "text", edits_col: str = "edits") -> tuple[DataFrame, dict[str, str]]:
    """trees after their edits, without the edits: text, leaves and n_tokens are those of the new text.

    edits is array<struct<start, stop, text>>, applied in order, each to the text
    that the one before left; a null list is an empty one, null parts are 0 and the
    empty text.  Null texts are empty.  Added: n_tokens_before, chars, recut_chars
    (characters of the pre-tokens that edits encoded anew).
    """
    rest = [c for c in trees.columns if c not in (text_col, edits_col, *names.values())]
    order = [*rest, text_col, *names.values()]
    made = dict(zip(("n_tokens_before", "chars", "recut_chars"), fresh(trees, "n_tokens_before", "chars", "recut_chars"), strict=True))
    kept = trees.select(*map(col, order))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in made.values())])
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part, texts in chunks(batch, at):
                edits = [[e for e in x or [] if e is not None] for x in part.column(at + 4).to_pylist()]
                leaves = [[np.frombuffer(x, "<i4").astype(np.int64) for x in part.column(at + k).to_pylist()] for k in (1, 2)]
                trees = [CountedText(bpe, t, own) for t, *own in zip(texts, *leaves, strict=True)]
                before = [d.count for d in trees]
                # The k-th edits of all these documents: their new pre-tokens are encoded together.
                for k in range(max(map(len, edits), default=0)):
                    turn = [(d, d.cut(e[k]["start"] or 0, e[k]["stop"] or 0, e[k]["text"] or "")) for d, e in zip(trees, edits, strict=True) if k < len(e)]
                    bpe.learn(change[-1] for _, change in turn)
                    for d, change in turn:
                        d.commit(change)
                new = [pa.array([d.text() for d in trees], pa.string()), _packed([d.kept()[0] for d in trees]), _packed([d.kept()[1] for d in trees])]
                numbers = [pa.array(x, pa.int64()) for x in ([d.count for d in trees], before, [len(d) for d in trees], [d.recut for d in trees])]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *new, *numbers], schema.names)

    edits = col(edits_col).cast(T.ArrayType(EDIT))
    return trees.select(*map(col, order), edits).mapInArrow(run, schema), made


def count_edits(docs: DataFrame, path: str, text_col: str = "text", edits_col: str = "edits") -> tuple[DataFrame, dict[str, str]]:
    """docs without text and edits, with its counts before and after its edits: planted and edited at once.

    Added: n_tokens, n_tokens_after, chars_after, recut_chars; see apply_edits.
    """
    rest = [c for c in docs.columns if c not in (text_col, edits_col)]
    trees, names = plant(docs, path, text_col)
    edited, made = apply_edits(trees, names, path, text_col, edits_col)
    keys = {"n_tokens": made["n_tokens_before"], "n_tokens_after": names["n_tokens"], "chars_after": made["chars"], "recut_chars": made["recut_chars"]}
    out = dict(zip(keys, fresh(docs.select(*map(col, rest)), *keys), strict=True))
    return edited.select(*map(col, rest), *(col(c).alias(out[k]) for k, c in keys.items())), out


def sample_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits made from doc_id and the text's length: an insertion, a replacement, a deletion."""
    n = F.length("text")
    at = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id"), n + 1)
    one = lambda k, width, text: F.struct(at(k).alias("start"), (at(k) + width).alias("stop"), F.lit(text).alias("text"))
    return docs.withColumn("edits", F.array(one(1, 0, " inserted words, 2 of them"), one(2, 9, "it's"), one(3, 40, "")))


def op2(docs: DataFrame, path: str) -> DataFrame:
    """Each document's counts before and after its three edits, which find its tree as it was kept."""
    trees, names = plant(docs.select("doc_id", "text"), path)
    trees = Scratch(docs.sparkSession, "trees").keep(trees, "trees")
    edited, made = apply_edits(sample_edits(trees), names, path)
    return edited.select("doc_id", F.col(made["n_tokens_before"]).alias("n_tokens"), F.col(names["n_tokens"]).alias("n_tokens_after"), F.col(made["chars"]).alias("chars_after"), F.col(made["recut_chars"]).alias("recut_chars"))
