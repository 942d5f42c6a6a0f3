"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The tokenizer's own file (vocabulary, merges, added tokens) is a parameter and is
read once per Python worker.  Texts are cut into words by the byte-level pattern;
every word that a worker hasn't met yet joins one flat array of symbols.  A round
finds each neighbouring pair's rank by binary search over the sorted pair keys,
takes each word's lowest, merges it wherever it stands in that word, and leaves out
words that are done.  A round therefore costs a few passes over all open words
together instead of a heap per word.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import col, fresh, text_bytes

#: The byte-level pre-tokenizer's pattern: a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.int64(1 << 40)
#: Distinct words a worker remembers before it starts anew; bounds its memory.
CACHE_WORDS = 300_000
#: Bytes of text worked on at once.
CHUNK_BYTES = 2_000_000


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            table[chr(extra)] = b
            extra += 1
    return table


class Bpe:
    """A byte-level BPE tokenizer over a tokenizer file in JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words aren't supported")
        chars, vocab = _byte_chars(), model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(chars[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            pieces[i] = token.encode()
        ordered = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self.pattern = regex.compile(PATTERN)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.word_at = self.word_len = np.zeros(0, np.int64)
        self.word_ids = np.zeros(0, np.uint32)

    # -- merging ---------------------------------------------------------------

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in one flat array, ids per word); no word is empty."""
        count = len(words)
        sizes = np.fromiter(map(len, words), np.int64, count)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(count), sizes)
        out_sym, out_own = [], []
        while symbols.size:
            rank = np.full(symbols.size, NONE)
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), self.keys.size - 1)
            known = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank[:-1][known] = self.rank[at[known]]
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lengths = np.diff(np.append(starts, symbols.size))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            done = least == NONE
            if done.any():
                out_sym.append(symbols[done])
                out_own.append(owner[done])
                go = ~done
                symbols, owner, rank, least = symbols[go], owner[go], rank[go], least[go]
                if not symbols.size:
                    break
            hit = np.flatnonzero(rank == least)
            # In a run like "aaa" the pairs overlap: every second one counts.
            fresh_run = np.diff(hit, prepend=-2) != 1
            if not fresh_run.all():
                order = np.arange(hit.size)
                hit = hit[(order - np.maximum.accumulate(np.where(fresh_run, order, 0))) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            stays = np.ones(symbols.size, bool)
            stays[hit + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        if not out_sym:
            return np.zeros(0, np.uint32), np.zeros(count, np.int64)
        owner = np.concatenate(out_own)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(out_sym)[order].astype(np.uint32), np.bincount(owner, minlength=count)

    def _learn(self, texts: Iterable[list[str]]) -> None:
        """Encode the words that aren't in the cache."""
        new = dict.fromkeys(w for words in texts for w in words if w not in self.words)
        if not new:
            return
        ids, lengths = self.merge([w.encode() for w in new])
        base = self.word_ids.size
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.word_at = np.concatenate([self.word_at, base + np.cumsum(lengths) - lengths])
        self.word_len = np.concatenate([self.word_len, lengths])
        self.word_ids = np.concatenate([self.word_ids, ids])

    # -- texts -----------------------------------------------------------------

    def parts(self, text: str) -> list[str | int]:
        """The text between added tokens, and the ids of those."""
        if self.split is None or not any(t in text for t in self.added):
            return [text]
        return [self.added.get(p, p) for p in self.split.split(text) if p]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        if len(self.words) > CACHE_WORDS:
            self._reset()
        cut = [[p if isinstance(p, int) else self.pattern.findall(p) for p in self.parts(t)] for t in texts]
        self._learn(p for parts in cut for p in parts if not isinstance(p, int))
        return [np.concatenate([self._ids(p) for p in parts]) if len(parts) != 1 else self._ids(parts[0]) for parts in cut]

    def _ids(self, words: list[str] | int) -> np.ndarray:
        if isinstance(words, int):
            return np.array([words], np.uint32)
        if not words:
            return np.zeros(0, np.uint32)
        index = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        return self.word_ids[_spans(self.word_at[index], self.word_len[index])]

    def learn(self, texts: Iterable[list[str]]) -> None:
        """Encode all unknown words of some texts (pre-tokens) in one batch."""
        if len(self.words) > CACHE_WORDS:
            self._reset()
        self._learn(texts)

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of ids of each word (pre-token)."""
        self._learn([words])
        return self.word_len[np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self.piece_bytes[_spans(self.piece_at[ids], self.piece_len[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    if not ends.size:
        return np.zeros(0, np.int64)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])


_LOADED: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """The worker's tokenizer for this file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def chunks(batch: pa.RecordBatch, text_at: int, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about `most` bytes of text each, null texts as empty."""
    texts, start, held = text_bytes(batch.column(text_at)), 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= most or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), [(x or b"").decode() for x in texts[start : i + 1]]
            start, held = i + 1, 0


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", digests: bool = True, keep_ids: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """docs without its text, with each text's ids and, on demand, the digests.

    A null or empty text has no ids.  Repeated rows and texts give equal rows; other
    columns pass through, and the added names avoid those that docs has.
    Added: ids array<int>, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    numbers), decoded_sha256 (of the text that decoding these ids gives).
    """
    from pyspark.sql import types as T

    rest = [c for c in docs.columns if c != text_col]
    names = dict(zip(("ids", "n_tokens", "ids_sha256", "decoded_sha256"), fresh(docs.select(*map(col, rest)), ids_col, "n_tokens", "ids_sha256", "decoded_sha256"), strict=True))
    fields = [docs.schema[c] for c in rest] + [T.StructField(names["n_tokens"], T.LongType(), False)]
    if keep_ids:
        fields.append(T.StructField(names["ids"], T.ArrayType(T.IntegerType(), False), False))
    if digests:
        fields += [T.StructField(names[k], T.StringType(), False) for k in ("ids_sha256", "decoded_sha256")]
    names_out = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part, texts in chunks(batch, len(rest)):
                ids = bpe.encode(texts)
                sizes = np.array([x.size for x in ids], np.int64)
                columns = [*part.columns[: len(rest)], pa.array(sizes)]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))))
                if digests:
                    columns.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]))
                    columns.append(pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]))
                yield pa.RecordBatch.from_arrays(columns, names_out)

    # Columns travel by place, so clashing names can't be confused.
    return docs.select(*map(col, rest), col(text_col).cast("string")).mapInArrow(run, T.StructType(fields)), names


def decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """coded with its ids decoded to text; null ids give null, no ids the empty text."""
    from pyspark.sql import types as T

    rest = [c for c in coded.columns if c != ids_col]
    (name,) = fresh(coded.select(*map(col, rest)), text_col)
    schema = T.StructType([coded.schema[c] for c in rest] + [T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return coded.select(*map(col, rest), col(ids_col)).mapInArrow(run, schema)


def op4(docs: DataFrame, path: str) -> DataFrame:
    """The contract's rows: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs.select("doc_id", "text"), path, keep_ids=False)[0]
