"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

1. One pass over the texts gives each document the hash set of its five-word
   shingles (never stored), a digest of that set, 200 minima, 40 band keys of five
   minima each, and a signature of the low two bits of each minimum.
2. Documents with equal sets form a class; only one node per class goes on, so a
   text copied a million times costs one node.
3. Nodes that share a band key meet in a bucket.  Every member is compared with the
   bucket's smallest node only: a star, not all pairs.
4. The number of equal two-bit fields, corrected for chance agreement, estimates
   the similarity; pairs far below the threshold go.  The others are confirmed on
   full sets, which are made anew for just the documents concerned.
5. Components of the confirmed links.  In buckets that still hold several
   components, members outside the smallest node's component are compared, block by
   block, with all others: on signatures, then on bitmaps of the sets, whose
   differing bits bound the similarity from above.  Survivors are confirmed as
   before.  So each pair that shares a bucket is in one component or was compared.

A pair at similarity 0.75 shares no band with a probability of 2e-5, and is
dropped by the estimate with one of 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, col, connected_components, fresh, text_bytes

WORDS = 5
BANDS, ROWS = 40, 5
PERMUTATIONS = BANDS * ROWS
BITS = 2
PER_LONG = 64 // BITS
LONGS = -(-PERMUTATIONS // PER_LONG)
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75
#: 5.5 standard deviations of the estimate below the threshold.
MARGIN = 0.20
#: Members of a bucket compared at once in step 5, and bytes of their bitmaps (four a shingle at most).
BLOCK, BLOCK_BYTES = 256, 8_000_000
CACHE_WORDS = 100_000
#: Ids (8 bytes each) up to which a list of documents is broadcast.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20_231_117)
XOR = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
MUL = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
FOLD = _rng.integers(0, 1 << 64, ROWS, dtype=np.uint64) | np.uint64(1)
BAND = _rng.integers(0, 1 << 64, BANDS, dtype=np.uint64)
PLACE = _rng.integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles.

    bytes.lower() folds A-Z only and bytes.split() cuts at ASCII white space only.
    """
    tokens = text.lower().split() if text else []
    h = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    if not tokens:
        return h
    if len(tokens) < words:
        return _mixed(np.array([np.sum(_mixed(h * PLACE[: h.size])) + np.uint64(h.size)], np.uint64))
    n = h.size - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out += _mixed(h[k : k + n] * PLACE[k]) if k == 0 else (h[k : k + n] ^ PLACE[k]) * PLACE[k]
    return np.unique(_mixed(out))


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a non-empty set."""
    least = None
    for at in range(0, s.size, 512):
        part = ((s[None, at : at + 512] ^ XOR[:, None]) * MUL[:, None]).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    return _mixed((_mixed(least).reshape(BANDS, ROWS) * FOLD).sum(axis=1, dtype=np.uint64) + BAND).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the (rehashed) minima, PER_LONG of them to a long."""
    bits = np.zeros(LONGS * PER_LONG, np.uint64)
    bits[: least.size] = _mixed(least) & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(bits.reshape(LONGS, PER_LONG) << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def _lists(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.ArrayType(T.LongType()))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            n, digests, keys, sigs = [], [], [], []
            for text in text_bytes(part.column(1)):
                s = shingles(text)
                n.append(s.size)
                digests.append(blake2b(s.tobytes(), digest_size=16).digest())
                if s.size:
                    least = minima(s)
                    keys.append(band_keys(least))
                    sigs.append(packed(least))
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            some = [x > 0 for x in n]
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), _lists(np.concatenate([none, *keys]), [BANDS * x for x in some]), _lists(np.concatenate([none, *sigs]), [LONGS * x for x in some])],
                FEATURES.names,
            )


SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [shingles(t).view(np.int64) for t in text_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(np.concatenate(found), [x.size for x in found])], SETS.names)


def _could_link(n_a: Column, n_b: Column) -> Column:
    """Sizes that allow the threshold: the smaller is that share of the larger."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT


def _estimate(sig_a: str, sig_b: str) -> Column:
    """Similarity from the number of equal fields, corrected for chance agreement."""
    odd = F.lit(0x5555555555555555)
    differ = None
    for i in range(LONGS):
        x = F.expr(f"{sig_a}[{i}] ^ {sig_b}[{i}]")
        fields = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
        differ = fields if differ is None else differ + fields
    chance = 2.0**-BITS
    return (1.0 - differ / F.lit(float(PERMUTATIONS)) - chance) / (1.0 - chance)


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs(a, b) whose signatures may stem from similar sets."""
    side = lambda k: sigs.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_could_link(F.col("n_a"), F.col("n_b")) & (_estimate("sig_a", "sig_b") >= PERCENT / 100 - MARGIN)).select("a", "b")


def _confirmed(pairs: DataFrame, texts: _Texts, scratch: Scratch) -> DataFrame:
    """The pairs(a, b) that reach the threshold on their whole sets."""
    pairs = scratch.keep(pairs, "likely")
    wanted = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    sets = texts.some(wanted).select("node", "text").mapInArrow(_sets, SETS)
    sets = scratch.keep(sets, "sets")
    side = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(common * 100 >= union * PERCENT).select("a", "b").distinct()


BITMAPS = T.StructType([T.StructField("node", T.LongType()), T.StructField("bitmap", T.BinaryType())])


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit per low bits of each hash, 16 bits or more for each of them; a power of two."""
    bits = max(64, 1 << int(16 * max(s.size, 1) - 1).bit_length())
    at = s & np.uint64(bits - 1)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bitmap(shingles(t)).tobytes() for t in text_bytes(part.column(1))], pa.binary())], BITMAPS.names)


def _differing(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits that differ between the pairs' bitmaps, the larger folded to the smaller's size.

    Each stands for a shingle that only one of the two sets has, so this never
    exceeds the size of their difference.
    """
    out = np.zeros(i.size, np.int64)
    size_x, size_y = (np.array([m.size for m in side]) for side in (x, y))
    kinds = size_x[i] << 32 | size_y[j]
    for kind in np.unique(kinds):
        pairs = np.flatnonzero(kinds == kind)
        words = int(min(kind >> 32, kind & 0xFFFFFFFF))
        stacks = []
        for side, at in ((x, i[pairs]), (y, j[pairs])):
            used, inverse = np.unique(at, return_inverse=True)
            stacks.append((np.stack([np.bitwise_or.reduce(side[k].reshape(-1, words), axis=0) for k in used]), inverse))
        step = max(1, 500_000 // words)
        for at in range(0, pairs.size, step):
            a, b = (stack[inverse[at : at + step]] for stack, inverse in stacks)
            out[pairs[at : at + step]] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


BLOCKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs between two blocks of one bucket that components don't join yet."""
    chance, least = 2.0**-BITS, PERCENT / 100 - MARGIN
    odd = np.uint64(0x5555555555555555)
    for batch in batches:
        for at in range(batch.num_rows):
            x, y = (batch.column(side).slice(at, 1).flatten() for side in (0, 1))
            maps = [[np.frombuffer(z, np.uint64) for z in m.field("bitmap").to_pylist()] for m in (x, y)]
            sx, sy = (m.field("sig").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, LONGS) for m in (x, y))
            x, y = ([m.field(k).to_numpy(zero_copy_only=False) for k in ("node", "component", "n")] for m in (x, y))
            differ = np.zeros((len(sx), len(sy)), np.int64)
            for i in range(LONGS):
                z = sx[:, i, None] ^ sy[None, :, i]
                differ += np.bitwise_count((z | z >> np.uint64(1)) & odd)
            small, large = np.minimum.outer(x[2], y[2]), np.maximum.outer(x[2], y[2])
            good = (1 - differ / PERMUTATIONS - chance) / (1 - chance) >= least
            good &= (x[1][:, None] != y[1][None, :]) & (small * 100 >= large * PERCENT)
            i, j = np.nonzero(good)
            both, apart = x[2][i] + y[2][j], _differing(*maps, i, j)
            could = (both - apart) * 100 >= (both + apart) * PERCENT
            a, b = x[0][i[could]], y[0][j[could]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], BLOCKS.names)


@dataclass(frozen=True)
class _Texts:
    """texts(node, text), and whether some node has several rows."""

    rows: DataFrame
    repeat: bool

    def some(self, nodes: DataFrame) -> DataFrame:
        """The distinct texts of some nodes, without moving the others' where the ids are few enough to broadcast."""
        wanted = nodes.select("node").distinct()
        few = nodes.count() <= BROADCAST_IDS
        found = self.rows.join(F.broadcast(wanted) if few else wanted.hint("merge"), "node", "left_semi")
        # Copies within a partition go before the shuffle: a node of very many rows sends few.
        return found.groupBy("node", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).drop("h") if self.repeat else found


def _rest_of_buckets(members: DataFrame, components: DataFrame, sigs: DataFrame, texts: _Texts, scratch: Scratch) -> DataFrame:
    """Likely pairs of members(key, node, hub, size) that no star has compared.

    A bucket is worked on if some member isn't in its hub's component.  Its members
    but for the hub are dealt into blocks of about BLOCK members or BLOCK_BYTES,
    whichever is less; blocks of members outside the hub's component meet all blocks.
    """
    label = components.select(F.col("id").alias("node"), F.col("component_id").alias("component"))
    known = scratch.keep(sigs.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "known")
    of_hub = known.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    placed = members.where("size > 2 and node <> hub").join(known, "node")
    placed = scratch.keep(placed.join(of_hub, "hub"), "placed")
    outside = F.col("component") != F.col("hub_component")
    # A bucket whose other members all lie outside in one component is done, too.
    load = F.ceil(F.sum("n") * F.lit(4) / F.lit(BLOCK_BYTES))
    parts = F.greatest(F.ceil(F.max("size") / F.lit(BLOCK)), load)
    span = placed.groupBy("key").agg(F.max(outside).alias("open"), F.min("component").alias("c0"), F.max("component").alias("c1"), parts.alias("parts"))
    open_keys = scratch.keep(span.where("open and c0 <> c1").select("key", "parts"), "open")
    placed = scratch.keep(placed.join(open_keys, "key"), "placed")
    bitmaps = scratch.keep(texts.some(scratch.keep(placed.select("node").distinct(), "nodes")).select("node", "text").mapInArrow(_bitmaps, BITMAPS), "bitmaps")
    placed = placed.join(bitmaps, "node").withColumn("part", F.struct(outside.alias("out"), F.pmod(F.xxhash64("node"), F.col("parts")).alias("at")))
    member = F.struct("node", "component", "n", "sig", "bitmap")
    blocks = scratch.keep(placed.groupBy("key", "part").agg(F.collect_list(member).alias("block")), "blocks")
    left = blocks.where("part.out").select("key", F.col("part").alias("p"), F.col("block").alias("left"))
    right = blocks.select("key", F.col("part").alias("q"), F.col("block").alias("right"))
    # Outside meets inside always, and outside meets outside once.
    met = left.join(right, "key").where("not q.out or p.at <= q.at").select("left", "right")
    return met.mapInArrow(_compare_blocks, BLOCKS).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Null and empty texts, and texts of white space only, have no shingles and link
    with nothing.  Repeated rows are copies of each other: each gets the row of its
    id.  Where one id has several texts, each row goes by its own text and the
    id links where any of them does.  A row with a null id belongs to the
    component of its equal texts (null if none of those has an id), and kept is
    false.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(col(id_col).cast("long").alias("node"), col(text_col).cast("string").alias("text"))
    rows = texts.mapInArrow(_features, FEATURES).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.keep(rows, "features")
    narrow = rows.select("doc_id", "n", "d1", "d2", "row")
    # One row stands for each class, however often it repeats.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("least")
    classes = scratch.keep(narrow.where("n > 0").groupBy("d1", "d2").agg(least).select("d1", "d2", F.col("least.doc_id").alias("node"), F.col("least.row").alias("row")), "classes")
    nodes = rows.join(classes.where("node is not null").select("row"), "row").select(F.col("doc_id").alias("node"), "n", "keys", "sig")
    nodes = scratch.keep(nodes, "nodes")
    texts = _Texts(texts, not narrow.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty())
    sigs = nodes.select("node", "n", "sig")
    banded = nodes.select(F.explode("keys").alias("key"), "node")
    buckets = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size"))
    buckets = scratch.keep(buckets.where("size > 1"), "buckets")
    members = scratch.keep(banded.join(buckets, "key"), "members")
    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.keep(_confirmed(_likely(stars, sigs), texts, scratch), "links")
    components = scratch.keep(connected_components(links, scratch), "components")
    more = _rest_of_buckets(members, components, sigs, texts, scratch)
    more = scratch.keep(_confirmed(more, texts, scratch), "links")
    if not more.isEmpty():
        components = scratch.keep(connected_components(links.unionByName(more), scratch), "components")
    classes = classes.drop("row").join(components.withColumnRenamed("id", "node"), "node", "left")
    classes = scratch.keep(classes.select("d1", "d2", F.coalesce("component_id", "node").alias("of_class")), "classes")
    out = narrow.drop("row").join(classes, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("of_class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: the one of smallest id.

    Of rows that repeat an id and its text one stays.  Where one id has several
    texts, or rows have a null id, each text of an id counts as a document of its
    own, those without an id last: no text goes but for a near copy that stays.
    Columns are those of docs.
    """
    key, digest = fresh(docs, "dedup_id", "dedup_digest")
    marked = docs.withColumn(key, col(id_col).cast("long")).withColumn(digest, F.coalesce(F.sha2(col(text_col).cast("string").cast("binary"), 256), F.lit("")))
    clash = F.col(key).isNull() | (F.col("low") != F.col("high"))
    if not marked.groupBy(key).agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where(clash).isEmpty():
        marked = _renumbered(marked, key, digest, Scratch(docs.sparkSession, "dedup"))
    found = near_duplicates(marked, key, text_col).where("kept").select("doc_id").distinct()
    kept = marked.join(found.select(F.col("doc_id").alias(key)), key, "left_semi").dropDuplicates([key])
    return kept.select(*map(col, docs.columns))


def _renumbered(marked: DataFrame, key: str, digest: str, scratch: Scratch) -> DataFrame:
    """marked with a number of its own in `key` for each id and digest, in the order of ids, null last."""
    (number,) = fresh(marked, "dedup_number")
    pairs = scratch.keep(marked.select(key, digest).distinct(), "pairs")
    # Numbers rise over the sorted partitions; written once, they stay the same.
    pairs = scratch.keep(pairs.sort(F.col(key).asc_nulls_last(), digest).withColumn(number, F.monotonically_increasing_id()), "numbers")
    left, right = marked.alias("left"), pairs.select(F.col(key).alias("k"), F.col(digest).alias("d"), F.col(number).alias("n")).alias("right")
    same = (F.col(f"left.{digest}") == F.col("right.d")) & F.col(f"left.{key}").eqNullSafe(F.col("right.k"))
    rows = left.join(right, same).select(*[F.col("left." + "`" + c.replace("`", "``") + "`") for c in marked.columns if c != key], F.col("right.n").alias(key))
    return scratch.keep(rows, "rows")


def op1(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(docs)
