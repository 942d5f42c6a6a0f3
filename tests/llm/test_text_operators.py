"""Operators that work text by text, against plain versions of the same thing."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import bpe, editcount, langid, mixing, packing, quality
from factloom.llm.queries import bpe_path, ranks_path

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
ODD = ["", " ", "\n\t ", "a", "A.", "123 456", "!!! ???", "x" * 70_000, "wörd " * 9_000, "<|endoftext|> and <|endoftext", "tabs\tand\x0bvertical\x0cfeeds\r\n", "naïve 😀 字 ́", "aaaaaaaaaaaaaaaaaaaa", "'s're 'll  two  spaces   ", "\x1c\x85  "]


def docs(spark, texts, langs=None, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    parts = ["a", "Bc", " ", "  ", "\n", "'s", "'", "é", "1", "²", "字", "😀", "--", "the", " of", "aaaa", "\x85", "<|endoftext|>"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_bpe_equals_the_library(spark, library, texts):
    df = docs(spark, [*texts, None]).withColumn("ids", F.lit("clash"))
    coded, names = bpe.encode(df, bpe_path())
    assert names["ids"] == "ids_1" and coded.columns[:4] == ["doc_id", "lang", "source", "n_chars"]
    rows = {r["doc_id"]: r for r in coded.collect()}
    for i, t in enumerate([*texts, ""]):
        want = library.encode(t, add_special_tokens=False).ids
        r = rows[i]
        assert list(r["ids_1"]) == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(coded.select("doc_id", "ids_1"), bpe_path(), ids_col="ids_1")
    assert all(r["text"] == [*texts, ""][r["doc_id"]] for r in back.collect())


def test_bpe_of_no_rows(spark):
    assert bpe.op4(docs(spark, []), bpe_path()).count() == 0


def test_decoding_any_ids_equals_the_library(library):
    rng, b = random.Random(4), bpe.tokenizer(bpe_path())
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 20))]
        assert b.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_edits_equal_fresh_counts():
    b, rng = bpe.tokenizer(bpe_path()), random.Random(9)
    parts = ["a", "bc", " ", "  ", "\n", "'s", "'re", "1", "23", "--", "word", "\t"]
    for trial in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 40, 900])))
        doc = editcount.CountedText(b, text)
        for _ in range(5):
            start = rng.randint(0, len(text))
            stop, new = min(len(text), start + rng.choice([0, 1, 5, 200])), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
            text = text[:start] + new + text[stop:]
            assert doc.edit(start, stop, new) == sum(len(x) for x in [b.encode([text.replace("<|", "")])[0]])
            assert doc.text() == text and len(doc) == len(text)
    doc = editcount.CountedText(b, "some words here, " * 2000)
    doc.edit(9000, 9005, "more")
    assert doc.recut < 100  # only the region of the edit


def test_count_edits_frame(spark):
    rows = [(1, "hello world", [(0, 5, "HELLO"), (100, 200, "!")]), (2, None, [(0, 0, "new text")]), (3, "kept", None), (4, "x", [None, (None, None, None)]), (None, "", [])]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("edits", T.ArrayType(editcount.EDIT))])).withColumn("n_tokens", F.lit("clash"))
    got, names = editcount.count_edits(df, bpe_path())
    b = bpe.tokenizer(bpe_path())
    count = lambda t: b.encode([t])[0].size
    out = {r["doc_id"]: (r[names["n_tokens"]], r[names["n_tokens_after"]]) for r in got.collect()}
    assert out == {1: (count("hello world"), count("HELLO world!")), 2: (0, count("new text")), 3: (count("kept"),) * 2, 4: (count("x"),) * 2, None: (0, 0)}


def test_kept_trees_take_later_edits(spark, tmp_path, texts):
    """Trees written, read, edited twice by joins, against counts of the texts as they then are."""
    b = bpe.tokenizer(bpe_path())
    count = lambda t: sum(len(x) for x in [b.encode([t.replace("<|", "")])[0]])
    texts = [t.replace("<|", "") for t in texts]
    trees, names = editcount.plant(docs(spark, [*texts, None, "same", "same"], ids=[*range(len(texts)), 7000, 7001, 7001]), bpe_path())
    trees.write.parquet(str(tmp_path / "0"))
    now = {**dict(enumerate(texts)), 7000: "", 7001: "same"}
    rng = random.Random(5)
    for turn in (1, 2):
        edits = {i: [(rng.randint(0, len(t)), rng.randint(0, len(t) + 3), rng.choice(["", "x", " new words", "'s", "\n\n"])) for _ in range(rng.randint(0, 3))] for i, t in now.items() if i % 3 != turn}
        table = spark.createDataFrame(list(edits.items()), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("edits", T.ArrayType(editcount.EDIT))]))
        old = spark.read.parquet(str(tmp_path / str(turn - 1)))
        got, made = editcount.apply_edits(editcount.with_edits(old, table), names, bpe_path())
        got = got.cache()
        before = {i: count(t) for i, t in now.items()}
        for i, own in edits.items():
            for start, stop, new in own:
                start, stop = min(start, len(now[i])), min(max(stop, start), len(now[i]))
                now[i] = now[i][:start] + new + now[i][stop:]
        rows = got.collect()
        assert len(rows) == len(now) + 1
        for r in rows:
            i = r["doc_id"]
            assert (r["text"], r[names["n_tokens"]], r[made["n_tokens_before"]], r[made["chars"]]) == (now[i], count(now[i]), before[i], len(now[i]))
            assert i in edits or r[made["recut_chars"]] == 0
        got.drop(*made.values()).write.parquet(str(tmp_path / str(turn)))


def test_edit_query(spark):
    """op2 over rows with nulls, repeats and long texts, against counts from scratch."""
    b = bpe.tokenizer(bpe_path())
    rows = [*ODD[:6], "some words, " * 3000, None, "twice over", "twice over"]
    df = docs(spark, rows, ids=[*range(8), 9, 9]).withColumn("n_tokens", F.lit("clash"))
    edits = {r["doc_id"]: [(e["start"], e["stop"], e["text"]) for e in r["edits"] if e["start"] is not None] for r in editcount.sample_edits(df).collect()}
    got = editcount.op2(df, bpe_path()).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[min(r["doc_id"], 8)] or ""
        assert r["n_tokens"] == b.encode([text])[0].size
        for start, stop, new in edits[r["doc_id"]] if text or rows[min(r["doc_id"], 8)] is not None else [(0, 0, " inserted words, 2 of them"), (0, 0, "it's"), (0, 0, "")]:
            start, stop = min(start, len(text)), min(max(stop, start), len(text))
            text = text[:start] + new + text[stop:]
        assert (r["n_tokens_after"], r["chars_after"]) == (b.encode([text])[0].size, len(text))
    assert editcount.op2(docs(spark, []), bpe_path()).count() == 0


def test_packing_query(spark, library):
    """op7's digests are those of the rows that pack gives, copies and empty texts included."""
    df = docs(spark, ["a b c", "", None, *["copy of a text"] * 300, "long " * 5000])
    packed = {(r["shard"], r["row"]): r for r in packing.pack(df, ranks_path()).collect()}
    got = packing.op7(df, ranks_path()).collect()
    assert len(got) == len(packed)
    for r in got:
        p = packed[r["shard"], r["row"]]
        assert (r["doc_ids"], r["starts"], r["cu_seqlens"]) == (p["doc_ids"], p["starts"], p["cu_seqlens"])
        assert r["ids_sha256"] == hashlib.sha256(p["ids"]).hexdigest() and r["positions_sha256"] == hashlib.sha256(p["positions"]).hexdigest()
    assert sum(r["n_tokens"] for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) for t in [x["text"] for x in df.collect()])


def test_packing_is_lossless(spark, library, texts):
    texts = [t for t in texts if "<|endoftext|>" not in t]
    df = docs(spark, [*texts, *texts[:20], None])
    rows = packing.pack(df, ranks_path(), context=64, shard_bytes=100_000).collect()
    ids, positions = packing.matrix(rows), packing.matrix(rows, "positions")
    assert ids.shape == (len(rows), 64)
    found: dict = {}
    for r, line, places in zip(rows, ids, positions, strict=True):
        ends = r["cu_seqlens"]
        assert ends[0] == 0 and ends[-1] == r["n_tokens"] <= 64 and (line[ends[-1] :] == packing.PAD).all()
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"], strict=True)):
            piece = line[ends[k] : ends[k + 1]]
            assert places[ends[k] : ends[k + 1]].tolist() == list(range(piece.size))
            found.setdefault(doc, []).append((start, piece.tolist()))
    for i, t in enumerate([*texts, *texts[:20]]):
        assert [x for _, p in sorted(found.get(i, [])) for x in p] == library.encode(t, add_special_tokens=False).ids
    assert sum(r["n_tokens"] for r in rows) / (64 * len(rows)) > 0.9
    assert packing.pack(docs(spark, []), ranks_path()).count() == 0


def test_best_fit_decreasing_takes_the_fullest_row():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 33, rng.integers(0, 60))
        left, want = [], []
        for i in np.lexsort((np.arange(lengths.size), -lengths)):
            fit = [r for r in range(len(left)) if left[r] >= lengths[i]]
            if fit:
                least = min(left[r] for r in fit)
                r = [r for r in fit if left[r] == least]
                r = max(r, key=lambda r: want[r][-1][1])  # the row that took a piece last
            else:
                left.append(32)
                want.append([])
                r = len(left) - 1
            left[r] -= lengths[i]
            want[r].append((int(i), sum(map(len, want))))
        got = packing.best_fit_decreasing(lengths, 32)
        assert sorted(i for row in got for i in row) == list(range(lengths.size))
        assert len(got) == len(want) and all(sum(lengths[row]) <= 32 for row in got)


def language_rows():
    words = {"en": "the of and with that from this have been house water green".split(), "de": "der die und nicht eine mit auch für über schön straße wasser".split(), "fr": "le la les des une être avec pour où déjà maison eau".split()}
    rng = random.Random(6)
    out = [(lang, " ".join(rng.choice(w) for _ in range(rng.randint(3, 40)))) for _ in range(400) for lang, w in words.items()]
    return [x[1] for x in out], [x[0] for x in out]


def test_language_id(spark):
    texts, langs = language_rows()
    extra = [None, "", " ", "123 !!", "und wasser " * 3000, "the the the"]
    df = docs(spark, texts + extra, langs + [None, "en", "en", None, None, None])
    rows = {r["doc_id"]: r for r in langid.op3(df).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] == (i in set(held)) for i in range(len(texts)))
    assert sum(rows[i]["lang_pred"] == langs[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    n = len(texts)
    assert [rows[n + k]["lang_pred"] for k in range(6)] == ["und", "und", "und", "und", "de", "en"]
    kept = langid.keep_identified(df.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x")))
    assert kept.columns == [*df.columns, "score", "lang_pred"] and kept.count() >= n


def test_language_id_ignores_held_out_labels(spark):
    texts, langs = language_rows()
    wrong = [("xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, lang in enumerate(langs)]
    a, b = (sorted(map(tuple, langid.op3(docs(spark, texts, x)).collect())) for x in (langs, wrong))
    assert a == b


def test_language_id_without_rows_or_labels(spark):
    assert langid.op3(docs(spark, [])).count() == 0
    assert [r["lang_pred"] for r in langid.op3(docs(spark, ["some text"], [None])).collect()] == ["und"]


def test_ngrams_do_not_depend_on_slices(monkeypatch):
    text = " ".join(language_rows()[0])
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "SLICE", 97)
    assert (langid.ngram_counts(text) == whole).all()


def quality_rows(n=500):
    rng = random.Random(8)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(8, 60))) + "." for _ in range(n)]
    bad = [" ".join(rng.choice(["al###", "be$$$", "ga&&&"]) for _ in range(rng.randint(8, 60))) for _ in range(n)]
    return good + bad, [1] * n + [0] * n


def test_quality(spark):
    texts, marks = quality_rows()
    df = docs(spark, [*texts, None, "", "x", "alpha beta. " * 20_000])
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(marks)] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.op8(df, labels).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    assert sum(rows[i]["predicted"] == marks[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    n = len(texts)
    assert rows[n]["score"] == rows[n + 1]["score"] and rows[n + 3]["predicted"] == 1
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.op8(df, flipped).collect())) == sorted(map(tuple, rows.values()))


def test_quality_covers_the_whole_text():
    texts, marks = quality_rows(150)
    net = quality.train([(t.encode(), y) for t, y in zip(texts, marks, strict=True)])
    long = b"alpha beta gamma. " * 8000
    assert net.score(long) > 0.5 and len(net.chunk_maxima(long)[0]) == -(-((len(long) - quality.WIDTH) // quality.STRIDE + 1) // quality.CHUNK)
    whole = net.chunk_maxima(long)[0]
    assert net.chunk_maxima(long[:-200] + b"###########" * 18)[0][-1].tolist() != whole[-1].tolist()


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.op8(docs(spark, ["a", None]), labels).collect())
    assert quality.op8(docs(spark, []), labels).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3):
    """The rule as stated: excess over a cap is shared anew until none is above."""
    names = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    w, total = {k: weights[i % 3] for i, k in enumerate(names)}, sum(sizes.values())
    out, open_ = {}, set(names)
    while open_:
        rest = total - sum(out.values())
        share = {k: rest * w[k] / sum(w[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > most * sizes[k]}
        if not over:
            return out | share
        out |= {k: most * sizes[k] for k in over}
        open_ -= over
    return out


def test_mixing(spark):
    rng = random.Random(12)
    names = ["b", "a", "Z", "ä", None, "tiny", "empty"]
    rows = [("w " * rng.randint(0, 60) if s != "empty" else " ", s) for s in names for _ in range({"tiny": 4, "a": 3000}.get(s, 700))] + [(None, "a")]
    df = docs(spark, [t for t, _ in rows], sources=[s for _, s in rows])
    got = mixing.op5(df).collect()
    sizes: dict = {}
    for t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = targets(sizes), {}
    for r in got:
        s = rows[r["doc_id"]][1]
        assert r["size"] == len((rows[r["doc_id"]][0] or "").split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.12 * want[s] + 1 for s in taken)
    assert sorted(map(tuple, mixing.op5(df).collect())) == sorted(map(tuple, got))
    mixed = mixing.emit(df.withColumn("size", F.lit("clash")))
    assert mixed.columns == [*df.columns, "size"] and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.op5(df.limit(0)).count() == 0


def test_mixing_beyond_the_broadcast_bound(spark, monkeypatch):
    df = docs(spark, ["w " * (i % 9) for i in range(300)], sources=[None if i % 7 == 0 else f"s{i % 5}" for i in range(300)])
    want = sorted(map(tuple, mixing.op5(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.op5(df).collect())) == want
