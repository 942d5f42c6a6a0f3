"""Operators that compare documents, vectors or records, against brute force."""

import collections
import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bm25, embeddings, merkle, minhash, shared

DOCS = "doc_id long, text string, extra string"


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, links).items()}


def corpus():
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(rng.randint(20, 120))] for _ in range(60)]
    base = [word() for _ in range(150)]
    for _ in range(150):  # near copies of which many pairs stay below the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    texts += [[*[word() for _ in range(rng.randint(5, 60))], *passage] for _ in range(80)]
    texts += [list(base) for _ in range(40)]
    out = [" ".join(t) for t in texts]
    out += ["", " \n", "one two", "ONE\ttwo", "one two three four", "one two three four five", "x y z " * 4000, "x y z " * 4000 + "end"]
    rng.shuffle(out)
    return dict(enumerate(out))


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "n") for i, t in texts.items()], DOCS).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op1(df).collect()}
    assert got == near(texts)


def test_near_duplicates_odd_rows(spark):
    long = "a b c d e f g h"
    rows = [(1, None, ""), (2, "", ""), (5, long, ""), (4, long.upper(), ""), (4, long.upper(), ""), (None, long, ""), (None, "only here in this row now", ""), (7, "é É", ""), (8, "é é", "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = sorted((tuple(r) for r in minhash.op1(df).collect()), key=str)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (5, 4, 4, False) in got and got.count((4, 4, 4, True)) == 2
    assert (None, 4, 4, False) in got and (None, 2, None, False) in got and (7, 1, 7, True) in got and (8, 1, 8, True) in got
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == [1, 2, 4, 7, 8]
    assert minhash.op1(df.limit(0)).count() == 0 and minhash.deduplicate(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.75, 0.9):
        found = []
        for _ in range(40):
            common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (int(share * 1000), 500 - int(share * 500), 500 - int(share * 500)))
            x, y = (minhash.packed(minhash.minima(np.unique(np.concatenate([common, z])))).view(np.uint64) for z in (a, b))
            z = x ^ y
            differ = np.bitwise_count((z | z >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum()
            found.append((1 - differ / minhash.PERMUTATIONS - 0.25) / 0.75)
        assert np.mean(found) == pytest.approx(share, abs=0.03)


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 900):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(0.8 * a.size)], rng.integers(0, 1 << 63, max(1, n // 3), dtype=np.uint64)]))
        apart = minhash._differing([minhash.bitmap(a)], [minhash.bitmap(b)], np.array([0]), np.array([0]))[0]
        assert apart <= np.setxor1d(a, b).size


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    ids = list(range(200))
    rng.shuffle(ids)
    links = [*zip(ids[:80], ids[1:80], strict=False), *((ids[100], x) for x in ids[101:140]), (ids[150], ids[151])]
    got = {r["id"]: r["component_id"] for r in shared.connected_components(spark.createDataFrame(links, "a long, b long"), shared.Scratch(spark, "test")).collect()}
    want = components(ids, links)
    assert got == {i: c for i, c in want.items() if i in {x for link in links for x in link}}


VECTORS = "vec_id long, embedding array<float>, label int, n_links string"


def vectors():
    rng = np.random.default_rng(7)
    rows = [(rng.normal(size=24), int(rng.integers(0, 3))) for _ in range(150)]
    center = rng.normal(size=24)
    rows += [(center + rng.normal(size=24) * 0.18 * rng.random(), 1) for _ in range(220)]
    rows += [(center * 2, 1)] * 30 + [(center, 2)] * 3
    rows += [(v + rng.normal(size=24) * 0.1, lab) for v, lab in rows[:40]]
    return [(i, [float(np.float32(x)) for x in v], lab, "x") for i, (v, lab) in enumerate(rows)]


def brute_vectors(rows):
    usable = {}
    for i, v, lab, _ in rows:
        if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v)
            usable[i] = (a / np.linalg.norm(a), lab)
    links = [(a, b) for a in usable for b in usable if a < b and usable[a][1] == usable[b][1] and usable[a][0].size == usable[b][0].size and usable[a][0] @ usable[b][0] >= 0.93]
    count = collections.Counter(x for link in links for x in link)
    comp = components([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize(("cell", "block", "cells"), [(2048, 1024, 500_000), (20, 16, 500_000), (8, 5, 0)])
def test_vectors_equal_brute_force(spark, monkeypatch, cell, block, cells):
    monkeypatch.setattr(embeddings, "BROADCAST_CELLS", cells)
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors()
    n = len(rows)
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 1, ""), (n + 1, [0.0] * 24, 1, ""), (n + 2, [nan] + [1.0] * 23, 1, ""), (n + 3, [inf] + [1.0] * 23, 1, ""), (n + 4, [None] + [1.0] * 23, 1, ""), (n + 5, [], 1, ""), (n + 6, rows[0][1], None, ""), (n + 7, [1.0, 2.0], 1, ""), (n + 8, [1.0, 2.1], 1, "")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.op10(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == brute_vectors(rows)


def test_double_vectors_and_hot_copies(spark):
    """Components of either width give the same links; a thousand copies are one node."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=16).astype(np.float32) * 0.12], i % 2, "") for i in range(160)]
    rows = [(i, [float(np.float32(x)) for x in v], label, e) for i, v, label, e in rows]
    kind = VECTORS.replace("array<float>", "array<double>")
    assert kind != VECTORS
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.op10(spark.createDataFrame(rows, kind)).collect()}
    assert got == brute_vectors(rows) and any(n for n, _, _ in got.values())
    hot = [(i, [1.0, 2.0, 3.0], 1, "") for i in range(1000)] + [(5000, [1.0, 2.0, 3.01], 1, "")]
    got = embeddings.op10(spark.createDataFrame(hot, kind)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(1000, 0)}


def test_vectors_with_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(3, v, 1, ""), (3, v, 1, ""), (None, v, 1, ""), (None, w, 1, ""), (9, [1.0, 0.01], 1, "")]
    got = sorted((tuple(r) for r in embeddings.op10(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got.count((3, 3, 3, True)) == 2 and (None, 3, None, False) in got and (None, 0, None, False) in got and (9, 3, 3, False) in got
    assert embeddings.op10(spark.createDataFrame([], VECTORS)).count() == 0


def test_rows_repeated_many_times(spark):
    """Ten thousand rows of two near copies are two nodes; their ids' other texts count too."""
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, "")] * 5000 + [(2, base + " end", "")] * 5000 + [(3, "all of it is other text here", ""), (3, base + " more end", ""), (4, "all of it is other text here", "")]
    got = minhash.op1(spark.createDataFrame(rows, DOCS).repartition(4))
    rows = got.groupBy("doc_id", "n_shingles", "component_id", "kept").count().collect()
    assert {tuple(r)[:4]: r["count"] for r in rows} == {(1, 76, 1, True): 5000, (2, 77, 1, False): 5000, (3, 3, 1, False): 1, (3, 78, 1, False): 1, (4, 3, 1, False): 1}


def bm25_brute(docs, queries, k=10):
    tf = [collections.Counter((t or "").encode().lower().split()) for _, t in docs]
    size = [sum(c.values()) for c in tf]
    mean, n = max(sum(size), 1) / len(docs), len(docs)
    df = collections.Counter(w for c in tf for w in c)
    out = {}
    for q, text in queries:
        terms = set((text or "").encode().lower().split())
        scores = []
        for (i, _), c, length in zip(docs, tf, size, strict=True):
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in terms if w in c)
            if s > 0:
                scores.append((-round(s, 9), i))
        out[q] = sorted(scores)[:k]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bm25, "QUERY_BYTES", 2_000)
    rng = random.Random(31)
    words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(6000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for i in range(400)]
    docs += [(400, docs[0][1]), (401, docs[0][1]), (402, None), (403, ""), (404, "W1 w1 W2 " * 3000)]
    df = spark.createDataFrame([(i, t, "") for i, t in docs], DOCS)
    got: dict = {}
    for r in bm25.op6(df).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["doc_id"], r["score"]))
    want = {q: x for q, x in bm25_brute(docs, [d for d in docs if d[0] % 20 == 0]).items() if x}
    assert set(got) == set(want)
    for q, hits in got.items():
        hits.sort()
        assert [p for p, _, _ in hits] == list(range(1, len(want[q]) + 1))
        assert [-s for s, _ in want[q]] == pytest.approx([s for _, _, s in hits], abs=1e-6)
        least = min(s for _, _, s in hits)
        assert {d for _, d, s in hits if s > least + 2e-6} == {i for s, i in want[q] if -s > least + 2e-6}
    assert bm25.op6(df.limit(0)).count() == 0


def test_pivots_lose_nothing(monkeypatch):
    """Many small segments, shards and batches in one process, every score against brute force."""
    for name, value in (("BLOCK_DOCS", 4), ("SEGMENT_DOCS", 16), ("BATCH", 5), ("COMMON", 4)):
        monkeypatch.setattr(bm25, name, value)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(300 + i, "W1 w2 w3") for i in range(40)]
    queries = [(i, t) for i, t in docs[::9] if t] + [(9000, "w1 w2 nowhere"), (9001, "nowhere")]
    shards, builder = [], bm25._Builder(10)
    for at, (i, t) in enumerate(docs):
        builder.add(None if i == 305 else i, t.encode())
        if at % 90 == 89 or at == len(docs) - 1:
            shards.append(bm25._unpacked(builder.batch(), 0, tuple(bm25.ARRAYS)))
            builder = bm25._Builder(10)
    terms = [bm25.term_counts(t.encode())[0] for _, t in queries]
    block = bm25.Block(np.arange(len(queries)), np.repeat(np.arange(len(queries)), [t.size for t in terms]), np.concatenate(terms))
    df = np.array([sum(int(x["df"][x["terms"] == t].sum()) for x in shards) for t in block.terms])
    block.idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    of = {int(q): c for c in range(block.size) for q in block.members[block.first[c] : block.first[c + 1]]}
    assert sorted(of) == list(range(len(queries))) and block.size < len(queries)
    best = bm25.Best(block.size, 10)
    skipped, seen = [], bm25.Segment.candidates
    monkeypatch.setattr(bm25.Segment, "candidates", lambda *a: skipped.append(seen(*a)[0].size == 0) or seen(*a))
    mean = sum(len(t.split()) for _, t in docs) / len(docs)
    for x in shards:
        bm25._scan(x, block, mean, best)
    want = bm25_brute(docs, queries)
    for q, (name, _) in enumerate(queries):
        got = [(-s, i) for s, i, there in zip(best.score[of[q]], best.doc[of[q]], best.named[of[q]], strict=True) if there]
        hits = [(s, i) for s, i in want[name] if i != 305]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in hits], abs=1e-8) and len(got) in (len(hits), len(hits) + 1 if len(hits) < 10 else 10)
        assert len({s for s, _ in hits}) < len(hits) or [i for _, i in got] == [i for _, i in hits]
    assert any(skipped)


def test_search_with_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(-1, "a b c", ""), (None, "a b c", ""), (5, "a b", ""), (5, "a b", ""), (6, None, ""), (7, "", "")], DOCS)
    queries = spark.createDataFrame([(1, "A"), (1, "b"), (None, "a"), (2, None), (3, "zzz")], "query_id long, text string")
    got = [tuple(r)[:3] for r in bm25.search(docs, queries).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, 5), (1, 2, 5), (1, 3, -1), (1, 4, None)]
    many = spark.createDataFrame([(i, "same words here", "") for i in range(3000)], DOCS).repartition(3)
    assert [r["doc_id"] for r in bm25.search(many, queries.where("false").union(spark.createDataFrame([(1, "words")], queries.schema))).orderBy("place").collect()] == list(range(10))


PAGES = "page_id long, url string, html string, file string"


def test_audit_finds_what_differs(spark):
    rows = [(i, f"http://h/{i}", "<p>" + "t" * (i % 7), "") for i in range(1300)]
    a = merkle.archive(spark.createDataFrame(rows, PAGES))
    b = a.withColumn("data", F.when(F.col("key").isin(0, 511, 1299), F.concat("data", F.lit("!"))).otherwise(F.col("data")))
    b = b.where("key <> 700").unionByName(spark.createDataFrame([(9, 5000, "new")], "file long, key long, data string"))
    got = {(r["file"], r["key"]): r["state"] for r in merkle.audit(a, b).collect()}
    assert got[0, 0] == got[0, 511] == got[2, 1299] == "corrupt" and got[1, 700] == "missing" and got[9, 5000] == "extra"
    # What follows a record that grew or went lies at other offsets, to the end of its file.
    moved = {k for k, state in got.items() if state == "moved"}
    assert moved == {(0, i) for i in range(1, 511)} | {(1, i) for i in range(701, 1024)} and len(got) == len(moved) + 5
    assert merkle.audit(a, a).count() == 0 and merkle.audit(a.limit(0), a.limit(0)).count() == 0
    assert {r["state"] for r in merkle.audit(a.where("file = 1"), a.limit(0)).collect()} == {"missing"}


def audited(pages):
    """What op9 should give, by plain Python: {(page, state)} counted, for pages of unique ids."""
    files: dict = {}
    for i, url, html in sorted(pages):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:md5:{hashlib.md5(f'{i}|{url}'.encode()).hexdigest()}>\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(html.encode())}\r\n\r\n"
        here, there = files.setdefault(i // 512, ([], []))
        own = (head + html + "\r\n\r\n").encode()
        here.append((i, 0, own))
        if i % 2011 != 17:
            there.append((i, 0, b"0" * len(own) if i % 997 == 5 else (head + html.replace("e", "3", 1) + "\r\n\r\n").encode() if i % 101 == 7 else own))
        if i % 3001 == 23:
            there.append((i, 1, b"WARC/1.1\r\n\r\n"))
    out = []
    for file, (here, there) in files.items():
        at, places = 0, {}
        for i, turn, data in there:
            places[i, turn] = (at, data)
            at += len(data)
        at = 0
        for seq, (i, _, data) in enumerate(here):
            other = places.pop((i, 0), None)
            out.append((i, file, seq, at, hashlib.sha256(data).hexdigest(), "missing" if other is None else "corrupt" if other[1] != data else "moved" if other[0] != at else "intact"))
            at += len(data)
        out += [(i, file, [x[:2] for x in there].index((i, 1)), at, hashlib.sha256(data).hexdigest(), "extra") for (i, _), (at, data) in places.items()]
    return sorted(out)


def test_audit_query(spark):
    pages = [(i, f"http://h/{i}", "<p>hello é</p>" * (i % 3)) for i in range(5200)]
    got = merkle.op9(spark.createDataFrame([(*p, "x") for p in pages], PAGES)).collect()
    assert sorted((r["page_id"], r["file"], r["seq"], r["first_byte"], r["sha256"], r["state"]) for r in got) == audited(pages)
    assert {r["state"] for r in got} == {"intact", "corrupt", "missing", "extra", "moved"}
    assert merkle.op9(spark.createDataFrame([], PAGES)).count() == 0


def test_audit_of_pages_without_own_ids(spark):
    """Null and repeated ids fill files in the order of the rows: none grows with an id."""
    rows = [(None, None, None, "")] * 3000 + [(24, "again", "body", "")] * 1500 + [(i, "u", "", "") for i in range(100, 300)]
    got = merkle.op9(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert len(got) == len(rows) and {r["state"] for r in got} == {"intact"}
    sizes = collections.Counter(r["file"] for r in got)
    assert max(sizes.values()) <= merkle.FILE_RECORDS


def test_warc_files(spark, tmp_path):
    """Two replicas of plain and compressed files: a flipped byte, a lost record, a file cut short."""
    rng = random.Random(4)
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    records = [record(i, bytes(rng.choices(range(256), k=rng.randint(0, 300)))) for i in range(120)]
    for side in ("a", "b"):
        (tmp_path / side).mkdir()
    pack = lambda some: b"".join(gzip.compress(r, mtime=0) for r in some)
    (tmp_path / "a" / "1.warc").write_bytes(b"".join(records[:60]))
    (tmp_path / "a" / "2.warc.gz").write_bytes(pack(records[60:]))
    flipped = bytearray(b"".join(records[:60]))
    flipped[sum(map(len, records[:30])) + len(records[30]) - 5] ^= 1
    (tmp_path / "b" / "1.warc").write_bytes(bytes(flipped[:-7]))
    (tmp_path / "b" / "2.warc.gz").write_bytes(pack(records[60:90] + records[91:]))
    one, two = (merkle.read_warc(spark, str(tmp_path / side)) for side in ("a", "b"))
    got = one.orderBy("path", "seq").collect()
    assert [bytes(r["data"]) for r in got] == records and [r["key"] for r in got] == [f"<urn:{i}>" for i in range(120)] and not any(r["error"] for r in got)
    assert all(x["last"] == y["first"] or y["first"] == 0 for x, y in zip(got, got[1:], strict=False))
    found = {(r["file"], r["key"] or r["seq"]): r["state"] for r in merkle.audit(*merkle.numbered(one, two)).collect()}
    assert found.pop((0, "<urn:30>")) == "corrupt" and found.pop((0, "<urn:59>")) == "missing" and found.pop((0, 59)) == "extra" and found.pop((1, "<urn:90>")) == "missing"
    assert found == {(1, f"<urn:{i}>"): "moved" for i in range(91, 120)}
    (tmp_path / "c").mkdir()
    broken = bytearray((tmp_path / "a" / "2.warc.gz").read_bytes())
    broken[len(pack(records[60:70])) + 3] ^= 255
    (tmp_path / "c" / "2.warc.gz").write_bytes(bytes(broken))
    (tmp_path / "c" / "3.warc").write_bytes(b"junk\r\n" + records[0])
    (tmp_path / "c" / "4.warc").write_bytes(b"")
    bad = merkle.read_warc(spark, str(tmp_path / "c")).orderBy("path", "seq").collect()
    assert [bool(r["error"]) for r in bad[-2:]] == [True, False] and bytes(bad[-1]["data"]) == records[0]
    assert sum(bool(r["error"]) for r in bad) == 2 and {r["key"] for r in bad} >= {f"<urn:{i}>" for i in range(71, 120)}
