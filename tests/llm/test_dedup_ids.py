"""Deduplication where ids clash or are null."""

from factloom.llm import minhash

A, B, C, D = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, `dedup.id` string").repartition(3)
    got = minhash.deduplicate(df)
    assert got.columns == df.columns
    return sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)


def test_texts_of_a_clashing_id_stay(spark):
    rows = [(5, A, ""), (5, B, ""), (5, B, ""), (2, B + " more", ""), (7, A.upper(), ""), (8, C, ""), (5, None, "")]
    assert kept(spark, rows) == sorted([(5, A), (2, B + " more"), (8, C), (5, None)], key=str)


def test_copies_without_an_id_go(spark):
    rows = [(1, A, ""), (None, A, ""), (None, A + " more", ""), (None, B, ""), (None, B, ""), (None, B.upper(), ""), (None, D, "")]
    got = kept(spark, rows)
    assert (1, A) in got and (None, D) in got and len(got) == 3 and sum(t.lower() == B for _, t in got) == 1
