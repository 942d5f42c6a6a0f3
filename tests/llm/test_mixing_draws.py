"""Rows without an id of their own are drawn apart."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing


@pytest.mark.parametrize("number", [None, 5])
def test_a_source_without_own_ids_meets_its_target(spark, number):
    rows = [(number, f"text {i} of one source", s) for s in ("a", "b", "c") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, n = mixing.mix(df)
    per = out.groupBy("source").agg(F.sum(F.col(n["size"]) * F.col(n["copies"])).alias("taken"), F.max(n["target"]).alias("target"), F.countDistinct(n["copies"]).alias("kinds")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.1 * r["target"] for r in per)
    assert any(r["kinds"] == 2 for r in per)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(df.repartition(7))[0].collect()))


def test_targets_of_many_sources(spark, monkeypatch):
    """More sources than one window takes: the same targets as by sharing in rounds."""
    rng = random.Random(6)
    sizes = {f"s{i:04d}": rng.choice([0, 1, 5, 40, 1000, 90_000]) for i in range(700)} | {None: 77}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    one = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    many = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    want, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < share * weight[s]}
        if not full:
            want |= {s: share * weight[s] for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        open_ -= full
    assert one == pytest.approx(want) and many == pytest.approx(want)
