"""A row of a small file becomes many: it is dealt out by product once, and stages that group by product don't shuffle again."""

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators.fuse import fuse
from factloom.operators.route import route, route_checked
from factloom.operators.validate import check_rules, validated, validation
from factloom.plans import queries as q
from factloom.plans.fusion import run, tables_in
from factloom.sources.manifests import synthetic
from factloom.workers import dealt


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_dealt_grows_with_the_rows(spark):
    few, many = (dealt(spark.range(n).select(F.col("id").cast("string").alias("product_id")), "product_id", 500) for n in (3, 10_000))
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (1, 20)
    assert many.distinct().count() == 10_000


@pytest.mark.parametrize("name", ["fuse_numeric", "fuse_fields", "enum_rule", "route_status", "marketing_gated"])
def test_one_shuffle(spark, sf, name, monkeypatch):
    monkeypatch.setattr(q, "PARTS_EACH", 20)
    df = q.queries()[name](spark, sf)
    assert shuffles(df) == 1
    assert df.rdd.getNumPartitions() == 10  # of 200 parts


def test_whole_plan_shuffles_once(spark, tmp_path):
    """Each kept stage has one shuffle at most, the records none but of what sources and their lines are; results are the same."""
    seen = {}

    def told(name, df):
        seen[name] = shuffles(df)
        return tables_in(str(tmp_path), 3)(name, df)

    result, plain = run(synthetic(spark, 40), keep=told, parts=3), run(synthetic(spark, 40))
    assert seen == {"observations": 1, "routed": 0}
    assert result.routed.groupBy("product_id").count().rdd.getNumPartitions() == 3
    for name in ("records", "catalog"):
        a, b = (sorted(map(str, getattr(r, name).collect())) for r in (result, plain))
        assert a == b and len(a) == 40
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("factloom_")]


def test_routing_without_a_join(spark, sf):
    """Fields meet their failed checks as they do by the join."""
    fused = q._fused(spark, sf)
    rules = ([q.PART], (*q.PART_RULES, *(q.Rule(f"w{i}", q.WARNING, ("weight",), lambda w, i=i: w != 40 + i, "weight is {0}") for i in range(8))))
    a, b = (sorted(map(str, df.collect())) for df in (route(fused, check_rules(fused, *rules)), route_checked(fused, *rules)))
    assert a == b and any(x.count("rule_id=") > 1 for x in a)
    assert fuse(q._normalized(spark, sf)).columns == fused.columns


def test_validation_from_one_row(spark, sf, monkeypatch):
    """Rules run, outcome and issues are those of the exploded checks."""
    rules = ([q.PART], (*q.PART_RULES, q.Rule("w", q.WARNING, ("weight",), lambda w: w != 40, "weight is {0}")))
    a, b = (sorted(map(str, df.collect())) for df in (validation(check_rules(q._fused(spark, sf), *rules)), validated(q._fused(spark, sf), *rules).where("rules_run > 0")))
    assert a == b and any("passed=False" in x for x in a) and any("passed=True, issues=[Row" in x for x in a)


def test_lines_written_alike_are_one(spark, sf, tmp_path):
    """A line that comes twice is one of the SQL's rows, with both its checks; nothing but counts is shuffled."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.unionAll(lines.limit(100)).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    df = q.queries()["rules_run_passed"](spark, str(tmp_path))
    assert shuffles(df) == 1 and "ObjectHashAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    want = con.sql(q.oracle_sql()["rules_run_passed"])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
