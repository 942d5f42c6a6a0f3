import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.numbers import agree, parse_number, round3
from factloom.functions.text import general, plain_number, shortest, slug, strip
from factloom.functions.units import canonical, to_unit
from factloom.operators.normalize import closest_target, domain_value, string_key
from factloom.registry.tables import field_table


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "text, value",
    [("12 000", 12000), ("7 800", 7800), ("14,0", 14), ("12,000", 12000), ("0.127", 0.127), ("1'250", 1250), ("1.234,5", 1.2345), ("0,127", 127), ("+12,000", 12), ("1,234,567", None), ("N/A", None), ("", None), ("nan", None), ("1e3", 1000), ("1.0d", None), ("1 000", 1000), (None, None), (" -5 ", -5)],
)
def test_parse_number(spark, text, value):
    assert one(spark, [(text,)], "t string", parse_number(F.col("t"))) == [(value,)]


def test_round3_is_exact(spark):
    rng = random.Random(5)
    xs = [rng.random() * 0.99 + 0.01 for _ in range(3000)] + [k / 2000 for k in range(20, 2000)] + [0.85 * 0.95 + 0.08]
    got = one(spark, [(x,) for x in xs], "x double", "x", round3(F.col("x")))
    assert [r for r in got if r[1] != round(r[0], 3)] == []


def test_number_texts(spark):
    xs = [0.0, 25.0, 0.127, 100000.0, 1234567.0, 0.00001, 0.0001234, 999999.5, 123.456789, -20.0, 0.5, 9.9999995, 12000000.0]
    got = one(spark, [(x,) for x in xs], "x double", "x", general(F.col("x")), plain_number(F.col("x")), shortest(F.col("x")))
    for x, g, p, s in got:
        assert g == f"{x:g}"
        assert float(s) == pytest.approx(x, abs=1e-6) and "." in s
        assert float(p) == pytest.approx(x, abs=1e-6) and (not x.is_integer() or "." not in p)


def test_units(spark):
    rows = [(14000.0, "N", "kN", 14.0), (13000.0, "r/min", "rpm", 13000.0), (1.97, "inches", "mm", 50.038), (580.0, "PSI", "bar", 39.989608), (50.0, "degF", "°C", 10.0), (0.0, "°C", "K", 273.15), (300.0, "K", "f", 80.33), (5.0, None, "mm", 5.0), (3.0, "furlong", "mm", 3.0), (2.0, "mbar", "bar", 2.0), (10.0, "hp", "kW", 7.457), (332.0, "lbf·ft", "Nm", 450.131576)]
    got = one(spark, rows, "x double, a string, b string, want double", to_unit(F.col("x"), F.col("a"), F.col("b")), "want")
    assert all(a == pytest.approx(b, abs=1e-5) for a, b in got)
    assert one(spark, [("  MIN-1 ",), ("mW",), (None,)], "u string", canonical(F.col("u"))) == [("rpm",), ("MW",), ("",)]


def test_agreement(spark):
    rows = [(25.0, 25.2, True), (25.0, 24.96, True), (13000.0, 12000.0, False), (0.01, 0.05, True), (None, 1.0, False), (-100.0, -101.0, True)]
    assert all(a == b for a, b in one(spark, rows, "a double, b double, w boolean", agree(F.col("a"), F.col("b")), "w"))


def test_domain_values(spark):
    fields = {r["field"]: r for r in field_table(spark).where("category = 'deep_groove_ball_bearing' or field = 'actuation'").collect()}

    def resolve(field, value):
        f = fields[field]
        df = spark.createDataFrame([(value, f["synonyms"], f["enum"], f["candidates"])], "v string, s map<string,string>, e array<string>, c array<struct<token:string,target:string,reach:int>>")
        return df.select(domain_value(F.col("v"), F.col("s"), F.col("e"), F.col("c"))).first()[0]

    assert resolve("seal_type", " Contact Seal ") == "2RS"
    assert resolve("seal_type", "2R5") == "2RS"
    assert resolve("actuation", "manua1") == "manual"
    assert resolve("actuation", "pneumatik") == "pneumatic"
    assert resolve("clearance", "C1") == "c1"  # one edit from several targets
    assert resolve("seal_type", "FOO") == "foo"
    assert resolve("seal_type", "") == ""


def test_closest_target_ties(spark):
    df = spark.createDataFrame([("ab", [("aa", "X", 1), ("bb", "Y", 1)]), ("aa", [("aa", "X", 1), ("ab", "Y", 1)]), ("zzzz", [("aa", "X", 1)])], "v string, c array<struct<token:string,target:string,reach:int>>")
    assert [r[0] for r in df.select(closest_target(F.col("v"), F.col("c"))).collect()] == [None, "X", None]


def test_string_keys(spark):
    rows = [("6205-2RSH", "part_number", "6205"), ("6205 -2rs", "part_number", "6205"), ("  Acme   Flow ", "brand", "acme flow"), ("6205-2RS", "brand", "6205-2rs")]
    assert all(a == b for a, b in one(spark, rows, "v string, f string, w string", string_key(F.col("v"), F.col("f")), "w"))


def test_slug_and_strip(spark):
    rows = [(" GRX 225/M ", "GRX-225-M"), ("..", "product"), (" a ", "a")]
    assert all(a == b for a, b in one(spark, rows, "v string, w string", slug(F.col("v")), "w"))
    assert one(spark, [("  x ",)], "v string", strip(F.col("v"))) == [("x",)]
