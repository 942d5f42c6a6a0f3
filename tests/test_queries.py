"""Each query with SQL against DuckDB over the smallest tables."""

import glob
import math
import os
import re
from html import unescape

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.plans import queries as q
from factloom.sources.documents import strip_tags


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def tidy(rows):
    one = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(one(x) for x in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = q.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(q.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert tidy(df.select(*columns).collect()) == tidy(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_references_without_semicolon_stay(spark, tmp_path):
    """A page's text is what its SQL gives where a reference is cut off, nested, or of no known name."""
    pages = [(1, "<h1>a &amp; b&amp</h1>"), (2, "&amp;lt; &lt;b&gt; &am &copy &nbsp;x &eacute; &#39;"), (3, "<p>&quot;x&quot;</p>&middot;"), (4, None)]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in q.queries()["html_stripped"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.sql(q.oracle_sql()["html_stripped"]).fetchall())
    assert dict(got)[1] == " a & b&amp\n"


def test_every_reference(spark):
    """Left to itself, stripping reads references as HTML does."""
    assert spark.createDataFrame([("&eacute;&#39;&amp &amp;lt;",)], "h string").select(strip_tags(F.col("h"))).first()[0] == "é'& &lt;"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plain_rows(page):
    """Rows by a scan over tags: each open element of a kind that gives a row gets the texts until it, or an element around it, ends."""
    rows, stack, skipping = [], [], 0
    for m in re.finditer(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(/?)([a-z][a-z0-9]*)\b([^>]*)>|([^<]+)", page, re.I | re.S):
        end, tag, _, text = m.groups()
        if text is not None:
            text = unescape(text).strip()
            for row in stack:
                if text and not skipping and row[1] is not None:
                    row[1].append(text)
        elif tag:
            tag = tag.lower()
            if tag in ("br", "img", "meta", "link", "input", "hr"):
                continue
            if tag in ("script", "style", "noscript", "svg"):
                skipping += -1 if end else 1
            elif not end:
                own = [] if tag in ("p", "h1", "h2", "h3", "h4", "li") and not skipping else None
                if own is not None:
                    rows.append(own)
                stack.append((tag, own))
            elif any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
    return [" ".join(r) for r in rows if r]


def test_html_blocks_equal_a_plain_scan(spark, sf):
    """Every row of every page; the pages have no tables."""
    got = {}
    for r in q.queries()["html_blocks"](spark, sf).collect():
        got.setdefault(r["page_id"], {})[r["line"]] = r["said"]
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(pages) > 40
    for p in pages:
        want = [line.rstrip() for row in plain_rows(p["html"]) for line in re.split("\r\n|[\n\r]", row)]
        assert got.get(p["page_id"], {}) == {i: x for i, x in enumerate(want, 1) if x}


def test_entry_without_the_corpus_operators(monkeypatch):
    """A part that can't be imported leaves the engine's queries."""
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def broken(name, *args, **kw):
        if name == "corpus_pipeline":
            raise ImportError("a library is missing")
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", broken)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
    assert "fuse_numeric" in entry.queries() and not any(n.startswith("op") and n[2:3].isdigit() for n in entry.queries())
