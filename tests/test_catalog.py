import json
import urllib.error
import urllib.request

import pytest

from factloom.operators.catalog import upsert
from factloom.operators.extract import ModelExtractor, RuleExtractor
from factloom.operators.providers import Provider, extractor_for, pick, reviewer_for
from factloom.operators.review import TemplateReviewer
from factloom.plans.fusion import run
from factloom.registry.tables import field_table
from factloom.sources.manifests import catalog_info, categories_of, read_catalog, synthetic
from factloom.sources.sinks import catalog_index, read_table, summary, write_catalog_csv, write_records, write_sources
from factloom.streaming.gateway import ROUTE, Gateway
from factloom.streaming.ingest import latest, start


def test_upsert_moves_replaced_products_to_the_end(spark):
    index = spark.createDataFrame([("a", 0, 1), ("b", 1, 2)], "product_id string, product_ord long, v int")
    batch = spark.createDataFrame([("a", 0, 9), ("c", 1, 3)], "product_id string, product_ord long, v int")
    rows = upsert(index, batch).orderBy("product_ord").collect()
    assert [(r["product_id"], r["v"]) for r in rows] == [("b", 2), ("a", 9), ("c", 3)]
    assert [r["product_id"] for r in upsert(index.limit(0), batch).orderBy("product_ord").collect()] == ["a", "c"]


def test_sinks(spark, tmp_path):
    result = run(synthetic(spark, 3))
    write_records(result.records, str(tmp_path / "records"))
    docs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "records")).collect()]
    assert {d["product_id"] for d in docs} == {"6200-2RS", "6201-2RS", "6202-2RS"}
    assert docs[0]["fields"][0]["value"].startswith("620") and "conflicts" in docs[0]["fields"][0]
    write_catalog_csv(result.catalog, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["product_id", "category", "status", "verified", "needs_review", "conflicts", "rules_run", "extracted", "output"]
    index = json.loads(catalog_index(result.catalog, "c", "C").first()["json"])
    assert index["totals"]["products"] == 3 and [p["product_id"] for p in index["products"]] == ["6200-2RS", "6201-2RS", "6202-2RS"]
    assert "3 products (3 ok / 0 failed)" in summary(result.catalog)


def test_stream_replaces_products(spark, tmp_path):
    drop, out = tmp_path / "in", tmp_path / "out"
    drop.mkdir()
    put = lambda name, mass: (drop / name).write_text(json.dumps({"product_id": "p", "category": "electric_motor", "sources": [{"type": "pdf", "text": f"Mass {mass} kg"}]}))
    for name, mass in (("1.json", 62), ("2.json", 70)):
        put(name, mass)
        start(spark, str(drop), str(out), str(tmp_path / "check")).awaitTermination()
    rows = latest(spark.read.parquet(str(out / "records"))).collect()
    assert len(rows) == 1 and json.loads(rows[0]["json"])["fields"][0]["value"] == 70


def test_providers(spark):
    one = Provider("one", "ONE_KEY", lambda prompt: "{}")
    assert pick("auto", [one], {}) == "mock" and pick("auto", [one], {"ONE_KEY": "k"}) == "one" and pick("mock", [one], {"ONE_KEY": "k"}) == "mock"
    fields = field_table(spark)
    assert isinstance(extractor_for("mock", fields, str), RuleExtractor) and isinstance(extractor_for("one", fields, str, [one]), ModelExtractor)
    assert isinstance(reviewer_for("mock"), TemplateReviewer)
    with pytest.raises(ValueError):
        reviewer_for("two", [one])


def test_catalog_documents(spark, tmp_path):
    schema = {"category": "lamp", "category_label": "Lamp", "fields": [{"name": "power", "type": "number", "unit": "W"}]}
    (tmp_path / "s.json").write_text(json.dumps(schema))
    (tmp_path / "m.json").write_text(json.dumps({"product_id": "l", "category": "lamp", "sources": []}))
    (tmp_path / "cat.json").write_text(json.dumps({"products": [{"manifest": "m.json", "schema": "s.json"}]}))
    entries = read_catalog(str(tmp_path / "cat.json"), str(tmp_path))
    assert catalog_info(str(tmp_path / "cat.json")) == ("cat", "cat")
    assert "lamp" in {c.name for c in categories_of(entries)} and len(categories_of([])) == 4


def test_source_tables(spark, tmp_path):
    assert read_table(spark, str(tmp_path / "none")) is None
    write_sources(synthetic(spark, 2), str(tmp_path / "bronze"))
    write_sources(synthetic(spark, 1), str(tmp_path / "bronze"))
    assert read_table(spark, str(tmp_path / "bronze")).count() == 9


def test_ingest_over_http(spark, tmp_path):
    server = Gateway(spark, str(tmp_path / "served")).serve()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(body, route=ROUTE):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + route, body, method="POST")) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    put = lambda product, mass: post(json.dumps({"product_id": product, "category": "electric_motor", "sources": [{"type": "pdf", "text": f"Mass {mass} kg"}]}).encode())
    try:
        assert post(b"not json")[0] == post(b"[1]")[0] == 400 and post(b"{}", "/api/other")[0] == 404
        status, got = post(json.dumps({"product_id": "p", "category": "toaster", "sources": [{"text": "x"}]}).encode())
        assert status == 500 and got["ok"] is False and "unknown category 'toaster'" in got["error"]
        status, got = put("p", 62)
        assert status == 200 and got["record"]["fields"][0]["value"] == 62 and got["products"] == ["p"]
        assert put("q", 5)[1]["products"] == ["p", "q"]
        status, got = put("p", 70)
        assert got["record"]["fields"][0]["value"] == 70 and got["products"] == ["p", "q"] and got["totals"]["products"] == 2
    finally:
        server.shutdown()
