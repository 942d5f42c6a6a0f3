import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators.catalog import catalog_totals
from factloom.operators.extract import ModelExtractor
from factloom.operators.fuse import conversion_diff, fuse, fuse_numbers
from factloom.operators.normalize import normalize
from factloom.operators.record import record_json
from factloom.operators.review import ModelReviewer
from factloom.operators.sanitize import PromptTemplate, answer_schema, sanitize
from factloom.plans.fusion import run, tables_in
from factloom.registry.categories import Category
from factloom.registry.tables import field_table, rule_table
from factloom.sources.documents import page_text, split_lines
from factloom.sources.manifests import from_payloads, read_catalog, sources_of, synthetic
from factloom.streaming.ingest import PAYLOAD

BEARING = "deep_groove_ball_bearing"
OBS = "product_id string, category string, src_ord int, rule_ord int, source_id string, authority double, field string, value string, unit string, confidence double, method string, snippet string, line_start int, line_end int, reasoning string"


def obs(*values, category=BEARING, product="p"):
    """(source, authority, field, value, unit, confidence) to observation rows."""
    order = {"a": 0, "b": 1, "c": 2}
    return [(product, category, order[s], i, s, auth, field, value, unit, conf, "table_parse", "", 1, 1, "") for i, (s, auth, field, value, unit, conf) in enumerate(values)]


def fused(spark, rows):
    return {r["field"]: r for r in fuse(normalize(spark.createDataFrame(rows, OBS), field_table(spark))).collect()}


def payload(spark, *products):
    return spark.createDataFrame([(p, c, [(s.get("id"), s["type"], s.get("title"), s["text"], s.get("authority")) for s in sources]) for p, c, sources in products], PAYLOAD)


def ingest(spark, *products):
    sources, rejected = from_payloads(payload(spark, *products))
    return run(sources), rejected


def test_agreement_boosts(spark):
    f = fused(spark, obs(("a", 0.95, "bore_diameter", "25", "mm", 0.95), ("b", 0.85, "bore_diameter", "24.96", "mm", 0.95)))["bore_diameter"]
    assert (f["value_num"], f["confidence"], f["flags"], f["conflict"], f["display"]) == (25.0, 0.98, ["multi_source"], False, "25")
    assert f["reasoning"] == "2 sources agree on Bore diameter (d) (normalized 25.0); confidence boosted from 0.90 to 0.98."


def test_conflict_has_no_winner(spark):
    f = fused(spark, obs(("a", 0.95, "max_speed", "13000", "r/min", 0.95), ("b", 0.85, "max_speed", "12 000", "rpm", 0.85)))["max_speed"]
    assert f["value_num"] is None and f["confidence"] == 0.4 and f["flags"] == ["conflict"]
    assert f["reasoning"] == "Sources disagree on Max speed: a=13000 r/min; b=12 000 rpm"
    assert [v["value"] for v in f["conflicts"][0]["values"]] == ["13000", "12 000"]


def test_single_source_confidence(spark):
    got = fused(spark, obs(("a", 0.95, "brand", "SKF", None, 0.95), ("c", 0.7, "precision_grade", "ABEC 1", None, 0.55)))
    assert got["brand"]["confidence"] == 0.857 and got["precision_grade"]["confidence"] == 0.366


def test_two_extractions_of_one_source_count_twice(spark):
    f = fused(spark, obs(("c", 0.7, "seal_type", "2RS", None, 0.6), ("c", 0.7, "seal_type", "2R5", None, 0.55)))["seal_type"]
    assert f["n"] == 2 and f["value_str"] == "2RS" and f["flags"] == ["multi_source"]


def test_unreadable_values(spark):
    got = fused(spark, obs(("a", 0.95, "width", "15", "mm", 0.95), ("b", 0.85, "width", "N/A", "mm", 0.95), ("a", 0.95, "weight", "?", "kg", 0.9)))
    assert len(got["width"]["sources"]) == 1 and got["width"]["dropped"][0]["reasoning"].endswith("[unparseable value excluded from merge]")
    assert "weight" not in got


def test_ties_go_to_the_earlier_source_and_rule(spark):
    got = fused(spark, obs(("b", 0.9, "part_number", "6205-2RS", None, 0.9), ("a", 0.9, "part_number", "6205-2RSH", None, 0.9)))
    assert got["part_number"]["display"] == "6205-2RSH"


def test_min_max_form_equals_clusters(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for p in range(300):
        base = rng.choice([0.02, 1.0, 25.0, 1000.0, -40.0])
        values = [base * (1 + rng.choice([0, 0, 0.005, 0.011, 0.02])) + rng.choice([0, 0.03]) for _ in range(rng.randint(1, 4))]
        rows += [(p, i, f"s{i}", round(v, 6), 0.8) for i, v in enumerate(values)]
        groups = []
        for v in (round(x, 6) for x in values):
            close = lambda a, b: abs(a - b) <= max(0.01 * max(abs(a), abs(b)), 0.05)
            for g in groups:
                if close(min(g), v) and close(max(g), v):
                    g.append(v)
                    break
            else:
                groups.append([v])
        want[p] = len(groups) > 1
    df = spark.createDataFrame(rows, "k int, src_ord int, source_id string, key_num double, eff double")
    assert {r["k"]: r["conflict"] for r in fuse_numbers(df, "k").collect()} == want


SHEET = "SKF 6205-2RSH Deep groove ball bearing\n\nd [mm] 25\nD [mm] 52\nB [mm] 15\nBasic dynamic load rating C 14,0 kN\nBasic static load rating C0 7.8 kN\nLimiting speed 15000 r/min\nMass 0.28 lb\nInternal clearance  CN\n"
PAGE = "<h1>6205-2RS Bearing</h1><p>Bore: 25 mm, OD: 52 mm, Width: 15 mm.</p><table><tr><td>Dynamic load rating</td><td>14000 N</td></tr><tr><td>Max speed (grease)</td><td>15,000 rpm</td></tr><tr><td>Operating temperature</td><td>-20 °C to +120 °C</td></tr></table>"


def test_whole_plan(spark):
    result, rejected = ingest(spark, ("6205", BEARING, [{"type": "pdf", "text": SHEET}, {"type": "web", "text": PAGE}, {"type": "ocr", "text": "25x52x15\n2R5\nJAPAN\nABEC 1"}]))
    assert rejected.count() == 0
    record = json.loads(record_json(result.records).first()["json"])
    fields = {f["field"]: f for f in record["fields"]}
    assert fields["bore_diameter"]["value"] == 25 and fields["bore_diameter"]["status"] == "verified"
    assert fields["dynamic_load_rating"]["value"] == 14 and fields["max_speed"]["value"] == 15000
    assert fields["weight"]["value"] == pytest.approx(0.127006)
    assert fields["seal_type"]["value"] == "2RS" and fields["country_of_origin"]["value"] == "Japan"
    assert fields["precision_grade"]["flags"] == ["single_source", "low_confidence"]
    assert record["summary"]["omitted_not_found"] == ["material"]
    assert [s["lines"] for s in record["sources"]] == [9, 5, 4]
    assert fields["bore_diameter"]["sources"][0]["line_start"] == 3  # blank lines count
    assert record["marketing"]["description"].startswith("It is rated for a dynamic load of 14 kN and a static load of 7.8 kN. Operating temperature range is -20 °C to 120 °C.")
    assert record["marketing"]["sentences_skipped"] == ["sentence using seal_type skipped (needs_review/missing/conflict)"]
    assert record["validation"]["passed"] is True
    low = [q for q in record["needs_review_queue"] if q["field"] == "precision_grade"][0]
    assert low["reason"] == "Only 1 source(s), effective confidence 0.37 < 0.75 threshold"
    assert record["ai_review"]["all_clear"] is False and record["ai_review"]["fields_reviewed"] == len(record["needs_review_queue"])


def test_rules_and_routing(spark):
    sheet = "d [mm] 52\nD [mm] 25\nMass 0.127 kg\nSeal  Contact seal, RS1 on both sides"
    result, _ = ingest(spark, ("x", BEARING, [{"type": "pdf", "text": sheet}, {"type": "web", "text": "Operating temperature 120 °C to -20 °C"}]))
    failed = {r["rule_id"]: r["message"] for r in result.checks.where("failed").collect()}
    assert failed == {
        "bore_lt_outer": "bore_diameter (52 mm) must be smaller than outer_diameter (25 mm)",
        "temp_min_lt_max": "temperature_range_min (120 °C) must be below temperature_range_max (-20 °C)",
    }
    routed = {r["field"]: r for r in result.routed.collect()}
    assert routed["bore_diameter"]["flags"] == ["single_source", "validation"] and routed["outer_diameter"]["status"] == "verified"
    assert result.records.first()["passed"] is False


def test_unknown_domain_value_fails(spark):
    rows = obs(("a", 0.95, "seal_type", "FOO", None, 0.95), ("b", 0.9, "seal_type", "foo", None, 0.95))
    from factloom.operators.route import route
    from factloom.operators.validate import check_rules

    f = fuse(normalize(spark.createDataFrame(rows, OBS), field_table(spark)))
    r = route(f, check_rules(f)).first()
    assert r["status"] == "needs_review" and r["value_str"] == "FOO"
    assert r["validation_issues"][0]["message"] == "seal_type 'FOO' not in schema enum ['2RS', '2RU', '2Z', 'RS', 'ZZ', 'open']"


def test_small_weight_fails_the_motor_rule_too(spark):
    totals = catalog_totals(run(synthetic(spark, 12)).catalog).first()
    assert (totals["products"], totals["verified"], totals["needs_review"], totals["conflicts"], totals["rules_run"]) == (12, 164, 16, 0, 156)


def test_kept_stages_give_the_same_catalog(spark, tmp_path):
    a, b = (sorted(map(str, run(synthetic(spark, 14), keep=k).catalog.collect())) for k in (None, tables_in(str(tmp_path))))
    assert a == b


def test_synthetic_ids_are_unique(spark):
    ids = [r["product_id"] for r in synthetic(spark, 14).select("product_id").distinct().collect()]
    assert len(ids) == 14 and "6200-2RS-2" in ids


def test_conflict_review(spark):
    result, _ = ingest(spark, ("g", "helical_gear_reducer", [{"type": "pdf", "text": "Part no GRX-1\nOutput speed 58 r/min\nRated torque 450 Nm"}, {"type": "web", "text": "Output speed 60 rpm\nRated torque 332 ft-lb"}]))
    got = {r["field"]: r for r in result.reviews.collect()}
    assert "Cross-source conflict on Output speed: Sources disagree on Output speed: src_pdf=58 rpm; src_web=60 rpm." in got["output_speed"]["review"]
    assert "PDF datasheet snippet (authority 0.95)" in got["output_speed"]["suggested_action"]
    assert {r["field"]: r["value_num"] for r in result.fused.collect()}["rated_torque"] == 450.0
    assert result.records.first()["description"] == ""  # no sentences for this category


def test_model_reviews_fall_back(spark):
    result, _ = ingest(spark, ("m", BEARING, [{"type": "ocr", "text": "ABEC 1\nJAPAN"}]))
    answer = json.dumps({"reviews": [{"field": "precision_grade", "review": "look again", "suggested_action": "ask"}, {"field": "nope", "review": "", "suggested_action": ""}]})
    got = {r["field"]: r["review"] for r in ModelReviewer(lambda prompt: answer).review(result.queue, result.records.select("product_id").crossJoin(spark.createDataFrame([("src_ocr", "t", 0.7)], "source_id string, title string, authority double"))).collect()}
    assert got["precision_grade"] == "look again" and got["country_of_origin"].startswith("Country of origin is backed by only 1 source(s)")


def test_payload_rejections_and_duplicate_ids(spark):
    text = [{"type": "pdf", "text": "Mass 1 kg"}]
    p = payload(spark, (" ", BEARING, text), ("a", "toaster", text), ("b", BEARING, [{"type": "pdf", "text": "  "}]), ("c", BEARING, [{"id": "s", "type": "pdf", "text": "Mass 1 kg"}, {"id": "s", "type": "web", "text": "x\ny"}]))
    sources, rejected = from_payloads(p)
    assert sorted(r["reason"].split(" ")[0] for r in rejected.collect()) == ["at", "product_id", "unknown"]
    rows = sources.orderBy("src_ord").collect()
    assert [r["source_id"] for r in rows] == ["s", "s-2"] and rows[1]["raw_text"] == "<p>x</p>\n<p>y</p>" and rows[1]["authority"] == 0.85


def test_imperial_valve(spark):
    result, _ = ingest(spark, ("v", "2_way_ball_valve", [{"type": "pdf", "text": "Part no V-1\nDN [mm] 50\nPressure rating 40 bar\nActuation manual lever\nWeight 3.4 kg"}, {"type": "web", "text": "Connection: 1.97 in\nPressure rating 580 PSI\nActuation: manual\nWeight: 7.5 lb"}]))
    got = {r["field"]: (r["display"], r["conflict"]) for r in result.fused.collect()}
    assert got["connection_size"] == ("50", False) and got["pressure_rating"] == ("40", False) and got["weight"] == ("3.4", False) and got["actuation"] == ("manual", False)
    diff = {(r["field"], r["raw_unit"]) for r in conversion_diff(result.normalized, result.fused).collect()}
    assert diff == {("connection_size", "in"), ("pressure_rating", "PSI"), ("weight", "lb")}


ANSWER = {
    "fields": [
        {"field": "width", "value": 42, "confidence": 2.5, "method": "hack", "line_start": "bad", "line_end": 3},
        {"field": "brand", "value": "Acme", "confidence": "0.5", "method": "ocr_heuristic", "unit": " ", "line_start": 4, "line_end": 5, "snippet": 7},
        {"field": "brand", "value": True, "confidence": 1}, {"field": "brand", "value": {"a": 1}}, {"field": "brand", "value": " "}, {"field": "made_up", "value": "1"}, None, "text", {"value": "1"},
    ]
}


@pytest.mark.parametrize("bad", [None, "", "[]", '{"fields": 3}', "not json", '{"fields": []}'])
def test_unusable_answers(spark, bad):
    df = spark.createDataFrame([("p", BEARING, 0, "s", 0.9, bad)], "product_id string, category string, src_ord int, source_id string, authority double, response string")
    assert sanitize(df, field_table(spark)).count() == 0


def test_sanitized_answers(spark):
    df = spark.createDataFrame([("p", BEARING, 0, "s", 0.9, json.dumps(ANSWER))], "product_id string, category string, src_ord int, source_id string, authority double, response string")
    got = {r["field"]: r for r in sanitize(df, field_table(spark)).collect()}
    assert set(got) == {"width", "brand"}
    assert (got["width"]["value"], got["width"]["confidence"], got["width"]["method"], got["width"]["line_start"], got["width"]["line_end"]) == ("42", 1.0, "llm_inference", 0, 0)
    assert (got["brand"]["confidence"], got["brand"]["unit"], got["brand"]["snippet"], got["brand"]["line_start"]) == (0.5, None, "", 4)


def test_model_extractor(spark):
    sources, _ = from_payloads(payload(spark, ("p", BEARING, [{"type": "pdf", "text": "any"}, {"type": "ocr", "text": "boom"}])))
    answer = json.dumps({"fields": [{"field": "width", "value": "15", "unit": "mm", "confidence": 0.9, "method": "table_parse", "line_start": 1, "line_end": 1}]})

    def call(prompt):
        if "boom" in prompt:
            raise RuntimeError("no answer")
        return answer

    result = run(sources, extractor=ModelExtractor(call, lambda category, source, text: text, field_table(spark)), mode="fake")
    assert [(r["field"], r["display"]) for r in result.fused.collect()] == [("width", "15")]
    row = result.catalog.first()
    assert (row["status"], row["error"]) == ("failed", "RuntimeError: no answer") and result.records.count() == 0


def test_prompt_and_schema():
    template = PromptTemplate("For readers only.\n<!-- VARIANT: system -->\nBe exact.\n<!-- /VARIANT -->\n<!-- VARIANT: pdf -->\nRead {{ source_text }} for {{other}}, {{ not closed.\n<!-- /VARIANT -->")
    assert template.render("pdf", {"source_text": "X {{y}}", "y": 1}) == "Be exact.\n\nRead X {{y}} for {{other}}, {{ not closed."
    with pytest.raises(ValueError):
        template.render("web", {})
    schema = answer_schema(["a", "b"])
    item = schema["properties"]["fields"]["items"]
    assert schema["required"] == ["fields"] and schema["additionalProperties"] is False and item["additionalProperties"] is False
    assert item["required"] == ["field", "value", "confidence", "method", "snippet", "line_start", "line_end"]
    assert item["properties"]["field"] == {"type": "string", "description": "One of: a, b"} and item["properties"]["unit"] == {"type": ["string", "null"]}
    assert item["properties"]["confidence"] == {"type": "number", "minimum": 0, "maximum": 1} and item["properties"]["method"]["enum"] == ["table_parse", "llm_inference", "ocr_heuristic"]
    assert item["properties"]["reasoning"] == {"type": "string"} and item["properties"]["line_end"] == {"type": "integer"}


def test_lines_and_pages(spark):
    rows = spark.createDataFrame([("a\r\n\n  b  \n c",)], "t string").select(F.explode(split_lines(F.col("t"))).alias("l")).select("l.*").collect()
    assert [(r["line"], r["text"]) for r in rows] == [(1, "a"), (3, "  b"), (5, "c")]
    html = "<h1>T &amp; U</h1><script>var p='<p>x</p>'</script><table><tr><th>A</th><td><b>1</b> mm</td><td></td></tr></table><ul><li>one<li>two</ul><p>open"
    assert page_text(html).split("\n")[:2] == ["T & U", "A  |  1 mm"]
    assert page_text("") == "" and "open" in page_text(html)


def test_catalog_isolates_failures(spark, tmp_path):
    (tmp_path / "a.txt").write_text("d [mm] 25\nD [mm] 52\n")
    (tmp_path / "m.json").write_text(json.dumps({"product_id": "good", "category": BEARING, "sources": [{"id": "s", "type": "pdf", "path": str(tmp_path / "a.txt")}]}))
    (tmp_path / "c.json").write_text(json.dumps({"products": [{"product_id": "good", "manifest": "m.json"}, {"product_id": "bad", "manifest": "nowhere.json"}]}))
    rows = run(sources_of(spark, read_catalog(str(tmp_path / "c.json"), str(tmp_path)))).catalog.orderBy("product_ord").collect()
    assert [(r["product_id"], r["status"]) for r in rows] == [("good", "ok"), ("bad", "failed")] and rows[1]["error"].startswith("FileNotFoundError")


def test_own_category(spark):
    own = Category.from_json(json.dumps({"category": BEARING, "category_label": "B", "fields": [{"name": "width", "label": "W", "type": "number", "unit": "mm"}]}))
    sources, _ = from_payloads(payload(spark, ("p", BEARING, [{"type": "pdf", "text": SHEET}])))
    assert [r["field"] for r in run(sources, [own]).fused.collect()] == ["width"]


def test_rule_table_is_whole(spark):
    assert rule_table(spark).count() == 108 and field_table(spark).count() == 50


def test_empty_input(spark):
    result = run(synthetic(spark, 0))
    assert result.catalog.count() == 0 and result.records.count() == 0
