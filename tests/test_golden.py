"""Four products of known outcome through the whole plan, from documents on disk to records."""

import json

import pytest

from factloom.operators.catalog import catalog_totals
from factloom.operators.record import record_json
from factloom.plans.fusion import run
from factloom.sources.manifests import categories_of, read_catalog, sources_in, sources_of, with_outputs
from factloom.sources.sinks import catalog_report, product_reports


def page(heading, text, *rows):
    cells = "".join(f"  <tr><td>{a}</td><td>{b}</td></tr>\n" for a, b in rows)
    return f"<!DOCTYPE html>\n<html><head><title>{heading}</title></head>\n<body>\n<h1>{heading}</h1>\n<p>{text}</p>\n<table>\n{cells}</table>\n</body></html>\n"


# What the sources say
BEARING_SHEET = """SKF 6205-2RSH Deep groove ball bearing
Single row, contact seals on both sides, snap ring groove

d [mm] 25
D [mm] 52
B [mm] 15

Basic dynamic load rating C 14.0 kN
Basic static load rating C0 7.8 kN

Limiting speed 13000 r/min
Reference speed 18000 r/min
Mass 0.127 kg

Seal  Contact seal, RS1 on both sides
Internal clearance  CN
Cage  Sheet metal, steel, riveted
"""
BEARING_PAGE = page(
    "6205-2RS Ball Bearing", "Sealed deep groove ball bearing for electric motors and gearboxes.\nBore: 25 mm, OD: 52 mm, Width: 15 mm.",
    ("Dynamic load rating", "14000 N"), ("Static load rating", "7 800 N"), ("Max speed (grease)", "12 000 rpm"), ("Operating temperature", "-20 °C to +120 °C"), ("Seal", "2RS (rubber contact)"), ("Internal clearance", "CN"), ("Made in", "Japan"),
).replace("</body>", "<div><p>In stock.</p></div></body>")
VALVE_SHEET = "Part no.   V2000-BS\nBrand   AcmeFlow\nType   Two-way ball valve, full bore\nDN [mm]   25\nPressure rating   40 bar\nBody material   brass\nSeat material   PTFE\nActuation   manual\nOperating temperature   -10 °C to 80 °C\nWeight   0.9 kg\n"
VALVE_PAGE = page("V2000-BS Two-Way Ball Valve", "A valve for water and air service.", ("Connection", "DN 25 mm"), ("Pressure rating", "PN 40 bar"), ("Body material", "brass"), ("Actuation", "manual lever"), ("Operating temperature", "-10 °C to 80 °C"), ("Weight", "0.9 kg"))
MOTOR_SHEET = "Part no.  ME-132S-4\nBrand  VoltTech\nType  Three-phase induction motor, IEC frame 132S\nOutput power  7.5 kW\nRated voltage  400 V\nRated current  15.2 A\nRated speed  1450 r/min\nFrequency  50 Hz\nEfficiency  90.5 %\nFrame size  132S\nProtection  IP55\nInsulation class  F\nMounting  B3\nMass  62 kg\n"
MOTOR_PAGE = page("ME-132S-4 Induction Motor", "A motor for pumps and fans.", ("Output power", "7.5 kW"), ("Voltage", "400 V"), ("Rated current", "15.2 A"), ("Rated speed", "1450 rpm"), ("Efficiency", "90.5%"), ("Frame size", "132S"), ("Protection", "IP55"), ("Insulation", "Class F"), ("Mounting", "B3"), ("Weight", "62 kg"))
GEAR_SHEET = "Part no.  GRX-225-M\nBrand  HelmDrive\nType  Helical gear reducer, single stage\nRatio  25 : 1\nInput speed  1450 r/min\nOutput speed  58 r/min\nRated torque  450 N·m\nService factor  1.4\nEfficiency  94 %\nMounting  B3\nProtection  IP55\nLubrication  oil\nMass  62 kg\n"
GEAR_PAGE = page("GRX-225-M Gear Reducer", "A reducer for conveyor drives.", ("Ratio", "25 : 1"), ("Input speed", "1450 rpm"), ("Output speed", "60 rpm"), ("Rated torque", "332 ft-lb"), ("Service factor", "1.4"), ("Efficiency", "94%"), ("Mounting", "B3"), ("Protection", "IP55"), ("Lubrication", "oil"), ("Weight", "62 kg"))

PRODUCTS = {
    "6205-2RS": ("deep_groove_ball_bearing", [("src_pdf", "pdf", "Datasheet 6205-2RSH (rev 4, p.1)", 0.95, "sheet.pdf.txt", BEARING_SHEET), ("src_web", "web", "Manufacturer product page - 6205-2RS", 0.85, "page.html", BEARING_PAGE), ("src_ocr", "ocr", "Product photo OCR (stamping on bearing face)", 0.7, "photo.txt", "6205\n2RS\n25x52x15\nJAPAN\nABEC 1\n")]),
    "V2000-BS": ("2_way_ball_valve", [("src_datasheet", "pdf", "Datasheet V2000-BS (rev 2, p.1)", 0.95, "sheet.txt", VALVE_SHEET), ("src_web", "web", "Manufacturer product page - V2000-BS", 0.85, "page.html", VALVE_PAGE)]),
    "ME-132S-4": ("electric_motor", [("src_pdf", "pdf", "Datasheet ME-132S-4 (IEC 60034, p.1)", 0.95, "sheet.txt", MOTOR_SHEET), ("src_web", "web", "Manufacturer product page - ME-132S-4", 0.85, "page.html", MOTOR_PAGE), ("src_ocr", "ocr", "Nameplate photo OCR (stamping on terminal box)", 0.7, "photo.txt", "ME-132S-4\n7.5 kW\n400 V\n1450 r/min\nIP55\nF\nB3\n")]),
    "GRX-225-M": ("helical_gear_reducer", [("src_pdf", "pdf", "Datasheet GRX-225-M (rev 2, p.1)", 0.95, "sheet.txt", GEAR_SHEET), ("src_web", "web", "Distributor product page - GRX-225-M", 0.85, "page.html", GEAR_PAGE), ("src_ocr", "ocr", "Nameplate photo OCR (stamping on gear case)", 0.7, "photo.txt", "GRX-225-M\n25 : 1\n450 N·m\nIP55\n62 kg\n")]),
}

# Each field's value, confidence and the lines that its sources cite; verified by several sources where not said otherwise
FIELDS = {
    "6205-2RS": [
        ("part_number", "6205-2RSH", 0.98, "1,1"), ("brand", "SKF", 0.857, "1"), ("bore_diameter", 25, 0.98, "4,3,3"), ("outer_diameter", 52, 0.98, "5,3,3"), ("width", 15, 0.98, "6,3,3"), ("dynamic_load_rating", 14, 0.98, "8,4"), ("static_load_rating", 7.8, 0.98, "9,5"),
        ("max_speed", None, 0.4, "11,6"), ("weight", 0.127, 0.857, "13"), ("seal_type", "2RS", 0.98, "15,8,2"), ("clearance", "CN", 0.98, "16,9"), ("temperature_range_min", -20, 0.767, "7"), ("temperature_range_max", 120, 0.767, "7"), ("country_of_origin", "Japan", 0.887, "10,4"), ("precision_grade", "ABEC 1", 0.366, "5"),
    ],
    "V2000-BS": [("part_number", "V2000-BS", 0.98, "1,1"), ("brand", "AcmeFlow", 0.857, "2"), ("connection_size", 25, 0.98, "4,3"), ("pressure_rating", 40, 0.98, "5,4"), ("body_material", "brass", 0.98, "6,5"), ("actuation", "manual", 0.98, "8,6"), ("temperature_range_min", -10, 0.98, "9,7"), ("temperature_range_max", 80, 0.98, "9,7"), ("weight", 0.9, 0.98, "10,8")],
    "ME-132S-4": [
        ("part_number", "ME-132S-4", 0.98, "1,1,1"), ("brand", "VoltTech", 0.857, "2"), ("power_kw", 7.5, 0.98, "4,3,2"), ("rated_voltage", 400, 0.98, "5,4,3"), ("rated_current", 15.2, 0.98, "6,5"), ("rated_speed", 1450, 0.98, "7,6,4"), ("efficiency", 90.5, 0.98, "9,7"),
        ("frequency", 50, 0.857, "8"), ("frame_size", "132S", 0.98, "10,8"), ("protection_class", "IP55", 0.98, "11,9,5"), ("insulation_class", "F", 0.98, "12,10,6"), ("mounting", "B3", 0.98, "13,11,7"), ("weight", 62, 0.98, "14,12"),
    ],
    "GRX-225-M": [
        ("part_number", "GRX-225-M", 0.98, "1,1,1"), ("brand", "HelmDrive", 0.857, "2"), ("ratio", 25, 0.98, "4,3,2"), ("input_speed", 1450, 0.98, "5,4"), ("output_speed", None, 0.4, "6,5"), ("rated_torque", 450, 0.98, "7,6,3"), ("service_factor", 1.4, 0.98, "8,7"),
        ("efficiency", 94, 0.98, "9,8"), ("mounting", "B3", 0.98, "10,9"), ("protection_class", "IP55", 0.98, "11,10,4"), ("lubrication", "oil", 0.98, "12,11"), ("weight", 62, 0.98, "13,12,5"),
    ],
}
# Verified, needs_review, conflicts, rules_run, extracted; what is omitted; lines and values per source
SUMMARY = {
    "6205-2RS": ((13, 2, 1, 12, 15), ["material"], [(13, 11), (11, 12), (5, 6)]),
    "V2000-BS": ((9, 0, 0, 10, 9), [], [(10, 9), (8, 8)]),
    "ME-132S-4": ((13, 0, 0, 15, 13), [], [(14, 13), (12, 11), (7, 7)]),
    "GRX-225-M": ((11, 1, 1, 11, 12), [], [(13, 12), (12, 11), (5, 5)]),
}
QUEUE = {
    "6205-2RS": [("max_speed", "Sources disagree on Max speed: src_pdf=13000 rpm; src_web=12000 rpm"), ("precision_grade", "Only 1 source(s), effective confidence 0.37 < 0.75 threshold")],
    "GRX-225-M": [("output_speed", "Sources disagree on Output speed: src_pdf=58 rpm; src_web=60 rpm")],
}
COPY = {
    "6205-2RS": "The 6205-2RSH is a sealed deep groove ball bearing with a 25 mm bore, 52 mm outer diameter and 15 mm width. It is rated for a dynamic load of 14 kN and a static load of 7.8 kN. Operating temperature range is -20 °C to 120 °C. The unit weighs 0.127 kg.",
    "V2000-BS": "The V2000-BS is a brass manual two-way ball valve with a 25 mm connection, rated to 40 bar. Operating temperature range is -10 °C to 80 °C. The unit weighs 0.9 kg.",
    "ME-132S-4": "The ME-132S-4 is an F-class, IP55 three-phase induction motor rated 7.5 kW at 1450 rpm. It runs on 400 V at 50 Hz, drawing 15.2 A at 90.5% efficiency. The unit weighs 62 kg.",
    "GRX-225-M": "",
}
REVIEWS = {
    "6205-2RS": "Reviewed 2 field(s): 1 conflict(s), 1 low-confidence, 0 validation. None can auto-publish until resolved.",
    "GRX-225-M": "Reviewed 1 field(s): 1 conflict(s), 0 low-confidence, 0 validation. None can auto-publish until resolved.",
}
CLEAR = "No fields were routed to review - every extracted field was verified."
CHECK = "Check the highest-authority source (Datasheet 6205-2RSH (rev 4, p.1) (authority 0.95), Manufacturer product page - 6205-2RS (authority 0.85)) for a typo or a different operating condition, then record the single correct value."


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("catalog")
    listed = []
    for product, (category, sources) in PRODUCTS.items():
        (root / "data" / product).mkdir(parents=True)
        for *_, name, text in sources:
            (root / "data" / product / name).write_text(text, encoding="utf-8")
        manifest = {"product_id": product, "category": category, "sources": [{"id": i, "type": kind, "title": title, "path": f"data/{product}/{name}", "authority": authority} for i, kind, title, authority, name, _ in sources]}
        (root / "data" / product / "sources.json").write_text(json.dumps(manifest), encoding="utf-8")
        listed.append({"product_id": product, "manifest": f"data/{product}/sources.json", "output": f"output/{product}.json"})
    (root / "catalog.json").write_text(json.dumps({"catalog_id": "demo", "products": listed}))
    return root


@pytest.fixture(scope="module")
def result(spark, folder):
    entries = read_catalog(str(folder / "catalog.json"), str(folder))
    return run(sources_of(spark, entries, str(folder)), categories_of(entries))


@pytest.fixture(scope="module")
def records(result):
    return {r["product_id"]: json.loads(r["json"]) for r in record_json(result.records).collect()}


@pytest.mark.parametrize("product", PRODUCTS)
def test_record(records, product):
    r = records[product]
    got = [(f["field"], f["value"], f["confidence"], ",".join(str(s["line_start"]) for s in f["sources"])) for f in r["fields"]]
    assert got == FIELDS[product]
    for f in r["fields"]:
        several = len(f["sources"]) > 1
        if f["value"] is None:
            assert (f["status"], f["flags"], len(f["conflicts"])) == ("needs_review", ["conflict"], 1)
        elif f["field"] == "precision_grade":
            assert (f["status"], f["flags"]) == ("needs_review", ["single_source", "low_confidence"])
        else:
            assert (f["status"], f["flags"], f["conflicts"]) == ("verified", ["multi_source" if several else "single_source"], [])
        assert f["dropped"] == [] and f["validation_issues"] == []
        assert all(s["reasoning"] == f"Pattern matched on line {s['line_start']}: {s['snippet'].strip()}" for s in f["sources"])
    counts, omitted, sources = SUMMARY[product]
    assert tuple(r["summary"][k] for k in ("verified", "needs_review", "conflicts", "rules_run", "extracted")) == counts and r["summary"]["omitted_not_found"] == omitted
    assert [(s["lines"], s["fields_extracted"]) for s in r["sources"]] == sources
    # Paths are as the manifest states them.
    assert [(s["id"], s["title"], s["path"]) for s in r["sources"]] == [(i, title, f"data/{product}/{name}") for i, _, title, _, name, _ in PRODUCTS[product][1]]
    assert [(q["field"], q["reason"]) for q in r["needs_review_queue"]] == QUEUE.get(product, [])
    assert r["marketing"]["description"] == COPY[product] and r["validation"]["passed"] is True and r["validation"]["issues"] == []
    assert r["ai_review"]["summary"] == REVIEWS.get(product, CLEAR) and r["ai_review"]["all_clear"] is (product not in QUEUE)
    assert r["pipeline"]["mode"] == "mock" and r["pipeline"]["provider_note"] == "deterministic mock (offline)"


def test_reviews_of_the_bearing(records):
    r = records["6205-2RS"]
    assert r["marketing"]["sentences_skipped"] == ["sentence using max_speed skipped (needs_review/missing/conflict)"]
    assert [x["suggested_action"] for x in r["ai_review"]["reviews"]] == [CHECK, "Confirm Precision grade from an additional independent source to raise confidence above 0.75."]
    torque = {f["field"]: f for f in records["GRX-225-M"]["fields"]}["rated_torque"]
    assert [(s["value"], s["unit"]) for s in torque["sources"]] == [("450", "N·m"), ("332", "ft-lb"), ("450", "Nm")]


def test_reports(result):
    text = {r["product_id"]: r["report"].split("\n") for r in product_reports(result.records).collect()}
    bearing = text["6205-2RS"]
    assert bearing[:2] == ["6205-2RS  Deep groove ball bearing  (mock)", "13 verified, 2 to review, 1 conflicts; 12 rules run, passed: true; not found: material"]
    assert "Max speed                  13000 rpm / 12000 rpm  0.40  NEEDS_REVIEW" in bearing and "Weight                     0.127 kg            0.86  VERIFIED" in bearing
    assert "  - [conflict] Max speed: " + QUEUE["6205-2RS"][0][1] in bearing and bearing[-1] == "Review: " + REVIEWS["6205-2RS"]
    assert "To review:" not in text["V2000-BS"] and "Description: " + COPY["V2000-BS"] in text["V2000-BS"]
    lines = [r["line"] for r in catalog_report(result.catalog).orderBy("product_ord").collect()]
    assert lines[0] == "6205-2RS      Deep groove ball bearing      13    2    1  ok" and len(lines) == 4


def test_catalog(result, folder):
    t = catalog_totals(result.catalog).first()
    assert (t["products"], t["ok"], t["failed"], t["verified"], t["needs_review"], t["conflicts"], t["rules_run"]) == (4, 4, 0, 46, 3, 2, 48)
    entries = read_catalog(str(folder / "catalog.json"), str(folder))
    rows = with_outputs(result.catalog, entries).orderBy("product_ord").collect()
    assert [(r["product_id"], r["output"].removeprefix(str(folder))) for r in rows] == [(p, f"/output/{p}.json") for p in PRODUCTS]


def test_manifests_read_by_spark(spark, folder, records):
    """The same records from manifests and documents under patterns; broken ones fail alone."""
    (folder / "data" / "broken").mkdir(exist_ok=True)
    (folder / "data" / "broken" / "sources.json").write_text('{"product_id": "b", "category": ')
    (folder / "data" / "lacking").mkdir(exist_ok=True)
    (folder / "data" / "lacking" / "sources.json").write_text(json.dumps({"product_id": "l", "category": "electric_motor", "sources": [{"id": "s", "type": "pdf", "path": "data/lacking/none.txt"}]}))
    (folder / "data" / "scanned").mkdir(exist_ok=True)
    (folder / "data" / "scanned" / "x.pdf").write_bytes(b"%PDF-1.4 not one")
    (folder / "data" / "scanned" / "sources.json").write_text(json.dumps({"product_id": "s", "category": "electric_motor", "sources": [{"id": "s", "type": "pdf", "path": "data/scanned/x.pdf"}]}))
    got = run(sources_in(spark, f"file://{folder}/data/*/sources.json", f"file://{folder}/data", str(folder)))
    assert {r["product_id"]: json.loads(r["json"]) for r in record_json(got.records).collect()} == records
    failed = {r["product_id"]: r["error"] for r in got.catalog.where("status = 'failed'").collect()}
    assert len(failed) == 3 and failed["l"] == "FileNotFoundError: data/lacking/none.txt" and any(e.startswith("ValueError: no manifest: ") for e in failed.values())
    # Binary files go to the reader of their tables, not to the decoder of text.
    assert "pdfplumber is not installed" in failed["s"] or "Error" in failed["s"]


def test_catalog_defaults(folder):
    (folder / "bare.json").write_text(json.dumps({"products": [{"manifest": "nowhere/alone.json"}, {"manifest": "data/V2000-BS/sources.json"}]}))
    lost, found = read_catalog(str(folder / "bare.json"), str(folder))
    assert lost["product_id"] == "alone" and lost["error"].startswith("FileNotFoundError") and lost["output"].endswith("output/alone_product.json") and lost["schema"].endswith("schema/bearing_schema.json")
    assert found["product_id"] == "V2000-BS" and found["output"].endswith("output/sources_product.json")
