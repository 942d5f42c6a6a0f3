"""Catalogs, product manifests, ad-hoc payloads and synthetic products as `sources`."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import plain_number, slug, strip
from ..registry import categories as registry
from ..registry.categories import Category
from .documents import DEFAULT_AUTHORITY, SOURCES, pdf_tables

# Authority and title of a source by its type
AUTHORITY = {"pdf": 0.95, "web": 0.85, "ocr": 0.70}
TYPE_LABELS = {"pdf": "PDF datasheet", "web": "Manufacturer / distributor web page", "ocr": "Product photo OCR"}


def resolve(path: str, *bases: str) -> str:
    """An absolute path as it is; else under the first base where it exists; else under the first."""
    if os.path.isabs(path) or "://" in path:
        return path
    return next((os.path.join(b, path) for b in bases if os.path.exists(os.path.join(b, path))), os.path.join(bases[0], path))


# What a catalog's product has where it names none
DEFAULT_SCHEMA, DEFAULT_OUTPUT = "schema/bearing_schema.json", "output/{}_product.json"


def read_catalog(path: str, root: str = ".") -> list[dict]:
    """A catalog document's products with their manifests read; what can't be read is an error there.

    A product's id defaults to its manifest's stem, its output and schema as stated
    above.  Products that fail keep the catalog's id, the others have their manifest's.
    Manifests named by a catalog are small control files, so the driver reads them; the
    documents that they name are read by Spark.  For manifests by the million see
    `sources_in`.
    """
    catalog = json.loads(Path(path).read_text(encoding="utf-8"))
    base, out = os.path.dirname(os.path.abspath(path)), []
    for p in catalog.get("products", []):
        manifest = resolve(p["manifest"], root, base)
        product = p.get("product_id") or Path(p["manifest"]).stem
        entry = {"product_id": product, "schema": resolve(p.get("schema") or DEFAULT_SCHEMA, root, base), "output": resolve(p.get("output") or DEFAULT_OUTPUT.format(product), root, base)}
        try:
            got = json.loads(Path(manifest).read_text(encoding="utf-8"))
            out.append({**entry, **got, "error": None})
        except (OSError, ValueError) as e:
            out.append({**entry, "category": None, "sources": [], "error": f"{type(e).__name__}: {e}"})
    return out


def with_outputs(catalog: DataFrame, entries: Iterable[dict]) -> DataFrame:
    """Catalog rows whose output is the one that read_catalog gave their product."""
    table = catalog.sparkSession.createDataFrame([(i, e["output"]) for i, e in enumerate(entries)], "product_ord bigint, named string")
    rows = catalog.join(F.broadcast(table), "product_ord", "left")  # a row per product of a catalog document
    return rows.select(*[F.coalesce("named", "output").alias("output") if c == "output" else c for c in catalog.columns])


def catalog_info(path: str) -> tuple[str, str]:
    """(catalog id, name) of a catalog document; the id defaults to the file's stem, the name to the id."""
    catalog = json.loads(Path(path).read_text(encoding="utf-8"))
    catalog_id = catalog.get("catalog_id") or Path(path).stem
    return catalog_id, catalog.get("name") or catalog_id


def categories_of(entries: Iterable[dict]) -> list[Category]:
    """The categories that catalog entries name by schema document; the built-in ones where they name none."""
    found = {c.name: c for c in registry.builtin()}
    for path in sorted({e["schema"] for e in entries if e.get("schema") and os.path.exists(e["schema"])}):
        own = Category.from_json(Path(path).read_text(encoding="utf-8"))
        found[own.name] = own
    return list(found.values())


def sources_of(spark: SparkSession, manifests: Iterable[dict], root: str = ".") -> DataFrame:
    """`sources` of product manifests; documents are read by Spark as whole texts.

    A document that isn't there gives a row with an error, and its product fails
    alone.  Rows of tables of binary PDF files become lines of text; where the library
    for that is missing, their product fails with an error that says what to do.
    Paths stay as the manifest states them.
    """
    rows = []
    for product_ord, m in enumerate(manifests):
        if m.get("error"):
            rows.append((m["product_id"], m.get("category"), product_ord, 0, None, None, None, None, None, None, m["error"], None))
        for i, s in enumerate(m.get("sources", [])):
            rows.append((m["product_id"], m["category"], product_ord, i, s["id"], s["type"], s.get("title", s["id"]), float(s.get("authority", DEFAULT_AUTHORITY)), s["path"], None, None, resolve(s["path"], root)))
    table = spark.createDataFrame(rows, T.StructType([*SOURCES.fields, T.StructField("found", T.StringType())]))
    return _read(table, sorted({r[11] for r in rows if r[11] and ("://" in r[11] or os.path.exists(r[11]))}))


MANIFEST = "product_id string, category string, sources array<struct<id:string,type:string,title:string,path:string,authority:double>>, _corrupt_record string"


def sources_in(spark: SparkSession, manifests: str, documents: str, root: str) -> DataFrame:
    """`sources` of all manifests under a path or pattern, with the documents under another; nothing passes through the driver.

    Relative paths are under root.  Products are ordered by their manifests' names.  A
    manifest that can't be parsed, and a document that isn't among those read, are
    errors of their product alone.
    """
    m = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(manifests).withColumn("file", F.input_file_name())
    m = m.withColumn("product_ord", F.xxhash64("file"))  # any order that is the same in every run
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    broken = F.when(F.col("_corrupt_record").isNotNull() | F.col("category").isNull(), F.concat(F.lit("ValueError: no manifest: "), "file"))
    rows = m.withColumn("broken", broken).select(F.coalesce("product_id", stem).alias("product_id"), "category", "product_ord", "broken", F.posexplode_outer("sources").alias("src_ord", "s"))
    path = F.col("s.path")
    rows = rows.select(
        "product_id", "category", "product_ord", F.coalesce("src_ord", F.lit(0)).alias("src_ord"), F.col("s.id").alias("source_id"), F.col("s.type").alias("source_type"), F.coalesce("s.title", "s.id").alias("title"),
        F.coalesce("s.authority", F.lit(DEFAULT_AUTHORITY)).alias("authority"), path.alias("path"), F.lit(None).cast("string").alias("raw_text"), F.col("broken").alias("error"),
        F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)).alias("found"),
    )
    return _read(rows, [documents])


def _read(table: DataFrame, paths: list[str]) -> DataFrame:
    """sources with the text of the document at `found`, or the error that keeps it from being read."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    missing = F.when(F.col("path").isNotNull(), F.concat(F.lit("FileNotFoundError: "), "path"))
    if not paths:
        return table.withColumn("error", F.coalesce("error", missing)).select(*SOURCES.names)
    spark = table.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(plain("path").alias("at"), "path", "content")
    pdf = F.lower("at").endswith(".pdf")
    texts = files.where(~pdf).select("at", F.make_valid_utf8(F.col("content").cast("string")).alias("body"), F.lit(None).cast("string").alias("failed"))
    cells = pdf_tables(files.where(pdf).select(F.col("at").alias("path"), "content")).groupBy(F.col("path").alias("at"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line_start", "text"))), lambda r: r["text"])  # a document's own rows
    texts = texts.unionByName(cells.agg(F.concat_ws("\n", lines).alias("body"), F.max("error").alias("failed")))
    read = table.join(texts, plain("found") == F.col("at"), "left")
    # A PDF without tables is read, and empty; what isn't among the files is missing.
    error = F.coalesce("error", "failed", F.when(F.col("at").isNull(), missing))
    return read.select(*[c for c in SOURCES.names if c not in ("raw_text", "error")], F.col("body").alias("raw_text"), error.alias("error"))


def from_payloads(payloads: DataFrame, of: Iterable[Category] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, rejected) of payloads(product_id, category, sources[id, type, title, text, authority]).

    Rejected payloads have a reason: no product id, unknown category, no text.
    Blank texts go; an id that came before gets its place in the list appended;
    plain text of a web source becomes paragraphs.
    """
    known = sorted(c.name for c in (of if of is not None else registry.builtin()))
    p = payloads.withColumn("product_id", strip(F.coalesce("product_id", F.lit("")))).withColumn("category", strip(F.coalesce("category", F.lit(""))))
    used = F.filter(F.coalesce("sources", F.array().cast(payloads.schema["sources"].dataType)), lambda s: strip(F.coalesce(s["text"], F.lit(""))) != "")
    p = p.withColumn("sources", used)
    reason = (
        F.when(F.col("product_id") == "", "product_id (SKU / product name) is required")
        .when(~F.col("category").isin(*known), F.concat(F.lit("unknown category '"), "category", F.lit(f"'; choose from {known}")))
        .when(F.size("sources") == 0, "at least one source snippet with text is required")
    )
    p = p.withColumn("reason", reason)
    rows = p.where("reason is null").withColumn("product_ord", F.monotonically_increasing_id()).select("product_id", "category", "product_ord", "sources", F.posexplode("sources").alias("src_ord", "s"))
    kind = F.coalesce("s.type", F.lit("pdf"))
    given = F.transform("sources", lambda x: F.coalesce(F.nullif(x["id"], F.lit("")), F.concat(F.lit("src_"), F.coalesce(x["type"], F.lit("pdf")))))
    own = F.element_at(given, F.col("src_ord") + 1)
    source_id = F.when(F.array_position(given, own) < F.col("src_ord") + 1, F.concat(own, F.lit("-"), (F.col("src_ord") + 1).cast("string"))).otherwise(own)
    text = strip(F.col("s.text"))
    lines = F.filter(F.transform(F.split(text, "\r\n|[\r\n]"), lambda x: strip(x)), lambda x: x != "")
    paragraphs = F.concat_ws("\n", F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))))
    by_type = lambda table, other: F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in table.items()], other)
    out = rows.select(
        "product_id", "category", "product_ord", "src_ord", source_id.alias("source_id"), kind.alias("source_type"),
        F.coalesce(F.nullif("s.title", F.lit("")), F.concat(by_type(TYPE_LABELS, kind), F.lit(" snippet"))).alias("title"),
        F.coalesce(F.nullif("s.authority", F.lit(0.0)), by_type(AUTHORITY, F.lit(DEFAULT_AUTHORITY))).alias("authority"),
        F.concat(slug(F.col("product_id")), F.lit("/"), slug(source_id), F.when(kind == "web", ".html").otherwise(".txt")).alias("path"),
        F.when((kind == "web") & ~text.contains("<"), paragraphs).otherwise(text).alias("raw_text"), F.lit(None).cast("string").alias("error"),
    )
    return out.select(*SOURCES.names), p.where("reason is not null").select("product_id", "category", "reason")


# Bearing series: designation, d, D, B in mm, C, C0 in kN, speed in r/min, mass in kg
SERIES = """
6200-2RS 10 30 9 5.07 2.36 36000 0.031
6201-2RS 12 32 10 7.02 3.10 32000 0.037
6202-2RS 15 35 11 7.80 3.75 28000 0.045
6203-2RS 17 40 12 9.95 4.75 24000 0.065
6204-2RS 20 47 14 12.7 6.55 19000 0.106
6205-2RS 25 52 15 14.0 7.80 15000 0.127
6206-2RS 30 62 16 20.3 11.2 13000 0.199
6207-2RS 35 72 17 27.0 15.3 11000 0.288
6208-2RS 40 80 18 32.5 19.0 9500 0.366
6209-2RS 45 85 19 35.1 21.6 8500 0.405
6210-2RS 50 90 20 37.1 23.2 7500 0.466
6211-2RS 55 100 21 46.5 29.0 6700 0.606
"""


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """`sources` of n bearing products, generated on the executors: datasheet, page and stamping.

    The series repeats; from its second turn on, ids carry the turn.
    """
    rows = [line.split() for line in SERIES.strip().splitlines()]
    series = spark.createDataFrame([(i, pn, int(d), int(big), int(b), float(c), float(c0), int(speed), float(mass)) for i, (pn, d, big, b, c, c0, speed, mass) in enumerate(rows)], "slot bigint, pn string, d int, big int, b int, c double, c0 double, speed int, mass double")
    p = spark.range(n).withColumn("slot", F.col("id") % len(rows)).withColumn("turn", F.expr(f"id div {len(rows)}")).join(F.broadcast(series), "slot")
    p = p.withColumn("product_id", F.when(F.col("turn") == 0, F.col("pn")).otherwise(F.concat("pn", F.lit("-"), (F.col("turn") + 1).cast("string"))))
    s = lambda c: F.col(c).cast("string")
    newton = lambda c: F.format_string("%.0f", F.col(c) * 1000)
    row = lambda a, b: F.concat(F.lit(f"<tr><td>{a}</td><td>"), b if not isinstance(b, str) else F.lit(b), F.lit("</td></tr>\n"))
    sheet = F.concat(
        F.lit("SKF "), "product_id", F.lit(" Deep groove ball bearing\nd [mm] "), s("d"), F.lit("\nD [mm] "), s("big"), F.lit("\nB [mm] "), s("b"), F.lit("\nBasic dynamic load rating C "), s("c"),
        F.lit(" kN\nBasic static load rating C0 "), s("c0"), F.lit(" kN\nLimiting speed "), s("speed"), F.lit(" r/min\nMass "), plain_number(F.col("mass")), F.lit(" kg\nSeal  Contact seal, RS1 on both sides\nInternal clearance  CN\n"),
    )
    page = F.concat(
        F.lit("<h1>"), "product_id", F.lit(" Ball Bearing</h1>\n<p>Bore: "), s("d"), F.lit(" mm, OD: "), s("big"), F.lit(" mm, Width: "), s("b"), F.lit(" mm.</p>\n<table>\n"),
        row("Dynamic load rating", F.concat(newton("c"), F.lit(" N"))), row("Static load rating", F.concat(newton("c0"), F.lit(" N"))), row("Max speed (grease)", F.concat(F.format_number("speed", 0), F.lit(" rpm"))),
        row("Operating temperature", "-20 °C to +120 °C"), row("Seal", "2RS (rubber contact)"), row("Internal clearance", "CN"), row("Made in", "Japan"), F.lit("</table>\n"),
    )
    stamp = F.concat(s("d"), F.lit("x"), s("big"), F.lit("x"), s("b"), F.lit("\n2RS\nJAPAN\nABEC 1\n"))
    one = lambda i, kind, title, text: F.struct(F.lit(i).alias("src_ord"), F.lit(f"src_{kind}").alias("source_id"), F.lit(kind).alias("source_type"), title.alias("title"), F.lit(AUTHORITY[kind]).alias("authority"), text.alias("raw_text"))
    three = F.array(
        one(0, "pdf", F.concat(F.lit("Datasheet "), "product_id", F.lit(" (rev 4, p.1)")), sheet),
        one(1, "web", F.concat(F.lit("Manufacturer product page - "), "product_id"), page),
        one(2, "ocr", F.lit("Product photo OCR (stamping on bearing face)"), stamp),
    )
    out = p.select("product_id", F.lit(registry.DEFAULT_CATEGORY).alias("category"), F.col("id").alias("product_ord"), F.explode(three).alias("s")).select("product_id", "category", "product_ord", "s.*")
    return out.withColumn("path", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).select(*SOURCES.names)
