"""Documents to blocks: the numbered lines that every later value cites.

`sources` is a DataFrame with one row per document: product_id, category, src_ord,
source_id, source_type (pdf, web, ocr), title, authority, path, raw_text.
`blocks` adds one row per citable line.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import reach_package

SOURCES = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("product_ord", T.LongType()),
        T.StructField("src_ord", T.IntegerType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("authority", T.DoubleType()),
        T.StructField("path", T.StringType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
DEFAULT_AUTHORITY = 0.8
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def split_lines(text: Column) -> Column:
    """Lines as array<struct<line, text>>: numbered from 1 over blank lines too, which go."""
    lines = F.split(text, LINE_BREAK)
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("line"), F.regexp_replace(x, r"(?U)\s+$", "").alias("text")))
    return F.filter(numbered, lambda x: x["text"] != "")


class _Rows(HTMLParser):
    """Readable rows of a page in document order.

    Each open element that yields a row (a heading, paragraph, item or table row)
    collects the text under it; nested ones collect it too.  A table row joins its
    cells' texts.  Unclosed elements end with their parent or the page.
    """

    TEXT, VOID = {"p", "h1", "h2", "h3", "h4", "li"}, {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
    SKIP, CELL = {"script", "style", "noscript", "svg"}, {"td", "th"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open: list[tuple[str, list | None]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        hold: list | None = None
        if not self._skipping():
            if tag in self.TEXT or tag == "tr":
                hold = []
                self.found.append([tag, hold])
            elif tag in self.CELL:
                hold = []
                for kind, rows in self.open:
                    if kind == "tr" and rows is not None:
                        rows.append(hold)
        self.open.append((tag, hold))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def _skipping(self) -> bool:
        return any(kind in self.SKIP for kind, _ in self.open)

    def handle_data(self, data: str) -> None:
        if data.strip() and not self._skipping():
            for kind, hold in self.open:
                if hold is not None and kind != "tr":
                    hold.append(data.strip())

    def text(self) -> str:
        rows = []
        for kind, parts in self.found:
            row = "  |  ".join(c for c in (" ".join(cell) for cell in parts) if c) if kind == "tr" else " ".join(parts)
            if row or kind == "tr":
                rows.append(row)
        return "\n".join(rows)


def page_text(html: str) -> str:
    """A page's rows, one per line."""
    parser = _Rows()
    parser.feed(html)
    parser.close()
    return parser.text()


@F.pandas_udf(T.StringType())
def html_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for page in pages:
        yield page.map(lambda x: None if x is None else page_text(x))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Text with its character references, named and numeric, as characters."""
    return text.map(lambda x: None if x is None else unescape(x))


def strip_tags(html: Column, references: Mapping[str, str] | None = None) -> Column:
    """Page text without a parser: every cell on a line of its own.

    Cheaper than html_text, but label and value of a table row come apart, so the
    extraction rules don't match such rows.  Every character reference becomes its
    character, as HTML reads them (some without their semicolon); with references only
    those, as they are written, one after the other.
    """
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?i)</(tr|td|th|p|div|li|h[1-6])>", "\n")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    x = unescaped(x) if references is None else reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), references.items(), x)
    return F.regexp_replace(x, "[ \t]+", " ")


def blocks(sources: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per citable line, by product in so many parts; only pages pass through Python workers."""
    reach_package(sources.sparkSession)
    keep = ["product_id", "category", "src_ord", "source_id", "source_type", "authority"]
    fine = sources.where("error is null and raw_text is not null")
    # In one pass, in which the parser is given nothing of other documents.
    web = F.col("source_type") == "web"
    read = fine.withColumn("raw_text", F.when(web, html_text(F.when(web, F.col("raw_text")))).otherwise(F.col("raw_text")))
    if parts is not None:
        read = read.select(*keep, "raw_text").repartition(parts, "product_id")
    lines = read.select(*keep, F.explode(split_lines(F.col("raw_text"))).alias("l"))
    text = F.col("l.text")
    return lines.select(*keep, F.col("l.line").alias("line_start"), F.col("l.line").alias("line_end"), text.alias("text"), F.lit("").alias("meta"))


def pdf_tables(files: DataFrame) -> DataFrame:
    """Blocks of binary PDF files (path, content): each table row is one block.

    Needs the optional library pdfplumber on the workers; without it each file
    gives one row whose error says to provide the extracted text instead, as does a file
    that can't be opened.
    """
    schema = "path string, line_start int, line_end int, text string, meta string, error string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            import pdfplumber
        except ImportError:
            pdfplumber = None
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if pdfplumber is None:
                    rows.append((path, None, None, None, None, "pdfplumber is not installed; provide the PDF as extracted text"))
                    continue
                try:
                    with pdfplumber.open(io.BytesIO(content)) as pdf:
                        tables = [(p, t, r, row) for p, page in enumerate(pdf.pages, 1) for t, table in enumerate(page.extract_tables() or [], 1) for r, row in enumerate(table, 1)]
                except Exception as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                said = [(p, t, r, [str(c).strip() for c in row if c is not None and str(c).strip()]) for p, t, r, row in tables]
                said = [x for x in said if x[3]]
                rows += [(path, n, n, "  |  ".join(cells), f"p{p}/t{t}/r{r}", None) for n, (p, t, r, cells) in enumerate(said, 1)]
            yield pd.DataFrame(rows, columns=["path", "line_start", "line_end", "text", "meta", "error"])

    return files.select("path", "content").mapInPandas(read, schema)


def line_numbered(block_rows: DataFrame) -> DataFrame:
    """(product_id, source_id, numbered): a source's lines with their numbers, for a model's prompt."""
    meta = F.when(F.col("meta") != "", F.concat("meta", F.lit(": "))).otherwise("")
    line = F.concat(F.format_string("%5d  ", "line_start"), meta, "text")
    rows = F.sort_array(F.collect_list(F.struct("line_start", line.alias("line"))))
    return block_rows.groupBy("product_id", "source_id").agg(F.concat_ws("\n", F.transform(rows, lambda x: x["line"])).alias("numbered"))
