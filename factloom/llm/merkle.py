"""Fixity audit of WARC files: Merkle trees over records and their offset ranges.

A file's records in offset order are the leaves; each inner node covers FANOUT
neighbours and hashes their hashes with the range of offsets they take.  File roots
go on, in file order, to one root.  Two replicas' trees are compared from the root
down: only children of nodes that differ are looked at, so the work below the first
level follows the corruption, not the archive.  Records below the last nodes that
differ are matched by their names, which tells damage from records that merely moved.

Only hashes, lengths and names are shuffled, never the records themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, col, ids_clash

FANOUT = 16
#: Records of a file: pages with ids from n * FILE_RECORDS on.
FILE_RECORDS = 512
#: FANOUT ** IN_FILE is at least the number of records of a file.
IN_FILE = 3

READ = T.StructType([T.StructField("path", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])


def warc_record(url: Column, body: Column, name: Column) -> Column:
    """A response record's text: its header block, the body, and the two line ends after it."""
    block = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:md5:"), F.md5(name.cast("binary")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, block, F.lit("\r\n\r\n"))


# -- WARC files --------------------------------------------------------------------


def _header(data: bytes, at: int) -> tuple[int, dict[str, str]] | None:
    """(where the header block at `at` ends, its named fields in lower case); None where there is none."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or data[at : at + 5] != b"WARC/":
        return None
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    return end + 4, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _plain(data: bytes) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(first, last, bytes, error) of each record of an uncompressed file."""
    at = 0
    while at < len(data):
        head = _header(data, at)
        length = head[1].get("content-length", "") if head else ""
        if not length.isdecimal():
            # What can't be read is one record up to the next that can.
            end = data.find(b"WARC/1", at + 1)
            end = len(data) if end < 0 else end
            yield at, end, data[at:end], "no record begins here"
        else:
            end = min(head[0] + int(length) + 4, len(data))
            yield at, end, data[at:end], None if end == head[0] + int(length) + 4 else "the file ends within the record"
        at = end


def _members(data: bytes) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(first, last, bytes, error) of each gzip member, by convention one a record; offsets are the file's."""
    at = 0
    while at < len(data):
        inflate = zlib.decompressobj(31)
        try:
            out, error = inflate.decompress(data[at:]), None
            end = len(data) - len(inflate.unused_data)
            if not inflate.eof:
                error = "the file ends within the member"
        except zlib.error as e:
            end = data.find(b"\x1f\x8b\x08", at + 1)
            end = len(data) if end < 0 else end
            out, error = data[at:end], f"zlib: {e}"
        yield at, end, out, error
        at = end


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, held = [], 0
            for seq, (first, last, data, error) in enumerate(_members(content) if content[:2] == b"\x1f\x8b" else _plain(content)):
                head = None if error else _header(data, 0)
                rows.append((path, seq, head[1].get("warc-record-id") if head else None, first, last, data, error))
                held += len(data)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], READ.names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], READ.names)


def read_warc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, seq, key, first, last, data, error): the records of WARC files, plain or one gzip member each.

    first and last are a record's offsets in its file, last excluded; key is its
    WARC-Record-ID.  What can't be read is a record with an error and without a key,
    up to where the next one begins.  A file is read whole by one task, and so may
    have 2 GB at most.  Empty files have no records.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content").where("length(content) > 0")
    return files.mapInArrow(_records, READ)


def numbered(*replicas: DataFrame) -> list[DataFrame]:
    """Records of read_warc with their file's number: files of the same name are one file in all replicas."""
    name = F.element_at(F.split("path", "/"), -1)
    names = None
    for r in replicas:
        own = r.select(name.alias("name")).distinct()
        names = own if names is None else names.union(own).distinct()
    # A row per file, not per record.
    names = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("file"))
    return [r.withColumn("name", name).join(names, "name").drop("name") for r in replicas]


# -- trees -----------------------------------------------------------------------


def leaves(records: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, seq, key, first, last, hash) of records(file, seq, key, data): a leaf per record.

    first and last are its range of offsets, last excluded: those of records where
    it has such columns, else those of records written one after the other.  seq
    orders a file's records; FANOUT ** IN_FILE or more of them widen the file's top
    node.  A file's offsets are summed within one task, from lengths alone.  Records
    without seq are numbered in the order of key and hash.  Records that have all
    these columns already are taken as they are.
    """
    have = set(records.columns)
    if "hash" in have:
        return scratch.keep(records.select("file", "seq", "key", "first", "last", "hash"), "leaves")
    digest = F.sha2(F.col("data").cast("binary"), 256)
    kept = [c for c in ("seq", "first", "last") if c in have]
    sized = records.select("file", "key", *kept, F.octet_length("data").cast("long").alias("bytes"), digest.alias("hash"))
    if "seq" not in have:
        order = Window.partitionBy("file").orderBy("key", "hash")
        sized = sized.withColumn("seq", F.row_number().over(order).cast("long") - 1)
    if "first" not in have:
        order = Window.partitionBy("file").orderBy("key", "hash") if "seq" not in have else Window.partitionBy("file").orderBy("seq")
        upto = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
        sized = sized.withColumn("last", upto).withColumn("first", F.col("last") - F.col("bytes"))
    return scratch.keep(sized.select("file", "seq", "key", "first", "last", "hash"), "leaves")


def tree(leaf: DataFrame, levels: int, scratch: Scratch) -> list[DataFrame]:
    """(file, node, first, last, hash) per level: the first is the leaves, the last the root.

    The lowest levels are kept as tables, so that no plan holds more than a few levels.
    """
    out = [leaf.select("file", F.col("seq").alias("node"), "first", "last", "hash")]
    for level in range(1, levels + 1):
        inside = level <= IN_FILE
        file = F.col("file") if inside else F.expr(f"file div {FANOUT}")
        node = F.expr(f"node div {FANOUT}") if inside else F.lit(0).cast("long")
        child = F.struct("file", "node", "hash", "first", "last")
        # FANOUT children at most
        now = out[-1].groupBy(file.alias("file"), node.alias("node")).agg(F.sort_array(F.collect_list(child)).alias("c"), F.min("first").alias("first"), F.max("last").alias("last"))
        said = F.concat_ws("|", F.transform("c", lambda c: F.concat_ws(":", c["first"].cast("string"), c["last"].cast("string"), c["hash"])))
        out.append(scratch.keep(now.select("file", "node", "first", "last", F.sha2(said.cast("binary"), 256).alias("hash")), f"level{level}"))
    return out


def levels_for(files: int) -> int:
    """Levels above the leaves, so that one root covers file numbers below `files`."""
    over, reach = 0, 1
    while reach < files:
        over, reach = over + 1, reach * FANOUT
    return IN_FILE + over


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that differ between replicas, both as records(file, seq, key, data) or as `leaves` takes them.

    (file, seq, key, first, last, state): in files where the replicas differ, records
    of one key (the n-th of it in its file) are matched: `corrupt` where their hashes
    differ, `moved` where only their offsets do; `missing` ones b lacks, `extra` ones
    a lacks.  The place and range are a's, or b's for extra ones.  Null data counts as
    empty, null keys are matched in turn.  Empty replicas agree.
    """
    scratch = Scratch(a.sparkSession, "merkle")
    one, two = (leaves(x.withColumn("data", F.coalesce(F.col("data").cast("binary"), F.lit("").cast("binary"))), scratch) for x in (a, b))
    return _descend(one, two, scratch)


def _descend(one: DataFrame, two: DataFrame, scratch: Scratch) -> DataFrame:
    most = max(x.agg(F.max("file")).first()[0] or 0 for x in (one, two))
    levels = levels_for(most + 1)
    trees = [tree(x, levels, scratch) for x in (one, two)]
    suspect: DataFrame | None = None
    for level in range(levels, 0, -1):
        x, y = (t[level] for t in trees)
        if suspect is not None:
            x, y = (_below(s, suspect, level) for s in (x, y))
        right = y.select("file", "node", F.col("hash").alias("hash_b"))
        differs = ~F.col("hash").eqNullSafe(F.col("hash_b"))  # a node's range is in its parent's hash, its children's in its own
        # Both sides of the next level read it: written once, it is small where little differs.
        suspect = scratch.keep(x.join(right, ["file", "node"], "full").where(differs).select("file", "node"), f"suspect{level}")
    nth = F.row_number().over(Window.partitionBy("file", "key").orderBy("seq"))
    x, y = (_below(leaf.withColumn("node", F.col("seq")), suspect, 0).drop("node").withColumn("nth", nth) for leaf in (one, two))
    x, y = (s.select(*[F.col(c).alias(f"{c}_{k}") for c in s.columns]) for s, k in ((x, "a"), (y, "b")))
    same = (F.col("file_a") == F.col("file_b")) & (F.col("nth_a") == F.col("nth_b")) & F.col("key_a").eqNullSafe(F.col("key_b"))
    both = x.join(y, same, "full")
    moved = (F.col("first_a") != F.col("first_b")) | (F.col("last_a") != F.col("last_b"))
    state = F.when(F.col("hash_a").isNull(), "extra").when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a") != F.col("hash_b"), "corrupt").when(moved, "moved")
    of = lambda c: F.when(F.col("hash_a").isNull(), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(c)
    found = both.withColumn("state", state).where("state is not null")
    return found.select(of("file"), of("seq"), of("key"), of("first"), of("last"), F.coalesce("hash_a", "hash_b").alias("hash"), "state")


def _below(level_rows: DataFrame, suspect: DataFrame, level: int) -> DataFrame:
    """Rows of a level whose parent is suspect."""
    file = F.col("file") if level < IN_FILE else F.expr(f"file div {FANOUT}")
    node = F.expr(f"node div {FANOUT}") if level < IN_FILE else F.lit(0).cast("long")
    up = suspect.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
    return level_rows.join(up, (file == F.col("up_file")) & (node == F.col("up_node")), "left_semi")


# -- pages as an archive ------------------------------------------------------------


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """records(file, key, data) of pages; those of FILE_RECORDS neighbouring ids share a file.

    Where an id is null or repeats, files are filled in the order of the rows as read
    instead, so that none grows with an id.  Null urls and bodies are empty.
    """
    key = col(id_col).cast("long")
    data = warc_record(col(url_col).cast("string"), col(body_col).cast("string"), F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(col(url_col).cast("string"), F.lit(""))))
    place = F.monotonically_increasing_id() if ids_clash(pages, id_col) else key
    return pages.select(key.alias("key"), F.floor(place / FILE_RECORDS).cast("long").alias("file"), data.alias("data"))


#: What the query's replica has wrong, by page id modulo the first and what it leaves: pages whose body has
#: a letter changed, pages whose record is zeroed out, pages whose record is lost, pages that have a second one.
FLIPPED, ZEROED, LOST, DOUBLED = (101, 7), (997, 5), (2011, 17), (3001, 23)


def op9(pages: DataFrame) -> DataFrame:
    """Every page's record in its file, and what the audit finds of it in the replica; then the replica's extra records.

    The replica is made from the same pages: FLIPPED ones have the body's first `e`
    turned into `3`, the records of ZEROED ones are all zeros, those of LOST ones are
    left out, and DOUBLED ones have a record with an empty body after their own.
    What follows a record that was lost or added in a file has moved.
    """
    scratch = Scratch(pages.sparkSession, "merkle")
    pages = pages.select("page_id", "url", "html")
    hit = lambda c, rule: F.coalesce(F.col(c).cast("long") % rule[0] == rule[1], F.lit(False))
    head = F.substring_index("html", "e", 1)
    hurt = F.when(hit("page_id", FLIPPED) & F.col("html").contains("e"), F.concat(head, F.lit("3"), F.expr("substring(html, length(substring_index(html, 'e', 1)) + 2)"))).otherwise(F.col("html"))
    copy = archive(pages.withColumn("html", hurt))
    copy = copy.where(~hit("key", LOST)).withColumn("data", F.when(hit("key", ZEROED), F.repeat(F.lit("0"), F.octet_length("data"))).otherwise(F.col("data")))
    added = F.when(hit("key", DOUBLED), F.array(F.col("data"), F.lit("WARC/1.1\r\n\r\n"))).otherwise(F.array("data"))
    # The second record of a page comes after its own, whatever their hashes.
    copy = copy.select("file", "key", F.posexplode(added).alias("turn", "data"))
    one, two = leaves(archive(pages), scratch), leaves(_in_turn(copy), scratch)
    found = scratch.keep(_descend(one, two, scratch), "found")
    same = [F.col(f"one.{c}") == F.col(f"found.{c}") for c in ("file", "seq")]
    intact = one.alias("one").join(found.where("state <> 'extra'").alias("found"), same[0] & same[1], "left").select("one.*", F.coalesce("found.state", F.lit("intact")).alias("state"))
    every = intact.unionByName(found.where("state = 'extra'"))
    return every.select(F.col("key").alias("page_id"), "file", "seq", F.col("first").alias("first_byte"), F.col("last").alias("last_byte"), F.col("hash").alias("sha256"), "state")


def _in_turn(records: DataFrame) -> DataFrame:
    """records(file, key, turn, data) numbered by key, turn and hash; lengths and hashes alone would be shuffled later, so these come first."""
    order = Window.partitionBy("file").orderBy("key", "turn", "hash")
    sized = records.select("file", "key", "turn", F.octet_length("data").cast("long").alias("bytes"), F.sha2(F.col("data").cast("binary"), 256).alias("hash"))
    upto = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sized.select("file", "key", (F.row_number().over(order) - 1).cast("long").alias("seq"), (upto - F.col("bytes")).alias("first"), upto.alias("last"), "hash")


OP9_SQL = f"""WITH r AS (SELECT page_id, page_id // {FILE_RECORDS} AS file, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:md5:' || md5(page_id || '|' || coalesce(url, '')) || '>' || chr(13) || chr(10)
 || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head, chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM pages),
a0 AS (SELECT page_id, file, 0 AS turn, head || coalesce(html, '') || tail AS data FROM r),
b0 AS (SELECT page_id, file, 0 AS turn, CASE WHEN page_id % {ZEROED[0]} = {ZEROED[1]} THEN repeat('0', strlen(head || coalesce(html, '') || tail)) WHEN page_id % {FLIPPED[0]} = {FLIPPED[1]} THEN head || regexp_replace(coalesce(html, ''), 'e', '3') || tail ELSE head || coalesce(html, '') || tail END AS data FROM r WHERE page_id % {LOST[0]} <> {LOST[1]}
 UNION ALL SELECT page_id, file, 1, 'WARC/1.1' || chr(13) || chr(10) || chr(13) || chr(10) FROM r WHERE page_id % {DOUBLED[0]} = {DOUBLED[1]}),
a AS (SELECT page_id, file, turn, sha256(data) AS sha, strlen(data) AS n, row_number() OVER w - 1 AS seq, (sum(strlen(data)) OVER w)::BIGINT AS upto FROM a0 WINDOW w AS (PARTITION BY file ORDER BY page_id, turn)),
b AS (SELECT page_id, file, turn, sha256(data) AS sha, strlen(data) AS n, row_number() OVER w - 1 AS seq, (sum(strlen(data)) OVER w)::BIGINT AS upto FROM b0 WINDOW w AS (PARTITION BY file ORDER BY page_id, turn))
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.file, b.file) AS file, coalesce(a.seq, b.seq) AS seq, coalesce(a.upto - a.n, b.upto - b.n) AS first_byte, coalesce(a.upto, b.upto) AS last_byte, coalesce(a.sha, b.sha) AS sha256,
CASE WHEN a.sha IS NULL THEN 'extra' WHEN b.sha IS NULL THEN 'missing' WHEN a.sha <> b.sha THEN 'corrupt' WHEN a.upto <> b.upto OR a.n <> b.n THEN 'moved' ELSE 'intact' END AS state FROM a FULL JOIN b ON a.page_id = b.page_id AND a.turn = b.turn"""
