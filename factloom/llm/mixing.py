"""Mixing sources to target weights, with DataFrame functions only.

A source's rate is its target over its size.  Each document is taken floor(rate)
times, and once more if a hash of its id, read as a number in [0, 1), is below the
rate's fraction: no state, so reruns and lost executors give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, Scratch, col, fresh, ids_clash

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3.0
SEED = 20_240_501
#: Rows of the per-source table up to which it is broadcast (some 40 bytes each).
BROADCAST_SOURCES = 50_000
#: Beyond that, rows of one source are spread over this many join keys.
SALTS = 64


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null and for white space only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """rows with the sum of each expression up to and with the row, in an order without ties, and over all rows.

    Few rows are one window's.  Beyond that, ranges of the order are summed on their own,
    and each is raised by the totals of those before it: one row per range then is.
    """
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    every = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if rows.count() <= BROADCAST_SOURCES:
        whole = Window.orderBy(*order)
        return rows.select("*", *[F.sum(e).over(upto(whole)).alias(f"{k}_upto") for k, e in sums.items()], *[F.sum(e).over(every(whole)).alias(f"{k}_all") for k, e in sums.items()])
    ranged = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = scratch.keep(ranged.select("*", *[e.alias(f"{k}_one") for k, e in sums.items()]), "ranged")
    totals = ranged.groupBy("range").agg(*[F.sum(f"{k}_one").alias(k) for k in sums])
    by_range = Window.orderBy("range")
    before = totals.select("range", *[(F.sum(k).over(upto(by_range)) - F.col(k)).alias(f"{k}_before") for k in sums], *[F.sum(k).over(every(by_range)).alias(f"{k}_all") for k in sums])
    own = Window.partitionBy("range").orderBy(*order)
    inside = ranged.select("*", *[F.sum(f"{k}_one").over(upto(own)).alias(f"{k}_own") for k in sums])
    joined = inside.join(F.broadcast(before), "range")  # a row per range, of which there are as many as shuffle partitions
    return joined.select(*rows.columns, *[(F.col(f"{k}_own") + F.col(f"{k}_before")).alias(f"{k}_upto") for k in sums], *[f"{k}_all" for k in sums])


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) of sized(source, size), one row per source.

    The targets that stop at `most` times the size and share the rest by weight
    are least(most * size, level * weight).  With sources in order of
    most * size / weight, those below the level come first, so a running sum gives
    the level directly; nothing is iterated, and documents are summed before any order.
    """
    scratch, n = Scratch(sized.sparkSession, "targets"), len(weights)
    per = scratch.keep(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sizes")
    by_name = [F.col("source").isNull(), F.col("source")]
    per = _running(per, by_name, {"rank": F.lit(1).cast("long")}, scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank_upto") - 1) % n + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    per = scratch.keep(per, "weights")
    # Sizes are whole numbers: their sums are exact, and so are those of whole caps.
    sums = {"cap": F.col("cap"), "weight": F.col("weight"), "size": F.col("source_size")}
    per = _running(per, [F.col("cap") / F.col("weight"), *by_name], sums, scratch)
    # The level if exactly the sources before this one stop at their caps; it is
    # the true one for the first source that this level doesn't take over its cap.
    rest = F.col("weight_all") - (F.col("weight_upto") - F.col("weight"))
    level = (F.col("size_all").cast("double") - (F.col("cap_upto") - F.col("cap"))) / rest
    per = scratch.keep(per.withColumn("level", level), "levels")
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    # Sources of one ratio come in the order of the sums: the first that fits, not the least level.
    order = F.struct(F.col("cap") / F.col("weight"), *by_name, F.col("level").alias("l"))
    true_level = per.agg(F.min(F.when(fits, order)).alias("m")).select(F.col("m.l").alias("true_level"))
    per = per.crossJoin(F.broadcast(true_level))  # one row
    target = F.least(F.col("cap"), F.coalesce(F.col("true_level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def _draw(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    """A number in [0, 1) for each row, evenly spread whatever the ids are."""
    parts = [col(id_col).cast("string")]
    if ids_clash(docs, id_col):
        # A hash passes over nulls, so each value comes with whether it is there.
        parts = [x for c in (id_col, text_col, source_col) for x in (col(c).isNull(), col(c).cast("string"))]
        seen = docs.select(F.xxhash64(*parts).alias("h")).groupBy("h").count()
        if not seen.where("count > 1").isEmpty():
            parts.append(F.monotonically_increasing_id())
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) * F.lit(2.0**-53)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST_REPEATS,
    seed: int = SEED,
) -> tuple[DataFrame, dict[str, str]]:
    """docs with each row's size, its source's size and target, and its copies.

    Returns the DataFrame and the names of the four added columns, which avoid
    names that docs has.  Nulls: a null source is a source of its own, ordered
    last; a null or empty text has size 0 and is copied as its source's rate says.
    Where an id is null or repeats, rows are drawn by id, text and source; where rows
    are equal in all three, by their place in the table as read too, so that even those
    are drawn apart and reruns over the same files agree.  Very long texts are counted,
    and copied, whole.
    A source of size 0 has target 0 and rate 0; an empty table stays empty.
    """
    spark = docs.sparkSession
    size, source_size, target, copies = fresh(docs, "size", "source_size", "target", "copies")
    sized = docs.select(col(source_col).cast("string").alias("source"), word_count(col(text_col)).alias("size"))
    per = Scratch(spark, "mix").keep(source_targets(sized, weights, most).coalesce(1), "sources")
    key, salt, k_source, k_salt = fresh(docs, "k", "s", "mix_source", "mix_salt")
    per = per.select(F.col("source").alias(k_source), F.col("source_size").alias(source_size), F.col("target").alias(target))
    draw = _draw(docs, id_col, text_col, source_col, seed)
    chance = fresh(docs, size, source_size, target, copies, "chance")[-1]
    docs = docs.withColumn(size, word_count(col(text_col))).withColumn(chance, draw)
    same = col(source_col).cast("string").eqNullSafe(F.col(k_source))
    if per.count() <= BROADCAST_SOURCES:
        out = docs.join(F.broadcast(per), same, "left")
    else:
        spread = F.floor(F.col(chance) * SALTS).cast("long")
        per = per.withColumn(k_salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = docs.withColumn(salt, spread).join(per, same & (F.col(salt) == F.col(k_salt)), "left").drop(salt, k_salt)
    rate = F.when(F.col(source_size) > 0, F.least(F.col(target) / F.col(source_size), F.lit(float(most)))).otherwise(0.0)
    whole = F.floor(rate)
    out = out.withColumn(copies, (whole + (F.col(chance) < rate - whole).cast("long")).cast("long")).drop(k_source, chance)
    return out, {"size": size, "source_size": source_size, "target": target, "copies": copies}


def emit(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, and docs' columns only."""
    mixed, names = mix(docs, **options)
    (each,) = fresh(mixed, "copy")
    mixed = mixed.where(F.col(names["copies"]) > 0)
    return mixed.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int")))).select(*[col(c) for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, size, source_size, target, taken, copies."""
    docs = docs.select("doc_id", "text", "source")
    out, n = mix(docs)
    return out.select("doc_id", F.col(n["size"]), F.col(n["source_size"]), F.col(n["target"]), (F.col(n["size"]) * F.col(n["copies"])).alias("taken"), F.col(n["copies"]).alias("copies"))
