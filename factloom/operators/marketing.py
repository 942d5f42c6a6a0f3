"""Product descriptions from verified fields only, with citations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry.copy_templates import SENTENCES, Sentence

NOTE = "Marketing copy only cites verified fields; needs_review fields are never auto-published."


def _worded(sentence: Sentence, field: str) -> Column:
    shown = F.col("verified")[field]["display"]
    phrases = sentence.phrases.get(field)
    if not phrases:
        return shown
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(phrases.items())]), shown), shown)


def _rendered(s: Sentence) -> Column:
    """struct<text, skipped, cited> for one sentence; text is null where it is skipped."""
    uses = F.array(*[F.lit(u) for u in s.uses])
    missing = F.array_except(uses, F.map_keys("verified"))
    text = reduce(lambda t, u: F.replace(t, F.lit("{{" + u + "}}"), _worded(s, u)), s.uses, F.lit(s.text))
    skipped = F.concat(F.lit("sentence using "), F.concat_ws(", ", missing), F.lit(" skipped (needs_review/missing/conflict)"))
    whole = F.size(missing) == 0
    return F.struct(F.when(whole, text).alias("text"), F.when(~whole, skipped).alias("skipped"), F.when(whole, uses).otherwise(F.array().cast("array<string>")).alias("cited"))


def marketing(routed: DataFrame, sentences: Iterable[Sentence] = SENTENCES) -> DataFrame:
    """(product_id, description, citations, sentences_skipped); categories without sentences give empty ones."""
    cite = F.transform("sources", lambda s: F.struct(s["source_id"].alias("source_id"), s["snippet"].alias("snippet")))
    entry = F.when(F.col("status") == "verified", F.struct("field", F.struct("label", "display", cite.alias("sources")).alias("v")))
    wide = routed.groupBy("product_id", "category").agg(F.map_from_entries(F.collect_list(entry)).alias("verified"))
    none = F.array().cast("array<struct<text:string,skipped:string,cited:array<string>>>")
    by: dict[str, list[Sentence]] = {}
    for s in sentences:
        by.setdefault(s.category, []).append(s)
    parts = reduce(lambda other, c: F.when(F.col("category") == c, F.array(*[_rendered(s) for s in by[c]])).otherwise(other), by, none)
    rows = wide.withColumn("parts", parts)
    cited = F.flatten(F.transform("parts", lambda p: p["cited"]))
    citations = F.transform(cited, lambda f: F.struct(f.alias("field"), F.col("verified")[f]["label"].alias("label"), F.col("verified")[f]["display"].alias("value"), F.col("verified")[f]["sources"].alias("sources")))
    present = lambda k: F.filter(F.transform("parts", lambda p: p[k]), lambda x: x.isNotNull())
    return rows.select("product_id", F.concat_ws(" ", present("text")).alias("description"), citations.alias("citations"), present("skipped").alias("sentences_skipped"))
