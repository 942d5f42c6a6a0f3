"""Routing: which fields are verified, which go to the review queue, and why."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry.categories import Category
from ..registry.validation_rules import RULES, Rule
from .fuse import VERIFIED
from .validate import with_issues


def status_and_flag(conflict: Column, has_issue: Column, confidence: Column) -> tuple[Column, Column]:
    """(status, flag to add): the first of conflict, issue and low confidence decides."""
    review = conflict | has_issue | (confidence < F.lit(VERIFIED))
    flag = F.when(conflict, F.lit(None).cast("string")).when(has_issue, F.lit("validation")).when(confidence < F.lit(VERIFIED), F.lit("low_confidence"))
    return F.when(review, F.lit("needs_review")).otherwise(F.lit("verified")), flag


def route(fused: DataFrame, checks: DataFrame) -> DataFrame:
    """fused with status, flags and the issues of fields that aren't in conflict."""
    issue = F.struct("rule_ord", "field", "rule_id", "severity", "message")
    own = checks.where("failed").groupBy("product_id", "field").agg(F.sort_array(F.collect_list(issue)).alias("found"))
    return _routed(fused, fused.join(own, ["product_id", "field"], "left"))


def route_checked(fused: DataFrame, categories: Iterable[Category] | None = None, rules: Iterable[Rule] = RULES, ran: Column | None = None) -> DataFrame:
    """route(fused, check_rules(fused, categories, rules)), for which fused is computed once and nothing is joined."""
    return _routed(fused, with_issues(fused, categories, rules, ran))


def _routed(fused: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: fused with `found`, each field's failed checks in the order of the rules."""
    status, flag = status_and_flag(F.col("conflict"), F.col("found").isNotNull(), F.col("confidence"))
    flags = F.concat("flags", F.when(flag.isNull(), F.array().cast("array<string>")).otherwise(F.array(flag)))
    nothing = F.array().cast("array<struct<field:string,rule_id:string,severity:string,message:string>>")
    issues = F.when(flag == "validation", F.transform("found", lambda i: i.dropFields("rule_ord"))).otherwise(nothing)
    return rows.select(*[c for c in fused.columns if c != "flags"], flags.alias("flags"), status.alias("status"), issues.alias("validation_issues"))


def review_queue(routed: DataFrame) -> DataFrame:
    """Fields that need review, with the reason; order them by queue_key within a product."""
    low = F.concat(F.lit("Only "), F.size("sources").cast("string"), F.lit(" source(s), effective confidence "), F.format_string("%.2f", "confidence"), F.lit(f" < {VERIFIED:.2f} threshold"))
    reason = (
        F.when(F.col("conflict"), F.col("reasoning"))
        .when(F.array_contains("flags", "validation"), F.concat_ws("; ", F.transform("validation_issues", lambda i: i["message"])))
        .when(F.array_contains("flags", "low_confidence"), low)
        .otherwise(F.col("reasoning"))
    )
    key = F.struct(F.when(F.col("conflict"), 0).otherwise(1).alias("first"), "confidence", "field_ord")
    return routed.where("status = 'needs_review'").select(
        "product_id", key.alias("queue_key"), "field", "label", "confidence", "flags", reason.alias("reason"), "type", "value_num", "value_str", "display",
        F.transform("sources", lambda s: s["source_id"]).alias("sources"),
    )
