"""Plausibility and domain rules over a product's fused fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import general, shortest
from ..registry.categories import Category, builtin
from ..registry.validation_rules import ERROR, RULES, Rule


def _number(field: str) -> Column:
    return F.try_element_at(F.col("numbers"), F.lit(field))


def _check(rule_id: str, field: str, severity: str, ran: Column, holds: Column, message: str, values: Column) -> Column:
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.coalesce(ran, F.lit(False)).alias("ran"), (ran & ~holds).alias("failed"), F.lit(message).alias("template"), values.alias("values"))


def _checked(rule: Rule) -> Column:
    values = [_number(f) for f in rule.fields]
    ran = values[0].isNotNull()
    for v in values[1:]:
        ran = ran & v.isNotNull()
    return _check(rule.id, rule.fields[0], rule.severity, ran, rule.holds(*values), rule.message, F.array(*values))


def _domain_rules(categories: Iterable[Category]) -> list[Column]:
    """One rule per closed field of each category, for products of that category."""
    out = []
    for c in categories:
        for f in c.fields:
            if f.type != "enum" or not f.enum:
                continue
            value = F.try_element_at(F.col("texts"), F.lit(f.name))
            listed = "[" + ", ".join(f"'{e}'" for e in sorted(f.enum)) + "]"
            ran = (F.col("category") == c.name) & value.isNotNull()
            out.append(_check(f"{f.name}_enum", f.name, ERROR, ran, F.lower(value).isin(*[e.lower() for e in f.enum]), f"{f.name} '{{value}}' not in schema enum {listed}", F.array().cast("array<double>")))
    return out


def _message(c: Column) -> Column:
    """The template with its values, in general format; only made for rules that fail."""
    shown = F.transform(c["values"], general)
    text = F.replace(c["template"], F.lit("{*}"), F.concat(F.lit("["), F.concat_ws(", ", F.transform(c["values"], shortest)), F.lit("]")))
    for i in range(3):
        text = F.replace(text, F.lit(f"{{{i}}}"), F.coalesce(F.get(shown, F.lit(i)), F.lit("")))
    text = F.replace(text, F.lit("{value}"), F.coalesce(F.try_element_at("texts", c["field"]), F.lit("")))
    return F.when(c["failed"], text)


def checks_run(categories: Iterable[Category] | None = None, rules: Iterable[Rule] = RULES) -> Column:
    """The checks that a product's numbers and texts allow, in the order of the rules; made once, it serves several stages as their `ran`."""
    checks = F.array(*[_checked(r) for r in rules], *_domain_rules(categories if categories is not None else builtin()))
    return F.filter(checks, lambda c: c["ran"])


def _wide(fused: DataFrame, *kept: str) -> DataFrame:
    """(product_id, category, rows, numbers, texts): a product's fields with what is kept of them, and their values by field."""
    named = lambda c: F.map_from_entries(F.transform(F.filter("rows", lambda r: r[c].isNotNull()), lambda r: F.struct(r["field"], r[c])))
    # A product has at most as many rows as its category has fields.
    whole = fused.groupBy("product_id", "category").agg(F.collect_list(F.struct("field", *kept)).alias("rows"))
    return whole.withColumn("numbers", named("value_num")).withColumn("texts", named("value_str"))


def check_rules(fused: DataFrame, categories: Iterable[Category] | None = None, rules: Iterable[Rule] = RULES, ran: Column | None = None) -> DataFrame:
    """(product_id, rule_ord, rule_id, field, severity, ran, failed, message), every rule for every product.

    Conflicts have no value, so rules that read them don't run.
    """
    return check_values(_wide(fused, "value_num", "value_str"), categories, rules, ran)


def check_values(wide: DataFrame, categories: Iterable[Category] | None = None, rules: Iterable[Rule] = RULES, ran: Column | None = None) -> DataFrame:
    """check_rules where each product is a row already: product_id, category, numbers and texts by field."""
    rows = wide.select("product_id", "texts", F.posexplode(checks_run(categories, rules) if ran is None else ran).alias("rule_ord", "c"))
    return rows.select("product_id", "rule_ord", "c.rule_id", "c.field", "c.severity", "c.ran", "c.failed", _message(F.col("c")).alias("message"))


def with_issues(fused: DataFrame, categories: Iterable[Category] | None = None, rules: Iterable[Rule] = RULES, ran: Column | None = None) -> DataFrame:
    """fused with `found`, a field's failed checks (rule_ord, field, rule_id, severity, message); null where it has none.

    A product's fields and their checks meet in one row, so fused is computed once and nothing is joined.
    """
    wide = _wide(fused, *[c for c in fused.columns if c not in ("product_id", "category", "field")])
    placed = F.filter(F.transform(checks_run(categories, rules) if ran is None else ran, lambda c, i: F.struct(i.alias("rule_ord"), c.alias("c"))), lambda p: p["c"]["failed"])
    issues = F.transform(placed, lambda p: F.struct(p["rule_ord"].alias("rule_ord"), *[p["c"][k].alias(k) for k in ("field", "rule_id", "severity")], _message(p["c"]).alias("message")))
    rows = wide.withColumn("issues", issues).select("product_id", "category", "issues", F.explode("rows").alias("r")).select("product_id", "category", "issues", "r.*")
    own = F.filter("issues", lambda i: i["field"] == F.col("field"))
    return rows.select(*fused.columns, F.when(F.size(own) > 0, own).alias("found"))


def validated(fused: DataFrame, categories: Iterable[Category] | None = None, rules: Iterable[Rule] = RULES, ran: Column | None = None) -> DataFrame:
    """validation(check_rules(fused, categories, rules)) from one row per product; products for which no rule ran are there too."""
    return validated_values(_wide(fused, "value_num", "value_str"), categories, rules, ran)


def validated_values(wide: DataFrame, categories: Iterable[Category] | None = None, rules: Iterable[Rule] = RULES, ran: Column | None = None) -> DataFrame:
    """validated where each product is a row already, as for check_values."""
    wide = wide.withColumn("checks", checks_run(categories, rules) if ran is None else ran)
    failed = F.filter("checks", lambda c: c["failed"])
    issues = F.transform(failed, lambda c: F.struct(*[c[k].alias(k) for k in ("field", "rule_id", "severity")], _message(c).alias("message")))
    passed = ~F.exists("checks", lambda c: F.coalesce(c["failed"], F.lit(False)) & (c["severity"] == ERROR))
    return wide.select("product_id", F.size("checks").cast("long").alias("rules_run"), passed.alias("passed"), issues.alias("issues"))


def validation(checks: DataFrame) -> DataFrame:
    """(product_id, rules_run, passed, issues) per product with any rule run; warnings don't fail it."""
    issue = F.struct("rule_ord", "field", "rule_id", "severity", "message")
    got = checks.groupBy("product_id").agg(
        F.count_if("ran").alias("rules_run"), (F.count_if(F.col("failed") & (F.col("severity") == ERROR)) == 0).alias("passed"),
        F.sort_array(F.collect_list(F.when(F.col("failed"), issue))).alias("issues"),
    )
    return got.withColumn("issues", F.transform("issues", lambda i: i.dropFields("rule_ord")))
