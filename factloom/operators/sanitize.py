"""A model's JSON answers to observations; what is malformed goes, nothing raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..registry.extraction_rules import METHODS


def _text(item: Column, key: str) -> Column:
    """The member as text if it is a JSON string."""
    v = F.try_variant_get(item, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(item, f"$.{key}", "string"))


def sanitize(answers: DataFrame, fields: DataFrame) -> DataFrame:
    """answers(product_id, category, src_ord, source_id, authority, response) to observations.

    Unknown fields and values that are booleans, objects, lists or blank go;
    numbers become text; the confidence is clamped to 0..1 (0 where it isn't a
    number); an unknown method is llm_inference; a bad line makes both lines 0.
    """
    parsed = answers.withColumn("doc", F.try_parse_json("response"))
    items = F.try_variant_get("doc", "$.fields", "array<variant>")
    rows = parsed.withColumn("listed", items).where("listed is not null").select("product_id", "category", "src_ord", "source_id", "authority", F.posexplode("listed").alias("rule_ord", "item"))
    kind = F.schema_of_variant(F.try_variant_get("item", "$.value", "variant"))
    value = F.when(kind == "STRING", F.try_variant_get("item", "$.value", "string"))
    value = value.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get("item", "$.value", "string"))
    confidence_text = F.try_variant_get("item", "$.confidence", "string")
    confidence = F.when(confidence_text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), confidence_text.try_cast("double"))
    method = _text(F.col("item"), "method")
    line = lambda k: F.coalesce(F.try_variant_get("item", f"$.{k}", "string"), F.lit("0")).try_cast("double").try_cast("int")
    start, end = line("line_start"), line("line_end")
    good = start.isNotNull() & end.isNotNull()
    unit = _text(F.col("item"), "unit")
    out = rows.select(
        "product_id", "category", "src_ord", "rule_ord", "source_id", "authority", _text(F.col("item"), "field").alias("field"), value.alias("value"),
        F.when(strip(unit) != "", unit).alias("unit"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)))).alias("confidence"),
        F.when(method.isin(*METHODS), method).otherwise("llm_inference").alias("method"), F.coalesce(_text(F.col("item"), "snippet"), F.lit("")).alias("snippet"),
        F.when(good, start).otherwise(0).alias("line_start"), F.when(good, end).otherwise(0).alias("line_end"), F.coalesce(_text(F.col("item"), "reasoning"), F.lit("")).alias("reasoning"),
    )
    out = out.where(F.col("value").isNotNull() & (strip(F.col("value")) != ""))
    return out.join(F.broadcast(fields.select("category", "field")), ["category", "field"], "left_semi").select(*out.columns)


#: What a model is asked for: a fields array of observations.  `optional` members may be left out.
ANSWER = T.StructType(
    [
        T.StructField(
            "fields",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("field", T.StringType(), False),
                        T.StructField("value", T.StringType(), False),
                        T.StructField("unit", T.StringType(), True, {"optional": True}),
                        T.StructField("confidence", T.DoubleType(), False, {"limits": {"minimum": 0, "maximum": 1}}),
                        T.StructField("method", T.StringType(), False, {"limits": {"enum": list(METHODS)}}),
                        T.StructField("snippet", T.StringType(), False),
                        T.StructField("line_start", T.IntegerType(), False),
                        T.StructField("line_end", T.IntegerType(), False),
                        T.StructField("reasoning", T.StringType(), False, {"optional": True}),
                    ]
                )
            ),
            False,
        )
    ]
)
_JSON_TYPES = {T.StringType: "string", T.DoubleType: "number", T.IntegerType: "integer"}


def json_schema(kind: T.DataType) -> dict:
    """The JSON Schema of a Spark type; objects are closed."""
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if not isinstance(kind, T.StructType):
        return {"type": _JSON_TYPES[type(kind)]}
    members, required = {}, []
    for f in kind.fields:
        own = json_schema(f.dataType) | f.metadata.get("limits", {})
        members[f.name] = own | {"type": [own["type"], "null"]} if f.nullable else own
        if not f.metadata.get("optional"):
            required.append(f.name)
    return {"type": "object", "properties": members, "required": required, "additionalProperties": False}


def answer_schema(field_names: list[str]) -> dict:
    """JSON Schema of the answer a model is asked for, with the category's field names."""
    out = json_schema(ANSWER)
    out["properties"]["fields"]["items"]["properties"]["field"]["description"] = "One of: " + ", ".join(field_names)
    return out


class PromptTemplate:
    """Named parts of a text, between lines that open and close a part; what stands outside is commentary."""

    # The lines around a part
    OPEN, SHUT, CLOSE = "<!-- VARIANT: ", " -->", "<!-- /VARIANT -->"

    def __init__(self, text: str):
        self.parts: dict[str, str] = {}
        name, lines = None, []
        for line in text.splitlines():
            if name is None and line.startswith(self.OPEN) and line.endswith(self.SHUT):
                name, lines = line[len(self.OPEN) : -len(self.SHUT)], []
            elif name is not None and line == self.CLOSE:
                self.parts.setdefault(name, "\n".join(lines).strip())
                name = None
            elif name is not None:
                lines.append(line)

    def render(self, variant: str, fills: dict[str, object]) -> str:
        """The system part and the variant, whose `{{name}}` are filled; unknown names stay."""
        missing = next((k for k in ("system", variant) if k not in self.parts), None)
        if missing is not None:
            raise ValueError(f"the prompt template has no part {missing!r}")
        out, rest = [], self.parts[variant]
        while rest:
            plain, mark, rest = rest.partition("{{")
            name, end, after = rest.partition("}}")
            if mark and end and name.strip() in fills:
                out += [plain, str(fills[name.strip()])]
                rest = after
            else:
                out += [plain, mark]
        return self.parts["system"] + "\n\n" + "".join(out)
