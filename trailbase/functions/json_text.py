"""JSON out of a language model's prose, and typed values out of that JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verdicts on a page.
CLASSES = ("RELEVANT", "HUB", "AGGREGATOR", "IRRELEVANT", "NAVIGATION", "UNKNOWN")
#: The most entries of each list.
LIMITS = {"tags": 8, "topics": 10, "entities": 10, "endorsed_links": 5}


def json_block(content: Column) -> Column:
    """The text from the first { to the last }, without commas before a closing bracket if it only parses so; null if neither parses."""
    block = F.nullif(F.regexp_extract(content, r"(?s)(\{.*\})", 1), F.lit(""))
    mended = F.regexp_replace(block, r",\s*([}\]])", "$1")
    return F.coalesce(F.when(F.try_parse_json(block).isNotNull(), block), F.when(F.try_parse_json(mended).isNotNull(), mended))


def _field(data: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(data), path, kind)


def number(data: Column, name: str) -> Column:
    """A number between 0 and 1; 0 for anything else, true and false too."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), f"$.{name}", "variant"))
    value = F.when(~kind.isin("BOOLEAN", "STRING"), _field(data, f"$.{name}", "double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def strings(data: Column, name: str, most: int) -> Column:
    """Trimmed, distinct, non-empty strings of a list in their order, ``most`` at most; other entries are passed over."""
    items = F.coalesce(F.try_variant_get(F.try_parse_json(data), f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    return F.slice(F.array_distinct(F.filter(texts, lambda x: x != "")), 1, most)


def classification(data: Column, name: str = "classification") -> Column:
    value = F.upper(_field(data, f"$.{name}", "string"))
    return F.when(value.isin(*CLASSES), value).otherwise("UNKNOWN")


def parse_analysis(data: Column) -> Column:
    """A page analysis as a struct with every value in its bounds."""
    return F.struct(
        classification(data).alias("classification"), number(data, "relevance_score").alias("relevance_score"), number(data, "hub_score").alias("hub_score"),
        F.coalesce(F.trim(_field(data, "$.summary", "string")), F.lit("")).alias("summary"), *[strings(data, k, n).alias(k) for k, n in LIMITS.items()],
    )
