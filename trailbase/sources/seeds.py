"""Seed candidates: from lists, JSON files, and RSS or Atom feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def _candidates(links: DataFrame) -> DataFrame:
    """Non-blank URLs (raw) as candidates of depth 0."""
    raw = F.trim("raw")
    url = urls.url_struct(raw, raw)
    return links.filter(raw != "").select(raw.alias("raw"), url.alias("url"), F.lit(0).alias("depth")).select(F.substring(F.sha2("raw", 256), 1, 12).alias("candidate_id"), "url.*", "depth").dropDuplicates(["url_key"])


def manual(spark: SparkSession, seeds: str | list[str]) -> DataFrame:
    """From a list, or from text with commas."""
    parts = seeds.split(",") if isinstance(seeds, str) else list(seeds)
    return _candidates(spark.createDataFrame([(p,) for p in parts], "raw string"))


def from_column(rows: DataFrame, column: Column) -> DataFrame:
    """From a column with one URL in each row; commas belong to it."""
    return _candidates(rows.select(column.alias("raw")).filter("raw is not null"))


def from_text_column(rows: DataFrame, column: Column) -> DataFrame:
    """From a column of comma-separated URLs."""
    return _candidates(rows.select(F.explode(F.split(column, ",")).alias("raw")))


def json_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Seeds, and allowed domains (reg_domain), of a JSON file: a list of URLs, or an object with seeds and allowed_domains.

    Entries that are not strings, and any other JSON, count as nothing.
    """
    data = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    strings = lambda where: F.transform(F.filter(F.coalesce(F.try_variant_get("v", where, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    seeds = data.select(F.explode(F.concat(strings("$"), strings("$.seeds"))).alias("raw"))
    domains = data.select(F.explode(strings("$.allowed_domains")).alias("d")).filter(F.trim("d") != "")
    return _candidates(seeds), domains.select(F.lower(F.trim("d")).alias("reg_domain")).distinct()


def feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Links of an RSS feed's items, or of an Atom feed's entries (tag ``entry``)."""
    link = {"item": "link string", "entry": "link struct<_href: string>"}[tag]
    rows = spark.read.format("xml").option("rowTag", tag).schema(link).load(path)
    return _candidates(rows.select(F.col("link") if tag == "item" else F.col("link._href")).toDF("raw").filter("raw is not null"))


def blacklist(spark: SparkSession, path: str | None, default: tuple[str, ...] = ("wikidata.org",)) -> DataFrame:
    """Domains of a JSON file with a list ``domains``; without a file the default."""
    if path is None:
        return spark.createDataFrame([(d,) for d in default], "reg_domain string")
    data = spark.read.text(path, wholetext=True)
    return data.select(F.explode(F.from_json("value", "domains array<string>")["domains"]).alias("reg_domain")).filter(F.trim("reg_domain") != "").distinct()
