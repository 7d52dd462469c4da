"""The tables of a folder as the engine's records, and the same in SQL for comparison.

pages are a corpus; documents stand for page texts (source as domain, doc_id
as order of fetching); labels are verdicts; embeddings are vectors (vec_id 0 is
the goal); events are the run's log (user_id as domain).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import html

KEYWORDS = ["the", "of and", "tion", "data"]
NOW = "2026-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages with their canonical URL and their source page."""
    links = html.page_links_table(table(spark, sf_dir, "pages"))
    url = urls.url_struct(F.col("href"), F.col("base_url"))
    source = urls.canonical_url(F.col("base_url"))
    return links.withColumn("u", url).select(
        F.substring(F.sha2(F.concat_ws("#", F.col("page_id").cast("string"), F.col("position").cast("string")), 256), 1, 12).alias("candidate_id"),
        "page_id", "u.*", "href", "anchor", "snippet", "parent_heading", "position", "link_count", F.lit(1).alias("depth"),
        source.alias("source_url"), urls.fingerprint(source).alias("source_url_key"), F.col("title").alias("source_title"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts on documents: seq, url_key, domain, classification and relevance_score."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "RELEVANT").when(F.col("toxic") == 1, "IRRELEVANT").otherwise("NAVIGATION")
    return docs.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url_key"), F.col("source").alias("domain"), "lang",
        verdict.alias("classification"), (F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000).alias("relevance_score"),
    )


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as judged pages, in the order of event_id."""
    kind = F.col("event_type")
    verdict = F.when(kind == "purchase", "RELEVANT").when(kind == "click", "HUB").when(kind == "view", "AGGREGATOR").when(kind == "signup", "NAVIGATION").otherwise("IRRELEVANT")
    topic = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("url"),
        F.concat(F.lit("page "), F.col("event_id").cast("string")).alias("title"), verdict.alias("classification"), F.least(F.col("value") / 500, F.lit(1.0)).alias("relevance_score"),
        F.when(verdict == "HUB", F.least(F.col("value") / 200, F.lit(1.0))).otherwise(0.0).alias("hub_score"), F.array(topic).alias("topics"),
        F.array(F.concat(F.lit("/next/"), topic)).alias("endorsed_links"), F.col("ts").cast("timestamp").alias("ts"), F.lit("t").alias("task_id"), F.col("value").alias("value"),
    )


_TRACK = ", ".join(f"'{p}'" for p in urls.TRACKING_PARAMS)
_PREFIX = "|".join(urls.HOST_PREFIXES)


def canonical_sql(u: str) -> str:
    """An absolute URL's canonical form in SQL."""
    path = f"regexp_replace(CASE WHEN regexp_extract({u}, '^[^:]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[^:]*://[^/?#]*([^?#]*)', 1) END, '/+', '/', 'g')"
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACK}))), '&')"
    return f"lower(regexp_extract({u}, '^([A-Za-z]+):', 1)) || '://' || {host_sql(u)} || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


def host_sql(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[^:]*://([^/?#:]*)', 1))"


def reg_domain_sql(h: str) -> str:
    return f"array_to_string(list_slice(string_split(regexp_replace({h}, '^((?:(?:{_PREFIX})\\.)+)([^.]+\\.[^.]+.*)$', '\\2'), '.'), -3, -1), '.')"


LINKS_SQL = f"""raw_links AS (
  SELECT page_id, url AS base_url, replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&amp;', '&') AS title, len(regexp_extract_all(html, '<a href="[^"]*"')) AS link_count,
         unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)<', 1)) AS anchor,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS position
  FROM pages),
link_urls AS (
  SELECT *, regexp_extract(base_url, '^([A-Za-z]+://[^/?#]*)', 1) || href AS absolute FROM raw_links),
candidates AS (
  SELECT substr(sha256(page_id || '#' || position), 1, 12) AS candidate_id, page_id, href AS raw, href, anchor, anchor AS snippet, position, link_count, 1 AS depth,
         nullif(title, '') AS source_title, {canonical_sql("absolute")} AS canonical, substr(sha256({canonical_sql("absolute")}), 1, 16) AS url_key,
         {host_sql("absolute")} AS domain, {reg_domain_sql(host_sql("absolute"))} AS reg_domain, {canonical_sql("base_url")} AS source_url
  FROM link_urls)"""

ANALYSES_SQL = """analyses AS (
  SELECT doc_id AS seq, 'd' || doc_id AS url_key, source AS domain, lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'RELEVANT' WHEN toxic = 1 THEN 'IRRELEVANT' ELSE 'NAVIGATION' END AS classification,
         ((doc_id * 7919) % 1000)::DOUBLE / 1000 AS relevance_score
  FROM documents JOIN labels USING (doc_id))"""

JUDGED_SQL = """judged AS (
  SELECT event_id AS seq, 'u' || user_id AS domain, 'p' || event_id AS url, 'page ' || event_id AS title,
         CASE event_type WHEN 'purchase' THEN 'RELEVANT' WHEN 'click' THEN 'HUB' WHEN 'view' THEN 'AGGREGATOR' WHEN 'signup' THEN 'NAVIGATION' ELSE 'IRRELEVANT' END AS classification,
         least(value / 500, 1.0) AS relevance_score, CASE WHEN event_type = 'click' THEN least(value / 200, 1.0) ELSE 0.0 END AS hub_score,
         json_extract_string(props, '$.k') AS topic, ts, value
  FROM events)"""
