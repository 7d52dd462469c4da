"""Queries over judgements, stop conditions and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback, stop
from ..shared import delete_at_exit, shared_folder
from ..streaming import events as stream
from ..streaming import feedback_state
from .tables import JUDGED_SQL, judgements, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_R = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"
_GOOD = "classification IN ('RELEVANT', 'HUB')"


@query(f"WITH {JUDGED_SQL} SELECT domain AS reg_domain, count(*) FILTER ({_GOOD}) AS times_relevant, count(*) FILTER (NOT {_GOOD}) AS times_irrelevant, {_R('sum(relevance_score) / count(*)')} AS average FROM judged GROUP BY domain")
def domain_priors(spark: SparkSession, d: str) -> DataFrame:
    deltas = feedback.prior_deltas(judgements(spark, d))
    return deltas.join(feedback.prior_averages(deltas), "reg_domain").select("reg_domain", "times_relevant", "times_irrelevant", "average")


_LAST = f"last AS (SELECT domain, {_GOOD} AS good, row_number() OVER (PARTITION BY domain ORDER BY seq DESC) AS nth FROM judged)"


_MULTIPLIERS = f"WITH {JUDGED_SQL}, {_LAST} SELECT domain, CASE WHEN count(*) >= 3 AND count(*) FILTER (good) = 3 THEN 1.2 WHEN count(*) >= 3 AND count(*) FILTER (good) = 0 THEN 0.6 ELSE 1.0 END::DOUBLE AS multiplier FROM last WHERE nth <= 3 GROUP BY domain"


@query(_MULTIPLIERS)
def domain_multiplier(spark: SparkSession, d: str) -> DataFrame:
    return feedback.domain_multipliers(judgements(spark, d))


@query(f"WITH {JUDGED_SQL}, w AS (SELECT seq, count(*) OVER f AS seen, count(*) FILTER ({_GOOD}) OVER f AS good FROM judged WINDOW f AS (PARTITION BY domain ORDER BY seq ROWS 2 PRECEDING)) SELECT seq, CASE WHEN seen >= 3 AND good = 3 THEN 1.2 WHEN seen >= 3 AND good = 0 THEN 0.6 ELSE 1.0 END::DOUBLE AS multiplier FROM w")
def rolling_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return feedback.rolling_verdicts(judgements(spark, d)).select("seq", "multiplier")


@query(f"WITH {JUDGED_SQL} SELECT domain, max(hub_score) AS hub_score FROM judged WHERE hub_score >= 0.5 GROUP BY domain ORDER BY hub_score DESC, min(seq) LIMIT 5")
def hub_top5(spark: SparkSession, d: str) -> DataFrame:
    return feedback.top_hubs(judgements(spark, d)).select("domain", "hub_score")


@query(f"WITH {JUDGED_SQL} SELECT topic, count(*) AS n FROM judged GROUP BY topic ORDER BY n DESC, min(seq) LIMIT 20")
def topics_top20(spark: SparkSession, d: str) -> DataFrame:
    return feedback.top_topics(judgements(spark, d))


@query(f"WITH {JUDGED_SQL} SELECT seq, url, title, round(relevance_score, 2) AS relevance_score FROM judged WHERE classification = 'RELEVANT' ORDER BY seq DESC LIMIT 10")
def recent_relevant(spark: SparkSession, d: str) -> DataFrame:
    return feedback.recent_relevant(judgements(spark, d))


@query(f"WITH {JUDGED_SQL} SELECT url AS source_url, '/next/' || topic AS href FROM judged")
def endorsed_links(spark: SparkSession, d: str) -> DataFrame:
    return feedback.endorsed(judgements(spark, d))


@query(f"""WITH {JUDGED_SQL}, {_LAST}, m AS (SELECT domain, CASE WHEN count(*) >= 3 AND count(*) FILTER (good) = 3 THEN 1.2 WHEN count(*) >= 3 AND count(*) FILTER (good) = 0 THEN 0.6 ELSE 1.0 END::DOUBLE AS x FROM last WHERE nth <= 3 GROUP BY domain)
SELECT seq, {_R("relevance_score * CASE WHEN hub_score >= 0.5 THEN 1.5 ELSE 1.0 END::DOUBLE * x")} AS priority FROM judged JOIN m USING (domain)""")
def steered_priorities(spark: SparkSession, d: str) -> DataFrame:
    judged = judgements(spark, d)
    items = judged.select("seq", F.col("domain").alias("reg_domain"), F.col("url").alias("source_url"), F.col("relevance_score").alias("priority"))
    return feedback.steer(items, judged).select("seq", "priority")


@query(f"""WITH {JUDGED_SQL}, recent AS (SELECT url, seq FROM judged WHERE classification = 'RELEVANT' ORDER BY seq DESC LIMIT 10),
hubs AS (SELECT domain, max(hub_score) AS best, min(seq) AS first FROM judged WHERE hub_score >= 0.5 GROUP BY domain ORDER BY best DESC, first LIMIT 5),
often AS (SELECT topic, count(*) AS n, min(seq) AS first FROM judged GROUP BY topic ORDER BY n DESC, first LIMIT 20),
priors AS (SELECT domain, floor(sum(relevance_score) / count(*) * 10000 + 0.5) / 10000 AS average FROM judged GROUP BY domain)
SELECT (SELECT count(*) FROM judged) AS pages_seen, (SELECT string_agg(url, ',' ORDER BY seq) FROM recent) AS relevant_pages, (SELECT string_agg(domain, ',' ORDER BY best DESC, first) FROM hubs) AS hub_domains,
(SELECT string_agg(topic, ',' ORDER BY n DESC, first) FROM often) AS topics, (SELECT count(*) FROM priors) AS n_priors, (SELECT domain FROM priors ORDER BY average DESC, domain LIMIT 1) AS best_prior""")
def feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    """The steering summary, its lists as text and of the priors the best."""
    best = F.array_sort(F.transform(F.map_entries("domain_priors"), lambda x: F.struct((-x["value"]).alias("v"), x["key"].alias("k"))))[0]["k"]
    return feedback.summary(judgements(spark, d)).select(
        "pages_seen", F.array_join(F.col("relevant_pages.url"), ",").alias("relevant_pages"), F.array_join("hub_domains", ",").alias("hub_domains"),
        F.array_join("topics", ",").alias("topics"), F.size("domain_priors").cast("long").alias("n_priors"), best.alias("best_prior"),
    )


_WINDOW = "w AS (SELECT seq, count(*) OVER f AS judged_n, count(*) FILTER (relevance_score >= 0.7) OVER f AS relevant_n FROM judged WINDOW f AS (ORDER BY seq ROWS 19 PRECEDING))"


@query(f"WITH {JUDGED_SQL}, {_WINDOW} SELECT min(seq) AS first_stop, count(*) AS n FROM w WHERE judged_n >= 20 AND relevant_n < 2")
def diminishing_returns(spark: SparkSession, d: str) -> DataFrame:
    rows = feedback.relevance_window(judgements(spark, d)).filter("judged >= 20 and relevant < 2")
    return rows.agg(F.min("seq").alias("first_stop"), F.count("*").alias("n"))


@query(f"WITH {JUDGED_SQL}, dated AS (SELECT seq, value < 100 AS stale FROM judged), g AS (SELECT *, count(*) FILTER (NOT stale) OVER (ORDER BY seq) AS run FROM dated) SELECT seq, count(*) FILTER (stale) OVER (PARTITION BY run ORDER BY seq) AS streak FROM g")
def stale_streak(spark: SparkSession, d: str) -> DataFrame:
    published = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("value").cast("double"))
    pages = judgements(spark, d).select("task_id", "seq", published.alias("published_at"))
    return feedback.stale_streak(pages, F.timestamp_seconds(F.lit(1_700_000_100.0))).select("seq", "streak")


@query(f"WITH {JUDGED_SQL}, t AS (SELECT seq, sum(floor(value)::BIGINT) OVER (ORDER BY seq) AS total FROM judged) SELECT min(seq) AS first_spent FROM t WHERE total >= 20000")
def budget_stop(spark: SparkSession, d: str) -> DataFrame:
    calls = judgements(spark, d).select("task_id", "seq", F.floor("value").alias("tokens"))
    return feedback.token_spend(calls, 20_000).filter("spent").agg(F.min("seq").alias("first_spent"))


@query("""SELECT o_orderkey AS task, nullif(concat_ws('+', CASE WHEN o_orderkey % 7 >= 5 THEN 'BUDGET_PAGES' END, CASE WHEN o_totalprice >= 200000 THEN 'BUDGET_TOKENS' END, CASE WHEN o_orderkey % 3 = 0 THEN 'USER_REQUESTED' END, CASE WHEN o_orderkey % 11 = 0 THEN 'FRONTIER_DRAINED' END), '') AS stop_reasons FROM orders""")
def stop_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    counters = table(spark, d, "orders").select(
        k.alias("task"), F.lit(5).alias("max_pages"), (k % 7).alias("fetched"), F.lit(200000.0).alias("max_tokens"), F.col("o_totalprice").alias("tokens_used"), F.lit(0).alias("max_duration"), F.lit(0).alias("elapsed"),
        F.lit(None).cast("timestamp").alias("since"), F.lit(9).alias("stale_streak"), F.lit("").alias("fatal_error"), F.when(k % 3 == 0, "STOPPING").otherwise("RUNNING").alias("state"),
        F.lit(0).alias("judged"), F.lit(0).alias("relevant"), (k % 11).alias("frontier_size"), F.lit(0).alias("buffer_size"), F.lit(0).alias("in_flight"),
    )
    return stop.stop_reasons(counters).select("task", "stop_reasons")


@query("SELECT event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY event_type")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return stream.run_to_folder(stream.counts_by_type(stream.event_stream(spark, d)), "complete")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    out = stream.run_to_folder(stream.windowed(stream.event_stream(spark, d)), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {JUDGED_SQL}, {_LAST} SELECT domain[2:]::BIGINT AS user_id, count(*)::INTEGER AS seen, (count(*) FILTER (good))::INTEGER AS good FROM last WHERE nth <= 3 GROUP BY domain")
def stream_domain_window(spark: SparkSession, d: str) -> DataFrame:
    return stream.run_to_folder(stream.running_verdicts(stream.event_stream(spark, d)), "update", ("user_id",))


@query(_MULTIPLIERS)
def stream_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The multipliers of domains from judgements that come as a stream and are folded batch by batch."""
    path = shared_folder(spark, "folded")
    delete_at_exit(spark, path)
    rows = judgements(spark, d).drop("ts")
    rows.withColumn("part", F.pmod("seq", F.lit(4))).repartition("part").write.parquet(f"{path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    fold = feedback_state.FeedbackFold(spark, f"{path}/state")
    fold.follow(source, f"{path}/checkpoint")
    return fold.domain_multipliers()
