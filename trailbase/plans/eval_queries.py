"""Queries over ranking metrics, experiments and finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import analytics, evals, store
from .tables import ANALYSES_SQL, LINKS_SQL, analyses, candidates, host_sql, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_R = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"
_COS = "list_dot_product(e.embedding::DOUBLE[], g.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(g.embedding::DOUBLE[], g.embedding::DOUBLE[])))"
EVAL_SQL = f"eval AS (SELECT e.vec_id AS idx, e.label AS layer, {_R(_COS)} AS score, e.label = g.label AS relevant, ((e.vec_id * 37) % 100)::DOUBLE / 100 AS old_score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) g)"


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    """Vectors scored by their similarity to vector 0; relevant if they share its label."""
    rows = table(spark, d, "embeddings")
    goal = rows.filter("vec_id = 0").select(F.col("embedding").alias("g"), F.col("label").alias("goal_label"), F.lit(1).alias("one"))
    both = rows.withColumn("one", F.lit(1)).join(F.broadcast(goal), "one")
    return both.select(F.col("vec_id").alias("idx"), F.col("label").alias("layer"), scores.round4(scores.cosine(F.col("embedding"), F.col("g"))).alias("score"), (F.col("label") == F.col("goal_label")).alias("relevant"), (F.pmod(F.col("vec_id") * 37, F.lit(100)) / 100.0).alias("old_score"))


def _metrics_sql(source: str, by: str) -> str:
    """Metrics for groups of ``by`` of (idx, score, relevant), as a chain of named tables."""
    ideal = lambda k: f"list_sum(list_transform(range(1, least(n_relevant, {k})::BIGINT + 1), lambda i: 1 / log2(i + 1)))"
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, idx) AS r FROM {source}),
counted AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY {by} ORDER BY r) AS hits FROM placed),
summed AS (SELECT {by}, sum(relevant::INT) AS n_relevant, {', '.join(f"sum(CASE WHEN r <= {k} AND relevant THEN 1 / log2(r + 1) ELSE 0 END) AS dcg{k}" for k in (5, 10, 50))},
  {', '.join(f"sum(CASE WHEN r <= {k} AND relevant THEN 1 ELSE 0 END) AS hits{k}" for k in (5, 10, 60, 100))}, sum(CASE WHEN relevant THEN hits / r ELSE 0 END) AS ap_sum FROM counted GROUP BY {by}),
metrics AS (SELECT {by}, n_relevant, {', '.join(f"CASE WHEN n_relevant > 0 THEN dcg{k} / {ideal(k)} ELSE 0.0 END AS ndcg_at_{k}" for k in (5, 10, 50))}, hits5 / 5 AS p_at_5, hits10 / 10 AS p_at_10,
  {', '.join(f"CASE WHEN n_relevant > 0 THEN hits{k} / n_relevant ELSE 0.0 END AS recall_at_{k}" for k in (60, 100))}, CASE WHEN n_relevant > 0 THEN ap_sum / n_relevant ELSE 0.0 END AS ap FROM summed)"""


_round = lambda *names: [scores.round4(F.col(n)).alias(n) for n in names]
_NDCG, _PR = ("ndcg_at_5", "ndcg_at_10", "ndcg_at_50"), ("p_at_5", "p_at_10", "recall_at_60", "recall_at_100")


def _all_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evals.metrics(eval_rows(spark, d).withColumn("run", F.lit("all")), ["run"])


_ONE_RUN = f"WITH {EVAL_SQL}, run_rows AS (SELECT *, 'all' AS run FROM eval), {_metrics_sql('run_rows', 'run')}"


@query(f"{_ONE_RUN} SELECT {', '.join(f'{_R(n)} AS {n}' for n in _NDCG)} FROM metrics")
def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _all_metrics(spark, d).select(*_round(*_NDCG))


@query(f"{_ONE_RUN} SELECT {', '.join(f'{_R(n)} AS {n}' for n in _PR)} FROM metrics")
def precision_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _all_metrics(spark, d).select(*_round(*_PR))


@query(f"{_ONE_RUN} SELECT n_relevant::BIGINT AS n_relevant, {_R('ap')} AS ap FROM metrics")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _all_metrics(spark, d).select("n_relevant", *_round("ap"))


@query(f"WITH {EVAL_SQL} SELECT layer, {', '.join(f'round(quantile_cont(score, {p}::DOUBLE), 6) AS p{int(p * 100)}' for p in (0.05, 0.25, 0.5, 0.75, 0.9))}, max(score) AS max FROM eval GROUP BY layer")
def layer_percentiles(spark: SparkSession, d: str) -> DataFrame:
    points = {f"p{int(p * 100)}": p for p in (0.05, 0.25, 0.5, 0.75, 0.9)}
    return evals.percentiles(eval_rows(spark, d), ["layer"], "score", points).select("layer", *[F.round(p, 6).alias(p) for p in points], "max")


_FLOORS = [-0.2, -0.1, 0.0, 0.1, 0.2]


@query(f"WITH {EVAL_SQL} SELECT layer, floor, {_R('avg((score >= floor)::INT)')} AS share FROM eval, (SELECT unnest([-0.2, -0.1, 0.0, 0.1, 0.2]::DOUBLE[]) AS floor) GROUP BY ALL")
def floor_survival(spark: SparkSession, d: str) -> DataFrame:
    return evals.floor_survival(eval_rows(spark, d), ["layer"], "score", _FLOORS).select("layer", "floor", *_round("share"))


@query(f"""WITH {EVAL_SQL}, floors AS (SELECT unnest([-0.1, 0.1]::DOUBLE[]) AS floor), keeps AS (SELECT unnest([20, 60, 200]) AS keep),
cut AS (SELECT floor, idx, score, relevant, row_number() OVER (PARTITION BY floor ORDER BY score DESC, idx) AS nth FROM eval, floors WHERE score >= floor), kept AS (SELECT floor, keep, idx, score, relevant FROM cut, keeps WHERE nth <= keep), {_metrics_sql('kept', 'floor, keep')}
SELECT floor, keep, n_relevant::BIGINT AS n_relevant, {_R('ap')} AS ap FROM metrics""")
def keep_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evals.keep_sweep(eval_rows(spark, d), [-0.1, 0.1], [20, 60, 200]).select("floor", "keep", "n_relevant", *_round("ap"))


@query(f"""WITH {EVAL_SQL}, weights AS (SELECT unnest([0.0, 0.5, 0.8, 1.0]::DOUBLE[]) AS weight), mixed AS (SELECT weight, idx, relevant, {_R('weight * score + (1 - weight) * old_score')} AS score FROM eval, weights), {_metrics_sql('mixed', 'weight')}
SELECT weight, {_R('ap')} AS ap, {_R('ndcg_at_10')} AS ndcg_at_10 FROM metrics""")
def blend_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = eval_rows(spark, d).withColumnRenamed("score", "new_score")
    return evals.blend_sweep(rows, [0.0, 0.5, 0.8, 1.0]).select("weight", *_round("ap", "ndcg_at_10"))


@query("""WITH one AS (SELECT DISTINCT text, sha256(text) AS h, lang AS layer FROM documents), first AS (SELECT h, min(layer) AS layer FROM one GROUP BY h), n AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY h) AS nth FROM first) SELECT layer, h FROM n WHERE nth <= 15""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return evals.stratified_sample(table(spark, d, "documents").select("text", "lang"), F.col("lang"), 15, "text").select("layer", "h")


@query("SELECT doc_id AS idx, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE quality END AS relevant FROM labels")
def label_patch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").alias("relevant"))
    return evals.apply_patch(rows, rows.filter("idx % 10 = 0").select("idx", F.lit(0).alias("relevant"))).select("idx", "relevant")


@query(f"WITH {LINKS_SQL} SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM candidates) AS links, (SELECT count(*) FROM events) AS decisions")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return analytics.run_summary(table(spark, d, "pages"), candidates(spark, d), table(spark, d, "events"))


@query("SELECT event_type AS ranker, count(*) AS n, count(*) FILTER (value < 100) AS dropped FROM events GROUP BY 1")
def ranker_histogram(spark: SparkSession, d: str) -> DataFrame:
    return analytics.ranker_histogram(table(spark, d, "events").select(F.col("event_type").alias("ranker"), (F.col("value") < 100).alias("dropped")))


@query(f"WITH h AS (SELECT {host_sql('url')} AS domain FROM pages) SELECT domain, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM pages) AS share FROM h GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def top_domains(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import urls

    return analytics.top_domains(table(spark, d, "pages").select(urls.host_of(F.col("url")).alias("domain")))


@query("SELECT quantile_disc(value, 0.1) AS p10, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events")
def priority_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return analytics.nearest_rank(table(spark, d, "events"), "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


_HITS = "hits AS (SELECT domain AS arm, seq, url_key, classification = 'RELEVANT' AND relevance_score >= 0.7 AS relevant FROM analyses)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return analyses(spark, d).select(F.col("domain").alias("arm"), "seq", "url_key", "lang", ((F.col("classification") == "RELEVANT") & (F.col("relevance_score") >= 0.7)).alias("relevant"))


@query(f"WITH {ANALYSES_SQL}, {_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY seq) AS nth FROM hits) SELECT arm, {', '.join(f'count(*) FILTER (nth <= {k} AND relevant) AS at_{k}' for k in (5, 10, 20, 50, 100))} FROM n WHERE nth <= 100 GROUP BY arm")
def hits_curve(spark: SparkSession, d: str) -> DataFrame:
    return evals.hits_curve(_hits(spark, d), ["arm"], [5, 10, 20, 50, 100])


_RUNS = "runs AS (SELECT lang AS arm, domain AS run, count(*) FILTER (classification = 'RELEVANT' AND relevance_score >= 0.7) AS hits FROM analyses GROUP BY ALL)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).groupBy(F.col("lang").alias("arm"), F.col("arm").alias("run")).agg(F.count_if("relevant").alias("hits"))


@query(f"WITH {ANALYSES_SQL}, {_RUNS}, m AS (SELECT arm, median(hits)::DOUBLE AS median, min(hits) AS least, max(hits) AS most FROM runs GROUP BY arm) SELECT arm, median, least, most, median - (SELECT median FROM m WHERE arm = 'en') AS delta FROM m")
def arm_medians(spark: SparkSession, d: str) -> DataFrame:
    return evals.arm_medians(_runs(spark, d), "en")


@query(f"WITH {ANALYSES_SQL}, {_RUNS}, b AS (SELECT run, hits AS ref FROM runs WHERE arm = 'en') SELECT arm, count(*) FILTER (hits > ref) AS wins, count(*) FILTER (hits < ref) AS losses, count(*) FILTER (hits = ref) AS ties FROM runs JOIN b USING (run) WHERE arm <> 'en' GROUP BY arm")
def arm_records(spark: SparkSession, d: str) -> DataFrame:
    return evals.arm_records(_runs(spark, d), "en")


_FOUND = "found AS (SELECT DISTINCT event_type AS arm, json_extract_string(props, '$.k') AS url FROM events)"


def _found(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("arm"), F.get_json_object("props", "$.k").alias("url"))


@query(f"WITH {_FOUND}, s AS (SELECT arm, count(*) AS n FROM found GROUP BY arm), p AS (SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS shared FROM found a JOIN found b USING (url) WHERE a.arm < b.arm GROUP BY ALL) SELECT arm_a, arm_b, shared, shared::DOUBLE / (x.n + y.n - shared) AS jaccard FROM p JOIN s x ON x.arm = arm_a JOIN s y ON y.arm = arm_b")
def arm_overlap(spark: SparkSession, d: str) -> DataFrame:
    return evals.arm_overlap(_found(spark, d))


@query(f"WITH {_FOUND} SELECT arm, count(*) AS n, count(*)::DOUBLE / (SELECT count(DISTINCT url) FROM found) AS recall FROM found GROUP BY arm")
def recall_proxy(spark: SparkSession, d: str) -> DataFrame:
    return evals.recall_proxy(_found(spark, d))


@query(f"""WITH {ANALYSES_SQL} SELECT url_key, relevance_score, classification, source AS canonical, lang AS title FROM (SELECT * FROM analyses WHERE classification = 'RELEVANT') a JOIN (SELECT 'd' || doc_id AS url_key, source FROM documents) USING (url_key) ORDER BY relevance_score DESC, url_key LIMIT 10""")
def inspect_top(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url_key"), F.col("source").alias("canonical"), F.col("lang").alias("title"))
    return analytics.best_pages(analyses(spark, d), pages).select("url_key", "relevance_score", "classification", "canonical", "title")


@query(f"WITH {ANALYSES_SQL} SELECT url_key, coalesce(source, '') AS url, coalesce(p.lang, '') AS title, classification, relevance_score, domain || ',' || a.lang AS tags FROM analyses a LEFT JOIN (SELECT 'd' || doc_id AS url_key, source, lang FROM documents WHERE lang <> 'es') p USING (url_key)")
def export_join(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").filter("lang != 'es'").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url_key"), F.col("source").alias("canonical"), F.col("lang").alias("title"), F.col("doc_id").alias("fetched_seq"))
    return store.export(analyses(spark, d).withColumn("tags", F.array("domain", "lang")), pages)


@query(f"WITH {ANALYSES_SQL} SELECT classification, count(*) AS n FROM analyses GROUP BY 1")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return analytics.class_histogram(analyses(spark, d))


@query(f"WITH {ANALYSES_SQL}, goals AS (SELECT source AS goal_id, min(doc_id) AS seq FROM documents GROUP BY source) SELECT goal_id, CASE WHEN seq = (SELECT min(seq) FROM goals) THEN 'original' ELSE 'replay' END AS role, (SELECT count(*) FROM analyses WHERE domain = goal_id) AS n FROM goals")
def goal_counts(spark: SparkSession, d: str) -> DataFrame:
    goals = table(spark, d, "documents").groupBy(F.col("source").alias("goal_id")).agg(F.min("doc_id").alias("seq"))
    return analytics.goal_counts(analyses(spark, d).withColumnRenamed("domain", "goal_id"), goals)


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) WHERE trim(coalesce(text, '')) <> ''")
def replay_worklist(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url_key")
    docs = table(spark, d, "documents").filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", key)
    judged = table(spark, d, "labels").select(key, F.lit("g").alias("goal_id"), F.lit("v1").alias("prompt_version"), F.lit("m").alias("model"))
    return store.unjudged(docs, judged, "g", "v1").select("doc_id")


@query("SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN quality IS NOT NULL THEN 'skipped' ELSE 'analyzed' END AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def replay_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return analytics.replay_report(docs.select(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("quality").isNotNull(), "skipped").otherwise("analyzed").alias("outcome")))


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM l WHERE nth = 1")
def latest_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("seq", F.struct("o_orderdate", "o_orderkey"))
    return store.latest(rows, ("o_custkey",)).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, count(*)::BIGINT AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY o_custkey")
def additive_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(1).cast("long").alias("n"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    sums = lambda df: df.groupBy("o_custkey").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    return store.add_up(sums(rows.filter("o_orderkey % 2 = 0")), sums(rows.filter("o_orderkey % 2 = 1")), ("o_custkey",), ("n", "cents"))


@query("SELECT event_id AS seq, event_type FROM events WHERE event_id > 500")
def event_tail(spark: SparkSession, d: str) -> DataFrame:
    return store.tail(table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), 500)


@query("SELECT max(event_id * 3) AS tokens, max(floor(value * 100)::BIGINT / 100)::DOUBLE AS time, count(*) FILTER (event_type = 'view') AS analyses FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup', 'error')")
def log_arm_stats(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    name = F.when(e == "view", "analysis.ok").otherwise("task.other")
    number = F.format_string("%.2f", F.floor(F.col("value") * 100) / 100)
    rows = table(spark, d, "events")
    lines = rows.select(F.concat(F.lit("info "), name, F.lit(" tokens=1")).alias("value")).union(rows.select(F.concat(F.lit("info task.done tokens="), (F.col("event_id") * 3).cast("string")))).union(rows.select(F.concat(F.lit("info fetch.ok elapsed="), number, F.lit("s"))))
    return analytics.arm_stats(analytics.log_fields(lines))


@query("SELECT DISTINCT json_extract_string(props, '$.k') AS url FROM events WHERE event_type IN ('view', 'click') AND json_extract_string(props, '$.k') NOT IN (SELECT json_extract_string(props, '$.k') FROM events WHERE event_type = 'purchase' AND user_id < 5)")
def judge_worklist(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "user_id", F.get_json_object("props", "$.k").alias("url"))
    return evals.judge_worklist([rows.filter(F.col("event_type") == e) for e in ("view", "click")], rows.filter("event_type = 'purchase' and user_id < 5"))


@query("SELECT vec_id AS idx, printf('%4d %s [%s] %s', vec_id, CASE WHEN label < 5 THEN '+' ELSE '-' END, label::VARCHAR, 'v' || vec_id) AS line FROM embeddings")
def review_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), (F.col("label") < 5).alias("relevant"), F.col("label").cast("string").alias("layer"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"))
    return evals.review_listing(rows)


@query("WITH a AS (SELECT event_type AS metric, count(*)::DOUBLE AS value FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, count(*)::DOUBLE AS value FROM events WHERE user_id % 2 = 1 GROUP BY 1) SELECT metric, a.value AS a, b.value AS b, b.value - a.value AS difference FROM a FULL JOIN b USING (metric)")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 2).alias("run")).agg(F.count("*").cast("double").alias("value")).withColumnRenamed("event_type", "metric")
    return analytics.compare_runs(rows.filter("run = 0"), rows.filter("run = 1"))
