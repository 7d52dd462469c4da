"""Ranking metrics and the experiments around them.

Rows: group columns (perhaps none), idx, score, relevant.  Ranks go by score,
higher first, and then by idx; a missing score is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running
from .selection import percentiles  # noqa: F401  a metric like the others here

NDCG_AT, PRECISION_AT, RECALL_AT = (5, 10, 50), (5, 10), (60, 100)


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with gain, rank, and hits (gains up to the rank).

    Scores are cut into bands a ten-thousandth wide: what lies before a band is
    a total over bands, so no task has to order a whole ranking.
    """
    scored = rows.withColumns({"score": F.coalesce("score", F.lit(0.0)), "gain": F.col("relevant").cast("int")})
    return running(scored, by, "idx", {"rank": F.lit(1), "hits": F.col("gain")}, chunk=-F.floor(F.col("score") * 10_000), order=[F.desc("score"), "idx"])


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """For each group ndcg@k, p@k, recall@k and ap; binary gains."""
    own = ranked(rows, by)
    dcg = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    hits = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("gain")).otherwise(0))
    relevant = F.sum("gain")
    grouped = own.groupBy(*by).agg(
        relevant.alias("n_relevant"), *[dcg(k).alias(f"dcg{k}") for k in NDCG_AT], *[(hits(k) / k).alias(f"p_at_{k}") for k in PRECISION_AT],
        *[hits(k).alias(f"hits{k}") for k in RECALL_AT], F.sum(F.when(F.col("gain") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
    )
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = F.col("n_relevant") > 0
    return grouped.select(
        *by, "n_relevant", *[F.when(some, F.col(f"dcg{k}") / ideal(k)).otherwise(0.0).alias(f"ndcg_at_{k}") for k in NDCG_AT], *[f"p_at_{k}" for k in PRECISION_AT],
        *[F.when(some, F.col(f"hits{k}") / F.col("n_relevant")).otherwise(0.0).alias(f"recall_at_{k}") for k in RECALL_AT], F.when(some, F.col("ap_sum") / F.col("n_relevant")).otherwise(0.0).alias("ap"),
    )


def grid(rows: DataFrame, name: str, values: list) -> DataFrame:
    """Each row once for each value of a parameter, a bounded list."""
    return rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def floor_survival(rows: DataFrame, by: list[str], value: str, floors: list[float]) -> DataFrame:
    """Of each group, the share at or above each floor."""
    return grid(rows, "floor", floors).groupBy(*by, "floor").agg(F.avg((F.col(value) >= F.col("floor")).cast("double")).alias("share"))


def keep_sweep(rows: DataFrame, floors: list[float], keeps: list[int]) -> DataFrame:
    """Average precision of what a similarity floor and a top-keep leave, relative to all that is relevant there."""
    scored = ranked(grid(rows, "floor", floors).filter(F.col("score") >= F.col("floor")), ["floor"])
    kept = grid(scored, "keep", keeps).filter(F.col("rank") <= F.col("keep")).select("floor", "keep", "idx", "score", "relevant")
    return metrics(kept, ["floor", "keep"]).select("floor", "keep", "n_relevant", "ap")


def blend_sweep(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Metrics of weight * new_score + (1 - weight) * old_score."""
    mixed = grid(rows, "weight", weights).withColumn("score", F.floor((F.col("weight") * F.col("new_score") + (1 - F.col("weight")) * F.col("old_score")) * 10000 + 0.5) / 10000)
    return metrics(mixed, ["weight"])


def stratified_sample(rows: DataFrame, layer: Column, per_layer: int, key: str) -> DataFrame:
    """The rows of least hash in each layer, a key once only; a null layer is left out."""
    one = rows.withColumn("layer", layer).filter("layer is not null").withColumn("h", F.sha2(F.col(key), 256))
    one = one.groupBy("h").agg(F.min(F.struct("layer", *[F.col(c) for c in rows.columns])).alias("r")).select("h", "r.*")
    order = Window.partitionBy("layer").orderBy("h")
    return one.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_layer)


def apply_patch(rows: DataFrame, patch: DataFrame) -> DataFrame:
    """Labels (idx, relevant) replaced by those of a patch."""
    return rows.join(patch.select("idx", F.col("relevant").alias("mended")), "idx", "left").withColumn("relevant", F.coalesce("mended", "relevant")).drop("mended")


def hits_curve(rows: DataFrame, by: list[str], points: list[int]) -> DataFrame:
    """Relevant pages among the first k of each group, in the order of seq."""
    order = Window.partitionBy(*by).orderBy("seq")
    first = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max(points))
    return first.groupBy(*by).agg(*[F.count_if((F.col("nth") <= k) & F.col("relevant")).alias(f"at_{k}") for k in points])


def arm_medians(runs: DataFrame, base: str) -> DataFrame:
    """Median, least and most hits of each arm, and the median's distance from the base arm's."""
    own = runs.groupBy("arm").agg(F.median("hits").alias("median"), F.min("hits").alias("least"), F.max("hits").alias("most"), F.lit(1).alias("one"))
    ref = own.filter(F.col("arm") == base).select(F.col("median").alias("ref"), "one")
    return own.join(F.broadcast(ref), "one").select("arm", "median", "least", "most", (F.col("median") - F.col("ref")).alias("delta"))


def arm_records(runs: DataFrame, base: str) -> DataFrame:
    """Wins, losses and ties of each arm against the base arm, run by run."""
    ref = runs.filter(F.col("arm") == base).select("run", F.col("hits").alias("ref"))
    both = runs.filter(F.col("arm") != base).join(ref, "run")
    return both.groupBy("arm").agg(F.count_if(F.col("hits") > F.col("ref")).alias("wins"), F.count_if(F.col("hits") < F.col("ref")).alias("losses"), F.count_if(F.col("hits") == F.col("ref")).alias("ties"))


def arm_overlap(found: DataFrame) -> DataFrame:
    """Jaccard overlap of what each two arms found (arm, url); pairs of arms share urls through a join on url."""
    one = found.select("arm", "url").distinct()
    sizes = one.groupBy("arm").agg(F.count("*").alias("n"))
    a, b = one.withColumnRenamed("arm", "arm_a"), one.withColumnRenamed("arm", "arm_b")
    shared = a.join(b, "url").filter("arm_a < arm_b").groupBy("arm_a", "arm_b").agg(F.count("*").alias("shared"))
    out = shared.join(sizes.select(F.col("arm").alias("arm_a"), F.col("n").alias("n_a")), "arm_a").join(sizes.select(F.col("arm").alias("arm_b"), F.col("n").alias("n_b")), "arm_b")
    return out.select("arm_a", "arm_b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def recall_proxy(found: DataFrame) -> DataFrame:
    """Of all that any arm found, each arm's share."""
    one = found.select("arm", "url").distinct()
    total = one.agg(F.countDistinct("url").alias("total"), F.lit(1).alias("k"))
    return one.groupBy("arm").agg(F.count("*").alias("n"), F.lit(1).alias("k")).join(F.broadcast(total), "k").select("arm", "n", (F.col("n") / F.col("total")).alias("recall"))


def judge_worklist(arms: list[DataFrame], judged: DataFrame) -> DataFrame:
    """Pages (url) that any arm fetched and no one has judged."""
    every = arms[0].select("url")
    for arm in arms[1:]:
        every = every.union(arm.select("url"))
    return every.distinct().join(judged.select("url"), "url", "left_anti")


def review_listing(rows: DataFrame) -> DataFrame:
    """One line for each labelled row."""
    mark = F.when(F.col("relevant"), "+").otherwise("-")
    return rows.select("idx", F.format_string("%4d %s [%s] %s", F.col("idx"), mark, F.col("layer"), F.coalesce("text", F.lit(""))).alias("line"))
