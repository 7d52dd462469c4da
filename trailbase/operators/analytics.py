"""Read-only questions over a finished run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import selection


def class_histogram(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("classification").agg(F.count("*").alias("n"))


def best_pages(analyses: DataFrame, pages: DataFrame, n: int = 10) -> DataFrame:
    """The n best pages by relevance: relevant ones, or all if there are none; the first best row of a key counts."""
    flagged = analyses.withColumn("level", (F.col("classification") == "RELEVANT").cast("int"))
    best = flagged.groupBy("url_key").agg(F.max_by(F.struct("level", "relevance_score", "classification"), F.struct("level", "relevance_score", -F.col("seq"))).alias("b")).select("url_key", "b.*")
    top = best.orderBy(F.desc("level"), F.desc("relevance_score"), "url_key").limit(n)
    any_relevant = Window.partitionBy(F.lit(1))  # over the n rows of the result
    top = top.withColumn("any", F.max("level").over(any_relevant)).filter("level = any").drop("any", "level")
    return top.join(pages.select("url_key", "canonical", "title"), "url_key", "left")


def goal_counts(analyses: DataFrame, goals: DataFrame) -> DataFrame:
    """Analyses of each goal, and whether the goal is the original one or of a replay."""
    first = goals.agg(F.min("seq").alias("first_seq")).withColumn("one", F.lit(1))
    counts = analyses.groupBy("goal_id").agg(F.count("*").alias("n"))
    roles = goals.withColumn("one", F.lit(1)).join(F.broadcast(first), "one").select("goal_id", F.when(F.col("seq") == F.col("first_seq"), "original").otherwise("replay").alias("role"))
    return roles.join(counts, "goal_id", "left").select("goal_id", "role", F.coalesce("n", F.lit(0)).alias("n"))


def replay_report(worklist: DataFrame) -> DataFrame:
    """Counts of a work-list by outcome."""
    return worklist.groupBy("outcome").agg(F.count("*").alias("n"))


def run_summary(pages: DataFrame, links: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: pages, links and decisions."""
    count = lambda df, name: df.agg(F.count("*").alias(name), F.lit(1).alias("one"))
    return count(pages, "pages").join(count(links, "links"), "one").join(count(decisions, "decisions"), "one").drop("one")


def ranker_histogram(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("ranker").agg(F.count("*").alias("n"), F.count_if("dropped").alias("dropped"))


def top_domains(pages: DataFrame, n: int = 10) -> DataFrame:
    """Domains by pages, and their share of all."""
    counts = pages.groupBy("domain").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    total = pages.agg(F.count("*").alias("total"), F.lit(1).alias("one"))
    return counts.orderBy(F.desc("n"), "domain").limit(n).join(F.broadcast(total), "one").select("domain", "n", (F.col("n") / F.col("total")).alias("share"))


def nearest_rank(values: DataFrame, column: str, points: dict[str, float]) -> DataFrame:
    """The least value that so many of the column's values don't pass, for each share."""
    return selection.discrete_percentiles(values, [], column, points)


def report(rounds: DataFrame, audit: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row on a run: pages, links found, kept and queued, tokens and seconds from what its rounds counted, dropped links by reason, analyses by class."""
    one = F.lit(1).alias("one")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counted = rounds.agg(F.count("*").alias("rounds"), *[total(c).alias(k) for k, c in (("pages", "popped"), ("links_found", "found"), ("links_kept", "kept"), ("links_queued", "added"), ("tokens", "tokens"), ("seconds", "seconds"))], one)
    tally = lambda rows, by, name: rows.groupBy(by).agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col(by).alias("key")))).alias(name), one)  # noqa: E731  a row for each rule or class
    both = counted.join(tally(audit.filter("drop_reason is not null"), "drop_reason", "drops"), "one").join(tally(analyses.filter("outcome = 'ok'"), "classification", "classes"), "one")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat((-x["less"]).cast("string"), F.lit(" "), x["key"])), ", ")
    return both.select("rounds", "pages", "links_found", "links_kept", "links_queued", "tokens", "seconds", text("drops").alias("drops"), text("classes").alias("classes"))


def report_lines(row: dict, state: str, reason: str) -> str:
    """The report as aligned lines; what did not happen has no line."""
    lines = [f"walk ended: {state} ({reason or 'none'})", f"  pages:      {row['pages']} in {row['rounds']} rounds", f"  links:      {row['links_found']} found, {row['links_kept']} kept, {row['links_queued']} queued"]
    for name, key in (("dropped", "drops"), ("analyses", "classes")):
        if row[key]:
            lines.append(f"  {name + ':':<11} {row[key]}")
    if row["tokens"]:
        lines.append(f"  tokens:     {row['tokens']}")
    return "\n".join([*lines, f"  duration:   {row['seconds']:.1f}s"])


def log_fields(lines: DataFrame) -> DataFrame:
    """event, tokens and elapsed of structured log lines."""
    number = lambda key, kind: F.regexp_extract("value", rf"{key}=([0-9.]+)", 1).try_cast(kind)
    return lines.select(F.regexp_extract("value", r"([a-z_]+\.[a-z_]+)", 1).alias("event"), number("tokens", "long").alias("tokens"), number("elapsed", "double").alias("elapsed"))


def arm_stats(fields: DataFrame) -> DataFrame:
    """One row: tokens of the finished task, the latest elapsed time of a fetch, analyses."""
    return fields.agg(F.coalesce(F.max(F.when(F.col("event") == "task.done", F.col("tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.max(F.when(F.col("event") == "fetch.ok", F.col("elapsed"))), F.lit(0.0)).alias("time"), F.count_if(F.col("event") == "analysis.ok").alias("analyses"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of (metric, value) side by side with their difference; a metric of one side alone stays."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full")
    return both.select("metric", "a", "b", (F.col("b") - F.col("a")).alias("difference"))


def as_metrics(row: DataFrame) -> DataFrame:
    """A one-row summary as (metric, value)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("m")).select("m.*")
