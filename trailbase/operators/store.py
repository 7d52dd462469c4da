"""Tables of runs: append-only files, the latest row of each key, additive totals, tails, caches.

A run writes Parquet under ``root/table/run_id=...``; an upsert is an append
and a view of the latest row, so writers never rewrite what others read.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import delete_at_exit, keep, shared_folder

#: The tables of a run and their keys; events and errors only grow.
KEYS = {"crawl_goals": ("goal_id",), "crawl_tasks": ("task_id",), "pages": ("page_id",), "rounds": ("round",), "links": ("candidate_id",), "rank_decisions": ("candidate_id", "ranker"), "analyses": ("url_key", "goal_id", "prompt_version", "model"), "frontier_snapshots": ("snapshot_id",), "robots_cache": ("domain",), "events": (), "errors": ()}
EVENTS = ("TASK_CREATED", "TASK_STARTED", "TASK_STOPPED", "TASK_COMPLETED", "URL_DISCOVERED", "CANDIDATE_FILTERED", "CANDIDATE_BUFFERED", "CANDIDATE_DROPPED", "URL_ENQUEUED", "URL_FETCHED", "PAGE_EXTRACTED", "PAGE_ANALYZED", "RANK_BATCH")


def latest(rows: DataFrame, keys: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """The last row of each key; partial maxima before the exchange."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), seq).alias("row")).select("row.*")


def add_up(stored: DataFrame, delta: DataFrame, keys: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """Stored totals and a delta as new totals."""
    columns = [*keys, *sums]
    return stored.select(*columns).unionByName(delta.select(*columns)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def tail(events: DataFrame, after: int, task_id: str | None = None) -> DataFrame:
    """Events past a sequence number; the filter reaches the scan."""
    rows = events.filter(F.col("seq") > after)
    return rows if task_id is None else rows.filter(F.col("task_id") == task_id)


def unjudged(pages: DataFrame, analyses: DataFrame, goal_id: str, prompt_version: str, model: str = "") -> DataFrame:
    """Pages without an analysis of this identity; an empty model stands for any."""
    own = analyses.filter((F.col("goal_id") == goal_id) & (F.col("prompt_version") == prompt_version))
    own = own if model == "" else own.filter(F.col("model") == model)
    return pages.join(own.select("url_key"), "url_key", "left_anti")


class RunStore:
    """The tables of runs under one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, table: str, run_id: str, rows: DataFrame) -> None:
        """Add rows of a run; rows without seq get one of their own that grows within the batch and past every batch before.

        The batch is written once to the shared folder, so that its rows are
        numbered by the counts of its tasks and no task has to see them all.
        """
        if table not in KEYS:
            raise ValueError(f"no such table: {table}")
        if "seq" not in rows.columns:
            rows = self._numbered(table, rows)
        rows.write.mode("append").parquet(f"{self.root}/{table}/run_id={run_id}")

    def _numbered(self, table: str, rows: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, "batch")
        delete_at_exit(self.spark, path)
        batch = keep(rows.withColumn("row_", F.monotonically_increasing_id()), f"{path}/rows").withColumn("task_", F.shiftright("row_", 33))
        sizes = batch.groupBy("task_").agg(F.count("*").alias("n"))
        before = sizes.withColumn("before_", F.sum("n").over(Window.orderBy("task_").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        last = self.spark.read.parquet(f"{self.root}/{table}").agg(F.max("seq")).first()[0] if where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where) else None
        first = max(time.time_ns() // 1000, (last or 0) + 1)
        number = F.lit(first) + F.coalesce("before_", F.lit(0)) + F.col("row_").bitwiseAND((1 << 33) - 1)
        return batch.join(before.hint("merge"), "task_").withColumn("seq", number).drop("row_", "task_", "before_")

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """Current rows: the latest of each key, or all of an append-only table; one run's partition alone if named."""
        rows = self.spark.read.option("basePath", f"{self.root}/{table}").option("mergeSchema", "true").parquet(f"{self.root}/{table}")
        rows = rows if run_id is None else rows.filter(F.col("run_id") == run_id)
        if not KEYS[table]:
            return rows
        return latest(rows, ("run_id", *KEYS[table]))

    def has(self, table: str, run_id: str | None = None) -> bool:
        """Whether a table, or a run's part of it, has been written."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}" + ("" if run_id is None else f"/run_id={run_id}"))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def priors(self) -> DataFrame:
        """Priors of domains: what all runs have added, summed."""
        if not self.has("domain_priors"):
            return self.spark.createDataFrame([], "reg_domain string, times_relevant long, times_irrelevant long, sum_relevance double")
        rows = self.spark.read.parquet(f"{self.root}/domain_priors")
        return rows.groupBy("reg_domain").agg(*[F.sum(c).alias(c) for c in ("times_relevant", "times_irrelevant", "sum_relevance")])

    def add_priors(self, run_id: str, deltas: DataFrame) -> None:
        """Flush what a run adds to the priors, once for each run."""
        deltas.write.mode("overwrite").parquet(f"{self.root}/domain_priors/run_id={run_id}")

    def latest_run(self, task_id: str) -> str | None:
        """The newest run that has the task."""
        row = self.read("crawl_tasks").filter(F.col("task_id") == task_id).agg(F.max("run_id").alias("run_id")).first()
        return row and row["run_id"]


def walk_events(task_id: str, visited: DataFrame, audit: DataFrame, why: str) -> DataFrame:
    """The event log of a walk: task_id, type, key, payload and round; ``RunStore.append`` numbers them in the order of their rounds."""
    event = lambda rows, kind, key, payload: rows.select(F.lit(task_id).alias("task_id"), F.lit(kind).alias("type"), F.col(key).alias("key"), payload.alias("payload"), F.col("round").cast("long").alias("round"))
    reason = F.to_json(F.struct("drop_reason", "source_url_key"))
    ends = visited.agg(F.min("round").alias("first"), F.max("round").alias("last"))
    frame = ends.select(F.explode(F.array(F.struct(F.lit("TASK_STARTED").alias("type"), F.coalesce("first", F.lit(0)).alias("round")), F.struct(F.lit("TASK_COMPLETED").alias("type"), F.coalesce("last", F.lit(0)).alias("round")))).alias("e"))
    frame = frame.select(F.lit(task_id).alias("task_id"), "e.type", F.lit(None).cast("string").alias("key"), F.to_json(F.struct(F.lit(why).alias("reason"))).alias("payload"), F.col("e.round").cast("long").alias("round"))
    found = event(audit, "URL_DISCOVERED", "url_key", reason)
    kept, dropped = event(audit.filter("drop_reason is null"), "CANDIDATE_BUFFERED", "url_key", reason), event(audit.filter("drop_reason is not null"), "CANDIDATE_FILTERED", "url_key", reason)
    return found.union(kept).union(dropped).union(event(visited, "URL_FETCHED", "url_key", F.to_json(F.struct("depth", "priority")))).union(frame).orderBy("round")


def export(analyses: DataFrame, pages: DataFrame) -> DataFrame:
    """Analyses with the last page of their key, in rows ready for CSV or JSON."""
    last = latest(pages, ("url_key",), "fetched_seq").select("url_key", "canonical", "title")
    return analyses.join(last, "url_key", "left").select("url_key", F.coalesce("canonical", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), "classification", "relevance_score", F.array_join("tags", ",").alias("tags"))


def write_export(rows: DataFrame, path: str, kind: str) -> None:
    """As csv with a header, or as json."""
    writer = rows.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path)}[kind]()
