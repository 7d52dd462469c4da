"""Analyses that are asked for again later: pages whose analysis failed wait, and come back when they are due.

All pages that fail in one step are due at one time, so the queue is a list of
segments by due time: a step reads the segments that are due and no others, and
what fails again becomes the newest one.  Results and segments are files in a
shared folder; a manifest commits a step, so a queue that broke off goes on
after its last step.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.logs import Manifests, observed
from ..shared import shared_folder
from .analyze import ATTEMPTS, Goal, analyze

DELAY = 60.0
PARKED = "url_key string, attempts int"
#: Errors that later attempts can't mend.
FINAL = ("BudgetExceededError",)


class AnalysisQueue:
    """Analyses of a run's pages for one goal: each page is asked for up to ``attempts`` times, ``delay`` seconds apart."""

    def __init__(self, spark: SparkSession, goal: Goal, model: Callable[[str], str], path: str | None = None, attempts: int = ATTEMPTS, delay: float = DELAY, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, **given):
        self.spark, self.goal, self.model, self.path = spark, goal, model, path or shared_folder(spark, "analyses")
        self.attempts, self.delay, self.clock, self.sleep, self.given = attempts, delay, clock, sleep, given
        self.manifests = Manifests(spark, f"{self.path}/steps")
        last = self.manifests.last()
        told = self.manifests.read(last) if last >= 0 else {}
        self.step_number, self.parked, self.settled = last + 1, [tuple(p) for p in told.get("parked", [])], told.get("settled", [])

    def results(self) -> DataFrame:
        """All settled analyses: outcome ok, empty or failed, with the attempt that settled them."""
        none = analyze(self.spark.createDataFrame([], "url_key string, canonical string, title string, plain_text string"), self.goal, lambda prompt: "").schema
        return self.spark.read.schema(none).parquet(*(f"{self.path}/{name}" for name in self.settled)).filter("outcome != 'parked'") if self.settled else self.spark.createDataFrame([], none)

    def waiting(self) -> int:
        return sum(rows for _, _, rows in self.parked)

    def next_due(self) -> float | None:
        return min((due for _, due, _ in self.parked), default=None)

    def step(self, new: DataFrame | None, pages: DataFrame) -> DataFrame:
        """Ask once for new pages and for those due; returns this step's settled analyses.

        new: pages as ``analyze`` takes them; pages: where those that wait are
        found again by url_key.
        """
        now, number = self.clock(), self.step_number
        due = [p for p in self.parked if p[1] <= now]
        work = None if new is None else new.withColumn("tried_", F.lit(0))
        if due:
            back = self.spark.read.schema(PARKED).parquet(*(f"{self.path}/{name}" for name, *_ in due))
            again = pages.join(back.withColumnRenamed("attempts", "tried_"), "url_key")
            work = again if work is None else work.unionByName(again.select(*work.columns))
        if work is None:
            return self.results().limit(0)
        found = analyze(work, self.goal, self.model, attempts=1, **self.given).drop("attempt")
        tried = work.select("url_key", (F.col("tried_") + 1).alias("attempt"))
        lasting = F.coalesce(F.col("error").rlike(rf"^({'|'.join(FINAL)})\b"), F.lit(False))
        outcome = F.when((F.col("outcome") == "failed") & (F.col("attempt") < self.attempts) & ~lasting, "parked").otherwise(F.col("outcome"))
        rows = found.join(tried, "url_key").withColumn("outcome", outcome)
        rows = rows.select(*[c for c in found.columns if c != "error"], "attempt", "error")
        got = observed(rows, f"{self.path}/step{number}", parked=F.count_if(F.col("outcome") == "parked"))
        kept = self.spark.read.schema(rows.schema).parquet(f"{self.path}/step{number}")
        left = [p for p in self.parked if p not in due]
        if got["parked"]:
            observed(kept.filter("outcome = 'parked'").select("url_key", F.col("attempt").alias("attempts")), f"{self.path}/parked{number}")
            left.append((f"parked{number}", now + self.delay, got["parked"]))
        self.parked, self.settled, self.step_number = left, [*self.settled, f"step{number}"], number + 1
        self.manifests.commit(number, {"parked": left, "settled": self.settled})
        return kept.filter("outcome != 'parked'")

    def drain(self, pages: DataFrame) -> None:
        """Wait until every page is settled."""
        while self.parked:
            self.sleep(max(0.0, self.next_due() - self.clock()))
            self.step(None, pages)
