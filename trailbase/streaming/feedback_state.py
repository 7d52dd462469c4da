"""What judged pages teach, folded batch by batch while a run goes on.

The state is one mergeable summary: the last n relevant pages, the best hub
score and the last verdicts of each domain, counts of topics, sums of priors,
hub pages, endorsed links, and the number of pages.  A batch adds its own
partial summary as a segment of each; segments are merged in tiers by the same
operation, so folding costs what the batch holds and reading what a few
segments hold.  A batch's manifest commits it; a batch that comes again changes
nothing, and one that broke off is written again under the same names.  Any cut
of the judgements into batches gives what the functions of ``feedback`` give
for all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import feedback
from ..plans.logs import Log, Manifests

#: Each part's columns.
PARTS = {
    "recent": "seq long, url string, title string, relevance_score double",
    "hubs": "domain string, hub_score double, first_seq long",
    "hub_pages": "url string",
    "topics": "topic string, n long, first struct<seq: long, at: int>",
    "windows": "domain string, last array<struct<seq: long, good: boolean>>",
    "priors": "reg_domain string, times_relevant long, times_irrelevant long, sum_relevance double",
    "endorsed": "source_url string, href string, seq long",
    "totals": "pages_seen long",
}


def _recent(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("seq")).limit(feedback.RECENT)


def _windows(rows: DataFrame) -> DataFrame:
    """The last verdicts of each domain, of lists that are no longer than the window each."""
    every = F.sort_array(F.flatten(F.collect_list("last")), asc=False)
    return rows.groupBy("domain").agg(F.slice(every, 1, feedback.DOMAIN_WINDOW).alias("last"))


#: How rows of several segments become one summary.
MERGE = {
    "recent": _recent,
    "hubs": lambda rows: rows.groupBy("domain").agg(F.max("hub_score").alias("hub_score"), F.min("first_seq").alias("first_seq")),
    "hub_pages": lambda rows: rows.distinct(),
    "topics": lambda rows: rows.groupBy("topic").agg(F.sum("n").alias("n"), F.min("first").alias("first")),
    "windows": _windows,
    "priors": lambda rows: rows.groupBy("reg_domain").agg(*[F.sum(c).alias(c) for c in feedback.PRIOR_SUMS]),
    "endorsed": lambda rows: rows,
    "totals": lambda rows: rows.agg(F.coalesce(F.sum("pages_seen"), F.lit(0)).alias("pages_seen")),
}


def partial(judged: DataFrame) -> dict[str, DataFrame]:
    """The summary of some judgements."""
    hub = judged.filter(F.col("hub_score") >= feedback.HUB_FLOOR)
    order = Window.partitionBy("domain").orderBy(F.desc("seq"))
    last = judged.select("domain", "seq", feedback.is_good(F.col("classification")).alias("good")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= feedback.DOMAIN_WINDOW)
    return {
        "recent": _recent(judged.filter("classification = 'RELEVANT'").select("seq", "url", "title", F.round("relevance_score", 2).alias("relevance_score"))),
        "hubs": hub.groupBy("domain").agg(F.max("hub_score").alias("hub_score"), F.min("seq").alias("first_seq")),
        "hub_pages": hub.select("url").distinct(),
        "topics": judged.select("seq", F.posexplode("topics").alias("at", "topic")).groupBy("topic").agg(F.count("*").alias("n"), F.min(F.struct("seq", "at")).alias("first")),
        "windows": last.groupBy("domain").agg(F.collect_list(F.struct("seq", "good")).alias("last")),
        "priors": feedback.prior_deltas(judged),
        "endorsed": judged.select(F.col("url").alias("source_url"), F.explode("endorsed_links").alias("href"), "seq"),
        "totals": judged.agg(F.count("*").alias("pages_seen")),
    }


class FeedbackFold:
    """The state under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, f"{self.path}/batches")
        self.batch = self.manifests.last()
        told = self.manifests.read(self.batch) if self.batch >= 0 else {}
        self.logs = {k: Log(spark, f"{self.path}/{k}", schema, segments=told.get(k)) for k, schema in PARTS.items()}

    def fold(self, judged: DataFrame, batch: int) -> bool:
        """Add a batch of judgements, whose numbers rise; false if it was there already."""
        if batch <= self.batch:
            return False
        judged = judged.persist()  # a batch, read once for each part
        try:
            for name, rows in partial(judged).items():
                columns = [f.name for f in self.logs[name].read([]).schema]
                self.logs[name].append(rows.select(*columns), f"b{batch}", batch)
        finally:
            judged.unpersist()
        for name, log in self.logs.items():
            log.merge(batch, lambda rows, since, merge=MERGE[name]: merge(rows).select(*rows.columns))
        self.manifests.commit(batch, {k: log.segments for k, log in self.logs.items()})
        self.batch = batch
        return True

    def part(self, name: str) -> DataFrame:
        return MERGE[name](self.logs[name].read())

    def recent_relevant(self) -> DataFrame:
        return self.part("recent").orderBy("seq")

    def top_hubs(self, n: int = feedback.HUBS) -> DataFrame:
        return self.part("hubs").orderBy(F.desc("hub_score"), "first_seq").limit(n)

    def top_topics(self, n: int = feedback.TOPICS) -> DataFrame:
        return self.part("topics").orderBy(F.desc("n"), "first").limit(n).select("topic", "n")

    def domain_multipliers(self) -> DataFrame:
        seen, good, n = F.size("last"), F.size(F.filter("last", lambda v: v["good"])), feedback.DOMAIN_WINDOW
        full = seen >= n
        return self.part("windows").select("domain", F.when(full & (good == n), feedback.BOOST).when(full & (good == 0), feedback.PENALTY).otherwise(1.0).alias("multiplier"))

    def hub_pages(self) -> DataFrame:
        return self.part("hub_pages")

    def prior_averages(self) -> DataFrame:
        return feedback.prior_averages(self.part("priors"))

    def endorsed(self) -> DataFrame:
        return self.part("endorsed")

    def pages_seen(self) -> int:
        return self.part("totals").first()["pages_seen"]

    def follow(self, judgements: DataFrame, checkpoint: str) -> None:
        """Fold what a stream of judgements has now, a micro-batch at a time, and stop."""
        judgements.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.fold).trigger(availableNow=True).start().awaitTermination()


def merged(folds: list[FeedbackFold], name: str) -> DataFrame:
    """A part of several runs' states together."""
    return MERGE[name](reduce(DataFrame.unionByName, [f.logs[name].read() for f in folds]))
