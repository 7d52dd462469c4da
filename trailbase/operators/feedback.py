"""What judged pages teach: windows, hubs, topics, domain priors, multipliers.

Judgements: seq, domain, url, title, classification, relevance_score,
hub_score, topics, endorsed_links.  All are aggregates or windows by domain;
nothing is kept on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .running import last_rows, running
from .store import add_up

RECENT, HUBS, TOPICS, DOMAIN_WINDOW, RELEVANCE_WINDOW = 10, 5, 20, 3, 20
PRIOR_SUMS = ("times_relevant", "times_irrelevant", "sum_relevance")
HUB_FLOOR, BOOST, PENALTY, HUB_BOOST = 0.5, 1.2, 0.6, 1.5


def is_good(classification: Column) -> Column:
    return classification.isin("RELEVANT", "HUB")


def recent_relevant(judged: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n relevant pages, newest last."""
    last = judged.filter("classification = 'RELEVANT'").orderBy(F.desc("seq")).limit(n)
    return last.select("seq", "url", "title", F.round("relevance_score", 2).alias("relevance_score")).orderBy("seq")


def hub_pages(judged: DataFrame, floor: float = HUB_FLOOR) -> DataFrame:
    return judged.filter(F.col("hub_score") >= floor).select("url").distinct()


def top_hubs(judged: DataFrame, n: int = HUBS, floor: float = HUB_FLOOR) -> DataFrame:
    """Domains by their best hub score; of equals the one met first."""
    best = judged.filter(F.col("hub_score") >= floor).groupBy("domain").agg(F.max("hub_score").alias("hub_score"), F.min("seq").alias("first_seq"))
    return best.orderBy(F.desc("hub_score"), "first_seq").limit(n)


def top_topics(judged: DataFrame, n: int = TOPICS) -> DataFrame:
    """Topics by how often they occur; of equals the one met first."""
    each = judged.select("seq", F.posexplode("topics").alias("at", "topic"))
    return each.groupBy("topic").agg(F.count("*").alias("n"), F.min(F.struct("seq", "at")).alias("first")).orderBy(F.desc("n"), "first").limit(n).select("topic", "n")


def last_verdicts(judged: DataFrame, n: int = DOMAIN_WINDOW) -> DataFrame:
    """domain, and how many of its last n verdicts there are and are good.

    Ranks are cut at n within each task before the exchange.
    """
    order = Window.partitionBy("domain").orderBy(F.desc("seq"))
    last = judged.select("domain", "seq", is_good(F.col("classification")).alias("good")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)
    return last.groupBy("domain").agg(F.count("*").alias("seen"), F.count_if("good").alias("good"))


def domain_multipliers(judged: DataFrame, n: int = DOMAIN_WINDOW) -> DataFrame:
    """1.2 for domains whose last n verdicts are all good, 0.6 where none is, 1 where fewer than n are known or they differ."""
    full = F.col("seen") >= n
    return last_verdicts(judged, n).select("domain", F.when(full & (F.col("good") == n), BOOST).when(full & (F.col("good") == 0), PENALTY).otherwise(1.0).alias("multiplier"))


def rolling_verdicts(judged: DataFrame, n: int = DOMAIN_WINDOW) -> DataFrame:
    """The multiplier of each judgement's domain just after it; a domain's history is ordered in chunks, so that none has to fit a task."""
    counted = last_rows(judged, "domain", "seq", n, {"seen": F.lit(True), "good": is_good(F.col("classification"))})
    full = F.col("seen") >= n
    return counted.withColumn("multiplier", F.when(full & (F.col("good") == n), BOOST).when(full & (F.col("good") == 0), PENALTY).otherwise(1.0))


def prior_deltas(judged: DataFrame) -> DataFrame:
    """What a run adds to the stored priors: reg_domain, times_relevant, times_irrelevant and sum_relevance."""
    good = is_good(F.col("classification"))
    return judged.groupBy(F.col("domain").alias("reg_domain")).agg(F.count_if(good).alias("times_relevant"), F.count_if(~good).alias("times_irrelevant"), F.sum("relevance_score").alias("sum_relevance"))


def priors(judged: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Stored priors and what these judgements add to them."""
    delta = prior_deltas(judged)
    return delta if stored is None else add_up(stored, delta, ("reg_domain",), PRIOR_SUMS)


def prior_averages(priors: DataFrame) -> DataFrame:
    seen = F.col("times_relevant") + F.col("times_irrelevant")
    return priors.filter(seen > 0).select("reg_domain", scores.round4(F.col("sum_relevance") / seen).alias("average"))


def endorsed(judged: DataFrame) -> DataFrame:
    """Endorsed links (href) beside the page that endorses them."""
    return judged.select(F.col("url").alias("source_url"), F.explode("endorsed_links").alias("href"))


def steer(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """Priorities times the multiplier of the candidate's domain and of its source page, which may pass 1."""
    domains = domain_multipliers(judged).select(F.col("domain").alias("reg_domain"), F.col("multiplier").alias("by_domain"))
    hubs = hub_pages(judged).select(F.col("url").alias("source_url"), F.lit(HUB_BOOST).alias("by_hub"))
    out = candidates.join(domains, "reg_domain", "left").join(hubs, "source_url", "left")
    one = F.lit(1.0)
    return out.withColumn("priority", scores.round4(F.col("priority") * F.coalesce("by_hub", one) * F.coalesce("by_domain", one))).drop("by_domain", "by_hub")


def summary(judged: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row: relevant pages, hub domains and topics, as lists of bounded length, pages seen, and the prior of each domain judged here or stored."""
    recent = recent_relevant(judged).agg(F.array_sort(F.collect_list(F.struct("seq", "url", "title", "relevance_score"))).alias("relevant_pages"), F.lit(1).alias("one"))
    hubs = top_hubs(judged).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("hub_score"), "first_seq", "domain"))), lambda x: x["domain"]).alias("hub_domains"), F.lit(1).alias("one"))
    topics = top_topics(judged).agg(F.collect_list("topic").alias("topics"), F.lit(1).alias("one"))
    seen = judged.agg(F.count("*").alias("pages_seen"), F.lit(1).alias("one"))
    known = prior_averages(priors(judged, stored)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reg_domain", "average")))).alias("domain_priors"), F.lit(1).alias("one"))
    return seen.join(recent, "one").join(hubs, "one").join(topics, "one").join(known, "one").drop("one")


def relevance_window(judged: DataFrame, threshold: float = 0.7, n: int = RELEVANCE_WINDOW) -> DataFrame:
    """Of each task's judgements, at each how many of the last n there are and are relevant enough."""
    return last_rows(judged, "task_id", "seq", n, {"judged": F.lit(True), "relevant": F.col("relevance_score") >= threshold})


def stale_streak(pages: DataFrame, since: Column) -> DataFrame:
    """Of each task's dated pages, at each how many in a row up to it are older than ``since``; undated pages are passed over.

    The streak is the old pages so far, less those up to the last fresh page.
    """
    dated = pages.filter("published_at is not null").withColumn("old", F.col("published_at") < since)
    counted = running(dated, "task_id", "seq", {"n_old": F.col("old").cast("long")})
    reset = running(counted, "task_id", "seq", {}, {"at_fresh": F.when(~F.col("old"), F.col("n_old"))})
    return reset.withColumn("streak", F.col("n_old") - F.coalesce("at_fresh", F.lit(0))).drop("old", "n_old", "at_fresh")


def token_spend(calls: DataFrame, limit: int) -> DataFrame:
    """Of each task's model calls, at each the tokens so far and whether the budget is used up."""
    return running(calls, "task_id", "seq", {"total": F.col("tokens")}).withColumn("spent", (F.lit(limit) > 0) & (F.col("total") >= limit))
