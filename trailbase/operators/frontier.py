"""The frontier and the buffer as tables, and a round of the traversal as set operations.

State is a table of items: url_key, priority, reg_domain, depth,
next_available_at, enqueued_at, seq.  Popping one item at a time from a heap
becomes choosing the first n of what is eligible; n = 1 is strict best-first.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGING_WINDOW, AGE_FACTOR = 600, 1.0
CAPACITY, BATCH, MAX_WAIT = 2000, 100, 30


def effective_priority(now: Column, age_factor: float = AGE_FACTOR, window: int = AGING_WINDOW) -> Column:
    """Priority and what waiting adds to it."""
    waited = F.greatest(F.lit(0.0), F.unix_micros(now) - F.unix_micros("enqueued_at")) / 1e6
    return F.col("priority") + F.lit(age_factor) * waited / F.lit(window)


def push(frontier: DataFrame, items: DataFrame, visited: DataFrame) -> DataFrame:
    """The frontier with items that are neither queued nor visited, the first of each key by seq."""
    first = Window.partitionBy("url_key").orderBy("seq")
    fresh = items.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    fresh = fresh.join(visited.select("url_key"), "url_key", "left_anti").join(frontier.select("url_key"), "url_key", "left_anti")
    return frontier.unionByName(fresh.select(*frontier.columns))


def eligible(frontier: DataFrame, now: Column, domains: DataFrame, domain_budget: int) -> DataFrame:
    """Items whose own gate and whose domain's gate are open, as many of each domain as its budget has left.

    domains: reg_domain, allowed_at, used.  The rank within a domain is over
    the priority and then seq; of a domain only ``domain_budget`` rows take
    part in the sort, as each task drops the rest by itself.
    """
    gated = frontier.join(domains, "reg_domain", "left").filter((F.col("next_available_at") <= now) & (F.coalesce("allowed_at", F.to_timestamp(F.lit("1970-01-01"))) <= now))
    order = Window.partitionBy("reg_domain").orderBy(F.desc("priority"), "seq")
    ranked = gated.withColumn("in_domain", F.row_number().over(order)).filter(F.col("in_domain") <= domain_budget)
    return ranked.filter(F.col("in_domain") + F.coalesce("used", F.lit(0)) <= domain_budget)


def pop(frontier: DataFrame, now: Column, domains: DataFrame, domain_budget: int, n: int, global_left: int | None = None, by_age: bool = False) -> DataFrame:
    """The next items, in order: by the stored priority, or by the effective one; no more than the run has left."""
    n = n if global_left is None else max(0, min(n, global_left))
    aged = eligible(frontier, now, domains, domain_budget).withColumn("effective", effective_priority(now))
    first = F.desc("effective") if by_age else F.desc("priority")
    return aged.orderBy(first, "seq").limit(n)


def gate_state(now: Column) -> Column:
    """Whether an item is ready or cooling down."""
    return F.when(F.col("next_available_at") > now, F.lit("pending")).otherwise(F.lit("ready"))


def release(frontier: DataFrame, now: Column) -> DataFrame:
    """Cooled-down items come back with their aged priority; waiting counts on from here."""
    back = (F.col("next_available_at") <= now) & (F.col("status") == "pending")
    return frontier.withColumns({"priority": F.when(back, effective_priority(now)).otherwise(F.col("priority")), "status": F.when(back, "ready").otherwise(F.col("status"))})


def outcomes(visited: DataFrame, done: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visited keys, and completed counts of each domain, after results (url_key, reg_domain, status)."""
    keys = visited.select("url_key").union(results.select("url_key")).distinct()
    more = results.filter("status = 'COMPLETED'").groupBy("reg_domain").agg(F.count("*").alias("domain_done"))
    return keys, done.select("reg_domain", "domain_done").union(more).groupBy("reg_domain").agg(F.sum("domain_done").alias("domain_done"))


def quality(depth: Column, position: Column) -> Column:
    return -0.1 * depth - 0.001 * position


def buffer_keep(candidates: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What a full buffer would hold: the first arrival of each key, and of those the best ``capacity``, earlier ones before equal ones.

    Keys that found no place count as seen, as they would in a buffer filled
    one by one.  The best are a bounded top-n over partial top-ns.
    """
    first = candidates.groupBy("url_key").agg(F.min_by(F.struct("depth", "position", "arrival"), "arrival").alias("c")).select("url_key", "c.*")
    return first.withColumn("quality", quality(F.col("depth"), F.col("position"))).orderBy(F.desc("quality"), "arrival").limit(capacity)


def drain(buffer: DataFrame, n: int = BATCH) -> DataFrame:
    """The n that have waited longest."""
    return buffer.orderBy("arrival").limit(n)


def buffer_ready(size: int, since_last_add: datetime.timedelta, hungry: bool, batch: int = BATCH, max_wait: int = MAX_WAIT) -> bool:
    """Whether a batch should be ranked now: it is full, or has waited, or the frontier has nothing."""
    return size >= batch or (size > 0 and (hungry or since_last_add.total_seconds() > max_wait))
