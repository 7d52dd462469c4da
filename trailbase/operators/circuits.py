"""Back-off and circuit breaker of each domain, as an associative scan over responses.

A response turns a domain's state (fails, next_allowed, open_until) into the
next one, and what a stretch of responses does to a state is known without the
state but for one number, the fails it begins with: a stretch with a 2xx ends
with the bad responses since its last 2xx, another one adds its own to those
before; its last bad response sets the gate, its last one at the threshold or
beyond opens the circuit.  So stretches compose.  Responses are dealt out in
ranges of (domain, ts, seq), which cut a domain with many of them; each range is
summed up as one row for each domain, the rows of a domain are composed in
order, and what comes before a range is carried into it.  No task holds a domain.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import delete_at_exit, keep, shared_folder

THRESHOLD, COOLDOWN, MOST_BACKOFF = 5, 600, 300
#: 2 ** 9 is more than MOST_BACKOFF, so larger counts need no power.
MOST_POWER = 9
KEYS = ["domain", "chunk"]


def _gate(ts: Column, fails: Column) -> Column:
    wait = F.least(F.pow(F.lit(2.0), F.least(fails, F.lit(MOST_POWER))), F.lit(float(MOST_BACKOFF))).cast("int")
    return ts + F.make_interval(secs=wait)


def _after(ts: Column, seconds: Column | int) -> Column:
    return ts + F.make_interval(secs=F.lit(seconds) if isinstance(seconds, int) else seconds)


def _marked(responses: DataFrame, ranges: int | None) -> DataFrame:
    """Responses in ranges (chunk), written, each with bad, run (2xx before it or at it in its range) and the bad ones of its run so far."""
    spark = responses.sparkSession
    rows = responses if "crawl_delay" in responses.columns else responses.withColumn("crawl_delay", F.lit(0))
    rows = rows.withColumns({"bad": F.coalesce(F.col("status").isin(429, 503), F.lit(False)), "good": F.coalesce(F.col("status").between(200, 299), F.lit(False))})
    ranged = rows.repartitionByRange("domain", "ts", "seq") if ranges is None else rows.repartitionByRange(ranges, "domain", "ts", "seq")
    path = shared_folder(spark, "circuits")
    delete_at_exit(spark, path)
    # Written, as a range is cut by a sample: every later step must see the same ranges.
    rows = keep(ranged.withColumn("chunk", F.spark_partition_id()), f"{path}/ranges")
    order = Window.partitionBy(*KEYS).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"run": F.count_if("good").over(order), "bads": F.count_if("bad").over(order)})
    # Bad ones before the last 2xx of the range: their count never falls, so it is the greatest met at a 2xx.
    return rows.withColumn("own_fails", F.col("bads") - F.coalesce(F.max(F.when(F.col("good"), F.col("bads"))).over(order), F.lit(0)))


def _carried(marked: DataFrame, threshold: int, cooldown: int) -> DataFrame:
    """For each domain and chunk, the state before it (fails_in, gate_in, until_in) and after it (fails, gate, until)."""
    at = F.struct("ts", "seq")
    last = lambda of, when: F.max_by(F.when(when, of), F.when(when, at))
    delayed = F.col("good") & (F.coalesce("crawl_delay", F.lit(0)) > 0)
    sums = marked.groupBy(*KEYS).agg(
        F.max("run").alias("resets"), F.max_by("own_fails", at).alias("tail"),
        last(F.struct("ts", "run", "own_fails", "bad", "crawl_delay"), F.col("bad") | delayed).alias("g"),
        last(F.col("ts"), F.col("bad") & (F.col("run") > 0) & (F.col("own_fails") >= threshold)).alias("opened"),
        last(F.struct("ts", "own_fails"), F.col("bad") & (F.col("run") == 0)).alias("p"),
    )
    ordered = Window.partitionBy("domain").orderBy("chunk")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # A chunk with a 2xx begins a stretch; fails add up within one.
    stretch = sums.withColumn("stretch", F.count_if(F.col("resets") > 0).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = F.sum("tail").over(Window.partitionBy("domain", "stretch").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = stretch.withColumn("fails", out).withColumn("fails_in", F.coalesce(F.lag("fails").over(ordered), F.lit(0)))
    added = F.when(F.col("g.run") == 0, F.col("fails_in")).otherwise(F.lit(0))
    gate = F.when(F.col("g.bad"), _gate(F.col("g.ts"), F.col("g.own_fails") + added)).when(F.col("g").isNotNull(), _after(F.col("g.ts"), F.col("g.crawl_delay").cast("int")))
    early = F.when(F.col("p.own_fails") + F.col("fails_in") >= threshold, F.col("p.ts"))
    known = known.withColumns({"own_gate": gate, "own_until": _after(F.coalesce("opened", early), cooldown)})
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.select(
        *KEYS, "fails_in", F.last("own_gate", ignorenulls=True).over(before).alias("gate_in"), F.last("own_until", ignorenulls=True).over(before).alias("until_in"),
        F.col("fails").alias("fails_out"), F.last("own_gate", ignorenulls=True).over(whole).alias("gate_out"), F.last("own_until", ignorenulls=True).over(whole).alias("until_out"),
    )


def circuit_states(responses: DataFrame, threshold: int = THRESHOLD, cooldown: int = COOLDOWN, ranges: int | None = None) -> DataFrame:
    """Each response (domain, ts, seq, status) with fails, next_allowed and open_until after it.

    429 and 503 count on, gate the domain for twice as long each time and open
    its circuit at the threshold; a 2xx starts anew, and gates the domain for
    ``crawl_delay`` seconds if that column has some; others change nothing.
    Responses of a domain go by ts and seq; a null status changes nothing.
    ranges: how many to deal responses out in (as the session does, if null).
    """
    columns = responses.columns
    marked = _marked(responses, ranges)
    carried = _carried(marked, threshold, cooldown).select(*KEYS, "fails_in", "gate_in", "until_in")
    rows = marked.join(carried, [marked["domain"].eqNullSafe(carried["domain"]), marked["chunk"] == carried["chunk"]]).drop(carried["domain"], carried["chunk"])
    rows = rows.withColumn("fails", F.col("own_fails") + F.when(F.col("run") == 0, F.col("fails_in")).otherwise(F.lit(0)))
    delay = F.coalesce("crawl_delay", F.lit(0)).cast("int")
    gate = F.when(F.col("bad"), _gate(F.col("ts"), F.col("fails"))).when(F.col("good") & (delay > 0), _after(F.col("ts"), delay))
    opened = F.when(F.col("bad") & (F.col("fails") >= threshold), _after(F.col("ts"), cooldown))
    order = Window.partitionBy(*KEYS).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda own, carried: F.coalesce(F.last(own, ignorenulls=True).over(order), carried)
    return rows.select(*columns, "fails", last(gate, F.col("gate_in")).alias("next_allowed"), last(opened, F.col("until_in")).alias("open_until"))


def circuits_now(responses: DataFrame, threshold: int = THRESHOLD, cooldown: int = COOLDOWN, ranges: int | None = None) -> DataFrame:
    """domain, fails, next_allowed and open_until after all responses; one row for each domain, from the summed ranges alone."""
    carried = _carried(_marked(responses, ranges), threshold, cooldown)
    last = carried.groupBy("domain").agg(F.max_by(F.struct("fails_out", "gate_out", "until_out"), "chunk").alias("s"))
    return last.select("domain", F.col("s.fails_out").alias("fails"), F.col("s.gate_out").alias("next_allowed"), F.col("s.until_out").alias("open_until"))


def circuit_allows(now_states: DataFrame, now: Column) -> DataFrame:
    """domain, next_allowed and whether its circuit is closed at ``now``; now_states as ``circuits_now`` gives them."""
    return now_states.select("domain", "next_allowed", F.coalesce(F.col("open_until") <= now, F.lit(True)).alias("closed"))


def breaker_step(state: tuple[int, float, float], status: int, now: float, threshold: int = THRESHOLD, cooldown: int = COOLDOWN, crawl_delay: int = 0) -> tuple[int, float, float]:
    """One response on (fails, next_allowed, open_until), in seconds: the same rule for a stateful stream."""
    fails, gate, until = state
    if status in (429, 503):
        fails += 1
        return fails, now + min(2 ** min(fails, MOST_POWER), MOST_BACKOFF), now + cooldown if fails >= threshold else until
    return (0, now + crawl_delay if crawl_delay > 0 else gate, until) if 200 <= status < 300 else state


def breaker_frame(states: dict, rows: pd.DataFrame, **limits) -> dict:
    """Fold rows (domain, ts, status) into states by domain."""
    for domain, ts, status in zip(rows["domain"], rows["ts"], rows["status"], strict=True):
        states[domain] = breaker_step(states.get(domain, (0, 0.0, 0.0)), int(status), ts.timestamp(), **limits)
    return states
