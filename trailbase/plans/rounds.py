"""The goal-driven walk over a link graph, in rounds of DataFrame operations.

A round pops the best items, takes their pages and links, judges the pages,
filters the links by the rules, robots and circuits, scores and steers them by
what has been judged so far, and pushes them; links that a judged page endorses
go in at full priority.  Links are written once, dealt out by their source page,
and so are pages, robots rules and the states of circuits.  A round appends its
own pages, judgements, audit and frontier items (``logs``): the frontier lies in
priority bands, a pop reads the highest that hold enough, and no round rewrites
it.  What stop conditions look at is counted while a round is written and kept
in its manifest, which commits the round: a walk that broke off resumes after
the last one.  Rounds of one item are strict best-first; larger ones trade order
for parallel work.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runlog
from ..functions import urls
from ..operators import circuits, feedback, frontier, prefilter, rank, stop
from ..operators import robots as robots_rules
from ..shared import delete_at_exit, keep, shared_folder
from .logs import Log, Manifests, band, observed


@dataclass(frozen=True)
class Limits:
    max_pages: int = 500
    depth_limit: int = 5
    domain_budget: int = 50
    round_size: int = 50
    most_rounds: int = 0
    max_tokens: int = 0
    max_duration: int = 0
    since: datetime.datetime | None = None
    relevance_threshold: float = 0.7
    buffer_capacity: int = 0
    buffer_batch: int = frontier.BATCH
    buffer_wait: int = frontier.MAX_WAIT


def ingest_seeds(seeds: DataFrame, allowed: DataFrame | None = None, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Seed candidates as frontier items of priority 1, and all of them with their drop_reason; robots rules don't apply to seeds."""
    open_ = seeds.withColumns({"robots_allows": F.lit(True), "anchor": F.lit("")})
    judged = prefilter.with_reason(open_, limits.depth_limit, limits.domain_budget, allowed=allowed)
    return judged.filter("drop_reason is null").select("url_key", "reg_domain", F.lit(1.0).alias("priority"), F.lit(0).alias("depth")), judged


def endorsed_items(judged: DataFrame, depths: DataFrame, seen: DataFrame, limits: Limits = Limits(), flags: Callable[[DataFrame], DataFrame] = lambda found: found, **given) -> DataFrame:
    """Links that judged pages endorse, as items of priority 1, one deeper than the page they are on.

    They pass the same rules as others: ``flags`` adds robots_allows, and what
    else is given goes to the rules.
    """
    links = feedback.endorsed(judged).withColumn("u", urls.url_struct(F.col("href"), F.col("source_url"))).select("source_url", "u.*", F.lit("").alias("anchor"))
    found = links.join(depths.select(F.col("url").alias("source_url"), F.col("depth").alias("from_depth")), "source_url", "left").withColumn("depth", F.coalesce("from_depth", F.lit(0)) + 1).drop("from_depth")
    kept = prefilter.with_reason(flags(found), limits.depth_limit, limits.domain_budget, seen=seen, **given).filter("drop_reason is null")
    return kept.groupBy("url_key").agg(F.min("canonical").alias("canonical"), F.min("reg_domain").alias("reg_domain"), F.min("depth").alias("depth")).withColumn("priority", F.lit(1.0))


JUDGEMENT = "url_key string, url string, domain string, title string, classification string, relevance_score double, hub_score double, topics array<string>, endorsed_links array<string>, tokens long"


FRONTIER = "url_key string, reg_domain string, priority double, depth int, round_added int, band int"
POPPED = "url_key string, reg_domain string, depth int, priority double, round int, band int"
AUDIT = "source_url_key string, url_key string, depth int, drop_reason string, round int"


class Walk:
    """A walk over pages and links.

    pages: url_key, reg_domain, perhaps published_at and what ``judge`` needs.
    links: source_url_key and the columns of a candidate (url_key, raw,
    canonical, domain, reg_domain, anchor; position, where there is a buffer).
    score: candidates to candidates with a priority.
    judge: the pages of a round to rows of JUDGEMENT (domain: the registered one),
    of these pages or of earlier ones.
    robots: domain and raw; responses: what ``circuits.circuit_states`` takes:
    an open circuit keeps links out, a gate that is shut keeps items in.
    priors: stored priors of domains; allowed: reg_domain; rules: instead of the default ones.
    Limits of 0 are none; with a buffer_capacity, links that pass the rules wait
    in a buffer of so many for their ranking.
    """

    def __init__(self, spark: SparkSession, pages: DataFrame, links: DataFrame, score: Callable[[DataFrame], DataFrame], limits: Limits = Limits(), path: str | None = None, judge: Callable[[DataFrame], DataFrame] | None = None, robots: DataFrame | None = None, responses: DataFrame | None = None, priors: DataFrame | None = None, allowed: DataFrame | None = None, rules: list | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.score, self.limits, self.judge = spark, score, limits, judge
        self.stored, self.allowed, self.rules, self.clock, self.sleep = priors, allowed, rules, clock, sleep
        self.path, self.began, self.fatal = path or shared_folder(spark, "walk"), clock(), ""
        if path is None:
            delete_at_exit(spark, self.path)
        self.manifests = Manifests(spark, f"{self.path}/rounds")
        self.links = self._once("links", lambda: links.repartition(F.col("source_url_key")).sortWithinPartitions("source_url_key"))
        self.pages = self._once("pages", lambda: pages)
        self.robots = None if robots is None else self._once("robots", lambda: robots_rules.rules_relation(robots))
        self.circuits = None if responses is None else self._once("circuits", lambda: circuits.circuits_now(responses))
        self._start({})

    def _start(self, manifest: dict) -> None:
        """The state that a manifest describes."""
        log = lambda name, schema, by=None: Log(self.spark, self.path, schema, by, manifest.get(name))
        self.queue, self.taken = log("queue", FRONTIER, "band"), log("taken", POPPED)
        self.feedback = log("feedback", f"{JUDGEMENT}, task_id string, seq long")
        self.offered = log("offered", "url_key string")
        self.state = {"round": 0, "live": None, "fetched": 0, "tokens": 0, "streak": 0, "last": [], "buffer": None, "buffered": 0, "added_at": 0.0} | {k: v for k, v in manifest.items() if k not in ("queue", "taken", "feedback", "offered")}

    def _where(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        files, where = self._where(name)
        return files.exists(where)

    def _delete(self, name: str) -> None:
        files, where = self._where(name)
        for found in files.globStatus(where) or []:
            files.delete(found.getPath(), True)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of the walk's folder, written by the first that needs it."""
        if not self._exists(f"{name}/_SUCCESS"):
            self._delete(name)
            make().write.parquet(f"{self.path}/{name}")
        return self._read(name)

    def visited(self) -> DataFrame:
        return self.taken.read()

    def audit(self) -> DataFrame:
        """Every candidate met, with its drop_reason; "buffer" where a full buffer had no place for it."""
        if not self._exists("judged"):
            return self.spark.createDataFrame([], AUDIT)
        return self.spark.read.option("recursiveFileLookup", "true").schema(AUDIT).parquet(f"{self.path}/judged")

    def judgements(self) -> DataFrame:
        """Judgements so far, in the order of seq."""
        return self.feedback.read()

    def rounds(self) -> DataFrame:
        """What each round counted: round, popped, found, kept, added, tokens and seconds."""
        if self.last_round() < 1:
            return self.spark.createDataFrame([], "round long, popped long, found long, kept long, added long, tokens long, seconds double")
        return self.spark.read.json(f"{self.path}/rounds").select("round", "popped", "found", "kept", "added", F.col("spent").alias("tokens"), "seconds").filter("round > 0")

    def last_round(self) -> int:
        """The last round that is complete in the walk's folder; -1 if there is none."""
        return self.manifests.last()

    def request_stop(self) -> None:
        """Have the walk end before its next round, from any process that sees its folder."""
        files, where = self._where("STOP")
        files.create(where).close()

    def _commit(self, **told) -> None:
        """Write the round's manifest: from now on the round is complete."""
        own = self.state | told | {"queue": self.queue.segments, "taken": self.taken.segments, "feedback": self.feedback.segments, "offered": self.offered.segments}
        self.manifests.commit(self.state["round"], own)

    def resume(self) -> tuple[DataFrame, DataFrame, str]:
        """Go on after the last complete round of a walk that broke off; a half-written round is done again."""
        n = self.last_round()
        if n < 0:
            raise ValueError(f"no walk in {self.path}")
        self._start(self.manifests.read(n))
        for name in (f"popped{n + 1}", f"popped{n + 1}.*", f"by_band/segment=added{n + 1}.*", f"feedback{n + 1}", f"feedback{n + 1}.*", f"offered{n + 1}", f"offered{n + 1}.*", f"buffer{n + 1}", f"pool{n + 1}.*", f"judged/{n + 1}", f"judged/{n + 1}.*", "STOP"):
            self._delete(name)
        return self._go()

    def run(self, seeds: DataFrame) -> tuple[DataFrame, DataFrame, str]:
        """(visited: url_key, reg_domain, depth, priority, round; audit: every candidate met with its drop_reason; why the walk ended).

        seeds: url_key, reg_domain, priority, depth.
        """
        first = seeds.select("url_key", "reg_domain", F.col("priority").cast("double").alias("priority"), F.col("depth").cast("int").alias("depth"), F.lit(0).alias("round_added")).dropDuplicates(["url_key"])
        self.state["live"] = self.queue.append(first.withColumn("band", band(F.col("priority"))), "added0.0", 0)["bands"]
        self._commit(popped=0, found=0, kept=0, added=sum(self.state["live"]), spent=0, seconds=0.0)
        return self._go()

    def _counters(self) -> DataFrame:
        """One row of what the stop conditions look at."""
        limits, own = self.limits, self.state
        state = "STOPPING" if self._exists("STOP") else "RUNNING"
        relevant = sum(score >= limits.relevance_threshold for _, score in own["last"])
        row = (limits.max_pages, own["fetched"], limits.max_tokens, own["tokens"], limits.max_duration, int(self.clock() - self.began), limits.since, own["streak"], self.fatal, state, len(own["last"]), relevant, sum(own["live"]), own["buffered"], 0)
        return self.spark.createDataFrame([row], "max_pages int, fetched int, max_tokens long, tokens_used long, max_duration long, elapsed long, since timestamp, stale_streak int, fatal_error string, state string, judged int, relevant int, frontier_size int, buffer_size int, in_flight int")

    def _now(self) -> Column:
        return F.timestamp_micros(F.lit(int(self.clock() * 1e6)))

    def _flags(self, found: DataFrame) -> DataFrame:
        """Candidates with robots_allows, as far as there are rules or responses."""
        if self.robots is None and self.circuits is None:
            return found
        closed = None if self.circuits is None else circuits.circuit_allows(self.circuits, self._now())
        rules = self.robots if self.robots is not None else self.spark.createDataFrame([], robots_rules.RULE)
        return robots_rules.robots_flags(found, rules, circuits=closed)

    def priors(self) -> DataFrame:
        """Averages of stored priors and of this walk's judgements, hubs raised: reg_domain and domain_prior."""
        seen = self.judgements()
        hubs = seen.filter(F.col("hub_score") >= feedback.HUB_FLOOR).select(F.col("domain").alias("reg_domain"))
        return rank.domain_prior(feedback.prior_averages(feedback.priors(seen, self.stored)), hubs)

    def _ranked(self, found: DataFrame) -> DataFrame:
        """Candidates scored, with the priors of their domains where any are known, and steered by the judgements so far."""
        if self.judge is None and self.stored is None:
            return self.score(found)
        scored = self.score(found.drop("domain_prior").join(self.priors(), "reg_domain", "left"))
        if self.judge is None:
            return scored
        by_key = self.judgements().withColumn("url", F.col("url_key"))
        return feedback.steer(scored.withColumn("source_url", F.col("source_url_key")), by_key).drop("source_url")

    def _judged(self, best: DataFrame, n: int) -> int:
        """Judge a round's pages and return what that cost; a judge that fails ends the walk."""
        if self.judge is None:
            return 0
        names = [f.split()[0] for f in JUDGEMENT.split(", ")]
        try:
            rows = self.judge(self.pages.join(best.select("url_key"), "url_key", "left_semi"))
            if "tokens" not in rows.columns:
                rows = rows.withColumn("tokens", F.lit(0).cast("long"))
            ordered = rows.select(*names).withColumns({"task_id": F.lit("walk"), "seq": F.lit(n).cast("long") * (1 << 32) + F.pmod(F.xxhash64("url_key"), F.lit(1 << 32))})
            got = self.feedback.append(ordered, f"feedback{n}", n, tokens=F.coalesce(F.sum("tokens"), F.lit(0)))
        except Exception as e:  # the service behind the judge may fail in any way
            self.fatal = f"{type(e).__name__}: {e}"[:500]
            self._delete(f"feedback{n}")
            return 0
        if got["rows"]:  # of the round's judgements the last few, as many as the window holds
            last = self._read(f"feedback{n}").orderBy(F.desc("seq")).limit(stop.WINDOW).select("seq", "relevance_score").collect()
            self.state["last"] = sorted([*map(tuple, self.state["last"]), *((r.seq, r.relevance_score) for r in last)])[-stop.WINDOW :]
        return got["tokens"]

    def _aged(self, best: DataFrame, n: int) -> None:
        """How many dated pages in a row, up to the round's last one, are older than the horizon."""
        if self.limits.since is None or "published_at" not in self.pages.columns:
            return
        dated = self.pages.join(best.select("url_key"), "url_key", "left_semi").filter("published_at is not null")
        dated = dated.select(F.pmod(F.xxhash64("url_key"), F.lit(1 << 32)).alias("seq"), (F.col("published_at") < F.lit(self.limits.since)).alias("old"))
        fresh, old = dated.agg(F.max(F.when(~F.col("old"), F.col("seq"))), F.count_if("old")).first()
        self.state["streak"] = self.state["streak"] + old if fresh is None else dated.filter((F.col("seq") > fresh) & F.col("old")).count()

    def _go(self) -> tuple[DataFrame, DataFrame, str]:
        limits, own = self.limits, self.state
        while True:
            began, n = time.time(), own["round"] + 1
            why = stop.stop_reasons(self._counters()).first()["stop_reasons"] or ("ROUNDS" if 0 < limits.most_rounds < n else None)
            if why:
                break
            size = min(limits.round_size, limits.max_pages - own["fetched"]) if limits.max_pages > 0 else limits.round_size
            popped = self._pop(size, n)
            if not popped:
                opens = self._next_gate()
                if opens is None:
                    why = "FRONTIER_DRAINED"
                    break
                left = limits.max_duration - (self.clock() - self.began) if limits.max_duration > 0 else opens
                self.sleep(max(0.001, min(opens, left)))
                continue
            best = self._read(f"popped{n}")
            own["round"], own["fetched"] = n, own["fetched"] + popped
            spent = self._judged(best, n)
            self._aged(best, n)
            found = self.links.join(best.select(F.col("url_key").alias("source_url_key"), F.col("depth").alias("from_depth"), F.col("priority").alias("from_priority")), "source_url_key").withColumn("depth", F.col("from_depth") + 1).drop("from_depth")
            seen = self.taken.read().select("url_key").union(self.queue.read().select("url_key"))
            done = self.taken.read().groupBy("reg_domain").agg(F.count("*").alias("domain_done"))
            judged = prefilter.with_reason(self._flags(found), limits.depth_limit, limits.domain_budget, allowed=self.allowed, seen=seen, done=done, rules=self.rules).withColumn("round", F.lit(n))
            counted = self._audited(judged, f"judged/{n}")
            kept = self._read(f"judged/{n}").filter("drop_reason is null").drop("round", "drop_reason")
            endorsed = None
            if self.judge is not None and not self.fatal:
                mine = self._read(f"feedback{n}")
                depths = mine.select("url_key", "url").join(self.taken.read().select("url_key", "depth"), "url_key").select("url", "depth")  # an analysis may come rounds after its page
                endorsed = endorsed_items(mine, depths, seen, limits, self._flags, allowed=self.allowed, done=done, rules=self.rules).select("url_key", "reg_domain", "depth", "priority")
            added = self._pushed(kept, endorsed, n) if limits.buffer_capacity <= 0 else self._buffered(kept, endorsed, n)
            self.feedback.merge(n)
            self.queue.merge(n, lambda rows, since: rows.join(self.taken.read().filter(F.col("round") > since).select("url_key"), "url_key", "left_anti").select(*rows.columns))
            self.taken.merge(n)
            self.offered.merge(n)
            own["tokens"] += spent
            runlog.event("walk.round", round=n, popped=popped, found=counted["rows"], kept=counted["kept"], added=added, tokens=spent, elapsed=round(time.time() - began, 3))
            self._commit(popped=popped, found=counted["rows"], kept=counted["kept"], added=added, spent=spent, seconds=round(time.time() - began, 3))
        runlog.event("task.done", reason=why, pages=own["fetched"], tokens=own["tokens"], rounds=own["round"])
        return self.visited().drop("band"), self.audit(), why

    def _audited(self, judged: DataFrame, name: str) -> dict:
        return observed(judged, f"{self.path}/{name}", kept=F.count_if(F.col("drop_reason").isNull()))

    def _pushed(self, kept: DataFrame, endorsed: DataFrame | None, n: int, part: int = 0, fresh_only: bool = False) -> int:
        """Rank candidates and append them, and endorsed items, to the frontier, each key once and with its best priority, if there is a page for it."""
        fresh = self._ranked(kept).select("url_key", "reg_domain", "depth", "priority")
        if endorsed is not None:
            fresh = fresh.unionByName(endorsed)
        fresh = fresh.groupBy("url_key").agg(F.max_by(F.struct("reg_domain", F.col("depth").cast("int").alias("depth"), F.col("priority").cast("double").alias("priority")), F.struct("priority", -F.col("depth"))).alias("c")).select("url_key", "c.reg_domain", "c.priority", "c.depth", F.lit(n).alias("round_added"))
        if fresh_only:
            fresh = fresh.join(self.taken.read().select("url_key").union(self.queue.read().select("url_key")), "url_key", "left_anti")
        reachable = fresh.join(self.pages.select("url_key"), "url_key", "left_semi")
        got = self.queue.append(reachable.withColumn("band", band(F.col("priority"))), f"added{n}.{part}", n)
        self.state["live"] = [a + b for a, b in zip(self.state["live"], got["bands"], strict=True)]
        return got["rows"]

    def _buffered(self, kept: DataFrame, endorsed: DataFrame | None, n: int) -> int:
        """Offer candidates to the buffer, and rank what it releases: full batches, or what there is if it has waited or the frontier has nothing.

        The buffer is the best ``buffer_capacity`` of those offered and not yet
        released, each key once ever; it is a bounded top-n of partial top-ns,
        written anew each round as it never holds more.  Who finds no place is
        in the audit.
        """
        limits, own = self.limits, self.state
        place = F.col("position").cast("long") if "position" in kept.columns else F.lit(0).cast("long")
        arrival = F.struct(F.lit(n).alias("round"), (-F.col("from_priority")).alias("before"), "source_url_key", place.alias("position"), "url_key")
        rows = kept.withColumns({"arrival": arrival, "quality": frontier.quality(F.col("depth"), place)})
        first = rows.groupBy("url_key").agg(F.min_by(F.struct(*rows.columns), "arrival").alias("c")).select("c.*").join(self.offered.read(), "url_key", "left_anti").select(*rows.columns)
        offers = keep(first, f"{self.path}/pool{n}.offers")
        if self.offered.append(offers.select("url_key"), f"offered{n}", n)["rows"]:
            own["added_at"] = self.clock()
        pool = offers if own["buffer"] is None else offers.unionByName(self._read(own["buffer"]))
        best = pool.orderBy(F.desc("quality"), "arrival").limit(limits.buffer_capacity)
        size = observed(best, f"{self.path}/pool{n}.kept")["rows"]
        held, added, part = self._read(f"pool{n}.kept"), 0, 0
        lost = pool.join(held.select("url_key"), "url_key", "left_anti").select("source_url_key", "url_key", F.col("depth").cast("int").alias("depth"), F.lit("buffer").alias("drop_reason"), F.lit(n).alias("round"))
        observed(lost, f"{self.path}/judged/{n}.buffer")
        while True:
            waited = datetime.timedelta(seconds=self.clock() - own["added_at"])
            ready = frontier.buffer_ready(size, waited, sum(own["live"]) == 0, limits.buffer_batch, limits.buffer_wait)
            some = (size // limits.buffer_batch * limits.buffer_batch or size) if ready else 0
            if not some and endorsed is None:
                break
            released = keep(frontier.drain(held, some), f"{self.path}/pool{n}.{part}")
            added += self._pushed(released.drop("arrival", "quality"), endorsed, n, part, fresh_only=True)
            held, size, endorsed, part = held.join(released.select("url_key"), "url_key", "left_anti"), size - some, None, part + 1
            if not some:
                break
        own["buffered"] = observed(held, f"{self.path}/buffer{n}")["rows"]
        own["buffer"] = f"buffer{n}"
        return added

    def _open(self) -> DataFrame:
        """Items not taken yet, with the time before which their domain's gate is shut (null: open)."""
        rows = self.queue.read()
        waiting = rows.join(self.taken.read().select("url_key"), "url_key", "left_anti")
        if self.circuits is None:
            return waiting.withColumn("next_allowed", F.lit(None).cast("timestamp"))
        return waiting.join(self.circuits.select(F.col("domain").alias("reg_domain"), "next_allowed"), "reg_domain", "left")

    def _next_gate(self) -> float | None:
        """Seconds until the first gate opens that keeps an item of a domain with budget left waiting; null if there is none."""
        if self.circuits is None:
            return None
        done = self.taken.read().groupBy("reg_domain").agg(F.count("*").alias("domain_done"))
        shut = self._open().filter(F.col("next_allowed") > self._now()).join(done, "reg_domain", "left").filter(F.coalesce("domain_done", F.lit(0)) < self.limits.domain_budget)
        opens = shut.agg(F.min(F.unix_micros("next_allowed"))).first()[0]
        return None if opens is None else opens / 1e6 - self.clock()

    def _pop(self, size: int, n: int) -> int:
        """Take the best items whose gates are open, as many as each domain's budget has left, from as few bands as hold enough."""
        limits, own = self.limits, self.state
        done = self.taken.read().groupBy("reg_domain").agg(F.count("*").alias("domain_done"))
        filled = [b for b, rows in enumerate(own["live"]) if rows > 0]
        upto, wanted = 0, size
        while filled:
            held = 0
            for b in filled:
                held, upto = held + own["live"][b], b
                if held >= wanted:
                    break
            waiting = self._open().filter((F.col("band") <= upto) & F.coalesce(F.col("next_allowed") <= self._now(), F.lit(True)))
            order = Window.partitionBy("reg_domain").orderBy(F.desc("priority"), "round_added", "url_key")
            ranked = waiting.join(done, "reg_domain", "left").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limits.domain_budget)
            left = ranked.filter(F.col("nth") + F.coalesce("domain_done", F.lit(0)) <= limits.domain_budget)
            best = left.orderBy(F.desc("priority"), "round_added", "url_key").limit(size)
            name = f"popped{n}"
            got = self.taken.append(best.select("url_key", "reg_domain", "depth", "priority", F.lit(n).alias("round"), "band"), name, n)
            if got["rows"] >= size or upto == filled[-1]:
                own["live"] = [a - b for a, b in zip(own["live"], got["bands"], strict=True)]
                return got["rows"]
            self.taken.drop_last(name)
            wanted = 4 * max(wanted, held)
        return 0


def breadth_first(edges: DataFrame, start: DataFrame, most_depth: int) -> DataFrame:
    """(node, depth): the least depth at which each node is reached from the start nodes; edges (src, dst), start (node)."""
    path = shared_folder(edges.sparkSession, "breadth")
    delete_at_exit(edges.sparkSession, path)
    edges = keep(edges.select("src", "dst"), f"{path}/edges")
    last = keep(start.select("node").distinct().withColumn("depth", F.lit(0)), f"{path}/0")
    reached = last
    for depth in range(1, most_depth + 1):
        fresh = edges.join(last, edges["src"] == last["node"]).select(F.col("dst").alias("node")).distinct().join(reached.select("node"), "node", "left_anti")
        last = keep(fresh.withColumn("depth", F.lit(depth)), f"{path}/{depth}")
        reached = reached.unionByName(last)
    return reached
