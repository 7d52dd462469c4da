"""The frontier as a stateful stream: pushes, gates, outcomes and demand for items come in, popped items come out.

Domains are dealt out to shards by hash, and each shard is one key of
``transformWithState``: what concerns a domain (its gate, its budget) lies in
one shard, and one shard in all is strict best-first.  Queued items lie in maps
by priority band, so that a pop reads the highest band that has any and not the
whole queue; items whose own or whose domain's gate is shut wait in a map of
their own until it opens, and then come back with what they have gained by
waiting, at the end of the queue of their priority.

Time is the events' own.  Demand that can't be met stays, and is met as soon as
an event or a gate's time allows: gates that open before an event are opened
first, and where no event comes, a timer on the watermark opens them.  So the
same events give the same pops, however they are cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from ..operators.frontier import AGE_FACTOR, AGING_WINDOW

EVENT = "no long, at timestamp, kind string, url_key string, reg_domain string, priority double, depth int, opens timestamp, n int"
POPPED = "shard int, at double, url_key string, reg_domain string, priority double, depth int, seq long"
#: Bands of 1 / BANDS_A_UNIT of priority, from the highest (0) down; the first and the last take all that lies beyond.
BANDS, BANDS_A_UNIT, HIGHEST = 24, 16, 1.5
ITEM = "reg_domain string, priority double, depth int, enqueued double, opens double, seq long"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def band(priority: float) -> int:
    return min(BANDS - 1, max(0, int((HIGHEST - priority) * BANDS_A_UNIT)))


@dataclass
class Item:
    reg_domain: str
    priority: float
    depth: int
    enqueued: float
    opens: float
    seq: int

    def row(self) -> tuple:
        return self.reg_domain, self.priority, self.depth, self.enqueued, self.opens, self.seq

    def effective(self, now: float) -> float:
        return self.priority + AGE_FACTOR * max(0.0, now - self.enqueued) / AGING_WINDOW


class Frontier(StatefulProcessor):
    """One shard. State: queue (items by band), waiting (items behind a gate), place (where each key is), domains (completed, open from), counters (demand, next seq)."""

    def __init__(self, domain_budget: int):
        self.domain_budget = domain_budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = StructType().add("url_key", StringType())
        self.handle = handle
        self.queue = [handle.getMapState(f"band{i}", key, ITEM) for i in range(BANDS)]
        self.waiting = handle.getMapState("waiting", key, ITEM)
        self.place = handle.getMapState("place", key, StructType().add("band", IntegerType()))
        self.domains = handle.getMapState("domains", StructType().add("reg_domain", StringType()), StructType().add("done", LongType()).add("opens", DoubleType()))
        self.counters = handle.getValueState("counters", StructType().add("wanted", LongType()).add("seq", LongType()).add("alarm", DoubleType()))

    #: Places that are no band: behind a gate, handed out, done or given up.
    WAITING, TAKEN, DONE = -1, -2, -3

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch's events of one shard; the source's limits a trigger bound them.
        events = pd.concat(list(rows)).sort_values("no")
        self.load()
        out: list[tuple] = []
        for e in events.itertuples(index=False):
            now = e.at.timestamp()
            self.pass_time(now, out)
            self.apply(e, now)
            self.serve(now, out)
        self.save()
        yield self.shown(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        out: list[tuple] = []
        self.alarm = 0.0
        self.pass_time(expiredTimerInfo.getExpiryTimeInMs() / 1000, out)
        self.save()
        yield self.shown(key, out)

    def shown(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in out], columns=[f.split()[0] for f in POPPED.split(", ")])

    def load(self) -> None:
        self.wanted, self.seq, self.alarm = self.counters.get() if self.counters.exists() else (0, 0, 0.0)

    def save(self) -> None:
        """Keep the counters, and set one timer for the gate that opens next, if anybody waits for it."""
        opens = min((Item(*row).opens for _, row in self.waiting.iterator()), default=0.0) if self.wanted else 0.0
        if opens != self.alarm:
            if self.alarm:
                self.handle.deleteTimer(int(self.alarm * 1000))
            if opens:
                self.handle.registerTimer(int(opens * 1000))
            self.alarm = opens
        self.counters.update((self.wanted, self.seq, self.alarm))

    def domain(self, name: str) -> tuple[int, float]:
        return self.domains.getValue((name,)) if self.domains.containsKey((name,)) else (0, 0.0)

    def where(self, url_key: str) -> int | None:
        return self.place.getValue((url_key,))[0] if self.place.containsKey((url_key,)) else None

    def put(self, url_key: str, item: Item) -> None:
        at = band(item.priority)
        self.queue[at].updateValue((url_key,), item.row())
        self.place.updateValue((url_key,), (at,))

    def hold(self, url_key: str, item: Item) -> None:
        self.waiting.updateValue((url_key,), item.row())
        self.place.updateValue((url_key,), (self.WAITING,))

    def apply(self, e, now: float) -> None:
        if e.kind == "push":
            if self.where(e.url_key) is None:
                self.seq += 1
                self.put(e.url_key, Item(e.reg_domain, e.priority, int(e.depth), now, 0.0 if pd.isna(e.opens) else e.opens.timestamp(), self.seq))
        elif e.kind == "gate":
            self.domains.updateValue((e.reg_domain,), (self.domain(e.reg_domain)[0], e.opens.timestamp()))
        elif e.kind in ("completed", "failed"):
            at = self.where(e.url_key)
            if at is not None and at >= 0:
                self.queue[at].removeKey((e.url_key,))
            elif at == self.WAITING:
                self.waiting.removeKey((e.url_key,))
            self.place.updateValue((e.url_key,), (self.DONE,))
            if e.kind == "completed":
                done, opens = self.domain(e.reg_domain)
                self.domains.updateValue((e.reg_domain,), (done + 1, opens))
        elif e.kind == "pop":
            self.wanted += int(e.n)

    def pass_time(self, now: float, out: list[tuple]) -> None:
        """While somebody waits, open the gates up to ``now``, each at its own time."""
        while self.wanted:
            opens = min((Item(*row).opens for _, row in self.waiting.iterator()), default=None)
            if opens is None or opens > now:
                break
            self.serve(opens, out)

    def serve(self, now: float, out: list[tuple]) -> None:
        while self.wanted:
            for url_key, item in self.ready(now):
                self.place.updateValue((url_key,), (self.TAKEN,))
                self.wanted -= 1
                out.append((now, url_key, item.reg_domain, item.effective(now), item.depth, item.seq))
                if not self.wanted:
                    return
            if not self.open_gates(now):
                return

    def open_gates(self, now: float) -> bool:
        """Items whose gate has opened go back into the queue, in the order in which they came, aged so far."""
        ready = sorted(((Item(*row), key[0]) for key, row in self.waiting.iterator() if Item(*row).opens <= now), key=lambda x: x[0].seq)
        for item, url_key in ready:
            self.waiting.removeKey((url_key,))
            self.seq += 1
            item.priority, item.seq = item.effective(now), self.seq
            self.put(url_key, item)
        return bool(ready)

    def ready(self, now: float) -> Iterator[tuple[str, Item]]:
        """Take items that may go now out of the queue, best first, a band at a time; those behind a gate go to wait, those of a full domain are given up."""
        for queue in self.queue:
            for item, url_key in sorted(((Item(*row), key[0]) for key, row in queue.iterator()), key=lambda x: (-x[0].priority, x[0].seq)):
                queue.removeKey((url_key,))
                done, opens = self.domain(item.reg_domain)
                if item.opens > now:
                    self.hold(url_key, item)
                elif opens > now:
                    item.opens = opens
                    self.hold(url_key, item)
                elif done >= self.domain_budget:
                    self.place.updateValue((url_key,), (self.DONE,))
                else:
                    yield url_key, item

    def close(self) -> None:
        pass


def pops(events: DataFrame, domain_budget: int = 50, shards: int = 1, late: str = "0 seconds") -> DataFrame:
    """POPPED rows of a stream of EVENT rows.

    Kinds of events, in the order of ``no``: push (url_key, reg_domain,
    priority, depth; opens: not before), gate (reg_domain closed until opens),
    completed and failed (url_key, reg_domain), pop (n more items wanted; with
    several shards, of each).  A key that was pushed before is not pushed
    again.  Needs the RocksDB state store (STATE_STORE).
    """
    events.sparkSession.conf.set(*STATE_STORE)
    home = F.pmod(F.xxhash64("reg_domain"), F.lit(shards)).cast("int")
    dealt = events.withColumn("shard", F.when(F.col("kind") == "pop", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(home))).withColumn("shard", F.explode("shard"))
    keyed = dealt.withWatermark("at", late).groupBy("shard")
    return keyed.transformWithStateInPandas(Frontier(domain_budget), POPPED, "Append", "EventTime")
