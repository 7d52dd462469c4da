"""The walk with buffer, gates and merged logs against a replay in plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trailbase.plans import logs, rounds

T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
LINK = "source_url_key string, url_key string, raw string, canonical string, domain string, reg_domain string, anchor string, position int, weight double"


class Clock:
    def __init__(self):
        self.now = T0.timestamp()

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def graph(seed: int, n: int = 45):
    draw = random.Random(seed)
    domain = lambda i: f"d{i % 4}.org"
    links = []
    for i in range(n):
        for position in range(draw.randint(0, 6)):
            j = draw.randint(0, n + 4)  # some lead to no page
            links.append((f"p{i:02}", f"p{j:02}", f"https://{domain(j)}/p{j}", f"https://{domain(j)}/p{j}", domain(j), domain(j), "", position, draw.randint(1, 30) / 20))
    return {f"p{i:02}": domain(i) for i in range(n)}, links


def replayed(pages, links, limits, gates):
    """(pops in order, audit) of the walk's rules, an item at a time."""
    now, taken, order, audit = T0.timestamp(), {}, [], []
    queue = {"p00": (1.0, 0, 0)}  # priority, round added, depth
    ever, offered, buffer, added_at = {"p00"}, set(), [], 0.0
    done = lambda d: sum(pages[k] == d for k in taken)
    while queue or buffer:
        if limits.max_pages and len(order) >= limits.max_pages:
            break
        live = {k: v for k, v in queue.items() if done(pages[k]) < limits.domain_budget}
        open_ = [(-p, r, k, d) for k, (p, r, d) in live.items() if gates.get(pages[k], 0) <= now]
        batch = []
        for item in sorted(open_):
            if done(pages[item[2]]) + sum(pages[b[2]] == pages[item[2]] for b in batch) < limits.domain_budget and len(batch) < limits.round_size:
                batch.append(item)
        if not batch:
            shut = [gates[pages[k]] for k in live if gates.get(pages[k], 0) > now]
            if not shut:
                break
            now = min(shut)
            continue
        n = (order[-1][0] if order else 0) + 1
        for negative, _, key, _ in batch:
            order.append((n, key, -negative))
            taken[key] = n
            del queue[key]
        kept = []
        for negative, _, key, depth in batch:
            for source, to, _, _, domain, _, _, position, weight in links:
                if source == key:
                    reason = "dedup" if to in ever else "depth" if depth + 1 > limits.depth_limit else "domain_budget" if done(domain) >= limits.domain_budget else None
                    audit.append((source, to, depth + 1, reason, n))
                    if reason is None:
                        kept.append({"key": to, "depth": depth + 1, "priority": weight, "arrival": (n, negative, source, position, to), "quality": -0.1 * (depth + 1) - 0.001 * position})

        def push(rows, n=n):
            best = {}
            for c in rows:
                if c["key"] not in ever and c["key"] in pages and (c["priority"], -c["depth"]) > best.get(c["key"], ((-1, 0),))[0]:
                    best[c["key"]] = ((c["priority"], -c["depth"]),)
            for key, ((priority, depth),) in best.items():
                queue[key] = (priority, n, -depth)
                ever.add(key)

        if not limits.buffer_capacity:
            push(kept)
            continue
        first = {}
        for c in sorted(kept, key=lambda c: c["arrival"]):
            if c["key"] not in offered:
                first.setdefault(c["key"], c)
        offered |= set(first)
        added_at = now if first else added_at
        pool = sorted([*buffer, *first.values()], key=lambda c: (-c["quality"], c["arrival"]))
        audit += [(c["arrival"][2], c["key"], c["depth"], "buffer", n) for c in pool[limits.buffer_capacity :]]
        buffer = sorted(pool[: limits.buffer_capacity], key=lambda c: c["arrival"])
        while buffer and (len(buffer) >= limits.buffer_batch or not queue or now - added_at > limits.buffer_wait):
            some = len(buffer) // limits.buffer_batch * limits.buffer_batch or len(buffer)
            push(buffer[:some])
            buffer = buffer[some:]
    return order, audit


@pytest.mark.parametrize(("seed", "more"), [(3, dict(round_size=1, max_pages=14)), (4, dict(round_size=3, buffer_capacity=6, buffer_batch=3, domain_budget=8))])
def test_walk_equals_a_replay(spark, monkeypatch, seed, more):
    monkeypatch.setattr(logs, "FAN", 3)
    pages, links = graph(seed)
    limits = rounds.Limits(depth_limit=6, **more)
    responses = spark.createDataFrame([("d1.org", datetime.datetime(2026, 1, 1), i, 503) for i in range(4)], "domain string, ts timestamp, seq int, status int")
    clock = Clock()
    walk = rounds.Walk(
        spark, spark.createDataFrame(list(pages.items()), "url_key string, reg_domain string"), spark.createDataFrame(links, LINK), lambda df: df.withColumn("priority", F.col("weight")),
        limits, responses=responses, clock=clock, sleep=clock.sleep,
    )
    visited, audit, why = walk.run(spark.createDataFrame([("p00", "d0.org", 1.0, 0)], "url_key string, reg_domain string, priority double, depth int"))
    order, told = replayed(pages, links, limits, {"d1.org": T0.timestamp() + 16})
    assert sorted((r["round"], r.url_key, r.priority) for r in visited.collect()) == sorted(order) and len(order) > 10
    assert sorted(map(str, map(tuple, audit.collect()))) == sorted(map(str, told))
    assert why == ("BUDGET_PAGES" if "max_pages" in more else "FRONTIER_DRAINED") and any(pages[k] == "d1.org" for _, k, _ in order)
    if "buffer_capacity" in more:
        assert any(a[3] == "buffer" for a in told)
    own = {r["round"]: r for r in walk.rounds().collect()}
    assert sum(r.popped for r in own.values()) == len(order) and sum(r.found for r in own.values()) == sum(a[3] != "buffer" for a in told)
    assert len(walk.queue.segments) < 12 and sum(walk.state["live"]) == walk._open().count()


def test_a_round_writes_what_it_adds(spark, tmp_path):
    """A wide first round and a chain behind it: the rounds of the chain write one item each."""
    path = f"file://{tmp_path}/walk"
    keys = [f"w{i}" for i in range(2000)] + [f"c{i}" for i in range(6)]
    link = lambda a, b, w: (a, b, f"https://{b}.org/", f"https://{b}.org/", f"{b}.org", f"{b}.org", "", 0, w)
    links = [link("s", k, 0.2) for k in keys[:2000]] + [link(a, b, 1.2) for a, b in zip(["s", *keys[2000:-1]], keys[2000:], strict=True)]
    pages = spark.createDataFrame([(k, f"{k}.org") for k in ["s", *keys]], "url_key string, reg_domain string")
    start = spark.createDataFrame([("s", "s.org", 1.0, 0)], "url_key string, reg_domain string, priority double, depth int")
    walk = rounds.Walk(spark, pages, spark.createDataFrame(links, LINK), lambda df: df.withColumn("priority", F.col("weight")), rounds.Limits(round_size=1, max_pages=6, depth_limit=99), path)
    visited, _, why = walk.run(start)
    assert [r.url_key for r in visited.orderBy("round").collect()] == ["s", "c0", "c1", "c2", "c3", "c4"] and why == "BUDGET_PAGES"
    assert [r.added for r in walk.rounds().orderBy("round").collect()] == [2001, 1, 1, 1, 1, 1]
    written = {p.name.split("=")[1]: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in (tmp_path / "walk" / "by_band").iterdir()}
    assert written["added1.0"] > 8 * max(written[f"added{n}.0"] for n in range(2, 7))
    bands = {f"band={b}" for b in range(logs.BANDS)}
    assert {p.name for p in (tmp_path / "walk" / "by_band" / "segment=added1.0").iterdir()} & bands == {"band=4", "band=20"}


def test_bands_follow_priorities(spark):
    rows = spark.createDataFrame([(p / 50 - 1,) for p in range(200)], "p double").select("p", logs.band(F.col("p")).alias("b")).collect()
    assert all(a.b >= b.b for a, b in zip(rows, rows[1:], strict=False)) and {r.b for r in rows} == set(range(logs.BANDS))

