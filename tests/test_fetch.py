"""Polite fetching with a stub client and a clock of its own, and raw bytes by run."""

import datetime

from trailbase.operators import circuits
from trailbase.sources import fetch

T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
ITEM = "domain string, url_key string, canonical string"


class Clock:
    def __init__(self):
        self.now = T0.timestamp()

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def client(url):
    if "busy" in url:
        return fetch.Response(503, {}, b"")
    if "gone" in url:
        return fetch.Response(404, {}, b"")
    return fetch.Response(200, {}, url.encode())


def polite(spark, items, **more):
    clock = Clock()
    rows = spark.createDataFrame(items, ITEM).coalesce(1)
    out = fetch.fetch_politely(rows, lambda: client, clock=clock, sleep=clock.sleep, **more).collect()
    return {r.url_key: r for r in out}, lambda key: next(r for r in out if r.url_key == key).fetched_at.astimezone(datetime.UTC).timestamp() - T0.timestamp()


def test_requests_of_a_domain_are_apart_and_domains_take_turns(spark):
    items = [("a.org", f"a{i}", f"https://a.org/{i}") for i in range(4)] + [("b.org", f"b{i}", f"https://b.org/{i}") for i in range(3)] + [("c.org", "c0", "https://c.org/gone")]
    delays = spark.createDataFrame([("a.org", 10), ("b.org", 0)], "domain string, crawl_delay int")
    rows, at = polite(spark, items, delays=delays)
    assert len(rows) == 8 and {k: r.outcome for k, r in rows.items()} == {r[1]: "failed" if r[1] == "c0" else "ok" for r in items}
    times = sorted(at(f"a{i}") for i in range(4))
    assert all(b - a >= 10 for a, b in zip(times, times[1:], strict=False)) and times[-1] <= 40
    assert bytes(rows["b1"].html) == b"https://b.org/1" and max(at(f"b{i}") for i in range(3)) <= times[1]


def test_an_open_circuit_defers(spark):
    items = [("x.org", f"x{i}", f"https://x.org/busy{i}") for i in range(8)]
    rows, _ = polite(spark, items)
    told = [rows[f"x{i}"].outcome for i in range(8)]
    assert sorted(told) == ["deferred"] * 3 + ["failed"] * 5 and all(r.status is None for r in rows.values() if r.outcome == "deferred")
    known = spark.createDataFrame([("x.org", None, T0 + datetime.timedelta(hours=1)), ("y.org", T0 + datetime.timedelta(seconds=50), None)], "domain string, next_allowed timestamp, open_until timestamp")
    rows, at = polite(spark, [("x.org", "x", "https://x.org/"), ("y.org", "y", "https://y.org/")], circuits=known)
    assert rows["x"].outcome == "deferred" and rows["y"].outcome == "ok" and at("y") >= 50


def test_responses_feed_circuits_and_bytes_are_kept(spark, tmp_path):
    clock = Clock()
    items = spark.createDataFrame([("x.org", f"x{i}", f"https://x.org/busy{i}") for i in range(5)] + [("b.org", "b", "https://b.org/1"), ("g.org", "g", "https://g.org/gone")], ITEM).coalesce(1)
    done = fetch.fetch_politely(items, lambda: client, clock=clock, sleep=clock.sleep)
    done.write.parquet(f"file://{tmp_path}/done")
    done = spark.read.parquet(f"file://{tmp_path}/done")
    states = {r.domain: r for r in circuits.circuits_now(fetch.responses(done)).collect()}
    assert states["x.org"].fails == 5 and states["x.org"].open_until is not None and states["b.org"].fails == 0
    stored = fetch.store_raw(done, f"file://{tmp_path}/store", "r1").collect()
    assert [(r.url_key, r.bytes, r.raw_path.endswith("run_id=r1")) for r in stored] == [("b", 15, True)]
    assert [(r.url_key, bytes(r.html)) for r in fetch.raw(spark, f"file://{tmp_path}/store", "r1").collect()] == [("b", b"https://b.org/1")]


def test_turns_hold_a_window():
    clock = Clock()
    turns = fetch.Turns(clock, clock.sleep)
    for i in range(6):
        turns.add(f"d{i % 2}", (i,), 0.0)
    order = []
    while turns.size:
        domain, item, shut = turns.next()
        assert not shut
        order.append(item[0])
        turns.done(domain, 200, 5 if domain == "d0" else 1)
    assert order == [0, 1, 3, 5, 2, 4]
