"""The stateful frontier against a heap in plain Python, for any cut into micro-batches and over a restart."""

import datetime
import heapq
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf", reason="transformWithState in Python needs it")

from trailbase.operators import frontier
from trailbase.streaming import frontier_state as fs

T0 = datetime.datetime(2026, 1, 1)
BUDGET = 3


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def script(seed: int, n: int = 90):
    """Events with rising numbers and times."""
    draw, now, out, pushed = random.Random(seed), 0, [], []
    for no in range(n):
        now += draw.choice([0, 0, 1, 5, 40])
        kind = draw.choice(["push"] * 5 + ["pop"] * 3 + ["gate", "completed", "failed"])
        key, domain = f"u{draw.randint(0, 40)}", f"d{draw.randint(0, 4)}.org"
        row = [no, at(now), kind, None, None, None, None, None, None]
        if kind == "push":
            row[3:8] = key, domain, draw.choice([0.2, 0.5, 0.5, 0.9, 1.0, 2.0, -1.0]), draw.randint(0, 3), at(now + draw.randint(1, 60)) if draw.random() < 0.3 else None
            pushed.append((key, domain))
        elif kind == "pop":
            row[8] = draw.randint(1, 3)
        elif kind == "gate":
            row[4], row[7] = domain, at(now + draw.randint(1, 90))
        elif pushed:
            row[3], row[4] = draw.choice(pushed)
        else:
            continue
        out.append(tuple(row))
    return out


def folded(events, budget=BUDGET):
    """One event after the other on a heap; gates that open on the way are opened at their time."""
    heap, items, waiting, state, done, opens, wanted, seq, out = [], {}, {}, {}, {}, {}, 0, 0, []
    aged = lambda i, now: i["priority"] + max(0.0, now - i["at"]) / 600

    def serve(now):
        nonlocal wanted, seq
        while wanted:
            while heap:
                _, own, key = heapq.heappop(heap)
                item = items.get(key)
                if item is None or item["seq"] != own or state[key] != "queued":
                    continue
                gate = max(item["opens"], opens.get(item["domain"], 0.0) if item["opens"] <= now else 0.0)
                if gate > now:
                    item["opens"], state[key] = gate, "waiting"
                    waiting[key] = item
                elif done.get(item["domain"], 0) >= budget:
                    state[key] = "given up"
                else:
                    state[key] = "taken"
                    wanted -= 1
                    out.append((now, key, item["domain"], round(aged(item, now), 9), item["depth"], own))
                    if not wanted:
                        return
            ready = sorted((i["seq"], k) for k, i in waiting.items() if i["opens"] <= now)
            if not ready:
                return
            for _, key in ready:
                item = waiting.pop(key)
                seq += 1
                item["priority"], item["seq"], state[key] = aged(item, now), seq, "queued"
                heapq.heappush(heap, (-item["priority"], seq, key))

    for _, when, kind, key, domain, priority, depth, until, n in events:
        now = when.timestamp()
        while wanted and waiting and (first := min(i["opens"] for i in waiting.values())) <= now:
            serve(first)
        if kind == "push" and key not in state:
            seq += 1
            items[key] = {"domain": domain, "priority": priority, "depth": depth, "at": now, "opens": until.timestamp() if until else 0.0, "seq": seq}
            state[key] = "queued"
            heapq.heappush(heap, (-priority, seq, key))
        elif kind == "gate":
            opens[domain] = until.timestamp()
        elif kind in ("completed", "failed"):
            state[key] = "done"
            waiting.pop(key, None)
            done[domain] = done.get(domain, 0) + (kind == "completed")
        elif kind == "pop":
            wanted += n
        serve(now)
    return out


def fed(spark, tmp_path, events, cuts, budget=BUDGET, shards=1):
    """Pops of the stream over files of events, one a micro-batch; a new query over the same checkpoint for the second half."""
    folder, sink, saved = (str(tmp_path / x) for x in ("in", "out", "state"))
    parts = [events[a:b] for a, b in zip([0, *cuts], [*cuts, len(events)], strict=True)]
    for half in (parts[: len(parts) // 2 + 1], parts[len(parts) // 2 + 1 :]):
        for part in half:
            if part:
                spark.createDataFrame(part, fs.EVENT).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        source = spark.readStream.schema(fs.EVENT).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
        query = fs.pops(source, budget, shards).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"file://{saved}").trigger(availableNow=True).start(f"file://{sink}")
        query.awaitTermination()
    return [(r.at, r.url_key, r.reg_domain, round(r.priority, 9), r.depth, r.seq) for r in spark.read.schema(fs.POPPED).parquet(f"file://{sink}").collect()]


@pytest.mark.parametrize(("seed", "cuts"), [(1, []), (2, [30, 31, 70])])
def test_stream_equals_a_heap(spark, tmp_path, seed, cuts):
    events = script(seed)
    want = folded(events)
    assert len(want) > 10 and sorted(fed(spark, tmp_path, events, cuts)) == sorted(want)


def test_a_gate_opens_without_an_event(spark, tmp_path):
    """Demand waits for a gate, and a timer opens it once the watermark, moved by another shard's event, has passed."""
    homes = {r.d: r.s for r in spark.createDataFrame([(f"d{i}.org",) for i in range(9)], "d string").withColumn("s", F.pmod(F.xxhash64("d"), F.lit(2))).collect()}
    other = next(d for d, s in homes.items() if s != homes["d0.org"])
    events = [(0, at(0), "push", "u", "d0.org", 0.5, 1, at(30), None), (1, at(1), "pop", None, None, None, None, None, 1), (2, at(100), "push", "v", other, 0.1, 1, None, None)]
    got = fed(spark, tmp_path, events, [2], shards=2)
    # Aged when the gate opens, and again as it is handed out.
    assert sorted(got) == [(at(30).timestamp(), "u", "d0.org", round(0.5 + 2 * 30 / 600, 9), 1, 2), (at(100).timestamp(), "v", other, 0.1, 1, 1)]


def test_one_pop_equals_the_batch_form(spark, tmp_path):
    rows = [(f"u{i}", f"d{i % 5}.org", ((i * 37) % 100) / 100, at(-(i % 7)), at(50) if i % 11 == 0 else at(-100), i) for i in range(60)]
    table = spark.createDataFrame(rows, "url_key string, reg_domain string, priority double, enqueued_at timestamp, next_available_at timestamp, seq long")
    domains = spark.createDataFrame([("d1.org", at(20), 0), ("d2.org", at(-20), 0)], "reg_domain string, allowed_at timestamp, used int")
    batch = frontier.pop(table, F.lit(at(0)), domains, 100, 15).collect()
    events = [(i, at(-100), "push", r[0], r[1], r[2], 0, r[4] if r[4] > at(0) else None, None) for i, r in enumerate(rows)]
    events += [(70, at(-100), "gate", None, "d1.org", None, None, at(20), None), (71, at(0), "pop", None, None, None, None, None, 15)]
    got = fed(spark, tmp_path, events, [])
    assert [r[1] for r in sorted(got, key=lambda r: (-r[3], r[5]))] == [r.url_key for r in batch]


def test_shards_keep_domains_together(spark, tmp_path):
    events = [(i, at(0), "push", f"u{i}", f"d{i % 6}.org", i / 20, 0, None, None) for i in range(20)] + [(20, at(1), "pop", None, None, None, None, None, 100)]
    got = fed(spark, tmp_path, events, [7], shards=3)
    assert sorted(r[1] for r in got) == sorted(f"u{i}" for i in range(20))
