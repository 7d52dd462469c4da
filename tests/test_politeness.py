"""Circuits against a fold, robots rules against the standard library's parser."""

import datetime
import random
from urllib.robotparser import RobotFileParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailbase.operators import circuits, robots

T0 = datetime.datetime(2026, 1, 1)
RESPONSES = "domain string, ts timestamp, seq long, status int, crawl_delay int"


def responses(seed: int = 1, n: int = 600):
    draw = random.Random(seed)
    rows = []
    for seq in range(n):
        domain = "hot" if draw.random() < 0.5 else draw.choice(["a", "b", "c", None])
        rows.append((domain, T0 + datetime.timedelta(seconds=draw.randint(0, n)), seq, draw.choice([200, 204, 301, 404, 429, 429, 503, 503, 503, 500, None]), draw.choice([0, 0, 7, None])))
    return rows + [("quiet", T0, n, 404, 0), ("bad", T0, n + 1, 503, 0), *(("down", T0 + datetime.timedelta(seconds=i), n + 2 + i, 503, 0) for i in range(40))]


def folded(rows, threshold, cooldown):
    """(state after each response by seq, last state by domain), one response after the other."""
    own, after = {}, {}
    for domain, ts, seq, status, delay in sorted(rows, key=lambda r: (r[1], r[2])):
        own[domain] = circuits.breaker_step(own.get(domain, (0, 0.0, 0.0)), status or 0, ts.timestamp(), threshold, cooldown, delay or 0)
        after[seq] = own[domain]
    return after, own


def seconds(row):
    return row.fails, row.next_allowed.timestamp() if row.next_allowed else 0.0, row.open_until.timestamp() if row.open_until else 0.0


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_scan_equals_fold(spark, ranges):
    rows = responses(ranges)
    table = spark.createDataFrame(rows, RESPONSES).repartition(5)
    after, last = folded(rows, 4, 90)
    states = circuits.circuit_states(table, 4, 90, ranges)
    assert states.columns == [*table.columns, "fails", "next_allowed", "open_until"]
    assert {r.seq: seconds(r) for r in states.collect()} == after
    assert {r.domain: seconds(r) for r in circuits.circuits_now(table, 4, 90, ranges).collect()} == last


def test_no_responses(spark):
    none = spark.createDataFrame([], RESPONSES)
    assert circuits.circuit_states(none).count() == 0 and circuits.circuits_now(none).count() == 0


FILES = {
    "a.org": "User-agent: *\nAllow: /a/b\nDisallow: /a\nDisallow: /x?y\nCrawl-delay: 7\n\nUser-agent: Other\nDisallow: /",
    "b.org": "# nothing\nDisallow: /lost\nUser-agent: One\nUser-agent: *\nDisallow: /%7Ehome/\nDisallow: /caf%C3%A9\nDisallow: /p q\nDisallow: /*z\n",
    "c.org": "User-agent: *\nDisallow:\n",
    "d.org": "User-agent: *\n\nDisallow: /gone\n\nUser-agent: *\nCrawl-delay: x\nDisallow: /one # why\n\nUser-agent: *\nDisallow: /two",
    "e.org": "User-agent: *\nDisallow: /",
    "f.org": "",
    "g.org": "User-agent:*\nALLOW:/public\ndisallow : /\nrequest-rate: 1/5\nSitemap: https://g.org/s.xml",
}
PATHS = ["", "/", "/a", "/a/b/c", "/ab", "/x?y=1", "/x?z", "/x?", "/~home/me", "/%7ehome/me", "/café", "/caf%C3%A9/x", "/p%20q", "/p+q", "/%zz", "/*z", "/lost", "/one", "/two", "/gone", "/public/x", "/a;", "/a;b", "/a#frag", "/a?#", "/%2Fa", "/%3Fx", "/tab%09a", "/日本"]


def allowed(raw, url, agent="*"):
    parser = RobotFileParser()
    parser.parse(raw.splitlines())
    return parser.can_fetch(agent, url)


def test_rules_equal_the_standard_parser(spark):
    rows = [(d, f"https://{d}{p}", i) for d in [*FILES, "none.org"] for i, p in enumerate(PATHS)]
    links = spark.createDataFrame([*rows, *rows[:3], (None, "https://x/", 0)], "domain string, canonical string, rank int").repartition(3)
    files = spark.createDataFrame([*FILES.items(), ("null.org", None)], "domain string, raw string")
    relation = robots.rules_relation(files)
    flagged = robots.robots_flags(links, relation)
    assert flagged.columns == [*links.columns, "robots_allows"] and flagged.count() == len(rows) + 4
    got = {r.canonical: r.robots_allows for r in flagged.collect()}
    assert got == {u: d not in FILES or allowed(FILES[d], u) for d, u, _ in rows} | {"https://x/": True}
    assert {r.domain: r.crawl_delay for r in robots.crawl_delays(relation).collect()} == {"a.org": 7}
    plan = flagged._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan


LINE = st.sampled_from(["User-agent: *", "user-agent: me", "User-agent: Meta/2", "Disallow: /a", "Allow: /a/b", "Disallow: /", "Disallow:", "Allow:", "Crawl-delay: 3", "crawl-delay: z", "Request-rate: 1/2", "", " ", "# c", "Disallow /x", "Sitemap: /s", "Disallow: /%61b"])


@given(st.lists(LINE, max_size=14), st.sampled_from(["*", "me", "Me/1.0", "you"]))
@settings(max_examples=500, deadline=None)
def test_groups_equal_the_standard_parser(lines, agent):
    raw = "\n".join(lines)
    rules, delay = robots.group_for(raw, agent)
    for path in ("/", "/a", "/a/b", "/ab/c", "/x"):
        own = next((allow for prefix, allow in rules if path.startswith(prefix)), True)
        assert own == allowed(raw, f"https://e.org{path}", agent)
    parser = RobotFileParser()
    parser.parse(lines)
    assert delay == parser.crawl_delay(agent)


def test_files_grow_stale(spark):
    now = F.lit(T0)
    rows = spark.createDataFrame([(T0 - datetime.timedelta(hours=h),) for h in (1, 23, 25)] + [(None,)], "at timestamp")
    assert [r[0] for r in rows.select(robots.stale(F.col("at"), now)).collect()] == [False, False, True, True]
