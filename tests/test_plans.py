import datetime
import hashlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from trailbase.plans import registry, rounds
from trailbase.sources import fetch, seeds
from trailbase.streaming import events as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    norm = lambda v: None if v is None or v is pd.NaT or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(norm(v) for v in r) for r in rows.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got[list(want.columns)].astype(object)) == plain(want.astype(object)) or len(got) == len(want) and _close(got[list(want.columns)], want)


def _close(a, b):
    keys = list(a.columns)
    a, b = a.sort_values(keys).reset_index(drop=True), b.sort_values(keys).reset_index(drop=True)
    return all((pd.to_numeric(a[k]) - pd.to_numeric(b[k])).abs().max() < 1e-9 if pd.api.types.is_numeric_dtype(b[k]) else (a[k].fillna("").astype(str) == b[k].fillna("").astype(str)).all() for k in keys)


def test_titles_of_odd_pages_equal_sql(spark, tmp_path):
    """References cut off or other than &amp;, blanks of all kinds, several titles, none, and a page that never closes one."""
    inner = ["a &amp; b", "cut&amp", "cut&am", "token = &quot;0b9&quot;", "&lt;b&gt; &#38; &eacute;", "&amp;amp;", "\u00a0\u3000 x \u2003", "\t y \n", "two\nlines", "  ", "\n\t", "\x0b", "\u00a0", "", "&nbsp;", "a\u0301 \U0001f600", "a  b"]
    pages = [f"<html><head><title>{t}</title></head><body>x</body></html>" for t in inner]
    pages += [None, "", "no title", "<title>open", "<TITLE>upper</TITLE>", "<title lang='x'>attribute</title>", "<title>a<b>c</b></title>", "<title> </title><title>second</title>", "<svg><title>first</title></svg><title>second</title>", "<title>x</title >", "<!-- <title>comment</title> -->", "<title>" + "long " * 200_000, "<title>" + " " * 200_000 + "far</title>"]
    spark.createDataFrame([(i, f"https://a.org/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.queries()["html_title"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.oracle_sql()["html_title"]).fetchall())
    assert (1, "cut&amp") in got and len(got) > 15


def test_mini_web_walk(spark):
    """Three pages, best first, with budgets; every candidate met has its reason."""
    pages = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "url_key string, reg_domain string")
    rows = [("a", "b", "https://x/b", "x"), ("a", "c", "https://y/c", "y"), ("a", "p", "https://x/n.pdf", "x"), ("b", "a", "https://x/a", "x"), ("c", "j", "javascript:1", "")]
    links = spark.createDataFrame([(s, k, u, u, d, d, "") for s, k, u, d in rows], "source_url_key string, url_key string, raw string, canonical string, domain string, reg_domain string, anchor string")
    start = spark.createDataFrame([("a", "x", 1.0, 0)], "url_key string, reg_domain string, priority double, depth int")
    score = lambda df: df.withColumn("priority", F.when(F.col("url_key") == "c", 0.9).otherwise(0.1))
    visited, audit, why = rounds.Walk(spark, pages, links, score, rounds.Limits(round_size=1)).run(start)
    assert [(r.url_key, r.depth) for r in visited.orderBy("round").collect()] == [("a", 0), ("c", 1), ("b", 1)]
    assert why == "FRONTIER_DRAINED"
    assert {r.url_key: r.drop_reason for r in audit.collect()} == {"b": None, "c": None, "p": "extension", "a": "dedup", "j": "protocol"}
    visited, _, why = rounds.Walk(spark, pages, links, score, rounds.Limits(max_pages=2, round_size=9)).run(start)
    assert visited.count() == 2 and why == "BUDGET_PAGES"


def star(spark, n, extra=()):
    """A start page that leads to n pages of one site each, and further links."""
    rows = [("s", f"p{i:02}", f"https://d{i:02}.org/p", f"d{i:02}.org") for i in range(n)] + list(extra)
    links = spark.createDataFrame([(a, b, u, u, d, d, "") for a, b, u, d in rows], "source_url_key string, url_key string, raw string, canonical string, domain string, reg_domain string, anchor string")
    old = datetime.datetime(2020, 1, 1)
    pages = spark.createDataFrame([("s", "https://s.org/", "s.org", None)] + [(b, u, d, old) for _, b, u, d in rows], "url_key string, canonical string, reg_domain string, published_at timestamp").dropDuplicates(["url_key"])
    return pages, links, spark.createDataFrame([("s", "s.org", 1.0, 0)], "url_key string, reg_domain string, priority double, depth int")


def judge_as(classification, relevance=0.0, hub=0.0, endorsed=(), tokens=10):
    def judge(pages):
        text = "array<string>"
        return pages.select(
            "url_key", F.col("canonical").alias("url"), F.col("reg_domain").alias("domain"), F.lit("t").alias("title"), F.lit(classification).alias("classification"), F.lit(relevance).alias("relevance_score"),
            F.lit(hub).alias("hub_score"), F.array().cast(text).alias("topics"), F.when(F.col("url_key") == "s", F.array(*map(F.lit, endorsed))).otherwise(F.array()).cast(text).alias("endorsed_links"), F.lit(tokens).cast("long").alias("tokens"),
        )

    return judge


def failing_judge(pages):
    fail = F.udf(lambda x: 1 / 0, "string")
    return judge_as("RELEVANT")(pages).withColumn("title", fail("title"))


STOPS = {
    "BUDGET_TOKENS": (dict(max_tokens=10), judge_as("RELEVANT"), 1),
    "TIME_HORIZON": (dict(since=datetime.datetime(2026, 1, 1)), None, 25),
    "FATAL": ({}, failing_judge, 1),
    "DIMINISHING_RETURNS": ({}, judge_as("IRRELEVANT"), 25),
    "BUDGET_TIME": (dict(max_duration=50), None, 1),
    "USER_REQUESTED": ({}, None, 0),
}


@pytest.mark.parametrize("reason", sorted(STOPS))
def test_each_stop_reason_ends_a_walk(spark, reason):
    more, judge, fetched = STOPS[reason]
    pages, links, start = star(spark, 30)
    now = iter(range(0, 10_000, 30))
    walk = rounds.Walk(spark, pages, links, lambda df: df.withColumn("priority", F.lit(0.5)), rounds.Limits(round_size=24, **more), judge=judge, clock=lambda: next(now) if reason == "BUDGET_TIME" else 0.0)
    if reason == "USER_REQUESTED":
        walk.request_stop()
    visited, _, why = walk.run(start)
    assert why == reason and visited.count() == fetched
    if reason == "FATAL":
        assert "division by zero" in walk.fatal


def test_a_walk_is_steered_by_what_it_judges(spark):
    """Hubs raise their links, endorsed links go first, robots and open circuits keep links out."""
    end = hashlib.sha256(b"https://end.org/x").hexdigest()[:16]
    extra = [("s", "rob", "https://rob.org/private/x", "rob.org"), ("s", "open", "https://open.org/x", "open.org"), ("s", end, "https://end.org/x", "end.org")]
    pages, links, start = star(spark, 3, extra)
    links = links.withColumn("domain_prior", F.lit(None).cast("double"))
    robots = spark.createDataFrame([("rob.org", "User-agent: *\nDisallow: /private/")], "domain string, raw string")
    responses = spark.createDataFrame([("open.org", datetime.datetime(2026, 1, 1), i, 503) for i in range(5)], "domain string, ts timestamp, seq int, status int")
    priors = spark.createDataFrame([("d01.org", 3, 1, 3.2)], "reg_domain string, times_relevant long, times_irrelevant long, sum_relevance double")
    score = lambda df: df.withColumn("priority", F.coalesce("domain_prior", F.lit(0.2)))
    at = datetime.datetime(2026, 1, 1, 0, 1, tzinfo=datetime.UTC).timestamp()
    walk = rounds.Walk(spark, pages, links, score, rounds.Limits(round_size=1, max_pages=3), judge=judge_as("HUB", 0.9, 0.9, ["https://end.org/x", "https://rob.org/private/x"]), robots=robots, responses=responses, priors=priors, clock=lambda: at)
    visited, audit, why = walk.run(start)
    assert [(r.url_key, r.priority) for r in visited.orderBy("round").collect()] == [("s", 1.0), ("p01", 1.2), (end, 1.0)] and why == "BUDGET_PAGES"
    assert {r.url_key: r.drop_reason for r in audit.filter("round = 1").collect()} == {"p00": None, "p01": None, "p02": None, end: None, "rob": "robots", "open": "robots"}
    assert {r.reg_domain: r.domain_prior for r in walk.priors().collect()} == {"s.org": 0.9, "end.org": 0.9, "d01.org": 0.82}


def replay_walk(edges, n_pages, limits):
    """The walk of crawl_rounds in plain Python."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    frontier, visited, number = {0: (1.0, 0, 0)}, {}, 0
    domain = lambda x: x % 7 if x else 0
    done = lambda: Counter(domain(x) for x in visited)
    while frontier and len(visited) < limits.max_pages:
        before, nth, order = done(), Counter(), []
        for x in sorted(frontier, key=lambda x: (-frontier[x][0], frontier[x][1], f"n{x}")):
            nth[domain(x)] += 1
            if nth[domain(x)] + before[domain(x)] <= limits.domain_budget:
                order.append(x)
        best = order[: min(limits.round_size, limits.max_pages - len(visited))]
        if not best:
            break
        number += 1
        for x in best:
            visited[x] = (*frontier.pop(x), number)
        seen, after, fresh = {*visited, *frontier}, done(), {}
        for x in best:
            depth = visited[x][2] + 1
            for y in out.get(x, ()):
                if y not in seen and depth <= limits.depth_limit and after[domain(y)] < limits.domain_budget and 0 <= y < n_pages:
                    fresh[y] = min(fresh.get(y, depth), depth)
        frontier |= {y: (y * 37 % 100 / 100.0, number, d) for y, d in fresh.items()}
    return {f"n{x}": (p, d, r) for x, (p, _, d, r) in visited.items()}


def test_crawl_rounds_equals_a_replay(spark):
    from trailbase.plans import crawl_queries

    edges = [tuple(r) for r in crawl_queries._edges(spark, SF).collect()]
    n = spark.read.parquet(f"{SF}/pages.parquet").count()
    got = {r.url_key: (r.priority, r.depth, r.round) for r in registry.queries()["crawl_rounds"](spark, SF).collect()}
    assert got == replay_walk(edges, n, rounds.Limits()) and len(got) > 20


def test_seeds_of_a_column_keep_their_commas(spark):
    rows = spark.createDataFrame([("https://e.com/a,b",), (None,), (" ",)], "u string")
    assert [r.canonical for r in seeds.from_column(rows, F.col("u")).collect()] == ["https://e.com/a,b"]


def test_seeds(spark, tmp_path):
    assert sorted(r.canonical for r in seeds.manual(spark, "https://E.com/a, ,http://b.org").collect()) == ["http://b.org/", "https://e.com/a"]
    (tmp_path / "a.json").write_text('{"seeds": ["https://e.com", 7, " "], "allowed_domains": ["E.com"]}')
    (tmp_path / "b.json").write_text('["https://e.com/x"]')
    (tmp_path / "c.json").write_text("7")
    got = seeds.json_file(spark, f"file://{tmp_path}/a.json")
    assert [r.canonical for r in got[0].collect()] == ["https://e.com/"] and [r.reg_domain for r in got[1].collect()] == ["e.com"]
    assert [r.canonical for r in seeds.json_file(spark, f"file://{tmp_path}/b.json")[0].collect()] == ["https://e.com/x"]
    assert seeds.json_file(spark, f"file://{tmp_path}/c.json")[0].count() == 0
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>t</title><link>https://e.com/1</link></item><item><link>https://e.com/2</link></item></channel></rss>")
    assert seeds.feed(spark, f"file://{tmp_path}/f.xml").count() == 2
    (tmp_path / "g.xml").write_text('<feed><entry><link href="https://e.com/3"/></entry></feed>')
    assert [r.canonical for r in seeds.feed(spark, f"file://{tmp_path}/g.xml", "entry").collect()] == ["https://e.com/3"]
    (tmp_path / "bl.json").write_text('{"domains": ["bad.org"]}')
    assert [r.reg_domain for r in seeds.blacklist(spark, f"file://{tmp_path}/bl.json").collect()] == ["bad.org"] and seeds.blacklist(spark, None).count() == 1


def test_fetch_policy():
    answers = {
        "ok": [fetch.Response(200, {}, b"x")], "moved": [fetch.Response(301, {"location": "ok"}, b"")], "loop": [fetch.Response(302, {"location": "loop"}, b"")], "gone": [fetch.Response(404, {}, b"")],
        "busy": [fetch.Response(429, {"retry-after": "7"}, b""), fetch.Response(200, {}, b"y")], "down": [fetch.Response(500, {}, b"")] * 3,
    }
    waits = []

    def client(url):
        if url == "line":
            raise OSError("reset")
        return answers[url].pop(0) if len(answers[url]) > 1 else answers[url][0]

    one = lambda u: fetch.fetch_one(client, u, waits.append)
    assert one("ok")["outcome"] == "ok" and one("moved")["redirects"] == 1 and one("loop")["error"] == "redirect loop"
    assert (one("gone")["attempts"], one("busy")["html"], one("down")["attempts"], one("line")["error"]) == (1, b"y", 3, "reset")
    assert waits[0] == 7.0 and 2.0 in waits and 4.0 in waits


def test_fetch_reads_dates_and_relative_targets():
    now = datetime.datetime(2026, 1, 1, 12, tzinfo=datetime.UTC)
    assert fetch.retry_after("Thu, 01 Jan 2026 12:00:30 GMT", now) == 30.0 and fetch.retry_after("Thu, 01 Jan 2026 11:00:00 GMT", now) == 0.0
    assert [fetch.retry_after(x, now) for x in ("12", " 3 ", None, "", "soon", "-4", "1.5", "99999-99")] == [12.0, 3.0, *[fetch.RETRY_AFTER] * 6]
    moved = {"https://e.com/a/b": "../c?x", "https://e.com/c?x": "//f.org/d", "https://f.org/d": "/end", "https://e.com/loop": "loop#", "https://e.com/bad": "http://[x"}
    asked = []

    def client(url):
        asked.append(url)
        return fetch.Response(302, {"location": moved[url]}, b"") if url in moved else fetch.Response(200, {}, b"here")

    one = fetch.fetch_one(client, "https://e.com/a/b", lambda s: None)
    assert (one["final_url"], one["redirects"], one["html"]) == ("https://f.org/end", 3, b"here")
    assert asked == ["https://e.com/a/b", "https://e.com/c?x", "https://f.org/d", "https://f.org/end"]
    assert fetch.fetch_one(client, "https://e.com/loop", lambda s: None)["outcome"] == "failed"
    assert fetch.fetch_one(client, "https://e.com/bad", lambda s: None)["attempts"] == 1
    dated = [fetch.Response(429, {"retry-after": "Wed, 21 Oct 2015 07:28:00 GMT"}, b""), fetch.Response(200, {}, b"ok")]
    assert fetch.fetch_one(lambda url: dated.pop(0), "https://e.com/", lambda s: None)["html"] == b"ok"


def test_fetch_table(spark):
    rows = spark.createDataFrame([("k", "https://e.com/")], "url_key string, canonical string")
    assert fetch.fetch(rows, lambda: lambda url: fetch.Response(200, {}, url.encode())).first().html == b"https://e.com/"
    assert fetch.replay(rows, spark.createDataFrame([("k", "h")], "url_key string, html string")).count() == 1


def test_stream_breaker_equals_fold(spark, tmp_path):
    t0 = datetime.datetime(2026, 1, 1)
    rows = [("d", t0 + datetime.timedelta(seconds=i), s) for i, s in enumerate([429, 429, 503, 200, 429])]
    spark.createDataFrame(rows, "domain string, ts timestamp, status int").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema("domain string, ts timestamp, status int").parquet(f"file://{tmp_path}/in")
    out = stream.run_to_table(stream.circuit_breaker(source, threshold=3), "breaker_test", "update").collect()
    assert len(out) == 1 and out[0].fails == 1 and out[0].open_until == (t0 + datetime.timedelta(seconds=602)).timestamp()


def test_stream_sessions_and_file_sink(spark, tmp_path):
    out = stream.run_to_table(stream.sessions(stream.event_stream(spark, SF)), "sessions_test", "complete")
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    stream.run_to_files(stream.event_stream(spark, SF).select("event_id"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1000


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_walk_resumes_after_its_last_round(spark, tmp_path):
    pages = spark.createDataFrame([(k, "x") for k in "abcd"], "url_key string, reg_domain string")
    links = spark.createDataFrame([(s, k, f"https://x/{k}", f"https://x/{k}", "x", "x", "") for s, k in ("ab", "bc", "cd")], "source_url_key string, url_key string, raw string, canonical string, domain string, reg_domain string, anchor string")
    start = spark.createDataFrame([("a", "x", 1.0, 0)], "url_key string, reg_domain string, priority double, depth int")
    score = lambda df: df.withColumn("priority", F.lit(0.5))
    path = f"file://{tmp_path}/walk"
    rounds.Walk(spark, pages, links, score, rounds.Limits(max_pages=2, round_size=1), path).run(start)
    (tmp_path / "walk" / "popped3").mkdir()  # a round that broke off
    visited, audit, why = rounds.Walk(spark, pages, links, score, rounds.Limits(round_size=1), path).resume()
    assert sorted(r.url_key for r in visited.collect()) == list("abcd") and audit.count() == 3 and why == "FRONTIER_DRAINED"


def test_endorsed_links_become_items(spark):
    judged = spark.createDataFrame([("https://e.com/a/", ["b", "c.pdf", "b"])], "url string, endorsed_links array<string>")
    depths = spark.createDataFrame([("https://e.com/a/", 2)], "url string, depth int")
    out = rounds.endorsed_items(judged, depths, spark.createDataFrame([], "url_key string")).collect()
    assert [(r.canonical, r.depth, r.priority) for r in out] == [("https://e.com/a/b", 3, 1.0)]


def test_goal_and_analysis(spark):
    from trailbase.operators import analyze

    now = datetime.datetime(2026, 3, 1, tzinfo=datetime.UTC)
    goal = analyze.enhance("Rust compilers", lambda p: 'x {"goal_statement": " s ", "keywords": ["a", " a", 3, "b"], "since": "2026-01-01",}', now)
    assert (goal.statement, goal.keywords, goal.since.month) == ("s", ("a", "b"), 1) and len(goal.goal_id) == 12
    assert analyze.enhance("Rust rust c", None, now).keywords == ("rust", "c")

    def broken(prompt):
        raise OSError

    assert analyze.enhance("x", broken, now).statement == ""
    pages = spark.createDataFrame([("k1", "https://e.com/1", "t", "body", 1), ("k2", "https://e.com/2", None, "  ", 2), ("k3", "https://e.com/3", "t", "odd", 3)], "url_key string, canonical string, title string, plain_text string, fetched_seq int")
    model = lambda p: "no" if "odd" in p else '{"classification": "HUB", "relevance_score": 0.5}'
    out = {r.url_key: r for r in analyze.analyze(pages, goal, model).collect()}
    assert (out["k1"].outcome, out["k1"].classification, out["k2"].outcome, out["k3"].outcome, out["k3"].attempt) == ("ok", "HUB", "empty", "failed", 3)
    done = analyze.analyze(pages, goal, model)
    assert analyze.replay(pages, done, goal, model).count() == 0
    assert [r.url_key for r in analyze.replay(pages, done, goal, model, force=True, limit=1).collect()] == ["k1"]


def test_services():
    from trailbase.sources import services

    calls = iter([OSError("x"), ("hi", 3, 4), ("ho", 3, 4)])

    def post(prompt):
        answer = next(calls)
        if isinstance(answer, OSError):
            raise answer
        return answer

    chat = services.Chat(post, services.TokenBudget(limit=7), sleep=lambda s: None)
    assert chat("p") == "hi" and chat.budget.total == 7 and chat.budget.calls == 1
    with pytest.raises(services.BudgetExceededError):
        chat("p")
    embed = services.remote_embedder(lambda texts: [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts)))], most=2)
    assert embed(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]]


def fake_model(prompt):
    return '{"classification": "RELEVANT", "relevance_score": 0.8, "tags": ["t"]}'


def fake_embedder(texts):
    return [[1.0, 0.0] for _ in texts]


def test_command_line(spark, tmp_path, capsys):
    from trailbase import cli

    root = f"file://{tmp_path}/store"
    page = lambda links: "<title>T</title><p>words here</p>" + "".join(f"<a href='{x}'>go</a>" for x in links)
    spark.createDataFrame([(1, "https://e.com/a", page(["/b", "/n.pdf"])), (2, "https://e.com/b", page(["/a"])), (3, "https://e.com/c", page([]))], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages")
    common = ["run", "words here", "--pages", f"file://{tmp_path}/pages", "--seeds", "https://e.com/a", "--round-size", "1"]
    cli.main([*common, "--store", f"{root}1"])
    assert ": 1 pages, ended by FRONTIER_DRAINED" in capsys.readouterr().out  # the rules find "go" too poor
    cli.main([*common, "--store", f"{root}2", "--embedder", "tests.test_plans:fake_embedder", "--model", "tests.test_plans:fake_model"])
    assert ": 2 pages" in capsys.readouterr().out  # with vectors the nearest stay
    (tmp_path / "settings").write_text("TRAILBASE_RULE_THRESHOLD=0.0\n")
    common += ["--settings", str(tmp_path / "settings")]
    spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /b")], "domain string, raw string").write.parquet(f"file://{tmp_path}/robots")
    (tmp_path / "black.json").write_text('{"domains": ["e.com"]}')
    for barred in (["--robots", f"file://{tmp_path}/robots"], ["--blacklist", f"file://{tmp_path}/black.json"]):
        cli.main([*common, "--store", f"{root}3", *barred])
        assert ": 1 pages" in capsys.readouterr().out
    cli.main([*common, "--store", root])
    said = capsys.readouterr().out
    assert "2 pages, ended by FRONTIER_DRAINED" in said
    run_id = said.split(":")[0]
    cli.main(["report", "--store", root, "--run", run_id])
    told = capsys.readouterr().out.splitlines()
    assert told[:4] == ["walk ended: COMPLETED (FRONTIER_DRAINED)", "  pages:      2 in 2 rounds", "  links:      3 found, 1 kept, 1 queued", "  dropped:    1 dedup, 1 extension"] and told[-1].startswith("  duration:")
    for _ in range(2):  # the second replay finds nothing to do
        cli.main(["replay", "--store", root, "--run", run_id, "--model", "tests.test_plans:fake_model"])
        assert "2 analyses" in capsys.readouterr().out
    cli.main(["inspect", "--store", root, "--run", run_id])
    assert "RELEVANT: 2" in capsys.readouterr().out
    cli.main(["inspect", "--store", root, "--run", run_id, "--export", "json", "--to", f"file://{tmp_path}/out"])
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_settings_layers(tmp_path, monkeypatch):
    from trailbase.settings import Settings

    (tmp_path / "env").write_text("# comment\nTRAILBASE_MAX_PAGES=7\nTRAILBASE_KEEP='9'\nOTHER=1\n")
    monkeypatch.setenv("TRAILBASE_MAX_PAGES", "8")
    s = Settings.load(f"{tmp_path}/env", round_size=3, depth_limit=None)
    assert (s.max_pages, s.keep, s.round_size, s.depth_limit) == (8, 9, 3, 5) and s.limits().max_pages == 8


def test_every_drop_reason_occurs(spark):
    got = {r.reason for r in registry.queries()["prefilter_every_rule"](spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    probed = {r.reason for r in registry.queries()["prefilter_reasons"](spark, SF).collect()}
    assert got | probed == {"kept", "scope", "dedup", "blacklist", "robots", "protocol", "extension", "url_pattern", "depth", "domain_budget", "negative_anchor"}


def test_registered_walk_goes_past_forty_pages(spark):
    assert registry.queries()["crawl_rounds"](spark, "/root/testdata/sf0.001").count() > 40
