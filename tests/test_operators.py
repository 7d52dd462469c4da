import datetime

from pyspark.sql import functions as F

from trailbase.operators import analytics, circuits, evals, feedback, frontier, prefilter, rank, robots, stop, store

T0 = datetime.datetime(2026, 1, 1)


def test_prefilter_order_and_pass(spark):
    rows = [
        ("javascript:x", "javascript:x", "k0", "", "", 1, "a"), ("https://e.com/login/a.pdf", "https://e.com/login/a.pdf", "k1", "e.com", "e.com", 9, "a"), ("https://e.com/login/", "https://e.com/login/", "k2", "e.com", "e.com", 1, "a"),
        ("https://e.com/login", "https://e.com/login", "k3", "e.com", "e.com", 1, "read more"), ("https://www.wikidata.org/x.pdf", "https://www.wikidata.org/x.pdf", "k4", "www.wikidata.org", "wikidata.org", 1, "a"),
        ("https://e.com/deep", "https://e.com/deep", "k5", "e.com", "e.com", 6, "a"), ("https://e.com/☀", "https://e.com/☀", "k6", "e.com", "e.com", 1, "a"), ("https://o.org/", "https://o.org/", "k7", "o.org", "o.org", 1, "a"),
    ]
    frame = spark.createDataFrame(rows, "raw string, canonical string, url_key string, domain string, reg_domain string, depth int, anchor string")
    reasons = lambda **k: {r.url_key: r.drop_reason for r in prefilter.with_reason(frame, **k).collect()}
    assert reasons() == {"k0": "protocol", "k1": "extension", "k2": "url_pattern", "k3": None, "k4": "blacklist", "k5": "depth", "k6": "url_pattern", "k7": None}
    assert reasons(negative_anchor=True)["k3"] == "negative_anchor"
    assert reasons(seen=spark.createDataFrame([("k7",)], "url_key string"))["k7"] == "dedup"
    done = spark.createDataFrame([("o.org", 50)], "reg_domain string, domain_done int")
    assert reasons(done=done)["k7"] == "domain_budget"
    assert reasons(allowed=spark.createDataFrame([("e.com",)], "reg_domain string"))["k7"] == "scope"


def decisions(spark, rows):
    return spark.createDataFrame([(k, k, p, d, "", r) for k, p, d, r in rows], "candidate_id string, url_key string, priority double, dropped boolean, rationale string, ranker string")


def test_blend_and_merge(spark):
    old = decisions(spark, [("k1", 0.3, False, "rule"), ("k2", 0.9, False, "rule")])
    new = decisions(spark, [("k1", 0.8, True, "llm")])
    assert {r.candidate_id: (r.priority, r.dropped, r.ranker) for r in rank.merge(old, new).collect()} == {"k1": (0.8, True, "llm"), "k2": (0.9, False, "rule")}
    assert {r.candidate_id: (r.priority, r.dropped) for r in rank.blend(old, new, 0.7).collect()} == {"k1": (0.65, True), "k2": (0.9, False)}


def test_similarity_keeps_the_first(spark):
    found = spark.createDataFrame([(f"c{i}", f"k{i}", [1.0, float(i), 0.0]) for i in range(5)], "candidate_id string, url_key string, vector array<float>")
    goal = spark.createDataFrame([([1.0, 0.0, 0.0],)], "goal_vector array<float>")
    out = {r.candidate_id: r.dropped for r in rank.similarity_rank(found, goal, 2).collect()}
    assert out == {"c0": False, "c1": False, "c2": True, "c3": True, "c4": True}


def test_model_answers(spark):
    found = spark.createDataFrame([(f"c{i}", f"k{i}", "x") for i in range(5)], "candidate_id string, url_key string, chunk string")
    content = 'ok {"rankings": [{"id": "c0", "priority": 1.7, "rationale": " why "}, {"id": "c1", "priority": true}, {"id": "c2", "priority": 0.25}, {"id": "zz", "priority": 1}, 7], "candidates_to_drop": ["c2", "c3", "nope"],}'
    out = {r.candidate_id: (r.priority, r.dropped, r.rationale) for r in rank.answer_decisions(found, spark.createDataFrame([("x", content)], "chunk string, content string")).collect()}
    assert out == {"c0": (1.0, False, "why"), "c1": (0.5, False, "no_opinion"), "c2": (0.25, False, "llm_priority=0.2500"), "c3": (0.0, True, "llm_drop"), "c4": (0.5, False, "no_opinion")}


def test_asking_repairs_and_survives_errors(spark):
    def model(prompt):
        if "bad" in prompt:
            raise OSError("down")
        model.seen = getattr(model, "seen", 0) + 1
        return "prose" if model.seen == 1 else "{}"

    out = {r.chunk: r for r in rank.ask(spark.createDataFrame([("a", "good"), ("b", "bad")], "chunk string, prompt string").coalesce(1), model).collect()}
    assert out["a"].content == "{}" and out["a"].attempt == 2 and out["b"].error == "OSError: down" and out["b"].content is None


def test_funnel(spark):
    rows = [(f"c{i}", f"k{i}", f"https://e.com/{i}", "rust compiler" if i < 3 else "cats", "", "", 1, "/x", i + 1, 10, None, [1.0, i / 10], 1) for i in range(6)]
    found = spark.createDataFrame(rows, "candidate_id string, url_key string, url string, anchor string, snippet string, source_title string, depth int, href string, position int, link_count int, domain_prior double, vector array<double>, source_page int")
    alone = {r.candidate_id: r for r in rank.plan(found, ["rust", "compiler"]).collect()}
    assert min(alone[f"c{i}"].priority for i in range(3)) > max(alone[f"c{i}"].priority for i in range(3, 6))
    strict = {r.candidate_id: r.dropped for r in rank.rule_rank(found, ["rust", "compiler"], 0.6).collect()}
    assert not strict["c0"] and strict["c5"]
    goal = spark.createDataFrame([([1.0, 0.0],)], "goal_vector array<double>")
    assert {r.ranker for r in rank.plan(found, ["rust"], goal).collect()} == {"embedding"}
    asked = rank.plan(found, ["rust", "compiler"], None, lambda p: '{"rankings": [{"id": "c1", "priority": 0.9}]}', "rust").collect()
    assert {r.candidate_id: r.priority for r in asked}["c1"] == 0.9

    # A stage that fails leaves what came before it.
    def broken(*_):
        raise OSError("no service")

    by_rule = {r.candidate_id: (r.priority, r.dropped, r.ranker) for r in rank.plan(found, ["rust", "compiler"]).collect()}
    assert {r.candidate_id: (r.priority, r.dropped, r.ranker) for r in rank.plan(found, ["rust", "compiler"], broken).collect()} == by_rule
    for model in (broken, lambda p: "no JSON here"):
        kept = {r.candidate_id: (r.priority, r.ranker) for r in rank.plan(found, ["rust", "compiler"], None, model, "rust").collect()}
        assert kept == {k: (p, r) for k, (p, _, r) in by_rule.items()}


def test_vector_cache(spark):
    texts = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h1", "a")], "content_hash string, text string")
    cache = spark.createDataFrame([("h1", [1.0, 2.0]), ("h2", [1.0])], "content_hash string, vector array<float>")
    every, new = rank.cached_vectors(texts, cache, lambda batch: [[9.0, 9.0]] * len(batch), 2)
    assert {r.content_hash: r.vector for r in every.collect()} == {"h1": [1.0, 2.0], "h2": [9.0, 9.0]} and new.count() == 1


def items(spark, rows):
    return spark.createDataFrame([(k, p, d, 0, T0 + datetime.timedelta(seconds=w), T0, s, "ready") for k, p, d, w, s in rows], "url_key string, priority double, reg_domain string, depth int, next_available_at timestamp, enqueued_at timestamp, seq long, status string")


def test_frontier(spark):
    now = F.lit(T0 + datetime.timedelta(seconds=60))
    none = spark.createDataFrame([], "reg_domain string, allowed_at timestamp, used int")
    state = items(spark, [("a", 0.1, "d1", 0, 1), ("b", 0.9, "d1", 0, 2), ("c", 0.5, "d2", 0, 3), ("e", 1.0, "d3", 900, 4), ("f", 0.5, "d4", 0, 5)])
    order = lambda *a, **k: [r.url_key for r in frontier.pop(state, now, *a, **k).orderBy(F.desc("priority"), "seq").collect()]
    assert order(none, 5, 10) == ["b", "c", "f", "a"]
    assert order(none, 1, 10) == ["b", "c", "f"]
    assert order(none, 5, 10, global_left=1) == ["b"]
    gated = spark.createDataFrame([("d1", T0 + datetime.timedelta(hours=1), 0), ("d2", T0, 5)], "reg_domain string, allowed_at timestamp, used int")
    assert order(gated, 5, 10) == ["f"]
    pushed = frontier.push(state, items(spark, [("a", 1.0, "d9", 0, 9), ("v", 1.0, "d9", 0, 10), ("n", 1.0, "d9", 0, 11), ("n", 0.2, "d9", 0, 12)]), spark.createDataFrame([("v",)], "url_key string"))
    assert sorted(r.url_key for r in pushed.collect()) == ["a", "b", "c", "e", "f", "n"]
    aged = {r.url_key: r.priority for r in frontier.release(state.withColumn("status", F.lit("pending")), now).collect()}
    assert abs(aged["a"] - 0.2) < 1e-9 and aged["e"] == 1.0
    keys, done = frontier.outcomes(spark.createDataFrame([("z",)], "url_key string"), spark.createDataFrame([("d1", 1)], "reg_domain string, domain_done long"), spark.createDataFrame([("a", "d1", "COMPLETED"), ("b", "d1", "FAILED")], "url_key string, reg_domain string, status string"))
    assert keys.count() == 3 and {r.reg_domain: r.domain_done for r in done.collect()} == {"d1": 2}


def test_buffer(spark):
    rows = spark.createDataFrame([("a", 1, 5, 1), ("b", 0, 1, 2), ("c", 3, 1, 3), ("a", 0, 0, 4)], "url_key string, depth int, position int, arrival long")
    assert sorted(r.url_key for r in frontier.buffer_keep(rows, 2).collect()) == ["a", "b"]
    assert [r.url_key for r in frontier.drain(rows, 1).collect()] == ["a"]
    wait = datetime.timedelta(seconds=31)
    assert frontier.buffer_ready(100, datetime.timedelta(), False) and frontier.buffer_ready(1, wait, False) and frontier.buffer_ready(1, datetime.timedelta(), True) and not frontier.buffer_ready(0, wait, True)


def test_circuit(spark):
    rows = [("d", T0 + datetime.timedelta(seconds=10 * i), i, s) for i, s in enumerate([429, 429, 404, 429, 200, 429])]
    responses = spark.createDataFrame(rows, "domain string, ts timestamp, seq long, status int")
    states = circuits.circuit_states(responses, threshold=3)
    assert [r.fails for r in states.orderBy("seq").collect()] == [1, 2, 2, 3, 0, 1]
    own = (0, 0.0, 0.0)
    for _, ts, _, status in rows:
        own = circuits.breaker_step(own, status, ts.timestamp(), threshold=3)
    last = states.orderBy(F.desc("seq")).first()
    assert own[0] == last.fails and own[1] == last.next_allowed.timestamp() and own[2] == last.open_until.timestamp()
    closed = lambda s: circuits.circuit_allows(circuits.circuits_now(responses, threshold=3), F.lit(T0 + datetime.timedelta(seconds=s))).first().closed
    assert not closed(60) and closed(700)


def test_robots_rules(spark):
    rows = spark.createDataFrame([("e.com", "https://e.com/admin/secret"), ("e.com", "https://e.com/about"), ("x.org", "https://x.org/admin")], "domain string, canonical string")
    rules = spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /admin")], "domain string, raw string")
    assert {r.canonical: r.robots_allows for r in robots.robots_flags(rows, robots.rules_relation(rules)).collect()} == {"https://e.com/admin/secret": False, "https://e.com/about": True, "https://x.org/admin": True}
    status = spark.createDataFrame([(s,) for s in (200, 301, 404, 429, 503)], "s int").select(robots.status_class(F.col("s")).alias("c"))
    assert [r.c for r in status.collect()] == ["ok", "redirect", "failed", "retry", "retry"]


def judged(spark, rows):
    full = [(i, d, f"u{i}", f"t{i}", c, r, h, list(t), [], "t") for i, (d, c, r, h, t) in enumerate(rows)]
    return spark.createDataFrame(full, "seq long, domain string, url string, title string, classification string, relevance_score double, hub_score double, topics array<string>, endorsed_links array<string>, task_id string")


def test_multipliers(spark):
    rows = [(d, c, 0.5, 0.0, []) for d, cs in (("a", "RH"), ("b", "RHR"), ("c", "INU"), ("d", "RRI"), ("e", "RRRI")) for c in ({"R": "RELEVANT", "H": "HUB", "I": "IRRELEVANT", "N": "NAVIGATION", "U": "UNKNOWN"}[x] for x in cs)]
    rows = judged(spark, rows)
    assert {r.domain: r.multiplier for r in feedback.domain_multipliers(rows).collect()} == {"a": 1.0, "b": 1.2, "c": 0.6, "d": 1.0, "e": 1.0}
    last = {r.domain: r.multiplier for r in feedback.rolling_verdicts(rows).orderBy("seq").collect()}
    assert last == {"a": 1.0, "b": 1.2, "c": 0.6, "d": 1.0, "e": 1.0}


def test_hubs_topics_recent_and_priors(spark):
    rows = judged(spark, [(f"d{i}", "HUB", 0.1, 0.5 + i / 100, ["rust"] if i < 2 else [f"t{i}"]) for i in range(7)] + [("x", "RELEVANT", 0.9, 0.4, []), ("x", "RELEVANT", 0.7, 0.0, []), ("x", "IRRELEVANT", 0.1, 0.0, [])])
    assert [r.domain for r in feedback.top_hubs(rows).orderBy(F.desc("hub_score")).collect()] == ["d6", "d5", "d4", "d3", "d2"]
    assert [r.topic for r in feedback.top_topics(rows, 3).collect()] == ["rust", "t2", "t3"]
    assert [r.seq for r in feedback.recent_relevant(rows).collect()] == [7, 8]
    assert {r.reg_domain: r.average for r in feedback.prior_averages(feedback.prior_deltas(rows)).collect()}["x"] == 0.5667
    s = feedback.summary(rows).first()
    assert s.pages_seen == 10 and s.hub_domains[0] == "d6" and len(s.relevant_pages) == 2
    steered = feedback.steer(spark.createDataFrame([("d0", "u0", 0.5), ("q", "u9", 0.5)], "reg_domain string, source_url string, priority double"), rows)
    assert {r.reg_domain: r.priority for r in steered.collect()} == {"d0": 0.75, "q": 0.5}


def test_summary_adds_stored_priors(spark):
    rows = judged(spark, [("a", "RELEVANT", 0.9, 0.0, []), ("a", "IRRELEVANT", 0.1, 0.0, []), ("b", "HUB", 0.5, 0.0, [])])
    stored = spark.createDataFrame([("a", 2, 0, 2.0), ("z", 0, 4, 0.4)], "reg_domain string, times_relevant long, times_irrelevant long, sum_relevance double")
    assert feedback.summary(rows).first().domain_priors == {"a": 0.5, "b": 0.5}
    assert feedback.summary(rows, stored).first().domain_priors == {"a": 0.75, "b": 0.5, "z": 0.1}


def test_own_rules_replace_the_default_ones(spark):
    rows = spark.createDataFrame([("https://e.com/a.pdf", "k1"), ("https://e.com/b", "k2")], "canonical string, url_key string")
    out = prefilter.with_reason(rows, rules=[("odd", F.col("url_key") == "k2")])
    assert {r.url_key: r.drop_reason for r in out.collect()} == {"k1": None, "k2": "odd"}


def test_appended_rows_have_growing_numbers_of_their_own(spark, tmp_path):
    from trailbase.operators.store import RunStore

    runs = RunStore(spark, f"file://{tmp_path}/store")
    for batch in range(2):
        runs.append("events", f"r{batch}", spark.range(5000).repartition(3).selectExpr("id", f"{batch} as batch", "'t' as task_id"))
    rows = runs.read("events")
    first, second = (rows.filter(f"batch = {b}").agg(F.count_distinct("seq"), F.min("seq"), F.max("seq")).first() for b in (0, 1))
    assert first[0] == second[0] == 5000 and first[2] - first[1] == 4999 and second[1] > first[2]
    assert runs.has("events", "r1") and not runs.has("pages")


def test_domain_prior_floor(spark):
    prior = rank.domain_prior(spark.createDataFrame([("a", 0.9), ("b", 0.2), ("", 1.0)], "reg_domain string, average double"), spark.createDataFrame([("b",), ("hub",)], "reg_domain string"))
    assert {r.reg_domain: r.domain_prior for r in prior.collect()} == {"a": 0.9, "b": 0.75, "hub": 0.75}


def test_streak_and_window(spark):
    ages = ["old", None, "old", "new", "old", "old"]
    rows = [("t", i, None if a is None else T0 + datetime.timedelta(days=-9 if a == "old" else 9)) for i, a in enumerate(ages)]
    out = feedback.stale_streak(spark.createDataFrame(rows, "task_id string, seq long, published_at timestamp"), F.lit(T0))
    assert [r.streak for r in out.orderBy("seq").collect()] == [1, 2, 0, 1, 2]
    calls = feedback.token_spend(spark.createDataFrame([("t", i, 40) for i in range(4)], "task_id string, seq long, tokens long"), 100)
    assert [r.spent for r in calls.orderBy("seq").collect()] == [False, False, True, True]


def test_stop_reasons(spark):
    base = {"max_pages": 5, "fetched": 0, "max_tokens": 0, "tokens_used": 9, "max_duration": 10, "elapsed": 1, "since": None, "stale_streak": 9, "fatal_error": "", "state": "RUNNING", "judged": 0, "relevant": 0, "frontier_size": 1, "buffer_size": 0, "in_flight": 0}
    schema = "max_pages int, fetched int, max_tokens int, tokens_used int, max_duration int, elapsed int, since timestamp, stale_streak int, fatal_error string, state string, judged int, relevant int, frontier_size int, buffer_size int, in_flight int"
    changes = [{}, {"fetched": 5}, {"elapsed": 10, "fetched": 9}, {"since": T0}, {"fatal_error": "x"}, {"state": "STOPPING"}, {"judged": 20, "relevant": 1}, {"judged": 20, "relevant": 2}, {"frontier_size": 0}, {"frontier_size": 0, "in_flight": 1}, {"max_tokens": 9}]
    rows = spark.createDataFrame([tuple((base | c).values()) for c in changes], schema).coalesce(1)
    want = [None, "BUDGET_PAGES", "BUDGET_PAGES+BUDGET_TIME", "TIME_HORIZON", "FATAL", "USER_REQUESTED", "DIMINISHING_RETURNS", None, "FRONTIER_DRAINED", None, "BUDGET_TOKENS"]
    assert [r.stop_reasons for r in stop.stop_reasons(rows).collect()] == want


def test_store(spark, tmp_path):
    runs = store.RunStore(spark, f"file://{tmp_path}/runs")
    page = lambda seq, title: spark.createDataFrame([("p1", title, seq)], "page_id string, title string, seq long")
    runs.append("pages", "r1", page(1, "old"))
    runs.append("pages", "r1", page(2, "new"))
    runs.append("pages", "r2", page(1, "other"))
    assert {(r.run_id, r.title) for r in runs.read("pages").collect()} == {("r1", "new"), ("r2", "other")}
    assert runs.read("pages", "r1").count() == 1
    runs.append("events", "r1", spark.createDataFrame([("t", "a"), ("t", "b")], "task_id string, type string"))
    assert runs.read("events").count() == 2
    runs.append("crawl_tasks", "r1", spark.createDataFrame([("t1",)], "task_id string"))
    runs.append("crawl_tasks", "r2", spark.createDataFrame([("t1",)], "task_id string"))
    assert runs.latest_run("t1") == "r2" and runs.latest_run("none") is None


def test_replay_is_idempotent(spark, tmp_path):
    pages = spark.createDataFrame([("a",), ("b",)], "url_key string")
    done = spark.createDataFrame([("a", "g", "v1", "m1")], "url_key string, goal_id string, prompt_version string, model string")
    left = lambda model: sorted(r.url_key for r in store.unjudged(pages, done, "g", "v1", model).collect())
    assert left("") == ["b"] and left("m1") == ["b"] and left("m2") == ["a", "b"]
    every = done.unionByName(store.unjudged(pages, done, "g", "v1").select("url_key", F.lit("g").alias("goal_id"), F.lit("v1").alias("prompt_version"), F.lit("m1").alias("model")))
    assert store.unjudged(pages, every, "g", "v1").count() == 0
    rows = spark.createDataFrame([("a", "RELEVANT", 0.9, ["x", "y"])], "url_key string, classification string, relevance_score double, tags array<string>")
    out = store.export(rows, spark.createDataFrame([("a", "u1", "t", 1), ("a", "u2", "t", 2)], "url_key string, canonical string, title string, fetched_seq long"))
    assert out.first().url == "u2" and out.first().tags == "x,y"
    for kind in ("csv", "json"):
        store.write_export(out, f"file://{tmp_path}/{kind}", kind)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first().tags == "x,y"


def test_best_pages_without_relevant_ones(spark):
    rows = spark.createDataFrame([("a", "HUB", 0.3, 1), ("a", "HUB", 0.9, 2), ("b", "IRRELEVANT", 0.5, 3)], "url_key string, classification string, relevance_score double, seq long")
    pages = spark.createDataFrame([("a", "u", "t")], "url_key string, canonical string, title string")
    assert [(r.url_key, r.relevance_score) for r in analytics.best_pages(rows, pages).orderBy(F.desc("relevance_score")).collect()] == [("a", 0.9), ("b", 0.5)]
    more = rows.union(spark.createDataFrame([("c", "RELEVANT", 0.1, 4)], rows.schema))
    assert [r.url_key for r in analytics.best_pages(more, pages).collect()] == ["c"]


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([("g", 1, 0.9, True), ("g", 2, 0.8, False), ("g", 3, 0.8, True), ("g", 4, None, False)], "g string, idx int, score double, relevant boolean")
    m = evals.metrics(rows, ["g"]).first()
    assert abs(m.ap - (1 + 2 / 3) / 2) < 1e-12 and m.p_at_5 == 0.4 and m.recall_at_60 == 1.0
    assert abs(m.ndcg_at_5 - (1 + 0.5) / (1 + 1 / 1.584962500721156)) < 1e-9
    none = evals.metrics(rows.withColumn("relevant", F.lit(False)), ["g"]).first()
    assert none.ap == 0.0 and none.ndcg_at_5 == 0.0
    p = evals.percentiles(spark.createDataFrame([("a", float(i)) for i in (1, 2, 3, 4)], "g string, v double"), ["g"], "v", {"p25": 0.25}).first()
    assert p.p25 == 1.75


def test_nothing_collects_a_group(spark):
    """The best page of a key and the last row of a key are aggregates with partial results."""
    plan = store.latest(spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("seq")), ("k",))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_running_totals_cross_chunks(spark):
    from trailbase.operators import running

    rows = spark.createDataFrame([("a", i * 3, (i * 7) % 5) for i in range(60)] + [("b", 1, 4)], "k string, seq long, v long")
    out = running.running(rows, "k", "seq", {"s": F.col("v")}, {"m": F.col("v")}, chunk=10).filter("k = 'a'").orderBy("seq").collect()
    values = [(i * 7) % 5 for i in range(60)]
    assert [r.s for r in out] == [sum(values[: i + 1]) for i in range(60)] and [r.m for r in out] == [max(values[: i + 1]) for i in range(60)]
    last = running.last_rows(rows, "k", "seq", 4, {"n": F.lit(True), "big": F.col("v") > 2}, chunk=10).filter("k = 'a'").orderBy("seq").collect()
    assert [r.n for r in last] == [min(i + 1, 4) for i in range(60)]
    assert [r.big for r in last] == [sum(v > 2 for v in values[max(0, i - 3) : i + 1]) for i in range(60)]


def test_store_keeps_the_last_row_of_a_large_batch(spark, tmp_path):
    from trailbase.operators.store import RunStore

    runs = RunStore(spark, f"file://{tmp_path}")
    runs.append("pages", "r", spark.range(0, 5500, 1, 2).select(F.lit("p").alias("page_id"), F.col("id").alias("n")))
    assert [r.n for r in runs.read("pages").collect()] == [5499]
    runs.append("pages", "r", spark.createDataFrame([("p", -1)], "page_id string, n long"))
    assert [r.n for r in runs.read("pages", "r").collect()] == [-1]
