"""Analyses asked again later, and a funnel whose services fail on executors."""

import pytest
from pyspark.sql import functions as F

from trailbase.operators import analyze, rank
from trailbase.operators.analysis_queue import AnalysisQueue

GOAL = analyze.Goal("find rust")
PAGES = "url_key string, canonical string, title string, plain_text string"
GOOD = '{"classification": "HUB", "relevance_score": 0.5}'


class Clock:
    def __init__(self):
        self.now, self.slept = 1000.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def moody(folder):
    """A model that fails on a page as often as its text says, counted in files, as each task has its own memory."""
    import os
    import re
    import uuid

    def model(prompt):
        name, times = re.search(r"page (\w+) fails (\d+)", prompt).groups()
        if name == "poor":
            raise type("BudgetExceededError", (RuntimeError,), {})("all spent")
        before = len([f for f in os.listdir(folder) if f.startswith(f"{name}-")])
        open(f"{folder}/{name}-{uuid.uuid4().hex}", "w").close()
        return GOOD if before >= int(times) else "no JSON"

    return model


def test_failed_analyses_come_back_when_due(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    body = lambda k, n: (k, f"https://e.com/{k}", "t", f"page {k} fails {n}")
    pages = spark.createDataFrame([body("ok", 0), body("once", 1), body("twice", 2), body("never", 9), body("poor", 0), ("blank", "https://e.com/b", "t", " ")], PAGES)
    clock, path = Clock(), f"file://{tmp_path}/queue"
    make = lambda: AnalysisQueue(spark, GOAL, moody(str(tmp_path / "calls")), path, delay=30, clock=clock, sleep=clock.sleep)
    queue = make()
    assert queue.results().count() == 0 and queue.step(None, pages).count() == 0
    first = {r.url_key: (r.outcome, r.attempt) for r in queue.step(pages, pages).collect()}
    assert first == {"ok": ("ok", 1), "poor": ("failed", 1), "blank": ("empty", 1)} and queue.waiting() == 3 and queue.next_due() == 1030
    clock.now += 10
    assert queue.step(None, pages).count() == 0 and queue.waiting() == 3  # not due yet
    queue = make()  # another driver goes on
    assert queue.waiting() == 3
    queue.drain(pages)
    assert clock.slept == [20.0, 30.0] and queue.waiting() == 0
    settled = {r.url_key: (r.outcome, r.attempt, r.classification) for r in queue.results().collect()}
    assert settled == {"ok": ("ok", 1, "HUB"), "once": ("ok", 2, "HUB"), "twice": ("ok", 3, "HUB"), "never": ("failed", 3, None), "poor": ("failed", 1, None), "blank": ("empty", 1, None)}


def candidates(spark, n=9):
    rows = [(f"c{i}", f"k{i}", f"https://e.com/{i}", "rust compiler" if i % 2 else "cats", f"s{i}", "", 1, "/x", i + 1, 10, None) for i in range(n)]
    return spark.createDataFrame(rows, "candidate_id string, url_key string, url string, anchor string, snippet string, source_title string, depth int, href string, position int, link_count int, domain_prior double").coalesce(1)


def test_only_failed_batches_fall_back(spark):
    """An embedder that raises on every batch with a text of its choice: the candidates of that batch are ranked by the rules alone."""
    found = candidates(spark)

    def embedder(texts):
        if any("s4" in t for t in texts):
            raise OSError("no service")
        return [[3.0, 4.0 if "rust" in t else 0.0] for t in texts]

    seen = rank.with_vectors(found, embedder, 3)
    vectors = {r.candidate_id: r.vector for r in seen.collect()}
    lost = {k for k, v in vectors.items() if v is None}
    assert "c4" in lost and 0 < len(lost) <= 3 and all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in vectors.values() if v)
    goal = spark.createDataFrame([([0.0, 1.0],)], "goal_vector array<double>")
    rules = {r.candidate_id: (r.priority, r.dropped, r.ranker) for r in rank.plan(found, ["rust", "compiler"]).collect()}
    got = {r.candidate_id: (r.priority, r.dropped, r.ranker) for r in rank.plan(seen, ["rust", "compiler"], goal).collect()}
    assert set(got) == set(rules) and all(got[k] == rules[k] for k in lost) and {got[k][2] for k in set(got) - lost} == {"embedding"}


def test_wrong_answers_are_failures(spark):
    texts = spark.createDataFrame([("h1", "a"), ("h2", "b")], "content_hash string, text string").coalesce(1)
    out = rank.embed(texts, lambda batch: [[1.0]]).collect()
    assert [r.vector for r in out] == [None, None] and all(r.error.startswith("ValueError: 1 vectors") for r in out)
    every, new = rank.cached_vectors(texts, spark.createDataFrame([("h1", [2.0])], "content_hash string, vector array<float>"), lambda batch: 1 / 0, 1)
    assert {r.content_hash: r.vector for r in every.collect()} == {"h1": [2.0]} and new.count() == 0


@pytest.mark.parametrize("vector", [[0.0, 0.0], [3.0, 4.0], []])
def test_unit_vectors(spark, vector):
    out = spark.createDataFrame([(vector,)], "v array<float>").select(rank.normalised(F.col("v")).alias("v")).first().v
    assert out == pytest.approx([0.6, 0.8] if vector == [3.0, 4.0] else vector)
