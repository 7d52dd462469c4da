"""Folding judgements in batches against the functions that see them all."""

import random

import pytest

from trailbase.operators import feedback
from trailbase.plans import logs
from trailbase.streaming.feedback_state import FeedbackFold, merged

SCHEMA = "seq long, domain string, url string, title string, classification string, relevance_score double, hub_score double, topics array<string>, endorsed_links array<string>"


def judged(seed: int, n: int = 120):
    draw = random.Random(seed)
    rows = []
    for seq in range(n):
        kind = draw.choice(["RELEVANT", "HUB", "IRRELEVANT", "NAVIGATION"])
        rows.append((seq, f"d{draw.randint(0, 8)}.org", f"u{draw.randint(0, 60)}", f"t{seq}", kind, draw.randint(0, 64) / 64, draw.choice([0.0, 0.25, 0.5, 0.75]), draw.sample(["a", "b", "c", "d"], draw.randint(0, 3)), [f"/x{draw.randint(0, 9)}"] * draw.randint(0, 2)))
    return rows


def same(fold, whole):
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert list(map(tuple, fold.recent_relevant().collect())) == list(map(tuple, feedback.recent_relevant(whole).collect()))
    assert list(map(tuple, fold.top_hubs().collect())) == list(map(tuple, feedback.top_hubs(whole).collect()))
    assert list(map(tuple, fold.top_topics().collect())) == list(map(tuple, feedback.top_topics(whole).collect()))
    assert rows(fold.domain_multipliers()) == rows(feedback.domain_multipliers(whole))
    assert rows(fold.hub_pages()) == rows(feedback.hub_pages(whole))
    assert rows(fold.prior_averages()) == rows(feedback.prior_averages(feedback.priors(whole)))
    assert rows(fold.endorsed().select("source_url", "href")) == rows(feedback.endorsed(whole))
    assert fold.pages_seen() == whole.count()


@pytest.mark.parametrize(("seed", "cuts"), [(1, []), (2, [1, 40, 41, 41, 90, 100])])
def test_any_cut_gives_the_whole(spark, tmp_path, monkeypatch, seed, cuts):
    monkeypatch.setattr(logs, "FAN", 3)
    rows = judged(seed)
    random.Random(seed).shuffle(rows)  # batches need not follow seq
    path = f"file://{tmp_path}/state"
    for batch, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        part = spark.createDataFrame(rows[a:b], SCHEMA)
        fold = FeedbackFold(spark, path)  # as after a restart
        assert fold.fold(part, batch) and not fold.fold(part, batch)
    same(FeedbackFold(spark, path), spark.createDataFrame(rows, SCHEMA))


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path, monkeypatch):
    rows, path = judged(3, 40), f"file://{tmp_path}/state"
    fold = FeedbackFold(spark, path)
    fold.fold(spark.createDataFrame(rows[:20], SCHEMA), 0)
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(logs.Manifests, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        fold.fold(spark.createDataFrame(rows[20:], SCHEMA), 1)
    fold = FeedbackFold(spark, path)
    assert fold.batch == 0 and fold.pages_seen() == 20
    fold.fold(spark.createDataFrame(rows[20:], SCHEMA), 1)
    same(fold, spark.createDataFrame(rows, SCHEMA))


def test_a_stream_folds_its_batches(spark, tmp_path):
    rows = judged(4, 30)
    for a in range(0, 30, 10):
        spark.createDataFrame(rows[a : a + 10], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    fold = FeedbackFold(spark, f"file://{tmp_path}/state")
    fold.follow(source, f"file://{tmp_path}/ck")
    assert fold.batch == 2
    same(fold, spark.createDataFrame(rows, SCHEMA))
    assert merged([fold, fold], "totals").first()[0] == 60
