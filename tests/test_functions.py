import datetime

import pytest
from pyspark.sql import functions as F

from trailbase.functions import dates, json_text, scores, text

def now():
    return F.to_timestamp(F.lit("2026-11-01 00:00:00"))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_words_and_overlap(spark):
    assert one(spark, text.word_list(F.lit("Hello, World! 123 hello"))) == ["hello", "world", "123"]
    assert one(spark, text.word_list(F.lit("Ciónue ß_x"))) == ["ciónue", "ß_x"]
    assert one(spark, text.jaccard(["hello", "world"], F.lit("hello world"))) == 1.0
    assert one(spark, text.jaccard(["foo"], F.lit("bar"))) == 0.0
    assert one(spark, text.jaccard([], F.lit("deep learning"))) == 0.5
    assert one(spark, text.jaccard(["foo"], F.lit(""))) == 0.5
    assert one(spark, text.jaccard(["foo"], F.lit(None).cast("string"))) == 0.5
    plain = one(spark, text.jaccard(["deep", "learning"], F.lit("on deep learning now")))
    assert one(spark, text.jaccard(["deep learning"], F.lit("on deep learning now"))) == pytest.approx(plain + 0.3)


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, scores.cosine(v(1.0, 0.0), v(2.0, 0.0))) == 1.0
    assert one(spark, scores.cosine(v(0.0, 0.0), v(2.0, 0.0))) == 0.0
    assert one(spark, scores.cosine(v(1.0), v(2.0, 0.0))) == 0.0
    assert one(spark, scores.normalize(v(3.0, 4.0))) == [0.6, 0.8]
    assert one(spark, scores.normalize(v(0.0, 0.0))) == [0.0, 0.0]


def test_weights(spark):
    assert one(spark, scores.weighted({"a": (3.0, F.lit(1.0)), "b": (1.0, F.lit(0.0))})) == 0.75
    assert one(spark, scores.weighted({})) == 0.0
    assert one(spark, scores.blend(F.lit(0.9), F.lit(0.5), 0.7)) == 0.78
    assert one(spark, scores.depth_penalty(F.lit(3))) == 0.5
    assert one(spark, scores.position_signal(F.lit(1), F.lit(4))) == 0.75
    assert one(spark, scores.position_signal(F.lit(1), F.lit(None).cast("int"))) == 0.5
    assert one(spark, scores.clamp01(F.lit(1.7))) == 1.0


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2026-08-01T10:30:00Z", "2026-08-01 10:30:00"), ("2026-07-15T08:00:00+00:00", "2026-07-15 08:00:00"), ("2026-07-15T08:00:00+0200", "2026-07-15 06:00:00"), ("2026-06-02", "2026-06-02 00:00:00"),
        ("2026-05-04 12:00:00", "2026-05-04 12:00:00"), ("4 May 2026", "2026-05-04 00:00:00"), ("May 4, 2026", "2026-05-04 00:00:00"), ("0001-01-01", None), ("2099-01-01", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_dates(spark, raw, want):
    got = one(spark, F.date_format(dates.parse_date(F.lit(raw).cast("string"), now()), "yyyy-MM-dd HH:mm:ss"))
    assert got == want


def test_since():
    now = datetime.datetime(2026, 3, 1, tzinfo=datetime.UTC)
    assert dates.since_cutoff("2 weeks", now) == now - datetime.timedelta(days=14)
    assert dates.since_cutoff("1 year", now) == now - datetime.timedelta(days=365)
    assert dates.since_cutoff("2026-01-02", now) == datetime.datetime(2026, 1, 2, tzinfo=datetime.UTC)
    with pytest.raises(ValueError):
        dates.since_cutoff("lately", now)
    assert dates.recent_since("2027-01-01", now) is None and dates.recent_since(None, now) is None
    assert dates.recent_since("2025-01-01T00:00:00Z", now).year == 2025


def test_json_repair(spark):
    block = lambda s: one(spark, json_text.json_block(F.lit(s)))
    assert block('Sure: {"a": [1, 2,],} bye') == '{"a": [1, 2]}'
    assert block('{"a": {"b": 1}}') == '{"a": {"b": 1}}'
    assert block("no json") is None and block("{broken") is None and block("{a b}") is None


def test_parse_analysis(spark):
    data = '{"classification": "relevant", "relevance_score": 1.4, "hub_score": true, "summary": " s ", "tags": ["a", " a ", 3, "", "b"], "topics": "no", "endorsed_links": ["1","2","3","4","5","6"]}'
    a = one(spark, json_text.parse_analysis(F.lit(data)))
    assert (a.classification, a.relevance_score, a.hub_score, a.summary, a.tags, a.topics) == ("RELEVANT", 1.0, 0.0, "s", ["a", "b"], [])
    assert a.endorsed_links == ["1", "2", "3", "4", "5"]
    assert one(spark, json_text.parse_analysis(F.lit('{"classification": 7}'))).classification == "UNKNOWN"


def test_texts(spark):
    n = F.lit(None).cast("string")
    assert one(spark, text.shorten(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, text.first_text(F.lit("  "), n, F.lit(" x "))) == "x"
    assert one(spark, text.embedding_text(n, F.lit("a"), F.lit(" "), F.lit("h"), n, F.lit("u"))) == "a h"
    assert one(spark, text.embedding_text(n, n, n, n, n, F.lit("u"))) == "u"
    assert one(spark, text.source_line(F.lit("T"), F.lit("HUB"), F.lit(0.5), F.lit("sum"))) == "T [HUB 0.50] sum"
    assert one(spark, text.rationale(F.lit(0.5), {"a": F.lit(0.25)})) == "rule_score=0.5000 a=0.2500"
