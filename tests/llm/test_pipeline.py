import itertools
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from trailbase.llm import queries, ranker

from .test_pairs import brute_components
from .test_texts import brute_secrets

TABLES = "documents labels embeddings conversations".split()
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        after = docs.count()
        assert after <= before
        before = after
    assert before < 200
    assert docs.filter("text rlike '(?i)(password|token) *= *.?[A-Za-z0-9]{8}'").count() == 0


def test_run_packs_what_the_stages_kept(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near-duplicate dedup", "secret scan", "best-fit packing"]


def test_run_equals_brute_force(spark):
    """Every decision again in plain Python, on the scores of the classifier (which has tests of its own)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in ranker.score_documents(spark, docs, queries.table(spark, SF, "labels")).filter("predicted = 1").collect()}
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect() if r.doc_id in good}
    last = {text: i for i, text in sorted(rows.items())}
    left = sorted((i, text) for text, i in last.items())
    component = brute_components(left, 5)
    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    want = set()
    for i, text in left:
        if component[i][1] != i:
            continue
        out, seen = [], 0
        for a, b, _ in brute_secrets(text):
            if a >= seen:
                out += [text[seen:a], "[SECRET]"]
            seen = max(seen, b)
        ids = [*library.encode("".join([*out, text[seen:]]), add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want |= {(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(itertools.pairwise(cuts))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 2048 and len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1


def test_stages_on_odd_tables(spark, docs, odd_docs, no_docs):
    """Nulls, repeated rows, clashing columns and an empty table pass every stage; columns stay and no row is made."""
    for table in (docs, odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns, name
            assert out.count() <= table.count(), name
        assert corpus_pipeline.pack(spark, table, SF).select("doc_id").distinct().count() == table.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
