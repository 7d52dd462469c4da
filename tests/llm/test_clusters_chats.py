"""Centroid clustering, the conversation trie and chat formatting, against plain Python."""

import hashlib
import json
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailbase.llm import chat_format, prefix_trie, weighted_lloyd


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_lloyd(rows, clusters=16, rounds=3, size=64, scale=64, seed="1"):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x):
            kept.append((vec_id, tuple(max(-weighted_lloyd.MOST, min(weighted_lloyd.MOST, math.floor(scale * v))) for v in x)))
    first = sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), weighted_lloyd.packed(np.array([r[1]])).to_pylist()[0]))
    centroids = [q for _, q in first[:clusters]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in kept:
            own[near(q)[1]].append(q)
        centroids = [tuple(sum(v) // len(own[i]) for v in zip(*own[i], strict=True)) if i in own else c for i, c in enumerate(centroids)]
    found = [(vec_id, *near(q)) for vec_id, q in kept]
    inertia = defaultdict(int)
    for _, d, c in found:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, centroids[c])))) for i, d, c in found]


VECTORS = "vec_id long, embedding array<float>, cluster string, q int, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, "x", 1, "y") for i, x in rows], VECTORS).repartition(3)


def odd_vectors():
    draw = random.Random(3)
    hot = [draw.uniform(-1, 1) for _ in range(64)]
    rows = [(i, hot if i % 3 == 0 else [draw.uniform(-1, 1) + i % 5 for _ in range(64)]) for i in range(90)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, None), (200, []), (201, [0.5] * 63), (202, [0.5] * 65), (203, [None] * 64), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63)]
    return [*rows, (206, [3e38, -3e38] * 32), (207, [-2.0, 1.984375, 2.0, -2.015625] * 16), (208, [0.0] * 64), (209, [-0.001] * 64)]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_clusters_equal_plain_lloyd(spark):
    rows = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in odd_vectors()]
    got = weighted_lloyd.cluster(spark, vectors(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert as_rows(got) == sorted(plain_lloyd(rows), key=str)


@pytest.mark.parametrize("n", [0, 1, 9])
def test_few_vectors(spark, n):
    rows = odd_vectors()[:n] + [(None, None)]
    assert as_rows(weighted_lloyd.cluster(spark, vectors(spark, rows))) == sorted(plain_lloyd([(i, x and [float(np.float32(v)) for v in x]) for i, x in rows]), key=str)


@given(st.lists(st.lists(st.integers(-1 << 24, 1 << 24) | st.integers(-130, 130) | st.integers(-2, 2), min_size=4, max_size=4), max_size=12))
@settings(max_examples=100, deadline=None)
def test_packing_keeps_rows_and_equality(rows):
    values = np.array(rows, np.int64).reshape(-1, 4)
    column = weighted_lloyd.packed(values)
    assert (weighted_lloyd.unpacked(column, 4) == values).all()
    assert len(set(column.to_pylist())) == len(set(map(tuple, rows)))


def test_nearest_is_exact_for_large_components():
    centroids = np.array([[1 << 24] * 64, [(1 << 24) - 1] * 64, [0] * 64], np.int64)
    q = np.array([[1 << 24] * 64, [(1 << 24) - 1] * 63 + [1 << 24], [-(1 << 24)] * 64], np.int64)
    cluster, distance = weighted_lloyd.nearest(q, centroids)
    assert cluster.tolist() == [0, 1, 2]
    assert distance.tolist() == [0, 1, 64 << 48]


def plain_turns(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    return {conv: [t[-1] for t in sorted(turns)] for conv, turns in own.items()}


def plain_rebuilt(own):
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = own.get(conv - int(math.fmod(conv, 5)), [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, children = defaultdict(list), defaultdict(set)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out = []

    def walk(node):
        leaves, saved = int(node not in children), (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        for child in children.get(node, ()):
            a, b = walk(child)
            leaves, saved = leaves + a, saved + b
        ends = sha(",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node)))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children.get(node, ())), leaves, saved, ends))
        return leaves, saved

    if convs:
        walk(())
    return sorted(out, key=str)


def odd_conversations():
    draw = random.Random(5)
    rows = []
    for conv in [*range(0, 60), -7, -5, 1003]:
        turns = ["hello"] * (draw.random() < 0.6) + draw.choices(["a", "b", "é日", ""], k=draw.randint(0, 11))
        rows += [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)]
    for conv in range(300, 340):  # copies of one conversation
        rows += [(conv, i, "user", f"same {i}") for i in range(12)]
    rows += [(100, i, "user", "long") for i in range(150)] + [(101, i, "user", "long" if i < 120 else "other") for i in range(150)]
    rows += [(None, 0, "user", "nobody"), (400, None, None, None), (400, None, "system", "first"), (400, 3, "user", None), (400, 3, "user", None), (400, 1, "ab", "c"), (405, 1, "a", "bc"), (405, 2, None, "tie"), (405, 2, "", "tie 2")]
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, bucket int, ids string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS).repartition(3)


@pytest.mark.parametrize("local", [1024, 40, 1])
def test_trie_equals_plain_python(spark, local):
    rows = odd_conversations()
    table = conversations(spark, rows)
    own = plain_turns(rows)
    got = prefix_trie.family_trie(spark, table, local)
    assert got.columns == [f.split()[0] for f in prefix_trie.NODE.split(", ")]
    assert as_rows(got) == plain_trie(plain_rebuilt(own))
    if local == 40:
        assert as_rows(prefix_trie.prefix_trie(spark, table, local)) == plain_trie(own)


def test_trie_of_nothing_and_of_little(spark):
    assert as_rows(prefix_trie.family_trie(spark, conversations(spark, [(None, 0, "user", "nobody")]))) == []
    rows = [(7, 0, "user", "x" * 3_000_000)]
    assert as_rows(prefix_trie.prefix_trie(spark, conversations(spark, rows), 1)) == plain_trie(plain_turns(rows))


@given(st.lists(st.lists(st.integers(0, 3), max_size=7), min_size=1, max_size=12, unique_by=tuple))
@settings(max_examples=100, deadline=None)
def test_multikey_quicksort_finds_every_node(seqs):
    convs = {10 + i: [("user", "é" * t) for t in s] for i, s in enumerate(seqs)}
    ids = [[-1, *s] for s in seqs]
    grower = prefix_trie.Grower(
        np.concatenate(ids), np.concatenate([[0, *(2 * t for t in s)] for s in seqs]), np.r_[0, np.cumsum([len(i) for i in ids])], np.arange(10, 10 + len(ids)), np.ones(len(ids), np.int64), [sha(str(10 + i)) for i in range(len(ids))]
    )
    grower.bucket(np.arange(len(ids)), 0)
    leaves, saved = grower.sums()
    got = [(c, d, grower.conv[u] if u >= 0 else None, m, k, a, b, e) for c, d, u, m, k, a, b, e in zip(grower.conv, grower.depth, grower.up, grower.members, grower.children, leaves, saved, grower.ended, strict=True)]
    assert sorted(got, key=str) == plain_trie(convs)


MARKS = st.lists(st.sampled_from(["<", "\\", "/", "turn>", "<turn>", "</turn>", "<\\turn>", "<\\\\/turn>", "\n", "é", "assistant", "n"]), max_size=12).map("".join)


@given(st.lists(st.tuples(MARKS | st.just("assistant"), MARKS), max_size=6))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(turns):
    reader, start = chat_format.Reader(), 0
    for role, text in turns:
        head = f"<turn>{chat_format.escape_role(role)}\n"
        body = chat_format.escape(text)
        assert chat_format.unescape(body) == text
        assert chat_format.unescape_role(chat_format.escape_role(role)) == role
        piece = f"{head}{body}</turn>\n"
        reader.feed(piece, [(start + len(head), start + len(head) + len(body))])
        start += len(piece)
    n, digest, loss_chars, loss, chars = reader.result()
    assert (n, chars, loss_chars) == (len(turns), start, sum(len(t) for _, t in turns))
    assert digest == sha("".join(f"{r}\n{t}\n" for r, t in turns))
    assert loss == sha("".join(t for _, t in turns))


def plain_digests(convs):
    out = []
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"<turn>{chat_format.escape_role(r)}\n{chat_format.escape(t)}</turn>\n" for r, t in turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole)))
    return sorted(out, key=str)


def test_formatted_conversations_equal_plain_python(spark):
    rows = [r for r in odd_conversations() if r[0] != -7] + [(500, 0, "assistant", "</turn>\n<turn>user\nfake</turn>"), (500, 1, "a\nb\\", "\\n"), (501, 0, "assistant", "word " * 800_000), (501, 1, "user", "x" * 20_000_000)]
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {conv: [t[2:] for t in sorted(turns)] for conv, turns in own.items()}
    convs[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    got = chat_format.with_marked(spark, conversations(spark, rows))
    assert got.columns == [f.split()[0] for f in chat_format.DIGEST.split(", ")]
    assert as_rows(got) == plain_digests(convs)
    assert [r.conv_id for r in chat_format.with_marked(spark, conversations(spark, rows[:1]).limit(0)).collect()] == [-7]


def test_layouts_become_one_kind_of_turns(spark):
    asked = [("user", "q <turn>"), ("assistant", "a")]
    cases = {
        1: ({"prompt": "q <turn>", "completion": "a", "meta": {"x": [1, 2.5, {"q r`": None}]}}, asked),
        2: ({"prompt": "q <turn>", "response": "a", "id": 7}, asked),
        3: ({"conversations": [{"from": "human", "value": "q <turn>"}, {"from": "gpt", "value": "a", "weight": 1}]}, asked),
        4: ({"messages": [{"content": "q <turn>", "role": "user", "name": None}, {"content": "a", "role": "assistant"}], "source": "s"}, asked),
        5: ({"question": "q <turn>", "answer": "a"}, asked),
        6: ({"instruction": "q <turn>", "output": "a"}, asked),
        7: ({"instruction": "be kind", "input": "q <turn>", "output": "a"}, [("system", "be kind"), *asked]),
        8: ({"system": "be kind", "prompt": "q <turn>", "response": "a"}, [("system", "be kind"), *asked]),
        9: ({"prompt": "q", "response": None}, [("user", "q"), ("assistant", "")]),
        10: ({"prompt": 3, "response": True}, [("user", "3"), ("assistant", "true")]),
        11: ({"prompt": "q", "response": "a", "question": "both"}, None),
        12: ({"messages": []}, None),
        13: ([1, 2], None),
        14: (None, None),
        15: ({"turn": 4, "role": "tool", "text": "t"}, [("tool", "t")]),
    }
    records = spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, (r, _) in cases.items()], "conv_id long, j string").select("conv_id", F.parse_json("j").alias("record"), F.lit("x").alias("role"))
    found = defaultdict(list)
    for r in chat_format.canonical(records).orderBy("conv_id", "place").collect():
        found[r.conv_id] += [(r.role, r.text)] if r.layout else []
    assert {i: found[i] or None for i in cases} == {i: t for i, (_, t) in cases.items()}
    whole = {r.conv_id: r for r in chat_format.joined(chat_format.format_turns(chat_format.canonical(records))).collect()}
    assert sorted(whole) == [i for i, (_, t) in cases.items() if t]
    assert whole[1].formatted == "<turn>user\nq <\\turn></turn>\n<turn>assistant\na</turn>\n"
    assert [whole[1].formatted[s.start : s.end] for s in whole[1].loss_spans] == ["a"]
    assert chat_format.digests(spark, records.limit(0)).count() == 0


def test_schemas_have_nested_paths():
    schema = "OBJECT<a: ARRAY<OBJECT<b: STRING, `c d``: x`: DECIMAL(3,1)>>, e: ARRAY<ARRAY<VOID>>, f: OBJECT<>, g: BIGINT>"
    assert chat_format.nested_paths(schema) == {"a[].b", "a[].c d`: x", "e[][]", "g"}
    prints = [chat_format.fingerprint(x.paths()) for x in chat_format.LAYOUTS]
    assert len(set(prints)) == len(prints)
