"""Near-duplicate groups, exact dedup and repeat removal against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailbase.llm import near_dup, radix_dedup, repeats, suffix_dedup, suffix_tree_dedup
from trailbase.llm.components import connected_components
from trailbase.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    words = WORD.findall("".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(rows, k):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dup_equals_brute_force(spark, docs, rows, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(spark, docs, k, 80).collect()}
    assert got == brute_components(rows, k)


def test_near_dup_large_group_of_chained_copies(spark):
    """Copies that drift: neighbours are alike, the ends are not; all are one group, and a row outside stays out."""
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 90])) for i in range(150)] + [(900, " ".join(f"z{i}" for i in range(90)))]
    got = {r.doc_id: r.component_id for r in near_dup.components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 2).items()}


def shared_passage(n, own, seed=0):
    """Texts that share 95 words and have 30 of their own, dealt from ``own`` words; every tenth is a near copy of the one before."""
    draw = random.Random(seed)
    head = [f"s{i}" for i in range(95)]
    rows = []
    for i in range(n):
        words = [*head, *(f"o{draw.randrange(own)}" for _ in range(30))] if i % 10 else [*rows[-1][1].split()[:-1], "x"] if rows else head
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("own", [40, 100_000])
def test_near_dup_splits_hot_keys(spark, monkeypatch, own):
    """Keys of more than TILE rows are split by leading shingles and, if those are common too, into tiles."""
    monkeypatch.setattr(near_dup, "TILE", 12)
    monkeypatch.setattr(near_dup, "SPLIT", 8)
    rows = shared_passage(120, own)
    got = {r.doc_id: r.component_id for r in near_dup.components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 2).items()}


def test_rows_that_share_a_passage_alone_meet_no_more(spark):
    """What is left of a hot key's rows does not grow with the square of their number."""
    for n in (200, 800):
        docs = spark.createDataFrame(shared_passage(n, 1 << 40), "doc_id long, text string")
        search = near_dup._Search(Workspace(spark, "test"), docs.select(docs.doc_id.alias("row_"), "text"), 2, 80, False)
        rows = docs.selectExpr("doc_id as id", "doc_id as component")
        assert search.leading(rows, f"n{n}").count() <= 6 * n  # 25 for each row of a near pair, a fifth of all


def test_near_dup_recall_at_the_limit(spark):
    """Pairs of similarity 0.80 to 0.85, each alone: none may be lost."""
    draw = random.Random(8)
    rows = []
    for i in range(1500):
        words = [f"w{draw.randrange(10**9)}" for _ in range(100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, *(f"t{i}_{j}" for j in range(18 + i % 7))]))]
    want = {i: c for i, t in rows for c in [i - i % 2]}
    alike = lambda i: len(shingle_set(rows[i][1], 2)) / len(shingle_set(rows[i + 1][1], 2))
    assert all(0.8 <= alike(i) <= 0.85 for i in range(0, 3000, 2))
    got = {r.doc_id: r.component_id for r in near_dup.components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.999 * len(want)


def thue_morse(n):
    """A word of n letters and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_long_words_of_like_hashes_differ(spark, n):
    one, other = thue_morse(n)
    rows = [(1, f"x {one} y"), (2, f"x {other} y"), (3, f"x {one} y z"), (4, " ".join([one, other] * 30)), (5, " ".join([other, one] * 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(spark, docs, 2, 80).collect()}
    assert got == brute_components(rows, 2)
    bytes_ = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(spark, docs).collect()}
    assert bytes_ == brute_bytes(rows, 50)
    words = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_tree_dedup.remove(spark, docs).collect()}
    assert words == brute_words(rows, 20)


def test_near_dup_odd_rows_and_empty(spark, odd_docs, no_docs):
    out = near_dup.components(spark, odd_docs, 2, 80).collect()
    assert len(out) == odd_docs.count()
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert {r.component_id for r in out if r.doc_id == 11} == {10}
    assert near_dup.components(spark, no_docs, 5, 80).count() == 0
    kept = near_dup.keep_one(spark, odd_docs, 2)
    assert kept.filter("doc_id = 11").count() == 0 and kept.filter("doc_id is null").count() == 2


def test_keep_one_keeps_columns(spark, docs):
    out = near_dup.keep_one(spark, docs)
    assert out.columns == docs.columns
    assert out.filter("doc_id = 11").count() == 0


def test_sketch_limit_holds_for_similar_sets():
    draw = np.random.default_rng(1)
    most = near_dup.most_differing(0.8)
    for n in (20, 300, 3000):
        for _ in range(30):
            both = draw.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(both[: n + n // 9]), np.unique(np.r_[both[:n], both[n + n // 9 : n + 2 * (n // 9)]])
            s = near_dup.odd_sketch(near_dup.minhash([a, b])).view(np.uint64)
            assert np.bitwise_count(s[0] ^ s[1]).sum() <= most


def test_components_of_paths_and_stars(spark):
    work = Workspace(spark, "test")
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r.id: r.component for r in connected_components(work, spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(work, spark.createDataFrame([], "a long, b long"), "none").count() == 0


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {(i, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_radix_equals_brute_force(spark, docs, rows):
    out = radix_dedup.exact_groups(spark, docs).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out} == brute_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)


def test_radix_splits_long_common_prefixes(spark):
    head = "p" * 5000
    rows = [(i, head + ("a" if i % 2 else "b") + "q" * (i % 3)) for i in range(24)] + [(50, head), (51, head[:64]), (52, head[:64])]
    out = radix_dedup.exact_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out} == brute_exact(rows)


def test_radix_odd_rows_and_empty(spark, odd_docs, no_docs):
    out = radix_dedup.exact_groups(spark, odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r.kept and r.keep_id is None and r.group_size == 1 for r in out if r.doc_id is None)
    assert {(r.keep_id, r.group_size) for r in out if r.doc_id == 11} == {(11, 3)}
    assert radix_dedup.exact_groups(spark, no_docs).count() == 0
    assert radix_dedup.keep_one(spark, odd_docs).filter("doc_id is null").count() == 2


def brute_bytes(rows, length):
    first, out = {}, {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            if first.setdefault(data[at : at + length], i) < i:
                gone[at : at + length] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(data) else 0, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        gone = np.zeros(len(words), bool)
        for at in range(len(words) - length + 1):
            window = tuple(words[at : at + length])
            if window in seen:
                gone[at : at + length] = True
            seen.add(window)
        out[i] = (len(words), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark, docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(spark, docs).collect()}
    assert got == brute_bytes(rows, 50)
    assert got[11][1] == got[11][0] > 0 and got[10][1] == 0


def test_suffix_tree_dedup_equals_brute_force(spark, docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_tree_dedup.remove(spark, docs).collect()}
    assert got == brute_words(rows, 20)
    assert got[21][1] > 250  # a text that repeats itself


@pytest.mark.parametrize("single", [1, 10**6])
def test_hot_leads_go_window_by_window(spark, docs, rows, monkeypatch, single):
    """Every lead and prefix is too common for one task: suffixes are dealt out by all of their symbols."""
    monkeypatch.setattr(repeats, "MOST_SINGLE", single)
    monkeypatch.setattr(suffix_dedup.Ranges, "segments", lambda self, symbols, anchor: np.full(len(anchor), -1))
    monkeypatch.setattr(suffix_tree_dedup.Prefixes, "segments", lambda self, symbols, anchor: np.full(len(anchor), -1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(spark, docs).collect()}
    assert got == brute_bytes(rows, 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_tree_dedup.remove(spark, docs).collect()}
    assert got == brute_words(rows, 20)


def test_equal_windows_go_to_one_bucket_and_common_ones_are_split():
    draw = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join([*(f"w{draw.randrange(10**6)}" for _ in range(30)), passage, *(f"w{draw.randrange(10**6)}" for _ in range(30))]) for _ in range(300)]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for words, length, gram, kind in ((False, 50, 16, "ranges"), (True, 20, 6, "prefixes")):
        windows = repeats.Windows(length, gram, words, False)
        symbols = windows.symbols(data, at)
        doc, place, count, off, _, _ = windows.segments(symbols)
        begin, off, count = symbols.first[doc] + place, off.astype(np.int64), count.astype(np.int64)
        if kind == "ranges":
            sample = sorted(k.ljust(58, b"\0") for k in suffix_dedup.keys(symbols.raw, begin, off, length).tolist())
            router = suffix_dedup.Ranges(sample, 16, length)
        else:
            sample = sorted(r.tobytes() for r in suffix_tree_dedup.prefix_hashes(symbols.values, begin, off, length, suffix_tree_dedup.depths(length, gram)).T)
            router = suffix_tree_dedup.Prefixes(sample, 400, length, gram)
        whole = router.segments(symbols, begin + off)
        assert (whole < 0).any() and (whole >= 0).any()
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first, off = np.repeat(begin, count) + step, np.repeat(off, count) - step
        dest = np.where(np.repeat(whole, count) >= 0, np.repeat(whole, count), router.windows(symbols, first, off))
        where = {}
        for f, d in zip(first.tolist(), dest.tolist(), strict=True):
            where.setdefault(symbols.raw[symbols.edge[f] : symbols.edge[f + length]].tobytes(), set()).add(d)
        assert all(len(d) == 1 for d in where.values())
        if kind == "ranges":
            assert np.bincount(dest, minlength=16).max() < 0.5 * len(dest)


def test_common_anchors_send_one_mark(spark, monkeypatch):
    """Of an anchor that several documents of a task share, one mark meets the others' and not its segments."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{' '.join(f'a{i}_{j}' for j in range(25))} {passage} {' '.join(f'b{i}_{j}' for j in range(25))}" for i in range(200)]
    part = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], names=["key", "text"])
    for windows, key in ((repeats.Windows(50, 16, False, False), 58), (repeats.Windows(20, 6, True, True), 8)):
        run = repeats._anchors(windows, 4, lambda symbols, begin, off, key=key: [b"x" * key] * len(begin))
        out = pa.Table.from_batches(list(run(iter([part])))).to_pydict()
        marks = sum(len(repeats.restore([b])[0]) for k, b in zip(out["kind"], out["blob"], strict=True) if k == repeats.KNOWN)
        opened = sum(len(repeats.restore([b])[0]) for k, b in zip(out["kind"], out["blob"], strict=True) if k == repeats.OPEN)
        assert 0 < marks < 60 and opened >= 200


@given(st.lists(st.lists(st.integers(0, 2), min_size=4, max_size=4), max_size=30))
@settings(deadline=None)
def test_tree_nodes(suffixes):
    symbols = np.array([x for s in suffixes for x in s], np.int64)
    tree = suffix_tree_dedup.SuffixTree(symbols, np.arange(len(suffixes)) * 4, 4)
    rows = [tuple(s) for s in suffixes]
    deep = {}
    for leaf, node in zip(tree.leaves.tolist(), tree.node.tolist(), strict=True):
        deep.setdefault(node, []).append(leaf)
    want = {r: [i for i, x in enumerate(rows) if x == r] for r in set(rows)}
    assert sorted(map(sorted, deep.values())) == sorted(v for v in want.values() if len(v) > 1)
    # Internal nodes are the prefixes after which the suffixes go on differently.
    branching = [p for d in range(4) for p in {r[:d] for r in rows} if len({r[d] for r in rows if r[:d] == p}) > 1]
    assert sorted(tree.node_depth.tolist()) == sorted(map(len, branching))
    assert all(a < b for a, b in zip(tree.node_depth[tree.parent[tree.parent >= 0]].tolist(), tree.node_depth[tree.parent >= 0].tolist(), strict=True))


@pytest.mark.parametrize("leads", ["ranges", "hot"])
def test_open_bytes_are_fetched_in_passes(spark, docs, rows, monkeypatch, leads):
    """Where open segments are many times the texts, a pass takes the buckets of its turn: together they give what one pass gives."""
    turns = []
    fetch = repeats._fetch
    monkeypatch.setattr(repeats, "PASS_SHARE", 0.001)
    monkeypatch.setattr(repeats, "_fetch", lambda *args: turns.append(args[3:]) or fetch(*args))
    if leads == "hot":
        monkeypatch.setattr(suffix_dedup.Ranges, "segments", lambda self, symbols, anchor: np.full(len(anchor), -1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(spark, docs).collect()}
    assert got == brute_bytes(rows, 50)
    assert len(turns) > 1 and turns == [(i, len(turns)) for i in range(len(turns))]


def test_a_pass_holds_its_share():
    """Copies in every task: the bytes of all open segments are several times the texts, those of a pass are not."""
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(200)) for _ in range(40)] * 2
    windows, buckets = repeats.Windows(50, 16, False, False), 24
    part = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array(texts)], names=["key", "text"])
    out = pa.Table.from_batches(list(repeats._anchors(windows, 1, lambda *_: [])(iter([part.slice(0, 40)]))) + list(repeats._anchors(windows, 1, lambda *_: [])(iter([part.slice(40)]))))
    met = pa.Table.from_batches(list(repeats._meet(windows, 1)(iter(out.to_batches()))))
    opened = sum(k for k, kind in zip(met["key"].to_pylist(), met["kind"].to_pylist(), strict=True) if kind == repeats.OPENED)
    size = sum(map(len, texts))
    assert opened > 3 * size
    text = pa.table({"dest": pa.array([0] * 80, pa.int32()), "kind": pa.array([repeats.TEXT] * 80, pa.int32()), "key": pa.array(range(80), pa.int64()), "text": texts, "blob": pa.nulls(80, pa.binary())})
    batches = [b.combine_chunks().to_batches()[0] for b in (met.filter(pa.compute.equal(met["kind"], repeats.OPEN)), text)]
    router = suffix_dedup.Ranges([], buckets, 50)

    def fetched(*turn):
        rows = pa.Table.from_batches(list(repeats._fetch(windows, 1, router, *turn)(iter(batches)))).to_pylist()
        return [(r["dest"], [c.tolist() for c in repeats.unsqueeze(r["blob"])]) for r in rows if r["kind"] == repeats.OPEN]

    whole, passes = fetched(), math.ceil(opened / (repeats.PASS_SHARE * size))
    parts = [fetched(i, passes) for i in range(passes)]
    assert sorted(whole) == sorted(sum(parts, []))
    total = sum(len(c[4]) for _, c in whole)
    assert total > 2 * size and max(sum(len(c[4]) for _, c in p) for p in parts) < repeats.PASS_SHARE * size


def test_repeats_odd_rows_and_empty(spark, odd_docs, no_docs):
    for remove in (suffix_dedup.remove, suffix_tree_dedup.remove):
        out = remove(spark, odd_docs).collect()
        assert len(out) == odd_docs.count()
        assert sorted(r.n_removed for r in out if r.doc_id is None)[0] == 0
        assert remove(spark, no_docs).count() == 0


@given(st.lists(st.text(alphabet="ab \n", max_size=80), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_segments_cover_each_window_once(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    windows = repeats.Windows(12, 5, words=False, same_document=False)
    doc, place, count, off, _, _ = windows.segments(windows.symbols(data, at))
    seen = [(int(d), int(p) + k) for d, p, c in zip(doc, place, count, strict=True) for k in range(int(c))]
    assert sorted(seen) == [(d, p) for d, t in enumerate(texts) for p in range(len(t) - 11)]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=40))
def test_multikey_finds_equal_rows(rows):
    table = np.array(rows, np.int64).reshape(-1, 2)
    left, group = suffix_dedup.multikey((lambda own, c=c: table[own, c] for c in range(2)), len(table))
    by = {}
    for i, g in zip(left.tolist(), group.tolist(), strict=True):
        by.setdefault(g, set()).add(i)
    expected = {}
    for i, r in enumerate(map(tuple, table.tolist())):
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, by.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def test_squeeze_round_trip():
    columns = [np.arange(5), np.array([1, 2], np.uint8), np.zeros(0, np.uint64), np.array([7.5])]
    back = repeats.unsqueeze(repeats.squeeze(*columns))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, back, strict=True))
