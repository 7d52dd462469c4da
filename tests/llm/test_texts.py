"""Tokenizers, packing, secrets, rules, ranker and rollup."""

import base64
import hashlib
import itertools
import math
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from trailbase.llm import flat, packing, piece_codec, ranker, rules, secrets, shape, token_rollup
from trailbase.llm.queries import tokenizer
from trailbase.llm.workspace import SETTING, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABET = st.sampled_from(["a", "b", "th", "the", " ", "  ", "\n", "é", "日", "\x00", "▁", "1", "!!", "ing", "<s>", "</s>", "<0x0A>", "\t", "😀", "aaaa", "\xa0", "'s", "<|endoftext|>"])
TEXT = st.lists(ALPHABET, max_size=25).map("".join)


@pytest.fixture(scope="session")
def pieces():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    return piece_codec.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_codec_equals_the_library(pieces, text):
    own, library = pieces
    ids = library.encode(text)
    assert own.encode(text) == [*ids, 2]
    assert own.decode([*ids, 2]) == library.decode([*ids, 2])
    _, shown, decoded = own.digests([text])
    assert shown[0] == hashlib.sha256(" ".join(map(str, [*ids, 2])).encode()).hexdigest()
    assert decoded[0] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_codec_long_runs_and_loose_bytes(pieces):
    own, library = pieces
    for text in ("a" * 3000, " " * 500, "ab" * 2000, "the" * 900):
        assert own.encode(text)[:-1] == library.encode(text)
    lists = ([28705, 242, 191], [242, 28705, 2], [2], [], [1318], [2, 1318, 3, 1318], [28705, 28705, 1318])
    for ids in lists:
        assert own.decode(ids) == library.decode(ids)
    together = own.model.decode_flat(np.array([i for ids in lists for i in ids], np.int64), np.cumsum(list(map(len, lists))))
    assert [t.decode() for t in together] == [library.decode(ids) for ids in lists]


@given(st.sampled_from(["ab", "acgt", "thein", "=-_", "中文的一是了", "abcdefghijklmnopqrstuvwxyz", "aZ09+/éx日"]), st.integers(65, 900), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_long_words_equal_the_library(pieces, alphabet, n, seed):
    own, library = pieces
    draw = np.random.default_rng(seed)
    text = "".join(draw.choice(list(alphabet), n)) + " the end " + "".join(draw.choice(list(alphabet), n // 2))
    ids = library.encode(text)
    assert own.encode(text)[:-1] == ids
    model = own.model
    known = [model.chars[c] for c in piece_codec.SPACE + alphabet if c in model.chars]
    symbols = draw.choice(known, n)
    by_rounds, _ = model._merge_long(symbols.copy(), np.zeros(n, np.int64))
    assert by_rounds.tolist() == model._merge_one(symbols.tolist())


@pytest.mark.parametrize("alphabet", ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "中文的一是不了人我在有他這日本語", "abcdefghijklmnopqrstuvwxyz", "a"])
def test_two_million_characters_without_spaces(pieces, alphabet):
    own, library = pieces
    text = "".join(np.random.default_rng(7).choice(list(alphabet), 2_000_000))
    begun = time.process_time()
    assert own.digests([text])[1] == [hashlib.sha256(" ".join(map(str, [*library.encode(text), 2])).encode()).hexdigest()]
    assert time.process_time() - begun < 60


def test_merges_that_open_better_pairs_wait():
    """A merge that opens a pair of higher rank is done alone, as a queue would."""

    def field(number, body):
        return bytes([number << 3 | 2, len(body)]) + body

    import struct

    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + bytes([0x15]) + struct.pack("<f", score) + bytes([0x18, kind]))

    model = piece_codec.PieceModel(
        b"".join([piece("<unk>", 0, 2), piece("</s>", 0, 3), *(piece(f"<0x{b:02X}>", 0, 6) for b in range(256)), piece("ab", -5), piece("aba", -1), piece("a", -9), piece("b", -9)])
        + field(2, bytes([0x18, 2])) + field(3, bytes([0x18, 1, 0x20, 0, 0x28, 1]))
    )
    flat_ids, _ = model.encode_flat(["ababab"])
    assert [model.pieces[i] for i in flat_ids] == ["aba", "b", "ab"]
    # Long words go by reach, and by single pairs where a merge ranks before those that made its parts.
    for seed in range(200):
        word = "".join(np.random.default_rng(seed).choice(["a", "b", "é"], 80, p=[0.49, 0.49, 0.02]))
        by_reach = [model.pieces[i] for i in model.encode_flat([word, "ab", word[::-1]])[0]]
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(piece_codec, "LONG", 1000)
            assert by_reach == [model.pieces[i] for i in model.encode_flat([word, "ab", word[::-1]])[0]]


def test_codec_on_tables(spark, docs, rows, no_docs, odd_docs, pieces):
    path = tokenizer("piece_bpe_32k.model")
    got = {r.doc_id: r for r in piece_codec.digest_documents(docs, path).collect()}
    for i, t in rows:
        ids = [*pieces[1].encode(t or ""), 2]
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = {r.doc_id: r.text for r in piece_codec.decode_ids(piece_codec.encode_documents(docs, path), path).collect()}
    assert back == {i: pieces[1].decode(pieces[1].encode(t or "")) for i, t in rows}
    assert piece_codec.digest_documents(no_docs, path).count() == 0
    assert piece_codec.digest_documents(odd_docs, path).count() == odd_docs.count()


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
@settings(max_examples=150, deadline=None)
def test_plan_holds_every_piece_once(counts):
    used, bins = {}, 0
    for items, times in packing.plan(counts, 64):
        assert sum(items) <= 64 and times > 0
        bins += times
        for x in items:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert bins >= -(-sum(k * n for k, n in counts.items()) // 64)


def sums(size, **free):
    counts = np.zeros(size + 1, np.int64)
    for length, n in free.items():
        counts[int(length[1:])] = n
    return packing.SumIndex(counts)


def test_index_finds_exact_sums():
    index = sums(64, l3=1, l9=2, l20=1)
    assert index.complement(20) == (20,)
    assert index.complement(18) == (9, 9)
    assert index.complement(32) == (20, 9, 3)
    assert index.complement(27) is None
    assert index.complement(6) is None
    index.free[9] = 1  # what is used up is found no more
    assert index.complement(18) is None and index.complement(32) == (20, 9, 3)
    assert sums(64, l7=3).complement(21) == (7, 7, 7) and sums(64, l7=2).complement(21) is None


@given(st.lists(st.integers(1, 20), min_size=1, max_size=30), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_index_holds_every_sum(lengths, gap):
    counts = np.bincount(lengths, minlength=61)
    found = packing.SumIndex(counts).complement(gap)
    every = {sum(c) for n in (1, 2, 3) for c in itertools.combinations(lengths, n)}
    assert (found is not None) == (gap in every)
    assert found is None or sum(found) == gap and all(counts[x] >= n for x, n in Counter(found).items())


def fewest(lengths, size):
    """The least number of sequences, by trying all ways."""
    best = [len(lengths)]

    def place(at, room):
        if len(room) >= best[0] and at < len(lengths):
            return
        if at == len(lengths):
            best[0] = min(best[0], len(room))
            return
        for k in {r: k for k, r in enumerate(room) if r >= lengths[at]}.values():
            place(at + 1, [*room[:k], room[k] - lengths[at], *room[k + 1 :]])
        place(at + 1, [*room, size - lengths[at]])

    place(0, [])
    return best[0]


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_plan_is_near_the_least_number_of_sequences(lengths):
    bins = sum(times for _, times in packing.plan(dict(Counter(lengths)), 20))
    assert bins <= fewest(sorted(lengths, reverse=True), 20) + 1


def test_plan_of_many_pieces_wastes_little():
    draw = np.random.default_rng(4)
    lengths = np.minimum(2048, np.exp(draw.normal(6, 1, 50_000)).astype(int) + 1)
    bins = sum(times for _, times in packing.plan(dict(Counter(lengths.tolist()))))
    assert bins == -(-int(lengths.sum()) // 2048)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, " \n" * 600_000 + "x", "a" * 2_000_000, "é" * 300_000, "\u3000" * 700_000])
def test_very_long_runs_equal_the_library(byte_tokenizers, text):
    own, library = byte_tokenizers
    assert own.encode(["a", text])[1].tolist() == library.encode(text, add_special_tokens=False).ids


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_byte_ids_equal_the_library(byte_tokenizers, text):
    own, library = byte_tokenizers
    assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="session")
def byte_tokenizers():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    return packing.ByteTokenizer(path), Tokenizer.from_file(path)


def test_both_libraries_class_characters_alike(byte_tokenizers):
    """Every 37th code point, among letters, digits, marks and spaces."""
    own, library = byte_tokenizers
    texts = [f"a{c}b 1{c}2 {c} {c}{c}!{c}\n{c}a  {c}" for c in (chr(i) for i in range(0, 0x110000, 37) if not 0xD800 <= i < 0xE000)]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("size", [64, 2048])
def test_packing_is_whole_and_gapless(spark, docs, rows, byte_tokenizers, size):
    out = packing.pack(spark, docs, tokenizer("byte_bpe_50k.json"), size).collect()
    ids = {i: [*byte_tokenizers[1].encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    for i, own in ids.items():
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert sum(r.length for r in mine) == len(own) and (len(own) <= size) == (len(mine) == 1)
        assert all(r.length == size for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size


def test_packing_odd_rows_and_empty(spark, odd_docs, no_docs):
    path = tokenizer("byte_bpe_50k.json")
    assert packing.pack(spark, no_docs, path).count() == 0
    assert packing.pack(spark, odd_docs, path).filter("doc_id is null").count() == 2


def brute_secrets(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(a, b, k) for a, _, b, k in sorted(spans)]


SECRET = st.lists(st.sampled_from(["password", "TOKEN", "Api_Key", "apikey", "passwd", "secret", "=", ": ", " ", '"', "'", "abcdef12", "0123456789abcdef", "AKIA", "ABCD1234EFGH", "é", "\n", "x", "ſecret", "日本", "ff"]), max_size=30).map("".join)


@given(st.lists(SECRET, min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_secrets_equal_plain_patterns(texts):
    raw = [t.encode() for t in texts]
    found = secrets.find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert found == [brute_secrets(t) for t in texts]


def checked_token(body="A" * 30):
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = secrets.BASE62[digit] + digits
    return f"ghp_{body}{digits.rjust(6, '0')}"


def test_checksums_decide(spark):
    good = checked_token()
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    out = secrets.report(spark.createDataFrame([(1, f"é {good} x"), (2, bad), (3, None)], "doc_id int, text string")).collect()
    assert [(r.n_checked, r.spans) for r in out] == [(1, "checked:2:42"), (0, ""), (0, "")]
    assert out[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_secrets_odd_tables(spark, docs, odd_docs, no_docs):
    """Nulls, repeated rows and clashing columns: one row for each row, clean texts without spans; an empty table is empty."""
    rows = [(7, "token = abcdefgh1 " + "x" * 200_000 + " token = abcdefgh2", "k")] * 2 + [(None, "secret: 0123456789", "k"), (8, None, "k"), (9, "", "k")]
    out = secrets.report(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert sorted((r.doc_id or 0, r.n_assign) for r in out) == [(0, 1), (7, 2), (7, 2), (8, 0), (9, 0)]
    assert {r.base_sha256 for r in out if r.doc_id in (8, 9)} == {hashlib.sha256(b"").hexdigest()}
    for table in (docs, odd_docs):
        assert secrets.report(table).count() == table.count() == secrets.redact(table).count()
    assert secrets.report(no_docs).count() == 0 and secrets.redact(no_docs).count() == 0


def test_redaction_keeps_rows_and_columns(spark, docs):
    rows = spark.createDataFrame([(1, "my password = hunter22 and more", 31), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in secrets.redact(rows).collect()}
    assert out[1].text == "my [SECRET] and more" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[2].n_chars is None and out[3].text == "clean"
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == docs.count()


def brute_shape(text):
    text = text or ""
    words, seen, copies = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    at, covered = {}, set()
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered)


def test_rules_base_equals_brute_force(spark, docs, rows, no_docs, odd_docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10, 20)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in rules.apply_rules(spark, docs, labels).collect()}
    for i, t in rows:
        r, own = out[i], brute_shape(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0]) and not (r.base_failed and r.kept)
    assert rules.apply_rules(spark, no_docs, labels).count() == 0
    assert rules.apply_rules(spark, odd_docs, labels.limit(0)).count() == odd_docs.count()


@given(st.lists(st.text(alphabet="ab \n\té|", max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_shape_counts(texts):
    raw = [t.encode() for t in texts]
    own = shape.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = list(zip(*(own[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute_shape(t) for t in texts]


def test_shape_tells_like_hashes_apart(monkeypatch):
    """Lines and words that polynomial hashes modulo 2**64 can't tell; and all lines, words and windows of one hash."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, other = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    texts = [f"{one}\n{other}\n{one}", f"{one} {other} a b c {other} {one} a b c", "a b c d e f a b c d e g", ""]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for _ in range(2):
        own = shape.counts(data, at)
        assert list(zip(*(own[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)) == [brute_shape(t) for t in texts]
        monkeypatch.setattr(flat.SpanHash, "__call__", lambda self, starts, ends: np.zeros(len(starts), np.uint64))


def test_binomial_bound_is_exact():
    assert rules.tail(0, 100, 0.05) == pytest.approx(0.95**100)
    assert rules.tail(1, 3, 0.5) == pytest.approx(0.5)
    assert rules.tail(3, 3, 0.5) == 1.0
    few = np.zeros(len(rules.CUTOFFS) + 1, int)
    few[0] = 50
    assert rules.choose(few, 0.01, 0.05) == float("inf")  # too few labels prove nothing
    many = few * 100
    assert rules.choose(many, 0.01, 0.05) == rules.CUTOFFS[-1]
    many[-1] = 200  # rates above the loosest cutoff
    assert rules.choose(many, 0.01, 0.05) == float("inf")


def plain(i, junk):
    """Forty words that don't repeat; junk has a mark on each."""
    return " ".join(f"{'#$' if junk else ''}word{(i * 41 + k) % 9973}{'abcdefgh'[k % 8]}" for k in range(40))


def test_cutoffs_keep_their_promise(spark):
    langs = ("en", None, "", "xx")
    rows = [(i, langs[i % 4] if i % 4 < 3 or i < 400 else "en", plain(i, i % 10 < 2 or i % 450 == 45)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i % 10 >= 2)) for i, _, _ in rows], "doc_id long, quality int")
    out = rules.apply_rules(spark, docs, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id")
    assert out.filter("base_failed").count() == 0
    lost = {r.lang: r.lost / r.n for r in out.filter("quality = 1").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("lost")).collect()}
    assert all(share <= rules.ALPHA for share in lost.values()) and max(lost.values()) > 0  # some good documents look like junk
    caught = {r.lang: r.caught / r.n for r in out.filter("quality = 0").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("failed_rule") == "symbols").alias("caught")).collect()}
    assert caught == {"en": 1.0, None: 1.0, "": 1.0, "xx": 0.0}  # a hundred labels prove nothing


def test_copies_teach_once(spark):
    """A good text repeated 400 times, in rows or under doc_ids of its own, is one trial and proves no cutoff."""
    for spread in (False, True):
        rows = [(4 * i if spread else 0, "en", plain(0, False)) for i in range(400)] + [(10_001 + 4 * i, "en", plain(i, True)) for i in range(100)]
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
        labels = spark.createDataFrame([(i, 1) for i in {r[0] for r in rows[:400]}], "doc_id long, quality int")
        assert rules.apply_rules(spark, docs, labels).filter("not kept").count() == 0


@given(st.lists(st.integers(0, 260), min_size=3, max_size=3), st.sampled_from([0.01, 0.02, 0.3]), st.sampled_from([0.0125, 0.05]))
@settings(max_examples=60, deadline=None)
def test_choose_equals_exact_fractions(counts, alpha, delta):
    from fractions import Fraction
    from math import comb

    places = (0, len(rules.CUTOFFS) // 2, len(rules.CUTOFFS))
    histogram = np.zeros(len(rules.CUTOFFS) + 1, int)
    for place, n in zip(places, counts, strict=True):
        histogram[place] += n
    n, p, best = int(histogram.sum()), Fraction(alpha), float("inf")
    for k, cutoff in enumerate(rules.CUTOFFS):
        lost = sum(int(h) for b, h in enumerate(histogram) if b >= len(rules.CUTOFFS) - k)
        if n == 0 or sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(lost + 1)) > Fraction(delta):
            break
        best = cutoff
    assert rules.choose(histogram, alpha, delta) == best


def test_null_and_empty_strata_are_apart(spark):
    """Junk is good where lang is null and bad where it is empty: only the latter gets a cutoff."""
    rows = [(i, None if i % 2 else "", plain(i, i % 4 < 2)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else int(i % 4 >= 2)) for i in range(4000)], "doc_id long, quality int")
    out = rules.apply_rules(spark, docs, labels).filter("not kept").select((F.col("doc_id") % 4).alias("m")).distinct().collect()
    assert [r.m for r in out] == [0]


def test_pair_weights_point_the_right_way():
    draw = np.random.default_rng(2)
    good, bad = draw.normal(0, 1, (400, 3)) + [1, 0, -1], draw.normal(0, 1, (300, 3))
    w = ranker.fit_pairs(good, bad, 20_000)
    assert w[0] > 0.5 and w[2] < -0.5 and abs(w[1]) < 0.3


def test_ranker_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = ranker.score_documents(spark, docs, labels).join(labels, "doc_id").filter("held_out")
    n, right = out.count(), out.filter("predicted = quality").count()
    assert right >= 0.93 * n
    assert out.filter("predicted != case when score >= 0.7 then 1 else 0 end").count() == 0


@pytest.mark.parametrize("bad", [10, 50, 80, 97])
def test_ranker_cut_reaches_the_boundary(spark, bad):
    draw = np.random.default_rng(3)
    quality = (np.arange(2000) % 100 >= bad).astype(int)
    rows = draw.normal(0, 0.1, (2000, len(ranker.features()))) + 3 * quality[:, None]
    model = ranker.fit(rows, quality)
    assert ((rows @ np.array(model.weights) + model.shift >= model.threshold) == quality).all()


def brute_features(text):
    """The ranker's features from counts by plain Python."""
    text = text or ""
    words, chars, symbols, copies, repeats = brute_shape(text)
    seen, lines = set(WORD.findall(text)), sum(bool(WORD.search(line)) for line in text.split("\n"))
    count = lambda pattern: len(re.findall(pattern, text))
    upper, lower, bangs, digits, marks = count("[A-Z]"), count("[a-z]"), count("[!?]"), count("[0-9]"), count("[.,;:]")
    out = []
    for a, b in ((symbols, words), (copies, lines), (repeats, words), (bangs, words), (upper, upper + lower), (digits, chars), (marks, words)):
        out += [a / max(b, 1), math.sqrt(a / max(b, 1))]
    by_length = math.log1p(len(seen)) / max(math.log1p(words), 1.0)
    return [*out, chars / max(words, 1), len(seen) / max(words, 1), by_length, math.log1p(words), float(words < 10), float(words < 30), math.log1p(words / max(lines, 1)), float(words == 0)]


def test_ranker_equals_brute_force(spark):
    """The fit is the least loss on the pairs drawn, the cut the best of all, and each score follows from plain counts."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "Ab! 12 é\n\nAb! 12 é\n" * 9)], "doc_id long, text string"))
    labels = spark.read.parquet(f"{d}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: int(r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in texts}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    signed = lambda i: (h := xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)) - (h >> 63 << 64)
    learn = sorted((i for i in known if not held[i]), key=signed)
    x, quality = np.array([brute_features(texts[i]) for i in learn]), np.array([known[i] for i in learn])
    model = ranker.train(shape.measure(docs), labels)
    weights = np.array(model.weights)

    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1.0
    standard, w = (x - mean) / spread, weights * spread
    draw = np.random.default_rng(7)
    good, bad = (standard[quality == k] for k in (1, 0))
    pairs = good[draw.integers(len(good), size=ranker.MOST_PAIRS)] - bad[draw.integers(len(bad), size=ranker.MOST_PAIRS)]
    slope = -(pairs / (1 + np.exp(pairs @ w))[:, None]).mean(0) + 1e-3 * w  # of a strictly convex loss: zero at its least value alone
    assert np.abs(slope).max() < 1e-6

    raw = x @ weights + model.shift
    told = lambda cut: int(((raw >= cut) == quality).sum())
    seen = sorted(set(raw.tolist()))
    assert told(model.threshold) == max(map(told, [seen[0] - 1, *((a + b) / 2 for a, b in itertools.pairwise(seen)), seen[-1] + 1]))

    out = ranker.score_documents(spark, docs, labels).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        z = float(np.dot(weights, brute_features(texts[r.doc_id]))) + model.shift - model.threshold + math.log(0.7 / 0.3)
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))), abs=1e-9)
        assert r.held_out == held[r.doc_id] and r.predicted == int(r.score >= 0.7)


def test_ranker_drops_mostly_bad_documents(spark):
    good = lambda i: " ".join(f"word{(i * 7 + k * k) % 97} of" for k in range(60)) + "."
    junk = lambda i: "### $$$ !!! BUY %%% " * (20 + i % 7)
    docs = spark.createDataFrame([(i, good(i) if i % 5 == 0 else junk(i), "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int")
    assert sorted(r.doc_id for r in ranker.keep_quality(spark, docs, labels).collect()) == list(range(0, 400, 5))


def test_ranker_edge_cases(spark, docs, no_docs, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ranker.score_documents(spark, docs, none).filter("predicted = 1").count() == docs.count()
    assert ranker.score_documents(spark, no_docs, none).count() == 0
    bad = spark.createDataFrame([(i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    out = ranker.score_documents(spark, odd_docs, bad)
    assert out.count() == odd_docs.count() and out.filter("predicted = 1 or score < 0 or score > 1").count() == 0
    assert ranker.keep_quality(spark, docs, none).columns == docs.columns


def test_a_score_at_the_cut_stays(spark):
    """Equal documents with unlike labels tie: all of them stay or all go."""
    text = " ".join(f"word{k} of" for k in range(60))
    docs = spark.createDataFrame([(i, text) for i in range(40)] + [(None, text), (1, text), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert ranker.score_documents(spark, docs, labels).filter("doc_id < 40 or doc_id is null").select("predicted").distinct().count() == 1
    assert ranker.keep_quality(spark, docs, labels).filter("text is not null").count() in (0, 42)


def test_rollup_commits_once(spark, docs):
    store = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-test-{id(docs)}")
    assert store.totals().count() == 0
    counts = token_rollup.count_tokens(docs, "words-1")
    assert store.commit("one", token_rollup.inserts(counts)) and not store.commit("one", token_rollup.inserts(counts))
    total = store.totals().groupBy().sum("n_docs", "n_tokens").first()
    assert total[0] == docs.count()
    assert store.commit("two", token_rollup.revisions(counts, token_rollup.count_tokens(docs, "words-2")))
    assert {r.version for r in store.totals().collect()} == {"words-2"}
    assert store.commit("none", token_rollup.inserts(counts).limit(0)) and store.batches() == ["none", "one", "two"]
    assert store.commit("gone", token_rollup.deletes(token_rollup.count_tokens(docs, "words-2"))) and store.totals().count() == 0
    with pytest.raises(ValueError):
        store.commit("../x", counts)


def test_rollup_folds_batches(spark, docs):
    """Totals, and what was committed before, outlive folding, dying in the midst of it, and folding again."""
    path = f"{shared_dir(spark)}/rollup-fold-{id(docs)}"
    store = token_rollup.TokenRollup(spark, path)
    counts = token_rollup.count_tokens(docs, "words-1")
    rows = lambda: sorted(map(tuple, store.totals().collect()), key=str)
    assert store.compact() == 0 and rows() == []
    store.commit("one", token_rollup.inserts(counts.filter("doc_id % 2 = 0")))
    store.commit("two", token_rollup.inserts(counts.filter("doc_id % 2 = 1")))
    before = rows()
    assert {r[1] for r in before} == {"en", None}  # a null key is a key of its own
    # One that died before its list was written: its totals are nobody's.
    store.totals().write.parquet(f"{path}/folded=1/totals")
    assert rows() == before and store.batches() == ["one", "two"]
    assert store.compact() == 2 and rows() == before and store.batches() == ["one", "two"] and store._names("batch", "") == []
    assert not store.commit("one", token_rollup.inserts(counts.filter("doc_id % 2 = 0"))) and rows() == before
    with pytest.raises(ValueError):
        store.commit("one", token_rollup.inserts(counts))
    store.commit("three", token_rollup.deletes(counts.union(counts).filter("doc_id = 10")))  # repeated rows count each
    with pytest.raises(ValueError):
        store.commit("three", token_rollup.deletes(counts.filter("doc_id = 10")))
    after = rows()
    assert after != before and store.compact() == 3 and rows() == after and store.compact() == 3
    assert store.batches() == ["one", "three", "two"] and store._folded() == 2 and store._names("folded", "known/") == ["2"]


def test_rollup_died_half_way(spark, docs):
    path = f"{shared_dir(spark)}/rollup-died-{id(docs)}"
    store = token_rollup.TokenRollup(spark, path)
    counts = token_rollup.count_tokens(docs, "words-1")
    token_rollup.inserts(counts).write.parquet(f"{path}/batch=one")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=one/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)
    assert store.totals().count() == 0
    assert store.commit("one", token_rollup.inserts(counts)) and store.totals().groupBy().sum("n_docs").first()[0] == docs.count()


def test_replay_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd_docs.selectExpr("*", "cast(null as string) as source")
    totals = {r.version: (r.n_docs, r.source) for r in token_rollup.replay(spark, docs, none).groupBy("version").agg(F.sum("n_docs").alias("n_docs"), F.max("source").alias("source")).collect()}
    assert totals == {"words-1": (odd_docs.count(), None), "words-2": (odd_docs.count(), None)}
    assert token_rollup.replay(spark, no_docs, none).count() == 0


ENCODERS = ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")


@pytest.fixture(scope="session")
def library_counts():
    """How many ids the libraries themselves give a text, by file."""
    import public_tokenizers
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    byte, pieces = Tokenizer.from_file(tokenizer(ENCODERS[0])), sentencepiece.SentencePieceProcessor(model_file=tokenizer(ENCODERS[2]))
    with open(tokenizer(ENCODERS[1])) as f:
        ranks = {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in f}
    multi = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {
        ENCODERS[0]: lambda t: len(byte.encode(t, add_special_tokens=False).ids),
        ENCODERS[1]: lambda t: len(multi.encode_ordinary(t)),
        ENCODERS[2]: lambda t: len(pieces.encode(t)),
    }


def test_versions_count_as_the_libraries_do(spark, docs, rows, odd_docs, library_counts):
    versions = {e: tokenizer(e) for e in ENCODERS} | {"words-1": token_rollup.WORDS}
    got = {r.doc_id: r.asDict() for r in token_rollup.count_versions(docs, versions).collect()}
    assert sorted(got) == [i for i, _ in rows]
    for i, t in rows:
        assert got[i]["words-1"] == len(WORD.findall(t or ""))
        assert [got[i][e] for e in ENCODERS] == [library_counts[e](t or "") for e in ENCODERS]
    odd = odd_docs.selectExpr("*", "cast(null as string) as source")
    assert token_rollup.count_versions(odd, versions).count() == odd.count()
    assert token_rollup.count_versions(odd.limit(0), versions).count() == 0


def test_white_space_of_millions_is_counted():
    count = token_rollup.encoder(tokenizer("byte_bpe_multi_50k.tiktoken"))
    per = count(" " * 100_000 + "x") / 100_000
    assert count(" " * 2_000_000 + "x") == pytest.approx(per * 2_000_000, rel=0.01)


def test_token_replay_equals_brute_force(spark, docs, rows, library_counts):
    labels = spark.createDataFrame([(12, 0, 0), (18, 0, 0), (25, 0, 0), (10, 1, 1), (24, 0, 1), (26, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    low, toxic = {12, 18, 25}, {10, 24}
    want = Counter()
    for i, t in rows:
        if i in toxic:
            continue
        for version in [ENCODERS[1]] if i in low else ENCODERS[:2]:
            key = (f"s{i % 2}", "en" if i % 3 else None, version)
            want[(*key, "docs")] += 1
            want[(*key, "tokens")] += library_counts[version](t or "")
    got = Counter()
    for r in token_rollup.replay(spark, docs, labels, {e: tokenizer(e) for e in ENCODERS[:2]}).collect():
        got[r.source, r.lang, r.version, "docs"], got[r.source, r.lang, r.version, "tokens"] = r.n_docs, r.n_tokens
    assert got == want


def test_rollup_two_writers_and_one_that_dies(spark, docs):
    """A writer that began before another ended commits nothing, and what was committed stays as it is."""
    path = f"{shared_dir(spark)}/rollup-race-{id(docs)}"
    counts = token_rollup.inserts(token_rollup.count_tokens(docs, "words-1"))

    class Late(token_rollup.TokenRollup):
        """Another writer commits while this one writes."""

        def _rename(self, old, new):
            token_rollup.TokenRollup(self.spark, self.path).commit(new.partition("=")[2], counts)
            return super()._rename(old, new)

    class Dies(token_rollup.TokenRollup):
        def _rename(self, old, new):
            raise KeyboardInterrupt

    store = token_rollup.TokenRollup(spark, path)
    with pytest.raises(KeyboardInterrupt):
        Dies(spark, path).commit("one", counts)
    assert store.batches() == [] and store.totals().count() == 0
    assert not Late(spark, path).commit("one", counts)
    assert store.batches() == ["one"] and store.totals().groupBy().sum("n_docs").first()[0] == docs.count()
    with pytest.raises(ValueError):
        Late(spark, path).commit("two", counts.filter("doc_id > 12"))
    assert store.totals().groupBy().sum("n_docs").first()[0] == 2 * docs.count()
    assert store.compact() == 2 and not Late(spark, path).commit("one", counts)


def test_cache_is_bounded_by_characters():
    from trailbase.llm.chunk_cache import RunCache

    cache = RunCache(lambda words: [w.upper() for w in words], most_chars=100)
    for i in range(50):
        word = f"{i}-" + "x" * 40
        assert cache.values([[word, "a"]])[word] == word.upper()
        assert sum(map(len, cache.known)) <= 100


def test_word_spans_and_hashes():
    data = "a bb\tccc  dd".encode()
    texts = np.frombuffer(data, np.uint8)
    starts, ends, first = flat.words(texts, np.array([0, 4, 4, len(data)]))
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == [b"a", b"bb", b"ccc", b"dd"] and first.tolist() == [0, 2, 2, 4]
    again = flat.SpanHash(flat.BYTE_VALUE[np.frombuffer(b"zzbb", np.uint8)])
    assert flat.SpanHash(flat.BYTE_VALUE[texts])(starts[1:2], ends[1:2]) == again(np.array([2]), np.array([4]))


def test_batches_of_empty_texts():
    from trailbase.llm import near_dup, repeats

    none, at = np.zeros(0, np.uint8), np.zeros(4, np.int64)
    assert flat.words(none, at)[2].tolist() == [0, 0, 0, 0]
    assert all(v.tolist() == [0, 0, 0] for v in shape.counts(none, at).values())
    assert secrets.find(none, at) == [[], [], []]
    assert [len(s) for s in near_dup.shingles(none, at, 2)] == [0, 0, 0]
    for words in (False, True):
        windows = repeats.Windows(20, 6, words, False)
        assert len(windows.segments(windows.symbols(none, at))[0]) == 0


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get(SETTING).rstrip("/")
