"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are bounded by the sequence size, so all planning works on one
histogram of lengths, however many pieces there are.  The sums of one, two and
three lengths are indexed once (``SumIndex``).  For each length, from the
longest, the gap it leaves is looked up in that index; a combination that fits
exactly is consumed as often as the counts allow.  What is left goes by best
fit: the longest piece that fits, then again an exact complement of the new gap
if there is one.  A plan says which ranks of each length go where; it has at
most about four rows for each length.  Pieces get their rank within their
length from a count of their own task and the sum of the counts of the tasks
before it, so no task ever holds all pieces of one length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, documents

SIZE = 2048


class SumIndex:
    """Sums of one, two and three available lengths, each indexed by its sum.

    Counts only fall, so an entry is valid as long as its lengths are left.
    Pairs of a sum are listed with the longer length falling.  A triple is
    listed as its longest length; the other two are a pair of what remains.
    """

    def __init__(self, free: np.ndarray):
        self.free, size = free, len(free) - 1
        lengths = np.flatnonzero(free[1:] > 0) + 1
        longer, shorter = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        fit = (longer >= shorter) & (longer + shorter <= size) & ((longer != shorter) | (free[longer] > 1))
        self.pairs, self.pair_at = self._by_sum(longer[fit], shorter[fit], size)
        least = np.full(size + 1, size + 1)  # the least longer length among a sum's pairs
        some = np.flatnonzero(np.diff(self.pair_at))
        least[some] = self.pairs[self.pair_at[some + 1] - 1]
        first, rest = (x.ravel() for x in np.meshgrid(lengths, some, indexing="ij"))
        fit = (first + rest <= size) & (first >= least[rest])
        self.triples, self.triple_at = self._by_sum(first[fit], rest[fit], size)

    @staticmethod
    def _by_sum(first: np.ndarray, rest: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((-first, first + rest))
        return first[order], np.searchsorted((first + rest)[order], np.arange(size + 2))

    def pair(self, gap: int, most: int) -> tuple[int, int] | None:
        """The pair of available lengths, the longer as long as it may be, that sums to gap."""
        longer = self.pairs[self.pair_at[gap] : self.pair_at[gap + 1]]
        longer = longer[longer <= most]
        ok = (self.free[longer] > 0) & (self.free[gap - longer] > 0) & ((2 * longer != gap) | (self.free[longer] > 1))
        at = int(np.argmax(ok)) if len(ok) else 0
        return (int(longer[at]), gap - int(longer[at])) if len(ok) and ok[at] else None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to gap exactly."""
        if self.free[gap] > 0:
            return (gap,)
        if pair := self.pair(gap, gap):
            return pair
        firsts = self.triples[self.triple_at[gap] : self.triple_at[gap + 1]]
        for first in firsts[self.free[firsts] > 0].tolist():
            self.free[first] -= 1
            pair = self.pair(gap - first, first)
            self.free[first] += 1
            if pair:
                return (first, *pair)
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Compositions of sequences and how often each is used; they hold exactly the pieces counted."""
    free = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    index = SumIndex(free)
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(items: list[int]) -> None:
        need = Counter(items)
        times = min(int(free[x]) // n for x, n in need.items())
        for x, n in need.items():
            free[x] -= times * n
        out.append((tuple(items), times))

    if free[size]:
        consume([size])
    for length in range(size - 1, 0, -1):
        while free[length]:
            free[length] -= 1
            rest = index.complement(size - length)
            free[length] += 1
            if rest is None:
                break
            consume([length, *rest])
    for length in range(size - 1, 0, -1):
        while free[length]:
            items, gap, before = [length], size - length, free.copy()
            free[length] -= 1
            while gap:
                rest = index.complement(gap)
                if rest:
                    items += rest
                    break
                fits = np.flatnonzero(free[1 : gap + 1] > 0)
                if not len(fits):
                    break
                x = int(fits[-1]) + 1
                items.append(x)
                free[x] -= 1
                gap -= x
            free[:] = before
            consume(items)
    return out


def slots(counts: dict[int, int], size: int = SIZE) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, the sequences they go to, and the offsets there; the following ranks go to the following sequences."""
    rank: Counter = Counter()
    rows: dict[int, list] = {}
    sequence = 0
    for items, times in plan(counts, size):
        offset = 0
        for x in items:
            rows.setdefault(x, []).append((rank[x], sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(column, np.int64) for column in zip(*own, strict=True)) for x, own in rows.items()}


#: Fixed value: how byte-level BPE of this kind cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes: themselves where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Ids of whole texts, as the tokenizers library makes them from a byte-level BPE file.

    Where merges rank as their ids do, the same vocabulary is run by tiktoken,
    which is five times faster; both libraries put every Unicode character in
    the same class, so they cut and merge alike.  Texts that hold an added
    token, and those that tiktoken refuses (white space of a million characters
    exhausts its stack), go through tokenizers itself.
    """

    def __init__(self, path: str):
        self.path, self.fast, self.full = path, None, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cutter = file["model"], file["pre_tokenizer"] or {}
        letters, vocabulary = byte_letters(), file["model"]["vocab"]
        self.added = [t["content"] for t in file["added_tokens"]]
        joined = [("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        plain = model["type"] == "BPE" and not file["normalizer"] and not model.get("dropout") and not model.get("ignore_merges")
        byte_level = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        ranked = [vocabulary[m] for m in joined]
        if plain and byte_level and ranked == sorted(ranked):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in self.added}
            self.fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._one(t) for t in texts] if self.fast else self._slow(texts)

    def _one(self, text: str) -> np.ndarray:
        if not any(a in text for a in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return self._slow([text])[0]

    def _slow(self, texts: list[str]) -> list[np.ndarray]:
        if self.full is None:  # only if a text needs it: it takes much memory
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        return [np.array(e.ids, np.uint32) for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]


_tokenizers: dict[str, ByteTokenizer] = {}
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def cut(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Pieces of the documents' ids (each with id 0 at its end), with their place among the pieces of their length in their task."""

    def run(batches):
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = ByteTokenizer(tokenizer_path)
        context = TaskContext.get()
        task, seen = context.partitionId() if context else 0, np.zeros(size + 1, np.int64).tolist()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), _tokenizers[tokenizer_path].encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(0)).astype("<u4")
                    n = len(ids)
                    start, number = 0, 0
                    while start < n:
                        length = min(size, (n - start) % size or size)
                        rows.append((doc_id, number, start, length, zlib.crc32(ids[start : start + length]), task, seen[length]))
                        seen[length] += 1
                        start, number = start + length, number + 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return documents(docs).mapInArrow(run, _PIECES)


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of docs.

    A document of more than ``size`` ids is cut into pieces of ``size``, the
    first piece perhaps shorter; others stay whole.  Null and empty texts are
    id 0 alone.  Rows with a null doc_id and repeated rows are packed like any
    other; an empty table gives an empty result.  A text of any length is
    encoded whole in one task, which holds its ids; ties between combinations
    go to the one with the longest first length.
    """
    work = Workspace(spark, "packing")
    pieces = work.keep(cut(docs, tokenizer_path, size), "pieces")
    by_task = work.keep(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "by_task")
    # At most ``size`` rows reach the driver: one for each length.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(counts, size)  # at most about four rows for each length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    first, goes_to, at = where[int(length[own[0]])]
                    k = np.searchsorted(first, rank[own], "right") - 1
                    sequence[own], offset[own] = goes_to[k] + rank[own] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    # One row for each length and task: that grows with the corpus, so it is not broadcast.
    ranked = pieces.join(bases.hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
