"""Whole texts as flat byte arrays: word spans, span hashes and Arrow batches.

Operators of this subpackage that leave the JVM do so through ``mapInArrow``.
They look at a few megabytes of text at a time as one ``uint8`` array with
document offsets, so that the work per byte is numpy's and not the
interpreter's.  A word is a maximal run of bytes outside ``0x20, 0x09-0x0D``;
as those bytes never occur inside a longer UTF-8 sequence, byte spans and
character spans agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MUL = 0x9E3779B97F4A7C15
#: The prime of the span hashes and two bases of large order modulo it.
PRIME, BASES = U64((1 << 31) - 1), (1_164_413_355, 746_205_981)
_powers: dict[int, list[np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a bijection."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: One random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_MUL))


def powers(n: int, base: int) -> list[np.ndarray]:
    """The first n powers of a base and of its inverse, modulo PRIME."""
    known = _powers.setdefault(base, [np.ones(1, U64), np.ones(1, U64)])
    while len(known[0]) < n:
        for k, factor in enumerate((base, pow(base, -1, int(PRIME)))):
            known[k] = np.concatenate([known[k], known[k] * U64(pow(factor, len(known[k]), int(PRIME))) % PRIME])
    return known


class SpanHash:
    """64-bit hashes of any spans of a sequence of 64-bit symbols, by prefix sums.

    Two polynomials modulo a prime, one over the low and one over the high 31
    bits of the symbols, and the length.  Equal hashes make spans candidates;
    whatever decides a result compares the symbols (``same``).
    """

    def __init__(self, symbols: np.ndarray):
        self.sides = []
        for base, half in zip(BASES, (symbols & PRIME, symbols >> U64(33)), strict=True):
            power, inverse = powers(len(symbols) + 1, base)
            sums = np.zeros(len(symbols) + 1, U64)
            np.cumsum(half * power[: len(symbols)] % PRIME, dtype=U64, out=sums[1:])
            self.sides.append((sums, inverse))

    def side(self, which: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One of the two polynomials alone."""
        sums, inverse = self.sides[which]
        return (sums[ends] - sums[starts]) % PRIME * inverse[starts] % PRIME

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        both = self.side(0, starts, ends) | self.side(1, starts, ends) << U64(31)
        return mix(both + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Hashes of spans of bytes, the spans in order and not overlapping; about ``most`` bytes are looked at at a time."""
    out, low = np.empty(len(starts), U64), 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + most, "right")))
        base = starts[low]
        out[low:high] = SpanHash(BYTE_VALUE[data[base : ends[high - 1]]])(starts[low:high] - base, ends[low:high] - base)
        low = high
    return out


def sort_within(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order of rows by group and then value, by two sorts of single numbers; groups are numbered from 0."""
    if not group.any():
        return np.argsort(value)
    order = np.argsort(value)
    ordered = value[order]
    rank = np.empty(len(value), np.int64)
    rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    return np.argsort(group * len(value) + rank)


def same(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether the spans of these sizes from a and from b hold the same symbols; each is compared, about ``most`` at a time."""
    out = np.ones(len(a), bool)
    some = np.flatnonzero(size > 0)
    total = np.cumsum(size[some])
    for part in np.split(some, np.searchsorted(total, np.arange(most, total[-1] if len(total) else 0, most))):
        n = size[part].astype(np.int64)
        if len(n):
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = symbols[np.repeat(a[part], n) + step] == symbols[np.repeat(b[part], n) + step]
            out[part] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The same number for spans of the same bytes and only for those: found by hash, confirmed byte for byte."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    head = first[number]
    again = np.flatnonzero(head != np.arange(len(head)))
    a, b, size = starts[again], starts[head[again]], ends[again] - starts[again]
    like = size == ends[head[again]] - b
    if like.all() and same(data, a, b, size).all():
        return number
    raw = data.tobytes()
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, and where each value begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 19, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about most_bytes of text (one document at least), each with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = buffers(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most_bytes, "right")) - 1)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each document's first word (with a last entry for the end)."""
    inside = ~SPACE[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | cut[:n]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each item, from the index of each document's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
