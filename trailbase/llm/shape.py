"""Counts that describe the shape of whole texts, for quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import flat
from .workspace import documents

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_bangs", "n_chars")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS = _class("#*$%&|<>")
UPPER, LOWER, DIGITS = (_class("".join(map(chr, range(a, b)))) for a, b in ((65, 91), (97, 123), (48, 58)))
MARKS, BANGS = _class(".,;:"), _class("!?")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][at])


def _alike(word: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the same words in the same document as one number, and how often each number occurs."""
    hashes = flat.SpanHash(flat.mix(word.astype(flat.U64)))(begin, begin + WINDOW)
    key = flat.mix(hashes + doc[begin].astype(flat.U64) * flat.U64(0xA0761D6478BD642F))
    _, first, number, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[number] > 1)
    a, b = begin[again], begin[first[number[again]]]
    if (doc[a] == doc[b]).all() and flat.same(word, a, b, np.full(len(a), WINDOW)).all():
        return number, times
    rows = np.column_stack([doc[begin], *(word[begin + k] for k in range(WINDOW))])
    return np.unique(rows, axis=0, return_inverse=True, return_counts=True)[1:]


def counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each document; equal lines, words and windows are found by hash and confirmed byte for byte."""
    n = len(at) - 1
    starts, ends, first = flat.words(data, at)
    hashes = flat.SpanHash(flat.BYTE_VALUE[data])
    n_words = np.diff(first)
    point = (data & 0xC0) != 0x80
    inside = ~flat.SPACE[data]
    out = {"n_words": n_words, "word_chars": _sums(point & inside, at), "n_symbols": _sums(SYMBOLS[data], at)}

    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(at[:-1], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(at, line_start, "right") - 1
    line_end = np.minimum(np.r_[line_start[1:], len(data)], at[line_doc + 1])
    line_end -= (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    line = flat.numbered(data, line_start, line_end, hashes(line_start, line_end))
    _, one = np.unique(line_doc * (len(line) + 1) + line, return_index=True)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[one], minlength=n)

    word = flat.numbered(data, starts, ends, hashes(starts, ends))
    doc = flat.owners(first)
    _, one = np.unique(doc * (len(word) + 1) + word, return_index=True)
    out["n_distinct_words"] = np.bincount(doc[one], minlength=n)
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) >= WINDOW:
        begin = np.flatnonzero(np.arange(len(word)) + WINDOW <= first[doc + 1])
        inverse, times = _alike(word, doc, begin)
        begin = begin[times[inverse] > 1]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(covered[:-1]) > 0, first)
    for name, which in (("n_upper", UPPER), ("n_lower", LOWER), ("n_digits", DIGITS), ("n_marks", MARKS), ("n_bangs", BANGS)):
        out[name] = _sums(which[data], at)
    out["n_chars"] = _sums(point, at)
    return out


def measure(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, further columns named, and COUNTS of whole texts, one row for each row; null and empty texts count nothing."""
    kept = documents(docs, *more)
    schema = kept.drop("text").schema
    for name in COUNTS:
        schema.add(name, "long")

    def run(batches):
        for part, data, at in flat.pieces(batches):
            own = counts(data, at)
            columns = [part.column(i) for i, f in enumerate(part.schema.names) if f != "text"]
            names = [f for f in part.schema.names if f != "text"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(own[k], pa.int64()) for k in COUNTS)], names=[*names, *COUNTS])

    return kept.mapInArrow(run, schema)
