"""Removal of repeated 20-word windows with prefix-partitioned suffix trees.

Suffixes that may repeat (see ``repeats``) are grouped by a prefix of variable
length, read from their anchor on and, past their end, from their beginning.
Prefixes are counted in a sample that grows with the texts: one that would not
fit a task's memory is made longer, step by step, up to all words of the window.
In each group a suffix tree is grown from the root, a word of depth at a time
for all its nodes together.  Where the words below a node differ, it is an
internal node and has an edge for each; where they don't, the edge gets longer;
a node with one leaf is not grown further.  The internal nodes that reach the
depth of a window are the maximal repeats: of their leaves the earliest stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import flat
from .repeats import Router, Symbols, Windows, covered, remove_repeats


def depths(length: int, gram: int) -> list[int]:
    """The lengths that a prefix may have: the anchor's, then a few more words each, then all."""
    return [*range(gram, length, 4), length]


def prefix_hashes(values: np.ndarray, begin: np.ndarray, off: np.ndarray, length: int, steps: list[int]) -> np.ndarray:
    """For each window a column of hashes: of its first words from its anchor on, in each of the lengths."""
    out, h = [], np.zeros(len(begin), flat.U64)
    for j in range(length):
        place = off + j
        turned = place == length  # past its end a window goes on at its beginning; how far its anchor lies from there tells windows apart
        h = np.where(turned, flat.mix(h ^ (off + 1).astype(flat.U64)), h)
        h = flat.mix(h * flat.U64(0x9E3779B97F4A7C15) + values[begin + np.where(place < length, place, place - length)])
        if j + 1 in steps:
            out.append(h)
    return np.stack(out)


class Prefixes(Router):
    """Groups by prefixes; ``longer[d]``: hashes of prefixes of the d-th length that are too common and take the next one."""

    def __init__(self, sample: list[bytes], buckets: int, length: int, gram: int):
        self.buckets, self.length, self.gram, self.steps = buckets, length, gram, depths(length, gram)
        most = max(1, 2 * len(sample) // buckets)
        table = np.frombuffer(b"".join(sample), flat.U64).reshape(len(sample), len(self.steps))
        self.longer = []
        for d in range(len(self.steps) - 1):
            prefix, n = np.unique(table[:, d], return_counts=True)
            self.longer.append(prefix[n > most])
            table = table[np.isin(table[:, d], self.longer[d])]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h % flat.U64(self.buckets)).astype(np.int64)

    def segments(self, symbols: Symbols, anchor: np.ndarray) -> np.ndarray:
        h = prefix_hashes(symbols.values, anchor, np.zeros(len(anchor), np.int64), self.gram, [self.gram])[0]
        return np.where(np.isin(h, self.longer[0]), -1, self._bucket(h))

    def windows(self, symbols: Symbols, begin: np.ndarray, off: np.ndarray) -> np.ndarray:
        table = prefix_hashes(symbols.values, begin, off, self.length, self.steps)
        h, more = table[0], np.ones(len(begin), bool)
        for d, longer in enumerate(self.longer):
            more &= np.isin(table[d], longer)
            h = np.where(more, table[d + 1], h)
        return self._bucket(h)


class SuffixTree:
    """The tree of suffixes of ``depth`` symbols, grown level by level; only nodes of several leaves are kept.

    ``node_depth`` and ``parent`` describe internal nodes in the order of their
    depth (the root, if it branches, is the first and has parent -1).
    """

    def __init__(self, symbols: np.ndarray, start: np.ndarray, depth: int):
        left, group = np.arange(len(start)), np.zeros(len(start), np.int64)
        above = np.full(1, -1, np.int64)  # the internal node that each group hangs below
        node_depth, parent, nodes = [], [], 0
        for d in range(depth):
            if not len(left):
                break
            value = symbols[start[left] + d]
            order = flat.sort_within(group, value)
            left, group, value = left[order], group[order], value[order]
            new = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])]
            edges = np.bincount(group[new], minlength=len(above))
            branches = np.flatnonzero(edges > 1)
            node_depth.append(np.full(len(branches), d))
            parent.append(above[branches])
            above[branches] = nodes + np.arange(len(branches))
            nodes += len(branches)
            child = np.cumsum(new) - 1
            above, size = above[group[new]], np.bincount(child)
            several = size > 1
            left, group, above = left[several[child]], (np.cumsum(several) - 1)[child[several[child]]], above[several]
        self.leaves, self.node = left, group
        #: Nodes of the full depth: their leaves are equal in all symbols.
        self.deep_parent = above if len(left) else np.zeros(0, np.int64)
        self.node_depth = np.concatenate(node_depth) if node_depth else np.zeros(0, np.int64)
        self.parent = np.concatenate(parent) if parent else np.zeros(0, np.int64)


def remove(spark: SparkSession, docs: DataFrame, length: int = 20, gram: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) for each row of docs.

    A word goes if a window of ``length`` words that covers it also starts
    earlier: in a document with a smaller doc_id, or before it in the same
    document.  Null and empty texts, and texts of fewer words, lose nothing;
    very long ones are read whole.  Rows that repeat a doc_id count as
    documents in the order of their texts; null doc_ids come last.  An empty
    table gives an empty result.
    """
    windows = Windows(length, gram, words=True, same_document=True)

    def sample_key(symbols: Symbols, begin: np.ndarray, off: np.ndarray) -> list[bytes]:
        return [row.tobytes() for row in prefix_hashes(symbols.values, begin, off, length, depths(length, gram)).T]

    def router(sample: list[bytes], buckets: int) -> Prefixes:
        return Prefixes(sample, buckets, length, gram)

    def equal(symbols: np.ndarray, start: np.ndarray):
        tree = SuffixTree(symbols, start, length)
        return tree.leaves, tree.node

    def finish(text, begin, end):
        words = (text or "").encode().split()
        if begin is None:
            return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
        gone = covered(len(words), begin, end).tolist()
        return len(words), sum(gone), hashlib.sha256(b" ".join([w for w, g in zip(words, gone, strict=True) if not g])).hexdigest()

    return remove_repeats(spark, docs, "trees", windows, sample_key, router, equal, finish, "n_words long, n_removed long, kept_sha256 string")
