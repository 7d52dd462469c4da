"""Windows of fixed length that repeat across a corpus, found without moving every suffix.

Both substring operators ask, for every window of L symbols (bytes or words),
whether the same window starts earlier.  A suffix for each position would move
many times the corpus.  So suffixes are sparse: they are ordered and grouped by
what follows their anchor, and neighbours with one anchor travel together.

* Anchors.  A window's anchor is its k-gram of least hash, the leftmost of
  equals: equal windows have the same anchor at the same place.  Neighbouring
  windows of one anchor form a segment, of which there is one for every ten or
  twenty symbols.  A task compares its own equal segments byte for byte; all but
  the earliest are repeats and go no further.  Segments then meet by the hash of
  their anchor, only to spare those whose anchor nobody else has.  An anchor
  that several documents of one task share is known to be open there already:
  the task sends one mark for it and not its segments, however many they are.
* Suffixes.  The bytes of open segments are fetched from the texts.  Where they
  go is the operator's own rule: a range between sampled splitters, or a prefix
  of variable length.  Leads that are too common for one task go window by
  window, each by all of its symbols, and of equal ones a task sends the earliest
  alone.  In its bucket every window is a suffix of L symbols, which the
  operator's own sort or tree compares symbol by symbol; of equal ones all but
  the earliest are repeats.  No hash decides that two windows are equal.
  Where most of a corpus is open, overlapping segments are several times as
  large as the texts: buckets then get theirs in several passes over the texts,
  one part of the buckets after another, so that the disk holds one part at a time.
* Removal.  The repeats go back to their documents.

Blobs between tasks are packed columns; a task holds one bucket of marks and one
of texts, and buckets grow in number with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .workspace import Workspace, documents, width

UNIT_BYTES, BUCKET_BYTES, PIECE_BYTES = 12 << 20, 24 << 20, 512 << 10
#: Windows that each UNIT_BYTES of text gives to the sample, windows in the sample at most, and most single windows held before equal ones are put together.
SAMPLES, MOST_SAMPLES, MOST_SINGLE = 16, 1 << 20, 400_000
SEGMENT, REPEAT, OPEN, KNOWN, SAMPLE, OPENED, TEXT = 0, 1, 2, 3, 4, 5, 9
#: Bytes of open segments that one pass fetches, for each byte of text.
PASS_SHARE = 1.5
ROWS = "dest int, kind int, key long, text string, blob binary"
_FIELDS = ROWS.replace(",", "").split()[::2]


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns as one compressed blob, their bytes by significance."""
    parts = [np.array([len(columns)], np.int64).tobytes()]
    body = []
    for c in columns:
        c = np.ascontiguousarray(c)
        parts.append(np.array([len(c), c.dtype.itemsize, ord(c.dtype.kind)], np.int64).tobytes())
        body.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts + body))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    heads, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3), 8 + 24 * n, []
    for size, item, kind in heads.tolist():
        planes = np.frombuffer(raw, np.uint8, size * item, at).reshape(item, size)
        out.append(np.ascontiguousarray(planes.T).view(f"{chr(kind)}{item}").reshape(size))
        at += size * item
    return out


def emit(rows: list[tuple[int, int, bytes]], opened: int = 0) -> pa.RecordBatch:
    """Rows of (dest, kind, blob); with ``opened`` one more that has this number as its key."""
    rows = [*rows, (0, OPENED, b"")] if opened else rows
    dest, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(kind, pa.int32()), pa.array([opened if k == OPENED else None for k in kind], pa.int64()), pa.nulls(n, pa.string()), pa.array(blob, pa.binary())], names=_FIELDS)


def by_dest(dest: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One row for each destination, with its part of the columns in their order; documents as differences."""
    if not len(dest):
        return
    order = np.argsort(dest, kind="stable")
    cuts = np.flatnonzero(np.diff(dest[order])) + 1
    for own in np.split(order, cuts):
        key = columns[0][own]
        yield int(dest[own[0]]), kind, squeeze(np.diff(key, prepend=np.int64(0)), *[c[own] for c in columns[1:]])


def restore(blobs: list[bytes]) -> list[np.ndarray]:
    """The columns of blobs of by_dest, together; the list is emptied on the way."""
    parts = []
    while blobs:
        parts.append(unsqueeze(blobs.pop()))
        parts[-1][0] = np.cumsum(parts[-1][0])
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


class Symbols:
    """The symbols of some documents: 64-bit values, where each document's begin, and their bytes.

    Symbol i is ``raw[edge[i] : edge[i + 1]]``.  Words are written with one space
    after each, so that equal runs of words are equal bytes.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, words: bool):
        if not words:
            self.raw, self.values, self.first = data, flat.BYTE_VALUE[data], at
            self.edge = np.arange(len(data) + 1)
            return
        starts, ends, self.first = flat.words(data, at)
        self.values = flat.SpanHash(flat.BYTE_VALUE[data])(starts, ends)
        size = ends - starts
        self.edge = np.r_[0, np.cumsum(size + 1)]
        self.raw = np.full(self.edge[-1], 32, np.uint8)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.raw[np.repeat(self.edge[:-1], size) + step] = data[np.repeat(starts, size) + step]

    def content(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of spans of symbols, one after another, and the number of bytes of each."""
        low, size = self.edge[begin], self.edge[end] - self.edge[begin]
        return self.raw[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())], size


class Windows:
    """What is asked: windows of ``length`` symbols; anchors of ``gram`` symbols; whether the same document counts."""

    def __init__(self, length: int, gram: int, words: bool, same_document: bool):
        self.length, self.gram, self.words, self.same_document = length, gram, words, same_document

    def symbols(self, data: np.ndarray, at: np.ndarray) -> Symbols:
        return Symbols(data, at, self.words)

    def segments(self, symbols: Symbols) -> tuple[np.ndarray, ...]:
        """(document, place, windows, anchor - place, hash of the anchor, hash of the segment), in order."""
        length, gram, n, first = self.length, self.gram, len(symbols.values), symbols.first
        room = np.diff(first) - length + 1
        if n < length or room.max(initial=0) <= 0:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint8, np.uint8, np.uint64, np.uint64))
        spans = flat.SpanHash(symbols.values)
        grams = spans(np.arange(n - gram + 1), np.arange(gram, n + 1))
        least = (grams & flat.U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=flat.U64)
        reach, whole = 1, length - gram + 1
        while 2 * reach <= whole:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < whole:
            least = np.minimum(least[: len(least) - (whole - reach)], least[whole - reach :])
        edge = np.zeros(n + 1, np.int64)
        some = room > 0
        edge[first[:-1][some]] += 1
        np.subtract.at(edge, first[:-1][some] + room[some], 1)
        place = np.flatnonzero(np.cumsum(edge[: len(least)]))
        anchor = (least[place] & flat.U64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[head, len(place)])
        place, anchor = place[head], anchor[head]
        doc = np.searchsorted(first, place, "right") - 1
        return doc, place - first[doc], count.astype(np.uint8), (anchor - place).astype(np.uint8), grams[anchor], spans(place, place + count - 1 + length)

    def later(self, group: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of rows sorted by group, key and place: which have an earlier row in their group."""
        if not len(group):
            return np.zeros(0, bool)
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[head, len(group)])
        later = key > np.repeat(key[head], size)
        return later | ((key == np.repeat(key[head], size)) & (place > np.repeat(place[head], size))) if self.same_document else later

    def shared(self, group: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Of rows sorted by group: whether their group has several documents (or several rows, if the same document counts)."""
        if not len(group):
            return np.zeros(0, bool)
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[head, len(group)])
        several = size > 1 if self.same_document else np.minimum.reduceat(key, head) != np.maximum.reduceat(key, head)
        return np.repeat(several, size)

    def symbols_of(self, count: np.ndarray) -> int:
        """Symbols of segments of so many windows, together."""
        return int(count.sum(dtype=np.int64)) + len(count) * (self.length - 1)

    def exact(self, content: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of contents as numbers that are equal only if their bytes are, and the index of each content's first."""
        if not self.words:
            return content, begin
        starts, ends, first = flat.words(content, np.r_[begin, len(content)])
        return flat.numbered(content, starts, ends, flat.span_hashes(content, starts, ends)), first[:-1]

    def settled(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray, hashes: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of spans, those of which an equal one comes earlier, and the others in their order; equal ones are found by hash and compared byte for byte."""
        order = np.lexsort((place, key, hashes))
        new = np.r_[True, hashes[order[1:]] != hashes[order[:-1]]][: len(order)]
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        later = self.later(np.cumsum(new), key[order], place[order])
        later[later] = size[order[later]] == size[head[later]]
        later[later] = flat.same(raw, begin[order[later]], begin[head[later]], size[order[later]])
        return order[later], np.sort(order[~later])


def bits48(gram: np.ndarray) -> list[np.ndarray]:
    low = gram.view(np.uint16).reshape(-1, 4)
    return [low[:, 0], low[:, 1], low[:, 2]]


def from48(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(flat.U64) | mid.astype(flat.U64) << flat.U64(16) | high.astype(flat.U64) << flat.U64(32)


def runs_of_windows(key: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring windows as one run: (key, place, windows)."""
    order = np.lexsort((place, key))
    key, place, count = key[order], place[order], count[order].astype(np.int64)
    if not len(key):
        return key, place, count
    head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1] + count[:-1])])
    return key[head], place[head], np.add.reduceat(count, head)


def _marked(buckets: int, key: np.ndarray, place: np.ndarray, count: np.ndarray) -> list:
    key, place, count = runs_of_windows(key, place, count)
    return list(by_dest(key % buckets, REPEAT, key, place, count))


def _opened(buckets: int, key: np.ndarray, place: np.ndarray, count: np.ndarray, off: np.ndarray) -> list:
    order = np.lexsort((place, key))
    key = key[order]
    return list(by_dest(key % buckets, OPEN, key, place[order].astype(np.uint32), count[order], off[order]))


def _anchors(windows: Windows, buckets: int, sample_key: Callable):
    """Texts to segments; a task compares its own equal segments, and knows which of its anchors several documents share."""

    def unit(held: list[tuple], raws: list[np.ndarray], samples: list[bytes]) -> pa.RecordBatch:
        key, place, count, off, gram, whole, begin, size = (np.concatenate(c) for c in zip(*held, strict=True))
        raw = np.concatenate(raws)
        held.clear(), raws.clear()
        gone, rest = windows.settled(raw, begin, size, whole, key, place)
        gram &= flat.U64(0xFFFFFFFFFFFF)
        rest = rest[np.lexsort((place[rest], key[rest], gram[rest]))]
        known = windows.shared(gram[rest], key[rest])
        opened, alone = rest[known], np.sort(rest[~known])
        alone = alone[np.argsort(key[alone], kind="stable")]
        seen = np.unique(gram[opened])
        rows = list(by_dest(_bucket(gram[alone], buckets), SEGMENT, key[alone], place[alone].astype(np.uint32), count[alone], off[alone], *bits48(gram[alone])))
        rows += by_dest(_bucket(seen, buckets), KNOWN, np.zeros(len(seen), np.int64), *bits48(seen))
        rows += _opened(buckets, key[opened], place[opened], count[opened], off[opened])
        rows += [(0, SAMPLE, b) for b in samples]
        samples.clear()
        return emit(rows + _marked(buckets, key[gone], place[gone], count[gone]), windows.symbols_of(count[opened]))

    def run(batches):
        held, raws, samples, size = [], [], [], 0
        for part, data, at in flat.pieces(batches, PIECE_BYTES):
            ids = part.column(0).to_numpy(zero_copy_only=False)
            symbols = windows.symbols(data, at)
            doc, place, count, off, gram, whole = windows.segments(symbols)
            start = symbols.first[doc] + place
            begin, end = symbols.edge[start], symbols.edge[start + count + windows.length - 1]
            held.append((ids[doc], place, count, off, gram, whole, begin + sum(map(len, raws)), end - begin))
            raws.append(symbols.raw)
            if len(doc):  # spread over the piece by a hash, the same wherever the text lies
                own = np.argsort(flat.mix(gram ^ whole))[: max(1, SAMPLES * len(data) // UNIT_BYTES)]
                samples += sample_key(symbols, start[own], off[own].astype(np.int64))
            size += len(data)
            if size >= UNIT_BYTES:
                yield unit(held, raws, samples)
                size = 0
        if held:
            yield unit(held, raws, samples)

    return run


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors are least hashes, so their upper bits are small: another mix spreads them."""
    return ((flat.mix(gram + flat.U64(1)) >> flat.U64(32)) * flat.U64(buckets) >> flat.U64(32)).astype(np.int64)


def _meet(windows: Windows, buckets: int):
    """Segments of one bucket of anchors: those whose anchor others have too are open, the others done.

    A task that holds several documents with one anchor sent a mark alone, so
    of any anchor there are at most so many rows here as tasks' units.
    """

    def run(batches):
        blobs, marks = [], []
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            for b, k in zip(batch.column(4).to_pylist(), kinds, strict=True):
                if k in (SEGMENT, KNOWN):
                    (blobs if k == SEGMENT else marks).append(b)
            yield batch.filter(pa.array([k not in (SEGMENT, KNOWN) for k in kinds]))
        if not blobs:
            return
        known = np.unique(from48(*restore(marks)[1:])) if marks else np.zeros(0, flat.U64)
        key, place, count, off, *gram = restore(blobs)
        gram = from48(*gram)
        order = np.lexsort((key, gram))
        key, place, count, off, gram = (x[order] for x in (key, place, count, off, gram))
        open_ = windows.shared(gram, key) | np.isin(gram, known)
        yield emit(_opened(buckets, key[open_], place[open_], count[open_], off[open_]), windows.symbols_of(count[open_]))

    return run


def _with_texts(batches, kind_of: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of texts of one bucket, and the columns of the blobs that came before them, sorted by document."""
    blobs, columns = [], None
    for batch in batches:
        kind = np.array(batch.column(1).to_pylist(), np.int64)
        blobs += [batch.column(4)[i].as_py() for i in np.flatnonzero(kind == kind_of).tolist()]
        texts = batch.slice(int((kind != TEXT).sum()))
        if texts.num_rows:
            if columns is None:
                columns = restore(blobs) if blobs else []
                if columns:
                    order = np.argsort(columns[0], kind="stable")
                    columns = [c[order] for c in columns]
            yield texts, columns


def _fetch(windows: Windows, buckets: int, router: Router, turn: int = 0, passes: int = 1):
    """Open segments with their bytes, sent to where suffixes that may be equal meet; of several passes, those for the buckets of this one."""

    def blobs(dest, key, place, count, size, content) -> list:
        rows, order, ends = [], np.argsort(dest, kind="stable"), np.cumsum(size)
        for mine in np.split(order, np.flatnonzero(np.diff(dest[order])) + 1):
            if len(mine):
                bytes_of = np.concatenate([content[ends[i] - size[i] : ends[i]] for i in mine.tolist()])
                rows.append((int(dest[mine[0]]), OPEN, squeeze(key[mine], place[mine].astype(np.uint32), count[mine].astype(np.uint8), size[mine].astype(np.uint32), bytes_of)))
        return rows

    def together(single: list[tuple]) -> tuple[tuple, list]:
        """Single windows, of equal ones the earliest alone; the others are repeats (or wait for the same document's first)."""
        dest, key, place, size, content = (np.concatenate(c) for c in zip(*single, strict=True))
        begin = np.cumsum(size) - size
        gone, rest = windows.settled(content, begin, size, flat.span_hashes(content, begin, begin + size), key, place)
        bytes_of = content[np.repeat(begin[rest] - np.cumsum(size[rest]) + size[rest], size[rest]) + np.arange(size[rest].sum())]
        return (dest[rest], key[rest], place[rest], size[rest], bytes_of), _marked(buckets, key[gone], place[gone], np.ones(len(gone), np.int64))

    def run(batches):
        single, held, limit = [], 0, MOST_SINGLE
        for texts, columns in _with_texts(batches, OPEN):
            if not columns:
                continue
            for part, data, at in flat.pieces(iter([texts]), PIECE_BYTES):
                ids = part.column(2).to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(columns[0], ids), np.searchsorted(columns[0], ids, "right")
                if (low == high).all():
                    continue
                symbols = windows.symbols(data, at)
                own = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                doc = np.repeat(np.arange(len(ids)), high - low)
                key, place, count, off = (c[own].astype(np.int64) for c in columns)
                begin = symbols.first[doc] + place
                dest = router.segments(symbols, begin + off)
                common = dest < 0
                whole = ~common & (dest % passes == turn)
                content, size = symbols.content(begin[whole], begin[whole] + count[whole] - 1 + windows.length)
                rows = blobs(dest[whole], key[whole], place[whole], count[whole], size, content)
                if common.any():  # one window at a time
                    key, place, count, off, begin = (x[common] for x in (key, place, count, off, begin))
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    key, place, begin, off = np.repeat(key, count), np.repeat(place, count) + step, np.repeat(begin, count) + step, np.repeat(off, count) - step
                    dest = router.windows(symbols, begin, off)
                    now = dest % passes == turn
                    dest, key, place, begin = (x[now] for x in (dest, key, place, begin))
                    content, size = symbols.content(begin, begin + windows.length)
                    single.append((dest, key, place, size, content))
                    held += len(key)
                if held > limit:
                    kept, gone = together(single)
                    single, held, rows = [kept], len(kept[0]), rows + gone
                    limit = max(MOST_SINGLE, 2 * held)
                    if held > 2 * MOST_SINGLE:
                        rows += blobs(kept[0], kept[1], kept[2], np.ones(held, np.int64), kept[3], kept[4])
                        single, held, limit = [], 0, MOST_SINGLE
                yield emit(rows)
        if single:
            kept, gone = together(single)
            yield emit(gone + blobs(kept[0], kept[1], kept[2], np.ones(len(kept[0]), np.int64), kept[3], kept[4]))

    return run


class Router:
    """Where suffixes go. Equal windows have equal anchors at equal places, and must go to one bucket."""

    def segments(self, symbols: Symbols, anchor: np.ndarray) -> np.ndarray:
        """The bucket of all windows with these anchors, or -1 if they go one by one."""
        raise NotImplementedError

    def windows(self, symbols: Symbols, begin: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The bucket of each window, from where it begins and how far its anchor lies behind."""
        raise NotImplementedError


def _compare(windows: Windows, buckets: int, equal: Callable):
    """Suffixes of one bucket to repeats."""

    def run(batches):
        blobs = []
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            blobs += [b for b, k in zip(batch.column(4).to_pylist(), kinds, strict=True) if k == OPEN]
            yield batch.filter(pa.array([k != OPEN for k in kinds]))
        if not blobs:
            return
        parts = [unsqueeze(b) for b in blobs]
        blobs.clear()
        key, place, count, size, content = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        place, count, size = (x.astype(np.int64) for x in (place, count, size))
        begin = np.cumsum(size) - size
        # Segments that are equal as a whole are compared once, and not for each of their windows.
        whole, rest = windows.settled(content, begin, size, flat.span_hashes(content, begin, begin + size), key, place)
        marks = [(key[whole], place[whole], count[whole])]
        key, place, count, begin, size = (x[rest] for x in (key, place, count, begin, size))
        content = content[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        symbols, begin = windows.exact(content, np.cumsum(size) - size)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(begin, count) + step
        key, place = np.repeat(key, count), np.repeat(place, count) + step
        left, group = equal(symbols, start)
        order = np.lexsort((place[left], key[left], group))
        left, group = left[order], group[order]
        gone = left[windows.later(group, key[left], place[left])]
        marks.append((key[gone], place[gone], np.ones(len(gone), np.int64)))
        yield emit(_marked(buckets, *(np.concatenate(c) for c in zip(*marks, strict=True))))

    return run


def _remove(windows: Windows, finish: Callable, names: list[str], kinds: list[pa.DataType]):
    """Texts and the runs of windows that repeat to the operator's result."""

    def run(batches):
        for texts, columns in _with_texts(batches, REPEAT):
            ids = texts.column(2).to_numpy(zero_copy_only=False)
            rows = []
            for i, text in zip(ids.tolist(), texts.column(3).to_pylist(), strict=True):
                low, high = (int(np.searchsorted(columns[0], i, s)) for s in ("left", "right")) if columns else (0, 0)
                begin = columns[1][low:high] if high > low else None
                rows.append(finish(text, begin, begin + columns[2][low:high] + windows.length - 1 if high > low else None))
            out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *out], names=["key", *names])

    return run


def covered(size: int, begin: np.ndarray | None, end: np.ndarray | None) -> np.ndarray:
    """Which of ``size`` symbols the spans cover."""
    edge = np.zeros(size + 1, np.int64)
    if begin is not None:
        np.add.at(edge, begin.astype(np.int64), 1)
        np.subtract.at(edge, end.astype(np.int64), 1)
    return np.cumsum(edge[:size]) > 0


def keyed(work: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame | None, int, int]:
    """(key, text) in the order of doc_id, what keys stand for (None: they are doc_ids), the number of buckets, and the bytes of all texts.

    A table that repeats doc_ids, or has null ones, is first written in the
    order of (doc_id, text) with a key of its own for each row, nulls last: its
    rows then count as different documents in that order.
    """
    rows = documents(docs)
    per_id = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    most, nulls, size = per_id.agg(F.max("n"), F.count_if(F.col("doc_id").isNull()), F.sum("size")).first()
    size = size or 0
    buckets = max(width(work.spark), -(-size // BUCKET_BYTES))
    if (most or 0) <= 1 and not nulls:
        return rows.select(F.col("doc_id").alias("key"), "text"), None, buckets, size
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    rows = work.keep(rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "keyed")
    return rows.select("key", "text"), rows.select("key", "doc_id"), buckets, size


def sample_of(met: DataFrame) -> list[bytes]:
    """Sampled windows: SAMPLES for each UNIT_BYTES of text, thinned by their hash to about MOST_SAMPLES."""
    rows = met.filter(F.col("kind") == SAMPLE)
    every = max(1, rows.count() // MOST_SAMPLES)
    return sorted(bytes(r["blob"]) for r in rows.filter(F.pmod(F.xxhash64("blob"), F.lit(every)) == 0).select("blob").collect())


def passes_of(met: DataFrame, size: int, buckets: int) -> int:
    """In how many passes open segments are fetched, so that each takes about PASS_SHARE times the bytes of the texts."""
    opened = met.filter(F.col("kind") == OPENED).agg(F.sum("key")).first()[0] or 0
    return max(1, min(buckets, math.ceil(opened / (PASS_SHARE * max(size, 1)))))


def remove_repeats(spark: SparkSession, docs: DataFrame, name: str, windows: Windows, sample_key: Callable, router: Callable, equal: Callable, finish: Callable, result: str) -> DataFrame:
    """One row for each row of docs: doc_id and what ``finish`` makes of its text and of the spans that repeat."""
    work = Workspace(spark, name)
    rows, names, buckets, size = keyed(work, docs)
    text_rows = rows.select(F.pmod("key", F.lit(buckets)).cast("int").alias("dest"), F.lit(TEXT).alias("kind"), "key", "text", F.lit(None).cast("binary").alias("blob"))
    to = lambda df: df.repartitionById(buckets, F.col("dest"))
    met = work.keep(to(rows.mapInArrow(_anchors(windows, buckets, sample_key), ROWS)).mapInArrow(_meet(windows, buckets), ROWS), "met", free=True)
    work.drop()
    marks, route = met.filter(F.col("kind") == REPEAT), router(sample_of(met), buckets)
    # An operator whose symbols are words has no count of bytes, and fetches in one pass.
    passes = 1 if windows.words else passes_of(met, size, buckets)
    for turn in range(passes):
        fetched = to(met.filter(F.col("kind") == OPEN).unionByName(text_rows)).sortWithinPartitions("kind").mapInArrow(_fetch(windows, buckets, route, turn, passes), ROWS)
        marks = marks.unionByName(work.keep(to(fetched).mapInArrow(_compare(windows, buckets, equal), ROWS), f"compared{turn}", free=True))
        del fetched
        work.drop()
    fields = [x.split() for x in result.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    last = to(marks.unionByName(text_rows)).sortWithinPartitions("kind")
    out = last.mapInArrow(_remove(windows, finish, [f for f, _ in fields], [types[t] for _, t in fields]), f"key long, {result}")
    if names is None:
        return out.withColumnRenamed("key", "doc_id")
    return names.join(out, "key").drop("key")
