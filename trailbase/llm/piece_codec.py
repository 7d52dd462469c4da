"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts becomes one flat array of symbols.  Each round finds, for
every word, the pair of neighbouring symbols of least rank (a segmented
minimum), merges its occurrences from the left, and closes the gaps, until no
word has a pair that the vocabulary can merge.  Words end before every space
that follows a non-space, as no piece has a space after another character; a
word met before is looked up and not merged again.

What the library does, and what is kept here: scores order the pairs, equal
scores go from left to right, and a merge may open a pair that comes before
what is left.  A round therefore merges all occurrences in a word only if none
of the pairs that this opens ranks as high; else it merges the leftmost alone.

A long word has too many ranks to take one in a round, so it is cut where no
piece holds both neighbours, and a round merges every pair that ranks least
within reach: no piece is longer than ``reach`` characters, so what lies
further off cannot take a symbol of the pair first.  That holds while each
merge ranks after those that made its parts; a stretch in which one doesn't is
merged pair by pair with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunk_cache import RunCache
from .workspace import documents

SPACE = "▁"
NEVER = np.int64(1 << 40)
#: Words of more characters are merged by what ranks least within reach; ids are the same either way.
LONG = 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message (its public wire format)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {5: 4, 1: 8}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Pieces, scores and kinds of a BPE model file without a normalisation map.

    Rejects a model whose rules this encoder doesn't follow: another kind of
    model, a character map, removal of extra spaces, no leading space, pieces
    that users defined or that are unused, or pieces with a space inside.
    """

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kinds = np.array(kinds)
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(3, 1) != 1 or normalizer.get(4, 1) != 0 or normalizer.get(5, 1) != 1:
            raise ValueError("not a BPE model with the identity normaliser, a leading space and all spaces kept")
        if np.isin(self.kinds, (USER_DEFINED, UNUSED)).any():
            raise ValueError("the model has user-defined or unused pieces")
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece has a space after another character")
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        self.bytes = np.array([next(i for i, p in enumerate(self.pieces) if kinds[i] == BYTE and p == f"<0x{b:02X}>") for b in range(256)])
        self.end = next(i for i, p in enumerate(self.pieces) if p == "</s>")
        order = sorted({scores[i] for i in self.ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        self.chars = {p: i for p, i in self.ids.items() if len(p) == 1}
        pairs = {}
        for piece, whole in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank_of[scores[whole]], whole)
        keys = sorted(pairs)
        self.reach = max(map(len, self.ids))
        self.neighbours = np.unique([(ord(p[i]) << 32) + ord(p[i + 1]) for p in self.ids for i in range(len(p) - 1)] or [-1])
        self.n = len(self.pieces)
        self.keys = np.array([a * self.n + b for a, b in keys] or [-1], np.int64)
        self.ranks = np.array([pairs[k][0] for k in keys] or [0], np.int64)
        self.wholes = np.array([pairs[k][1] for k in keys] or [0], np.int64)
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.is_byte = self.kinds == BYTE
        self.surface_size = np.array(list(map(len, self.surface)), np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (NEVER if they don't merge) and the merged pieces; negative symbols never merge."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NEVER), self.wholes[at]

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's ids end; spaces are U+2581 and none is added."""
        text = "".join(words)
        codes, place = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        first = np.cumsum([0, *map(len, words)])
        # A character without a piece is a symbol below zero: it never merges, and becomes bytes at the end.
        table = np.array([self.chars.get(chr(c), -1 - int(c)) for c in codes], np.int64)
        symbols, word = table[place], np.repeat(np.arange(len(words)), np.diff(first))
        done_s, done_w = [], []
        long = np.diff(first) > LONG
        if long.any():
            there = long[word]
            chars = codes[place[there]].astype(np.int64)
            near = (chars[:-1] << 32) + chars[1:]
            joined = self.neighbours[np.minimum(np.searchsorted(self.neighbours, near), len(self.neighbours) - 1)] == near
            part = np.cumsum(np.r_[True, ~joined | (word[there][1:] != word[there][:-1])]) - 1
            of = word[there][np.flatnonzero(np.r_[True, part[1:] != part[:-1]])]
            merged, part = self._merge_long(symbols[there], part)
            done_s.append(merged)
            done_w.append(of[part])
            symbols, word = symbols[~there], word[~there]
        while len(symbols):
            rank, whole = np.full(len(symbols), NEVER), np.zeros(len(symbols), np.int64)
            if len(symbols) > 1:
                rank[:-1], whole[:-1] = self.look_up(symbols[:-1], symbols[1:])
                rank[:-1][word[1:] != word[:-1]] = NEVER
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[heads, len(symbols)])
            least = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            over = least == NEVER
            if over.any():
                done_s.append(symbols[over])
                done_w.append(word[over])
                symbols, word, rank, whole, least = (x[~over] for x in (symbols, word, rank, whole, least))
                if not len(symbols):
                    break
            here = np.flatnonzero(rank == least)
            # Of overlapping pairs in a row, every other one from the left.
            run = np.cumsum(np.r_[True, np.diff(here) != 1]) - 1
            run_head = here[np.flatnonzero(np.r_[True, np.diff(run) != 0])]
            here = here[(here - run_head[run]) % 2 == 0]
            here = here[self._safe(symbols, word, here, whole, least)]
            keep = np.ones(len(symbols), bool)
            keep[here + 1] = False
            symbols[here] = whole[here]
            symbols, word = symbols[keep], word[keep]
        if not done_s:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbols, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        symbols, word = self._spell(symbols[order], word[order])
        return symbols, np.searchsorted(word, np.arange(len(words)), "right")

    def _merge_long(self, symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the symbols of each part merge to, in order, and the part of each result."""
        first, parts, symbols = symbols, part, symbols.copy()
        size, born = np.ones(len(symbols), np.int64), np.full(len(symbols), -1)
        bad = np.zeros(int(part[-1]) + 1, bool)
        rank, whole = np.full(len(symbols), NEVER), np.zeros(len(symbols), np.int64)
        rank[:-1], whole[:-1] = self.look_up(symbols[:-1], symbols[1:])
        rank[:-1][part[1:] != part[:-1]] = NEVER
        while True:
            here = self._least(rank, size)
            if not len(here):
                break
            new, order, owner, last = whole[here], rank[here], part[here], len(symbols) - 1
            after, before = np.minimum(here + 2, last), np.maximum(here - 1, 0)
            opened = np.minimum(
                np.where((here + 2 <= last) & (part[after] == owner), self.look_up(new, symbols[after])[0], NEVER),
                np.where((here >= 1) & (part[before] == owner), self.look_up(symbols[before], new)[0], NEVER),
            )
            opened = np.minimum(opened, np.where(np.r_[here[1:], -1] == here + 2, self.look_up(new, new)[0], NEVER))
            odd = (opened <= order) | (order <= np.maximum(born[here], born[here + 1]))
            symbols[here], born[here] = new, order
            size[here] += size[here + 1]
            keep = np.ones(len(symbols), bool)
            keep[here + 1] = False
            if odd.any():
                bad[owner[odd]] = True
                keep &= ~bad[part]
            place = np.cumsum(keep) - 1
            changed = place[here[keep[here]]]
            symbols, part, size, born, rank, whole = (x[keep] for x in (symbols, part, size, born, rank, whole))
            changed = np.unique(np.r_[changed, changed - 1])
            changed = changed[(changed >= 0) & (changed < len(symbols) - 1)]
            rank[changed], whole[changed] = self.look_up(symbols[changed], symbols[changed + 1])
            rank[changed[part[changed] != part[changed + 1]]] = NEVER
            if len(symbols):
                rank[-1] = NEVER
        if bad.any():
            again = np.flatnonzero(bad)
            low, high = np.searchsorted(parts, again), np.searchsorted(parts, again, "right")
            redone = [self._merge_one(first[a:b].tolist()) for a, b in zip(low, high, strict=True)]
            symbols = np.r_[symbols, np.fromiter(chain.from_iterable(redone), np.int64)]
            part = np.r_[part, np.repeat(again, list(map(len, redone)))]
            order = np.argsort(part, kind="stable")
            symbols, part = symbols[order], part[order]
        return symbols, part

    def _least(self, rank: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pairs that rank least of all pairs that a piece with one of their symbols could cover."""
        if len(rank) < 2:
            return np.zeros(0, np.int64)
        here = np.flatnonzero((rank != NEVER) & (rank <= np.r_[NEVER, rank[:-1]]) & (rank <= np.r_[rank[1:], NEVER]))
        end = np.cumsum(size)
        start, last = end - size, len(rank) - 1
        for step in range(2, self.reach):
            left, right = np.maximum(here - step, 0), np.minimum(here + step, last - 1)
            beaten = (rank[left] < rank[here]) & (start[left] >= end[here] - self.reach)
            beaten |= (rank[right] < rank[here]) & (end[right + 1] <= start[here + 1] + self.reach)
            here = here[~beaten]
        if not len(here):
            return here
        # Of overlapping pairs in a row every other one, if the row's first is here.
        run = np.cumsum(np.r_[True, np.diff(here) != 1]) - 1
        head = here[np.flatnonzero(np.r_[True, np.diff(run) != 0])]
        whole_run = (head == 0) | (rank[np.maximum(head - 1, 0)] != rank[head])
        return here[((here - head[run]) % 2 == 0) & whole_run[run]]

    def _merge_one(self, symbols: list[int]) -> list[int]:
        """The same by one pair after the other."""
        if not hasattr(self, "pairs"):
            self.pairs = {k: (r, w) for k, r, w in zip(self.keys.tolist(), self.ranks.tolist(), self.wholes.tolist(), strict=True)}
        n, pairs, end = self.n, self.pairs, len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap: list[tuple[int, int, int]] = []

        def meet(a: int, b: int) -> None:
            if a >= 0 and b < end and symbols[a] >= 0 and symbols[b] >= 0:
                found = pairs.get(symbols[a] * n + symbols[b])
                if found:
                    heapq.heappush(heap, (found[0], a, symbols[a] * n + symbols[b]))

        for i in range(end - 1):
            meet(i, i + 1)
        gone = bytearray(end)
        while heap:
            _, a, key = heapq.heappop(heap)
            b = after[a]
            if gone[a] or b == end or symbols[a] < 0 or symbols[b] < 0 or symbols[a] * n + symbols[b] != key:
                continue
            symbols[a], gone[b] = pairs[key][1], 1
            after[a] = after[b]
            if after[b] < end:
                before[after[b]] = a
            meet(before[a], a)
            meet(a, after[a])
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def _safe(self, symbols: np.ndarray, word: np.ndarray, here: np.ndarray, whole: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which of the merges may happen in this round."""
        owner = word[here]
        first = np.r_[True, owner[1:] != owner[:-1]]
        if first.all():
            return first
        new, rank = whole[here], least[here]
        last = len(symbols) - 1
        after, before, next_ = np.minimum(here + 2, last), np.maximum(here - 1, 0), np.r_[here[1:], -1]
        opened = np.minimum(
            np.where((here + 2 <= last) & (word[after] == owner), self.look_up(new, symbols[after])[0], NEVER),
            np.where((here >= 1) & (word[before] == owner), self.look_up(symbols[before], new)[0], NEVER),
        )
        opened = np.minimum(opened, np.where(next_ == here + 2, self.look_up(new, new)[0], NEVER))
        bad = np.unique(owner[opened <= rank])
        return first | ~np.isin(owner, bad)

    def _spell(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece as the ids of their UTF-8 bytes."""
        if not (symbols < 0).any():
            return symbols, word
        sizes = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(symbols < 0)
        spelled = [chr(-1 - int(s)).encode("utf-8", "surrogatepass") for s in symbols[odd]]
        sizes[odd] = list(map(len, spelled))
        out, at = np.repeat(symbols, sizes), np.cumsum(sizes) - sizes
        places = np.repeat(at[odd] - np.r_[0, np.cumsum(sizes[odd])[:-1]], sizes[odd]) + np.arange(sizes[odd].sum())
        out[places] = self.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.repeat(word, sizes)

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of many lists of ids, one after another in one array, by one gather of their pieces' bytes.

        Lists that begin with a control id, or whose bytes are no valid UTF-8,
        are decoded one by one.
        """
        size = self.surface_size[ids]
        total = np.cumsum(size)
        raw = self.surface_bytes[np.repeat(self.surface_at[ids] - total + size, size) + np.arange(size.sum())].tobytes()
        out, low, begin = [], 0, 0
        for high in ends.tolist():
            end = int(total[high - 1]) if high else 0
            text = raw[begin:end]
            try:
                text.decode()
                plain = high == low or self.kinds[ids[low]] != CONTROL
            except UnicodeDecodeError:
                plain = False
            if not plain:
                text = self.decode(ids[low:high]).encode("utf-8", "surrogatepass")
            elif high > low and not self.is_byte[ids[low]] and text[:1] == b" ":
                text = text[1:]
            out.append(text)
            low, begin = high, end
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: one leading space goes, byte pieces in a row are read as UTF-8, each bad byte as U+FFFD."""
        out, held, first = [], b"", True
        for i in ids.tolist():
            if self.is_byte[i]:
                held += self.surface[i]
                first = False
                continue
            if held:
                out.append(utf8(held))
                held = b""
            piece = self.surface[i].decode()
            if self.kinds[i] != CONTROL:
                out.append(piece[1:] if first and piece[:1] == " " else piece)
                first = False
        out.append(utf8(held))
        return "".join(out)


def utf8(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is not part of a valid character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class PieceCodec:
    """Encodes and decodes texts, with a table of the words met so far."""

    def __init__(self, path: str, end_id: bool = True):
        with open(path, "rb") as f:
            self.model = PieceModel(f.read())
        self.tail = [self.model.end] if end_id else []
        self.cache = RunCache(self._ids)
        self.shown = RunCache(self._show)
        self.names = list(map(str, range(self.model.n)))

    def _show(self, new: list[str]) -> list[tuple[str, list[int]]]:
        """For each word its ids in decimal, and the ids."""
        flat, ends = self._encode(new)
        name = self.names
        return [(" ".join([name[i] for i in flat[a:b]]), flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def words(text: str) -> list[str]:
        """A text's words, each without the one space before it (the first has the leading space that encoding adds)."""
        if not text:
            return []
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for part in parts:
            if part:
                out.append(" " * spaces + part)
                spaces = 0
            else:
                spaces += 1
        return [*out, " " * (spaces - 1)] if spaces else out

    def _encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        flat, ends = self.model.encode_flat([SPACE + w.replace(" ", SPACE) for w in words])
        return flat.tolist(), ends.tolist()

    def _ids(self, new: list[str]) -> list[list[int]]:
        flat, ends = self._encode(new)
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        known = self.cache.values([words])
        return [i for w in words for i in known[w]] + self.tail

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(t) for t in texts]
        known = self.cache.values(split)
        return [[i for w in s for i in known[w]] + self.tail for s in split]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(np.array(ids, np.int64))

    def digests(self, batch: list[str]) -> tuple[list[int], list[str], list[str]]:
        """For each text the number of its ids, and digests of its ids and of what these decode to."""
        split = [self.words(t) for t in batch]
        known = self.shown.values(split)
        tail = list(map(str, self.tail))
        counts, digests, every = [], [], []
        for words in split:
            shown, ids = zip(*[known[w] for w in words], strict=True) if words else ((), ())
            counts.append(sum(map(len, ids)) + len(tail))
            digests.append(hashlib.sha256(" ".join([*shown, *tail]).encode()).hexdigest())
            every += [*ids, self.tail]
        decoded = self.model.decode_flat(np.fromiter(chain.from_iterable(every), np.int64), np.cumsum(counts))
        return counts, digests, [hashlib.sha256(t).hexdigest() for t in decoded]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each model and worker process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array<int>, with the end id) of whole texts.

    Null and empty texts have the end id alone.  Rows with a null doc_id and
    repeated rows are encoded like any other; further columns are left out.
    """

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                yield pa.record_batch([part.column(0), pa.array(codec(model_path).encode_batch(part.column(1).to_pylist()), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of the rows of ``encode_documents``; null ids decode to the empty text."""

    def run(batches):
        for batch in batches:
            texts = [codec(model_path).decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of whole texts, one row for each row of docs.

    One pass and no exchange.  Null and empty texts: one id (the end), and the
    digest of the empty text.  Null doc_ids stay null; repeated rows are
    repeated in the result; an empty table gives an empty one.  A very long text
    is encoded whole, in memory and time that grow with it, with or without spaces; the table of words met is
    bounded by their number and their characters.
    """

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                counts, ids, decoded = codec(model_path).digests(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
