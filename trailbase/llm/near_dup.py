"""Near-duplicate groups: MinHash bands for candidates, odd sketches to check them, whole sets to confirm.

1. Each text becomes its set of distinct word shingles, PERMUTATIONS MinHash
   values, BANDS band keys, and an odd sketch: a bitmap in which every
   (permutation, value) flips one bit.  The bits in which two sketches differ
   are the parity of what the two samples don't share, so their number tells
   high similarities apart much more finely than the count of equal samples
   of so few bytes would.
2. Rows of the same words in the same order are one class, told by a 256-bit
   digest of them, and only its least doc_id goes on.
3. Within a band key every class is compared with the key's least class alone:
   as many pairs as rows, however large the group.
4. Groups are the connected components of the pairs that hold on whole sets.
5. A key whose classes fell into several components is looked at once more.
   One of at most SPLIT rows is a tile: its classes of different components are
   compared inside one task, sketch against sketch, and no pair leaves it.
6. A larger one is split first.  Its rows are given the whole sets' shingles in
   one order, rarest first.  Two sets of the similarity miss at most a fifth of
   each other, so the first shingle that they share lies in the first fifth of
   both (and one more): rows meet again by those leading shingles alone, of
   which those that no other row has are left out.  A row with more such
   shingles than the fifth links with nothing and is done.  No link is lost.
   The rows of one such shingle are a tile again, or several if more than TILE.
7. Whole texts go to the tiles whose sketches left something open, once for each
   row and not for each pair, and the links that hold there join components.
   A link within one component can't change it, so no link that shares a key
   with its partner is lost.

Shingles are hashed to find candidates; every link is confirmed on the words
themselves.

A pair of similarity 0.8 shares no band key with probability (1 - 0.8**5)**32 =
3e-6.  A sketch rules out a pair of that similarity with a probability below
1e-7 (see ``most_differing``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .components import connected_components
from .workspace import Workspace, documents, ids_are_unique, width

ROWS, BANDS, SKETCH_BITS, SPLIT, TILE = 5, 32, 512, 64, 1024
#: So many of a row's earlier keys are looked at to leave a pair to the first key that it shares; beyond them it is only looked at again.
EARLIER = 32
PERMUTATIONS = ROWS * BANDS
_A = (flat.mix(np.arange(1, PERMUTATIONS + 1, dtype=flat.U64) * flat.U64(0x2545F4914F6CDD1D)) >> flat.U64(32)).astype(np.uint32) | np.uint32(1)
_B = (flat.mix(np.arange(1, PERMUTATIONS + 1, dtype=flat.U64) * flat.U64(0x9FB21C651E98DF25)) >> flat.U64(32)).astype(np.uint32)


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's distinct k-word shingles as sorted 64-bit hashes, A-Z lower-cased; fewer words are one shingle."""
    data = flat.lower_ascii(data)
    starts, ends, first = flat.words(data, at)
    word = flat.SpanHash(flat.BYTE_VALUE[data])(starts, ends)
    spans = flat.SpanHash(word)
    n = np.diff(first)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), size)
    low = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + first[doc]
    key = spans(low, np.minimum(low + k, first[doc + 1]))
    return [np.unique(x) for x in np.split(key, np.cumsum(size)[:-1])] if len(n) else []


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """PERMUTATIONS least values for each set; none may be empty."""
    values = (np.concatenate(sets) >> flat.U64(32)).astype(np.uint32)
    heads = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((PERMUTATIONS, len(sets)), np.uint32)
    for i in range(PERMUTATIONS):
        out[i] = np.minimum.reduceat(values * _A[i] + _B[i], heads)
    return out.T


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity of how often each of SKETCH_BITS bits is hit by the (permutation, value) pairs of a row, as int64 words."""
    bit = flat.mix(samples.astype(flat.U64) + np.arange(PERMUTATIONS, dtype=flat.U64) * flat.U64(1 << 32)) % flat.U64(SKETCH_BITS)
    place = bit.astype(np.int64) + np.arange(len(samples))[:, None] * SKETCH_BITS
    parity = np.bincount(place.ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(samples), -1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(BANDS, dtype=flat.U64), (len(samples), 1))
    for r in range(ROWS):
        key = flat.mix(key * flat.U64(0x9E3779B97F4A7C15) + samples[:, r::ROWS].astype(flat.U64))
    return key.view(np.int64)


def most_differing(similarity: float, lost: float = 1e-7) -> int:
    """The most bits in which sketches of two sets of at least this similarity differ, but for a share ``lost`` of such pairs.

    Of the samples Binomial(PERMUTATIONS, 1 - similarity) differ, and each of
    these flips two bits at random.  The distribution of the number of odd bits
    is carried along flip by flip, so the limit is exact and not a bound.
    """
    p, n = 1 - similarity, SKETCH_BITS
    at = np.arange(n + 1)
    odd, total = np.zeros(n + 1), np.zeros(n + 1)
    odd[0] = 1.0
    for differing in range(PERMUTATIONS + 1):
        total += math.comb(PERMUTATIONS, differing) * p**differing * similarity ** (PERMUTATIONS - differing) * odd
        for _ in range(2):
            odd = np.r_[0.0, (odd * (n - at) / n)[:-1]] + np.r_[(odd * at / n)[1:], 0.0]
    beyond = 1 - np.cumsum(total)
    return int(np.flatnonzero(beyond <= lost)[0])


def word_set(text: str, k: int) -> set:
    """The distinct k-word shingles themselves, A-Z lower-cased; fewer words are one shingle."""
    words = text.encode().lower().split()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def word_key(text: bytes) -> bytes:
    """A digest of all words in their order, A-Z lower-cased."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=32).digest()


_SIGNED = "n_shingles long, set_key binary, sketch array<long>, bands array<long>"


def sign(docs: DataFrame, k: int) -> DataFrame:
    """Rows of docs without their text, with the size, a 256-bit key of their words, the odd sketch and the band keys of their shingle sets."""

    def run(batches):
        for part, data, at in flat.pieces(batches):
            sets = shingles(data, at, k)
            some = [i for i, s in enumerate(sets) if len(s)]
            sketch, bands = [None] * len(sets), [None] * len(sets)
            if some:
                samples = minhash([sets[i] for i in some])
                for i, s, b in zip(some, odd_sketch(samples).tolist(), band_keys(samples).tolist(), strict=True):
                    sketch[i], bands[i] = s, b
            raw = data.tobytes()
            keys = [word_key(raw[at[i] : at[i + 1]]) if len(s) else None for i, s in enumerate(sets)]
            columns = [c for c, f in zip(part.columns, part.schema.names, strict=True) if f != "text"]
            names = [f for f in part.schema.names if f != "text"]
            words = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array(sketch, words), pa.array(bands, words)], names=[*names, "n_shingles", "set_key", "sketch", "bands"])

    return docs.mapInArrow(run, T.StructType([*docs.drop("text").schema.fields, *T.StructType.fromDDL(_SIGNED).fields]))


def _confirm_pairs(batches: Iterator[pa.RecordBatch], k: int, percent: int):
    """Of pairs with both texts, sorted by the first, those that hold on the sets of words."""
    last, held = None, set()
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for text, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if text != last:
                last, held = text, word_set(text, k)
            own = word_set(other, k)
            both = len(held & own)
            keep.append(100 * both >= percent * (len(held) + len(own) - both))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, h in zip(a, keep, strict=True) if h], pa.int64()), pa.array([x for x, h in zip(b, keep, strict=True) if h], pa.int64())], names=["a", "b"])


class _Search:
    """The steps that find links; classes are named by the row number of their least row."""

    def __init__(self, work: Workspace, docs: DataFrame, k: int, percent: int, repeated: bool):
        self.work, self.docs, self.k, self.percent, self.repeated = work, docs, k, percent, repeated
        self.most = most_differing(percent / 100)

    def sketched(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) that neither sizes nor sketches rule out."""
        side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
        differing = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        near = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
        return near.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")).filter(differing <= self.most).select("a", "b")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """Whole texts (id, text) of the wanted ids alone."""
        rows = self.docs.select(F.col("row_").alias("id"), "text").join(wanted.hint("merge"), "id", "left_semi")
        return rows.dropDuplicates(["id", "text"]) if self.repeated else rows

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose whole sets have the similarity."""
        k, percent = self.k, self.percent
        pairs = self.work.keep(pairs, f"{name}-candidates")
        texts = self.work.keep(self.texts(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), f"{name}-texts")
        side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
        both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").select("a", "b", "t_a", "t_b")
        held = self.work.keep(both.mapInArrow(lambda batches: _confirm_pairs(batches, k, percent), "a long, b long"), f"{name}-links")
        self.work.drop(f"{name}-candidates", f"{name}-texts")
        return held

    def stars(self, keyed: DataFrame) -> DataFrame:
        """Each class beside the least class of each of its band keys."""
        # Written before the join, as a join right above an aggregate can't split a hot key.
        least = self.work.keep(keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"), "least")
        return keyed.join(least.hint("merge"), "key").filter("id != a").select("a", F.col("id").alias("b")).distinct()

    def leading(self, rows: DataFrame, name: str) -> DataFrame:
        """The keys (key, id, component, before) by which rows meet that may hold the similarity: shingles, rarest first.

        Every text of a row has a number of its own, as an id may stand for
        several.  At most a fifth (100 - percent) of a row's shingles can be
        missing in a partner; those that no other row has always are.
        """
        k, percent = self.k, self.percent

        def run(batches):
            for part, data, at in flat.pieces(batches):
                sets = [s.view(np.int64) for s in shingles(data, at, k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "tokens"])

        sets = self.texts(rows.select("id")).select("id", "text").mapInArrow(run, "id long, tokens array<long>")
        sets = self.work.keep(sets.withColumn("row", F.monotonically_increasing_id()), f"{name}-tokens")
        spread = lambda rows: rows.select("row", F.explode("tokens").alias("token"))
        counts = self.work.keep(spread(sets).groupBy("token").agg(F.count("*").alias("n"), F.min("row").alias("row")), f"{name}-tokens-n")
        # A shingle met once names its row, so rows with too many of their own are done before anything is joined by shingle.
        own = counts.filter("n = 1").groupBy("row").agg(F.count("*").alias("n_own"))
        spare = F.size("tokens") - F.floor((F.size("tokens") * percent + 99) / 100) - F.coalesce("n_own", F.lit(0))
        left = self.work.keep(sets.join(own.hint("merge"), "row", "left").withColumn("spare", spare.cast("int")).drop("n_own").filter("spare >= 0"), f"{name}-spare")
        met = spread(left).join(counts.filter("n > 1").select("token", "n").hint("merge"), "token").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("met"))
        lead = met.join(left.select("row", "id", "spare").hint("merge"), "row")
        lead = lead.select("id", F.expr("slice(met.token, 1, spare + 1)").alias("lead")).join(rows.hint("merge"), "id")
        short = F.transform("lead", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
        keyed = lead.select("id", "component", short.alias("short"), F.posexplode("lead").alias("at", "key"))
        return keyed.select("key", "id", "component", F.slice("short", F.lit(1), F.least("at", F.lit(EARLIER))).alias("before"))

    def opened(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows (key, id, component, ...) of the keys with several components, with the number of rows in the key's main component and in others."""
        # Of a key, the component of its least class is the main one; the rows of others are few in a large group.
        main = F.min(F.struct("id", "component")).alias("least")
        keys = rows.groupBy("key").agg(main, F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
        keys = self.work.keep(keys.select("key", F.col("least.component").alias("main"), F.col("least.id").alias("least_id")), f"{name}-keys")
        rows = self.work.keep(rows.join(keys.hint("merge"), "key").withColumn("in_main", F.col("component") == F.col("main")).drop("main"), f"{name}-open")
        sizes = self.work.keep(rows.groupBy("key").agg(F.count_if("in_main").alias("n_main"), F.count_if(~F.col("in_main")).alias("n_other")), f"{name}-sizes")
        self.work.drop(f"{name}-keys")
        return rows.join(sizes.hint("merge"), "key")

    def across(self, classes: DataFrame, components: DataFrame, name: str) -> DataFrame:
        """Links between classes that share a key but no component, one at least for each two components of a tile that have any."""
        labelled = classes.join(components.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        rows = self.opened(labelled.select(F.posexplode("bands").alias("band", "key"), "id", "component"), f"{name}-band")
        # A band key's least class was compared with all others already.
        rows = rows.withColumn("done", F.col("id") == F.col("least_id")).withColumn("before", F.lit(None).cast("array<int>"))
        large = F.col("n_main") + F.col("n_other") > SPLIT
        hot = self.work.keep(rows.filter(large).select("id", "component").distinct(), f"{name}-hot")
        columns = ["key", "id", "component", "in_main", "done", "band", "before", "n_main", "n_other"]
        tiles = rows.filter(~large).select(columns)
        if not hot.isEmpty():
            lists = self.opened(self.work.keep(self.leading(hot, name), f"{name}-lists"), f"{name}-lead")
            tiles = tiles.union(lists.withColumn("done", F.lit(False)).withColumn("band", F.lit(0)).select(columns))
        links = self.work.keep(self.tiles(tiles, classes, name), f"{name}-links")
        self.work.drop(*(f"{name}-{x}" for x in ("band-open", "band-sizes", "hot", "tokens", "tokens-n", "spare", "lists", "lead-open", "lead-sizes", "tiles")))
        return links

    def tiles(self, rows: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """Links found in tiles of at most about TILE by TILE rows."""
        parts = lambda x: F.ceil(F.col(x) / TILE).cast("int")
        rows = rows.withColumn("mains", parts("n_main")).withColumn("others", parts("n_other"))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
        # A tile (x, y) holds part x of the others against part y: of the main component if y < mains, else part y - mains >= x of the others.
        tile = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
        upto = lambda n: F.sequence(F.lit(0), n - 1)
        as_main = F.transform(upto(F.col("others")), lambda x: tile(x, F.col("part")))
        as_first = F.transform(F.filter(upto(F.col("mains") + F.col("others")), lambda y: (y < F.col("mains")) | (y - F.col("mains") >= F.col("part"))), lambda y: tile(F.col("part"), y))
        as_second = F.transform(F.filter(upto(F.col("others")), lambda x: x < F.col("part")), lambda x: tile(x, F.col("mains") + F.col("part")))
        rows = rows.withColumn("tile", F.explode(F.when(F.col("in_main"), as_main).otherwise(F.concat(as_first, as_second))))
        # Band keys by 31 bits: enough to tell whether two rows share an earlier one.
        details = classes.select("id", "n_shingles", "sketch", F.transform("bands", lambda b: b.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands"))
        rows = rows.join(details.hint("merge"), "id").withColumn("before", F.coalesce("before", F.slice("bands", F.lit(1), F.col("band"))))
        rows = rows.select(F.xxhash64("key", "tile.x", "tile.y").alias("tile"), "id", (F.col("tile.y") < F.col("mains")).alias("mixed"), "in_main", "done", "component", "n_shingles", "sketch", "before")
        n, most, percent, k = width(self.work.spark), self.most, self.percent, self.k
        by_tile = lambda df: df.repartition(n, "tile").sortWithinPartitions("tile", F.col("id").asc_nulls_first())
        left = self.work.keep(by_tile(rows).mapInArrow(lambda batches: by_key(batches, lambda t: _sketch_tile(t, most, percent)), "tile long, id long, component long, pairs binary"), f"{name}-tiles")
        rows_left = left.filter("id is not null")
        met = rows_left.select("tile", "id", "component").join(self.texts(rows_left.select("id").distinct()).hint("merge"), "id").select("tile", "id", "component", "text", F.lit(None).cast("binary").alias("pairs"))
        lists = left.filter("id is null").select("tile", "id", "component", F.lit(None).cast("string").alias("text"), "pairs")
        links = by_tile(met.unionByName(lists)).mapInArrow(lambda batches: by_key(batches, lambda t: _confirm_tile(t, k, percent)), "a long, b long")
        return links.distinct()


def by_key(batches, one: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """What ``one`` makes of the rows of each value of the first column; batches come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        if held and held[-1].column(0)[0].as_py() != key[0]:
            yield from one(pa.Table.from_batches(held))
            held = []
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if held and low:
                yield from one(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield from one(pa.Table.from_batches(held))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _sketch_tile(table: pa.Table, most: int, percent: int):
    """Rows of one tile with a partner of another component that sizes and sketches allow, and the list of those pairs."""
    ids, component, n, main, done = (_numbers(table, c) for c in ("id", "component", "n_shingles", "in_main", "done"))
    mixed, before = table.column("mixed")[0].as_py(), [x.values.to_numpy() for x in table.column("before")]
    who, earlier = np.repeat(np.arange(len(ids)), list(map(len, before))), np.concatenate(before)
    order = np.argsort(earlier, kind="stable")
    who, earlier = who[order], earlier[order]
    sketch = _matrix(table, "sketch").view(flat.U64)
    found_i, found_j = [], []
    for i in np.flatnonzero(~done[:-1]).tolist():
        j = np.arange(i + 1, len(ids))
        ok = (component[j] != component[i]) & ~done[j] & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))
        j = j[ok & (main[j] != main[i])] if mixed else j[ok]
        if len(j):
            j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64) <= most]
        if len(j) and len(before[i]):  # a pair is this tile's if no earlier key has it
            met = np.zeros(len(ids), bool)
            for low, high in zip(np.searchsorted(earlier, before[i]).tolist(), np.searchsorted(earlier, before[i], "right").tolist(), strict=True):
                met[who[low:high]] = True
            j = j[~met[j]]
        if len(j):
            found_i.append(np.full(len(j), i))
            found_j.append(j)
    if found_i:
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        rows, place = np.unique(np.r_[ids[i], ids[j]], return_inverse=True)
        pairs = zstandard.ZstdCompressor(level=1).compress(place.astype(np.uint16).reshape(2, -1).tobytes())
        of = dict(zip(ids.tolist(), component.tolist(), strict=True))
        tile, size = table.column("tile")[0].as_py(), len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([tile] * (size + 1)), pa.array([*rows.tolist(), None], pa.int64()), pa.array([*(of[x] for x in rows.tolist()), None], pa.int64()), pa.array([*[None] * size, pairs], pa.binary())], names=["tile", "id", "component", "pairs"])


def _confirm_tile(table: pa.Table, k: int, percent: int):
    """Of one tile's pairs, links on whole sets of words; of those that join the same two components, one."""
    listed = table.filter(pa.compute.is_valid(table.column("pairs")))
    rows = table.filter(pa.compute.is_valid(table.column("id")))
    place = np.frombuffer(zstandard.ZstdDecompressor().decompress(listed.column("pairs")[0].as_py()), np.uint16).reshape(2, -1)
    number: dict[tuple, int] = {}
    members = [np.array([number.setdefault(s, len(number)) for s in word_set(t.as_py(), k)], np.int64) for t in rows.column("text")]
    # An id that stands for several texts has a set for each.
    ids = _numbers(rows, "id")
    own, first = np.unique(ids, return_index=True)
    bounds = [*first.tolist(), len(ids)]
    component = _numbers(rows, "component")[first]
    shared, size = overlap_counter(members), np.array(list(map(len, members)))
    seen, out = set(), []
    for i, j in zip(*place.astype(np.int64).tolist(), strict=True):
        two = (int(min(component[i], component[j])), int(max(component[i], component[j])))
        if two in seen:
            continue
        for x in range(bounds[i], bounds[i + 1]):
            for y in range(bounds[j], bounds[j + 1]):
                both = shared(x, y)
                if two not in seen and 100 * both >= percent * (int(size[x]) + int(size[y]) - both):
                    seen.add(two)
                    out.append((int(own[i]), int(own[j])))
    if out:
        a, b = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def overlap_counter(members: list[np.ndarray], most_bytes: int = 64 << 20) -> Callable[[int, int], int]:
    """How many members two sets share: by bitmaps over the members of all, or by merging where those would be too large; both count the same."""
    every, place = np.unique(np.concatenate(members), return_inverse=True)
    words = -(-len(every) // 64)
    if 8 * words * len(members) > most_bytes:
        return lambda x, y: len(np.intersect1d(members[x], members[y], assume_unique=True))
    row = np.repeat(np.arange(len(members)), list(map(len, members)))
    bits = np.zeros((len(members), words * 8), np.uint8)
    np.bitwise_or.at(bits, (row, place >> 3), (1 << (place & 7)).astype(np.uint8))
    wide = bits.view(flat.U64)
    return lambda x, y: int(np.bitwise_count(wide[x] & wide[y]).sum())


def components(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, *more: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, and the further columns named.

    Two rows are linked if 100 * intersection >= percent * union of their
    shingle sets; component_id is the least doc_id that links reach.  Rows
    without words (null and empty texts too) and rows with a null doc_id are
    linked with nothing: component_id is their own doc_id, and they are kept.
    Rows that repeat a doc_id count each: they link by their texts.  An empty
    table gives an empty result; further columns of any name do no harm.
    """
    work = Workspace(spark, "near")
    extra = F.struct(*[F.col(c) for c in more]).alias("more_") if more else F.lit(None).cast("boolean").alias("more_")
    rows = documents(docs, extra)
    signed = work.keep(sign(rows, k), "signed")
    linkable = signed.filter("doc_id is not null and n_shingles > 0")
    # The least doc_id stands for its class; ids in pairs are doc_ids, and a repeated doc_id brings the sets of its first row in byte order of keys.
    classes = work.keep(linkable.groupBy("set_key").agg(F.min("doc_id").alias("id")), "keys")
    one = linkable.join(classes.hint("merge"), "set_key").filter("doc_id = id").groupBy("id", "set_key").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    one = work.keep(one, "classes")
    repeated = not linkable.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    search = _Search(work, rows.select(F.col("doc_id").alias("row_"), "text"), k, percent, repeated)
    keyed = one.select(F.explode("bands").alias("key"), "id")
    links = search.confirmed(search.sketched(search.stars(keyed), one), "star")
    found = work.keep(connected_components(work, links, "first"), "found")
    more_links = search.across(one, found, "across")
    found = work.keep(connected_components(work, found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more_links), "second"), "all")
    work.drop("keys", "least", "star-links", "across-links", "found")
    named = one.select("id", "set_key").join(found.hint("merge"), "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    out = signed.withColumn("key_", F.expr("if(doc_id is null, null, set_key)")).join(named.hint("merge"), F.col("key_") == named["set_key"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *[F.col("more_")[c].alias(c) for c in more])


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group those with the least doc_id.

    Where no doc_id repeats, an anti join on doc_id leaves the others out; else
    rows carry all their columns along.
    """
    if ids_are_unique(docs):
        gone = components(spark, docs, k, percent).filter("not kept").select("doc_id")
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    row = docs.withColumn("row_", F.struct(*[F.col(c) for c in docs.columns])).select("doc_id", "text", "row_")
    return components(spark, row, k, percent, "row_").filter("kept").select("row_.*")
