"""Conversation prefix tries by distributed MSD radix partitioning.

Turns are dictionary-encoded: equal (role, text) get one number, and from then
on numbers travel, not texts.  Equal conversations become one sequence with a
count.  All sequences start as one bucket, whose digit stands for the root.  A
bucket that is small ends in one task: multikey quicksort splits it turn by
turn, and each "equal" part is a node.  A large one is a chain of nodes (the
turns that all its sequences share, which the least and the greatest sequence
tell) and is split again by the next turn into buckets of their own.  So a
level of recursion costs a job where many conversations part, not for each
turn that they share, and only large buckets reach it.

What a node needs from below (leaves, bytes) comes as one row for each bucket,
summed for each large bucket above it on the map side first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import BATCH, Workspace, width

#: Buckets of so many turns at most end in one task. Larger ones are split further; the result is the same.
LOCAL = 1024
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT_TURN = -1
#: Numbers of buckets are unlike on all levels while an exchange has fewer than 2**17 partitions.
LEVEL_BITS = 50
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encode(work: Workspace, conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (id, bytes) in the order of turns, of each conversation with an id.

    The dictionary tells (role, text) by their SHA-256, the role's length
    before both so that no two pairs look alike.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).alias("bytes"))
    turns = work.keep(turns, "turns")
    words = work.keep(turns.groupBy("digest").agg(F.count("*").alias("n")).select("digest", F.monotonically_increasing_id().alias("id")), "dictionary")
    coded = turns.join(words.hint("merge"), "digest")
    # Fields of a struct sort nulls first; equal turn numbers go by the digest, so that the order does not hang on the dictionary.
    own = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "bytes"))).alias("turns"))
    own = work.keep(own.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("turns")), "encoded")
    work.drop("turns", "dictionary")
    return own


def rebuilt(encoded: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that begin as the first of their family does: its first h turns, then what follows the own first h; h = crc32(conv_id) % heads."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    first = encoded.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first_"), F.slice("turns", 1, heads).alias("head"))
    both = encoded.withColumns({"first_": F.col("conv_id") - F.col("conv_id") % family, "h": h}).join(first, "first_", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (seq, conv_id) in order: seq, the first conv_id and all of them joined, for each run of a batch."""
    for batch in batches:
        seqs, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
        cuts = [i for i in range(len(seqs)) if i == 0 or seqs[i] != seqs[i - 1]] + [len(seqs)]
        runs = list(zip(cuts, cuts[1:], strict=False))
        yield pa.record_batch([pa.array([seqs[a] for a, _ in runs], pa.binary()), pa.array([ids[a] for a, _ in runs], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in runs], pa.string()), pa.array([b - a for a, b in runs], pa.int64())], ["seq", "first", "ids", "n"])


def id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (seq, first, ids, n) in order: seq, its least conv_id, number and the digest of all ids; one text at a time goes into the digest."""
    seq, least, count, digest = None, 0, 0, None
    for batch in batches:
        out = []
        for own, first, ids, n in zip(*(batch.column(c).to_pylist() for c in ("seq", "first", "ids", "n")), strict=True):
            if own != seq:
                if seq is not None:
                    out.append((seq, least, count, digest.hexdigest()))
                seq, least, count, digest = own, first, 0, hashlib.sha256()
            elif count:
                digest.update(b",")
            digest.update(ids.encode())
            count += n
        yield _digests(out)
    if seq is not None:
        yield _digests([(seq, least, count, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["seq", "rep", "n", "ends"])


def sequences(work: Workspace, convs: DataFrame) -> DataFrame:
    """Distinct sequences: rep (the least conv_id), n, ends (digest of all conv_ids), ids and bytes, both with a turn for the root in front.

    Conv_ids are ordered by a range partitioning of (sequence, conv_id), so that
    copies of one conversation are joined in many tasks; the digest of a
    sequence then takes their texts one after the other, as SHA-256 must.
    """
    spark = work.spark
    ids, sizes = F.transform("turns", lambda t: t["id"]), F.transform("turns", lambda t: t["bytes"])
    seq = F.unhex(F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), 256))
    rows = work.keep(convs.select("conv_id", seq.alias("seq"), F.concat(F.array(F.lit(ROOT_TURN).cast("long")), ids).alias("ids"), F.concat(F.array(F.lit(0)), sizes).alias("bytes")), "rows")
    ranged = rows.select("seq", "conv_id").repartitionByRange(width(spark), "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    texts = work.keep(ranged.mapInArrow(id_texts, "seq binary, first long, ids string, n long"), "texts")
    ends = texts.repartition(width(spark), "seq").sortWithinPartitions("seq", "first").mapInArrow(id_digests, "seq binary, rep long, n long, ends string")
    distinct = rows.groupBy("seq", "ids", "bytes").agg(F.count("*").alias("again")).select("seq", "ids", "bytes")
    out = work.keep(distinct.join(ends, "seq").select("rep", "n", "ends", "ids", "bytes"), "sequences")
    work.drop("rows", "texts")
    return out


class Grower:
    """Nodes of small buckets, all buckets of a batch one after the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, rep: np.ndarray, n: np.ndarray, ends: list[str]):
        self.ids, self.sizes, self.start, self.length, self.rep, self.n, self.all_ends = ids, sizes, at[:-1], np.diff(at), rep, n, ends
        self.conv, self.depth, self.up, self.members, self.children, self.own, self.ended = [], [], [], [], [], [], []

    def node(self, rows: np.ndarray, level: int, up: int, depth: int) -> int:
        """A node whose sequences share ``level`` turns; the last of them is its own."""
        n = int(self.n[rows].sum())
        self.conv.append(int(self.rep[rows].min()))
        self.depth.append(depth + level - 1)
        self.up.append(up)
        self.members.append(n)
        self.children.append(0)
        self.own.append((n - 1) * int(self.sizes[self.start[rows[0]] + level - 1]))
        self.ended.append(EMPTY)
        if up >= 0:
            self.children[up] += 1
        return len(self.conv) - 1

    def chain(self, row: int, level: int, up: int, depth: int) -> None:
        """The nodes of a sequence that is alone from ``level`` shared turns on."""
        left, n, base = int(self.length[row]) - level, int(self.n[row]), len(self.conv)
        if left:
            self.children[up] += 1
            first = int(self.start[row]) + level
            self.conv += [int(self.rep[row])] * left
            self.depth += range(depth + level, depth + level + left)
            self.up += [up, *range(base, base + left - 1)]
            self.members += [n] * left
            self.children += [1] * (left - 1) + [0]
            self.own += ((n - 1) * self.sizes[first : first + left].astype(np.int64)).tolist()
            self.ended += [EMPTY] * left
        self.ended[-1 if left else up] = self.all_ends[row]

    def bucket(self, rows: np.ndarray, depth: int) -> int:
        """Multikey quicksort of one bucket, whose sequences share the first turn; the number of its top node."""
        top = self.node(rows, 1, -1, depth)
        open_parts = [(rows, 1, top, True)]
        while open_parts:
            part, level, up, fresh = open_parts.pop()
            if fresh:  # the part is all that lies below the node ``up``
                lengths = self.length[part]
                if len(part) == 1:
                    self.chain(int(part[0]), level, up, depth)
                    continue
                for row in part[lengths == level]:
                    self.ended[up] = self.all_ends[row]
                part = part[lengths > level]
            if not len(part):
                continue
            turn = self.ids[self.start[part] + level]
            pivot = np.sort(turn[[0, len(turn) // 2, -1]])[1]
            same = part[turn == pivot]
            if len(same) == 1:
                self.chain(int(same[0]), level, up, depth)
            else:
                open_parts.append((same, level + 1, self.node(same, level + 1, up, depth), True))
            if len(same) < len(part):
                open_parts += [(part[turn < pivot], level, up, False), (part[turn > pivot], level, up, False)]
        return top

    def sums(self) -> tuple[list[int], list[int]]:
        """Leaves and saved bytes of each node's subtree; nodes come after those above them."""
        leaves, saved = [int(not c) for c in self.children], list(self.own)
        for i in range(len(leaves) - 1, -1, -1):
            if (up := self.up[i]) >= 0:
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        return leaves, saved


def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the buckets in the rows (bucket, depth, up_conv, path, rep, n, ends, ids, bytes), which come bucket by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = batch.column("bucket").to_numpy()
        cut = int(np.searchsorted(buckets, buckets[-1]))
        if cut:
            yield _nodes(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
        if not cut and len(held) > 1 and held[0].column("bucket")[0].as_py() != buckets[-1]:
            yield _nodes(pa.Table.from_batches(held[:-1]))
            held = held[-1:]
    if held:
        yield _nodes(pa.Table.from_batches(held))


def _nodes(table: pa.Table) -> pa.RecordBatch:
    part = table.combine_chunks().to_batches()[0]
    lists, sizes = part.column("ids"), part.column("bytes")
    at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    grower = Grower(lists.flatten().to_numpy(), sizes.flatten().to_numpy(), at, part.column("rep").to_numpy(), part.column("n").to_numpy(), part.column("ends").to_pylist())
    buckets, depths = part.column("bucket").to_numpy(), part.column("depth").to_numpy()
    ups, paths = part.column("up_conv").to_pylist(), part.column("path").to_pylist()
    cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True])
    tops, top_up = {}, {}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        top = grower.bucket(np.arange(a, b), int(depths[a]))
        tops[top], top_up[top] = paths[a], ups[a]
    leaves, saved = grower.sums()
    parents = [grower.conv[up] if up >= 0 else top_up[i] for i, up in enumerate(grower.up)]
    columns = [grower.conv, grower.depth, parents, grower.members, grower.children, leaves, saved]
    out = [pa.array(c, pa.int64()) for c in columns] + [pa.array(grower.ended, pa.string()), pa.array([tops.get(i) for i in range(len(leaves))], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(out, names=[*(f.split()[0] for f in NODE.split(", ")), "path"])


def shared(low: str, high: str):
    """How many turns all sequences of a bucket share: those that its least and its greatest have in common."""
    size = F.least(F.size(low), F.size(high))
    differ = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at(low, i) != F.element_at(high, i))
    return F.coalesce(F.get(differ, 0) - 1, size).alias("shared")


def trie(work: Workspace, seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """All nodes above the sequences that ``sequences`` gives."""
    spark = work.spark
    stats = [F.sum(F.size("ids")).alias("cells"), F.min("rep").alias("conv"), F.sum("n").alias("members"), F.min("ids").alias("low"), F.max("ids").alias("high")]
    #: A level's rows and the buckets that they fall into: (up, digit) names a bucket.
    level = seqs.withColumns({"up": F.lit(-1).cast("long"), "up_conv": F.lit(None).cast("long"), "depth": F.lit(0).cast("long"), "path": F.array().cast("array<long>")})
    small, large, ended, number = [], [], [], 0
    while True:
        digits = level.withColumn("digit", F.get("ids", 0))
        groups = digits.groupBy("up", "digit").agg(*stats).withColumn("bucket", F.monotonically_increasing_id() + (number << LEVEL_BITS))
        groups = work.keep(groups.select("up", "digit", "bucket", "conv", "members", (F.col("cells") > local).alias("goes_on"), shared("low", "high")), f"groups{number}")
        if number:
            rows = digits.join(groups.hint("merge"), ["up", "digit"])
        else:  # one bucket: no join on a key that all rows have
            one = groups.first()
            if one is None:
                return spark.createDataFrame([], NODE)
            rows = digits.withColumns({"bucket": F.lit(one.bucket), "conv": F.lit(one.conv), "members": F.lit(one.members), "goes_on": F.lit(one.goes_on), "shared": F.lit(one.shared)})
        rows = work.keep(rows.select("bucket", "depth", "up_conv", "path", "rep", "n", "ends", "ids", "bytes", "conv", "members", "goes_on", "shared"), f"rows{number}")
        work.drop(f"groups{number}")
        small.append(rows.filter("not goes_on").select("bucket", "depth", "up_conv", "path", "rep", "n", "ends", "ids", "bytes"))
        going = rows.filter("goes_on")
        if going.isEmpty():
            break
        # A row for each large bucket: what it shares with itself, from any of its rows.
        head = going.groupBy("bucket").agg(F.min(F.struct("depth", "up_conv", "path", "conv", "members", F.slice("bytes", F.lit(1), F.col("shared")).alias("bytes"))).alias("b")).select("bucket", "b.*")
        large.append(work.keep(head, f"large{number}"))
        ended.append(going.filter(F.size("ids") == F.col("shared")).select("bucket", "ends"))
        below = going.filter(F.size("ids") > F.col("shared"))
        rest = lambda c: F.slice(c, F.col("shared") + 1, F.size(c) - F.col("shared")).alias(c)
        level = below.select("rep", "n", "ends", rest("ids"), rest("bytes"), F.col("bucket").alias("up"), F.col("conv").alias("up_conv"), (F.col("depth") + F.col("shared")).alias("depth"), F.concat("path", F.array("bucket")).alias("path"))
        number += 1
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    spark.conf.set(*BATCH)
    grown = rows.repartition(width(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(grow, f"{NODE}, path array<long>")
    nodes = work.keep(grown, "nodes")
    if not large:
        return nodes.drop("path")
    heads, ends = large[0], ended[0]
    for more in large[1:]:
        heads = heads.unionByName(more)
    for more in ended[1:]:
        ends = ends.unionByName(more)
    own = F.aggregate("bytes", F.lit(0).cast("long"), lambda a, b: a + b * (F.col("members") - 1))
    parts = nodes.filter("path is not null").select("path", "n_leaves", F.col("saved_tokens").alias("saved"))
    parts = parts.unionByName(heads.select("path", F.lit(0).cast("long").alias("n_leaves"), own.alias("saved")))
    above = parts.select(F.posexplode("path"), F.size("path").alias("many"), "n_leaves", "saved").groupBy(F.col("col").alias("bucket")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.count_if(F.col("pos") == F.col("many") - 1).alias("n_children"))
    whole = heads.join(above, "bucket", "left").join(ends, "bucket", "left")
    #: A large bucket without any below it is one long sequence, or copies of it: one leaf, which those above it count too.
    alone = heads.join(above, "bucket", "left_anti").select(F.explode("path").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("more"))
    whole = whole.join(alone, "bucket", "left")
    last = F.size("bytes") - 1
    saved = own + F.coalesce(F.col("saved"), F.lit(0)) - (F.col("members") - 1) * F.coalesce(F.col("before"), F.lit(0))
    chain = whole.select("*", F.posexplode(F.expr("transform(bytes, (b, i) -> aggregate(slice(bytes, 1, i), 0L, (s, x) -> s + x))")).alias("i", "before"))
    chain = chain.select(
        F.col("conv").alias("conv_id"), (F.col("depth") + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.when(F.col("i") < last, F.lit(1)).otherwise(F.coalesce("n_children", F.lit(0))).cast("long").alias("n_children"),
        (F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(F.col("n_leaves")) + F.coalesce("more", F.lit(0))).cast("long").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"), F.when(F.col("i") == last, F.coalesce("ends", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return nodes.drop("path").unionByName(chain)


def prefix_trie(spark: SparkSession, conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of all conversations: one row for each distinct sequence of first turns, the empty one (the root) included.

    conv_id is the least conversation that begins so, and (conv_id, depth)
    names a node: its turns are that conversation's first ``depth``. Then
    parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes
    in the subtree), saved_tokens (over the subtree, bytes of a node's last
    text times n_convs - 1) and ends_sha256 (digest of the conv_ids that end
    here, in order).

    Turns go by their number, null first, and equal numbers by the digest of
    role and text; rows that repeat are turns each. A null role or text is
    empty. Rows with a null conv_id belong to no conversation and are left out.
    An empty table has no node. Texts of any length are digested where they are
    read and go no further; further columns of any name do no harm. A
    conversation's turn ids (12 bytes a turn) travel as one row.
    """
    work = Workspace(spark, "trie")
    return trie(work, sequences(work, encode(work, conversations)), local)


def family_trie(spark: SparkSession, conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of conversations rebuilt with their family's head (see ``rebuilt``); rows as in ``prefix_trie``, turnless conversations end at the root."""
    work = Workspace(spark, "trie")
    return trie(work, sequences(work, rebuilt(encode(work, conversations))), local)


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(x ORDER BY i) AS own, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS s FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), prefixes AS (
  SELECT conv_id, d, s[1:d] AS prefix, len(s) AS n, CASE WHEN d = 0 THEN 0 ELSE strlen(s[d].t) END AS size FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), members AS (
  SELECT conv_id, d, n, size, min(conv_id) OVER (PARTITION BY d, prefix) AS rep FROM prefixes
), nodes AS (
  SELECT rep, d, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM members GROUP BY rep, d
), tied AS (
  SELECT nodes.*, up.rep AS parent FROM nodes LEFT JOIN members up ON up.conv_id = nodes.rep AND up.d = nodes.d - 1
), counted AS (
  SELECT tied.*, coalesce(k.n, 0) AS n_children FROM tied LEFT JOIN (SELECT parent, d - 1 AS d, count(*) AS n FROM tied GROUP BY ALL) k ON k.parent = tied.rep AND k.d = tied.d
), below AS (
  SELECT m.rep, m.d, count_if(c.n_children = 0) AS n_leaves, sum(c.own) AS saved FROM counted c JOIN members m ON m.conv_id = c.rep AND m.d <= c.d GROUP BY m.rep, m.d
)
SELECT rep AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM counted JOIN below USING (rep, d)
"""
