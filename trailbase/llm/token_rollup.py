"""Token counts kept as additive totals that signed deltas update.

A batch is a table of deltas: doc_id, source, lang, version, n_docs and
n_tokens, both signed.  An insert adds a document's count, a delete takes it
away, and a revision takes the old count away and adds the new one, perhaps
under another tokenizer version.  Totals by source, language and version are
sums, so batches commute and nothing is counted again.

Committing a batch writes its own small totals, counted on the map side before
the exchange, to a folder of this attempt alone and then renames that to the
batch's name.  The rename is the commit: it fails if the name is taken, so of
several writers of one batch one commits, none touches what another has
written, and one that dies leaves a folder that nobody reads.  A batch sent
again with other content is an error.  ``compact`` folds all committed batches into one folder, with a list of
their names and fingerprints, by which they are still known when sent again;
the totals are the sum of the last such folder and of the batches since.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
import regex
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, piece_codec
from .workspace import Workspace, documents

KEYS = ("source", "lang", "version")
WORDS = r"[^\x20\x09-\x0D]+"
#: Versions that count words, for totals that SQL can check: white-space words, and words and marks apart.
VERSIONS = {"words-1": WORDS, "words-2": r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"}
#: Ends of the files of tokenizers; a version that names no such file is a pattern of words.
FILES = (".json", ".tiktoken", ".model")
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


def encoder(path: str) -> Callable[[str], int]:
    """How many ids a text has by a tokenizer file, without ids that mark its beginning or end."""
    if path.endswith(".json"):
        whole = packing.ByteTokenizer(path)
        return lambda text: len(whole.encode([text])[0])
    if path.endswith(".model"):
        codec = piece_codec.PieceCodec(path, end_id=False)
        return lambda text: len(codec.encode(text))
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("file", pat_str=packing.WORDS, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        try:
            return len(fast.encode_to_numpy(text, disallowed_special=()))
        except ValueError:  # white space of a million characters exhausts its pattern's stack
            return sum(len(fast._encode_single_piece(w.group())) for w in regex.finditer(packing.WORDS, text))

    return count


_encoders: dict[str, Callable[[str], int]] = {}


def _count(path: str, texts: list[str]) -> list[int]:
    if path not in _encoders:
        _encoders[path] = encoder(path)
    return list(map(_encoders[path], texts))


def count_versions(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """doc_id, source, lang and a column of token counts for each version, in one pass over whole texts.

    A version is a tokenizer's file or a pattern of words.  Null texts have no
    tokens; rows that repeat or have no doc_id are counted like any other;
    further columns are left out.  A text of any length is encoded whole in
    one task.
    """
    files = {v: p for v, p in versions.items() if p.endswith(FILES)}
    name = lambda c: F.col(c).cast("string").alias(c)
    words = [F.regexp_count("text", F.lit(p)).cast("long").alias(v) for v, p in versions.items() if v not in files]
    rows = documents(docs, name("source"), name("lang")).select("*", *words)
    if files:
        fields = [f for f in rows.schema.fields if f.name != "text"]

        def run(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    part = batch.slice(low, 256)
                    texts = part.column("text").to_pylist()
                    counts = [pa.array(_count(path, texts), pa.int64()) for path in files.values()]
                    yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), *counts], names=[*(f.name for f in fields), *files])

        rows = rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{v}` long" for v in files)]))
    return rows.select("doc_id", "source", "lang", *[F.col(f"`{v}`") for v in versions])


def count_tokens(docs: DataFrame, version: str, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """doc_id, source, lang, version and n_tokens of whole texts; null texts have none."""
    return as_version(count_versions(docs, {version: versions[version]}), version)


def as_version(counted: DataFrame, version: str) -> DataFrame:
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("version"), F.col(f"`{version}`").alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("n_docs", F.lit(1).cast("long"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("n_docs", F.lit(-1).cast("long")).withColumn("n_tokens", -F.col("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts leave and the new ones come."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Totals in a folder that all executors share.

    Null keys are keys of their own; rows of a batch that repeat count each;
    an empty batch commits and changes nothing.  Totals that have come back to
    no documents and no tokens are left out.  Any number of writers may commit
    at the same time, one batch or several; ``compact`` is for one caller at a time, as
    batches may be committed beside it but not folded twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch once; False if it was committed before with the same totals."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch is named by letters, digits, _ and -")
        part = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        known = self._known()
        if batch in known or self._exists(f"batch={batch}/_SUCCESS"):
            before = known.get(batch) or self._fingerprint(self._read(f"batch={batch}"))
            if before != self._fingerprint(part):
                raise ValueError(f"batch {batch} was committed with other content")
            return False
        attempt = f"attempt={batch}-{uuid.uuid4().hex}"
        part.write.parquet(f"{self.path}/{attempt}")
        if self._rename(attempt, f"batch={batch}"):
            return True
        # Another writer was first: what counts is its content.
        same = self._fingerprint(self._read(f"batch={batch}")) == self._fingerprint(self._read(attempt))
        self._delete(attempt)
        if not same:
            raise ValueError(f"batch {batch} was committed with other content")
        return False

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _delete(self, name: str) -> None:
        where = self._path(name)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _rename(self, old: str, new: str) -> bool:
        """Give a folder its name for good; False if a complete folder has that name."""
        jvm, old_path, new_path = self.spark._jvm, self._path(old), self._path(new)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old_path.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for _ in range(2):
            try:
                context.rename(old_path, new_path, none)
                return True
            except Py4JJavaError:
                if self._exists(f"{new}/_SUCCESS"):
                    return False
                if not self._exists(new):
                    raise
                self._delete(new)  # without its mark it was never committed
        return False

    def _read(self, *names: str) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in names]
        return self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)

    @staticmethod
    def _fingerprint(part: DataFrame) -> str:
        """What tells the totals of one batch from others', whatever the order of their rows."""
        hashes = F.xxhash64(*KEYS, "n_docs", "n_tokens"), F.hash(*KEYS, "n_docs", "n_tokens")
        return "/".join(map(str, part.agg(F.count("*"), *[F.bit_xor(h) for h in hashes], F.sum("n_docs"), F.sum("n_tokens")).first()))

    def _names(self, kind: str, mark: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/{mark}_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(str(f.getPath()).rpartition(f"{kind}=")[2].partition("/")[0] for f in found or [])

    def _folded(self) -> int:
        """The number of the last folder of folded batches that is complete; 0 if there is none."""
        return max(map(int, self._names("folded", "known/")), default=0)

    def _known(self) -> dict[str, str]:
        """Names and fingerprints of folded batches."""
        n = self._folded()
        return {r["batch"]: r["fingerprint"] for r in self.spark.read.parquet(f"{self.path}/folded={n}/known").collect()} if n else {}

    def batches(self) -> list[str]:
        """Names of committed batches, folded or not."""
        return sorted({*self._known(), *self._names("batch", "")})

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs and n_tokens over all committed batches."""
        n, known = self._folded(), self._known()
        rows = self._read(*([f"folded={n}/totals"] if n else []), *(f"batch={b}" for b in self._names("batch", "") if b not in known))
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter("n_docs != 0 or n_tokens != 0")

    def compact(self) -> int:
        """Fold all committed batches into one folder and delete theirs; returns how many batches it stands for.

        The list of names is written last and is the commit: a caller that dies
        before leaves all as it was, and one that dies after leaves batch folders
        that the list names and nobody reads.
        """
        n, known = self._folded(), self._known()
        new = [b for b in self._names("batch", "") if b not in known]
        names = known | {b: self._fingerprint(self._read(f"batch={b}")) for b in new}
        if new:
            self.totals().write.mode("overwrite").parquet(f"{self.path}/folded={n + 1}/totals")
            self.spark.createDataFrame(sorted(names.items()), "batch string, fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folded={n + 1}/known")
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for gone in [*(f"batch={b}" for b in self._names("batch", "") if b in names), *(f"folded={i}" for i in map(int, self._names("folded", "known/")) if i < self._folded())]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{gone}"), True)
        return len(names)


def replay(spark: SparkSession, docs: DataFrame, labels: DataFrame, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """The totals after four batches over a whole table, one of them sent twice.

    All documents come in under the first of two versions; those labelled
    toxic are deleted; those labelled as of low quality are revised to the
    second version; the deletions are sent again and change nothing; and all
    documents left are counted under the second version too by a last batch of
    those not revised.  The batches are folded together before that last one.
    Null texts count no tokens; null sources and languages are keys of their
    own; repeated rows count each; labels with a null doc_id mark nothing, and
    of several labels of a document toxic ones and low quality prevail.  Empty
    tables give no totals.
    """
    first, second = versions
    work = Workspace(spark, "rollup")
    rollup = TokenRollup(spark, f"{work.path}/totals")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    counted = work.keep(count_versions(docs, versions).join(marks, "doc_id", "left"), "counted")
    gone = F.coalesce(F.col("toxic") == 1, F.lit(False))
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    rollup.commit("inserts", inserts(as_version(counted, first)))
    removed = deletes(as_version(counted.filter(gone), first))
    rollup.commit("deletes", removed)
    revised = counted.filter(~gone & low)
    rollup.commit("revisions", revisions(as_version(revised, first), as_version(revised, second)))
    rollup.commit("deletes", removed)
    rollup.compact()
    rollup.commit("second-version", inserts(as_version(counted.filter(~gone & ~low), second)))
    return rollup.totals()


ORACLE_SQL = r"""
WITH marks AS (SELECT doc_id, max(coalesce(toxic, 0)) AS toxic, min(coalesce(quality, 1)) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
left_over AS (SELECT source, lang, coalesce(quality = 0, false) AS low, coalesce(text, '') AS t
              FROM documents LEFT JOIN marks USING (doc_id) WHERE NOT coalesce(toxic = 1, false))
SELECT source, lang, 'words-1' AS version, count(*) AS n_docs, sum(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens
FROM left_over WHERE NOT low GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words-2', count(*), sum(len(regexp_extract_all(t, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')))::BIGINT
FROM left_over GROUP BY source, lang
"""
