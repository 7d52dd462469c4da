"""Exact dedup by most-significant-digit radix partitioning of whole texts.

Texts of one length and one leading digit (some bytes) form a group; groups of
several rows are split again by the next digit, and a row alone in its group is
done.  A group whose texts have ended holds equal texts: bytes decide, no
digest.  Digits grow fourfold from level to level, so the number of levels is
the logarithm of the longest text that still has a partner.

A level counts its groups on the map side first, so a group of copies crosses
the exchange as one row for each task.  Its rows learn their group from a sort-merge
join at every size, in which Spark may split a hot key.  Only rows that still share a group carry
text to the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, documents, ids_are_unique

FIRST_DIGIT, GROWTH = 64, 4
RESULT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _group(work: Workspace, rows: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Groups of several rows by the keys, each with a number of its own."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys, F.monotonically_increasing_id().alias("to"))
    return work.keep(groups, f"groups{level}")


def exact_groups(spark: SparkSession, docs: DataFrame, *more: str, digest: bool = True) -> DataFrame:
    """One row for each row of docs: RESULT and the further columns named (``more``).

    keep_id is the largest doc_id of the rows with an equal text (null counts
    as the empty text) and group_size their number.  Rows that repeat a doc_id
    and its text count each and are kept together.  A row with a null doc_id
    is in no group: its keep_id is null, its group_size 1, and it is kept.  An
    empty table gives an empty result; further columns of any name do no harm.
    """
    work = Workspace(spark, "radix")
    extra = F.struct(*[F.col(c) for c in more]).alias("more_") if more else F.lit(None).cast("boolean").alias("more_")
    sha = F.sha2("text", 256) if digest else F.lit(None).cast("string")
    rows = documents(docs, extra).select("doc_id", "more_", sha.alias("sha_"), F.octet_length("text").alias("size_"), F.col("text").cast("binary").alias("rest_"))
    rows = rows.withColumn("digit_", F.substring("rest_", 1, FIRST_DIGIT))
    known = rows.filter("doc_id is not null")
    groups = _group(work, known.select("size_", "digit_"), ["size_", "digit_"], 0)
    width, done = FIRST_DIGIT, FIRST_DIGIT
    split = rows.join(groups.hint("merge"), ["size_", "digit_"], "left").withColumn("to", F.expr("if(doc_id is null, null, to)"))
    rest = F.when(F.col("to").isNotNull(), F.expr(f"substring(rest_, {FIRST_DIGIT + 1}, greatest(0, size_ - {FIRST_DIGIT}))"))
    level = work.keep(split.select("doc_id", "more_", "sha_", "size_", F.col("to").alias("group_"), rest.alias("rest_")), "level0")
    work.drop("groups0")
    number, finished = 0, []
    while True:
        finished.append(level.filter("group_ is null").select("doc_id", "more_", "sha_", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
        ended = level.filter(f"group_ is not null and size_ <= {done}")
        # Written first: a join right above an aggregate can't split a hot key.
        best = work.keep(ended.groupBy("group_").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), f"best{number}")
        finished.append(ended.join(best.hint("merge"), "group_").select("doc_id", "more_", "sha_", "keep_id", "group_size"))
        level = level.filter(f"group_ is not null and size_ > {done}")
        if level.isEmpty():
            break
        number, width = number + 1, width * GROWTH
        digits = level.withColumn("digit_", F.substring("rest_", 1, width))
        groups = _group(work, digits.select("group_", "digit_"), ["group_", "digit_"], number)
        rest = F.when(F.col("to").isNotNull(), F.expr(f"substring(rest_, {width + 1}, greatest(0, size_ - {done + width}))"))
        split = digits.join(groups.hint("merge"), ["group_", "digit_"], "left").select("doc_id", "more_", "sha_", "size_", F.col("to").alias("group_"), rest.alias("rest_"))
        level = work.keep(split, f"level{number}")
        work.drop(f"groups{number}")
        done += width
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(True)).alias("kept"), F.col("sha_").alias("text_sha256"), *([F.col("more_")[c].alias(c) for c in more]))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts those with the largest doc_id.

    Rows that repeat a doc_id and its text stay together, as in exact_groups.
    Where no doc_id repeats, an anti join on doc_id leaves the others out; else
    rows carry all their columns along.
    """
    if ids_are_unique(docs):
        gone = exact_groups(spark, docs, digest=False).filter("not kept").select("doc_id")
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    row = docs.withColumn("row_", F.struct(*[F.col(c) for c in docs.columns])).select("doc_id", "text", "row_")
    return exact_groups(spark, row, "row_", digest=False).filter("kept").select("row_.*")


ORACLE_SQL = """
SELECT doc_id, CASE WHEN doc_id IS NULL THEN NULL ELSE max(doc_id) OVER same END AS keep_id,
       CASE WHEN doc_id IS NULL THEN 1 ELSE count(doc_id) OVER same END AS group_size,
       doc_id IS NULL OR doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)
"""
