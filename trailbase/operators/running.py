"""Running totals over a long order without one task that holds all of it.

Rows are cut into chunks of consecutive sequence numbers.  Each chunk's total
is an aggregate; what lies before a chunk is a window over chunk totals, which
are few; within a chunk a window runs as usual.  So a task holds a chunk, and
only one row for each chunk is ordered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1_000_000


def running(rows: DataFrame, by: str | list[str], seq: str, sums: dict[str, Column], highs: dict[str, Column] | None = None, chunk: int | Column = CHUNK, order: list | None = None) -> DataFrame:
    """rows with, for each name, the sum (or the greatest value, null if none yet) of a column up to and with each row.

    Rows go by ``seq``, in chunks of so many numbers; or by ``order`` within
    chunks that a column gives, which has to rise along that order.
    """
    by, highs = [by] if isinstance(by, str) else list(by), highs or {}
    at = F.floor(F.col(seq) / chunk) if isinstance(chunk, int) else chunk
    rows = rows.withColumns({"chunk_": at, **{f"{k}_": c for k, c in {**sums, **highs}.items()}})
    totals = rows.groupBy(*by, "chunk_").agg(*[F.sum(f"{k}_").alias(k) for k in sums], *[F.max(f"{k}_").alias(k) for k in highs])
    before = Window.partitionBy(*by).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(b).alias(f"{b}_by_") for b in by], F.col("chunk_").alias("at_"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums], *[F.max(k).over(before).alias(f"{k}_before") for k in highs])
    inside = Window.partitionBy(*by, "chunk_").orderBy(*(order or [seq])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({**{k: F.sum(f"{k}_").over(inside) for k in sums}, **{k: F.max(f"{k}_").over(inside) for k in highs}})
    same = own["chunk_"] == offsets["at_"]
    for b in by:
        same = same & own[b].eqNullSafe(offsets[f"{b}_by_"])
    both = own.join(offsets, same)
    out = both.withColumns({**{k: F.coalesce(F.col(k), F.lit(0)) + F.col(f"{k}_before") for k in sums}, **{k: F.greatest(F.col(k), F.col(f"{k}_before")) for k in highs}})
    return out.drop("chunk_", "at_", *[f"{b}_by_" for b in by], *[f"{k}_" for k in (*sums, *highs)], *[f"{k}_before" for k in (*sums, *highs)])


def last_rows(rows: DataFrame, by: str, seq: str, n: int, counts: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """rows with counts over each row and the n - 1 before it.

    Rows get their number in the order first; a chunk of numbers then borrows
    the n - 1 rows before it, so each frame lies within one chunk.
    """
    numbered = running(rows, by, seq, {"number": F.lit(1)}, chunk=chunk)
    at = F.col("number") - 1
    homes = F.when(at % chunk >= chunk - n + 1, F.array(F.floor(at / chunk), F.floor(at / chunk) + 1)).otherwise(F.array(F.floor(at / chunk)))
    spread = numbered.withColumn("home_", F.explode(homes))
    frame = Window.partitionBy(by, "home_").orderBy("number").rowsBetween(1 - n, Window.currentRow)
    counted = spread.withColumns({k: F.count_if(c).over(frame) for k, c in counts.items()})
    return counted.filter(F.col("home_") == F.floor(at / chunk)).drop("home_", "number")
