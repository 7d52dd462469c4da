"""Tables of a walk that only grow: segments, merged in tiers, and a frontier by priority bands on top of them.

A round appends a segment.  As soon as FAN segments of one tier stand at the
end they become one of the next tier, so that a row is written again once for
each tier (the logarithm of the rounds), a table has few segments, and what a
round writes goes with the round and not with the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FAN = 8
#: Bands of 1 / BANDS_A_UNIT of priority, from the highest (0) down; the first and the last take all that lies beyond.
BANDS, BANDS_A_UNIT, HIGHEST = 24, 16, 1.5


def band(priority: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), F.floor((F.lit(HIGHEST) - priority) * BANDS_A_UNIT))).cast("int")


def observed(df: DataFrame, path: str, by: str | None = None, **counts: Column) -> dict:
    """Write df, and what was counted while it was written: rows, the counts asked for, and bands (rows of each band)."""
    seen = Observation()
    bands = [F.count_if(F.col("band") == b).alias(f"band{b}") for b in range(BANDS)] if "band" in df.columns else []
    writer = df.observe(seen, F.count("*").alias("rows"), *bands, *[c.alias(k) for k, c in counts.items()]).write
    (writer.partitionBy(by) if by else writer).mode("overwrite").parquet(path)
    got = seen.get
    return {"rows": got["rows"], **{k: got[k] for k in counts}, **({"bands": [got[f"band{b}"] for b in range(BANDS)]} if bands else {})}


class Manifests:
    """Numbered JSON files in a folder; one is there whole or not at all, and names what belongs to its number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _where(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def last(self) -> int:
        """The greatest number there is; -1 if there is none."""
        files, where = self._where("*.json")
        return max((int(f.getPath().getName().removesuffix(".json")) for f in files.globStatus(where) or []), default=-1)

    def read(self, number: int) -> dict:
        files, where = self._where(f"{number}.json")
        stream = files.open(where)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return json.loads(text)

    def commit(self, number: int, told: dict) -> None:
        """Write under another name and rename."""
        files, draft = self._where(f"_{number}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        files.rename(draft, self._where(f"{number}.json")[1])


class Log:
    """A table of segments (name, tier, rows, since: the first round in it) below a folder, each in files by the column ``by`` if that is given."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str | None = None, segments: list | None = None):
        self.spark, self.path, self.schema, self.by = spark, path, schema, by
        self.segments = [tuple(s) for s in segments or []]

    def read(self, segments: list | None = None) -> DataFrame:
        paths = [self.where(name) for name, *_ in (self.segments if segments is None else segments)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        if not self.by:
            return self.spark.read.schema(self.schema).parquet(*paths)
        return self.spark.read.schema(f"{self.schema}, segment string").option("basePath", f"{self.path}/by_{self.by}").parquet(*paths).drop("segment")

    def where(self, name: str) -> str:
        return f"{self.path}/by_{self.by}/segment={name}" if self.by else f"{self.path}/{name}"

    def append(self, df: DataFrame, name: str, round_: int, **counts: Column) -> dict:
        """Add a segment; an empty one is written and forgotten."""
        got = observed(df, self.where(name), self.by, **counts)
        if got["rows"]:
            self.segments.append((name, 0, got["rows"], round_))
        return got

    def drop_last(self, name: str) -> None:
        self.segments = [s for s in self.segments if s[0] != name]

    def merge(self, round_: int, living: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
        """Merge full tiers; ``living`` makes of a merged segment's rows those that are needed on (since: its first round)."""
        while len(self.segments) >= FAN and len({s[1] for s in self.segments[-FAN:]}) == 1:
            old = self.segments[-FAN:]
            tier, since, name = old[0][1] + 1, min(s[3] for s in old), f"{old[-1][0]}.{round_}-{old[0][1] + 1}"
            rows = self.read(old)
            files = rows if living is None else living(rows, since)
            got = observed(files.hint("rebalance", *([self.by] if self.by else [])), self.where(name), self.by)
            self.segments = self.segments[:-FAN] + ([(name, tier, got["rows"], since)] if got["rows"] else [])
