"""Structured Streaming over the event log: counts, windows, running verdicts, circuit breaker.

Each has a batch form among the operators; run over the same rows both agree.
Events come late by ten minutes at most, by their own time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import circuits
from ..shared import delete_at_exit, shared_folder

LATE = "10 minutes"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream, with ts as an instant."""
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def counts_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def windowed(events: DataFrame, span: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows of event time."""
    out = events.withWatermark("ts", LATE).groupBy(F.window("ts", span), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: a gap ends one."""
    out = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def running_verdicts(events: DataFrame, good: tuple[str, ...] = ("purchase", "click"), n: int = 3) -> DataFrame:
    """user_id, seen and good of the last n verdicts of each user, kept as state; rows of a batch go by event_id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        newest = pd.DataFrame()
        for rows in batches:  # of the batch, too, the last n are enough
            newest = pd.concat([newest, rows]).nlargest(n, "event_id")
        last = [*last, *(e in good for e in newest.sort_values("event_id")["event_type"])][-n:]
        state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]], "seen": [len(last)], "good": [sum(last)]})

    grouped = events.select("user_id", "event_id", "event_type").groupBy("user_id")
    return grouped.applyInPandasWithState(step, "user_id long, seen int, good int", "last array<boolean>", "update", GroupStateTimeout.NoTimeout)


def circuit_breaker(responses: DataFrame, **limits) -> DataFrame:
    """domain, fails, next_allowed and open_until (seconds) after each batch of responses (domain, ts, status), kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = tuple(state.get) if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        own = circuits.breaker_frame({key[0]: own}, rows, **limits)[key[0]]
        state.update(own)
        yield pd.DataFrame({"domain": [key[0]], "fails": [own[0]], "next_allowed": [own[1]], "open_until": [own[2]]})

    return responses.groupBy("domain").applyInPandasWithState(step, "domain string, fails int, next_allowed double, open_until double", "fails int, next_allowed double, open_until double", "update", GroupStateTimeout.NoTimeout)


def run_to_folder(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """What the stream's results are now, from files in the shared folder.

    A micro-batch writes a folder of its own, so one that is run again writes
    the same folder again. In complete mode the last batch is the result; in
    update mode the last row of each key is.
    """
    spark = stream.sparkSession
    path = shared_folder(spark, "stream")
    delete_at_exit(spark, path)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").schema(StructType([*stream.schema.fields, StructField("batch_", IntegerType())])).parquet(f"{path}/out")
    if mode == "complete":
        return rows.join(rows.agg(F.max("batch_").alias("batch_")).hint("broadcast"), "batch_").drop("batch_")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch_").alias("r")).select("r.*")


def run_to_table(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that the stream has now, as a table in memory: for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the stream has now to Parquet files, exactly once, and stop."""
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
