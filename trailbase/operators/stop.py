"""When a run stops: conditions over one row of counters for each task, all that hold, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STREAK, WINDOW, FEWEST = 5, 20, 2


def conditions() -> list[tuple[str, Column]]:
    """(code, column) over the counters of a task; limits of 0 are none."""
    c = F.col
    return [
        ("BUDGET_PAGES", (c("max_pages") > 0) & (c("fetched") >= c("max_pages"))),
        ("BUDGET_TOKENS", (c("max_tokens") > 0) & (c("tokens_used") >= c("max_tokens"))),
        ("BUDGET_TIME", (c("max_duration") > 0) & (c("elapsed") >= c("max_duration"))),
        ("TIME_HORIZON", c("since").isNotNull() & (c("stale_streak") >= STREAK)),
        ("FATAL", F.coalesce(c("fatal_error"), F.lit("")) != ""),
        ("USER_REQUESTED", c("state") == "STOPPING"),
        ("DIMINISHING_RETURNS", (c("judged") >= WINDOW) & (c("relevant") < FEWEST)),
        ("FRONTIER_DRAINED", (c("frontier_size") == 0) & (c("buffer_size") == 0) & (c("in_flight") == 0)),
    ]


def stop_reasons(counters: DataFrame, checks: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Counters with stop_reasons: codes joined by +, or null if the run goes on."""
    codes = F.concat_ws("+", *[F.when(F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in checks or conditions()])
    return counters.withColumn("stop_reasons", F.nullif(codes, F.lit("")))
