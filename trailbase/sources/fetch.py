"""Fetching: a stage that calls a client, or reads pages that are already there."""

from __future__ import annotations

import datetime
import email.utils
import heapq
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.circuits import breaker_step

MOST_ATTEMPTS, MOST_REDIRECTS, RETRY_AFTER, MOST_WAIT = 3, 10, 5.0, 60.0


class Response(NamedTuple):
    status: int
    headers: dict
    body: bytes


Client = Callable[[str], Response]
RESULT = "url_key string, final_url string, status int, outcome string, attempts int, redirects int, html binary, error string"


def retry_after(stated: str | None, now: datetime.datetime | None = None) -> float:
    """Seconds to wait by a Retry-After header: a number of seconds, or a date; what is neither counts as RETRY_AFTER."""
    stated = (stated or "").strip()
    if stated.isascii() and stated.isdigit():
        return float(stated)
    try:
        until = email.utils.parsedate_to_datetime(stated)
    except (TypeError, ValueError):
        return RETRY_AFTER
    until = until if until.tzinfo else until.replace(tzinfo=datetime.UTC)
    return max(0.0, (until - (now or datetime.datetime.now(datetime.UTC))).total_seconds())


def fetch_one(client: Client, url: str, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Follow redirects, relative ones too (no loops), try again after 429, 5xx and errors of the line, give up on other 4xx and on targets that are no URL."""
    attempts, wait, error, status = 0, 0.0, None, None
    while attempts < MOST_ATTEMPTS:
        if attempts:
            sleep(min(wait or 2.0**attempts, MOST_WAIT))
        attempts, at, met, wait = attempts + 1, url, {url}, 0.0
        try:
            answer = client(at)
            while answer.status in (301, 302, 303, 307, 308) and answer.headers.get("location"):
                at = urljoin(at, answer.headers["location"])
                if at in met or len(met) > MOST_REDIRECTS:
                    return {"final_url": at, "status": answer.status, "outcome": "failed", "attempts": attempts, "redirects": len(met) - 1, "html": None, "error": "redirect loop"}
                met.add(at)
                answer = client(at)
        except OSError as e:
            error = str(e)
            continue
        except ValueError as e:  # a target that can't be read as a URL
            return {"final_url": at, "status": status, "outcome": "failed", "attempts": attempts, "redirects": len(met) - 1, "html": None, "error": str(e)}
        status, error = answer.status, None
        if status < 400:
            return {"final_url": at, "status": status, "outcome": "ok", "attempts": attempts, "redirects": len(met) - 1, "html": answer.body, "error": None}
        if status == 429:
            wait = retry_after(answer.headers.get("retry-after"))
        elif status < 500:
            break
    return {"final_url": url, "status": status, "outcome": "failed", "attempts": attempts, "redirects": 0, "html": None, "error": error or f"status {status}"}


def fetch(items: DataFrame, make_client: Callable[[], Client], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """RESULT for items (url_key, canonical); one client for each task."""

    def run(batches: Iterator[pd.DataFrame]):
        client = make_client()
        for batch in batches:
            rows = [{"url_key": k, **fetch_one(client, u, sleep)} for k, u in zip(batch["url_key"], batch["canonical"], strict=True)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT.split(", ")])

    return items.select("url_key", "canonical").mapInPandas(run, RESULT)


POLITE = f"domain string, {RESULT}, fetched_at timestamp"
#: Items of a task that wait for their domain's turn together.
WINDOW = 1000


class Turns:
    """Items of several domains, each handed out when its domain's gate opens; the domain that opens first goes first."""

    def __init__(self, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.clock, self.sleep, self.states = clock, sleep, {}
        self.waiting: dict[str, deque] = {}
        self.heap: list[tuple[float, int, str]] = []
        self.size = self.order = 0

    def add(self, domain: str, item: tuple, opens: float) -> None:
        """opens: not before, as far as earlier runs know."""
        if domain not in self.states:
            self.states[domain] = (0, opens, 0.0)
        if domain not in self.waiting:
            self.waiting[domain] = deque()
            self._queue(domain)
        self.waiting[domain].append(item)
        self.size += 1

    def _queue(self, domain: str) -> None:
        self.order += 1
        heapq.heappush(self.heap, (self.states[domain][1], self.order, domain))

    def next(self) -> tuple[str, tuple, bool]:
        """The next item, after its domain's gate has opened; and whether its circuit is open, in which case nobody waits."""
        opens, _, domain = heapq.heappop(self.heap)
        shut = self.states[domain][2] > self.clock()
        if not shut and opens > self.clock():
            self.sleep(opens - self.clock())
        item = self.waiting[domain].popleft()
        self.size -= 1
        return domain, item, shut

    def done(self, domain: str, status: int | None, delay: int) -> None:
        """What a response means for the domain's next item."""
        if status is not None:
            self.states[domain] = breaker_step(self.states[domain], status, self.clock(), crawl_delay=delay)
        if self.waiting[domain]:
            self._queue(domain)
        else:
            del self.waiting[domain]


def fetch_politely(items: DataFrame, make_client: Callable[[], Client], delays: DataFrame | None = None, circuits: DataFrame | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """POLITE rows of items (domain, url_key, canonical): one request at a time for a domain, as far apart as it asks for.

    delays: domain and crawl_delay (``robots.crawl_delays``); circuits: domain,
    next_allowed and open_until (``circuits.circuits_now``), to begin with.  All
    items of a domain are in one task, as they have to come one after the other
    anyway; a task takes turns between its domains and holds WINDOW items and
    one body at a time.  429 and 503 make a domain wait longer; while its
    circuit is open its items come back as "deferred" at once.
    """
    rows = items.select("domain", "url_key", "canonical")
    rows = rows.withColumn("crawl_delay", F.lit(0)) if delays is None else rows.join(delays.select("domain", "crawl_delay"), "domain", "left")
    if circuits is None:
        rows = rows.withColumns({"opens": F.lit(0.0), "until": F.lit(0.0)})
    else:
        seconds = lambda c: (F.unix_micros(c) / 1e6).alias(c)
        rows = rows.join(circuits.select("domain", seconds("next_allowed").alias("opens"), seconds("open_until").alias("until")), "domain", "left")
    names = [f.split()[0] for f in POLITE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]):
        client, turns = make_client(), Turns(clock, sleep)

        def one() -> pd.DataFrame:
            domain, (key, url, delay, until), shut = turns.next()
            if shut or until > clock():
                row = {"final_url": url, "status": None, "outcome": "deferred", "attempts": 0, "redirects": 0, "html": None, "error": "circuit open"}
            else:
                row = fetch_one(client, url, sleep)
            turns.done(domain, row["status"], delay)
            return pd.DataFrame([{"domain": domain, "url_key": key, **row, "fetched_at": pd.Timestamp(clock(), unit="s", tz="UTC")}], columns=names).astype({"status": "Int32"})

        for batch in batches:
            for domain, key, url, delay, opens, until in batch[["domain", "url_key", "canonical", "crawl_delay", "opens", "until"]].itertuples(index=False):
                turns.add(domain, (key, url, 0 if pd.isna(delay) else int(delay), 0.0 if pd.isna(until) else until), 0.0 if pd.isna(opens) else opens)
                while turns.size >= WINDOW:
                    yield one()
        while turns.size:
            yield one()

    return rows.repartition("domain").mapInPandas(run, POLITE)


def responses(fetched: DataFrame) -> DataFrame:
    """What ``circuits`` takes, of POLITE rows: domain, ts, seq and status of what was asked for."""
    return fetched.filter("status is not null").select("domain", F.col("fetched_at").alias("ts"), F.unix_micros("fetched_at").alias("seq"), "status")


def store_raw(fetched: DataFrame, root: str, run_id: str) -> DataFrame:
    """Keep the bytes of fetched pages under the run's name and return where each lies: url_key, final_url, raw_path, sha256 and bytes.

    Bytes lie in Parquet files by run, many pages in one file; a page is found
    by its key.
    """
    path = f"{root.rstrip('/')}/raw_pages/run_id={run_id}"
    fetched.filter("html is not null").select("url_key", "final_url", F.sha2("html", 256).alias("sha256"), F.octet_length("html").alias("bytes"), "html").write.mode("append").parquet(path)
    return fetched.sparkSession.read.parquet(path).select("url_key", "final_url", F.lit(path).alias("raw_path"), "sha256", "bytes")


def raw(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """url_key and html of a run's pages, as they were fetched."""
    return spark.read.parquet(f"{root.rstrip('/')}/raw_pages/run_id={run_id}").select("url_key", "html")


def replay(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with the page that a table already has for their key; items without one are left out."""
    return items.join(pages, "url_key")
