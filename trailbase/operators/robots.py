"""Politeness: robots rules as a relation, status classes and back-off.

A robots.txt is read once, into rows (domain, rank, path, allow); of the rules
that a path begins with, the first in the file decides.  A path is tried at the
lengths that its domain's rules have and no others, so matching is a join on
(domain, prefix), whose keys spread the links of one domain; no rule text
travels beside links, and paths are put into the form of the rules by
expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse, urlunparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_HOURS = 24
RULE = "domain string, rank int, path string, allow boolean, crawl_delay int"


def status_class(status: Column) -> Column:
    """ok, retry (429 and 5xx), redirect or failed."""
    return F.when(status.between(200, 299), "ok").when(status.between(300, 399), "redirect").when((status == 429) | status.between(500, 599), "retry").otherwise("failed")


def backoff(attempt: Column, most: int = 60) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(most)))


def groups(raw: str) -> list[tuple[list[str], list[tuple[str, bool]], int | None]]:
    """The groups of a robots.txt: agents, rules (path, allow) in order, and the crawl delay.

    Agents with nothing but an empty line below them are no group; rules before
    any agent count for nobody.
    """
    out, agents, rules, delay, ruled = [], [], [], None, False

    def end():
        nonlocal agents, rules, delay, ruled
        if ruled:
            out.append((agents, rules, delay))
        agents, rules, delay, ruled = [], [], None, False

    for line in raw.splitlines():
        if not line:
            end()
        name, colon, value = line.split("#", 1)[0].strip().partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), unquote(value.strip())
        if name == "user-agent":
            if ruled:
                end()
            agents.append(value)
        elif agents and name in ("disallow", "allow"):
            path = quote(urlunparse(urlparse(value)))
            rules.append((path, name == "allow" or not value))
            ruled = True
        elif agents and name == "crawl-delay":
            delay, ruled = int(value) if value.isdigit() else delay, True
        elif agents and name == "request-rate":
            ruled = True
    end()
    return out


def group_for(raw: str, agent: str) -> tuple[list[tuple[str, bool]], int | None]:
    """Rules and delay for an agent: the first group that names it, else the first for all."""
    name, rest = agent.split("/")[0].lower(), None
    for agents, rules, delay in groups(raw):
        if "*" in agents:
            rest = rest or (rules, delay)
        elif any(a.lower() in name for a in agents):
            return rules, delay
    return rest or ([], None)


def rules_relation(files: DataFrame, agent: str = "*") -> DataFrame:
    """RULE rows of robots files (domain, raw): a row for each rule, and one without a path (rank -1) for a crawl delay.

    A domain without a file, or with a null one, has no rows and forbids nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for domain, raw in zip(batch.column("domain").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                rules, delay = group_for(raw, agent)
                rows += [(domain, i, path, allow, None) for i, (path, allow) in enumerate(rules)]
                if delay is not None:
                    rows.append((domain, -1, None, None, delay))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RULE.split(", ")])

    return files.select("domain", "raw").filter("raw is not null").mapInArrow(run, RULE)


def crawl_delays(relation: DataFrame) -> DataFrame:
    """domain and crawl_delay, in seconds, of the domains that state one."""
    return relation.filter("crawl_delay is not null").groupBy("domain").agg(F.max("crawl_delay").alias("crawl_delay"))


def fetch_path(url: Column) -> Column:
    """What rules are held against: path, query and fragment of an absolute URL, decoded and quoted again; ``/`` if there is nothing."""
    text = F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    text = F.regexp_replace(F.url_decode(text), r"[\t\r\n]", "")
    rest = F.regexp_replace(F.regexp_replace(text, "^[A-Za-z][A-Za-z0-9+.-]*:", ""), "^//[^/?#]*", "")
    rest = F.regexp_replace(rest, r"^([^?#]*/)?([^/?#;]*);(?=[?#]|$)", "$1$2")  # empty parameters, queries and fragments have no mark
    rest = F.regexp_replace(F.regexp_replace(rest, r"^([^?#]*)\?(?=#|$)", "$1"), r"^([^#]*)#$", "$1")
    quoted = F.url_encode(rest)
    for own, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(own), F.lit(plain))
    return F.when(quoted == "", "/").otherwise(quoted)


def robots_flags(candidates: DataFrame, relation: DataFrame, circuits: DataFrame | None = None) -> DataFrame:
    """Candidates with robots_allows: what their domain's rules say; true where none fits, false while its circuit is open.

    relation: ``rules_relation``; circuits: domain and closed (``circuits.circuit_allows``).
    Equal paths of a domain are tried once.  Candidates are read twice, for
    their paths and for themselves, so they should lie in a table.
    """
    rules = relation.filter("path is not null").select("domain", "rank", F.col("path").alias("prefix_"), "allow")
    sizes = rules.groupBy("domain").agg(F.collect_set(F.length("prefix_")).alias("sizes_"))
    rows = candidates.withColumn("path_", fetch_path(F.col("canonical")))
    paths = rows.select("domain", "path_").distinct()
    tried = paths.join(sizes, "domain").select("domain", "path_", F.explode(F.filter("sizes_", lambda n: n <= F.length("path_"))).alias("n_"))
    tried = tried.select("domain", "path_", F.substring("path_", F.lit(1), F.col("n_")).alias("prefix_"))
    said = tried.join(rules, ["domain", "prefix_"]).groupBy("domain", "path_").agg(F.min_by("allow", "rank").alias("said_"))
    flagged = rows.join(said, ["domain", "path_"], "left").withColumn("robots_allows", F.coalesce("said_", F.lit(True)))
    if circuits is not None:
        flagged = flagged.join(circuits.select("domain", "closed"), "domain", "left").withColumn("robots_allows", F.col("robots_allows") & F.coalesce("closed", F.lit(True)))
    return flagged.select(*candidates.columns, "robots_allows")


def stale(fetched_at: Column, now: Column, hours: int = TTL_HOURS) -> Column:
    """Whether a robots.txt has to be read again; one never read has."""
    return F.coalesce(fetched_at + F.make_interval(hours=F.lit(hours)) < now, F.lit(True))
