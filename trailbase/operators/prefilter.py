"""The ordered rule cascade that says why a candidate is dropped.

Rules are (name, column) pairs; the first that holds names the reason.  One
CASE keeps the order and stops at the first hit; a rule that is null (it
could not be decided) is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schemes that lead to no page, and file endings that are no pages.
DEAD_PREFIXES = ("javascript:", "mailto:", "tel:", "#")
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "svg", "ico", "webp", "mp4", "mp3", "avi", "mov", "wmv", "flv", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar", "gz", "7z", "exe", "dmg", "deb", "rpm", "msi", "css", "js", "map", "txt", "xml", "rss")
#: Path words (the last with a slash of its own), emoji, and anchors that say nothing.
PATH_WORDS = ("login", "logout", "signup", "register", "signin", "cart", "checkout", "account", "admin", "wp-admin", "ajax", "api/")
EMOJI = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1F9FF}\x{FE00}-\x{FE0F}]"
EMPTY_ANCHOR = r"(?i)^(download|click\s*here|read\s*more|more|here)$"
DEFAULT_BLACKLIST = ("wikidata.org",)
EXTENSION_PATTERN = rf"(?i)\.({'|'.join(EXTENSIONS)})(\?|#|$)"
PATH_PATTERN = rf"(?i)/({'|'.join(PATH_WORDS)})/|{EMOJI}"


def default_rules(blacklist: tuple[str, ...] = DEFAULT_BLACKLIST, negative_anchor: bool = False) -> list[tuple[str, Column]]:
    """Rules over the columns raw, canonical, domain, reg_domain, depth and anchor, and over the flags that joins bring.

    Flags: in_scope and seen (joins with allowed domains and with visited and
    queued keys), robots_allows, domain_done; limits: depth_limit and
    domain_budget.  A flag that is null passes.
    """
    c = F.col
    dead = F.lit(False)
    for prefix in DEAD_PREFIXES:
        dead = dead | c("raw").startswith(prefix)
    rules = [
        ("scope", ~c("in_scope")),
        ("dedup", c("seen")),
        ("blacklist", c("reg_domain").isin(*blacklist) | c("domain").isin(*blacklist)),
        ("robots", ~c("robots_allows")),
        ("protocol", dead),
        ("extension", c("canonical").rlike(EXTENSION_PATTERN)),
        ("url_pattern", c("canonical").rlike(PATH_PATTERN)),
        ("depth", c("depth") > c("depth_limit")),
        ("domain_budget", c("domain_done") >= c("domain_budget")),
    ]
    return [*rules, ("negative_anchor", c("anchor").rlike(EMPTY_ANCHOR))] if negative_anchor else rules


def drop_reason(rules: list[tuple[str, Column]]) -> Column:
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(reason)
    return reason


def with_reason(candidates: DataFrame, depth_limit: int = 5, domain_budget: int = 50, blacklist: tuple[str, ...] = DEFAULT_BLACKLIST, negative_anchor: bool = False, allowed: DataFrame | None = None, seen: DataFrame | None = None, done: DataFrame | None = None, rules: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Candidates with drop_reason (null: stays), by ``rules`` or else the default ones.

    allowed: reg_domain; seen: url_key; done: reg_domain and domain_done.  Each
    is joined by key, so none has to fit the driver; ``robots_allows`` is used
    if it is there.
    """
    out = candidates.withColumns({"depth_limit": F.lit(depth_limit), "domain_budget": F.lit(domain_budget)})
    out = out.withColumn("in_scope", F.lit(True)) if allowed is None else out.join(allowed.select("reg_domain").distinct().withColumn("in_scope", F.lit(True)), "reg_domain", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    out = out.withColumn("seen", F.lit(False)) if seen is None else out.join(seen.select("url_key").distinct().withColumn("seen", F.lit(True)), "url_key", "left")
    out = out.withColumn("domain_done", F.lit(0)) if done is None else out.join(done.select("reg_domain", "domain_done"), "reg_domain", "left")
    if "robots_allows" not in out.columns:
        out = out.withColumn("robots_allows", F.lit(True))
    return out.withColumn("drop_reason", drop_reason(default_rules(blacklist, negative_anchor) if rules is None else rules)).drop("depth_limit", "domain_budget", "in_scope", "seen", "domain_done", "robots_allows")
