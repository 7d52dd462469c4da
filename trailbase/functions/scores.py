"""Numbers: rounding, vectors, and the weighted factors of a rule score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls
from .binding import let


def round4(value: Column) -> Column:
    """Half up at four places, the same in every SQL engine."""
    return F.floor(value * 10000 + 0.5) / 10000


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(0.0))).otherwise(0.0)


def normalize(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def depth_penalty(depth: Column) -> Column:
    return 1 / F.sqrt(depth + 1)


def position_signal(position: Column, link_count: Column) -> Column:
    """1 - position / links; the position counts links without a target too, so it may pass the count."""
    return F.when(F.coalesce(link_count, F.lit(0)) > 0, 1 - position / link_count).otherwise(0.5)


def default_factors(keywords: list[str]) -> dict[str, tuple[float, Column]]:
    """Name, weight and score of each factor, over columns anchor, snippet, source_title, domain_prior, depth, href, position and link_count."""
    c = F.col
    half = F.lit(0.5)
    match = lambda column: text.jaccard(keywords, c(column)) if keywords else half
    return {
        "anchor": (0.30, match("anchor")),
        "snippet": (0.15, match("snippet")),
        "title": (0.15, match("source_title")),
        "prior": (0.15, F.coalesce(c("domain_prior"), half)),
        "depth": (0.10, depth_penalty(c("depth"))),
        "path": (0.10, urls.path_signal(c("href"))),
        "position": (0.05, position_signal(c("position"), c("link_count"))),
    }


def weighted(factors: dict[str, tuple[float, Column]]) -> Column:
    """The weighted mean of factors; 0 without weight."""
    total = sum(w for w, _ in factors.values())
    if total <= 0:
        return F.lit(0.0)
    summed = F.lit(0.0)
    for w, score in factors.values():
        summed = summed + F.lit(float(w)) * score
    return summed / F.lit(float(total))


def blend(new: Column, old: Column, weight: float = 0.8) -> Column:
    return round4(F.lit(weight) * new + F.lit(1 - weight) * old)
