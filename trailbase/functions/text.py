"""Words, overlaps and prompt text as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

WORD = r"[\p{L}\p{N}_]+"


def word_list(text: Column) -> Column:
    """Distinct lower-case words in the order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def jaccard(keywords: list[str], text: Column) -> Column:
    """Overlap of keyword words and text words; 0.5 if either has none; 0.3 more (1 at most) if a keyword of several words is in the text as it is."""
    wanted = list(dict.fromkeys(w.lower() for k in keywords for w in re.findall(r"\w+", k)))
    if not wanted:
        return F.lit(0.5)
    phrases = [k.lower() for k in keywords if " " in k.strip()]

    def overlap(words: Column) -> Column:
        shared = F.size(F.array_intersect(words, F.array(*map(F.lit, wanted))))
        plain = shared / (F.size(words) + len(wanted) - shared)
        found = F.lit(False)
        for phrase in phrases:
            found = found | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(phrase))
        raised = F.when(found, F.least(F.lit(1.0), plain + 0.3)).otherwise(plain) if phrases else plain
        return F.when(F.size(words) == 0, F.lit(0.5)).otherwise(raised)

    return let(word_list(text), overlap)


def shorten(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def first_text(*columns: Column) -> Column:
    """The first column that is not blank, trimmed; null if all are."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def embedding_text(text: Column, anchor: Column, snippet: Column, heading: Column, title: Column, url: Column, most: int = 512) -> Column:
    """What stands for a candidate: its texts that are not blank, or else its URL; cut at ``most`` characters."""
    joined = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in (text, anchor, snippet, heading, title)])
    return F.left(F.coalesce(F.nullif(joined, F.lit("")), url), F.lit(most))


def content_hash(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.char(F.lit(0)), text), 256)


def candidate_card(identifier: Column, url: Column, anchor: Column, snippet: Column, source: Column) -> Column:
    """One candidate's lines in a ranking prompt."""
    short = lambda c: shorten(F.coalesce(c, F.lit("")), 160)
    return F.concat_ws("\n", F.concat(F.lit("id: "), identifier), F.concat(F.lit("url: "), url), F.concat(F.lit("anchor: "), short(anchor)), F.concat(F.lit("context: "), short(snippet)), F.concat(F.lit("source: "), F.coalesce(source, F.lit(""))))


def source_line(title: Column, classification: Column, relevance: Column, summary: Column) -> Column:
    """A source page as its title, its verdict and the head of its summary."""
    verdict = F.when(classification.isNotNull(), F.format_string(" [%s %.2f]", classification, F.coalesce(relevance, F.lit(0.0)))).otherwise("")
    return F.concat(F.coalesce(title, F.lit("")), verdict, F.when(F.coalesce(summary, F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), shorten(summary, 60))))


def analysis_prompt(goal: str, url: Column, title: Column, text: Column, most: int = 3000) -> Column:
    return F.concat_ws("\n", F.lit(f"Goal: {goal}"), F.concat(F.lit("URL: "), url), F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), F.lit(""), F.left(text, F.lit(most)))


def rationale(score: Column, parts: dict[str, Column]) -> Column:
    """The score and its parts in one line."""
    shown = [F.concat(F.lit(f"{k}="), F.format_string("%.4f", v)) for k, v in parts.items()]
    return F.concat_ws(" ", F.concat(F.lit("rule_score="), F.format_string("%.4f", score)), *shown)
