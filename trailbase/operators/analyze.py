"""Judging pages with a model, and the goal that they are judged by."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, json_text, text
from .rank import ask
from .store import unjudged

MOST_KEYWORDS, ATTEMPTS = 12, 3


@dataclass(frozen=True)
class Goal:
    """What a run looks for. The id follows from the prompt, so the same prompt is the same goal."""

    prompt: str
    statement: str = ""
    keywords: tuple[str, ...] = ()
    since: datetime.datetime | None = None

    @property
    def goal_id(self) -> str:
        import hashlib

        return hashlib.sha256(self.prompt.encode()).hexdigest()[:12]


def plain_keywords(prompt: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"\w+", prompt.lower())))


def goal_from_answer(prompt: str, content: str | None, now: datetime.datetime) -> Goal:
    """A goal out of a model's JSON; what is missing or odd falls back to the prompt."""
    found = re.search(r"\{.*\}", content or "", re.DOTALL)
    data = None
    for block in (found[0], re.sub(r",\s*([}\]])", r"\1", found[0])) if found else ():
        try:
            data = json.loads(block)
            break
        except ValueError:
            continue
    data = data if isinstance(data, dict) else {}
    statement, words = data.get("goal_statement"), data.get("keywords")
    trimmed = (w.strip() for w in words if isinstance(w, str)) if isinstance(words, list) else ()
    keywords = tuple(w for w in dict.fromkeys(trimmed) if w)[:MOST_KEYWORDS]
    since = data.get("since")
    return Goal(prompt, statement.strip() if isinstance(statement, str) else "", keywords or plain_keywords(prompt), dates.recent_since(since if isinstance(since, str) else None, now))


def enhance(prompt: str, model: Callable[[str], str] | None, now: datetime.datetime) -> Goal:
    """One call to the model, if there is one; any failure leaves the plain goal."""
    try:
        content = model(f"Goal: {prompt}\nToday: {now:%Y-%m-%d}") if model else None
    except Exception:  # the goal can do without the service
        content = None
    return goal_from_answer(prompt, content, now)


def analyze(pages: DataFrame, goal: Goal, model: Callable[[str], str], prompt_version: str = "v1", model_name: str = "", most: int = 3000, attempts: int = ATTEMPTS) -> DataFrame:
    """Analyses of pages (url_key, canonical, title, plain_text, perhaps markdown), and what failed.

    outcome: ok, empty (no text, not asked) or failed (no JSON in so many attempts, one right after the other).
    """
    body = text.first_text(F.col("plain_text"), F.col("markdown") if "markdown" in pages.columns else F.lit(None).cast("string"))
    asked = pages.select("url_key", "canonical", F.coalesce("title", F.lit("")).alias("title"), body.alias("body"))
    prompt = text.analysis_prompt(goal.statement or goal.prompt, F.col("canonical"), F.col("title"), F.col("body"), most)
    answers = ask(asked.filter("body is not null").select(F.col("url_key").alias("chunk"), prompt.alias("prompt")), model, attempts)
    data = json_text.json_block(F.col("content"))
    found = asked.join(answers.select(F.col("chunk").alias("url_key"), data.alias("data"), "attempt", "error"), "url_key", "left")
    outcome = F.when(F.col("body").isNull(), "empty").when(F.col("data").isNull(), "failed").otherwise("ok")
    analysis = F.when(F.col("data").isNotNull(), json_text.parse_analysis(F.col("data")))
    return found.select("url_key", F.lit(goal.goal_id).alias("goal_id"), F.lit(prompt_version).alias("prompt_version"), F.lit(model_name).alias("model"), outcome.alias("outcome"), analysis.alias("a"), "attempt", "error").select("url_key", "goal_id", "prompt_version", "model", "outcome", "a.*", "attempt", "error")


def replay(pages: DataFrame, analyses: DataFrame, goal: Goal, model: Callable[[str], str], prompt_version: str = "v1", model_name: str = "", force: bool = False, limit: int | None = None) -> DataFrame:
    """Analyses of the pages that have none of this identity (all, if forced), the first ``limit`` by fetched_seq."""
    work = pages if force else unjudged(pages, analyses, goal.goal_id, prompt_version, model_name)
    if limit is not None:
        work = work.orderBy("fetched_seq").limit(limit)
    return analyze(work, goal, model, prompt_version, model_name)
