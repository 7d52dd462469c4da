"""Ranking stages: rule score, similarity, model answers, and how they combine.

A stage takes candidates and returns one decision for each: candidate_id,
url_key, priority, dropped, rationale, ranker.  Ties go by candidate_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json_text, scores, text

KEEP, BLEND_WEIGHT, THRESHOLD, CHUNK = 60, 0.8, 0.35, 30
DECISION = ("candidate_id", "url_key", "priority", "dropped", "rationale", "ranker")


def rule_scored(candidates: DataFrame, keywords: list[str], factors: dict[str, tuple[float, Column]] | None = None) -> DataFrame:
    """Candidates with all their columns and their priority: weighted factors, rounded."""
    return candidates.withColumn("priority", scores.round4(scores.weighted(scores.default_factors(keywords) if factors is None else factors)))


def rule_rank(candidates: DataFrame, keywords: list[str], threshold: float = THRESHOLD, factors: dict[str, tuple[float, Column]] | None = None) -> DataFrame:
    """Decisions by the rule score over a candidate and its source page; the rounded score is held against the threshold."""
    used = scores.default_factors(keywords) if factors is None else factors
    why = text.rationale(F.col("priority"), {k: scores.round4(v) for k, (_, v) in used.items()})
    return rule_scored(candidates, keywords, used).select("candidate_id", "url_key", "priority", (F.col("priority") < threshold).alias("dropped"), why.alias("rationale"), F.lit("rule").alias("ranker"))


def domain_prior(averages: DataFrame, hubs: DataFrame, floor: float = 0.75) -> DataFrame:
    """reg_domain and domain_prior: averages, hub domains at ``floor`` at least, the empty domain left out."""
    hubs = hubs.select("reg_domain").distinct().withColumn("hub", F.lit(floor))
    both = averages.select("reg_domain", "average").join(hubs, "reg_domain", "full").filter("reg_domain != ''")
    return both.select("reg_domain", F.greatest("average", "hub").alias("domain_prior"))


def similarity_rank(candidates: DataFrame, goal: DataFrame, keep: int = KEEP) -> DataFrame:
    """Cosine of ``vector`` with the goal's one ``goal_vector``; of all, the first ``keep`` stay.

    The goal is one row and joined by a constant key.  The first ``keep`` are
    found as a bounded top-n that each task starts by itself, so the ranking
    never gathers all candidates in one task.
    """
    one = goal.select("goal_vector").limit(1).withColumn("one", F.lit(1))
    near = candidates.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").withColumn("similarity", scores.round4(scores.cosine(F.col("vector"), F.col("goal_vector"))))
    best = near.orderBy(F.desc("similarity"), "candidate_id").limit(keep).select("candidate_id", F.lit(True).alias("kept"))
    out = near.join(F.broadcast(best), "candidate_id", "left")
    return out.select("candidate_id", "url_key", F.col("similarity").alias("priority"), F.col("kept").isNull().alias("dropped"), F.concat(F.lit("similarity="), F.format_string("%.4f", F.col("similarity"))).alias("rationale"), F.lit("embedding").alias("ranker"))


def survivors(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates that no decision drops; one without a decision stays."""
    return candidates.join(decisions.filter("dropped").select("candidate_id"), "candidate_id", "left_anti")


def blend(previous: DataFrame, new: DataFrame, weight: float = BLEND_WEIGHT) -> DataFrame:
    """New and previous priorities mixed; whether a candidate is dropped, and by whom, the new stage says where it has spoken."""
    p, n = previous.alias("p"), new.alias("n")
    both = p.join(n, F.col("p.candidate_id") == F.col("n.candidate_id"), "full")
    priority = F.when(F.col("n.priority").isNull(), F.col("p.priority")).when(F.col("p.priority").isNull(), F.col("n.priority")).otherwise(scores.blend(F.col("n.priority"), F.col("p.priority"), weight))
    return both.select(*[priority.alias(c) if c == "priority" else F.coalesce(F.col(f"n.{c}"), F.col(f"p.{c}")).alias(c) for c in DECISION])


def merge(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Previous decisions, replaced by new ones of the same candidate."""
    p, n = previous.alias("p"), new.alias("n")
    both = p.join(n, F.col("p.candidate_id") == F.col("n.candidate_id"), "left")
    spoken = F.col("n.candidate_id").isNotNull()
    return both.select(*[F.when(spoken, F.col(f"n.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in DECISION])


def answer_decisions(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Decisions from a model's JSON answers (chunk, content), for candidates with the chunk they were asked in.

    A ranked candidate gets its priority between 0 and 1; one listed to drop is
    dropped unless it is ranked too; one not named keeps 0.5; ids that were not
    asked for are passed over.  The last ranking of an id counts.
    """
    parsed = answers.select("chunk", json_text.json_block(F.col("content")).alias("data"))
    variant = F.try_parse_json("data")
    listed = F.coalesce(F.try_variant_get(variant, "$.rankings", "array<variant>"), F.array().cast("array<variant>"))
    ranked = parsed.select("chunk", F.posexplode(listed).alias("at", "r")).select(
        "chunk", "at", F.try_variant_get("r", "$.id", "string").alias("candidate_id"),
        F.when(~F.schema_of_variant(F.try_variant_get("r", "$.priority", "variant")).isin("BOOLEAN", "STRING"), F.try_variant_get("r", "$.priority", "double")).alias("p"),
        F.coalesce(F.trim(F.try_variant_get("r", "$.rationale", "string")), F.lit("")).alias("why"),
    ).filter("candidate_id != '' and p is not null")
    ranked = ranked.groupBy("chunk", "candidate_id").agg(F.max_by(F.struct("p", "why"), "at").alias("r"))
    dropped = parsed.select("chunk", F.explode(F.coalesce(F.try_variant_get(variant, "$.candidates_to_drop", "array<string>"), F.array().cast("array<string>"))).alias("candidate_id")).distinct().withColumn("drop", F.lit(True))
    out = candidates.join(ranked, ["chunk", "candidate_id"], "left").join(dropped, ["chunk", "candidate_id"], "left")
    score = scores.round4(scores.clamp01(F.col("r.p")))
    is_ranked, is_dropped = F.col("r").isNotNull(), F.col("drop").isNotNull()
    priority = F.when(is_ranked, score).when(is_dropped, 0.0).otherwise(0.5)
    why = F.when(is_ranked & (F.col("r.why") != ""), F.col("r.why")).when(is_ranked, F.concat(F.lit("llm_priority="), F.format_string("%.4f", score))).when(is_dropped, "llm_drop").otherwise("no_opinion")
    return out.select("candidate_id", "url_key", priority.alias("priority"), (~is_ranked & F.coalesce("drop", F.lit(False))).alias("dropped"), why.alias("rationale"), F.lit("llm").alias("ranker"))


def goal_vector(spark: SparkSession, statement: str, prompt: str, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """The goal's one vector, embedded once on the driver."""
    return spark.createDataFrame([(list(map(float, embedder([f"{statement} {prompt}".strip()])[0])),)], "goal_vector array<double>")


def chunked(candidates: DataFrame, size: int = CHUNK) -> DataFrame:
    """Candidates with the chunk they are asked in, by rank within their source page."""
    order = Window.partitionBy("source_page").orderBy("candidate_id")
    return candidates.withColumn("chunk", F.concat_ws("-", "source_page", F.floor((F.row_number().over(order) - 1) / size).cast("string")))


def ask(prompts: DataFrame, model: Callable[[str], str], attempts: int = 2) -> DataFrame:
    """(chunk, content, attempt, error) of a model's answers to (chunk, prompt); an answer that isn't JSON is asked for again."""

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            rows = []
            for chunk, prompt in zip(batch["chunk"], batch["prompt"], strict=True):
                content, error, attempt = None, None, 0
                while attempt < attempts:
                    attempt += 1
                    try:
                        content, error = model(prompt), None
                    except Exception as e:  # a service may fail in any way; the row says how
                        error = f"{type(e).__name__}: {e}"
                        continue
                    if content and "{" in content and "}" in content:
                        break
                rows.append((chunk, content, attempt, error))
            yield pd.DataFrame(rows, columns=["chunk", "content", "attempt", "error"])

    return prompts.select("chunk", "prompt").mapInPandas(run, "chunk string, content string, attempt int, error string")


def answered(answers: DataFrame) -> DataFrame:
    """Answers that came without an error and hold JSON."""
    return answers.filter(F.col("error").isNull() & F.try_parse_json(json_text.json_block(F.col("content"))).isNotNull())


def ranking_prompts(candidates: DataFrame, goal: str, seen: list[str] | None = None) -> DataFrame:
    """(chunk, prompt): the goal, up to five lines on pages seen, and the cards of a chunk's candidates, CHUNK of them at most."""
    head = "\n".join([f"Goal: {goal}", *(["Seen:", *(seen or [])[:5]] if seen else [])])
    card = text.candidate_card(F.col("candidate_id"), F.col("url"), F.col("anchor"), F.col("snippet"), F.col("source_title"))
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", card.alias("card")))), lambda x: x["card"]), "\n\n")
    return candidates.groupBy("chunk").agg(F.concat(F.lit(head + "\n\n"), cards).alias("prompt"))


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """(content_hash, vector, error) of (content_hash, text); the embedder gets lists of ``batch`` at most.

    A batch that it fails on, or gives a wrong number of vectors for, has none
    and says why; the others are not touched by it.
    """

    def run(batches: Iterator[pd.DataFrame]):
        for rows in batches:
            for low in range(0, len(rows), batch):
                part = rows.iloc[low : low + batch]
                try:
                    vectors, error = [list(map(float, v)) for v in embedder(part["text"].tolist())], None
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors of {len(part)} texts")
                except Exception as e:  # a service may fail in any way; the rows say how
                    vectors, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"content_hash": part["content_hash"].tolist(), "vector": vectors, "error": error})

    return texts.select("content_hash", "text").mapInPandas(run, "content_hash string, vector array<float>, error string")


def normalised(vector: Column) -> Column:
    """A vector of length 1, or as it is where it has none."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > 0, F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector)


def cached_vectors(texts: DataFrame, cache: DataFrame, embedder: Callable, dims: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of all texts, those of the cache where it has them with ``dims`` dimensions; and the new ones, to be added to it. Texts that the embedder failed on are in neither."""
    known = cache.filter(F.size("vector") == dims).select("content_hash", "vector")
    wanted = texts.select("content_hash", "text").dropDuplicates(["content_hash"])
    new = embed(wanted.join(known, "content_hash", "left_anti"), embedder).filter("vector is not null").drop("error")
    return wanted.select("content_hash").join(known.unionByName(new), "content_hash"), new


def with_vectors(candidates: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """Candidates with the unit vector of what an embedding sees of them; null where the embedder failed. Equal texts are embedded once."""
    part = lambda c: F.col(c) if c in candidates.columns else F.lit(None).cast("string")
    shown = text.embedding_text(part("text"), part("anchor"), part("snippet"), part("parent_heading"), part("source_title"), part("url" if "url" in candidates.columns else "canonical"))
    seen = candidates.withColumn("text_", shown).withColumn("content_hash", text.content_hash("", F.col("text_")))
    vectors = embed(seen.select("content_hash", F.col("text_").alias("text")).dropDuplicates(["content_hash"]), embedder, batch)
    return seen.drop("text_").join(vectors.select("content_hash", normalised(F.col("vector")).alias("vector")), "content_hash", "left").drop("content_hash")


def plan(candidates: DataFrame, keywords: list[str], goal: DataFrame | Callable[[], DataFrame] | None = None, model: Callable[[str], str] | None = None, prompt_goal: str = "", threshold: float = THRESHOLD, keep: int = KEEP, weight: float = BLEND_WEIGHT) -> DataFrame:
    """The funnel that the settings ask for: rules alone, rules and a model, or rules, similarity and perhaps a model.

    Without vectors the rules drop below the threshold, or a tenth below it
    before a model; with vectors they drop nothing and the first ``keep`` stay.
    A later stage sees the survivors of those before it.  Where it fails, what
    came before stands: a chunk that the model gave no answer to keeps its
    scores, a candidate without a vector (``with_vectors`` failed on its batch)
    keeps what the rules alone say, and so do all if ``goal`` raises.
    """
    strict = round(threshold - 0.1, 4) if model else threshold
    if goal is None:
        decisions = rule_rank(candidates, keywords, strict)
    else:
        try:
            vector = goal() if callable(goal) else goal
        except Exception:  # a service may fail in any way
            vector = None
        if vector is None:
            decisions = rule_rank(candidates, keywords, strict)
        else:
            seen, unseen = candidates.filter("vector is not null"), candidates.filter("vector is null")
            decisions = blend(rule_rank(seen, keywords, 0.0), similarity_rank(seen, vector, keep), weight).unionByName(rule_rank(unseen, keywords, strict))
    if model is not None:
        asked = chunked(survivors(candidates, decisions))
        answers = answered(ask(ranking_prompts(asked, prompt_goal), model))
        decisions = merge(decisions, answer_decisions(asked.join(answers.select("chunk"), "chunk", "left_semi"), answers))
    return decisions
