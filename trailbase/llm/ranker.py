"""A quality classifier from pairwise preferences (Bradley-Terry).

The probability that a good document beats a bad one is the logistic function
of the difference of their scores, and a score is linear in a document's
features.  Weights minimise the logistic loss over pairs of one good and one
bad labelled document, on feature differences.  The cut between two scores that
tells most labels right becomes the threshold, and the score shown is the
logistic function of the distance from it, moved so that the threshold shows
as 0.7.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shape
from .workspace import Workspace

#: Most labelled rows that a fit uses, chosen by a hash of doc_id, and pairs drawn from them.
MOST_ROWS, MOST_PAIRS = 40_000, 200_000
CUT = 0.7


def features() -> dict[str, Column]:
    """Features of a row of shape.measure; none comes from labels, lang, source or doc_id."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    root = lambda a, b: F.sqrt(per(a, b))
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    return {
        "symbols": per("n_symbols", "n_words"), "symbols_root": root("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"), "dup_lines_root": root("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"), "repeats_root": root("n_repeat_words", "n_words"),
        "bangs": per("n_bangs", "n_words"), "bangs_root": root("n_bangs", "n_words"),
        "upper": F.col("n_upper") / letters, "upper_root": F.sqrt(F.col("n_upper") / letters),
        "digits": per("n_digits", "word_chars"), "digits_root": root("n_digits", "word_chars"),
        "marks": per("n_marks", "n_words"), "marks_root": root("n_marks", "n_words"),
        "word_length": per("word_chars", "n_words"),
        "distinct": per("n_distinct_words", "n_words"), "distinct_by_length": F.log1p("n_distinct_words") / F.greatest(F.log1p("n_words"), F.lit(1.0)),
        "length": F.log1p("n_words"), "short": (F.col("n_words") < 10).cast("double"), "few": (F.col("n_words") < 30).cast("double"),
        "line_length": F.log1p(per("n_words", "n_lines")), "empty": (F.col("n_words") == 0).cast("double"),
    }


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    shift: float
    threshold: float

    def raw(self) -> Column:
        return sum((F.lit(w) * x for w, x in zip(self.weights, features().values(), strict=True)), F.lit(self.shift))

    def score(self) -> Column:
        """0 to 1, and 0.7 at the threshold."""
        offset = math.log(CUT / (1 - CUT))
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), self.raw() - F.lit(self.threshold) + F.lit(offset)))
        return 1 / (1 + F.exp(-z))


def fit_pairs(good: np.ndarray, bad: np.ndarray, most_pairs: int = MOST_PAIRS, ridge: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of standardised features from pairs, by Newton steps on the logistic loss of differences."""
    draw = np.random.default_rng(seed)
    x = good[draw.integers(len(good), size=most_pairs)] - bad[draw.integers(len(bad), size=most_pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = -(x * (1 - p)[:, None]).mean(0) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: np.ndarray, quality: np.ndarray) -> Model:
    """A model from features and labels 0/1; with one label alone every document scores as that label."""
    n = len(features())
    if not len(rows) or quality.min() == quality.max():
        return Model((0.0,) * n, 0.0, -2.0 if not len(rows) or quality.max() == 1 else 2.0)
    mean, spread = rows.mean(0), rows.std(0)
    spread[spread == 0] = 1.0
    x = (rows - mean) / spread
    w = fit_pairs(x[quality == 1], x[quality == 0])
    s = x @ w
    # Of all cuts between neighbouring scores, and beyond both ends, the one that tells the labels apart best; of equals, the middle one.
    seen = np.unique(s)
    cuts = np.r_[seen[0] - 1, (seen[1:] + seen[:-1]) / 2, seen[-1] + 1]
    order = np.sort(s[quality == 1]), np.sort(s[quality == 0])
    right = (len(order[0]) - np.searchsorted(order[0], cuts)) + np.searchsorted(order[1], cuts)
    best = np.flatnonzero(right == right.max())
    return Model(tuple(float(v) for v in w / spread), float(-(w / spread) @ mean), float(cuts[best[len(best) // 2]]))


def train(measured: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fit on at most most_rows labelled rows, those of least hash; rows whose crc32(doc_id) mod 4 is 2 are held out.

    Null labels and null doc_ids teach nothing; of several labels of a
    document the least counts.
    """
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label_"))
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    named = features()
    sample = (
        measured.join(known, "doc_id").filter(learn)
        .select("label_", F.xxhash64("doc_id").alias("h_"), *[x.cast("double").alias(k) for k, x in named.items()])
        .orderBy("h_", *named).limit(most_rows).toPandas()
    )
    return fit(sample[list(named)].to_numpy(float), sample["label_"].to_numpy(int))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score and predicted (1: quality).

    One pass over the texts; its counts are written and read again, for the
    fit and for the scores.  Null and empty texts are scored by their (zero)
    counts; a null doc_id gives a null held_out; repeated rows score alike, and
    equal texts too, so ties lie on one side of the cut.  A text of any length
    is counted whole in one task.  Further columns are left out; an empty table
    gives an empty result.
    """
    work = Workspace(spark, "ranker")
    measured = work.keep(shape.measure(docs), "measured")
    model = train(measured, labels, most_rows)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return measured.select("doc_id", held.alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of docs that the classifier predicts as quality, with all their columns.

    Two passes and no exchange of texts: counts for the fit, and counts beside
    each row for its score.  Null and empty texts are judged by their (zero)
    counts, rows with a null doc_id and repeated rows like any other; a score
    equal to the cut stays; without labels all rows stay; columns of any name
    are kept; an empty table gives an empty result.
    """
    model = train(shape.measure(docs), labels, most_rows)
    hidden = docs.withColumn("row_", F.struct(*[F.col(c) for c in docs.columns])).select("doc_id", "text", "row_")
    return shape.measure(hidden, "row_").filter(model.score() >= CUT).select("row_.*")
