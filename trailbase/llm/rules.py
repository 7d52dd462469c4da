"""Quality rules whose cutoffs bound how many good documents each stratum loses.

A document is rejected if the rate of any rule lies above its stratum's cutoff.
Cutoffs come from labelled holdout rows.  For each stratum one fixed sequence
of cutoffs, the same for all rules together, is tested from the loosest to the
tightest: the hypothesis "more than ALPHA of the good documents are rejected"
is itself rejected only if the exact binomial tail of what the holdout shows is
at most DELTA / strata; the sequence ends at the first cutoff that fails.
Testing in a fixed order needs no further correction along the sequence, and
the division by the number of strata corrects for testing each, so with
probability 1 - DELTA no stratum loses more than ALPHA of its good documents.
A text is one trial of its stratum, however many rows or doc_ids have it, as
copies say nothing new; it is good if all labels that it has are.
A stratum with too few labels gets no cutoff and loses none: (1 - ALPHA)**n
must come down to DELTA / strata, which takes 217 good labels where there are
four strata and none of the good is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shape
from .workspace import Workspace

ALPHA, DELTA = 0.02, 0.05


def rates() -> dict:
    """Each rule's rate; more is worse."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols": ratio("n_symbols", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "bangs": ratio("n_bangs", "n_words"),
        "shouting": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
        "digits": ratio("n_digits", "word_chars"),
    }


#: The sequence of cutoffs tested, loosest first: the same for all rules.
CUTOFFS = [round(2.0 * 0.9**k, 6) for k in range(48)]


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials of probability p."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    gamma = np.vectorize(math.lgamma)
    logs = math.lgamma(n + 1) - gamma(i + 1.0) - gamma(n - i + 1.0) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def choose(histogram: np.ndarray, alpha: float, delta: float) -> float:
    """The tightest cutoff before the first failure. histogram[b]: good documents whose rate passes b of the CUTOFFS' upper parts."""
    n, best = int(histogram.sum()), math.inf
    above = np.cumsum(histogram[::-1])[::-1]
    for k, cutoff in enumerate(CUTOFFS):
        # Bin b holds rates above exactly the cutoffs from len - b on.
        lost = int(above[len(CUTOFFS) - k]) if k else int(histogram[len(CUTOFFS)])
        if n == 0 or tail(lost, n, alpha) > delta:
            break
        best = cutoff
    return best


def level() -> Column:
    """How many of CUTOFFS the worst rate of a document lies above."""
    worst = F.greatest(*rates().values())
    return F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: worst > c))


def stratum_of(name: str) -> Column:
    """A stratum's name; null is a stratum of its own, apart from the empty text."""
    return F.when(F.col(name).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def calibrate(work: Workspace, features: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum: stratum, n_good and cutoff (infinite: none).

    Labelled rows meet by their text's digest and become one trial; what is
    brought together then is a histogram of cutoffs for each stratum.  Both are
    reduced on the map side before they are exchanged.  The labels of all
    holdout rows take part; rows without a label don't.
    """
    verdicts = labels.groupBy("doc_id").agg(F.min("quality").alias("q"))
    trials = features.join(verdicts, "doc_id").groupBy(stratum_of(stratum).alias("stratum"), "digest_").agg(F.min("q").alias("q"), F.max(level()).alias("bin"))
    bins = trials.filter("q = 1").groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    bins = work.keep(bins, "bins")
    strata = max(1, bins.select("stratum").distinct().count())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        histogram = np.bincount(pdf.bin, weights=pdf.n, minlength=len(CUTOFFS) + 1).astype(int)
        return pd.DataFrame([(pdf.stratum.iloc[0], int(pdf.n.sum()), choose(histogram, alpha, delta / strata))], columns=["stratum", "n_good", "cutoff"])

    return bins.groupBy("stratum").applyInPandas(run, "stratum string, n_good long, cutoff double")


def apply_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, kept and failed_rule (null: none).

    One pass over the texts; its counts are written and read again for the
    cutoffs and the verdicts.  Null and empty texts have no words and fail the
    base; a null lang is a stratum of its own; rows with a null doc_id are
    judged but teach nothing; repeated rows are judged each, and teach once; a
    rate equal to the cutoff passes; texts of any length are counted whole; an
    empty table gives an empty result; further columns do no harm.
    """
    work = Workspace(spark, "rules")
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    features = work.keep(shape.measure(docs.select("doc_id", "text", "lang", digest.alias("digest_")), "lang", "digest_"), "features")
    holdout = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    limits = work.keep(calibrate(work, features.filter(holdout), labels, "lang", alpha, delta), "cutoffs")
    work.drop("bins")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = F.coalesce(*[F.when(rate > F.col("cutoff"), F.lit(r)) for r, rate in rates().items()])
    judged = features.withColumn("stratum", stratum_of("lang")).join(limits.select("stratum", "cutoff"), "stratum", "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & broken.isNull()).alias("kept"), broken.alias("failed_rule"))
