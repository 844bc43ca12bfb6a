"""Quality rules whose cutoffs are chosen with a guarantee on falsely rejected documents."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("symbol_share", "pipe_share", "digit_share", "upper_share", "mean_word", "repeated_words", "repeated_lines", "log_words", "short_lines", "ends")


def features(text: Column) -> dict[str, Column]:
    """Measures of a text, each finite for any text; all by built-in expressions."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))

    def share(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))) / n

    words = F.split(F.lower(t), r"\s+")
    lines = F.split(t, "\n")
    n_words, n_lines = F.size(words), F.size(lines)
    return {
        "symbol_share": share("%#$&*@^~=+<>{}[]\\_"),
        "pipe_share": share("|"),
        "digit_share": share("0123456789"),
        "upper_share": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "mean_word": F.least(n / n_words, F.lit(40.0)) / 40,
        "repeated_words": 1 - F.size(F.array_distinct(words)) / n_words,
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / n_lines,
        "log_words": F.log(F.lit(1.0) + n_words) / 12,
        "short_lines": F.least(F.lit(1.0), n_lines * 20 / n),
        "ends": share(".!?;:,"),
    }


def binomial_upper(bad: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate of which bad among n were seen, wrong with chance delta."""
    if bad >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(bad + 1)]
    lo, hi = bad / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if p <= 0 or p >= 1:
            break
        a, b = math.log(p), math.log1p(-p)
        cdf = math.fsum(math.exp(c + i * a + (n - i) * b) for i, c in enumerate(logs))
        lo, hi = (p, hi) if cdf > delta else (lo, p)
    return hi


def cutoffs(scored: list[tuple[str | None, float, int]], alpha: float, delta: float, grid: int) -> dict[str | None, float]:
    """For each stratum the highest cutoff below which at most a share alpha of good documents lies.

    scored: (stratum, score, 1 for good) of the holdout. Cutoffs are tested from the lowest
    up, each at level delta / strata (Bonferroni over strata); the first that fails ends its
    stratum's sequence, so that testing in fixed order needs no further correction. With
    chance 1 - delta, no stratum's true false-rejection rate exceeds alpha. A stratum of
    which nothing can be certified gets -infinity: nothing is rejected there.
    """
    cuts = np.arange(1, grid) / grid  # fixed in advance, not taken from the holdout
    counts = {}
    for stratum in {s for s, _, _ in scored}:
        good = np.sort([x for s, x, y in scored if s == stratum and y == 1])
        counts[stratum] = (len(good), [int(i) for i in np.searchsorted(good, cuts)])  # rejected: score < cut
    return certified(counts, alpha, delta, grid)


def certified(counts: dict[str | None, tuple[int, list[int]]], alpha: float, delta: float, grid: int) -> dict[str | None, float]:
    """cutoffs() from each stratum's number of good documents, and of those below each cutoff of the grid."""
    out: dict[str | None, float] = {}
    for stratum, (n, below) in counts.items():
        best = -math.inf
        for cut, bad in zip(np.arange(1, grid) / grid, below):
            # The bound is never under the rate seen.
            if bad > alpha * n or binomial_upper(bad, n, delta / len(counts)) > alpha:
                break
            best = float(cut)
        out[stratum] = best
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression by Newton's method; the classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    beta = np.zeros(x.shape[1])
    eye = np.eye(x.shape[1]) * ridge
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + eye, x.T @ (w * (y - p)) - eye @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, max_labels: int = 20_000, grid: int = 50, ridge: float = 1e-4) -> tuple[Column, Column]:
    """(score, threshold) columns over docs: a document of lower score than threshold is rejected.

    A classifier of FEATURES is fitted to at most max_labels labelled documents: of one half,
    by a hash of their id, those of least other hash. All other labelled documents choose each
    stratum's (lang's) cutoff, counted per stratum and cutoff.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    fit = known.where(F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(2)) == 0).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(max_labels)
    f = features(F.col("text"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    # The sample is bounded by max_labels, so its ids may be broadcast whatever the corpus' size.
    rows = text.join(F.broadcast(fit), "doc_id").select("doc_id", "quality", *[c.cast("double").alias(n) for n, c in f.items()]).toPandas()
    x, y = rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(int)
    if not (y == 0).any() or not (y == 1).any():
        return F.lit(1.0), F.lit(float("-inf"))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    beta = _fit((x - mean) / scale, y, ridge)
    z = sum((f[n] - float(m)) / float(s) * float(b) for n, m, s, b in zip(FEATURES, mean, scale, beta)) + float(beta[-1])
    score = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    # Every document that was in the sample is out of the holdout, even if it repeats there.
    used = docs.sparkSession.createDataFrame([(int(i),) for i in rows["doc_id"].unique()], "doc_id long")
    held = known.join(F.broadcast(used), "doc_id", "left_anti").where("quality = 1").select("doc_id")
    good = _perhaps(text, held).select("doc_id", "lang", score.alias("score")).join(held, "doc_id")
    below = [F.count_if(F.col("score") < float(cut)).alias(f"below_{i}") for i, cut in enumerate(np.arange(1, grid) / grid)]
    counts = {r[0]: (r[1], list(r[2:])) for r in good.groupBy("lang").agg(F.count("*").alias("n"), *below).collect()}
    low = F.lit(float("-inf"))
    for stratum, cut in certified(counts, alpha, delta, grid).items():
        low = F.when(lang.eqNullSafe(F.lit(stratum)), F.lit(cut)).otherwise(low)
    return score, low


def _perhaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most of those whose doc_id is not in ids, so that few texts are measured in vain and none is shuffled.

    A filter of 2**25 bits whatever the number of ids: 4 MB are broadcast, and the more ids,
    the more others pass. No row with an id of ids is lost.
    """
    place = F.pmod(F.xxhash64("doc_id", F.lit("filter")), F.lit(1 << 25))
    part, at = F.shiftright(place, 15).alias("part"), F.pmod(place, F.lit(1 << 15))
    bits = ids.select(part, at.alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return docs.withColumn("part", part).join(F.broadcast(bits), "part").where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).drop("part", "bits")


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with score, threshold and kept; see rules() for options.

    docs: doc_id, text, and lang as the stratum where there is such a column. labels:
    doc_id, quality (1 good, 0 bad; others and nulls are ignored; of repeated labels the
    lowest counts). A document is rejected if its score is under its stratum's threshold.
    With chance 1 - delta the share of good documents rejected is at most alpha in every
    stratum; strata without enough labels (a null lang is one, too) reject nothing, and
    nor does a corpus without labels of either kind. A null or empty text is scored as an
    empty one. Rows are never merged; columns of docs with the names of the new ones are replaced.
    """
    score, low = rules(docs, labels, **options)
    # Exploded, as a filter on kept would else be pushed below the score and compute it again.
    return docs.withColumns({"score": F.explode(F.array(score)), "threshold": low}).withColumn("kept", F.col("score") >= F.col("threshold"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that scored() keeps, with the columns of docs."""
    score, low = rules(docs, labels, **options)
    return docs.where(score >= low)
