"""Mixing sources to target token weights by entropy balancing."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import written

#: Cells (combinations of constraint values) up to which their rates are broadcast; about 10 MB.
FEW_CELLS = 100_000


def tokens(docs: DataFrame) -> Column:
    """A document's size in tokens: its white-space words, one at least."""
    return F.greatest(F.lit(1), F.size(F.split(F.trim(F.coalesce(F.col("text"), F.lit(""))), r"\s+"))).cast("long")


def _value(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def _cells(docs: DataFrame, by: list[str], size: Column) -> DataFrame:
    """(v_0, v_1, ..., tokens): tokens of each combination of the constrained columns' values, all that the dual needs to know."""
    return docs.select(*[_value(c).alias(f"v_{i}") for i, c in enumerate(by)], size.alias("tokens")).groupBy(*[f"v_{i}" for i in range(len(by))]).agg(F.sum("tokens").cast("double").alias("tokens"))


def _shares(cells: DataFrame, value: str, weights: dict[str, float] | float) -> dict[str, float]:
    """Target shares of a column's values; a number is the exponent by which the corpus' own shares are flattened."""
    have = {r[0]: r[1] for r in cells.groupBy(value).agg(F.sum("tokens")).collect()}
    want = {v: (weights.get(v, 0.0) if isinstance(weights, dict) else n**weights) for v, n in have.items()}
    total = sum(want.values())
    return {v: (x / total if total else n / sum(have.values())) for (v, x), n in zip(want.items(), have.values())}


def balance(cells: DataFrame, targets: list[dict[str, float]], steps: int = 50, tolerance: float = 1e-6, ridge: float = 1e-9) -> list[dict[str, float]]:
    """The dual's multipliers, one for each value of each constrained column.

    Minimises sum(tokens * exp(l(v1) + l(v2) + ...)) / total - sum(share * l) by Newton's
    method with step halving; each iteration's value, gradient and Hessian are sums over
    the cells, computed by Spark in one aggregate. The driver holds a matrix of as many rows and
    columns as there are values. Values of share 0 are left out of the
    dual: their rate is 0. At the optimum the tilted tokens have the target shares; a warning
    tells by how much they miss them where `steps` end before that, as with targets that contradict each other.
    """
    spark = cells.sparkSession
    by = range(len(targets))
    keys = [(c, v) for c in by for v, s in targets[c].items() if s > 0]
    if not keys:
        return [{} for _ in by]
    index = {k: i for i, k in enumerate(keys)}
    share = np.array([targets[c][v] for c, v in keys])
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    for c in by:
        at = spark.createDataFrame([(v, index[c, v]) for v, s in targets[c].items() if s > 0], f"v_{c} string, i_{c} int")
        cells = cells.join(at, f"v_{c}")
    lam = np.zeros(len(keys))

    def tilted(x: np.ndarray) -> DataFrame:
        values = F.lit(x.tolist())
        return cells.select(F.array(*[f"i_{c}" for c in by]).alias("at"), (F.col("tokens") / total * F.exp(sum(F.get(values, f"i_{c}") for c in by))).alias("w"))

    def moments(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        pairs = tilted(x).select("w", F.explode("at").alias("i"), "at").select("w", "i", F.explode("at").alias("j")).groupBy("i", "j").agg(F.sum("w").alias("w")).collect()
        hess = np.zeros((len(keys), len(keys)))
        for i, j, w in pairs:
            hess[i, j] = w
        grad = np.diag(hess).copy()
        return grad[: len([k for k in keys if k[0] == 0])].sum() - share @ x, grad - share, hess

    value, grad, hess = moments(lam)
    for _ in range(steps):
        if np.abs(grad).max() <= tolerance:
            break
        step = np.linalg.solve(hess + ridge * np.eye(len(keys)), -grad)
        size = 1.0
        while True:
            new = moments(lam + size * step)
            if new[0] <= value + 1e-4 * size * (grad @ step) + 1e-12 or size < 1e-4:
                break
            size /= 2
        lam = lam + size * step
        value, grad, hess = new
    if np.abs(grad).max() > tolerance:
        warnings.warn(f"the token shares miss their targets by up to {np.abs(grad).max():.2g}", stacklevel=2)
    return [{v: float(lam[index[c, v]]) for v, s in targets[c].items() if s > 0} for c in by]


def rates(docs: DataFrame, targets: dict[str, dict[str, float] | float], budget: float | None = None, floor: float | None = None, **options) -> DataFrame:
    """docs with tokens, rate and copies; columns of docs with these names are replaced.

    docs: doc_id, text and the constrained columns. targets: for each column either the
    weight of each of its values (values not named get none), or an exponent that flattens
    the corpus' own token shares. Null values count as ''. The rates are those closest to 1
    in relative entropy, weighted by tokens, that meet all token shares together (as
    nearly as can be, where the targets contradict each other), scaled so that all have
    `budget` tokens (as many as the corpus by default) or, where floor is given, so that
    the least positive rate is floor: with 1, no document of a wanted value is dropped. Copies
    are the rate rounded up or down by the hash of doc_id and text, unbiased; rows that
    repeat both get the same number. A null or empty text has one token; an empty table gives no rows.
    """
    rows = _rated(docs, targets, budget, floor, **options)
    own = [c for c in docs.columns if c not in ("tokens", "rate", "copies")]
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in own], F.col("size").alias("tokens"), "rate", "copies")


def _rated(docs: DataFrame, targets: dict[str, dict[str, float] | float], budget: float | None, floor: float | None, **options) -> DataFrame:
    """(row, size, rate, copies), row being all columns of docs, so that none can clash with the others."""
    by = list(targets)
    cells = written(_cells(docs, by, tokens(docs)), "cells")
    lam = balance(cells, [_shares(cells, f"v_{i}", w) for i, w in enumerate(targets.values())], **options)
    spark = docs.sparkSession
    rated = cells
    for i in range(len(by)):
        rated = rated.join(spark.createDataFrame(list(lam[i].items()), f"v_{i} string, l_{i} double"), f"v_{i}", "left")
    rated = rated.withColumn("rate", F.coalesce(F.exp(sum(F.col(f"l_{i}") for i in range(len(by)))), F.lit(0.0)))
    spent, total, least, n = rated.agg(F.sum(F.col("rate") * F.col("tokens")), F.sum("tokens"), F.min(F.when(F.col("rate") > 0, F.col("rate"))), F.count("*")).first()
    scale = floor / least if floor and least else (budget or total or 1.0) / spent if spent else 1.0
    # Cells are as many as the combinations of values that occur. While they are few they travel to the
    # documents, whose hot sources then need not meet in one task; beyond that both sides are shuffled.
    rated = rated.select(*[F.col(f"v_{i}").alias(f"of_{i}") for i in range(len(by))], (F.col("rate") * scale).alias("rate"))
    rated = F.broadcast(rated) if n <= FEW_CELLS else rated
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[_value(c).alias(f"v_{i}") for i, c in enumerate(by)], tokens(docs).alias("size"))
    cond = F.lit(True)
    for i in range(len(by)):
        cond = cond & (F.col(f"v_{i}") == F.col(f"of_{i}"))
    u = F.pmod(F.xxhash64(F.col("row.doc_id"), F.col("row.text"), F.lit("copies")), F.lit(1 << 40)) / float(1 << 40)
    below = F.floor(F.col("rate") + 1e-9)  # a rate that should be whole may be a hair below
    return whole.join(rated, cond).select("row", "size", "rate", (below + (u < F.col("rate") - below).cast("long")).alias("copies"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float] | float], budget: float | None = None, floor: float | None = None, **options) -> DataFrame:
    """Each document as many times as its copies, with the columns of docs, as they are; see rates(), also for nulls, repeated rows and empty tables."""
    rows = _rated(docs, targets, budget, floor, **options)
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
