"""Shards of even size out of indivisible groups, by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import written


def differencing(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions into one.

    parts: a row for each, of its bins' sizes in descending order. Repeatedly the two of largest
    spread (largest minus least bin) are combined, the largest bins of the one with the
    least of the other; ties go to the earlier. Returns the final bins' sizes in
    descending order, and for each part the final bin of each of its own.
    """
    n, k = parts.shape
    if n == 0:
        return np.zeros(k, np.int64), np.zeros((0, k), np.int64)
    sums = list(parts.astype(np.int64))
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[a] = sums[b] = None
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(total[0] - total[-1]), len(sums)))
        sums.append(total)
    to: list = [None] * len(sums)
    to[-1] = np.arange(k)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        back = np.empty(k, np.int64)
        back[order] = to[node]  # the final bin of each bin before it was sorted
        to[a], to[b] = back, back[::-1]
        to[node] = None
    return sums[-1], np.array(to[:n])


def _local(shards: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "unit"], ascending=[False, True], kind="stable")
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf["bytes"]
        _, to = differencing(parts)
        return pd.DataFrame({"part": key[0], "bin": to[:, 0], "unit": pdf["unit"].to_numpy(), "bytes": pdf["bytes"].to_numpy()})

    return run


def _combine(shards: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["part", "bytes", "bin"], ascending=[True, False, True], kind="stable")
        names = order["part"].unique()
        sizes, bins = np.zeros((len(names), shards), np.int64), np.full((len(names), shards), -1)
        for i, (_, own) in enumerate(order.groupby("part", sort=True)):
            sizes[i, : len(own)], bins[i, : len(own)] = own["bytes"], own["bin"]
        _, to = differencing(sizes)
        at = np.nonzero(bins >= 0)
        return pd.DataFrame({"level": key[0], "part": names[at[0]], "bin": bins[at], "shard": to[at]})

    return run


def assign(units: DataFrame, shards: int, fan_in: int = 512, group_cells: int = 1 << 20) -> DataFrame:
    """(unit, bytes, shard) for units (unit BIGINT, distinct; bytes BIGINT).

    Groups of units, as many as keep group_cells units times shards in each, are differenced
    into one partial partition each; then up to fan_in of those at a time are differenced
    further, until there is one. A null unit is one like others, null bytes are none; no units give no rows.
    """
    units = written(units.select("unit", F.coalesce("bytes", F.lit(0)).alias("bytes")), "sizes")
    n = max(1, -(-units.count() * shards // group_cells))
    local = written(units.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(n)).cast("int")).groupBy("part").applyInPandas(_local(shards), "part int, bin int, unit long, bytes long"), "units")
    sums = local.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes"))
    at = local.select("part", "bin").distinct().select("part", "bin", F.col("part").alias("now"), F.col("bin").alias("shard"))
    while True:
        last = n <= fan_in
        up = sums.withColumn("level", F.lit(0) if last else (F.col("part") / fan_in).cast("int"))
        moved = written(up.groupBy("level").applyInPandas(_combine(shards), "level int, part int, bin int, shard int"), "shards")
        step = moved.select(F.col("part").alias("now"), F.col("bin").alias("shard"), F.col("level").alias("next"), F.col("shard").alias("to"))
        at = written(at.join(step, ["now", "shard"]).select("part", "bin", F.col("next").alias("now"), F.col("to").alias("shard")), "placed")
        if last:
            return local.join(at.select("part", "bin", "shard"), ["part", "bin"]).select("unit", "bytes", "shard")
        sums = sums.join(moved.drop("level").withColumnRenamed("shard", "to"), ["part", "bin"]).groupBy((F.col("part") / fan_in).cast("int").alias("part"), F.col("to").alias("bin")).agg(F.sum("bytes").alias("bytes"))
        n = -(-n // fan_in)


def shard(docs: DataFrame, shards: int = 64, group: Column | None = None) -> DataFrame:
    """(doc_id, shard, group_bytes): documents in shards of even bytes, groups undivided.

    docs: doc_id BIGINT and text; other columns are not read unless group names them. group: what
    must stay together, by default exact copies of a text, so that each shard holds
    all of them. Sizes are the texts' UTF-8 bytes; null and empty texts have none and
    are a group each. Groups are told apart by a 64-bit hash. shard counts from 0, the
    fullest. One row for each row of docs, also for repeated ones and those without an id;
    an empty table gives none.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = docs.select("doc_id", F.xxhash64(F.col("text") if group is None else group).alias("unit"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    placed = assign(rows.groupBy("unit").agg(F.sum("bytes").alias("bytes")), shards)
    return rows.select("doc_id", "unit").join(placed, "unit").select("doc_id", "shard", F.col("bytes").alias("group_bytes"))
