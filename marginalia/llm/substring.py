"""Substring dedup by super-k-mers of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import SPACE, U64, byte_range_hashes, chunks, flat, mix, range_hashes, ranges, words

_NO_ID = -(2**63)


def _minimisers(h: np.ndarray, k: int, m: int) -> np.ndarray:
    """The least hash of m consecutive words within each window of k words."""
    at = np.arange(len(h) - m + 1)
    low = range_hashes(h, at, at + m)
    width, have = k - m + 1, 1
    while have < width:  # minima of windows twice as wide, then of two that overlap
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


class _Windows:
    """The words of some texts, and the super-k-mers of their windows: each one's first word, number of windows and minimiser."""

    def __init__(self, texts: list[str | None], k: int, m: int):
        self.raw, at = flat(texts)
        buf = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends = words(buf, ~SPACE)
        self.run = self.windows = np.zeros(0, np.int64)
        self.low = np.zeros(0, np.uint64)
        if len(self.starts) < k:
            return
        self.h = byte_range_hashes(buf, self.starts, self.ends)
        doc = self.doc = np.searchsorted(at, self.starts, "right") - 1
        self.first = np.searchsorted(doc, np.arange(len(texts)))
        n = len(self.h) - k + 1
        valid = doc[:n] == doc[k - 1 :]
        low = _minimisers(self.h, k, m)
        fresh = np.ones(n, bool)
        fresh[1:] = (low[1:] != low[:-1]) | ~valid[:-1] | (doc[1:n] != doc[: n - 1])
        self.run = np.flatnonzero(valid & fresh)
        stop = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True))
        self.windows, self.low = stop - self.run + 1, low[self.run]


def _owners(ids: list[int | None]) -> np.ndarray:
    return np.array([_NO_ID if i is None else i for i in ids], np.int64)


def _prints(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of k words."""
    return range_hashes(h, at, at + k), range_hashes(mix(h ^ U64(0xD6E8FEB86659FD93)), at, at + k)


def _super_kmers(ids: list[int | None], texts: list[str | None], k: int, m: int, buckets: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each bucket one packed record: the super-k-mers' documents, first words, windows, byte lengths and texts; none for hot minimisers."""
    w = _Windows(texts, k, m)
    cold = ~np.isin(w.low, hot)
    raw, starts, ends, run, windows = w.raw, w.starts, w.ends, w.run[cold], w.windows[cold]
    if not len(run):
        return
    doc, first = w.doc, w.first
    bucket = w.low[cold] % U64(buckets)
    order = np.argsort(bucket, kind="stable")
    run, windows, bucket = run[order], windows[order], bucket[order]
    a, b = starts[run], ends[run + windows + k - 2]
    owner = _owners(ids)[doc[run]]
    place = (run - first[doc[run]]).astype(np.int32)
    pack = zstandard.ZstdCompressor(level=1)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for i, j in zip(cut, np.append(cut[1:], len(bucket))):
        body = b"".join([raw[x:y] for x, y in zip(a[i:j].tolist(), b[i:j].tolist())])
        head = np.array([j - i], np.int32).tobytes() + owner[i:j].tobytes() + place[i:j].tobytes() + windows[i:j].astype(np.int32).tobytes() + (b[i:j] - a[i:j]).astype(np.int32).tobytes()
        yield int(bucket[i]), pack.compress(head + body)


def _often(k: int, m: int, least: float):
    """(minimiser, windows) of those that have so many windows in a chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in chunks(texts, 4_000_000):
                w = _Windows(texts[i:j], k, m)
                low, at = np.unique(w.low, return_inverse=True)
                n = np.bincount(at, w.windows, len(low)).astype(np.int64)
                many = n >= least
                if many.any():
                    yield pa.RecordBatch.from_arrays([pa.array(low[many].view(np.int64)), pa.array(n[many])], ["low", "n"])

    return run


def _hot_windows(k: int, m: int, hot: np.ndarray):
    """A row for each window of a hot minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, j in chunks(texts, 1_000_000):
                w = _Windows(texts[i:j], k, m)
                mine = np.isin(w.low, hot)
                at = ranges(w.run[mine], w.windows[mine])
                if len(at):
                    one, two = _prints(w.h, at, k)
                    own = _owners(ids[i:j])[w.doc[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(own), pa.array(at - w.first[w.doc[at]])], ["one", "two", "doc_id", "start_word"])

    return run


def _emit(k: int, m: int, buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for i, j in chunks(texts, 4_000_000):
                found = list(_super_kmers(ids[i:j], texts[i:j], k, m, buckets, hot))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], ["bucket", "packed"])

    return run


def _count(k: int):
    """Within a bucket: sort all windows, and give the runs of those that occur again."""

    def run(table: pa.Table) -> pa.Table:
        heads: list[list[np.ndarray]] = [[], [], [], []]
        bodies = []
        unpack = zstandard.ZstdDecompressor()
        for blob in table.column("packed").to_pylist():
            raw = unpack.decompress(blob)
            n = int(np.frombuffer(raw, np.int32, 1)[0])
            at = 4
            for x, kind in zip(heads, (np.int64, np.int32, np.int32, np.int32)):
                x.append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            bodies.append(raw[at:])
        doc, place, windows, size = (np.concatenate(x) for x in heads)
        # The super-k-mers' texts follow each other without a gap, so their borders part words too.
        buf = np.frombuffer(b"".join(bodies), np.uint8)
        del bodies
        end_at = np.cumsum(size.astype(np.int64))
        flag = np.zeros(len(buf) + 1, np.int8)
        flag[:-1] = ~SPACE[buf]
        before = np.append(0, flag[:-1])
        before[end_at - size] = 0
        starts = np.flatnonzero((flag == 1) & (before == 0))
        after = np.append(flag[1:], 0)
        after[end_at - 1] = 0
        ends = np.flatnonzero((flag == 1) & (after == 0)) + 1
        h = byte_range_hashes(buf, starts, ends)
        first = np.searchsorted(starts, end_at - size)
        windows = windows.astype(np.int64)
        at = ranges(first, windows)
        one, two = _prints(h, at, k)
        owner = np.repeat(np.arange(len(doc)), windows)
        start = place[owner] + (at - first[owner])
        order = np.argsort(one, kind="stable")
        same = one[order][1:] == one[order][:-1]
        if (same & (two[order][1:] != two[order][:-1])).any():
            order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        group = np.append(0, np.cumsum(~same))
        copies = np.bincount(group)[group]
        again = copies > 1
        order, group, copies = order[again], group[again], copies[again]
        # The earliest of each group of equal windows is the one to keep.
        rank = np.lexsort((start[order], doc[owner[order]], group))
        order, group, copies = order[rank], group[rank], copies[rank]
        earliest = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
        back = np.argsort(order, kind="stable")
        order, copies, earliest = order[back], copies[back], earliest[back]
        own, s = owner[order], start[order]
        cut = np.ones(len(order), bool)
        cut[1:] = (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1) | (earliest[1:] != earliest[:-1])
        i = np.flatnonzero(cut)
        if not len(i):
            i = np.zeros(0, np.int64)
            most = last = i
        else:
            most = np.maximum.reduceat(copies, i)
            last = np.append(i[1:], len(order)) - 1
        ids = doc[own[i]]
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == _NO_ID), "start_word": pa.array(s[i], pa.int64()), "end_word": pa.array(s[last] + k, pa.int64()), "copies": pa.array(most, pa.int64()), "is_first": pa.array(earliest[i], pa.bool_())})

    return run


def _hot_runs(text: DataFrame, k: int, m: int, hot: np.ndarray) -> DataFrame:
    """What _count() gives, for the windows of hot minimisers, each as a run of its own.

    A window's count and earliest place are taken before rows are shuffled; those that occur
    again are joined back to their places, where a skewed key is split as it is joined.
    """
    rows = text.mapInArrow(_hot_windows(k, m, hot), "one long, two long, doc_id long, start_word long")
    again = rows.groupBy("one", "two").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "start_word")).alias("first")).where("copies > 1")
    first = F.struct("doc_id", "start_word") == F.col("first")
    # Rows that share even their place are no earlier than each other; then all are the first.
    return rows.join(again, ["one", "two"]).select(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "start_word", (F.col("start_word") + k).alias("end_word"), "copies", first.alias("is_first"))


def repeated_spans(docs: DataFrame, k: int = 50, m: int = 8, bucket_chars: int = 2_000_000, hot_windows: int = 1_000_000) -> DataFrame:
    """Passages of k or more words that occur more than once in the corpus, as spans of each document.

    docs: doc_id BIGINT and text; other columns are not read. A word is a maximal run of
    bytes other than ASCII white space and NUL, compared exactly. Every window of k words is
    counted over the whole corpus: consecutive windows with the same minimiser (least hash
    of m words) travel as one packed string to that minimiser's bucket, and there windows
    are sorted by a 128-bit fingerprint of their words. There is a bucket for each
    bucket_chars characters of the corpus; minimisers of more than hot_windows windows
    (and perhaps some of half as many) have none, and their windows are counted as rows.

    Returns (doc_id, start_word, end_word, copies, is_first): the union of overlapping or
    touching repeated windows, words counted from 0 with the end exclusive; copies is the
    largest count of any window of the span; is_first tells spans whose windows are the
    earliest occurrence by (doc_id, position) from later ones, which may be removed.

    Texts that are null, empty or under k words give no rows; an empty table gives none. Rows
    without a doc_id count as one document that comes first, with null as its id. Repeated
    rows are repeated passages; rows that share a doc_id share their spans, and where even
    positions tie, one or all of the tied windows are the first.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_chars))
    # A chunk reports minimisers from its share of half the bound on, so that all that go unreported are under that half.
    least = hot_windows / 2 / max(1, size / 4_000_000)
    few = text.mapInArrow(_often(k, m, least), "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") > hot_windows / 2)
    # Hot ones are few: each has so many of the corpus' windows.
    hot = np.array([r["low"] for r in few.collect()], np.int64).view(np.uint64)
    packed = text.mapInArrow(_emit(k, m, buckets, hot), "bucket int, packed binary")
    runs = packed.groupBy("bucket").applyInArrow(_count(k), "doc_id long, start_word long, end_word long, copies long, is_first boolean")
    if len(hot):
        runs = runs.unionByName(_hot_runs(text, k, m, hot))
    by = Window.partitionBy("doc_id", "is_first").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("fresh", F.when(F.col("start_word") <= reach, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "is_first", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.max("copies").alias("copies")).select("doc_id", "start_word", "end_word", "copies", "is_first")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x00\t\n\x0B\f\r ]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i - 1 AS s, array_to_string(ws[i : i + 49], ' ') AS body FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
counted AS (SELECT doc_id, s, count(*) OVER (PARTITION BY body) AS copies, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) = 1 AS is_first FROM win),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id, is_first ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM counted WHERE copies > 1),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, is_first ORDER BY s) AS island FROM marked)
SELECT doc_id, min(s) AS start_word, max(s) + 50 AS end_word, max(copies) AS copies, is_first FROM grouped GROUP BY doc_id, is_first, island
"""
