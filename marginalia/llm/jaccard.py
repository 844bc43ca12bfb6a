"""Similarity join of documents by the Jaccard index of their word n-grams: chosen-path join."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import ALNUM, U64, byte_range_hashes, chunks, drop_written, flat, mix, partitions, range_hashes, words, written

#: Coordinates of a signature.
T = 64
#: Standard deviations below what is expected at the threshold, under which a candidate's signatures may not agree: one pair in over a million.
SURE = 5.0
#: Pairs that a task holds at once, and that one task verifies; sets that it holds for that.
HELD, VERIFIED, SETS = 500_000, 1_000_000, 10_000
_PATH = "path long, rid long, kin long, sig binary"
_CAND = "home long, a long, b long"
_SETS = "rid long, doc_id long, sig binary, members binary"


def _shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct n-gram hashes, sorted, in one flat array; which texts have any, and where theirs begin."""
    raw, at = flat([t.lower() if t else t for t in texts])
    buf = np.frombuffer(raw, np.uint8)
    starts, ends = words(buf, ALNUM)
    h = byte_range_hashes(buf, starts, ends)
    doc = np.searchsorted(at, starts, "right") - 1
    have, first, count = np.unique(doc, return_index=True, return_counts=True)
    size = np.minimum(n, np.repeat(count, count))  # a text under n words has one n-gram, of all of them
    begin = np.arange(len(h))
    fits = begin + size <= np.repeat(first + count, count)
    begin, size, doc = begin[fits], size[fits], doc[fits]
    gram = (range_hashes(h, begin, begin + size) >> U64(32)).astype(np.uint64)
    both = np.unique((doc.astype(np.uint64) << U64(32)) | gram)
    owner = (both >> U64(32)).astype(np.int64)
    have, first = np.unique(owner, return_index=True)
    return both.astype(np.uint32), have, first


@functools.cache
def _hashes(draw: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash functions of a draw of coordinates."""
    rng = np.random.default_rng([715517, draw])
    return rng.integers(0, 2**31, T, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, T, dtype=np.uint32)


def _signatures(flatset: np.ndarray, first: np.ndarray, draw: int = 0) -> np.ndarray:
    mul, xor = _hashes(draw)
    out = np.empty((len(first), T), np.uint32)
    for j in range(T):
        v = flatset ^ xor[j]
        v *= mul[j]
        out[:, j] = np.minimum.reduceat(v, first)
    return out


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, j in chunks(texts):
                flatset, have, first = _shingles(texts[i:j], n)
                if not len(have):
                    continue
                sig = _signatures(flatset, first)
                stop = np.append(first[1:], len(flatset))
                wide = mix(flatset.astype(np.uint64) + U64(0x9E3779B97F4A7C15))
                rid = mix(np.add.reduceat(wide, first) + (stop - first).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid, pa.int64()), pa.array([ids[i + x] for x in have.tolist()], pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([flatset[a:b].tobytes() for a, b in zip(first.tolist(), stop.tolist())], pa.binary())],
                    ["rid", "doc_id", "sig", "members"],
                )

    return run


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(rid, doc_id, sig, members): the set of n-grams as sorted 32-bit hashes, its identity and its signature."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL").mapInArrow(_sets(n), _SETS)


def _redrawn(draw: int):
    """The signatures of sets by other coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [np.frombuffer(m, np.uint32) for m in part.column("members").to_pylist()]
                first = np.cumsum([0] + [len(x) for x in sets[:-1]])
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([x.tobytes() for x in _signatures(np.concatenate(sets), first, draw)], pa.binary())], ["rid", "sig"])

    return run


def _choices(path: int, threshold: float) -> list[int]:
    """The coordinates by which a node of the tree is split; 1 / threshold of them on average, one at least."""
    rng = np.random.default_rng(path & 0xFFFFFFFFFFFFFFFF)
    want = 1 / threshold
    n = int(want) + (rng.random() < want - int(want))
    return rng.choice(T, min(n, T), replace=False).tolist()


def _roots(runs: list[int], threshold: float):
    """The first split, of all records alike: one row for each chosen coordinate, the run in the path's high bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, T)
            low = pa.array([s.tobytes() for s in sig.astype(np.uint8)], pa.binary())
            for r in runs:
                for j in _choices(r, threshold):
                    node = mix(sig[:, j].astype(np.uint64) + U64((r * T + j) << 33))
                    path = (node >> U64(10)) | U64(r << 54)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("rid"), batch.column("kin"), low], ["path", "rid", "kin", "sig"])

    return run


def _deeper(threshold: float):
    """One more split of nodes that are too large for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, rid, kin, sig = (batch.column(c).to_pylist() for c in ("path", "rid", "kin", "sig"))
            choose = functools.cache(lambda p: _choices(p, threshold))
            rows = [(p, j, r, s, k) for p, r, s, k in zip(path, rid, sig, kin) for j in choose(p)]
            if rows:
                old = np.array([x[0] for x in rows], np.int64).view(np.uint64)
                step = np.array([x[1] * 256 + x[3][x[1]] for x in rows], np.uint64)
                new = (mix(mix(old) + step) >> U64(10)) | (old >> U64(54) << U64(54))
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array([x[2] for x in rows], pa.int64()), pa.array([x[4] for x in rows], pa.int64()), pa.array([x[3] for x in rows], pa.binary())], ["path", "rid", "kin", "sig"])

    return run


def _pairs_within(sig: np.ndarray, kin: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Brute force over one bucket: the pairs of different kin with so many equal coordinates, HELD or few more at once."""
    if (kin == kin[0]).all():
        return
    left, right, n = [], [], 0
    for i in range(len(sig) - 1):
        other = i + 1 + np.flatnonzero(kin[i + 1 :] != kin[i])
        hit = other[np.count_nonzero(sig[other] == sig[i], axis=1) >= need]
        left.append(np.full(len(hit), i))
        right.append(hit)
        n += len(hit)
        if n >= HELD:
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def _stars(sig: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that tie a bucket's records together, fewer than there are records: the first one left with all that agree with it."""
    rest = np.arange(len(sig))
    while len(rest) > 1:
        hit = np.count_nonzero(sig[rest[1:]] == sig[rest[0]], axis=1) >= need
        if hit.any():
            yield np.full(int(hit.sum()), rest[0]), rest[1:][hit]
        rest = rest[1:][~hit]


def _split(sig: np.ndarray, rows: np.ndarray, path: int, depth: int, threshold: float, small: int, most: int) -> Iterator[np.ndarray]:
    """The parts of a bucket to be compared by brute force: small, deep, or alike throughout; others are split by further coordinates."""
    own = sig[rows]
    if len(rows) > small and depth < most:
        probe = own[:: max(1, len(own) // 64)]
        alike = np.mean([np.mean(own == p) for p in probe])
        if alike < threshold:
            for j in _choices(path, threshold):
                order = np.argsort(own[:, j], kind="stable")
                value = own[order, j]
                cut = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
                for a, b in zip(cut, np.append(cut[1:], len(order))):
                    if b - a > 1:
                        yield from _split(sig, rows[order[a:b]], hash((path, j, int(value[a]))), depth + 1, threshold, small, most)
            return
    yield rows


def _buckets(threshold: float, need: int, small: int, most: int, stars: bool = False):
    """Candidate pairs of each path's bucket, from rows sorted by path; with stars, only what ties large buckets together."""
    sure = max(need, int(T * (threshold + (1 - threshold) / 256)))

    def pairs(path: np.ndarray, kin: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cut = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        size = np.diff(np.append(cut, len(path)))
        if not stars:
            reach = np.repeat(np.where(size <= small, size, 0), size)  # larger buckets are split one by one
            at = np.arange(len(path)) - np.repeat(cut, size)
            for d in range(1, int(reach.max(initial=1))):
                i = np.flatnonzero(at + d < reach)
                i = i[np.count_nonzero(sig[i] == sig[i + d], axis=1) >= need]
                yield i, i + d
        for k in np.flatnonzero(size > small):
            for rows in _split(sig, np.arange(cut[k], cut[k] + size[k]), int(path[cut[k]]), 1, threshold, small, most):
                if not stars or len(rows) > small:
                    for a, b in _stars(sig[rows], sure) if stars else _pairs_within(sig[rows], kin[rows], need):
                        yield rows[a], rows[b]

    def found(path: np.ndarray, rid: np.ndarray, kin: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        def batch() -> Iterator[pa.RecordBatch]:
            a, b = np.concatenate(left), np.concatenate(right)
            keep = kin[a] != kin[b]
            home, x, y = path[a[keep]], rid[a[keep]], rid[b[keep]]
            if len(home):
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["home", "a", "b"])

        left, right, n = [], [], 0
        for a, b in pairs(path, kin, sig):
            left.append(a)
            right.append(b)
            n += len(a)
            if n >= HELD:
                yield from batch()
                left, right, n = [], [], 0
        if left:
            yield from batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rid, kin, sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, T), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            path = np.append(path, batch.column("path").to_numpy())
            rid = np.append(rid, batch.column("rid").to_numpy())
            kin = np.append(kin, batch.column("kin").to_numpy())
            sig = np.concatenate([sig, np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, T)])
            whole = int(np.searchsorted(path, path[-1]))  # the last bucket may go on
            if whole:
                yield from found(path[:whole], rid[:whole], kin[:whole], sig[:whole])
                path, rid, kin, sig = path[whole:], rid[whole:], kin[whole:], sig[whole:]
        if len(path):
            yield from found(path, rid, kin, sig)

    return run


def _verify(threshold: float):
    """Exact Jaccard of the candidate pairs of each part of a home, whose sets come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, sets = None, {}
        for batch in batches:
            out = []
            for *at, kind, a, b, found, members in zip(*(batch.column(c).to_pylist() for c in ("home", "part", "kind", "a", "b", "found", "members"))):
                if at != home:
                    home, sets = at, {}
                if kind == 0:
                    sets[a] = np.frombuffer(members, np.uint32)
                    continue
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs merge in linear time
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                j = shared / (len(both) - shared)
                if j >= threshold:
                    out.append((a, b, found, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "found", "jaccard"])

    return run


def _round(records: DataFrame, runs: list[int], threshold: float, small: int, most: int, task_rows: int, stars: bool = False) -> DataFrame:
    """(home, a, b) for each run that brings a pair of records (rid, kin, sig) of different kin into one bucket."""
    sigma = (threshold * (1 - threshold) / T) ** 0.5
    need = max(1, int(T * (threshold + (1 - threshold) / 256 - SURE * sigma)))
    rows = records.select("rid", "kin", "sig").mapInArrow(_roots(runs, threshold), _PATH)
    done = None
    for _ in range(most):
        large = written(rows.groupBy("path").count().where(F.col("count") > task_rows).select("path"), "paths")
        if large.isEmpty():
            break
        # A path that is too large for one task is split again before its records meet.
        ready = rows.join(large, "path", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        rows = rows.join(large, "path", "left_semi").mapInArrow(_deeper(threshold), _PATH)
    rows = rows if done is None else done.unionByName(rows)
    return rows.repartition(2 * partitions(rows.sparkSession), "path").sortWithinPartitions("path").mapInArrow(_buckets(threshold, need, small, most, stars), _CAND)


def _verified(cand: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    spark = cand.sparkSession
    # A pair's home is its bucket of the earliest run, so that a group's pairs mostly meet in one.
    pairs = written(cand.groupBy("a", "b").agg(F.min("home").alias("home"), F.countDistinct(F.shiftright("home", 54)).alias("found")), "candidates")
    # A home that is too large for one task is a square of parts, by either side's hash; few homes are.
    needed = pairs.select("home", F.explode(F.array("a", "b")).alias("rid")).distinct()
    size = pairs.groupBy("home").count().where(F.col("count") > SETS).join(needed.groupBy("home").agg(F.count("*").alias("sets")), "home")
    side = F.ceil(F.greatest(F.sqrt(F.col("count") / VERIFIED), F.col("sets") / SETS)).cast("int")
    large = written(size.select("home", side.alias("side")).where("side > 1"), "homes")
    part = lambda rid: F.pmod(F.xxhash64(rid), F.col("side"))
    parted = pairs.join(large, "home", "left").withColumn("part", F.coalesce(part("a") * F.col("side") + part("b"), F.lit(0)))
    needed = parted.select("home", "part", F.explode(F.array("a", "b")).alias("rid")).distinct()
    members = needed.join(sets.select("rid", "members"), "rid").select("home", "part", F.lit(0).alias("kind"), F.col("rid").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("found"), "members")
    both = members.unionByName(parted.select("home", "part", F.lit(1).alias("kind"), "a", "b", "found", F.lit(None).cast("binary").alias("members")))
    near = written(both.repartition(2 * partitions(spark), "home", "part").sortWithinPartitions("home", "part", "kind").mapInArrow(_verify(threshold), "a long, b long, found long, jaccard double"), "near")
    drop_written(pairs, large)
    return near


def near_sets(docs: DataFrame, n: int = 3, threshold: float = 0.6, recall: float = 0.95, runs: int = 6, small: int = 48, most: int = 8, task_rows: int = 200_000, connected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id) of every document, and (a, b, jaccard) of the near pairs of different sets; see ngram_jaccard_classes().

    connected: of sets that are all alike only near pairs that connect them, and then those between sets
    that are not connected yet, so that a group's pairs are no more than in proportion to its sets.
    """
    sets = written(shingle_sets(docs, n), "sets")
    # Records of one set are the same to the last byte: any may stand for all.
    one = sets.groupBy("rid").agg(F.first("sig").alias("sig"))
    reps = sets.select("rid", "members").dropDuplicates(["rid"])
    kin, tied, known = None, None, 0

    def related(records: DataFrame) -> DataFrame:
        if kin is None:
            return records.select("rid", F.col("rid").alias("kin"), "sig")
        return records.join(kin, "rid", "left").select("rid", F.coalesce("kin", "rid").alias("kin"), "sig")

    if connected:
        stars = written(_round(related(one), list(range(runs)), threshold, small, most, task_rows, stars=True), "stars")
        tied = _verified(stars, reps, threshold)
        drop_written(stars)
        known = tied.count()
        if known:
            kin = written(components(tied.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))).select(F.col("doc_id").alias("rid"), F.col("group_id").alias("kin")), "kin")
    seen, near, r = [], None, 0
    while True:
        # Other coordinates in each round, so that a pair that is hard to find by one draw is not so by the next.
        records = written(reps.mapInArrow(_redrawn(r), "rid long, sig binary"), "signatures") if r else one
        seen.append(written(_round(related(records), list(range(r * runs, (r + 1) * runs)), threshold, small, most, task_rows), "found"))
        before, near = near, _verified(functools.reduce(DataFrame.unionByName, seen), reps, threshold)
        drop_written(*([before] if before is not None else []), *([records] if r else []))
        total, once, twice = near.select(F.count("*"), F.count_if(F.col("found") == 1), F.count_if(F.col("found") == 2)).first()
        missed = once * once / (2 * twice) if twice else once * (once - 1) / 2
        if total + known >= recall * (total + known + missed):
            break
        r += 1
    members = written(sets.select("rid", "doc_id").distinct(), "members")
    drop_written(sets, *seen, *([kin] if kin is not None else []))
    near = near.select("a", "b", "jaccard")
    return members, near.unionByName(tied.select("a", "b", "jaccard")) if tied is not None else near


def star_pairs(members: DataFrame, near: DataFrame) -> DataFrame:
    """(id_a, id_b), from near_sets(): one row for a copy, to its set's least doc_id, and the near pairs between those."""
    groups = members.groupBy("rid").agg(F.min("doc_id").alias("id"))
    a, b = (groups.select(F.col("rid").alias(x), F.col("id").alias(f"id_{x}")) for x in "ab")
    copies = members.join(groups, "rid").select(F.col("id").alias("id_a"), F.col("doc_id").alias("id_b"))
    return near.join(a, "a").join(b, "b").select("id_a", "id_b").unionByName(copies).where("id_a <> id_b")


def ngram_jaccard_classes(docs: DataFrame, n: int = 3, threshold: float = 0.6, recall: float = 0.95, runs: int = 6, small: int = 48, most: int = 8, task_rows: int = 200_000) -> DataFrame:
    """For each document its class of near duplicates, and to how many others it is linked.

    docs: doc_id BIGINT and text; other columns are not read. Two documents are linked if
    their sets of word n-grams have a Jaccard index of threshold or more. Words are maximal runs of
    letters and digits of the lower-cased text (every character beyond ASCII counts as a
    letter); a text under n words has one n-gram, of all its words.

    Chosen-path join: in each run all distinct sets are split by the values of sampled
    coordinates of their min-hash signatures, 1 / threshold of them at each node on average; nodes
    of at most `small` sets, `most` splits deep, or alike throughout are compared by brute
    force, and nodes over `task_rows` are split before their sets meet. Candidates have their
    exact index computed, but for those whose signatures agree SURE standard deviations less than
    expected. After each round of `runs` runs, each round with coordinates of its own, how often pairs were found
    tells how many were missed (Chao's estimate); rounds repeat until the estimated recall
    is `recall`. The index is exact but for collisions of 32-bit n-gram hashes.

    Returns one row (doc_id, class_id, links) for each doc_id: class_id is the least doc_id
    that it is linked to directly or through others, itself if there is none; links is the
    number of linked documents, copies of its own text and of those linked to it
    included. Documents of one set share all their links, so pairs are sought between sets and never written out for copies.

    Rows without a doc_id give none; texts without a word (null and empty ones too) have no
    links; exactly repeated rows count once, and a doc_id of several texts has the links of
    all of them; an empty table gives no rows.
    """
    members, near = near_sets(docs, n, threshold, recall, runs, small, most, task_rows)
    size = members.groupBy("rid").agg(F.count("*").alias("size"))
    ways = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = ways.join(size, F.col("b") == F.col("rid")).groupBy("a").agg(F.sum("size").alias("more"))
    per_set = size.join(more, F.col("rid") == F.col("a"), "left").select("rid", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    links = members.join(per_set, "rid").groupBy("doc_id").agg(F.sum("links").alias("links"))
    groups = components(star_pairs(members, near))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return ids.join(links, "doc_id", "left").join(groups, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, group_id) for every id in pairs (id_a, id_b): the least id it is connected to.

    Alternates hooking every neighbour of a node to its least one with the same for the
    smaller neighbours alone, until nothing changes; each step is written to the shared folder.
    Rows with a null on either side, and of an id with itself, connect nothing; repeated rows
    count once, and no rows give none.
    """
    edges = pairs.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = written(small, "edges")
        drop_written(large)
        now, before = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (small, edges))
        drop_written(edges)
        edges = small
        if now == before:
            break
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct())


def keep_one_per_group(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that are joined, directly or through others, to one of smaller doc_id.

    The result has the columns and rows of docs otherwise, whatever their names; rows without a doc_id, and texts
    without a word, stay; rows that repeat a doc_id stay or go together; an empty table gives no rows.
    """
    groups = components(star_pairs(*near_sets(docs, connected=True, **options)))
    gone = groups.where("doc_id <> group_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
