"""Line dedup: exact copies by digest, near copies by a deletion-neighbourhood join over words."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import U64, _INV, byte_range_hashes, flat, mix, partitions, powers, written

_NEAR = "doc_id long, print long, line_no int, to_doc long, to_line int"


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one insertion, deletion or substitution of a word, or none, turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _variants(half: np.ndarray, own: np.ndarray, lines: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed keys of all variants of the lines, the line of each, and how many variants there are.

    Two lines share a key just when, in the same bucket, they have as many words and are
    equal without the word at the same place, or when one of them is equal to the other
    without one word.
    """
    raw, at = flat(lines)
    buf = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero((buf == 32) | (buf == 0))
    starts = np.append(0, ends[:-1] + 1)
    h = byte_range_hashes(buf, starts, ends)
    first = np.searchsorted(starts, at[:-1])
    count = np.diff(np.append(first, len(starts)))
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    line = np.repeat(np.arange(len(lines)), count)
    s, e = first[line], first[line] + count[line]
    g = np.arange(len(h))
    without = mix(((total[g] - total[s]) + (total[e] - total[g + 1]) * _INV) * down[s] + (count[line] - 1).astype(np.uint64))
    whole = mix((total[first + count] - total[first]) * down[first] + count.astype(np.uint64))
    bucket = mix(half.view(np.uint64))
    mine = own[line]
    place = mix(without + mix((g - s).astype(np.uint64)))
    keys = np.concatenate([mix(place[mine] ^ bucket[line[mine]]), without[mine] ^ bucket[line[mine]], whole[~own] ^ bucket[~own]])
    return keys, np.concatenate([line[mine], line[mine], np.flatnonzero(~own)]), int(mine.sum())


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each line of a bucket the earliest line, if earlier, that is within one word of it; rows come sorted by bucket."""

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        half, own = table.column("half").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        lines = table.column("norm").to_pylist()
        doc = table.column("doc_id").to_pandas().astype("Int64")
        text = table.column("print").to_numpy()
        place = table.column("line_no").to_numpy()
        lost = doc.isna().to_numpy()
        ids = doc.fillna(0).to_numpy(np.int64)
        rank = np.empty(len(lines), np.int64)
        rank[np.lexsort((place, ids, ~lost))] = np.arange(len(lines))  # rows without an id come first
        keys, line, n = _variants(half, own, lines)
        kind = np.zeros(len(keys), np.int8)  # 0 same place, 1 without a word, 2 whole
        kind[n : 2 * n], kind[2 * n :] = 1, 2
        order = np.lexsort((rank[line], kind, keys))
        keys, line, kind = keys[order], line[order], kind[order]
        cut = np.append(True, (keys[1:] != keys[:-1]) | (kind[1:] != kind[:-1]))
        start = np.flatnonzero(cut)
        group = np.cumsum(cut) - 1
        low = line[start]  # the earliest of each group of equal keys and kinds
        best = np.full(len(lines), -1)

        def offer(who: np.ndarray, other: np.ndarray) -> None:
            better = (rank[other] < rank[who]) & (who != other)
            who, other = who[better], other[better]
            by = np.argsort(-rank[other], kind="stable")  # the earliest is written last
            now = best[who[by]]
            use = (now < 0) | (rank[other[by]] < rank[now])
            best[who[by][use]] = other[by][use]

        same = kind == 0
        offer(line[same], low[group[same]])
        gk, gt = keys[start], kind[start]
        pair = np.flatnonzero((gk[1:] == gk[:-1]) & (gt[:-1] == 1) & (gt[1:] == 2))  # a whole line equal to others without a word
        if len(pair):
            of = np.full(len(start), -1)
            of[pair] = low[pair + 1]
            one = (kind == 1) & (of[group] >= 0)
            offer(line[one], of[group[one]])
            of[:] = -1
            of[pair + 1] = low[pair]
            two = (kind == 2) & (of[group] >= 0)
            offer(line[two], of[group[two]])
        who = np.flatnonzero(best >= 0)
        who = [i for i in who.tolist() if lines[i] != lines[best[i]] and within_one(lines[i].split(" "), lines[best[i]].split(" "))]
        if who:
            other = best[who]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[who], pa.int64(), mask=lost[who]), pa.array(text[who], pa.int64()), pa.array(place[who], pa.int32()), pa.array(ids[other], pa.int64(), mask=lost[other]), pa.array(place[other], pa.int32())], ["doc_id", "print", "line_no", "to_doc", "to_line"]
            )

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        half = batch.column("half").to_numpy()
        whole = int(np.flatnonzero(half == half[-1])[0])  # the last bucket may go on
        if whole or (rest and rest[-1].column("half")[-1].as_py() != half[0]):
            rest.append(batch.slice(0, whole))
            yield from found(pa.Table.from_batches(rest).combine_chunks())
            rest = [batch.slice(whole)]
        else:
            rest.append(batch)
    if rest:
        yield from found(pa.Table.from_batches(rest).combine_chunks())


def _normal(line: Column) -> Column:
    # Most lines have single spaces alone, which no pattern needs to look for.
    loose = [F.contains(line, F.lit(s)) for s in ("  ", "\t", "\x0b", "\f", "\r")]
    return F.trim(F.when(functools.reduce(Column.__or__, loose), F.regexp_replace(line, "[\t\x0b\f\r ]+", " ")).otherwise(line))


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "print", "line_no", _normal(F.col("line")).alias("norm")).where("norm <> ''")


def _word_count(norm: str) -> Column:
    return F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "))) + 1


def _halves(norm: str, words: str, min_words: int) -> Column:
    """Keys of the bucket pairs that a line takes part in; words is its column of _word_count().

    Lines of v and w words, v <= w <= v + 1, that one word parts agree on their first or on
    their last (w - 1) div 2 words. A line offers both for its own number of words, and for one more.
    The number is read from a column because, as an expression, it would be counted anew at each use.
    """
    w = F.col(words)

    def key(width: Column, own: bool, side: int) -> Column:
        return F.struct(F.xxhash64(width, F.lit(side), F.call_function("substring_index", F.col(norm), F.lit(" "), (F.lit(side) * F.floor((width - 1) / 2)).cast("int"))).alias("half"), F.lit(own).alias("own"))

    return F.when(w >= min_words, F.array(key(w, True, 1), key(w, True, -1), key(w + 1, False, 1), key(w + 1, False, -1)))


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each variant of each line: its hashed key, its kind (0 same place, 1 without a word, 2 whole), and the line's number in its batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            keys, line, n = _variants(part.column("half").to_numpy(), part.column("own").to_numpy(zero_copy_only=False), part.column("norm").to_pylist())
            kind = np.zeros(len(keys), np.int8)
            kind[n : 2 * n], kind[2 * n :] = 1, 2
            rows = part.select(["doc_id", "print", "line_no", "norm"]).take(pa.array(line))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kind), *rows.columns], ["key", "kind", "doc_id", "print", "line_no", "norm"])


def _one_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose two lines are within one word of each other, without the lines."""
    for batch in batches:
        keep = [a != b and within_one(a.split(" "), b.split(" ")) for a, b in zip(batch.column("norm").to_pylist(), batch.column("to_norm").to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["doc_id", "print", "line_no", "to_doc", "to_line"])


def _hot_neighbours(lines: DataFrame) -> DataFrame:
    """What _neighbours() gives, for lines of buckets that are too large for one task.

    Every variant is a row of its own; the earliest line of each key is a minimum, which is
    taken before the rows are shuffled, and is joined back to the lines that share the key.
    """
    rows = lines.mapInArrow(_variant_rows, "key long, kind byte, doc_id long, print long, line_no int, norm string")
    place = F.struct("doc_id", "line_no", "norm")
    # Kinds 1 and 2 answer each other: a whole line equals another one without a word.
    low = rows.groupBy("key", "kind").agg(F.min(place).alias("low")).select(F.col("key").alias("k"), F.when(F.col("kind") == 0, 0).otherwise(3 - F.col("kind")).alias("for"), "low")
    met = rows.join(low, (F.col("key") == F.col("k")) & (F.col("kind") == F.col("for")))
    met = met.where(F.struct("doc_id", "line_no") > F.struct("low.doc_id", "low.line_no"))
    return met.select("doc_id", "print", "line_no", "norm", F.col("low.doc_id").alias("to_doc"), F.col("low.line_no").alias("to_line"), F.col("low.norm").alias("to_norm")).mapInArrow(_one_apart, _NEAR)


def repeated_lines(docs: DataFrame, min_words: int = 8, task_lines: int = 200_000) -> DataFrame:
    """The lines that an earlier line equals, or is one word away from.

    docs: doc_id BIGINT and text; other columns are not read. Lines are parted by newlines;
    runs of white space inside a line count as one space, and blank lines are left alone.
    Lines are ordered by (doc_id, line number), rows without a doc_id first. Equal lines are
    copies whatever their length; lines of min_words words or more are near copies where one
    word inserted, deleted or replaced makes them equal. A line goes if any earlier line, kept
    itself or not, is a copy or near copy of it; `kept_doc_id, kept_line_no` is the earliest.

    Near copies: lines that share half of their words with another (which one changed word
    leaves intact) meet in that half's bucket. There every line emits its variants with one
    word deleted as hashed keys; equal keys join, in linear time however many lines share
    them, and the match with the earliest is verified word by word. Buckets of more than
    task_lines lines aren't held in a task: there each variant is a row, and rows are joined.

    Returns (doc_id, print, line_no, kept_doc_id, kept_line_no), print being the xxhash64 of the text.
    Null and empty texts and empty tables give no rows. Rows that share a doc_id are told
    apart by their texts; lines at the same position of them tie, and neither is the
    earlier: rows that repeat both keep the same lines, and so do all rows without a
    doc_id, line by line. Very long texts have their lines like others.
    """
    spark = docs.sparkSession
    lines = _lines(docs).withColumn("key", F.unhex(F.md5(F.col("norm").cast("binary"))))
    at = F.struct("doc_id", "line_no")
    counted = lines.withColumn("words", _word_count("norm"))
    distinct = written(counted.select("key", F.struct("doc_id", "line_no", "print").alias("first"), _halves("norm", "words", min_words).alias("halves")).groupBy("key").agg(F.min("first").alias("first"), F.first("halves").alias("halves")), "lines")
    half = distinct.select("first", F.inline("halves"))
    met = half.groupBy("half").agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.max("own").alias("any"), F.count("*").alias("n")).where("lo <> hi AND any").select("half", (F.col("n") > task_lines).alias("hot"))
    wanted = half.join(met, "half").select(F.col("first.doc_id").alias("of"), F.col("first.print").alias("of_print"), F.col("first.line_no").alias("line_no"), "half", "own", "hot")
    asked = wanted.groupBy("of", "of_print").agg(F.collect_list(F.struct("line_no", "half", "own", "hot")).alias("asked"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.split("text", "\n").alias("lines"))
    near = (
        texts.join(asked, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")))
        .select("doc_id", "print", "lines", F.inline("asked"))
        .select("half", "own", "hot", "doc_id", "print", "line_no", _normal(F.get("lines", "line_no")).alias("norm"))
    )
    near = written(near, "asked")
    hot = near.where("hot").drop("hot")
    found = near.where("NOT hot").drop("hot").repartition(2 * partitions(spark), "half").sortWithinPartitions("half").mapInArrow(_neighbours, _NEAR)
    found = found if hot.isEmpty() else found.unionByName(_hot_neighbours(hot))
    near = found.groupBy("doc_id", "print", "line_no").agg(F.min(F.struct(F.col("to_doc").alias("doc_id"), F.col("to_line").alias("line_no"))).alias("near")).select(F.struct("doc_id", "line_no", "print").alias("of"), "near")
    first = F.struct("first.doc_id", "first.line_no")
    keep = distinct.select("key", "first").join(written(near, "near"), F.col("first").eqNullSafe(F.col("of")), "left").select("key", F.least(first, F.coalesce("near", first)).alias("keep"))
    return lines.select("doc_id", "print", "line_no", "key").join(keep, "key").where(at > F.col("keep")).select("doc_id", "print", "line_no", F.col("keep.doc_id").alias("kept_doc_id"), F.col("keep.line_no").alias("kept_line_no"))


def dedupe_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """docs with the lines that repeated_lines() names cut from their texts.

    Columns and rows are those of docs, whatever their names; n_chars, where there is one,
    is counted anew; a document goes where every line that was not blank is a repetition.
    Null, empty and blank texts stay as they are; of rows that repeat doc_id and text all are
    cut alike; an empty table gives no rows.
    """
    gone = repeated_lines(docs, min_words).groupBy("doc_id", "print").agg(F.collect_list("line_no").alias("gone"))
    # All columns of docs travel in one, so that none can clash with those added here.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = whole.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("print"), F.split("row.text", "\n").alias("lines"))
    gone = gone.select(F.col("doc_id").alias("of"), F.col("print").alias("of_print"), "gone")
    rows = left.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept))
    rows = rows.where(F.col("gone").isNull() | F.exists("kept", lambda x: F.trim(F.translate(x, "\t\x0b\f\r", "    ")) != ""))
    text = F.array_join("kept", "\n")
    new = {"text": text, "n_chars": F.coalesce(F.length(text).cast("long"), F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return rows.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
l AS (SELECT doc_id, n, trim(regexp_replace(line, '[\t\x0B\f\r ]+', ' ', 'g')) AS norm FROM raw),
d AS (SELECT norm, min(doc_id * 1000000 + n) AS pos, string_split(norm, ' ') AS ws FROM l WHERE norm <> '' GROUP BY norm),
v AS (SELECT norm, pos, len(ws) AS w, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) >= 8),
cut AS (SELECT norm, pos, w, i, array_to_string(list_concat(ws[1 : i - 1], ws[i + 1 :]), ' ') AS rest FROM v),
near AS (SELECT a.norm, b.pos FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.w = b.w AND a.norm <> b.norm
 UNION ALL SELECT a.norm, b.pos FROM cut a JOIN d b ON a.rest = b.norm WHERE a.w >= 9
 UNION ALL SELECT b.norm, a.pos FROM cut a JOIN d b ON a.rest = b.norm WHERE a.w >= 9),
best AS (SELECT norm, min(pos) AS pos FROM (SELECT norm, pos FROM d UNION ALL SELECT norm, pos FROM near) GROUP BY norm)
SELECT l.doc_id, CAST(l.n AS INTEGER) AS line_no, best.pos // 1000000 AS kept_doc_id, CAST(best.pos % 1000000 AS INTEGER) AS kept_line_no
FROM l JOIN best USING (norm) WHERE l.doc_id * 1000000 + l.n > best.pos
"""
