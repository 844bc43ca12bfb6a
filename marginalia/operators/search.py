"""Full-text search: dual-form terms, BM25 with field weights, phrases, filters, pages, snippets; postings as tables."""

from __future__ import annotations

import functools
import json
import uuid
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.errors import NoteError
from marginalia.functions.text import ENDINGS, TOKEN, analyse, fold, reduce_word, tokens, words
from marginalia.operators import metadata

K1, B = 1.2, 0.75
RAW, REDUCED = 1.5, 1.0
IN_TITLE, IN_HEADING = 3.0, 2.0
DEFAULT_LIMIT, MOST_HITS, SNIPPET, MOST_SNIPPET = 20, 200, 240, 1000
#: Versions of what an index holds; a reader refuses any other.
FORMAT = {"format": 1, "parser": 1, "analyser": 1}


def forms(term: str) -> list[str]:
    """The folded words that are posted under a term: itself, and those that are reduced to it."""
    found = {term, f"{term}s"} | {term[: len(term) - len(to)] + ending for ending, to in ENDINGS if term.endswith(to)}
    return sorted(w for w in found if w == term or reduce_word(w) == term)


def _any_of(term: str) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(forms(term), key=len, reverse=True)) + ")"


def occurrences(folded: Column, term: str) -> Column:
    """How many words of a folded text are posted under the term; no array of words is built."""
    edge = r"[\p{L}\p{Nd}]"
    return F.regexp_count(folded, F.lit(f"(?<!{edge}){_any_of(term)}(?!{edge})"))


def phrase_in(folded: Column, query: list[tuple[str, str]]) -> Column:
    """Whether the query's words follow each other, one ASCII sign apart."""
    edge = r"[\p{L}\p{Nd}]"
    gap = r"[\x00-\x7F&&[^\p{L}\p{Nd}]]"
    return folded.rlike(f"(?<!{edge})" + gap.join(_any_of(raw) for raw, _ in query) + f"(?!{edge})")


def doc_length(content: Column) -> Column:
    return F.regexp_count(content, F.lit(TOKEN)).cast("long")


def _weighted(folded: Column, title: Column | None, headings: Column | None, term: str) -> Column:
    """Occurrences by field: three for each if the title holds the term, else two for each in a heading, one elsewhere."""
    n = occurrences(folded, term).cast("double")
    if headings is not None:
        n = n + (IN_HEADING - 1) * occurrences(headings, term)
    return n if title is None else F.when(F.contains(title, F.lit(term)), IN_TITLE * occurrences(folded, term)).otherwise(n)


def frequencies(notes: DataFrame, query: list[tuple[str, str]], keep: Column, weights: bool = True) -> DataFrame:
    """(path, doc_len, tf, keep) of every note: tf holds each query word's weighted frequency.

    One narrow pass over the texts. The few numbers that are left of each are exchanged once, so that
    the corpus' statistics and the scores read the same exchange instead of the texts twice.
    """
    have = set(notes.columns)
    title = F.when(F.col("title") != "", fold(F.col("title"))) if weights and "title" in have else None
    # The texts are folded once; every word of the query reads the same column.
    base = notes.select("path", fold(F.coalesce(F.col("content").cast("string"), F.lit(""))).alias("folded"), *([title.alias("fold_title")] if title is not None else []), *([fold(F.concat_ws("\n", "headings.text")).alias("fold_headings")] if weights and "headings" in have else []), keep.alias("keep"))
    t = F.col("fold_title") if title is not None else None
    h = F.col("fold_headings") if weights and "headings" in have else None

    def tf(raw: str, short: str) -> Column:
        out = RAW * _weighted(F.col("folded"), t, h, raw)
        return out + REDUCED * _weighted(F.col("folded"), t, h, short) if short and short != raw else out

    return base.select("path", doc_length(F.col("folded")).alias("doc_len"), F.array(*[tf(*q) for q in query]).alias("tf"), F.coalesce("keep", F.lit(False)).alias("keep")).repartition("path")


def scored(freq: DataFrame, n_words: int) -> DataFrame:
    """(path, score, total): the kept notes that hold a word of the query, and how many they are.

    Document frequencies and the mean length are those of all notes, kept or not.
    """
    hit = F.exists("tf", lambda x: x > 0)
    stats = freq.agg(F.count("*").alias("n"), F.sum("doc_len").alias("length"), F.count_if(hit & F.col("keep")).alias("total"), *[F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df_{i}") for i in range(n_words)])
    rows = freq.crossJoin(F.broadcast(stats))  # one row, whatever the corpus' size
    mean = F.when(F.col("length") > 0, F.col("length") / F.col("n")).otherwise(1.0)

    def part(i: int) -> Column:
        tf, df = F.get("tf", F.lit(i)), F.col(f"df_{i}")
        return F.when(tf > 0, F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / mean))).otherwise(0.0)

    # A score depends on both sides, so the filter stays above the exchange, and that is read twice, not made twice.
    score = F.when(F.col("keep"), functools.reduce(Column.__add__, [part(i) for i in range(n_words)])).otherwise(0.0)
    return rows.select("path", score.alias("score"), "total").where("score > 0")


def bm25(notes: DataFrame, query: str, weights: bool = True) -> DataFrame:
    """(path, score) of all notes that hold a word of the query."""
    found = analyse(query)
    if not found:
        return notes.select("path", F.lit(0.0).alias("score")).where("false")
    return scored(frequencies(notes, found, F.lit(True), weights), len(found)).select("path", "score")


def search(notes: DataFrame, query: str = "", folder: str = "", tags: list[str] | None = None, frontmatter: dict | None = None, modified_after=None, modified_before=None, snippet_chars: int = SNIPPET, limit: int = DEFAULT_LIMIT, offset: int = 0, snippets: bool = True, ready: bool = True) -> DataFrame:
    """A page of the best notes: (path, title, score, snippet, matched_headings, modified, total, truncated), best first.

    A query in double quotes is a phrase. Filters don't change the scores. An empty query lists notes by path
    with score 0; folder then means direct children, and tags their sub-tags, too.
    """
    if not ready:
        raise NoteError("INDEX_BUILDING", "the index is not complete")
    limit = DEFAULT_LIMIT if limit <= 0 else min(limit, MOST_HITS)
    offset = max(offset, 0)
    snippet_chars = SNIPPET if snippet_chars <= 0 else min(snippet_chars, MOST_SNIPPET)
    query = (query or "").strip()
    if not query:
        rows = metadata.filtered(notes, tags=tags, folder=folder, recursive=False, frontmatter=frontmatter, modified_after=modified_after, modified_before=modified_before)
        total = rows.agg(F.count("*").alias("total"))
        page = rows.select("path", "title", "mtime").orderBy("path").offset(offset).limit(limit)
        return page.crossJoin(F.broadcast(total)).select("path", "title", F.lit(0.0).alias("score"), F.lit("").alias("snippet"), F.array().cast("array<string>").alias("matched_headings"), F.col("mtime").alias("modified"), "total", (F.col("total") > offset + limit).alias("truncated")).orderBy("path")
    is_phrase = len(query) >= 2 and query[0] == query[-1] == '"'
    found = analyse(query.strip('"') if is_phrase else query)
    if not found:
        return notes.select("path", "title", F.lit(0.0).alias("score"), F.lit("").alias("snippet"), F.array().cast("array<string>").alias("matched_headings"), F.col("mtime").alias("modified"), F.lit(0).cast("long").alias("total"), F.lit(False).alias("truncated")).where("false")
    keep = metadata.search_filter(notes, folder, tags, frontmatter, modified_after, modified_before)
    if is_phrase and len(found) > 1:
        keep = keep & phrase_in(fold(F.col("content").cast("string")), found)
    hits = scored(frequencies(notes, found, keep), len(found))
    page = hits.orderBy(F.desc("score"), "path").offset(offset).limit(limit)
    # A page has MOST_HITS rows at most.
    rows = notes.join(F.broadcast(page), "path")
    out = rows.select("path", "title", "score", "content", *(["headings"] if "headings" in notes.columns else []), F.col("mtime").alias("modified"), "total", (F.col("total") > offset + limit).alias("truncated"))
    if snippets:
        out = with_snippets(out, found, snippet_chars)
    else:
        out = out.select("path", "title", "score", F.lit("").alias("snippet"), F.array().cast("array<string>").alias("matched_headings"), "modified", "total", "truncated")
    return out.orderBy(F.desc("score"), "path")


def snippet_of(content: bytes, query: list[tuple[str, str]], most: int) -> tuple[str, int, int, int, int]:
    """(text, highlight start, end, match start, end): a window of most bytes around the first place of the first query term there is."""
    import regex

    from marginalia.functions.text import plain

    bom = 3 if content.startswith(b"\xef\xbb\xbf") else 0
    text = content[bom:].decode("utf-8", "replace")
    first: dict[str, tuple[int, int]] = {}
    for m in regex.finditer(TOKEN, text):
        word = plain(m[0])
        for t in (word, reduce_word(word)):
            if t:
                first.setdefault(t, m.span())
    at = next((first[t] for pair in query for t in pair if t and t in first), None)
    if at is None:
        return "", 0, 0, -1, -1
    start = bom + len(text[: at[0]].encode())
    end = start + len(text[at[0] : at[1]].encode())
    low = max(0, start - most // 2)
    window = content[low : low + most]
    crop = 0
    while crop < len(window) and window[crop] & 0xC0 == 0x80:
        crop += 1
    stop = len(window)
    while stop > crop:
        try:
            window[crop:stop].decode()
            break
        except UnicodeDecodeError as bad:
            stop = crop + bad.start if bad.end >= stop - crop else stop - 1
    out = window[crop:stop]
    a, b = max(0, start - low - crop), min(end - low - crop, len(out))
    return out.decode("utf-8", "replace"), min(a, b), b, start, end


def with_snippets(page: DataFrame, query: list[tuple[str, str]], most: int) -> DataFrame:
    """A page with snippet and matched_headings in place of content and headings: the first, outermost section around the match."""
    if "headings" not in page.columns:
        page = page.withColumn("headings", F.lit(None).cast("array<struct<text:string,start:bigint,end:bigint>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made, around = [], []
            for content, headings in zip(pdf["content"], pdf["headings"]):
                raw = content.encode() if isinstance(content, str) else bytes(content or b"")
                text, _, _, start, end = snippet_of(raw, query, most)
                made.append(text)
                around.append([h["text"] for h in (headings if headings is not None else []) if start >= h["start"] and 0 <= end <= h["end"]][:1])
            yield pdf.assign(snippet=made, matched_headings=around)[["path", "title", "score", "snippet", "matched_headings", "modified", "total", "truncated"]]

    return page.select("path", "title", "score", "content", F.transform("headings", lambda h: F.struct(h["text"].alias("text"), h["start"].alias("start"), h["end"].alias("end"))).alias("headings"), "modified", "total", "truncated").mapInPandas(run, "path string, title string, score double, snippet string, matched_headings array<string>, modified timestamp, total long, truncated boolean")


def doc_stats(notes: DataFrame) -> DataFrame:
    """(path, doc_len)."""
    return notes.select("path", doc_length(F.coalesce(F.col("content").cast("string"), F.lit(""))).alias("doc_len"))


def token_table(notes: DataFrame) -> DataFrame:
    """(path, pos, raw, reduced): the folded words in order."""
    from marginalia.functions.text import reduced

    return notes.select("path", F.posexplode(words(F.col("content").cast("string"))).alias("pos", "raw")).select("path", "pos", "raw", reduced(F.col("raw")).alias("reduced"))


@functools.cache
def _inside():
    """Which code points a token has."""
    import numpy as np
    import regex

    inside = np.zeros(0x110000, bool)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for m in regex.finditer(TOKEN, np.arange(low, high, dtype="<u4").tobytes().decode("utf-32-le")):
            inside[low + m.start() : low + m.end()] = True
    return inside


class _Terms(dict):
    """The number of a word; first and second have the numbers of the terms it is posted under, names the terms."""

    #: Words that are kept from one piece of text to the next.
    MOST = 200_000

    def __init__(self, folded: bool):
        self.folded, self.first, self.second, self.names, self.numbers = folded, [], [], [], {}

    def _number(self, term: str) -> int:
        n = self.numbers.setdefault(term, len(self.names))
        if n == len(self.names):
            self.names.append(term)
        return n

    def __missing__(self, word: str) -> int:
        from marginalia.functions.text import plain

        raw = word if self.folded else plain(word)
        short = reduce_word(raw)
        self.first.append(self._number(raw) if raw else -1)
        self.second.append(self._number(short) if short and short != raw else -1)
        self[word] = len(self.first) - 1
        return self[word]


def _posted(texts: list[str], terms: _Terms):
    """(text, term, start, end) of every word of the texts under its one or two terms, by text, term and place, as arrays; texts and terms by number, places by byte."""
    import numpy as np

    if len(terms) > terms.MOST:
        terms.clear()
        terms.__init__(terms.folded)
    whole = "\n".join(texts)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    flag = np.zeros(len(code) + 2, np.int8)
    flag[1:-1] = _inside()[code]
    edge = np.diff(flag)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = np.fromiter((terms[whole[a:b]] for a, b in zip(start.tolist(), end.tolist())), np.int64, len(start))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(begin, start, "right") - 1
    first, second = (np.asarray(x, np.int64)[word] for x in (terms.first, terms.second))
    n = max(1, len(start))
    # One number for text, term and place in order: at most a piece's texts x MOST words' terms x a piece's words.
    place = np.arange(len(start))
    keys = [((text * len(terms.names) + t) * n + place)[t >= 0] for t in (first, second)]
    order = np.sort(np.concatenate(keys))
    key, place = np.divmod(order, n)
    text, term = np.divmod(key, max(1, len(terms.names)))
    size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    byte = np.append(0, np.cumsum(size, dtype=np.int64))
    base = byte[begin[text]]
    return text, term, byte[start[place]] - base, byte[end[place]] - base


def _named(terms: _Terms, numbers):
    """The terms of numbers, as an Arrow array."""
    import numpy as np
    import pyarrow as pa

    own, at = np.unique(numbers, return_inverse=True)
    return pa.array([terms.names[i] for i in own.tolist()], pa.string()).take(pa.array(at))


def _groups(text, term):
    """Where each text's each term begins in arrays ordered by them; one more offset at the end."""
    import numpy as np

    return np.append(np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (term[1:] != term[:-1]))), len(text)) if len(text) else np.zeros(1, np.int64)


def postings(notes: DataFrame) -> DataFrame:
    """(term, path, tf): every word under its one or two terms.

    The texts are exchanged by path instead of their words, and counted text by text; rows that share a path are one note.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from marginalia.functions.batches import pieces

        terms, held, at = _Terms(True), {}, None

        def rest():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([at] * len(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "path", "tf"])

        for piece in pieces(batches, "folded"):
            paths = piece.column("path").to_pylist()
            # Texts of one path are neighbours; the last path may go on, so what it has is held until another comes.
            new = np.append(True, [a != b for a, b in zip(paths[1:], paths)]) if len(paths) > 1 else np.ones(1, bool)
            note = np.cumsum(new) - 1
            text, term, _, _ = _posted(piece.column("folded").to_pylist(), terms)
            key, tf = np.unique(note[text] * max(1, len(terms.names)) + term, return_counts=True)
            of, term = np.divmod(key, max(1, len(terms.names)))
            if held and at != paths[0]:
                yield rest()
                held = {}
            last = len(paths) and int(note[-1])
            own = []
            for number in sorted({0, last}):  # the first may be held from before, the last may go on
                if number == last or held:
                    mine = of == number
                    counts = dict(zip([terms.names[i] for i in term[mine].tolist()], tf[mine].tolist()))
                    if number == 0 and held:
                        for t, n in held.items():
                            counts[t] = counts.get(t, 0) + n
                        held = {}
                    own.append((number, counts))
            for number, counts in own:
                held, at = counts, paths[int(np.flatnonzero(note == number)[0])]
                if number != last and held:
                    yield rest()
                    held = {}
            between = ~np.isin(of, [number for number, _ in own])
            if between.any():
                path = piece.column("path").take(pa.array(np.flatnonzero(new)[of[between]]))
                yield pa.RecordBatch.from_arrays([_named(terms, term[between]), path, pa.array(tf[between])], ["term", "path", "tf"])
        if held:
            yield rest()

    texts = notes.select("path", fold(F.col("content").cast("string")).alias("folded")).where("folded IS NOT NULL")
    return texts.repartition("path").sortWithinPartitions("path").mapInArrow(run, "term string, path string, tf long")


def positions(notes: DataFrame) -> DataFrame:
    """(term, path, positions): byte offsets of every occurrence, in order, made note by note without a shuffle."""

    def run(batches):
        import pyarrow as pa

        from marginalia.functions.batches import pieces

        terms = _Terms(False)
        for piece in pieces(batches, "content"):
            text, term, start, end = _posted(piece.column("content").to_pylist(), terms)
            cut = _groups(text, term)
            place = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([_named(terms, term[cut[:-1]]), piece.column("path").take(pa.array(text[cut[:-1]])), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), place)], ["term", "path", "positions"])

    texts = notes.select("path", F.col("content").cast("string").alias("content")).where("content IS NOT NULL")
    return texts.mapInArrow(run, "term string, path string, positions array<struct<start:bigint,end:bigint>>")


def lookup(index: DataFrame, term: str, path: str | None = None) -> DataFrame:
    """The postings of a term, by path; or its positions in one note."""
    rows = index.where(F.col("term") == term)
    return (rows if path is None else rows.where(F.col("path") == path)).orderBy("path")


def index_counts(index: DataFrame, stats: DataFrame) -> DataFrame:
    """(terms, postings, docs, tokens) of an index."""
    return index.agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings")).crossJoin(F.broadcast(stats.agg(F.count("*").alias("docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens"))))


def bm25_index(index: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(path, score) from stored postings, which a reader skips all but the query's terms of; body weights."""
    found = analyse(query)
    want = [(t, i, w) for i, (raw, short) in enumerate(found) for t, w in ((raw, RAW), (short, REDUCED)) if t]
    if not want:
        return stats.select("path", F.lit(0.0).alias("score")).where("false")
    spark = index.sparkSession
    tf_of = "tf" if "tf" in index.columns else "size(positions)"
    near = index.where(F.col("term").isin(sorted({t for t, _, _ in want}))).select("term", "path", F.expr(tf_of).cast("double").alias("n"))
    asked = spark.createDataFrame(want, "term string, i int, w double")  # as long as the query
    tf = near.join(F.broadcast(asked), "term").groupBy("path", "i").agg(F.sum(F.col("n") * F.col("w")).alias("tf"))
    df = tf.groupBy("i").agg(F.count("*").alias("df"))
    whole = stats.agg(F.count("*").alias("n"), F.sum("doc_len").alias("length"))
    mean = F.when(F.col("length") > 0, F.col("length") / F.col("n")).otherwise(1.0)
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / mean))
    rows = tf.join(F.broadcast(df), "i").join(stats, "path").crossJoin(F.broadcast(whole))
    return rows.groupBy("path").agg(F.sum(part).alias("score"))


def update_postings(base: DataFrame, changed: DataFrame, gone: DataFrame | None = None, key: str = "path") -> DataFrame:
    """An index' rows after notes changed or went: base without their paths, and the rows of what changed.

    changed: rows like base's; gone: paths.
    """
    paths = changed.select(key)
    if gone is not None:
        paths = paths.unionByName(gone.select(key))
    # The changed paths are hashed in each partition; the index, which is far larger, need not be sorted.
    return base.join(paths.distinct().hint("shuffle_hash"), key, "left_anti").select(*base.columns).unionByName(changed.select(*base.columns))


def write_index(notes: DataFrame, folder: str, vault: str = "") -> None:
    """Postings in term order, so that readers skip by term; document lengths; and, last, a manifest of versions and counts.

    Each index has a folder of its own, which the manifest names: one that was broken off is
    never read, and the one before stays whole until the manifest names the next.
    """
    spark = notes.sparkSession
    own = f"index-{uuid.uuid4().hex}"
    positions(notes).repartitionByRange("term").sortWithinPartitions("term", "path").write.parquet(f"{folder}/{own}/postings")
    doc_stats(notes).write.parquet(f"{folder}/{own}/doc_stats")
    _name_index(spark, folder, own, vault)


def _name_index(spark: SparkSession, folder: str, own: str, vault: str) -> None:
    """Puts a manifest that names an index in the place of the one before by renaming, and removes the other indexes."""
    docs = spark.read.parquet(f"{folder}/{own}/doc_stats").count()
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    spark.createDataFrame([(json.dumps(FORMAT | {"vault": vault, "docs": docs, "folder": own}),)], "manifest string").coalesce(1).write.json(f"{folder}/{own}/manifest")
    files.delete(jvm.Path(f"{folder}/manifest"), True)
    files.rename(jvm.Path(f"{folder}/{own}/manifest"), jvm.Path(f"{folder}/manifest"))
    for old in files.listStatus(at):
        name = old.getPath().getName()
        if name.startswith("index-") and name != own:
            files.delete(old.getPath(), True)


def read_index(spark: SparkSession, folder: str, vault: str = "") -> tuple[DataFrame, DataFrame]:
    """(postings, doc_stats) of a folder that write_index() finished with the same versions for the same vault."""
    try:
        manifest = json.loads(spark.read.schema("manifest string").json(f"{folder}/manifest").first()[0])
    except Exception as why:
        raise NoteError("INDEX_BUILDING", f"no complete index in {folder}") from why
    if {k: manifest.get(k) for k in FORMAT} != FORMAT or manifest.get("vault") != vault:
        raise NoteError("INDEX_BUILDING", "the index is of another version or vault")
    stats = spark.read.parquet(f"{folder}/{manifest['folder']}/doc_stats")
    if stats.count() != manifest["docs"]:
        raise NoteError("INDEX_BUILDING", "the index lacks documents that its manifest counts")
    return spark.read.parquet(f"{folder}/{manifest['folder']}/postings"), stats


def resume_index(notes: DataFrame, folder: str, vault: str = "") -> tuple[DataFrame, DataFrame]:
    """read_index() of an index that holds all notes: one that lacks some has these added and is written anew, one that can't be read is built."""
    spark = notes.sparkSession
    try:
        index, stats = read_index(spark, folder, vault)
    except NoteError:
        write_index(notes, folder, vault)
        return read_index(spark, folder, vault)
    lacking = missing_docs(notes, stats)
    if not lacking.isEmpty():
        own = f"index-{uuid.uuid4().hex}"
        update_postings(index, positions(lacking)).repartitionByRange("term").sortWithinPartitions("term", "path").write.parquet(f"{folder}/{own}/postings")
        update_postings(stats, doc_stats(lacking)).write.parquet(f"{folder}/{own}/doc_stats")
        _name_index(spark, folder, own, vault)
    return read_index(spark, folder, vault)


def missing_docs(notes: DataFrame, stats: DataFrame) -> DataFrame:
    """Notes that an index lacks: what to add to resume an unfinished one."""
    return notes.join(stats.select("path"), "path", "left_anti")


def tokens_of(notes: DataFrame) -> DataFrame:
    """(path, token): words as written."""
    return notes.select("path", F.explode(tokens(F.col("content").cast("string"))).alias("token"))
