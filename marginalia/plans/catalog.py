"""Every registered query of the note engine, with its SQL twin where SQL can say it.

The driver's tables hold no notes, so `documents` stands in for them: notes() by plain
columns, linked() with links, headings and blocks composed by arithmetic, markdown()
as texts for the parser. Each composition is written once for either engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.once import once
from marginalia.functions.text import analyse, reduced, slug, words
from marginalia.operators import edit, links, metadata, search
from marginalia.sources import vault as source
from marginalia.streaming import changes

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def keep(fn):
        _found[fn.__name__] = (fn, sql)
        return fn

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Notes by plain columns.

_PATH = "source || '/' || lang || '/' || lpad(CAST(doc_id AS STRING), 8, '0') || '.md'"


def notes(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.select(
        F.expr(_PATH).alias("path"), F.substring_index("text", ".", 1).alias("title"), F.array("source", F.concat(F.lit("lang/"), "lang")).alias("tags"), F.octet_length("text").cast("long").alias("size"),
        F.expr("TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT))").alias("mtime"), F.md5("text").alias("hash"), F.col("text").alias("content"),
        F.to_json(F.struct(F.col("source").alias("author"), F.col("n_chars").alias("chars"), F.array("lang", F.lit("Édition")).alias("keys"), F.struct(F.col("lang").alias("code")).alias("meta"))).alias("frontmatter"),
        F.array(F.concat(F.lit("A"), (F.col("doc_id") % 97).cast("string")), F.concat(F.lit("a"), (F.col("doc_id") % 89).cast("string"))).alias("aliases"),
    )


NOTES = """notes AS (SELECT doc_id, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS path, split_part(text, '.', 1) AS title, [source, 'lang/' || lang] AS tags,
 CAST(strlen(text) AS BIGINT) AS size, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS mtime, md5(text) AS hash, text AS content, source, lang, n_chars FROM documents)"""
TOKENS = r"tok AS (SELECT path, unnest(regexp_extract_all(lower(strip_accents(content)), '[\p{L}\p{Nd}]+')) AS w FROM notes)"
REDUCE = (
    "CASE WHEN strlen(w) <= 3 THEN '' WHEN suffix(w, 'coes') OR suffix(w, 'soes') OR suffix(w, 'zoes') THEN left(w, -3) || 'ao' WHEN suffix(w, 'oes') THEN left(w, -3) || 'ao'"
    " WHEN suffix(w, 'ais') OR suffix(w, 'eis') OR suffix(w, 'ois') OR suffix(w, 'uis') THEN left(w, -2) || 'l' WHEN suffix(w, 'res') THEN left(w, -2)"
    " WHEN suffix(w, 's') AND NOT suffix(w, 'ss') AND NOT suffix(w, 'is') THEN left(w, -1) ELSE '' END"
)


@query(f"WITH {NOTES}, {TOKENS} SELECT path, CAST(count(w) AS BIGINT) AS doc_len FROM notes LEFT JOIN tok USING (path) GROUP BY path")
def tokenize_counts(spark, d):
    return search.doc_stats(notes(spark, d))


@query(f"WITH {NOTES}, {TOKENS} SELECT w AS word, count(*) AS n FROM tok GROUP BY w")
def accent_fold(spark, d):
    return notes(spark, d).select(F.explode(words(F.col("content"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {NOTES}, {TOKENS}, x AS (SELECT DISTINCT w FROM tok) SELECT w AS word, {REDUCE} AS reduced FROM x")
def reduce_pt(spark, d):
    return notes(spark, d).select(F.explode(words(F.col("content"))).alias("word")).distinct().select("word", reduced(F.col("word")).alias("reduced"))


@query(rf"WITH {NOTES} SELECT path, trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^\p{{L}}\p{{Nd}}\s]+', '', 'g'), '\s+', ' ', 'g')) AS slug FROM notes")
def slugs(spark, d):
    return notes(spark, d).select("path", slug(F.col("title")).alias("slug"))


_POSTED = f"posted AS (SELECT term, path, count(*) AS tf FROM (SELECT path, w AS term FROM tok UNION ALL SELECT path, {REDUCE} AS term FROM tok) WHERE term <> '' GROUP BY term, path)"


@query(f"WITH {NOTES}, {TOKENS}, {_POSTED} SELECT term, path, CAST(tf AS BIGINT) AS tf FROM posted")
def postings(spark, d):
    return search.postings(notes(spark, d))


@query(f"WITH {NOTES}, {TOKENS}, {_POSTED} SELECT term, count(*) AS df FROM posted GROUP BY term")
def postings_df(spark, d):
    return search.postings(notes(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {NOTES}, {TOKENS}, {_POSTED} SELECT (SELECT count(DISTINCT term) FROM posted) AS terms, (SELECT count(*) FROM posted) AS postings, (SELECT count(*) FROM notes) AS docs, (SELECT count(*) FROM tok) AS tokens")
def index_counts(spark, d):
    n = notes(spark, d)
    return search.index_counts(search.postings(n), search.doc_stats(n))


@query(f"WITH {NOTES}, {TOKENS}, l AS (SELECT path, count(w) AS n FROM notes LEFT JOIN tok USING (path) GROUP BY path) SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS mean FROM l")
def doc_stats(spark, d):
    return search.doc_stats(notes(spark, d)).agg(F.count("*").alias("docs"), F.sum("doc_len").alias("tokens"), F.round(F.avg("doc_len"), 6).alias("mean"))


@query()
def token_positions(spark, d):
    """Byte offsets of every posting, summed up for each term; tests hold positions() against brute force."""
    return search.positions(notes(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("tf"), F.max(F.element_at("positions", -1)["end"]).alias("furthest"))


def _bm25(text: str, weights: bool = True, keep: str = "true", select: str = "SELECT path, round(score, 6) AS score FROM kept", base: str = NOTES) -> str:
    """SQL of the scores of a query, kept being those of the notes that keep is true of."""
    parts, n = [], len(analyse(text))
    for i, (raw, short) in enumerate(analyse(text)):
        for term, weight in ((raw, 1.5), (short, 1.0)):
            if term:
                field = f"CASE WHEN contains(lower(strip_accents(title)), '{term}') THEN 3.0 ELSE 1.0 END" if weights else "1.0"
                parts.append(f"SELECT path, {i} AS i, {weight} * {field} AS wt FROM both_forms JOIN notes USING (path) WHERE term = '{term}'")
    return f"""WITH {base}, {TOKENS}, both_forms AS (SELECT path, w AS term FROM tok UNION ALL SELECT path, {REDUCE} AS term FROM tok),
 lens AS (SELECT path, count(w) AS dl FROM notes LEFT JOIN tok USING (path) GROUP BY path), tf AS (SELECT path, i, sum(wt) AS tf FROM ({" UNION ALL ".join(parts)}) GROUP BY path, i),
 df AS (SELECT i, count(*) AS df FROM tf GROUP BY i), whole AS (SELECT count(*) AS n, avg(dl) AS mean FROM lens),
 scores AS (SELECT path, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM tf JOIN df USING (i) JOIN lens USING (path), whole GROUP BY path),
 kept AS (SELECT path, title, score, mtime, content FROM scores JOIN notes USING (path) WHERE {keep}) {select}""" + f" /* {n} words */"


_PAGE = "SELECT path, title, round(score, 6) AS score, mtime AS modified, (SELECT count(*) FROM kept) AS total, (SELECT count(*) FROM kept) > {end} AS truncated FROM kept ORDER BY kept.score DESC, path LIMIT {limit} OFFSET {offset}"


def _page(rows: DataFrame) -> DataFrame:
    return rows.select("path", "title", F.round("score", 6).alias("score"), "modified", "total", "truncated")


@query(_bm25("these", weights=False))
def bm25_term(spark, d):
    return search.bm25(notes(spark, d), "these", weights=False).select("path", F.round("score", 6).alias("score"))


@query(_bm25("these eaux"))
def bm25_field_weights(spark, d):
    return search.bm25(notes(spark, d), "these eaux").select("path", F.round("score", 6).alias("score"))


@query(_bm25("reres thates"))
def bm25_reduced_forms(spark, d):
    return search.bm25(notes(spark, d), "reres thates").select("path", F.round("score", 6).alias("score"))


@query(_bm25("of hain", select=_PAGE.format(end=20, limit=20, offset=0)))
def bm25_two_terms(spark, d):
    return _page(search.search(notes(spark, d), "of hain", snippets=False))


@query()
def bm25_two_terms_whole(spark, d):
    """bm25_two_terms with its snippets, which SQL can't cut by bytes where letters are longer."""
    rows = search.search(notes(spark, d), "of hain")
    return rows.select("path", "title", F.round("score", 6).alias("score"), "modified", "total", "truncated", "snippet")


@query(_bm25("of the", keep=r"regexp_matches(lower(strip_accents(content)), '(^|[^\p{L}\p{Nd}])of[\x00-/:-@\[-`{-\x7F](the|thes)([^\p{L}\p{Nd}]|$)')", select=_PAGE.format(end=20, limit=20, offset=0)))
def phrase_search(spark, d):
    return _page(search.search(notes(spark, d), '"of the"', snippets=False))


@query(_bm25("of the", keep="starts_with(path, 'src1/')", select=_PAGE.format(end=20, limit=20, offset=0)))
def search_folder_filter(spark, d):
    return _page(search.search(notes(spark, d), "of the", folder="src1", snippets=False))


@query(_bm25("of the", keep="list_contains(tags, 'lang/en')", select=_PAGE.format(end=20, limit=20, offset=0)))
def search_tag_exact(spark, d):
    return _page(search.search(notes(spark, d), "of the", tags=["#Lang/EN"], snippets=False))


@query(_bm25("of the", keep="lower(source) = 'src2'", select=_PAGE.format(end=20, limit=20, offset=0)))
def search_frontmatter(spark, d):
    return _page(search.search(notes(spark, d), "of the", frontmatter={"author": "SRC2"}, snippets=False))


@query(_bm25("of the", keep="mtime BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-01 09:00:00'", select=_PAGE.format(end=20, limit=20, offset=0)))
def search_modified(spark, d):
    return _page(search.search(notes(spark, d), "of the", modified_after="2024-01-01 02:00:00", modified_before="2024-01-01 09:00:00", snippets=False))


@query(_bm25("the", select=_PAGE.format(end=30, limit=10, offset=20)))
def search_page_truncated(spark, d):
    return _page(search.search(notes(spark, d), "the", limit=10, offset=20, snippets=False))


@query(f"WITH {NOTES}, kept AS (SELECT *, 0.0::DOUBLE AS score FROM notes WHERE starts_with(path, 'src3/en/') AND (list_contains(tags, 'lang') OR list_contains(tags, 'lang/en'))) " + _PAGE.format(end=20, limit=20, offset=0))
def search_metadata_only(spark, d):
    return _page(search.search(notes(spark, d), "", folder="src3/en", tags=["lang"], snippets=False))


@query(_bm25("these eaux", weights=False))
def bm25_from_index(spark, d):
    n = notes(spark, d)
    return search.bm25_index(search.postings(n), search.doc_stats(n), "these eaux").select("path", F.round("score", 6).alias("score"))


# The metadata query.


def _listed(where: str, tail: str = "") -> str:
    return f"WITH {NOTES}, kept AS (SELECT * FROM notes WHERE {where}) SELECT path, title, hash, mtime AS modified, size, tags, (SELECT count(*) FROM kept) AS total FROM kept {tail}"


def _list(spark, d, **options):
    return metadata.list_notes(notes(spark, d), **options).drop("fields")


@query(_listed("lang = 'en' AND source = 'src2'"))
def list_tags_all(spark, d):
    return _list(spark, d, tags=["Lang", "lang/en", "SRC2"])


@query(_listed("lang = 'fr' OR source = 'src2'"))
def list_tags_any(spark, d):
    return _list(spark, d, tags=["lang/fr", "src2"], tag_mode="any")


@query(_listed("source = 'src1'"))
def list_folder_recursive(spark, d):
    return _list(spark, d, folder="src1")


@query(_listed("source = 'src1' AND lang = 'de'"))
def list_folder_nonrecursive(spark, d):
    return _list(spark, d, folder="src1/de/", recursive=False)


@query(_listed(r"regexp_matches(path, '^src[0-4]/[^/]*/0000[^/][^/]*3\.md$')"))
def list_glob(spark, d):
    return _list(spark, d, pattern="src[0-4]/*/0000?*3.md")


@query(_listed("lang = 'es' AND n_chars > 0 AND source <> ''"))
def list_frontmatter(spark, d):
    return _list(spark, d, frontmatter={"keys": ["EDITION", "es"], "meta.code": "es", "author": None})


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 29")
def list_frontmatter_number(spark, d):
    ev = _table(spark, d, "events")
    return ev.where(metadata.matches_field(F.col("props"), "k", 29)).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(_listed("mtime BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 05:00:00'"))
def list_modified_range(spark, d):
    return _list(spark, d, modified_after="2024-01-01 01:00:00", modified_before="2024-01-01 05:00:00")


@query(_listed("true", "ORDER BY size DESC, path DESC LIMIT 25 OFFSET 10"))
def list_sort_desc_page(spark, d):
    return _list(spark, d, sort="size", order="desc", offset=10, limit=25)


@query(f"""WITH {NOTES} SELECT path, '"' || source || '"' AS author, CAST(n_chars AS VARCHAR) AS chars FROM notes""")
def list_fields(spark, d):
    rows = metadata.list_notes(notes(spark, d), fields=["author", "chars", "absent"])
    return rows.select("path", F.col("fields")["author"].alias("author"), F.col("fields")["chars"].alias("chars"))


@query(f"WITH {NOTES} SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM notes) WHERE starts_with(lower(tag), 'src1') GROUP BY tag HAVING count(*) >= 2")
def tag_list(spark, d):
    return metadata.tag_counts(notes(spark, d), "SRC1", 2)


@query("SELECT lower(a) AS alias, count(*) AS notes FROM (SELECT unnest(['A' || (doc_id % 97), 'a' || (doc_id % 89)]) AS a FROM documents) GROUP BY 1 HAVING count(*) > 1")
def alias_collisions(spark, d):
    return metadata.alias_collisions(notes(spark, d))


@query(f"WITH {NOTES} SELECT count(*) AS notes, CAST(max(strlen('/home/notes/' || path)) AS INTEGER) AS longest_path, count_if(strlen('/home/notes/' || path) > 30) AS too_long, CAST(0 AS BIGINT) AS case_collisions FROM notes")
def doctor(spark, d):
    return metadata.doctor(notes(spark, d), "/home/notes", 30)


@query(f"WITH {NOTES} SELECT path, CASE WHEN title <> '' THEN title ELSE path END AS name, mtime FROM notes ORDER BY mtime DESC, path LIMIT 200")
def resources(spark, d):
    return metadata.newest(notes(spark, d))


# Notes with links, headings and blocks; assets.

_N = 400


def linked(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")

    def link(ord_: int, target: str, anchor: str = "''", alias: str = "''", kind: str = "wikilink") -> str:
        return f"named_struct('ord', {ord_}, 'raw', '', 'target', {target}, 'alias', {alias}, 'anchor', {anchor}, 'kind', '{kind}', 'start', CAST(-1 AS BIGINT), 'end', CAST(-1 AS BIGINT))"

    rows = [
        link(0, "'n' || (doc_id * 7 + 3) % 500"),
        link(1, "source || '/' || lang || '/d0/n' || (doc_id * 3) % 400", "'Part ' || doc_id % 5"),
        link(2, "'A' || doc_id % 120", alias="'see'"),
        link(3, "'img' || doc_id % 10 || '.png'", kind="embed"),
        link(4, "'n' || (doc_id * 11) % 400 || '.md'", "'^b' || doc_id % 3"),
        link(5, "'https://example.org/' || doc_id", kind="markdown"),
    ]
    return docs.select(
        F.expr("source || '/' || lang || '/d' || (doc_id div 400) || '/n' || doc_id % 400 || '.md'").alias("path"), F.substring_index("text", ".", 1).alias("title"), F.octet_length("text").cast("long").alias("size"),
        F.array("source").alias("tags"), F.expr("array('a' || doc_id % 97)").alias("aliases"),
        F.expr("array(named_struct('level', 2, 'text', 'Part ' || doc_id % 3, 'slug', 'part ' || doc_id % 3, 'start', CAST(0 AS BIGINT), 'end', CAST(9 AS BIGINT), 'body_start', CAST(8 AS BIGINT)))").alias("headings"),
        F.expr("array(named_struct('id', 'b' || doc_id % 2, 'start', CAST(0 AS BIGINT), 'end', CAST(9 AS BIGINT)))").alias("blocks"), F.expr(f"array({', '.join(rows)})").alias("links"), F.col("text").alias("content"),
    )


def assets(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "nation").where("n_nationkey < 7").select(F.concat(F.lit("files/img"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("path"), F.lit(10).cast("long").alias("size"))


LINKED = """ln AS (SELECT doc_id, source, lang, source || '/' || lang || '/d' || (doc_id // 400) || '/' AS dir, source || '/' || lang || '/d' || (doc_id // 400) || '/n' || (doc_id % 400) || '.md' AS path, text FROM documents),
assets AS (SELECT 'files/img' || n_nationkey || '.png' AS path FROM nation WHERE n_nationkey < 7),
links AS (SELECT path AS from_path, dir, source, lang, doc_id, 0 AS ord, 'n' || ((doc_id * 7 + 3) % 500) AS target, '' AS anchor, '' AS alias, 'wikilink' AS kind FROM ln
 UNION ALL SELECT path, dir, source, lang, doc_id, 1, source || '/' || lang || '/d0/n' || ((doc_id * 3) % 400), 'Part ' || (doc_id % 5), '', 'wikilink' FROM ln
 UNION ALL SELECT path, dir, source, lang, doc_id, 2, 'A' || (doc_id % 120), '', 'see', 'wikilink' FROM ln
 UNION ALL SELECT path, dir, source, lang, doc_id, 3, 'img' || (doc_id % 10) || '.png', '', '', 'embed' FROM ln
 UNION ALL SELECT path, dir, source, lang, doc_id, 4, 'n' || ((doc_id * 11) % 400) || '.md', '^b' || (doc_id % 3), '', 'wikilink' FROM ln
 UNION ALL SELECT path, dir, source, lang, doc_id, 5, 'https://example.org/' || doc_id, '', '', 'markdown' FROM ln),
cand AS (SELECT from_path, ord, l.source AS s, l.lang AS g, l.dir AS dd, 1 AS rank, n.path AS c, n.dir AS cd, 'path' AS via, n.doc_id AS cid FROM links l JOIN ln n ON ord = 1 AND n.path = l.target || '.md'
 UNION ALL SELECT from_path, ord, l.source, l.lang, l.dir, 3, n.path, n.dir, 'name', n.doc_id FROM links l JOIN ln n ON ord IN (0, 4) AND 'n' || (n.doc_id % 400) || '.md' = CASE WHEN ord = 4 THEN l.target ELSE l.target || '.md' END
 UNION ALL SELECT from_path, ord, l.source, l.lang, l.dir, 4, a.path, '', 'asset', NULL FROM links l JOIN assets a ON ord = 3 AND a.path = 'files/' || l.target
 UNION ALL SELECT from_path, ord, l.source, l.lang, l.dir, 5, n.path, n.dir, 'alias', n.doc_id FROM links l JOIN ln n ON ord = 2 AND 'a' || (n.doc_id % 97) = lower(l.target)),
near AS (SELECT *, CASE WHEN dd = cd THEN 3 WHEN starts_with(cd, s || '/' || g || '/') THEN 2 WHEN starts_with(cd, s || '/') THEN 1 ELSE 0 END AS depth FROM cand),
best AS (SELECT *, row_number() OVER (PARTITION BY from_path, ord ORDER BY rank, depth DESC, c) AS rn FROM near),
resolved AS (SELECT l.from_path, l.ord, l.target, l.anchor, l.alias, l.kind, b.c AS resolved, coalesce(b.via, '') AS via,
 CASE WHEN l.ord = 5 THEN 'external' WHEN b.c IS NULL THEN 'target_missing' WHEN l.ord = 1 AND l.doc_id % 5 <> b.cid % 3 THEN 'anchor_missing' WHEN l.ord = 4 AND l.doc_id % 3 <> b.cid % 2 THEN 'anchor_missing' ELSE 'ok' END AS state
 FROM links l LEFT JOIN best b ON l.from_path = b.from_path AND l.ord = b.ord AND b.rn = 1)"""


def _resolved(spark, d):
    return links.resolve(linked(spark, d), assets(spark, d))


@query(f"WITH {LINKED} SELECT from_path, ord, target, resolved, via, state FROM resolved")
def link_resolve(spark, d):
    return _resolved(spark, d).select("from_path", "ord", "target", "resolved", "via", "state")


@query(f"WITH {LINKED} SELECT from_path, resolved FROM resolved WHERE via = 'name'")
def link_tiebreak(spark, d):
    return _resolved(spark, d).where("via = 'name'").select("from_path", "resolved")


@query(f"WITH {LINKED} SELECT from_path, ord, anchor, state FROM resolved WHERE anchor <> ''")
def anchor_check(spark, d):
    return _resolved(spark, d).where("anchor <> ''").select("from_path", "ord", "anchor", "state")


@query(f"WITH {LINKED} SELECT resolved AS path, from_path AS \"from\", anchor, alias, kind, '' AS context FROM resolved WHERE resolved IS NOT NULL")
def backlinks(spark, d):
    return links.backlinks(_resolved(spark, d))


@query(f"WITH {LINKED} SELECT path FROM ln WHERE path NOT IN (SELECT resolved FROM resolved WHERE resolved IS NOT NULL)")
def orphans(spark, d):
    return links.orphans(linked(spark, d), _resolved(spark, d))


@query(f"WITH {LINKED} SELECT from_path, target FROM resolved WHERE state = 'target_missing'")
def broken_links(spark, d):
    return _resolved(spark, d).where("state = 'target_missing'").select("from_path", "target")


@query(f"""WITH {LINKED} SELECT (SELECT count(*) FROM ln) AS notes, CAST(7 AS BIGINT) AS assets, (SELECT CAST(sum(strlen(text)) AS BIGINT) + 70 FROM ln) AS total_size, (SELECT count(DISTINCT source) FROM ln) AS tags,
 (SELECT count(*) FROM ln WHERE path NOT IN (SELECT resolved FROM resolved WHERE resolved IS NOT NULL)) AS orphans, count_if(state = 'target_missing') AS broken_links, count_if(state = 'anchor_missing') AS broken_anchors FROM resolved""")
def vault_stats(spark, d):
    n = linked(spark, d)
    return metadata.totals(n, assets(spark, d)).crossJoin(F.broadcast(links.health(n, _resolved(spark, d))))


def _start(spark, d) -> str:
    return linked(spark, d).agg(F.min("path")).first()[0]


_EDGES = f"""{LINKED}, e AS (SELECT from_path AS source, resolved AS target FROM resolved WHERE state IN ('ok', 'anchor_missing') GROUP BY 1, 2), s AS (SELECT min(path) AS path FROM ln),
n1 AS (SELECT target AS path FROM e, s WHERE source = s.path), n2 AS (SELECT e.target AS path FROM e JOIN n1 ON e.source = n1.path),
dist AS (SELECT path, min(k) AS distance FROM (SELECT path, 0 AS k FROM s UNION ALL SELECT path, 1 FROM n1 UNION ALL SELECT path, 2 FROM n2) GROUP BY path)"""


@query(f"WITH {_EDGES} SELECT path, CAST(distance AS INTEGER) AS distance FROM dist")
def link_graph_depth2(spark, d):
    nodes, _ = links.graph(_resolved(spark, d), linked(spark, d), _start(spark, d), "outgoing", 2, include_broken=False)
    return nodes.select("path", "distance")


@query(f"WITH {_EDGES} SELECT e.source, e.target FROM e JOIN dist a ON e.source = a.path AND a.distance < 2 JOIN dist b ON e.target = b.path")
def link_graph_edges(spark, d):
    _, edges = links.graph(_resolved(spark, d), linked(spark, d), _start(spark, d), "outgoing", 2, include_broken=False)
    return edges.select("source", "target")


@query(f"WITH {LINKED} SELECT from_path, ord, target, state FROM resolved WHERE resolved = (SELECT min(resolved) FROM resolved)")
def move_impact(spark, d):
    rows = _resolved(spark, d)
    return links.moved(rows, rows.agg(F.min("resolved")).first()[0]).select("from_path", "ord", "target", "state")


@query(f"WITH {LINKED} SELECT from_path, count_if(anchor <> '') AS broken_anchors FROM resolved WHERE resolved = (SELECT min(resolved) FROM resolved) GROUP BY from_path")
def delete_impact(spark, d):
    rows = _resolved(spark, d)
    return links.delete_impact(rows, rows.agg(F.min("resolved")).first()[0])


@query(f"WITH {LINKED} SELECT path, lower(path) AS lower FROM ln WHERE path = (SELECT min(path) FROM ln)")
def path_lookup(spark, d):
    return metadata.find_path(linked(spark, d), _start(spark, d).upper()).select("path", F.lower("path").alias("lower"))


@query(r"""WITH p AS (SELECT url, page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] AS host, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages)
SELECT page_id, target, count(*) AS n FROM p GROUP BY page_id, target""")
def page_links(spark, d):
    pages = _table(spark, d, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("n"))


# Texts for the parser: the documents' whole texts below headings, links and fields, and code that holds none.

_BODY = r"'---\ntitle: \"T' || doc_id || '\"\ntags: [' || source || ', lang/' || lang || ']\naliases: a' || doc_id || ', b\nyear: 2024\n---\n# Head ' || doc_id || '\n\n[[n' || doc_id % 7 || '#Part|see]] #own/x' || doc_id % 3 || ' ^blk' || doc_id || '\n\n## Part\n\n' || (doc_id % 10) || ' words\n\nkey:: v' || doc_id % 5 || '\n\n# Tail\n\n[m](t%20' || doc_id % 4 || '.md) ![[i.png]]\n\n```\n# No\n[[no]] #no\nkey:: no\n```\n\n`[[no]]` \\#no #Own/x' || doc_id % 3 || '\n\n### Deep ###\n\nin [mood:: m' || doc_id % 3 || '] here\n\n'"
_SQL_BODY = "replace(" + _BODY.replace(r"\n", "~").replace(r"\"", '"').replace("\\\\", "\\") + ", '~', chr(10)) || coalesce(text, '') || chr(10)"
MARKDOWN = f"md AS (SELECT doc_id, source, lang, 'm/' || doc_id || '.md' AS path, {_SQL_BODY} AS content FROM documents)"


def raw_markdown(spark: SparkSession, d: str) -> DataFrame:
    body = "replace(" + _BODY.replace(r"\n", "~").replace(r"\"", '"') + ", '~', '\\n') || coalesce(text, '') || '\\n'"
    return _table(spark, d, "documents").select("doc_id", F.expr("'m/' || doc_id || '.md'").alias("path"), F.expr(body).alias("content"), F.lit("2024-01-01").cast("timestamp").alias("mtime"))


def markdown(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The parsed texts; of their columns only those named, if any are."""
    raw = raw_markdown(spark, d)
    return source.parsed(raw.select("path", F.octet_length("content").cast("long").alias("size"), "mtime", F.col("content").cast("binary").alias("content")), list(columns) or None)


@query(f"WITH {MARKDOWN} SELECT path, 'T' || doc_id AS title, CAST(2024 AS BIGINT) AS year, strlen(content) AS size, FALSE AS bom FROM md")
def frontmatter_split(spark, d):
    return markdown(spark, d, "path", "title", "frontmatter", "size", "bom").select("path", "title", F.try_variant_get(F.try_parse_json("frontmatter"), "$.year", "bigint").alias("year"), "size", "bom")


@query(f"WITH {MARKDOWN} SELECT path, unnest(list_sort([source, 'lang/' || lang, 'own/x' || (doc_id % 3)])) AS tag FROM md")
def parse_tags(spark, d):
    return markdown(spark, d, "path", "tags").select("path", F.explode("tags").alias("tag"))


@query(f"WITH {MARKDOWN} SELECT path, unnest(['a' || doc_id, 'b']) AS alias FROM md")
def parse_aliases(spark, d):
    return markdown(spark, d, "path", "aliases").select("path", F.explode("aliases").alias("alias"))


_HEADS = f"""{MARKDOWN}, o AS (SELECT *, strpos(content, chr(10) || '# Head') AS a, strpos(content, chr(10) || '## Part') AS b, strpos(content, chr(10) || '# Tail') AS c, strpos(content, chr(10) || '### Deep') AS e FROM md),
h AS (SELECT path, content, 1 AS level, 'Head ' || doc_id AS text, a AS start, c AS "end", a + length('# Head ' || doc_id) + 1 AS body_start FROM o
 UNION ALL SELECT path, content, 2, 'Part', b, c, b + 8 FROM o UNION ALL SELECT path, content, 1, 'Tail', c, strlen(content), c + 7 FROM o UNION ALL SELECT path, content, 3, 'Deep', e, strlen(content), e + 13 FROM o)"""


@query(f'WITH {_HEADS} SELECT path, CAST(level AS INTEGER) AS level, text, lower(text) AS slug, start, "end", body_start FROM h')
def headings_extract(spark, d):
    return markdown(spark, d, "path", "headings").select("path", F.inline("headings"))


@query(f'WITH {_HEADS} SELECT path, text, content[start + 1 : "end"] AS section FROM h')
def section_ranges(spark, d):
    from marginalia.functions.text import byte_slice

    return markdown(spark, d, "path", "headings", "content").select("path", "content", F.inline("headings")).select("path", "text", byte_slice(F.col("content"), F.col("start"), F.col("end")).alias("section"))


@query(f"""WITH {MARKDOWN} SELECT path, CAST(0 AS INTEGER) AS ord, 'n' || (doc_id % 7) AS target, 'Part' AS anchor, 'see' AS alias, 'wikilink' AS kind, CAST(strpos(content, '[[n') - 1 AS BIGINT) AS start FROM md
 UNION ALL SELECT path, 1, 't ' || (doc_id % 4) || '.md', '', 'm', 'markdown', strpos(content, '[m]') - 1 FROM md UNION ALL SELECT path, 2, 'i.png', '', '', 'embed', strpos(content, '![[') - 1 FROM md""")
def parse_links(spark, d):
    return links.exploded(markdown(spark, d, "path", "links")).select(F.col("from_path").alias("path"), "ord", "target", "anchor", "alias", "kind", "start")


@query(f"WITH {MARKDOWN} SELECT path, 'key' AS key, 'v' || (doc_id % 5) AS value FROM md UNION ALL SELECT path, 'mood', 'm' || (doc_id % 3) FROM md")
def inline_fields(spark, d):
    return markdown(spark, d, "path", "inline").select("path", F.explode("inline").alias("key", "values")).select("path", "key", F.explode("values").alias("value"))


@query(f"WITH {MARKDOWN} SELECT path, 'blk' || doc_id AS id, CAST(strpos(content, '[[n') - 1 AS BIGINT) AS start, CAST(strpos(content, '^blk') + length('^blk' || doc_id) - 1 AS BIGINT) AS \"end\" FROM md")
def block_ids(spark, d):
    return markdown(spark, d, "path", "blocks").select("path", F.inline("blocks"))


@query(f'WITH {_HEADS} SELECT path, start, "end", body_start, content[start + 1 : "end"] AS section, CAST(NULL AS VARCHAR) AS problem FROM h WHERE text = \'Part\'')
def read_section(spark, d):
    return edit.section(markdown(spark, d, "path", "headings", "content"), "part")


@query(f"WITH {_HEADS} SELECT path, content[1 : \"end\"] || 'new' || chr(10) || 'line' || chr(10) || content[\"end\" + 1 :] AS content FROM h WHERE text = 'Part'")
def append_section(spark, d):
    return edit.append_to_section(markdown(spark, d, "path", "headings", "content"), "Part", "new\r\nline")


@query(f"WITH {_HEADS} SELECT path, content[1 : body_start] || 'other' || chr(10) || content[\"end\" + 1 :] AS content FROM h WHERE text = 'Part'")
def patch_section(spark, d):
    return edit.patch_section(markdown(spark, d, "path", "headings", "content"), "Part", "other")


@query(f"WITH {NOTES} SELECT path, CASE WHEN content = '' OR suffix(content, chr(10)) THEN content ELSE content || CASE WHEN contains(content, chr(13) || chr(10)) THEN chr(13) || chr(10) ELSE chr(10) END END || 'end' || CASE WHEN contains(content, chr(13) || chr(10)) THEN chr(13) || chr(10) ELSE chr(10) END AS content FROM notes")
def append_end(spark, d):
    return edit.append_to_end(notes(spark, d), "end")


@query(f"WITH {NOTES} SELECT path, encode(content)[11:50] AS part FROM notes".replace("encode(content)[11:50]", "hex(encode(content))[21:100]"))
def read_range(spark, d):
    return notes(spark, d).select("path", F.hex(edit.read_range(F.col("content").cast("binary"), 10, 50)).alias("part"))


@query(f"WITH {MARKDOWN} SELECT path, replace(content, '[[n3#', '[[moved#') AS content, CAST(1 AS INTEGER) AS links FROM md WHERE doc_id % 7 = 3")
def rewrite_links(spark, d):
    parts = once(markdown(spark, d, "path", "aliases", "headings", "blocks", "links"), "parts")
    own = parts.where("path IN ('m/3.md')").select(F.lit("n3.md").alias("path"), "aliases", "headings", "blocks")
    known = own.unionByName(parts.select("path", "aliases", "headings", "blocks"))
    return edit.rewrite_links(markdown(spark, d, "path", "content"), links.resolve(known, None, links.exploded(parts)), "n3.md", "m/moved.md")


_DIFF = r"'--- a/m/' || doc_id || '.md~+++ b/m/' || doc_id || '.md~@@ -9,11 +9,7 @@~ [[n' || (doc_id % 7) || '#Part|see]] #own/x' || (doc_id % 3) || ' ^blk' || doc_id || '~ ~ ## Part~-~-' || (doc_id % 10) || ' words~-~-key:: v' || (doc_id % 5) || '~-~+other~ # Tail~ ~ [m](t%20' || (doc_id % 4) || '.md) ![[i.png]]~'"


@query(f"SELECT 'm/' || doc_id || '.md' AS path, replace({_DIFF}, '~', chr(10)) AS diff FROM documents")
def unified_diff(spark, d):
    """The differences that patch_section makes."""
    return edit.diffs(markdown(spark, d, "path", "content"), edit.patch_section(markdown(spark, d, "path", "headings", "content"), "Part", "other"))


@query(r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'a/' || p_partkey || '.md' WHEN 1 THEN '.Git/' || p_partkey || '.md' WHEN 2 THEN p_partkey || '.PNG' WHEN 3 THEN 'x/~$' || p_partkey || '.md' WHEN 4 THEN p_partkey || '.tmp' WHEN 5 THEN '../' || p_partkey || '.md' WHEN 6 THEN '/abs/' || p_partkey || '.pdf' ELSE '_h/.' || p_partkey || '.md' END AS path FROM part)
SELECT path, CASE p_partkey % 8 WHEN 0 THEN 'note' WHEN 2 THEN 'asset' WHEN 5 THEN 'note' WHEN 6 THEN 'asset' WHEN 7 THEN 'note' END AS class, CASE p_partkey % 8 WHEN 5 THEN 'leaves the vault' WHEN 6 THEN 'absolute' END AS problem FROM p""")
def classify_paths(spark, d):
    path = F.expr("CASE p_partkey % 8 WHEN 0 THEN 'a/' || p_partkey || '.md' WHEN 1 THEN '.Git/' || p_partkey || '.md' WHEN 2 THEN p_partkey || '.PNG' WHEN 3 THEN 'x/~$' || p_partkey || '.md' WHEN 4 THEN p_partkey || '.tmp' WHEN 5 THEN '../' || p_partkey || '.md' WHEN 6 THEN '/abs/' || p_partkey || '.pdf' ELSE '_h/.' || p_partkey || '.md' END")
    rows = _table(spark, d, "part").select(path.alias("path"))
    return rows.select("path", source.classify(F.col("path")).alias("class"), metadata.path_problem(F.col("path")).alias("problem"))


# Changes.

_OP = "CASE event_type WHEN 'view' THEN 'write' WHEN 'signup' THEN 'create' WHEN 'error' THEN 'chmod' WHEN 'click' THEN 'remove|write' ELSE 'touch' END"
_EV_PATH = "CASE WHEN user_id % 11 = 0 THEN '.git/' || user_id WHEN user_id % 13 = 0 THEN 'u/../../' || user_id ELSE 'u/' || user_id || '.md' END"
EVENTS = f"ev AS (SELECT event_id, ts, {_EV_PATH} AS path, {_OP} AS op, user_id, event_type FROM events), judged AS (SELECT *, CASE WHEN op = 'chmod' THEN 'chmod' WHEN user_id % 13 = 0 AND user_id % 11 <> 0 THEN 'outside_vault' WHEN user_id % 11 = 0 THEN 'excluded' WHEN op = 'touch' THEN 'unknown_op' END AS dropped FROM ev)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", "ts", F.expr(_EV_PATH).alias("path"), F.expr(_OP).alias("op"))


@query(f"WITH {EVENTS} SELECT coalesce(dropped, 'active') AS dropped, count(*) AS count FROM judged GROUP BY 1")
def event_filter(spark, d):
    return changes.drop_counts(events(spark, d))


@query(f"WITH {EVENTS} SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS window_start, count(*) AS overflows, CAST(1 AS BIGINT) AS reconciles FROM ev WHERE op = 'touch' GROUP BY 1")
def overflow_windows(spark, d):
    lost = events(spark, d).withColumn("op", F.when(F.col("op") == "touch", changes.OVERFLOW).otherwise(F.col("op")))
    return changes.overflows(lost, "6 hours")


@query(f"WITH {NOTES} SELECT path, 'create' AS op FROM notes WHERE string_split(path, '/')[1] IN (SELECT 'src' || (user_id % 9) FROM events WHERE event_type = 'signup')")
def new_folder_scan(spark, d):
    folders = _table(spark, d, "events").select(F.expr("'src' || (user_id % 9)").alias("path"), F.expr(_OP).alias("op"))
    return changes.scanned(folders, notes(spark, d))


@query(f"WITH {EVENTS} SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS window_start, path, count(*) AS events, count(*) - 1 AS coalesced FROM judged WHERE dropped IS NULL GROUP BY 1, 2")
def debounce_tumbling(spark, d):
    return changes.debounced(events(spark, d), "6 hours")


@query(f"WITH {EVENTS} SELECT path, arg_max(op, {{'ts': ts, 'event_id': event_id}}) AS op, max(ts) AS ts FROM ev GROUP BY path")
def last_state(spark, d):
    return changes.last_state(events(spark, d))


def _before(spark, d):
    return notes(spark, d).select("path", "size", "mtime", "hash")


def _after(spark, d):
    """The same notes after changes: every tenth is gone, every seventh has a new path, every fifth another size."""
    docs = _table(spark, d, "documents")
    return docs.where("doc_id % 10 <> 9").select(F.expr(f"CASE WHEN doc_id % 7 = 0 THEN 'moved/' || doc_id || '.md' ELSE {_PATH} END").alias("path"), (F.octet_length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).cast("long").alias("size"), F.expr("TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT))").alias("mtime"), F.md5("text").alias("hash"))


SNAPSHOTS = f"{NOTES}, after AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'moved/' || doc_id || '.md' ELSE path END AS path, size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, mtime, hash FROM notes WHERE doc_id % 10 <> 9)"
_PAIRS = """gone AS (SELECT hash, min(path) AS f FROM notes WHERE size > 0 AND path NOT IN (SELECT path FROM after) GROUP BY hash HAVING count(*) = 1),
came AS (SELECT hash, min(path) AS t FROM after WHERE size > 0 AND path NOT IN (SELECT path FROM notes) GROUP BY hash HAVING count(*) = 1), pairs AS (SELECT f, t FROM gone JOIN came USING (hash))"""


@query(f'WITH {SNAPSHOTS}, {_PAIRS} SELECT f AS "from", t AS "to" FROM pairs')
def rename_correlate(spark, d):
    return changes.renames(_before(spark, d), _after(spark, d))


@query(f"WITH {SNAPSHOTS} SELECT path, CASE WHEN a.path IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM notes n FULL JOIN after a USING (path) WHERE a.path IS NULL OR n.path IS NULL OR a.size <> n.size OR a.mtime <> n.mtime")
def reconcile(spark, d):
    return changes.reconcile(_before(spark, d), _after(spark, d))


@query(f"""WITH {SNAPSHOTS}, {_PAIRS} SELECT f AS path, 'rename' AS action, t AS "to" FROM pairs
 UNION ALL SELECT path, CASE WHEN a.path IS NULL THEN 'remove' WHEN n.path IS NOT NULL AND a.size = n.size AND a.mtime = n.mtime THEN 'skip' ELSE 'replace' END, NULL FROM notes n FULL JOIN after a USING (path) WHERE path NOT IN (SELECT f FROM pairs UNION ALL SELECT t FROM pairs)""")
def apply_batch(spark, d):
    before, after = _before(spark, d), _after(spark, d)
    return changes.applied(before, before.select("path").unionByName(after.select("path")), after)


@query(f"WITH {NOTES.replace('text AS content', chr(39) + 'new words' + chr(39) + ' AS content').replace('FROM documents)', 'FROM documents WHERE doc_id % 4 = 0)')}, {TOKENS}, {_POSTED}, n0 AS (SELECT * FROM posted), ".replace("notes AS", "notes AS", 1) + f"old AS (SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS path, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM documents WHERE doc_id % 4 NOT IN (0, 1)), merged AS (SELECT term, path, count(*) AS tf FROM (SELECT path, w AS term FROM old UNION ALL SELECT path, {REDUCE} AS term FROM old) WHERE term <> '' GROUP BY term, path UNION ALL SELECT * FROM n0) SELECT path, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tf FROM merged GROUP BY path")
def incremental_postings(spark, d):
    """An index after every fourth note got other words and the one after it went."""
    number = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 4
    n = notes(spark, d)
    base = search.postings(n)
    changed = search.postings(n.where(number == 0).withColumn("content", F.lit("new words")))
    rows = search.update_postings(base, changed, n.where(number == 1).select("path"))
    return rows.groupBy("path").agg(F.count("*").alias("terms"), F.sum("tf").alias("tf"))


@query(f"WITH {NOTES} SELECT path, title, hash, source AS tag0 FROM notes WHERE path = (SELECT min(path) FROM notes)")
def note_metadata(spark, d):
    n = notes(spark, d)
    first = n.agg(F.min("path")).first()[0]
    return metadata.note_metadata(n, None, first, ["tags"]).select("path", "title", "hash", F.get("tags", F.lit(0)).alias("tag0"))
