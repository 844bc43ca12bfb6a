"""The metadata query: predicates over notes, order, pages, projections, tags and statistics."""

from __future__ import annotations

import datetime
import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.errors import NoteError
from marginalia.functions.text import fold_text, glob, plain

ORDERS = {"path": "path", "modified": "mtime", "size": "size", "title": "title"}


def _and(conditions: list[Column]) -> Column:
    return functools.reduce(Column.__and__, conditions, F.lit(True))


def has_tag(tags: Column, tag: str, below: bool = True) -> Column:
    """Whether tags hold the tag in any case, or (with below) one under it."""
    want = tag.removeprefix("#").lower()
    return F.exists(tags, lambda t: (F.lower(t) == want) | (F.lower(t).startswith(f"{want}/") if below else F.lit(False)))


def in_folder(path: Column, folder: str, recursive: bool = True) -> Column:
    """Whether a path lies in a folder, or (not recursive) directly in it."""
    head = folder.strip("/")
    start = f"{head}/" if head else ""
    inside = path.startswith(start) if start else F.lit(True)
    return inside if recursive else inside & ~F.contains(F.substr(path, F.lit(len(start) + 1)), F.lit("/"))


def _json_path(key: str) -> str:
    return "$" + "".join("['" + part.replace("'", "\\'") + "']" for part in key.split("."))


def _when(value) -> str | None:
    """A date or time as front matter holds it."""
    if isinstance(value, datetime.datetime):
        return (value if value.tzinfo else value.replace(tzinfo=datetime.UTC)).isoformat().replace("+00:00", "Z")
    if isinstance(value, datetime.date):
        return f"{value.isoformat()}T00:00:00Z"
    if isinstance(value, str):
        try:
            return _when(datetime.date.fromisoformat(value))
        except ValueError:
            return None
    return None


def matches_field(frontmatter: Column, key: str, want) -> Column:
    """Whether a front matter (JSON) has, under a dotted key, what is wanted.

    None: the key, with any value. Texts are compared without case and accents; a text
    matches a list that contains it, a list one that contains all of its items; numbers by value,
    whole or not; dates by day. A missing key never matches.
    """
    v = F.try_variant_get(F.try_parse_json(frontmatter), _json_path(key), "variant")
    if want is None:
        return v.isNotNull()
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    is_list = F.coalesce(kind.startswith("ARRAY"), F.lit(False))

    def scalar(x: Column, value) -> Column:
        k = F.schema_of_variant(x)
        if isinstance(value, bool):
            return (k == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == value)
        if isinstance(value, (int, float)):
            return k.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)") & (F.try_variant_get(x, "$", "double") == float(value))
        text = F.try_variant_get(x, "$", "string")
        same = (k == "STRING") & (fold_text(text) == plain(str(_when(value) or value) if not isinstance(value, str) else value))
        return same | ((k == "STRING") & (text == _when(value))) if _when(value) else same

    def among(value) -> Column:
        return F.exists(items, lambda x: F.coalesce(scalar(x, value), F.lit(False)))

    if isinstance(want, (list, tuple)):
        return F.coalesce(is_list & _and([among(w) for w in want]), F.lit(False))
    if isinstance(want, dict):
        return F.coalesce(F.to_json(v) == json.dumps(want, separators=(",", ":"), ensure_ascii=False), F.lit(False))
    return F.coalesce(F.when(is_list, among(want)).otherwise(scalar(v, want)), F.lit(False))


def filtered(notes: DataFrame, tags: list[str] | None = None, tag_mode: str = "all", folder: str = "", recursive: bool = True, pattern: str = "", frontmatter: dict | None = None, modified_after=None, modified_before=None) -> DataFrame:
    """The notes that meet all criteria; bounds of time are inclusive."""
    found = []
    if tags:
        each = [has_tag(F.col("tags"), t) for t in tags]
        found.append(functools.reduce(Column.__or__, each) if tag_mode == "any" else _and(each))
    if folder and folder != "/" or (not recursive and folder == "/"):
        found.append(in_folder(F.col("path"), folder, recursive))
    if pattern:
        found.append(glob(F.col("path"), pattern))
    found += [matches_field(F.col("frontmatter"), k, v) for k, v in (frontmatter or {}).items()]
    if modified_after is not None:
        found.append(F.col("mtime") >= F.lit(modified_after).cast("timestamp"))
    if modified_before is not None:
        found.append(F.col("mtime") <= F.lit(modified_before).cast("timestamp"))
    return notes.where(_and(found)) if found else notes


def search_filter(notes: DataFrame, folder: str, tags: list[str] | None, frontmatter: dict | None, modified_after, modified_before) -> Column:
    """The conditions of a search with words: folders go deep, tags are exact."""
    found = [has_tag(F.col("tags"), t, below=False) for t in tags or []]
    if folder.strip("/"):
        found.append(in_folder(F.col("path"), folder) | (F.col("path") == folder.strip("/")))
    found += [matches_field(F.col("frontmatter"), k, v) for k, v in (frontmatter or {}).items()]
    if modified_after is not None:
        found.append(F.col("mtime") >= F.lit(modified_after).cast("timestamp"))
    if modified_before is not None:
        found.append(F.col("mtime") <= F.lit(modified_before).cast("timestamp"))
    return _and(found)


def ordered(notes: DataFrame, sort: str = "path", order: str = "asc") -> DataFrame:
    """By a key and, within it, by path, both the same way; an unknown key means path."""
    keys = list(dict.fromkeys([ORDERS.get(sort, "path"), "path"]))
    return notes.orderBy(*[F.desc(k) if order == "desc" else F.asc(k) for k in keys])


def page(rows: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
    rows = rows.offset(offset) if offset > 0 else rows
    return rows.limit(limit) if limit > 0 else rows


def list_notes(notes: DataFrame, sort: str = "path", order: str = "asc", fields: list[str] | None = None, offset: int = 0, limit: int = 0, **criteria) -> DataFrame:
    """(path, title, hash, modified, size, tags, fields, total): a page of the notes that meet filtered()'s criteria.

    fields: top-level front matter keys to give as a map of JSON texts; missing ones are left out.
    total counts before paging; a page beyond the end is empty.
    """
    rows = filtered(notes, **criteria)
    total = rows.agg(F.count("*").alias("total"))
    if fields:
        pairs = [F.struct(F.lit(f).alias("k"), F.to_json(F.try_variant_get(F.try_parse_json("frontmatter"), _json_path(f), "variant")).alias("v")) for f in fields]
        got = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))
    else:
        got = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    slim = rows.select("path", "title", "hash", "mtime", "size", "tags", got.alias("fields"))
    out = page(ordered(slim, sort, order), offset, limit).crossJoin(F.broadcast(total))
    return ordered(out, sort, order).withColumnRenamed("mtime", "modified")


def find_path(notes: DataFrame, path: str) -> DataFrame:
    """The note of exactly this path, else the first whose path differs in case alone."""
    rank = F.when(F.col("path") == path, 0).otherwise(1)
    return notes.where(F.lower("path") == path.lower()).orderBy(rank, "path").limit(1)


def resolve_path(notes: DataFrame, path: str) -> str:
    """find_path()'s path; an error if there is none."""
    check_path(path)
    row = find_path(notes.select("path"), path).first()
    if row is None:
        raise NoteError("NOT_FOUND", path)
    return row[0]


def path_problem(path: Column) -> Column:
    """Null for a path inside the vault, else what is wrong with it."""
    outside = F.exists(F.split(path, r"[/\\]"), lambda p: p == "..")
    return F.when(path.isNull() | (path == ""), "empty").when(F.contains(path, F.lit("\0")), "null byte").when(path.rlike(r"^([/\\]|[A-Za-z]:)"), "absolute").when(outside, "leaves the vault")


def check_path(path: str) -> str:
    if not path or "\0" in path:
        raise NoteError("INVALID_PATH", repr(path))
    if path[0] in "/\\" or path[1:2] == ":" or ".." in path.replace("\\", "/").split("/"):
        raise NoteError("PATH_OUTSIDE_VAULT", path)
    return path


def note_metadata(notes: DataFrame, backlinks: DataFrame | None, path: str, include: list[str] | None = None) -> DataFrame:
    """(path, title, hash) of one note and the parts asked for: frontmatter, tags, headings, links, backlinks, blocks, aliases, inline."""
    include = include or ["frontmatter", "tags", "headings", "links", "backlinks"]
    row = find_path(notes, path)
    parts = {"frontmatter": F.col("frontmatter"), "tags": F.col("tags"), "headings": F.col("headings.text").alias("headings"), "links": F.col("links"), "blocks": F.col("blocks.id").alias("blocks"), "aliases": F.col("aliases"), "inline": F.col("inline")}
    out = row.select("path", "title", "hash", *[parts[p] for p in include if p in parts])
    if "backlinks" in include and backlinks is not None:
        mine = backlinks.join(F.broadcast(row.select("path")), "path").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("from", "anchor", "alias", "kind"))).alias("backlinks"))
        out = out.join(mine, "path", "left")
    return out


def inspect(notes: DataFrame, backlinks: DataFrame, path: str) -> DataFrame:
    """One note's summary: heading texts, number of links, distinct referrers."""
    row = find_path(notes, path).select("path", "title", "size", "mtime", "tags", F.col("headings.text").alias("headings"), F.size("links").alias("links"))
    n = backlinks.groupBy("path").agg(F.countDistinct("from").alias("backlinks"))
    return row.join(n, "path", "left").fillna(0, ["backlinks"])


def tag_counts(notes: DataFrame, prefix: str = "", min_count: int = 1) -> DataFrame:
    """(tag, count), most frequent first; tags that differ in case are told apart, the prefix is not."""
    rows = notes.select(F.explode("tags").alias("tag"))
    if prefix:
        rows = rows.where(F.lower("tag").startswith(prefix.removeprefix("#").lower()))
    return rows.groupBy("tag").agg(F.count("*").alias("count")).where(F.col("count") >= min_count).orderBy(F.desc("count"), "tag")


def alias_collisions(notes: DataFrame) -> DataFrame:
    """(alias, notes) of aliases that several entries declare, case aside."""
    return notes.select(F.explode("aliases").alias("alias")).groupBy(F.lower("alias").alias("alias")).agg(F.count("*").alias("notes")).where("notes > 1")


def totals(notes: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(notes, assets, total_size, tags) in one pass over each."""
    own = notes.select("size", "tags").agg(F.count("*").alias("notes"), F.coalesce(F.sum("size"), F.lit(0)).alias("note_size"))
    tags = notes.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag").alias("tags"))
    other = assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("size"), F.lit(0)).alias("asset_size")) if assets is not None else notes.sparkSession.range(1).select(F.lit(0).cast("long").alias("assets"), F.lit(0).cast("long").alias("asset_size"))
    return own.crossJoin(F.broadcast(other)).crossJoin(F.broadcast(tags)).select("notes", "assets", (F.col("note_size") + F.col("asset_size")).alias("total_size"), "tags")


def doctor(notes: DataFrame, root: str = "", longest: int = 240) -> DataFrame:
    """(notes, longest_path, too_long, case_collisions): what may fail on other file systems."""
    length = F.octet_length(F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.col("path")))
    a = notes.agg(F.count("*").alias("notes"), F.coalesce(F.max(length), F.lit(0)).alias("longest_path"), F.count_if(length > longest).alias("too_long"))
    same = notes.groupBy(F.lower("path").alias("p")).agg(F.countDistinct("path").alias("n")).agg(F.count_if(F.col("n") > 1).alias("case_collisions"))
    return a.crossJoin(F.broadcast(same))


def newest(notes: DataFrame, most: int = 200) -> DataFrame:
    """(path, name, mtime) of the notes changed last, named by title or path."""
    return notes.select("path", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("path")).alias("name"), "mtime").orderBy(F.desc("mtime"), "path").limit(most)
