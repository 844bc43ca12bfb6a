"""Link resolution, anchors, backlinks, link health and bounded neighbourhoods."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.once import once
from marginalia.functions.text import slug

OK, MISSING, ANCHOR_MISSING, EXTERNAL = "ok", "target_missing", "anchor_missing", "external"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
DEEPEST, MOST_NODES = 3, 100


def ancestors(path: Column) -> Column:
    """Every folder a path lies in, the root ('') first, each with its closing '/'."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.concat_ws("/", F.slice(parts, 1, i)), F.lit("/"))))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def exploded(notes: DataFrame) -> DataFrame:
    """(from_path, ord, raw, target, alias, anchor, kind, start, end), one row for each link."""
    return notes.select(F.col("path").alias("from_path"), F.explode("links").alias("l")).select("from_path", *[F.col(f"l.{c}").alias(c) for c in ("ord", "raw", "target", "alias", "anchor", "kind", "start", "end")])


def _names(notes: DataFrame, assets: DataFrame | None) -> DataFrame:
    """(key, under, found): for each thing a link may name and each folder above it, the least path there.

    Keys tell by their first letter what they are: p a path, n a note's name, a an
    asset's name, l an alias. Homonyms are folded into one row for each folder before
    links meet them, so that a name shared by many notes never multiplies links.
    """
    note = notes.select("path")
    rows = [
        note.select(F.concat(F.lit("p:"), "path").alias("key"), F.col("path"), F.lit(False).alias("near")),
        note.select(F.concat(F.lit("n:"), basename(F.col("path"))).alias("key"), "path", F.lit(True).alias("near")),
        notes.select("path", F.explode("aliases").alias("alias")).select(F.concat(F.lit("l:"), F.lower("alias")).alias("key"), "path", F.lit(True).alias("near")),
    ]
    if assets is not None:
        rows += [assets.select(F.concat(F.lit("p:"), "path").alias("key"), "path", F.lit(False).alias("near")), assets.select(F.concat(F.lit("a:"), basename(F.col("path"))).alias("key"), "path", F.lit(True).alias("near"))]
    every = functools.reduce(DataFrame.unionByName, rows)
    spread = every.select("key", "path", F.explode(F.when(F.col("near"), ancestors(F.col("path"))).otherwise(F.array(F.lit("")))).alias("under"))
    return spread.groupBy("key", "under").agg(F.min("path").alias("found"))


def resolve(notes: DataFrame, assets: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """The links with resolved, via and state.

    In order: an address with a scheme is external; a target with '/' may be a whole path of a note or an asset,
    or of a note less '.md'; then a note's name, an asset's name, an alias in any case. Of
    homonyms the one that shares most leading folders with the origin, then the least path. Then the anchor must name a block or a heading
    of a note that was found.
    """
    links = exploded(notes) if links is None else links
    t = F.col("target")
    external = t.rlike(_SCHEME)
    deep = F.contains(t, F.lit("/"))
    name = F.when(t.endswith(".md"), t).otherwise(F.concat(t, F.lit(".md")))
    exact = F.when(deep, F.array(F.concat(F.lit("p:"), t), F.concat(F.lit("p:"), t, F.lit(".md")))).otherwise(F.array().cast("array<string>"))
    near = F.array(F.concat(F.lit("n:"), name), F.concat(F.lit("a:"), t), F.concat(F.lit("l:"), F.lower(t)))
    # What a link asks for depends on its folder and target alone: each such pair is asked once.
    asked = links.where((t != "") & ~external).select(F.regexp_extract("from_path", "^(.*/)?", 0).alias("dir"), "target").distinct()
    keys = F.concat(F.transform(exact, lambda k, i: F.struct((i + 1).cast("int").alias("rank"), k.alias("key"), F.array(F.lit("")).alias("unders"))), F.transform(near, lambda k, i: F.struct((i + 3).cast("int").alias("rank"), k.alias("key"), ancestors(F.concat("dir", F.lit("x"))).alias("unders"))))
    wanted = asked.select("dir", "target", F.inline(keys)).select("dir", "target", "rank", "key", F.explode("unders").alias("under"))
    best = wanted.join(_names(notes, assets), ["key", "under"]).groupBy("dir", "target").agg(F.min(F.struct("rank", (-F.length("under")).alias("depth"), "found")).alias("best"))
    rank = F.col("best.rank")
    via = F.when(rank <= 2, "path").when(rank == 3, "name").when(rank == 4, "asset").when(rank == 5, "alias")
    rows = links.withColumn("dir", F.regexp_extract("from_path", "^(.*/)?", 0)).join(best, ["dir", "target"], "left")
    rows = rows.select("from_path", "ord", "raw", "target", "alias", "anchor", "kind", "start", "end", F.col("best.found").alias("resolved"), F.coalesce(via, F.lit("")).alias("via"), external.alias("external"))
    return with_anchors(rows, notes)


def anchors(notes: DataFrame) -> DataFrame:
    """(path, anchor): every block id as ^id and every heading's slug."""
    own = F.concat(F.transform("blocks", lambda b: F.concat(F.lit("^"), b["id"])), F.col("headings.slug"))
    return notes.select("path", F.explode(F.array_distinct(own)).alias("anchor"))


def with_anchors(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """rows with state in place of external: an anchor of a note that has no such block or heading is missing."""
    want = F.when(F.col("anchor").startswith("^"), F.col("anchor")).when(F.col("anchor") != "", slug(F.col("anchor")))
    asked = rows.where("resolved IS NOT NULL AND anchor <> ''").select(F.col("resolved").alias("path"), want.alias("anchor")).distinct()
    lost = asked.join(notes.select("path"), "path", "left_semi").join(anchors(notes), ["path", "anchor"], "left_anti").select(F.col("path").alias("resolved"), F.col("anchor").alias("want"), F.lit(True).alias("lost"))
    joined = rows.withColumn("want", want).join(lost, ["resolved", "want"], "left")
    state = F.when(F.col("external"), EXTERNAL).when(F.col("resolved").isNull(), MISSING).when(F.col("lost"), ANCHOR_MISSING).otherwise(OK)
    return joined.select("from_path", "ord", "raw", "target", "alias", "anchor", "kind", "start", "end", "resolved", "via", state.alias("state"))


def backlinks(resolved: DataFrame) -> DataFrame:
    """(path, from, anchor, alias, kind, context) of every link that was resolved, also of a note to itself."""
    return resolved.where("resolved IS NOT NULL").select(F.col("resolved").alias("path"), F.col("from_path").alias("from"), "anchor", "alias", "kind", F.lit("").alias("context"))


def orphans(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Paths of notes that nothing links to."""
    return notes.select("path").join(resolved.select(F.col("resolved").alias("path")), "path", "left_anti")


def health(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """(orphans, broken_links, broken_anchors)."""
    state = resolved.agg(F.count_if(F.col("state") == MISSING).alias("broken_links"), F.count_if(F.col("state") == ANCHOR_MISSING).alias("broken_anchors"))
    return orphans(notes, resolved).agg(F.count("*").alias("orphans")).crossJoin(F.broadcast(state))


def graph(resolved: DataFrame, titles: DataFrame, start: str, direction: str = "both", depth: int = 1, include_broken: bool = True, include_embeds: bool = True, limit: int = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a note, at most three links away.

    nodes: (path, title, distance), those first found nearest, then by path, limit of them;
    edges: (source, target, kind) among what was passed, one for each pair, of its last link. The frontier
    of each step holds at most limit notes, so it may be broadcast.
    """
    depth = min(max(depth or 1, 1), DEEPEST)
    limit = limit if limit > 0 else MOST_NODES
    rows = resolved if include_embeds else resolved.where("kind <> 'embed'")
    good = rows.where(F.col("state").isin(OK, ANCHOR_MISSING)).select(F.col("from_path").alias("source"), F.col("resolved").alias("target"), "kind", "ord", F.lit(False).alias("broken"))
    broken = rows.where((F.col("state") == MISSING) & (F.col("target") != "")).select(F.col("from_path").alias("source"), F.col("target"), "kind", "ord", F.lit(True).alias("broken"))
    both = good.unionByName(broken) if include_broken else good
    every = both.groupBy("source", "target").agg(F.max(F.struct("ord", "kind")).alias("last"), F.min("broken").alias("broken")).select("source", "target", F.col("last.kind").alias("kind"), "broken")
    every = once(every, "edges")  # each step reads them, and so does the result
    spark = resolved.sparkSession
    nodes = {start: 0}
    frontier, edges = [start], []
    for step in range(1, depth + 1):
        if not frontier:
            break
        near = F.broadcast(spark.createDataFrame([(p,) for p in frontier], "at string"))
        found = []
        if direction in ("outgoing", "both"):
            found.append(every.join(near, F.col("source") == F.col("at")).select("source", "target", "kind", "broken", F.col("target").alias("next")))
        if direction in ("incoming", "both"):
            found.append(every.where("NOT broken").join(near, F.col("target") == F.col("at")).select("source", "target", "kind", "broken", F.col("source").alias("next")))
        new = functools.reduce(DataFrame.unionByName, found)
        edges.append(new.select("source", "target", "kind"))
        # Broken targets are leaves; other notes go on, as far as the budget reaches.
        ahead = new.where(~F.col("next").isin(list(nodes))).groupBy("next").agg(F.min("broken").alias("broken")).orderBy("next").limit(max(0, limit - len(nodes))).collect()
        frontier = [r["next"] for r in ahead if not r["broken"]]
        nodes |= {r["next"]: step for r in ahead}
    named = F.broadcast(spark.createDataFrame(list(nodes.items()), "path string, distance int"))
    own = titles.select("path", "title").join(named, "path", "right").select("path", F.coalesce("title", F.lit("")).alias("title"), "distance").orderBy("distance", "path")
    kept = functools.reduce(DataFrame.unionByName, edges).distinct() if edges else spark.createDataFrame([], "source string, target string, kind string")
    inside = list(nodes)
    return own, kept.where(F.col("source").isin(inside) & F.col("target").isin(inside)).orderBy("source", "target")


def moved(resolved: DataFrame, path: str) -> DataFrame:
    """The links that a move of a note would have to rewrite, in the order of their notes."""
    return resolved.where(F.col("resolved") == path).orderBy("from_path", "ord")


def delete_impact(resolved: DataFrame, path: str) -> DataFrame:
    """(from_path, broken_anchors): who refers to a note, and by how many anchored links."""
    return resolved.where(F.col("resolved") == path).groupBy("from_path").agg(F.count_if(F.col("anchor") != "").alias("broken_anchors")).orderBy("from_path")
