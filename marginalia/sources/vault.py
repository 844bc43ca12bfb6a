"""Files of a folder as rows, notes parsed into columns, and a writer for single notes."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marginalia.functions.errors import NoteError
from marginalia.operators.metadata import check_path

PRUNED = (".obsidian", ".git", ".trash", ".stfolder")
ASSETS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "pdf", "mp3", "wav", "ogg", "m4a", "mp4", "mov", "webm", "canvas")
TEMPORARY = ".marginalia-tmp-"
_HEADING = "struct<level:int,text:string,slug:string,start:bigint,end:bigint,body_start:bigint>"
_LINK = "struct<ord:int,raw:string,target:string,alias:string,anchor:string,kind:string,start:bigint,end:bigint>"
PARSED = f"title string, frontmatter string, frontmatter_err string, tags array<string>, aliases array<string>, headings array<{_HEADING}>, blocks array<struct<id:string,start:bigint,end:bigint>>, links array<{_LINK}>, inline map<string,array<string>>"
PARTS = ("title", "frontmatter", "frontmatter_err", "tags", "aliases", "headings", "blocks", "links", "inline")
NOTE = f"path string, size long, mtime timestamp, hash string, eol string, bom boolean, {PARSED}, content string"


def pruned(path: Column) -> Column:
    """Whether a path lies in a folder that is never looked into."""
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(list(PRUNED)))


def is_noise(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return name.rlike(r"^~\$|^\.~lock\.|\.tmp$") | name.startswith(TEMPORARY) | name.isin("desktop.ini", "thumbs.db", ".ds_store")


def classify(path: Column) -> Column:
    """'note', 'asset', or null for what is neither."""
    ending = F.regexp_extract(F.lower(F.substring_index(path, "/", -1)), r"\.([^.]*)$", 1)
    return F.when(pruned(path) | is_noise(path), F.lit(None)).when(ending == "md", "note").when(ending.isin(*ASSETS), "asset")


def hash64(raw: bytes) -> str:
    """XXH64 of seed 0, as 16 hexadecimal digits."""
    try:
        import xxhash

        return xxhash.xxh64(raw).hexdigest()
    except ImportError:
        return f"{_xxh64(raw):016x}"


def _xxh64(raw: bytes) -> int:
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    mask = (1 << 64) - 1
    turn = lambda x, r: (x << r | x >> 64 - r) & mask
    lane = lambda acc, x: turn((acc + x * p2) & mask, 31) * p1 & mask
    n, i = len(raw), 0
    if n >= 32:
        acc = [(p1 + p2) & mask, p2, 0, -p1 & mask]
        while i <= n - 32:
            acc = [lane(a, int.from_bytes(raw[i + 8 * j : i + 8 * j + 8], "little")) for j, a in enumerate(acc)]
            i += 32
        h = sum(turn(a, r) for a, r in zip(acc, (1, 7, 12, 18))) & mask
        for a in acc:
            h = ((h ^ lane(0, a)) * p1 + p4) & mask
    else:
        h = p5
    h = (h + n) & mask
    while i + 8 <= n:
        h = (turn(h ^ lane(0, int.from_bytes(raw[i : i + 8], "little")), 27) * p1 + p4) & mask
        i += 8
    if i + 4 <= n:
        h = (turn(h ^ int.from_bytes(raw[i : i + 4], "little") * p1 & mask, 23) * p2 + p3) & mask
        i += 4
    for b in raw[i:]:
        h = turn(h ^ b * p5 & mask, 11) * p1 & mask
    h = (h ^ h >> 33) * p2 & mask
    h = (h ^ h >> 29) * p3 & mask
    return h ^ h >> 32


def _walk(root: str, top: str, deep: bool = True) -> Iterator[dict]:
    """Files under root/top; folders that can't be read are passed over, links aren't followed out of the root."""
    real = os.path.realpath(root)
    for folder, folders, files in os.walk(os.path.join(root, top)):
        folders[:] = [d for d in folders if d.lower() not in PRUNED] if deep else []
        for name in files:
            whole = os.path.join(folder, name)
            try:
                if os.path.islink(whole) and not os.path.realpath(whole).startswith(real + os.sep):
                    continue
                stat = os.stat(whole)
            except OSError:
                continue
            yield {"path": os.path.relpath(whole, root).replace(os.sep, "/"), "size": stat.st_size, "mtime": datetime.fromtimestamp(stat.st_mtime, UTC)}


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, class) of the notes and assets under a folder that all executors see.

    The driver lists the root alone; the folders below are walked by tasks. Hidden and empty files
    are files like others.
    """
    if not os.path.isdir(root):
        raise NoteError("NOT_FOUND", root)
    tops = [e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and e.name.lower() not in PRUNED]
    jobs = [("", False)] + [(t, True) for t in tops]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for top, deep in zip(pdf["top"], pdf["deep"]):
                rows = list(_walk(root, top, bool(deep)))
                if rows:
                    yield pd.DataFrame(rows)

    listed = spark.createDataFrame(jobs, "top string, deep boolean").repartition(len(jobs)).mapInPandas(run, "path string, size long, mtime timestamp")
    return listed.withColumn("class", classify(F.col("path"))).where("class IS NOT NULL")


def parsed(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Notes of rows (path, size, mtime, content BINARY), parsed piece by piece without a shuffle; extra columns are dropped.

    columns: those of NOTE to make, all by default; what none of them needs is neither parsed nor sent.
    """
    types = dict(x.split(" ", 1) for x in NOTE.split(", "))
    columns = list(types) if columns is None else columns
    given = [c for c in ("path", "size", "mtime") if c in columns]
    rows = rows.select(*given, "content").where("content IS NOT NULL")
    if set(columns) <= {*given, "content"}:
        return rows.withColumn("content", F.make_valid_utf8(F.col("content").cast("string"))).select(*columns)
    kinds = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(", ".join(f"{c} {types[c]}" for c in columns)))}

    def run(batches):
        import pyarrow as pa

        from marginalia.functions.batches import pieces
        from marginalia.sources.markdown import BOM, as_row

        own = [c for c in columns if c in PARTS]
        for batch in pieces(batches, "content", rows=500):
            raws = batch.column("content").to_pylist()
            made = {c: batch.column(c) for c in given}
            parts = [as_row("", raw, own) for raw in raws]
            for c in own:
                made[c] = pa.array([x[c] for x in parts], kinds[c])
            del parts
            for c, of in (("hash", hash64), ("eol", lambda raw: "\r\n" if b"\r\n" in raw else "\n"), ("bom", lambda raw: raw.startswith(BOM)), ("content", lambda raw: raw.decode("utf-8", "replace"))):
                if c in columns:
                    made[c] = pa.array([of(raw) for raw in raws], kinds[c])
            yield pa.RecordBatch.from_arrays([made[c] for c in columns], columns)

    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns))


def notes(spark: SparkSession, root: str, listed: DataFrame | None = None) -> DataFrame:
    """The parsed notes of a folder; files that can't be read are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = []
            for path in pdf["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data.append(f.read())
                except OSError:
                    data.append(None)
            yield pdf.assign(content=data)

    listed = files(spark, root) if listed is None else listed
    own = listed.where("class = 'note'").select("path", "size", "mtime")
    return parsed(own.mapInPandas(read, "path string, size long, mtime timestamp, content binary"))


def assets(spark: SparkSession, root: str, listed: DataFrame | None = None) -> DataFrame:
    listed = files(spark, root) if listed is None else listed
    return listed.where("class = 'asset'").select("path", "size", "mtime")


def write_note(root: str, path: str, content: bytes, tries: int = 10) -> None:
    """Replaces a file at once: written beside it, flushed, then renamed."""
    check_path(path)
    whole = os.path.join(root, path)
    if not os.path.realpath(os.path.dirname(whole)).startswith(os.path.realpath(root)):
        raise NoteError("PATH_OUTSIDE_VAULT", path)
    beside = os.path.join(os.path.dirname(whole), TEMPORARY + uuid.uuid4().hex)
    try:
        with open(beside, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        for i in range(tries):
            try:
                os.replace(beside, whole)
                return
            except PermissionError:
                if i == tries - 1:
                    raise
                time.sleep(0.01)
    finally:
        if os.path.exists(beside):
            os.unlink(beside)


def sweep(root: str) -> int:
    """Removes what interrupted writes left; how many files that were."""
    n = 0
    for folder, _, names in os.walk(root):
        for name in names:
            if name.startswith(TEMPORARY):
                os.unlink(os.path.join(folder, name))
                n += 1
    return n
