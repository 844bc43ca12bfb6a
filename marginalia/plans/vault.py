"""The note engine's calls over one vault, or over any relations of its notes and assets."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.diff import unified
from marginalia.functions.errors import NoteError
from marginalia.functions.text import path_uri
from marginalia.operators import edit, links, metadata, search
from marginalia.sources import vault as source
from marginalia.sources.markdown import parse, split_frontmatter


class Vault:
    """Notes and assets as DataFrames, with all queries; edits where there is a folder and it is not read_only.

    Reads give DataFrames. The links are resolved when first needed; refresh() forgets what was read.
    """

    def __init__(self, notes: DataFrame, assets: DataFrame | None = None, root: str | None = None, read_only: bool = False):
        self.spark: SparkSession = notes.sparkSession
        self.notes, self.assets, self.root, self.read_only = notes, assets, root, read_only
        self.generation = 0
        self._resolved: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, read_only: bool = False) -> Vault:
        if not read_only:
            source.sweep(root)
        listed = source.files(spark, root)
        return cls(source.notes(spark, root, listed), source.assets(spark, root, listed), root, read_only)

    def refresh(self) -> None:
        if self.root:
            listed = source.files(self.spark, self.root)
            self.notes, self.assets = source.notes(self.spark, self.root, listed), source.assets(self.spark, self.root, listed)
        self._resolved = None
        self.generation += 1

    @property
    def links(self) -> DataFrame:
        if self._resolved is None:
            self._resolved = links.resolve(self.notes, self.assets)
        return self._resolved

    # Reads.

    def vault_search(self, query: str = "", **options) -> DataFrame:
        return search.search(self.notes, query, **options)

    def note_list(self, limit: int = 100, **options) -> DataFrame:
        return metadata.list_notes(self.notes, limit=limit, **options)

    def note_metadata(self, path: str, include: list[str] | None = None) -> DataFrame:
        back = links.backlinks(self.links) if not include or "backlinks" in include else None
        return metadata.note_metadata(self.notes, back, metadata.resolve_path(self.notes, path), include)

    def link_graph(self, path: str, **options) -> tuple[DataFrame, DataFrame]:
        return links.graph(self.links, self.notes, metadata.resolve_path(self.notes, path), **options)

    def tag_list(self, prefix: str = "", min_count: int = 1) -> DataFrame:
        return metadata.tag_counts(self.notes, prefix, min_count)

    def vault_stats(self, include_health: bool = True, include_runtime: bool = False) -> DataFrame:
        out = metadata.totals(self.notes, self.assets).crossJoin(F.broadcast(metadata.alias_collisions(self.notes).agg(F.count("*").alias("alias_collisions")))).withColumn("generation", F.lit(self.generation))
        if include_health:
            out = out.crossJoin(F.broadcast(links.health(self.notes, self.links)))
        if include_runtime:
            out = out.withColumn("spark", F.lit(self.spark.version))
        return out

    def inspect(self, path: str) -> DataFrame:
        return metadata.inspect(self.notes, links.backlinks(self.links), path)

    def index_summary(self) -> DataFrame:
        began = time.time()
        row = metadata.totals(self.notes, self.assets).first()
        return self.spark.createDataFrame([(*row, time.time() - began)], "notes long, assets long, total_size long, tags long, seconds double")

    def doctor(self) -> DataFrame:
        return metadata.doctor(self.notes, self.root or "")

    def resources(self, most: int = 200) -> list[tuple[str, str]]:
        """(address, name) of the notes changed last."""
        return [(path_uri(r["path"]), r["name"]) for r in metadata.newest(self.notes, most).collect()]

    def note_read(self, path: str, heading: str = "", heading_level: int = 0, block_id: str = "", include_frontmatter: bool = True, max_bytes: int = edit.MOST_BYTES) -> dict:
        """content, hash, section and truncated of one note, or of a section or block of it."""
        row = self._note(path)
        raw = self._bytes(row["path"]) if self.root else row["content"].encode()
        start, end, section = 0, len(raw), ""
        if heading:
            h = edit.find_heading([x.asDict() for x in row["headings"]], heading, heading_level)
            start, end, section = h["start"], h["end"], h["text"]
        elif block_id:
            b = edit.find_block([x.asDict() for x in row["blocks"]], block_id)
            start, end = b["start"], b["end"]
        elif not include_frontmatter:
            start = split_frontmatter(raw)[1]
        if max_bytes > 0:
            end = min(end, start + max_bytes)
        return {"content": raw[start:end].decode("utf-8", "replace"), "hash": row["hash"], "section": section, "truncated": 0 < max_bytes == end - start}

    # Edits. Each returns a difference; with dry_run nothing is written.

    def note_create(self, path: str, content: str, frontmatter: dict | None = None, create_folders: bool = True, dry_run: bool = False) -> dict:
        self._may_write()
        metadata.check_path(path)
        whole = os.path.join(self.root, path)
        if os.path.exists(whole):
            raise NoteError("ALREADY_EXISTS", path)
        folder = os.path.dirname(whole)
        if not os.path.isdir(folder) and not create_folders:
            raise NoteError("NOT_FOUND", os.path.dirname(path))
        new = edit.created(content, frontmatter)
        if not dry_run:
            os.makedirs(folder, exist_ok=True)
            source.write_note(self.root, path, new)
        return {"path": path, "diff": unified("/dev/null", f"b/{path}", "", new.decode()), "created": not dry_run}

    def note_append(self, path: str, content: str, heading: str = "", heading_level: int = 0, create_if_missing: bool = False, ensure_blank_line: bool = True, expected_hash: str = "", dry_run: bool = False) -> dict:
        path, raw, note = self._target(path, expected_hash)
        if heading:
            try:
                at = edit.find_heading(note.headings, heading)["end"]
            except NoteError as why:
                if why.code != "HEADING_NOT_FOUND" or not create_if_missing:
                    raise
                content, at = f"{'#' * (heading_level or 2)} {heading}\n\n{content}", None
            new = edit.appended(raw, content, at, ensure_blank_line)
        else:
            new = edit.appended(raw, content, None, ensure_blank_line)
        return self._changed(path, raw, new, dry_run) | {"appended": not dry_run}

    def note_patch(self, path: str, content: str, heading: str = "", block_id: str = "", mode: str = "", expected_hash: str = "", dry_run: bool = False) -> dict:
        path, raw, note = self._target(path, expected_hash)
        mode = mode or ("replace_block" if block_id else "replace_section")
        if mode == "replace_block":
            new = edit.patched_block(raw, edit.find_block(note.blocks, block_id), content)
        elif mode in ("replace_section", "replace_heading_and_section"):
            h = edit.find_heading(note.headings, heading)
            new = edit.patched(raw, h["body_start" if mode == "replace_section" else "start"], h["end"], content)
        else:
            raise NoteError("INVALID_ARGUMENT", mode)
        return self._changed(path, raw, new, dry_run) | {"patched": not dry_run}

    def note_move(self, origin: str, to: str, update_links: bool = True, create_folders: bool = True, dry_run: bool = False) -> dict:
        """Referrers first, in path order, then the note itself; what was done is told if a step fails."""
        self._may_write()
        origin = metadata.resolve_path(self.notes, origin)
        metadata.check_path(to)
        if os.path.exists(os.path.join(self.root, to)):
            raise NoteError("ALREADY_EXISTS", to)
        folder = os.path.dirname(os.path.join(self.root, to))
        if not os.path.isdir(folder) and not create_folders:
            raise NoteError("NOT_FOUND", os.path.dirname(to))
        mine = links.moved(self.links, origin)
        broken = mine.where(F.col("state") == links.ANCHOR_MISSING).select("from_path", "anchor").collect()
        done, diffs, n, own = [], {}, 0, None
        if update_links:
            # Offsets are of the files' bytes, and bytes are what is written: no text passes through an encoding.
            for row in edit.links_to(self.links, origin).orderBy("path").toLocalIterator():
                before = self._bytes(row["path"])
                after = edit.rewritten(before, [(x.asDict(), edit.new_target(x.asDict(), to)) for x in row["own"]])
                diffs[row["path"]] = unified(f"a/{row['path']}", f"b/{row['path']}", before.decode("utf-8", "replace"), after.decode("utf-8", "replace"))
                n += len(row["own"])
                if row["path"] == origin:
                    own = after
                elif not dry_run:
                    try:
                        source.write_note(self.root, row["path"], after)
                    except OSError as why:
                        raise NoteError("PARTIAL_MOVE", f"{row['path']}: {why}", done) from why
                done.append(row["path"])
        if not dry_run:
            os.makedirs(folder, exist_ok=True)
            source.write_note(self.root, to, self._bytes(origin) if own is None else own)
            os.unlink(os.path.join(self.root, origin))
        return {"from": origin, "to": to, "rewritten": done, "links_updated": n, "broken_anchors": [tuple(b) for b in broken], "diffs": diffs}

    def note_delete(self, path: str, to_trash: bool = True, report_broken_links: bool = True, dry_run: bool = False) -> dict:
        self._may_write()
        path = metadata.resolve_path(self.notes, path)
        hurt = links.delete_impact(self.links, path).collect() if report_broken_links else []
        trash = ""
        if to_trash:
            trash = f".trash/{os.path.basename(path)}"
            if os.path.exists(os.path.join(self.root, trash)):
                stem, ending = os.path.splitext(trash)
                trash = f"{stem}_{time.time_ns()}{ending}"
        if not dry_run:
            if to_trash:
                os.makedirs(os.path.join(self.root, ".trash"), exist_ok=True)
                os.replace(os.path.join(self.root, path), os.path.join(self.root, trash))
            else:
                os.unlink(os.path.join(self.root, path))
        return {"path": path, "deleted": not dry_run, "moved_to_trash": to_trash and not dry_run, "trash_path": trash, "broken_links": [r["from_path"] for r in hurt], "broken_anchors": [r["from_path"] for r in hurt if r["broken_anchors"]]}

    def _note(self, path: str):
        return self.notes.where(F.col("path") == metadata.resolve_path(self.notes, path)).first()

    def _may_write(self) -> None:
        if self.read_only or not self.root:
            raise NoteError("READ_ONLY", "this vault takes no edits")

    def _bytes(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as f:
            return f.read()

    def _target(self, path: str, expected: str):
        self._may_write()
        path = metadata.resolve_path(self.notes, path)
        raw = self._bytes(path)
        if expected and self.notes.where(F.col("path") == path).select("hash").first()[0] != expected:
            raise NoteError("HASH_MISMATCH", path)
        return path, raw, parse(raw)

    def _changed(self, path: str, old: bytes, new: bytes, dry_run: bool) -> dict:
        if not dry_run:
            source.write_note(self.root, path, new)
        return {"path": path, "diff": unified(f"a/{path}", f"b/{path}", old.decode("utf-8", "replace"), new.decode("utf-8", "replace"))}
