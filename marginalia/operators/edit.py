"""Reading and editing notes by byte offsets: pure expressions over columns, and text functions for single notes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.batches import pieces
from marginalia.functions.diff import unified
from marginalia.functions.errors import NoteError
from marginalia.functions.text import byte_slice, slug_of

MOST_BYTES = 100_000
CEILING = 64 << 20


def eol_of(content: Column) -> Column:
    """The line end that edits of a text use."""
    return F.when(F.contains(content, F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))


def with_eol(text: Column, eol: Column) -> Column:
    """text with its line ends, whatever they are, as eol."""
    return F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\n"), eol)


def strip_bom(content: Column) -> Column:
    """A binary column without a leading byte order mark."""
    return F.when(F.substr(content, F.lit(1), F.lit(3)) == F.unhex(F.lit("EFBBBF")), F.substr(content, F.lit(4))).otherwise(content)


def read_range(content: Column, start: int, end: int) -> Column:
    """Bytes start to end of a binary column; an end beyond the content gives what there is."""
    if start < 0 or end < start:
        raise NoteError("INVALID_RANGE", f"{start} to {end}")
    if end - start > CEILING:
        raise NoteError("TOO_LARGE", f"{end - start} bytes")
    return F.substr(content, F.lit(start + 1), F.lit(end - start))


def heading_named(headings: Column, name: str, level: int = 0) -> Column:
    """The headings of this slug or, case aside, text (and level, if given)."""
    want, low = slug_of(name), name.strip().lower()
    return F.filter(headings, lambda h: ((h["slug"] == want) | (F.lower(h["text"]) == low)) & ((h["level"] == level) if level else F.lit(True)))


def section(notes: DataFrame, heading: str, level: int = 0) -> DataFrame:
    """(path, start, end, body_start, section, problem): the section of a heading in every note; problem where it has none or several."""
    found = heading_named(F.col("headings"), heading, level)
    one = F.when(F.size("found") == 1, F.get("found", F.lit(0)))
    rows = notes.select("path", "content", found.alias("found")).select("path", "content", one.alias("h"), F.when(F.size("found") == 0, "HEADING_NOT_FOUND").when(F.size("found") > 1, "AMBIGUOUS_HEADING").alias("problem"))
    return rows.select("path", "h.start", "h.end", "h.body_start", byte_slice(F.col("content"), F.col("h.start"), F.col("h.end")).alias("section"), "problem")


def append_to_section(notes: DataFrame, heading: str, text: str) -> DataFrame:
    """(path, content): text at the end of a heading's section, in every note that has just one such."""
    return _spliced(notes, heading, text, "end", "end", True)


def patch_section(notes: DataFrame, heading: str, text: str, whole: bool = False) -> DataFrame:
    """(path, content): text in place of a section, its heading line kept unless whole."""
    return _spliced(notes, heading, text, "start" if whole else "body_start", "end", False)


def _spliced(notes: DataFrame, heading: str, text: str, start: str, end: str, new_line: bool) -> DataFrame:
    found = heading_named(F.col("headings"), heading)
    rows = notes.select("path", "content", found.alias("found")).where(F.size("found") == 1).select("path", "content", F.get("found", F.lit(0)).alias("h"))
    raw = F.col("content").cast("binary")
    head, tail = F.substr(raw, F.lit(1), F.col(f"h.{start}").cast("int")), F.substr(raw, (F.col(f"h.{end}") + 1).cast("int"))
    eol = eol_of(F.col("content"))
    add = with_eol(F.lit(text), eol)
    add = F.when((add == "") | add.endswith(eol), add).otherwise(F.concat(add, eol)) if not new_line else F.when(add.endswith(eol), add).otherwise(F.concat(add, eol))
    head = F.decode(head, "UTF-8")
    if new_line:
        head = F.when((head == "") | head.endswith("\n"), head).otherwise(F.concat(head, eol))
    return rows.select("path", F.concat(head, add, F.decode(tail, "UTF-8")).alias("content"))


def append_to_end(notes: DataFrame, text: str) -> DataFrame:
    """(path, content): text as the last lines of every note."""
    c, eol = F.col("content"), eol_of(F.col("content"))
    head = F.when((c == "") | c.endswith("\n"), c).otherwise(F.concat(c, eol))
    add = with_eol(F.lit(text), eol)
    return notes.select("path", F.concat(head, add, F.when(add.endswith(eol), F.lit("")).otherwise(eol)).alias("content"))


def diffs(before: DataFrame, after: DataFrame, context: int = 3) -> DataFrame:
    """(path, diff) of notes whose (path, content) differ; '' as the old or new text where a side has none."""

    def run(batches):
        for piece in pieces(batches, "old", "new", rows=500):
            made = [unified(f"a/{p}", f"b/{p}", a, b, context) for p, a, b in zip(*(piece.column(c).to_pylist() for c in ("path", "old", "new")))]
            yield pa.RecordBatch.from_arrays([piece.column("path"), pa.array(made, pa.string())], ["path", "diff"])

    both = before.select("path", F.col("content").alias("old")).join(after.select("path", F.col("content").alias("new")), "path", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("path", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new")).mapInArrow(run, "path string, diff string")


# Single notes, as bytes.


def eol(raw: bytes) -> bytes:
    return b"\r\n" if b"\r\n" in raw else b"\n"


def normal(text: str, end: bytes) -> bytes:
    return text.replace("\r\n", "\n").replace("\r", "\n").encode().replace(b"\n", end)


def find_heading(headings: list[dict], name: str, level: int = 0) -> dict:
    """The only heading of a slug or text."""
    found = [h for h in headings if (h["slug"] == slug_of(name) or h["text"].lower() == name.strip().lower()) and (not level or h["level"] == level)]
    if len(found) != 1:
        raise NoteError("AMBIGUOUS_HEADING" if found else "HEADING_NOT_FOUND", name, [h["text"] for h in found or headings])
    return found[0]


def find_block(blocks: list[dict], name: str) -> dict:
    found = [b for b in blocks if b["id"] == name.removeprefix("^")]
    if len(found) != 1:
        raise NoteError("AMBIGUOUS_BLOCK" if found else "BLOCK_NOT_FOUND", name, [b["id"] for b in found or blocks])
    return found[0]


def appended(raw: bytes, text: str, at: int | None = None, blank_line: bool = False) -> bytes:
    """raw with text at the end, or at the end of the section that ends at at."""
    at = len(raw) if at is None else at
    end = eol(raw)
    head = raw[:at]
    if head and not head.endswith(b"\n"):
        head += end
    if blank_line and head and not head.endswith((b"\n\n", b"\r\n\r\n")):
        head += end
    add = normal(text, end)
    return head + add + (b"" if add.endswith(end) else end) + raw[at:]


def patched(raw: bytes, start: int, stop: int, text: str) -> bytes:
    end = eol(raw)
    add = normal(text, end)
    return raw[:start] + add + (end if add and not add.endswith(end) else b"") + raw[stop:]


def patched_block(raw: bytes, block: dict, text: str) -> bytes:
    """A block replaced; its id stays at its end."""
    add = normal(text, eol(raw)).rstrip(b"\r\n")
    mark = b"^" + block["id"].encode()
    if not add.endswith(mark):
        add += (b" " if add and not add.endswith(b" ") else b"") + mark
    return raw[: block["start"]] + add + raw[block["end"] :]


def created(text: str, frontmatter: dict | None = None) -> bytes:
    """A new note: its front matter, if any, an empty line, its text."""
    if not frontmatter:
        return text.encode()
    import yaml

    return f"---\n{yaml.safe_dump(frontmatter, allow_unicode=True, sort_keys=True)}---\n\n{text}".encode()


def link_text(link: dict, target: str) -> str:
    """A link with another target, its form, anchor and alias kept."""
    bang = "!" if link["kind"] == "embed" else ""
    if link["kind"] == "wikilink" or (bang and link["raw"].startswith("![[")):
        return f"{bang}[[{target}{'#' + link['anchor'] if link['anchor'] else ''}{'|' + link['alias'] if link['alias'] else ''}]]"
    if "%20" in link["raw"] or " " in target:
        target = target.replace(" ", "%20")
    return f"{bang}[{link['alias']}]({target})"


def new_target(link: dict, to: str) -> str:
    """How a link names a note that moved: by its whole path where it did before, else by its name."""
    if link["kind"] == "markdown" or (link["kind"] == "embed" and not link["raw"].startswith("![[")):
        return to
    short = to.removesuffix(".md") if not link["target"].endswith(".md") else to
    return short if "/" in link["target"] else short.rsplit("/", 1)[-1]


def rewritten(raw: bytes, changes: list[tuple[dict, str]]) -> bytes:
    """raw with links replaced, from the last to the first; offsets must be inside and apart, and the links must be there."""
    order = sorted(changes, key=lambda c: -c[0]["start"])
    for link, _ in order:
        if not 0 <= link["start"] < link["end"] <= len(raw):
            raise NoteError("LINK_OFFSET_INVALID", f"{link['raw']} at {link['start']} to {link['end']} of {len(raw)}")
    for (later, _), (earlier, _) in zip(order, order[1:]):
        if earlier["end"] > later["start"]:
            raise NoteError("LINK_OVERLAP", f"{earlier['raw']} and {later['raw']}")
    for link, _ in order:
        here = raw[link["start"] : link["end"]].decode("utf-8", "replace")
        if not here.startswith(("[", "![")) or link["raw"] not in here:  # raw of a Markdown link is its destination
            raise NoteError("LINK_OFFSET_INVALID", f"{link['raw']} is not at {link['start']}")
    for link, target in order:
        raw = raw[: link["start"]] + link_text(link, target).encode() + raw[link["end"] :]
    return raw


def links_to(resolved: DataFrame, old: str) -> DataFrame:
    """(path, own): the notes that refer to old, and those of their links."""
    return resolved.where((F.col("resolved") == old) & (F.col("start") >= 0)).groupBy(F.col("from_path").alias("path")).agg(F.collect_list(F.struct("raw", "target", "alias", "anchor", "kind", "start", "end")).alias("own"))


def rewrite_links(notes: DataFrame, resolved: DataFrame, old: str, new: str) -> DataFrame:
    """(path, content, links): the notes that refer to old, with those links made to refer to new; notes are rewritten in parallel.

    content is a string or, for notes that may not be valid UTF-8, the file's bytes; these stay as they are but for the links.
    """
    kind = notes.schema["content"].dataType.simpleString()

    def one(c, links):
        made = rewritten(c.encode() if isinstance(c, str) else c, [(x, new_target(x, new)) for x in links])
        return made.decode() if isinstance(c, str) else made

    def run(batches):
        for piece in pieces(batches, "content", rows=500):
            own = piece.column("own").to_pylist()
            made = [one(c, links) for c, links in zip(piece.column("content").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([piece.column("path"), pa.array(made, piece.column("content").type), pa.array([len(x) for x in own], pa.int32())], ["path", "content", "links"])

    return notes.select("path", "content").join(links_to(resolved, old), "path").select("path", "content", "own").mapInArrow(run, f"path string, content {kind}, links int")
