"""One note's text to its parts: front matter, headings, block ids, links, tags, inline fields, with byte offsets.

A scanner in two passes. The first cuts the body into leaf blocks (paragraphs, headings,
code, HTML), following list items and quotations; the second reads each leaf's
inline constructs. Work is on bytes, so that offsets are those of the file.
"""

from __future__ import annotations

import datetime
import json
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field

from marginalia.functions.text import percent_decoded, slug_of

WIKI, EMBED, MARKDOWN = "wikilink", "embed", "markdown"
BOM = b"\xef\xbb\xbf"
_FENCE = re.compile(rb" {0,3}(`{3,}|~{3,})([^\n]*)")
_ATX = re.compile(rb" {0,3}(#{1,6})(?=[ \t\r\n]|$)")
_MAYBE_HEADING = re.compile(rb"^ {0,3}(?:#|`{3}|~{3})", re.M)
_ITEM = re.compile(rb"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t\r\n]|$)")
_BREAK = re.compile(rb" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\r?\n?$")
_UNDER = re.compile(rb" {0,3}(?:=+|-+)[ \t]*\r?\n?$")
_HTML = re.compile(rb" {0,3}<(?:(!--)|(\?)|(!\[CDATA\[)|(![A-Za-z])|(?i:(script|pre|style|textarea)(?=[\s>]|$))|/?(?i:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|section|source|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s/>]|$))")
_TAG7 = re.compile(rb" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*\r?\n?$")
_AUTO = re.compile(rb"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
_INLINE_HTML = re.compile(rb"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|/[A-Za-z][A-Za-z0-9-]*\s*>|!--.*?-->|\?.*?\?>|![A-Za-z][^>]*>|!\[CDATA\[.*?\]\]>)", re.S)
_BLOCK_ID = re.compile(rb"\^([A-Za-z0-9-]+)[ \t\r\n]*$")
_MARKS = re.compile(rb"[\\`\[\]!<#^:]")
_PUNCTUATION = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Parsed:
    frontmatter: dict | None = None
    frontmatter_err: str = ""
    title: str = ""
    tags: list[str] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)
    headings: list[dict] = field(default_factory=list)
    blocks: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    inline: dict[str, list[str]] = field(default_factory=dict)


def split_frontmatter(raw: bytes) -> tuple[bytes | None, int]:
    """The YAML between a first line '---' and the next such line, and where the body begins; None if there is none."""
    head = re.match(rb"---[ \t\r]*\n", raw)
    if not head:
        return None, 0
    end = re.compile(rb"^---[ \t\r]*(?:\n|\Z)", re.M).search(raw, head.end())
    return (raw[head.end() : end.start()], end.end()) if end else (None, 0)


def _jsonable(value):
    if isinstance(value, dict):
        return {str(k): _jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_jsonable(v) for v in value]
    if isinstance(value, datetime.datetime):
        return (value if value.tzinfo else value.replace(tzinfo=datetime.UTC)).isoformat().replace("+00:00", "Z")
    if isinstance(value, datetime.date):
        return f"{value.isoformat()}T00:00:00Z"
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return str(value)
    return value


def decode_yaml(text: bytes) -> tuple[dict | None, str]:
    """The mapping that a front matter is, or why it is none."""
    import yaml

    try:
        value = yaml.load(text.decode("utf-8", "replace"), Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError, RecursionError) as why:
        return None, " ".join(str(why).split()) or "malformed"
    if value is None:
        return None, ""
    if not isinstance(value, dict):
        return None, "front matter is not a mapping"
    return _jsonable(value), ""


def _strings(value) -> list[str]:
    parts = value.split(",") if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, list) else []
    return [p.strip() for p in parts if p.strip()]


def _heading(line: bytes) -> tuple[int, str] | None:
    m = _ATX.match(line)
    if not m:
        return None
    title = line[m.end() :].decode("utf-8", "replace").strip()
    bare = title.rstrip("#")
    if bare != title and (not bare or bare[-1] in " \t"):
        title = bare
    return len(m[1]), title.strip()


def headings(body: bytes, offset: int = 0) -> list[dict]:
    """'#' headings outside code fences; a section ends where a heading of its level or less begins."""
    out: list[dict] = []
    fence: tuple[bytes, int] | None = None
    for begin in _MAYBE_HEADING.finditer(body):  # other lines neither are headings nor fence them off
        at = begin.start()
        line = body[at : (body.find(b"\n", at) + 1) or len(body)]
        text = line.rstrip(b"\n").rstrip(b"\r")
        m = _FENCE.match(text)
        if fence:
            if m and m[1][:1] == fence[0] and len(m[1]) >= fence[1] and not m[2].strip():
                fence = None
        elif m and not (m[1][:1] == b"`" and b"`" in m[2]):
            fence = (m[1][:1], len(m[1]))
        elif found := _heading(text):
            out.append({"level": found[0], "text": found[1], "slug": slug_of(found[1]), "start": offset + at, "end": 0, "body_start": offset + at + len(line)})
    open_: list[dict] = []
    for h in out:
        while open_ and open_[-1]["level"] >= h["level"]:
            open_.pop()["end"] = h["start"]
        open_.append(h)
    for h in open_:
        h["end"] = offset + len(body)
    return out


def _columns(line: bytes, at: int) -> int:
    """Blanks from at on, tabs to the next multiple of four."""
    n = 0
    while at < len(line) and line[at] in b" \t":
        n += 4 - n % 4 if line[at] == 9 else 1
        at += 1
    return n


def leaves(body: bytes) -> list[list[tuple[int, int]]]:
    """The spans of the lines of each paragraph or heading: what may hold inline constructs."""
    out: list[list[tuple[int, int]]] = []
    para: list[tuple[int, int]] = []
    # Open containers: ('q',) for quotations, ('l', indent) for list items.
    stack: list[tuple] = []
    code: tuple[bytes, int] | None = None
    html: re.Pattern | None = None
    depth_of_leaf = 0
    indented = False

    def close() -> None:
        nonlocal para, indented
        if para:
            out.append(para)
        para, indented = [], False

    at = 0
    for line in re.split(rb"(?<=\n)", body):
        if not line:
            continue
        start, pos, kept = at, 0, 0
        at += len(line)
        blank_line = not line.strip()
        for box in stack:
            if box[0] == "q":
                m = re.compile(rb" {0,3}> ?").match(line, pos)
                if not m:
                    break
                pos = m.end()
            elif blank_line or not line[pos:].strip():
                pass
            elif _columns(line, pos) >= box[1]:
                n = 0
                while n < box[1]:
                    n += 4 - n % 4 if line[pos] == 9 else 1
                    pos += 1
            else:
                break
            kept += 1
        rest = line[pos:]
        blank = not rest.strip()
        if code or html:
            if kept < depth_of_leaf and not (blank and kept == len(stack)):
                code = html = None
                del stack[kept:]
            elif code:
                m = _FENCE.match(rest)
                if m and m[1][:1] == code[0] and len(m[1]) >= code[1] and not m[2].strip():
                    code = None
                continue
            else:
                if html.search(rest):
                    html = None
                continue
        if kept < len(stack):
            lazy = bool(para) and not blank
            if lazy:
                probe = rest
                lazy = not (_ITEM.match(probe) or re.match(rb" {0,3}>", probe) or _FENCE.match(probe) or _ATX.match(probe) or _BREAK.match(probe) or _HTML.match(probe))
            if lazy:
                para.append((start + pos + len(rest) - len(rest.lstrip(b" \t")), at))
                continue
            if not (blank and all(b[0] == "l" for b in stack[kept:])):
                close()
                del stack[kept:]
        if blank:
            close_indented = indented
            close()
            indented = close_indented
            continue
        while True:  # new containers
            m = re.compile(rb" {0,3}> ?").match(line, pos)
            if m:
                close()
                stack.append(("q",))
                pos = m.end()
                continue
            m = _ITEM.match(line[pos:])
            if m and not _BREAK.match(line[pos:]) and _columns(line, pos) < 4:
                after = line[pos + m.end() :]
                if para and (not after.strip() or (m[2][:1].isdigit() and m[2][:-1] != b"1")):
                    break
                close()
                blanks = _columns(line, pos + m.end())
                if not after.strip():
                    width, skip = m.end() + 1, 0
                elif blanks >= 5:
                    width, skip = m.end() + 1, 1
                else:
                    width, skip = m.end() + blanks, len(after) - len(after.lstrip(b" \t"))
                stack.append(("l", width))
                pos += m.end() + skip
                if not after.strip():
                    break
                continue
            break
        rest = line[pos:]
        if not rest.strip():
            continue
        if not para and _columns(line, pos) >= 4:
            indented = True
            continue
        indented = False
        m = _FENCE.match(rest)
        if m and not (m[1][:1] == b"`" and b"`" in m[2]):
            close()
            code, depth_of_leaf = (m[1][:1], len(m[1])), len(stack)
            continue
        h = _HTML.match(rest)
        if h or (not para and _TAG7.match(rest)):
            close()
            depth_of_leaf = len(stack)
            ends = [rb"-->", rb"\?>", rb"\]\]>", rb">", rb"(?i)</(?:script|pre|style|textarea)>"]
            kind = next((i for i in range(5) if h and h[i + 1]), None)
            if kind is None:
                html = re.compile(rb"^\s*$")
                # ends at a blank line, which the test above sees
            else:
                html = re.compile(ends[kind])
                if html.search(rest, h.end() if kind in (0, 1, 2) else h.end(kind + 1)):
                    html = None
            continue
        if _ATX.match(rest):
            close()
            m = _ATX.match(rest)
            inner = rest[m.end() :]
            lead = len(inner) - len(inner.lstrip(b" \t"))
            bare = re.sub(rb"(?:^|[ \t])#+[ \t\r\n]*$", b"", inner).rstrip(b" \t\r\n")
            out.append([(start + pos + m.end() + lead, start + pos + m.end() + max(lead, len(bare)))])
            continue
        if para and _UNDER.match(rest) and kept == len(stack):
            close()
            continue
        if _BREAK.match(rest):
            close()
            continue
        lead = len(rest) - len(rest.lstrip(b" \t"))
        para.append((start + pos + lead, at))
    close()
    return out


def _letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def _key_char(c: str) -> bool:
    return c in " -_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"


def _may_precede_tag(c: str) -> bool:
    return c.isspace() or c in "\"'*_~" or unicodedata.category(c) in ("Ps", "Pi", "Pd")


def _destination(text: bytes, at: int) -> tuple[bytes, int] | None:
    """The destination of a link whose '(' is at at, and where its ')' ends."""
    i, n = at + 1, len(text)
    while i < n and text[i] in b" \t\r\n":
        i += 1
    if i < n and text[i] == 60:  # <...>
        j = i + 1
        while j < n and text[j] != 62:
            if text[j] in b"\n<":
                return None
            j += 2 if text[j] == 92 else 1
        if j >= n:
            return None
        dest, i = text[i + 1 : j], j + 1
    else:
        j, depth = i, 0
        while j < n:
            c = text[j]
            if c == 92 and j + 1 < n and text[j + 1] in _PUNCTUATION:
                j += 2
                continue
            if c <= 32:
                break
            if c == 40:
                depth += 1
            elif c == 41:
                if not depth:
                    break
                depth -= 1
            j += 1
        if depth:
            return None
        dest, i = text[i:j], j
    gap = i
    while i < n and text[i] in b" \t\r\n":
        i += 1
    if i < n and text[i] in b"\"'(" and i > gap:
        close = 41 if text[i] == 40 else text[i]
        j = i + 1
        while j < n and text[j] != close:
            j += 2 if text[j] == 92 else 1
        if j >= n:
            return None
        i = j + 1
        while i < n and text[i] in b" \t\r\n":
            i += 1
    return (dest, i + 1) if i < n and text[i] == 41 else None


class _Leaf:
    """One leaf block: its lines joined, and where each of their bytes lies in the body."""

    def __init__(self, body: bytes, spans: list[tuple[int, int]], offset: int):
        self.spans, self.offset = spans, offset
        self.text = b"".join(body[a:b] for a, b in spans).rstrip(b" \t\r\n") if len(spans) > 1 else body[spans[0][0] : spans[0][1]].rstrip(b"\r\n")
        self.starts = [0]
        for a, b in spans:
            self.starts.append(self.starts[-1] + b - a)

    def at(self, i: int) -> int:
        line = bisect_right(self.starts, i, 0, len(self.spans)) - 1
        return self.offset + self.spans[line][0] + i - self.starts[line]

    def line(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.starts, i, 0, len(self.spans)) - 1
        return self.starts[k], min(self.starts[k + 1], len(self.text))


def _inline(leaf: _Leaf, note: Parsed) -> None:
    text = leaf.text
    n = len(text)
    brackets: list[dict] = []  # open '[' and '!['
    found: list[tuple[int, int, dict]] = []
    i = 0
    while i < n:
        m = _MARKS.search(text, i)
        if not m:
            break
        i = m.start()
        c = text[i]
        if c == 92:  # backslash
            i += 2 if i + 1 < n and text[i + 1] in _PUNCTUATION else 1
        elif c == 96:  # code span
            run = re.compile(rb"`+").match(text, i)
            closing = next((x for x in re.compile(rb"`+").finditer(text, run.end()) if len(x[0]) == len(run[0])), None)
            i = closing.end() if closing else run.end()
        elif c == 60:
            m = _AUTO.match(text, i) or _INLINE_HTML.match(text, i)
            i = m.end() if m else i + 1
        elif c == 94:  # block id
            a, b = leaf.line(i)
            m = _BLOCK_ID.match(text[i:b])
            if m and a == leaf.line(n - 1)[0]:
                note.blocks.append({"id": m[1].decode(), "start": leaf.at(0), "end": leaf.at(i) + 1 + len(m[1])})
                i += 1 + len(m[1])
            else:
                i += 1
        elif c == 35:  # tag
            before = text[max(0, i - 8) : i].decode("utf-8", "ignore")[-1:] or text[:i].decode("utf-8", "ignore")[-1:] or "\n"
            if not _may_precede_tag(before):
                i += 1
                continue
            name = []
            for ch in text[i + 1 : leaf.line(i)[1]].decode("utf-8", "replace"):
                if not (ch in "-_/" or _letter(ch) or unicodedata.category(ch) == "Nd"):
                    break
                name.append(ch)
            tag = "".join(name).rstrip("/")
            if tag and any(map(_letter, tag)):
                note.tags.append("/".join(p for p in tag.split("/") if p))
                i += 1 + len(tag.encode())
            else:
                i += 1
        elif c == 58:  # key:: value
            a, b = leaf.line(i)
            if text[i + 1 : i + 2] == b":" and text[i + 2 : i + 3] != b":":
                key = text[a:i].decode("utf-8", "replace")
                if key.strip() and all(map(_key_char, key)):
                    note.inline.setdefault(key.strip(), []).append(text[i + 2 : b].decode("utf-8", "replace").strip())
                i += 2
            else:
                i += 1
        elif c == 33 and text[i + 1 : i + 2] != b"[":
            i += 1
        elif c in b"[!":
            embed = c == 33
            open_ = i + embed
            end = leaf.line(i)[1]
            if not embed and (size := _bracket_field(text[i:end], note)):
                i += size
                continue
            close = text.find(b"]]", open_ + 2, end) if text[open_ : open_ + 2] == b"[[" and text[open_ + 2 : open_ + 3] != b"[" else -1
            if close >= 0 and b"[[" not in text[open_ + 2 : close]:
                inner = text[open_ + 2 : close].decode("utf-8", "replace")
                target, _, alias = inner.partition("|")
                target, _, anchor = target.partition("#")
                if target.strip() or anchor.strip():
                    link = {"raw": text[i : close + 2].decode("utf-8", "replace"), "target": target.strip(), "alias": alias.strip(), "anchor": anchor.strip(), "kind": EMBED if embed else WIKI, "start": leaf.at(i), "end": leaf.at(close + 1) + 1}
                    found.append((i, i, link))
                    i = close + 2
                    continue
            if embed and close >= 0:
                i += 1
                continue
            brackets.append({"at": i, "embed": embed, "active": True})
            i = open_ + 1
        else:  # ]
            opener = brackets.pop() if brackets else None
            if opener and opener["active"] and text[i + 1 : i + 2] == b"(" and (got := _destination(text, i + 1)):
                raw = got[0].decode("utf-8", "replace")
                inside = opener["at"] + 1 + opener["embed"]
                # Alias: the text without marks of emphasis, code and wiki links inside.
                label = text[inside:i]
                for a, b, w in found:
                    if w["kind"] == WIKI and inside <= a < i:
                        label = label.replace(w["raw"].encode(), b"")
                label = re.sub(rb"\\([!-/:-@\[-`{-~])", rb"\1", re.sub(rb"[*`~]+", b"", label)).decode("utf-8", "replace")
                dest = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", raw)
                found.append((opener["at"], i, {"raw": dest, "target": percent_decoded(dest), "alias": label, "anchor": "", "kind": EMBED if opener["embed"] else MARKDOWN, "start": leaf.at(opener["at"]), "end": leaf.at(got[1] - 1) + 1}))
                if not opener["embed"]:
                    for other in brackets:
                        other["active"] = other["active"] and other["embed"]
                i = got[1]
            else:
                i += 1
    note.links += [x for _, _, x in sorted(found, key=lambda f: f[0])]


def _bracket_field(line: bytes, note: Parsed) -> int:
    """Records [key:: value] at the beginning of line; how many bytes to go on by."""
    text = line.decode("utf-8", "replace")
    i = 1
    while i < len(text) and _key_char(text[i]):
        i += 1
    key = text[1:i].strip()
    if not key or text[i : i + 2] != "::" or text[i + 2 : i + 3] == ":":
        return 0
    depth = 0
    for j in range(i + 2, len(text)):
        if text[j] == "[":
            depth += 1
        elif text[j] == "]":
            if not depth:
                if text[j + 1 : j + 2] in ("(", "["):
                    return 0
                note.inline.setdefault(key, []).append(text[i + 2 : j].strip())
                return len(text[: i + 2].encode())
            depth -= 1
    return 0


def parse(raw: bytes, bom: bool = True, parts: list[str] | None = None) -> Parsed:
    """The parts of a note; with bom, a leading byte order mark is no text, but counts in offsets.

    parts: fields of Parsed that are wanted, all by default; others may stay empty.
    """
    note = Parsed()
    shift = 3 if bom and raw.startswith(BOM) else 0
    raw = raw[shift:]
    yaml_text, begin = split_frontmatter(raw)
    if yaml_text is not None:
        note.frontmatter, note.frontmatter_err = decode_yaml(yaml_text)
    body = raw[begin:]
    fm = note.frontmatter or {}
    title = fm.get("title")
    if parts is None or "headings" in parts or ("title" in parts and not isinstance(title, str)):
        note.headings = headings(body, shift + begin)
    tags = [t.removeprefix("#") for k in ("tags", "tag") for t in _strings(fm.get(k))]
    note.aliases = [a for k in ("aliases", "alias") for a in _strings(fm.get(k))]
    if (parts is None or not {"tags", "blocks", "links", "inline"}.isdisjoint(parts)) and any(mark in body for mark in (b"[", b"#", b"^", b"::")):
        for spans in leaves(body):
            leaf = _Leaf(body, spans, shift + begin)
            if leaf.text:
                _inline(leaf, note)
    unique: dict[str, str] = {}
    for tag in tags + note.tags:
        unique.setdefault(tag.lower(), tag)
    note.tags = sorted(unique.values(), key=lambda t: t.encode())
    note.title = title if isinstance(title, str) else next((h["text"] for h in note.headings if h["level"] == 1), "")
    return note


def as_row(path: str, raw: bytes, parts: list[str] | None = None) -> dict:
    """The columns that sources.vault.NOTE names, of one note; parts: those that are wanted, others may be empty."""
    note = parse(raw, parts=parts)
    return {
        "title": note.title, "frontmatter": json.dumps(note.frontmatter, ensure_ascii=False) if note.frontmatter is not None else None, "frontmatter_err": note.frontmatter_err or None,
        "tags": note.tags, "aliases": note.aliases, "headings": note.headings, "blocks": note.blocks,
        "links": [{"ord": i} | x for i, x in enumerate(note.links)], "inline": list(note.inline.items()),
    }
