import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions.batches import pieces
from marginalia.sources import vault
from marginalia.sources.markdown import as_row, headings, parse, split_frontmatter


def links(text):
    return [(x["kind"], x["target"], x["anchor"], x["alias"]) for x in parse(text.encode()).links]


def test_frontmatter():
    n = parse("---\ntitle: Um\ntags: [a, '#b']\nalias: x, y\nday: 2024-05-06\nn: 3\n---\n# Dois\n".encode())
    assert n.title == "Um" and n.tags == ["a", "b"] and n.aliases == ["x", "y"]
    assert n.frontmatter["day"] == "2024-05-06T00:00:00Z" and n.frontmatter["n"] == 3
    assert split_frontmatter(b"---\na: 1\n") == (None, 0)
    bad = parse(b"---\na: [\n---\n# H\n")
    assert bad.frontmatter is None and bad.frontmatter_err and bad.title == "H"
    assert parse(b"no\n---\n").frontmatter is None


def test_headings_and_sections():
    body = "# A\n## B\ntext\n```\n# not\n```\n### C #\n# D#\n####### no\n    # no\n#no\n".encode()
    got = [(h["level"], h["text"], body[h["start"] : h["end"]].decode()) for h in headings(body)]
    assert [(a, b) for a, b, _ in got] == [(1, "A"), (2, "B"), (3, "C"), (1, "D#")]
    assert got[0][2].startswith("# A") and got[0][2].endswith("### C #\n") and got[3][2].endswith("#no\n")
    assert headings("# Ação é\n".encode())[0]["slug"] == "acao e"
    fence = headings(b"````\n```\n# x\n````\n~~~\n# y\n~~~ \n# z\n")
    assert [h["text"] for h in fence] == ["z"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("[[a]]", [("wikilink", "a", "", "")]),
        ("![[p.png|100]]", [("embed", "p.png", "", "100")]),
        ("[[ a # b | c ]]", [("wikilink", "a", "b", "c")]),
        ("[[a|b#c]]", [("wikilink", "a", "", "b#c")]),
        ("[[#h]]", [("wikilink", "", "h", "")]),
        ("[[|x]] [[]]", []),
        ("[[a\nb]]", []),
        ("[t](a%20b.md) ![i](<x y.png>)", [("markdown", "a b.md", "", "t"), ("embed", "x y.png", "", "i")]),
        ('[t](a "title")', [("markdown", "a", "", "t")]),
        ("`[[a]]` \\[[b]] [[c]]", [("wikilink", "c", "", "")]),
        ("```\n[[a]]\n```\n\n    [[b]]\n\n[[c]]", [("wikilink", "c", "", "")]),
        ("- x\n\n      [[code]]\n  - [[in]]", [("wikilink", "in", "", "")]),
        ("> [[q]]\nlazy [[z]]", [("wikilink", "q", "", ""), ("wikilink", "z", "", "")]),
        ("<!-- [[a]]\n\n[[b]] -->\n[[c]]", [("wikilink", "c", "", "")]),
    ],
)
def test_links(text, want):
    assert links(text) == want


def test_link_offsets_count_bytes_and_the_mark():
    raw = "﻿é [[a]] [x](b)".encode()
    assert [raw[x["start"] : x["end"]] for x in parse(raw).links] == [b"[[a]]", b"[x](b)"]


def test_tags():
    n = parse('#a (#b) "#c" x#d #1 #2x **#e** #f/g/ #h//i #A – #k'.encode())
    assert n.tags == ["2x", "a", "b", "c", "e", "f/g", "h/i", "k"]
    assert parse(b"# heading #t\n").tags == ["t"]


def test_blocks():
    raw = "um\ndois ^b1\n\n- item ^b2\n  - sub ^b3\n\nno ^x y\n\nmid ^n\nend\n".encode()
    got = {b["id"]: raw[b["start"] : b["end"]].decode() for b in parse(raw).blocks}
    assert got == {"b1": "um\ndois ^b1", "b2": "item ^b2", "b3": "sub ^b3"}


def test_inline_fields():
    n = parse("a:: 1 b:: 2\n\n[a:: 3] x [c d:: [[n]]] [e:: f](g)\nk::: no\n".encode())
    assert n.inline == {"a": ["1 b:: 2", "3"], "c d": ["[[n]]"]}
    assert [x["target"] for x in n.links] == ["n", "g"]


@pytest.mark.parametrize("raw", [b"", b"\xff\xfe\x00", b"---\n", b"[" * 3000, b"> " * 400 + b"x", b"`" * 999, ("é" * 100_000).encode(), b"- " * 300 + b"[[a]]"])
def test_odd_texts_do_not_fail(raw):
    json.dumps(as_row("p", raw), default=str)


ODD = [b"", b"\xff\xfe\x00", b"\xe2\x82 x \xf0\x9f\x98", b"\xed\xa0\x80", "\ufeff# H\r\ntext #t ^b\r\n".encode(), b"---\ntitle: T\naliases: a\n---\n# A\n[[x]]\n", b"a\rb\n# C\r\n", b"---\ntitle: 3\n---\n## B\n# D", None]


def test_some_columns_are_those_of_all(spark):
    rows = [(f"p{i}", len(t or b""), t) for i, t in enumerate(ODD)]
    raw = spark.createDataFrame(rows, "path string, size long, content binary").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    whole = {r.path: r for r in vault.parsed(raw).collect()}
    assert len(whole) == len(ODD) - 1 and all(whole[p].content == t.decode("utf-8", "replace") for p, _, t in rows if t is not None)
    for columns in (["path", "content"], ["path", "title", "bom"], ["path", "headings", "content"], ["path", "blocks"], ["path", "tags", "aliases", "links", "inline"], ["path", "hash", "eol", "mtime", "size"]):
        some = vault.parsed(raw, columns)
        assert some.columns == columns
        assert {r.path: r for r in some.collect()} == {p: type(r)(**{c: r[c] for c in columns}) for p, r in whole.items()}
    plan = lambda *c: vault.parsed(raw, list(c))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan("path", "headings") and "Python" not in plan("path", "content")


def test_texts_are_worked_on_in_pieces():
    sizes = [10, 2_000_000, 5, 5, None, 700_000, 400_000, 1] + [1] * 1200
    batch = pa.RecordBatch.from_arrays([pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())], ["content"])
    got = [p.column("content").to_pylist() for p in pieces([batch, batch.slice(0, 0)], "content", most=1_000_000, rows=500)]
    assert sum(got, []) == batch.column("content").to_pylist()
    assert all(len(p) <= 500 and (len(p) == 1 or sum(len(x or b"") for x in p) <= 1_000_000) for p in got)


def test_long_paragraphs_take_linear_time():
    raw = b"a: b\n" * 40_000
    began = time.process_time()
    parse(raw)
    assert time.process_time() - began < 10
