import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions.errors import NoteError
from marginalia.operators import links, metadata
from tests.test_search import make


def test_frontmatter_filters(spark):
    rows = [("a", {"autor": "José Silva", "n": 3, "x": {"y": [1, "Dois"]}, "d": "2024-05-06T00:00:00Z", "b": True, "z": None}), ("b", {"autor": ["jose silva", "Outro"], "n": 3.5}), ("c", None)]
    df = spark.createDataFrame([(p, json.dumps(f) if f is not None else None) for p, f in rows], "path string, fm string")
    ask = lambda k, v: [r.path for r in df.where(metadata.matches_field(F.col("fm"), k, v)).orderBy("path").collect()]
    assert ask("autor", "JOSE SILVA") == ["a", "b"]
    assert ask("autor", ["outro", "José silva"]) == ["b"] and ask("autor", ["nada"]) == []
    assert ask("n", 3) == ["a"] and ask("n", 3.0) == ["a"] and ask("n", 3.5) == ["b"] and ask("n", "3") == []
    assert ask("x.y", "dois") == ["a"] and ask("x.y", 1) == ["a"] and ask("x.q", None) == [] and ask("x", None) == ["a"]
    assert ask("d", datetime.date(2024, 5, 6)) == ["a"] and ask("d", "2024-05-06") == ["a"] and ask("b", True) == ["a"] and ask("b", False) == []


def test_list(spark):
    df = make(spark, {"B/x.md": "#civil/penal", "B/C/y.md": "#Civil", "z.md": "#civilista texto"}).cache()
    paths = lambda **k: [r.path for r in metadata.list_notes(df, **k).collect()]
    assert paths(tags=["#civil"]) == ["B/C/y.md", "B/x.md"]
    assert paths(tags=["civil", "civil/penal"]) == ["B/x.md"] and paths(tags=["civilista", "civil"], tag_mode="any") == ["B/C/y.md", "B/x.md", "z.md"]
    assert paths(folder="B", recursive=False) == ["B/x.md"] and paths(folder="/", recursive=False) == ["z.md"] and paths(folder="/") == ["B/C/y.md", "B/x.md", "z.md"]
    assert paths(pattern="*/*.md") == ["B/x.md"] and paths(pattern="[") == []
    assert paths(sort="size", order="desc") == ["z.md", "B/x.md", "B/C/y.md"] and paths(sort="modified", order="desc") == ["z.md", "B/x.md", "B/C/y.md"]
    page = metadata.list_notes(df, offset=1, limit=1).collect()
    assert [(r.path, r.total) for r in page] == [("B/x.md", 3)] and paths(offset=9) == []
    assert [(r.tag, r["count"]) for r in metadata.tag_counts(df, "CIVIL").collect()] == [("Civil", 1), ("civil/penal", 1), ("civilista", 1)]
    assert metadata.resolve_path(df, "b/X.MD") == "B/x.md"
    for bad, code in (("nada.md", "NOT_FOUND"), ("../a", "PATH_OUTSIDE_VAULT"), ("/a", "PATH_OUTSIDE_VAULT"), ("", "INVALID_PATH"), ("a\0", "INVALID_PATH")):
        with pytest.raises(NoteError, match=code):
            metadata.resolve_path(df, bad)


VAULT = {
    "Origem.md": "[[PONTO 03]] [[Terceiro]] [[Nao Existe]] ![[diagrama.png]] [[Civil/PONTO 03]] [s](https://x.org) [[P3#Parte]] [[P3#nada]] [[P3#^b1]] [[#eu]] [[PONTO 03.md]]",
    "Civil/PONTO 03.md": "[[PONTO 03]]", "Penal/PONTO 03.md": "[[PONTO 03]]", "Penal/x.md": "[[PONTO 03]] [[penal/PONTO 03]]", "P3.md": "---\naliases: [TERCEIRO]\n---\n## Parte\nt ^b1\n",
}


def test_resolution(spark):
    df = make(spark, VAULT).cache()
    assets = spark.createDataFrame([("Anexos/diagrama.png", 1)], "path string, size long")
    got = links.resolve(df, assets).cache()
    rows = {(r.from_path, r.ord): (r.resolved, r.via, r.state) for r in got.collect()}
    assert [rows["Origem.md", i] for i in range(11)] == [
        ("Civil/PONTO 03.md", "name", "ok"), ("P3.md", "alias", "ok"), (None, "", "target_missing"), ("Anexos/diagrama.png", "asset", "ok"), ("Civil/PONTO 03.md", "path", "ok"), (None, "", "external"),
        ("P3.md", "name", "ok"), ("P3.md", "name", "anchor_missing"), ("P3.md", "name", "ok"), (None, "", "target_missing"), ("Civil/PONTO 03.md", "name", "ok"),
    ]
    assert rows["Penal/PONTO 03.md", 0][0] == rows["Penal/x.md", 0][0] == "Penal/PONTO 03.md" and rows["Penal/x.md", 1] == (None, "", "target_missing")
    assert {r.path for r in links.orphans(df, got).collect()} == {"Origem.md", "Penal/x.md"}
    assert tuple(links.health(df, got).first()) == (2, 3, 1)
    assert links.backlinks(got).where("path = 'P3.md'").count() == 4
    nodes, edges = links.graph(got, df, "Origem.md", "outgoing", 1)
    assert {r.path for r in nodes.collect()} == {"Origem.md", "Civil/PONTO 03.md", "P3.md", "Nao Existe", "Anexos/diagrama.png"}
    nodes, edges = links.graph(got, df, "Penal/PONTO 03.md", "both", 2, include_broken=False)
    assert {(r.path, r.distance) for r in nodes.collect()} == {("Penal/PONTO 03.md", 0), ("Penal/x.md", 1)}
    assert {(r.source, r.target) for r in edges.collect()} == {("Penal/PONTO 03.md", "Penal/PONTO 03.md"), ("Penal/x.md", "Penal/PONTO 03.md")}
    nodes, _ = links.graph(got, df, "Origem.md", "outgoing", 1, include_embeds=False, limit=2)
    assert nodes.count() == 2


def test_tiebreak_equals_brute_force(spark):
    rng = random.Random(1)
    dirs = ["", "a/", "a/b/", "a/b/c/", "d/", "a/d/"]
    notes = {f"{d}{n}.md": " ".join(f"[[{rng.choice('xyz')}]]" for _ in range(3)) for d in dirs for n in "wxyz" if rng.random() < 0.7}
    got = links.resolve(make(spark, notes)).collect()

    def best(origin: str, name: str):
        own = origin.split("/")[:-1]

        def shared(p):
            n = 0
            for x, y in zip(own, p.split("/")[:-1]):
                if x != y:
                    break
                n += 1
            return n

        return min((p for p in notes if p.split("/")[-1] == f"{name}.md"), key=lambda p: (-shared(p), p), default=None)

    assert got and all(r.resolved == best(r.from_path, r.target) for r in got)


def test_doctor_and_totals(spark):
    df = make(spark, {"A.md": "x", "a.md": "y", "b.md": "#t"})
    assert tuple(metadata.doctor(df, "/r", 6).first()) == (3, 7, 3, 1)
    assert tuple(metadata.totals(df).first()) == (3, 0, 4, 1)


def test_a_graph_resolves_links_once(spark):
    df = make(spark, VAULT)
    _, edges = links.graph(links.resolve(df), df, "Penal/PONTO 03.md", "both", 3, include_broken=False)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Aggregate [key" not in plan
    assert {(r.source, r.target) for r in edges.collect()} >= {("Penal/PONTO 03.md", "Penal/PONTO 03.md"), ("Penal/x.md", "Penal/PONTO 03.md")}
