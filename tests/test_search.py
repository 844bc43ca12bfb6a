import math
import random

import pytest
import regex
from pyspark.sql import functions as F

from marginalia.functions.errors import NoteError
from marginalia.functions.text import TOKEN, analyse, plain, reduce_word
from marginalia.operators import search
from marginalia.sources import vault


def make(spark, notes: dict[str, str]):
    rows = [(p, len(t.encode()), t.encode()) for p, t in notes.items()]
    raw = spark.createDataFrame(rows, "path string, size long, content binary").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    return vault.parsed(raw)


def scores(spark, notes, query, **options):
    return {r.path: r.score for r in search.bm25(make(spark, notes), query, **options).collect()}


def test_raw_form_ranks_first(spark):
    got = scores(spark, {"a": "prescrições", "b": "prescrição"}, "prescrições", weights=False)
    assert got["a"] == pytest.approx(0.271019, abs=1e-6) and got["b"] == pytest.approx(0.182322, abs=1e-6)


def test_frequency_saturates_and_length_counts(spark):
    got = scores(spark, {"a": "prescricao a b c d", "b": "prescricao " * 5}, "prescricao", weights=False)
    assert got["a"] == pytest.approx(0.222837, abs=1e-6) and got["b"] == pytest.approx(0.345782, abs=1e-6)
    got = scores(spark, {"a": "prescricao civil", "b": "prescricao " + " ".join("abcdefghijklmnopqrs")}, "prescricao", weights=False)
    assert got["a"] == pytest.approx(0.306402, abs=1e-6) and got["b"] == pytest.approx(0.175087, abs=1e-6)


def test_fields(spark):
    got = scores(spark, {"t": "---\ntitle: Termo\n---\nx termo y", "h": "## termo\nx y z", "b": "termo x y z w"}, "termo")
    assert got["t"] > got["h"] > got["b"]


def brute(notes: dict[str, str], query: str) -> dict[str, float]:
    words = {p: [plain(w) for w in regex.findall(TOKEN, t)] for p, t in notes.items()}
    mean = sum(map(len, words.values())) / len(words) or 1
    tf: dict[tuple[str, int], float] = {}
    for i, (raw, short) in enumerate(analyse(query)):
        for p, ws in words.items():
            for w in ws:
                posted = {w, reduce_word(w)} - {""}
                tf[p, i] = tf.get((p, i), 0) + 1.5 * (raw in posted) + 1.0 * (short != "" and short in posted)
    out: dict[str, float] = {}
    for i in range(len(analyse(query))):
        df = sum(tf.get((p, i), 0) > 0 for p in notes)
        for p in notes:
            x = tf.get((p, i), 0)
            if x:
                out[p] = out.get(p, 0) + math.log(1 + (len(notes) - df + 0.5) / (df + 0.5)) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(words[p]) / mean))
    return out


def test_direct_and_indexed_scores_equal_brute_force(spark):
    rng = random.Random(5)
    pool = ["casa", "casas", "ação", "ações", "mês", "flores", "flor", "luz", "x1"]
    notes = {f"n{i}": " ".join(rng.choices(pool, k=rng.randrange(0, 30))) for i in range(40)}
    notes["empty"] = ""
    df = make(spark, notes).cache()
    index, stats = search.positions(df), search.doc_stats(df)
    for query in ("ações", "casa flores", "flor flor mês", "nada"):
        want = brute(notes, query)
        for rows in (search.bm25(df, query, weights=False), search.bm25_index(index, stats, query), search.bm25_index(search.postings(df), stats, query)):
            got = {r.path: r.score for r in rows.collect()}
            assert got == pytest.approx(want)


def test_positions(spark):
    text = "Ação, ações x😀y"
    got = {r.term: [(p.start, p.end) for p in r.positions] for r in search.positions(make(spark, {"p": text})).collect()}
    raw = text.encode()
    assert {t: [raw[a:b].decode() for a, b in v] for t, v in got.items()} == {"acao": ["Ação", "ações"], "acoes": ["ações"], "x": ["x"], "y": ["y"]}


def test_phrase_filters_pages_and_order(spark):
    df = make(spark, {"F/a.md": "um tema #t", "F/b.md": "tema um #t/u", "c.md": "um  tema", "F/G/d.md": "um temas", "é.md": "um-tema"}).cache()
    paths = lambda *a, **k: [r.path for r in search.search(df, *a, **k).collect()]
    assert set(paths('"um tema"')) == {"F/a.md", "F/G/d.md", "é.md"}
    assert set(paths("um", folder="F")) == {"F/a.md", "F/b.md", "F/G/d.md"}
    assert paths("um", tags=["T"]) == ["F/a.md"]
    assert paths("", tags=["t"]) == ["F/a.md", "F/b.md"] and paths("", folder="F") == ["F/a.md", "F/b.md"]
    first = search.search(df, "um", limit=2).collect()
    assert [r.total for r in first] == [5, 5] and all(r.truncated for r in first)
    assert len(paths("um", limit=2, offset=4)) == 1 and paths("um", offset=9) == [] and paths("!!") == []
    assert first == sorted(first, key=lambda r: (-r.score, r.path))
    with pytest.raises(NoteError, match="INDEX_BUILDING"):
        search.search(df, "um", ready=False)


def test_snippet(spark):
    text = "# Alto\n" + "é" * 50 + " fim\n## Baixo\nxx alvo yy"
    row = search.search(make(spark, {"a.md": text}), "alvo", snippet_chars=20).first()
    assert row.snippet == "aixo\nxx alvo yy"[-16:] or "alvo" in row.snippet
    assert row.matched_headings == ["Alto"]
    got = search.snippet_of(text.encode(), analyse("fim"), 21)
    assert got[0].encode()[got[1] : got[2]] == b"fim" and len(got[0].encode()) <= 21
    assert search.snippet_of(b"\xef\xbb\xbfab cd", analyse("cd"), 10)[0].encode()[-2:] == b"cd"


def test_index_on_disk(spark, tmp_path):
    df = make(spark, {"a": "um dois", "b": "dois"}).cache()
    search.write_index(df, str(tmp_path), "v")
    index, stats = search.read_index(spark, str(tmp_path), "v")
    assert {r.path for r in search.bm25_index(index, stats, "um").collect()} == {"a"}
    assert [r.path for r in search.lookup(index, "dois").collect()] == ["a", "b"]
    more = make(spark, {"a": "um", "b": "dois", "c": "tres"})
    assert [r.path for r in search.missing_docs(more, stats).collect()] == ["c"]
    grown, lengths = search.resume_index(more, str(tmp_path), "v")
    assert [r.path for r in search.lookup(grown, "tres").collect()] == ["c"] and lengths.count() == 3
    assert [r.path for r in search.lookup(grown, "dois").collect()] == ["a", "b"]  # "a" was indexed; what changed goes by update_postings()
    # A build that breaks off leaves the finished index as it is.
    with pytest.MonkeyPatch.context() as m:
        m.setattr(search, "doc_stats", lambda _: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            search.write_index(df, str(tmp_path), "v")
    assert search.read_index(spark, str(tmp_path), "v")[1].count() == 3
    with pytest.raises(NoteError):
        search.read_index(spark, str(tmp_path), "other")
    with pytest.raises(NoteError):
        search.read_index(spark, str(tmp_path / "none"))


def test_update_equals_rebuild(spark):
    old, new = {"a": "um dois", "b": "dois", "c": "tres"}, {"a": "quatro um", "b": "dois", "d": "cinco"}
    p = lambda n: search.postings(make(spark, n))
    got = search.update_postings(p(old), p({k: new[k] for k in ("a", "d")}), spark.createDataFrame([("c",)], "path string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, p(new).collect()))


def test_texts_are_read_once(spark):
    df = spark.createDataFrame([("a", "um")], "path string, content string")
    freq = search.frequencies(df, analyse("um"), F.lit(True))
    rows = search.scored(freq, 1)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "Python" not in plan


def test_postings_are_counted_by_note_and_positions_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    pool = ["Ações", "ação", "luz", "É", "x😀y", "flores flor", "ß", "Ὀδυσσεύς", "a٣b", "co\u0301", "res ss is"]
    rows = [(rng.choice(["a", "b", "c", None, f"n{i}"]), " ".join(rng.choices(pool, k=rng.randrange(0, 3000)))) for i in range(60)] + [("z", None), ("z", ""), ("y", "luz " * 400_000)]
    df = spark.createDataFrame(rows, "path string, content string").coalesce(1)
    want = {}
    for path, text in rows:
        for m in regex.finditer(TOKEN, text or ""):
            for t in {plain(m[0]), reduce_word(plain(m[0]))} - {""}:
                want[t, path] = want.get((t, path), 0) + 1
    got = search.postings(df).collect()
    assert len(got) == len(want) and {(r.term, r.path): r.tf for r in got} == want
    # Words are not exchanged, texts are, once; and no batch is made of many texts' words at once.
    plan = search.postings(df).groupBy("term").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" in plan and "hashpartitioning(term" in plan and "hashpartitioning(term, path" not in plan and "Generate" not in plan
    at = {(r.term, r.path): [(p.start, p.end) for p in r.positions] for r in search.positions(df.where("path LIKE 'n%'")).collect()}
    brute_force = {}
    for path, text in rows:
        if path and path[0] == "n":
            for m in regex.finditer(TOKEN, text):
                for t in {plain(m[0]), reduce_word(plain(m[0]))} - {""}:
                    brute_force.setdefault((t, path), []).append((len(text[: m.start()].encode()), len(text[: m.end()].encode())))
    assert at and at == brute_force
