import os

import pytest

from marginalia.functions.errors import NoteError
from marginalia.operators import edit
from marginalia.plans.vault import Vault
from marginalia.sources import vault as source


@pytest.fixture
def folder(tmp_path):
    files = {"a.md": "# A\n\ntexto [[b]] e [[b#Dois|x]]\n", "sub/b.md": "---\nt: 1\n---\n# Um\r\nx\r\n## Dois\r\ny ^k1\r\n", "_h/.c.md": "", "img.png": "p", ".git/x.md": "no", ".Trash/x.md": "no", "~$a.md": "no", "n.txt": "no", "d.md": "[m](sub/b.md) [[sub/b]]\n"}
    for path, text in files.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_bytes(text.encode())
    return str(tmp_path)


def test_scan(spark, folder):
    got = {r.path: r["class"] for r in source.files(spark, folder).collect()}
    assert got == {"a.md": "note", "sub/b.md": "note", "_h/.c.md": "note", "img.png": "asset", "d.md": "note"}
    row = source.notes(spark, folder).where("path = 'sub/b.md'").first()
    assert row.eol == "\r\n" and row.title == "Um" and row.frontmatter == '{"t": 1}' and row.size == len(row.content.encode())


def test_hash():
    assert source.hash64(b"abc") == "44bc2cf5ad770999" == f"{source._xxh64(b'abc'):016x}"
    for n in (0, 1, 5, 8, 31, 32, 33, 100):
        assert source.hash64(bytes(range(n))) == f"{source._xxh64(bytes(range(n))):016x}"


def test_reads(spark, folder):
    v = Vault.open(spark, folder)
    assert v.note_read("sub/b.md", heading="dois")["content"] == "## Dois\r\ny ^k1\r\n"
    assert v.note_read("sub/b.md", block_id="k1")["content"] == "y ^k1"
    assert v.note_read("sub/b.md", include_frontmatter=False, max_bytes=4) | {"hash": ""} == {"content": "# Um", "hash": "", "section": "", "truncated": True}
    with pytest.raises(NoteError, match="HEADING_NOT_FOUND") as why:
        v.note_read("sub/b.md", heading="nada")
    assert why.value.alternatives == ["Um", "Dois"]
    assert [r.path for r in v.vault_search("texto").collect()] == ["a.md"]
    stats = v.vault_stats().first()
    assert (stats.notes, stats.assets, stats.orphans, stats.broken_links) == (4, 1, 3, 0)
    assert v.note_metadata("SUB/b.md").first().backlinks[0]["from"] == "a.md"
    assert v.inspect("sub/b.md").first().backlinks == 2
    assert len(v.resources()) == 4 and v.index_summary().first().notes == 4


def test_edits(spark, folder):
    v = Vault.open(spark, folder)
    read = lambda p: open(os.path.join(folder, p), "rb").read().decode()
    got = v.note_append("sub/b.md", "z", heading="Um")
    assert read("sub/b.md").endswith("y ^k1\r\n\r\nz\r\n") and "+z" in got["diff"]
    v.note_patch("sub/b.md", "w", block_id="k1")
    assert "w ^k1\r\n\r\nz" in read("sub/b.md")
    before = read("a.md")
    assert v.note_patch("a.md", "novo", heading="A", dry_run=True)["diff"].count("\n+novo") == 1 and read("a.md") == before
    with pytest.raises(NoteError, match="HASH_MISMATCH"):
        v.note_append("a.md", "x", expected_hash="0" * 16)
    v.note_create("novo/e.md", "oi", {"title": "E"})
    assert read("novo/e.md") == "---\ntitle: E\n---\n\noi"
    with pytest.raises(NoteError, match="ALREADY_EXISTS"):
        v.note_create("novo/e.md", "")
    with pytest.raises(NoteError, match="PATH_OUTSIDE_VAULT"):
        v.note_create("../e.md", "")
    v.refresh()
    moved = v.note_move("sub/b.md", "novo/c c.md")
    assert moved["rewritten"] == ["a.md", "d.md"] and moved["links_updated"] == 3 or moved["links_updated"] == 4
    assert read("a.md") == "# A\n\ntexto [[c c]] e [[c c#Dois|x]]\n"
    assert read("d.md") == "[m](novo/c%20c.md) [[novo/c c]]\n" and not os.path.exists(os.path.join(folder, "sub/b.md"))
    v.refresh()
    gone = v.note_delete("novo/c c.md")
    assert gone["trash_path"] == ".trash/c c.md" and set(gone["broken_links"]) == {"a.md", "d.md"} and gone["broken_anchors"] == ["a.md"]
    with pytest.raises(NoteError, match="READ_ONLY"):
        Vault.open(spark, folder, read_only=True).note_delete("a.md")


def test_rewrite_checks_offsets():
    link = {"raw": "[[a]]", "target": "a", "alias": "", "anchor": "", "kind": "wikilink", "start": 0, "end": 5}
    assert edit.rewritten(b"[[a]] [[a]]", [(link, "b"), (link | {"start": 6, "end": 11}, "c")]) == b"[[b]] [[c]]"
    with pytest.raises(NoteError, match="LINK_OFFSET_INVALID"):
        edit.rewritten(b"[[a", [(link, "b")])
    with pytest.raises(NoteError, match="LINK_OVERLAP"):
        edit.rewritten(b"[[a]] [[a]]", [(link, "b"), (link | {"start": 3, "end": 8}, "c")])


def test_interrupted_writes_leave_whole_notes(folder, monkeypatch):
    def fail(*_):
        raise OSError("stopped")

    monkeypatch.setattr(os, "replace", fail)
    with pytest.raises(OSError):
        source.write_note(folder, "a.md", b"new")
    assert open(os.path.join(folder, "a.md")).read().startswith("# A")
    open(os.path.join(folder, "sub", source.TEMPORARY + "1"), "w").close()
    assert source.sweep(folder) == 1


def test_move_leaves_other_bytes_alone(spark, tmp_path):
    kept = {"bad.md": b"caf\xe9 \xff [[x]] end", "bom.md": b"\xef\xbb\xbf[[x#A|b]]\r\nline\r\n", "utf.md": "na\u00efve \U0001f600 [[x]] [[x]]".encode()}
    for name, raw in (kept | {"x.md": b"# A\n"}).items():
        (tmp_path / name).write_bytes(raw)
    v = Vault.open(spark, str(tmp_path))
    got = v.note_move("x.md", "sub/z.md")
    assert got["links_updated"] == 4 and got["rewritten"] == sorted(kept)
    for name, raw in kept.items():
        assert (tmp_path / name).read_bytes() == raw.replace(b"[[x", b"[[z")
    assert (tmp_path / "sub/z.md").read_bytes() == b"# A\n" and not (tmp_path / "x.md").exists()


def test_links_are_rewritten_in_bytes(spark):
    from marginalia.operators import edit

    raw = b"caf\xe9 \xff [[x]] end"
    notes = spark.createDataFrame([("a.md", bytearray(raw))], "path string, content binary")
    links = spark.createDataFrame([("a.md", "x.md", "[[x]]", "x", "", "", "wikilink", 7, 12)], "from_path string, resolved string, raw string, target string, alias string, anchor string, kind string, start long, `end` long")
    assert bytes(edit.rewrite_links(notes, links, "x.md", "z.md").first()["content"]) == raw.replace(b"x", b"z")
    with pytest.raises(Exception, match="LINK_OFFSET_INVALID|is not at"):
        edit.rewrite_links(notes, links.withColumn("start", links["start"] + 1), "x.md", "z.md").collect()
