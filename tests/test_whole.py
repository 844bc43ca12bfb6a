"""The whole job: nothing of a query's input is left out."""

import regex

import __spark_entry__
from marginalia.functions.text import TOKEN, analyse, plain, reduce_word
from marginalia.plans import catalog
from tests.conftest import SF


def test_search_reads_every_note(spark):
    query = analyse("of hain")
    texts = {r.path: r.content for r in catalog.notes(spark, SF).select("path", "content").collect()}
    terms = {t for pair in query for t in pair if t}

    def found(text):
        return {t for m in regex.finditer(TOKEN, text or "") for t in (plain(m[0]), reduce_word(plain(m[0])))} & terms

    hits = {p for p, t in texts.items() if found(t)}
    assert any(not texts[p].isascii() for p in hits)
    rows = __spark_entry__.entry(spark).collect()
    assert {r.total for r in rows} == {len(hits)} and {r.path for r in rows} <= hits
    assert any(not texts[r.path].isascii() for r in rows)
    for r in rows:
        # The snippet: 240 bytes at most, whole characters, from 120 bytes ahead of the first place of the first term there is.
        term = next(t for pair in query for t in pair if t and t in found(texts[r.path]))
        at = next(m.start() for m in regex.finditer(TOKEN, texts[r.path]) if term in (plain(m[0]), reduce_word(plain(m[0]))))
        start = max(0, len(texts[r.path][:at].encode()) - 120)
        assert r.snippet == texts[r.path].encode()[start : start + 240].decode("utf-8", "ignore")
    ranked = catalog.queries()["bm25_two_terms"](spark, SF).collect()  # held to SQL by test_catalog
    assert [r[:6] for r in rows] == [tuple(r) for r in ranked]
