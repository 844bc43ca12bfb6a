"""Every operator over odd tables: nulls, empty and very long texts, repeated rows, no rows, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from marginalia.llm import bpe, images, jaccard, lines, mixing, quality, sharding, substring, toxicity, urls

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [(1, "", "en", "a"), (2, None, "en", "a"), (None, "look here you idiot", None, None), (3, LONG, "fr", "b"), (3, LONG, "fr", "b"), (4, "\n\n \t\n", "en", "a"), (5, "x", "en", None), (None, None, None, None), (6, "naïve 😀 ünï\0code\r\nline", "de", "b")]
#: Extra columns that operators use as names of their own.
EXTRA = ("print", "key", "rid", "tokens", "rate", "copies", "bucket", "shard", "unit", "bytes", "first", "half", "norm", "sig", "members", "group_id", "gone", "w", "hits", "terms", "host", "path", "best", "content", "tokens_", "line_no", "__id", "__tokens", "__copy", "row", "size", "v_0", "of_0", "copy", "a.b", "id", "lines", "of", "links", "class_id", "score", "threshold", "kept")
PLAIN = [c for c in EXTRA if "." not in c]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in EXTRA})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 0), (3, None, None), (99, 1, 1), (5, 7, 0)], LABELS)


OPS = {
    "substring": lambda s, d: substring.repeated_spans(d),
    "toxicity": lambda s, d: toxicity.toxic_documents(d, stems=toxicity.learn_lexicon(d, labels(s))[0]),
    "sharding": lambda s, d: sharding.shard(d, 3),
    "mixing": lambda s, d: mixing.rates(d, {"source": 0.5, "lang": 0.5}),
    "mixing_clash": lambda s, d: mixing.rates(d, {"tokens": 0.5, "a.b": 1.0}),
    "mixed": lambda s, d: mixing.mixed(d, {"source": 0.5}, floor=1.0),
    "lines": lambda s, d: lines.repeated_lines(d),
    "dedupe_lines": lambda s, d: lines.dedupe_lines(d),
    "bpe": lambda s, d: bpe.encode(d, verify=True),
    "jaccard": lambda s, d: jaccard.ngram_jaccard_classes(d),
    "one_per_group": lambda s, d: jaccard.keep_one_per_group(d),
    "quality": lambda s, d: quality.scored(d, labels(s)),
    "urls": lambda s, d: urls.filter_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), *PLAIN), urls.rules_table(s)),
    "images": lambda s, d: images.image_copies(d.drop("content").select(F.col("doc_id").alias("media_id"), F.col("text").cast("binary").alias("content"), *[c for c in PLAIN if c != "content"])),
}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(spark, docs, name):
    rows = OPS[name](spark, docs).collect()
    if name in ("sharding", "mixing", "bpe", "quality", "urls"):
        assert len(rows) == len(ROWS)  # one for each row
    if name == "mixed":
        assert len(rows) >= len(ROWS) and {r.tokens for r in rows} == {7}
    if name == "bpe":
        assert all(r.decodes in (True, None) and (r.tokens is None) == (r.decodes is None) for r in rows)
    if name == "substring":
        assert {(r.doc_id, r.end_word) for r in rows} == {(3, 1026), (3, 60_000)}  # the text repeats itself, too
    if name == "toxicity":
        assert [r.doc_id for r in rows] == [None] and rows[0].terms == ["idiot"]
    if name in ("one_per_group",):
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)  # repeated rows don't pair with themselves
    if name == "dedupe_lines":
        assert sum(r.doc_id == 3 for r in rows) == 2  # copies at one position: neither is earlier
    if name == "quality":
        assert all(r.kept for r in rows)  # no labels of both kinds


@pytest.mark.parametrize("name", OPS)
def test_no_rows(spark, empty, name):
    assert OPS[name](spark, empty).collect() == []
