"""The whole job: nothing of an operator's input or result is left out."""

import random

from pyspark.sql import functions as F

from marginalia.llm import jaccard, quality
from tests.llm.test_operators import DOC, words


def test_every_copy_has_all_its_partners(spark):
    rng = random.Random(12)
    text = words(rng, 60, 5000)
    docs = [(i, text) for i in (1, 5, 9)] + [(i, text + " other") for i in (7, 11)] + [(3, words(rng, 60, 5000)), (4, None), (5, text)]
    members, near = jaccard.near_sets(spark.createDataFrame(docs, DOC))
    ids = {}
    for r in members.collect():
        ids.setdefault(r.rid, set()).add(r.doc_id)
    assert sorted(map(sorted, ids.values())) == [[1, 5, 9], [3], [7, 11]]
    assert [({*ids[r.a], *ids[r.b]}, r.jaccard) for r in near.collect()] == [({1, 5, 7, 9, 11}, 58 / 59)]
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.ngram_jaccard_classes(spark.createDataFrame(docs, DOC)).collect()}
    assert got == dict.fromkeys((1, 5, 7, 9, 11), (1, 4)) | {3: (3, 0), 4: (4, 0)}


def test_copies_are_joined_by_a_star(spark):
    docs = spark.createDataFrame([(i, "one text of a few words") for i in range(40)] + [(50, "another text of other words")], DOC)
    assert jaccard.star_pairs(*jaccard.near_sets(docs)).count() == 39
    assert {r.doc_id for r in jaccard.keep_one_per_group(docs).collect()} == {0, 50}
    assert {tuple(r) for r in jaccard.ngram_jaccard_classes(docs).collect()} == {(i, 0, 39) for i in range(40)} | {(50, 50, 0)}


def test_a_group_alike_throughout_is_tied_together_in_proportion_to_its_sets(spark, monkeypatch):
    rng = random.Random(14)
    text = words(rng, 120, 5000).split()

    def variant(i):
        w = list(text)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"v{i}x{rng.randrange(99)}"
        return " ".join(w)

    docs = spark.createDataFrame([(i, variant(i)) for i in range(150)] + [(200 + i, words(rng, 60, 5000)) for i in range(20)], DOC)
    members, near = jaccard.near_sets(docs, connected=True)
    assert near.count() < 8 * 150 and near.where("jaccard < 0.6").isEmpty()
    every = jaccard.near_sets(docs)[1].select("a", "b").collect()
    assert len(every) == 150 * 149 / 2
    assert {r.doc_id for r in jaccard.keep_one_per_group(docs).collect()} == {0, *range(200, 220)}
    # A home in many parts has the same pairs, each once.
    monkeypatch.setattr(jaccard, "SETS", 20)
    monkeypatch.setattr(jaccard, "VERIFIED", 500)
    assert sorted(map(tuple, jaccard.near_sets(docs)[1].select("a", "b").collect())) == sorted(map(tuple, every))


def test_labels_beyond_the_sample_choose_cutoffs(spark):
    rng = random.Random(13)
    good = [(i, ". ".join(words(rng, 12, 3000) for _ in range(6)) + ".", "en") for i in range(900)]
    junk = [(2000 + i, "%%% ### | " * 20 + words(rng, 4), "en") for i in range(300)]
    docs = spark.createDataFrame(good + junk, DOC + ", lang string").cache()
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in junk], "doc_id long, quality int")
    rows = quality.scored(docs, labels, max_labels=120).collect()
    assert len(rows) == 1200 and sum(r.kept for r in rows if r.doc_id >= 2000) <= 6 and sum(r.kept for r in rows if r.doc_id < 2000) >= 0.98 * 900


def test_filter_of_ids_loses_none(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = docs.where("doc_id % 7 = 3").select("doc_id")
    got = {r.doc_id for r in quality._perhaps(docs, ids).select("doc_id").collect()}
    want = set(range(3, 40_000, 7))
    assert want <= got and len(got) < len(want) + 200
