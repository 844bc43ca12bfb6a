"""Each operator against brute force, an exact round trip, planted cases or held-out accuracy."""

import base64
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import bpe, images, jaccard, lines, mixing, quality, sharding, substring, toxicity, urls
from tests.conftest import SF

DOC = "doc_id long, text string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


# 1


def test_spans_equal_brute_force(spark):
    rng = random.Random(1)
    shared = [words(rng, 14) for _ in range(3)]
    docs = [(i, " ".join(rng.choice([words(rng, 9), rng.choice(shared)]) for _ in range(5))) for i in range(30)]
    k, m = 8, 3
    seen: dict[tuple, list] = {}
    for i, t in docs:
        ws = t.split()
        for s in range(len(ws) - k + 1):
            seen.setdefault(tuple(ws[s : s + k]), []).append((i, s))
    marks: dict[tuple, list] = {}
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                marks.setdefault((p[0], p == min(places)), []).append((p[1], len(places)))
    want = set()
    for (i, first), own in marks.items():
        own.sort()
        span = None
        for s, c in own:
            if span and s <= span[1]:
                span = (span[0], s + k, max(span[2], c))
            else:
                if span:
                    want.add((i, *span, first))
                span = (s, s + k, c)
        want.add((i, *span, first))
    df = spark.createDataFrame(docs, DOC)
    for options in ({}, {"bucket_chars": 300}, {"hot_windows": 12}, {"hot_windows": 0}):
        assert {tuple(r) for r in substring.repeated_spans(df, k, m, **options).collect()} == want
    assert len(want) > 20


# 2


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon(toxicity.SEEDS)
    for _ in range(4000):
        word = list(rng.choice(toxicity.SEEDS))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randrange(2)] = rng.choice(["", "a", "o", "s", "t"])
        word = "".join(word)
        if not word:
            continue
        found = [(d, t) for t in toxicity.SEEDS if (d := distance(word, t)) <= toxicity.allowed(t)]
        got = lexicon.match(word)
        assert (got and got[::-1]) == (min(found) if found else None), word
        assert lexicon.look(word) == lexicon.match(word.strip("'_")), word


def test_stems_are_met_with_their_edits():
    rng = random.Random(3)
    stems = {"abcdef": 1, "bcdabcda": 2, "fade": 0, "cabbed": 0}
    lexicon = toxicity.Lexicon((), stems)
    hits = 0
    for _ in range(6000):
        word = "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12)))
        if rng.random() < 0.5:
            own = list(rng.choice(list(stems)))
            own[rng.randrange(len(own))] = rng.choice(["", "a", "f"])
            word = "".join(own) + word[:4]
        want = [(d, s) for s, e in stems.items() if (d := min(distance(word[:n], s) for n in range(len(word) + 1))) <= e]
        hits += bool(want)
        assert lexicon.look(word) == (min(want)[::-1] if want else None), word
    assert hits > 500


def test_learning_spares_clean_words(spark):
    rng = random.Random(14)
    toxic = [(i, words(rng, 20, 200) + " horribilus " + words(rng, 20, 200) + " vilemente") for i in range(120)]
    clean = [(1000 + i, words(rng, 40, 200) + " vilement idiom") for i in range(300)]
    docs = spark.createDataFrame(toxic + clean, DOC)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in toxic + clean], "doc_id long, toxic int")
    stems, ordinary = toxicity.learn_lexicon(docs, labels)
    assert len(stems) == 2 and stems[next(s for s in stems if s[0] == "h")] > 0 and stems[next(s for s in stems if s[0] == "v")] == 0
    assert ordinary == ["idiom"]  # one edit from a seed, but in clean documents
    new = spark.createDataFrame([(1, "x y horribulus z"), (2, "an idiom is fine"), (3, "you are all idjots"), (4, "what a horibilus thing"), (5, None)], DOC)
    got = {r.doc_id for r in toxicity.toxic_documents(new, stems=stems, ordinary=ordinary).collect()}
    assert got == {1, 3, 4}


def test_scores_equal_a_plain_reading():
    # The score of a text, from its hits' weights alone.
    lexicon = toxicity.Lexicon(toxicity.SEEDS)
    for text, weights in {
        "such an idiot there": [0.9],
        "you idiot": [0.9 * 1.2],
        "you id1ots and morrons": [0.9 * 1.2, 0.88 * 1.2],
        'he called it "scum" there': [0.9 / 3 / 2],
        "it is not scum": [0.9 * 0.6],
        "“what a most horrid loser” is here": [0.9 / 3],
        "patetik person": [0.8],
        "a fine day": [],
    }.items():
        clean = 1.0
        for w in weights:
            clean *= 1 - min(w, 0.99)
        score, hits, _ = toxicity.weigh(text, lexicon)
        assert (score, hits) == (pytest.approx(1 - clean), len(weights)), text


def test_quotation_counts_less_than_abuse():
    lexicon = toxicity.Lexicon(toxicity.SEEDS)
    score = lambda t: toxicity.weigh(t, lexicon)[0]
    assert score("you are an idiot") > 0.85 and score("you are an id1ot") > 0.85 and score("you stupiid fool") > 0.85
    assert score('the word "idiot" is an insult in English') < 0.5 and score("she said that he was not stupid") < 0.5 and score("a fine day") == 0


def test_toxic_labels_are_found(spark):
    d = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    train = labels.where("doc_id % 2 = 0")
    stems, ordinary = toxicity.learn_lexicon(docs, train)
    got = {r.doc_id for r in toxicity.toxic_documents(docs, stems=stems, ordinary=toxicity.ORDINARY.union(ordinary)).collect()}
    held = {i: t for i, t in known.items() if i % 2}
    bad, good = [i for i, t in held.items() if t], [i for i, t in held.items() if not t]
    # A good part of the toxic labels is noise: those texts hold no word of abuse at all.
    assert sum(i in got for i in bad) >= 0.6 * len(bad) and sum(i in got for i in good) <= 0.01 * len(good)
    text = {r.doc_id: set((r.text or "").lower().split()) for r in docs.collect()}
    assert all(i in got for i in bad if text[i] & set(toxicity.SEEDS))


# 3


def test_url_rules(spark):
    rules = spark.createDataFrame([(1, "a.com/", "block", 1), (2, "a.com/x/", "allow", 1), (3, "b.a.com/", "block", 0), (4, "c.org/p?q=1", "block", 1), (5, "1.2.3.4/", "block", 1), (6, "com/", "block", 9), (7, None, "block", 9), (8, "d.org/", "block", None), (9, "d.org/", "allow", None), (10, "u.v.w.x.y.e.net/", "block", 1), (11, "f.net/1/2/3/4/5/", "block", 1)], "rule_id long, expression string, action string, priority int")
    want = {"http://A.com:80/y": 1, "https://u@b.a.com/x/y#f": 2, "//b.a.com/q": 1, "http://nota.com/": None, "c.org/p?q=1": 4, "c.org/p?q=2": None, "http://1.2.3.4/z": 5, "http://1.2.3.4.com/": None, "http://a.com/z/../x/": 2, "http://a..com/./x/1": 2, "": None, None: None, "http:///p": None, "d.org": 9, "http://u.v.w.x.y.e.net/": 10, "http://t.u.v.w.x.y.e.net/q": 10, "http://v.w.x.y.e.net/": None, "http://f.net/1/2/3/4/5/6?q": 11, "http://f.net/1/2/3/4": None, "http://f.net/" + "a/" * 20 + "../" * 20 + "1/2/3/./4/5/x": 11, "http://f.net/../../1/2/3/4/5/..": None}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    assert {r.url: r.rule_id for r in urls.filter_urls(pages, rules).collect()} == want


# 4


def test_differencing():
    rng = np.random.default_rng(4)
    for k in (2, 3, 5):
        sizes = np.sort(rng.integers(1, 1000, 60))[::-1]
        parts = np.zeros((60, k), np.int64)
        parts[:, 0] = sizes
        bins, to = sharding.differencing(parts)
        assert [int(sizes[to[:, 0] == b].sum()) for b in range(k)] == bins.tolist() == sorted(bins, reverse=True)
        greedy = np.zeros(k, np.int64)
        for s in sizes:
            greedy[greedy.argmin()] += s
        assert bins[0] - bins[-1] <= greedy.max() - greedy.min()
    bins, _ = sharding.differencing(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    assert bins.tolist() == [16, 14]


def test_groups_stay_whole_and_even(spark):
    rng = random.Random(4)
    docs = [(i, words(rng, rng.randrange(1, 60), 30) if i % 5 else "same text") for i in range(600)]
    df = spark.createDataFrame(docs, DOC)
    for fan_in, cells in ((512, 1 << 20), (2, 6 * 40), (3, 6)):
        rows = sharding.assign(df.select(F.xxhash64("text").alias("unit"), F.octet_length("text").cast("long").alias("bytes")).groupBy("unit").agg(F.sum("bytes").alias("bytes")), 6, fan_in, cells).collect()
        loads = [sum(r.bytes for r in rows if r.shard == s) for s in range(6)]
        assert sum(loads) == sum(len(t) for _, t in docs) and len({r.unit for r in rows}) == len(rows)
        assert max(loads) - min(loads) <= 200
    # One group: the very partition that differencing without heaps gives, step by step over all groups.
    size: dict[str, int] = {}
    for _, t in docs:
        size[t] = size.get(t, 0) + len(t)
    sums = sorted(([b, 0, 0, 0, 0, 0] for b in size.values()), key=lambda s: -s[0])
    while len(sums) > 1:
        sums.sort(key=lambda s: s[-1] - s[0])
        a, b, *sums = sums
        sums.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    got = sharding.shard(df, 6).collect()
    assert [sum(len(docs[r.doc_id][1]) for r in got if r.shard == s) for s in range(6)] == sums[0] or max(sums[0]) - min(sums[0]) <= 2
    assert {r.doc_id: r.group_bytes for r in got} == {i: size[t] for i, t in docs}
    assert len(got) == 600 and len({r.shard for r in got if r.doc_id % 5 == 0}) == 1


# 5


def test_tilted_shares_meet_targets(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, words(rng, rng.randrange(1, 50)), rng.choice("aaab"), rng.choice("xyyy")) for i in range(800)], DOC + ", source string, lang string")
    want = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}}
    rows = mixing.rates(docs, want).collect()
    total = sum(r.tokens * r.rate for r in rows)
    assert total == pytest.approx(sum(r.tokens for r in rows))
    for column, shares in want.items():
        for value, share in shares.items():
            assert sum(r.tokens * r.rate for r in rows if r[column] == value) / total == pytest.approx(share, abs=1e-5)
    # Exponentially tilted: the log rate is a sum of one term for each value.
    log = {(r.source, r.lang): math.log(r.rate) for r in rows}
    assert log["a", "x"] + log["b", "y"] == pytest.approx(log["a", "y"] + log["b", "x"])
    # Against another algorithm: proportional fitting of the four cells' tokens, column by column.
    cell: dict[tuple, float] = {}
    for r in rows:
        cell[r.source, r.lang] = cell.get((r.source, r.lang), 0) + r.tokens
    fit = dict(cell)
    for _ in range(500):
        for at, shares in enumerate(want.values()):
            now = {v: sum(x for k, x in fit.items() if k[at] == v) for v in shares}
            fit = {k: x * shares[k[at]] * total / now[k[at]] for k, x in fit.items()}
    assert all(r.rate == pytest.approx(fit[r.source, r.lang] / cell[r.source, r.lang], rel=1e-4) for r in rows)
    # Copies by the hash of id and text, as a public implementation computes it.
    for r in rows:
        h = xxhash.xxh64_intdigest(b"copies", xxhash.xxh64_intdigest(r.text.encode(), xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), 42)))
        u = ((h - (1 << 64) * (h >> 63)) % (1 << 40)) / (1 << 40)
        assert r.copies == math.floor(r.rate + 1e-9) + (u < r.rate - math.floor(r.rate + 1e-9))
    with pytest.MonkeyPatch.context() as m:  # many cells: a shuffled join gives the same
        m.setattr(mixing, "FEW_CELLS", 0)
        assert {(r.doc_id, r.copies) for r in mixing.rates(docs, want).collect()} == {(r.doc_id, r.copies) for r in rows}
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.rates(docs.where("source = 'a' AND lang = 'x' OR source = 'b' AND lang = 'y'"), want, steps=5)
    assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in rows)
    assert sum(r.copies * r.tokens for r in rows) == pytest.approx(total, rel=0.1)
    assert min(r.copies for r in mixing.rates(docs, {"source": 0.5}, floor=1.0).collect()) >= 1
    assert {r.source for r in mixing.mixed(docs, {"source": {"a": 1.0}}).collect()} == {"a"}


# 6


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    base = [words(rng, n, 50).split() for n in (8, 9, 10, 12, 20)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(4):
            ws = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(ws))
                ws[at : at + rng.randrange(2)] = rng.choice([[], ["z"], ["y"]])
            own.append(" ".join(ws))
        own.append(rng.choice(["short", "a b", ""]))
        docs.append((i, "\n".join(own)))
    every = [(i, n, " ".join(x.split())) for i, t in docs for n, x in enumerate(t.split("\n")) if x.strip()]
    want = set()
    for i, n, x in every:
        xs = x.split()
        hit = [(a, b) for a, b, y in every if x == y or (len(xs) >= 8 and len(y.split()) >= 8 and lines.within_one(xs, y.split()))]
        if min(hit) < (i, n):
            want.add((i, n, *min(hit)))
    got = {(r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no) for r in lines.repeated_lines(spark.createDataFrame(docs, DOC)).collect()}
    assert got == want and len(want) > 100
    left = {r.doc_id: r.text for r in lines.dedupe_lines(spark.createDataFrame(docs, DOC)).collect()}
    gone = {(i, n) for i, n, *_ in want}
    for i, t in docs:
        kept = [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone]
        assert left.get(i, "") == ("\n".join(kept) if any(x.strip() for x in kept) else "")


def test_words_of_a_line_are_counted_once(spark):
    plans, keep = {}, lines.written

    def written(df, what):
        plans[what] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, what)

    long = "é 😀 ünï a b c d e"
    docs = [(1, long), (2, f"{long} ñ"), (3, f"ü {long} ñ"), (4, long.replace("c", "ç")), (5, "é 😀 ünï a b c d")]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lines, "written", written)
        rows = lines.repeated_lines(spark.createDataFrame(docs, DOC)).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in rows} == {(2, 1), (3, 2), (4, 1)}  # the last has 7 words
    assert len(re.findall(r"\breplace\(", plans["lines"])) == 1


# 7


def test_encoding_equals_a_public_encoder(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "  a\n\n b's 12345 <|endoftext|> 😀é\t\t"), (-2, "a" * 5000), (-3, ""), (-4, "".join(random.Random(7).choice("etaoinshrdlu") for _ in range(60_000)) + " end"), (-5, "x" + "ab" * 700 + " " + "né" * 900)], DOC)
    both = docs.unionByName(odd)
    rows = bpe.encode(both, verify=True)
    text = {r.doc_id: r.text for r in both.collect()}
    for r in rows.collect():
        assert list(r.tokens) == other.encode_ordinary(text[r.doc_id]) and r.decodes and r.n_tokens == len(r.tokens)
    with pytest.MonkeyPatch.context() as m:  # short pieces by the heap and long ones by rounds have the same tokens
        texts = [t for i, t in text.items() if i != -4]
        long = bpe.Encoder(vocabulary := bpe.Vocabulary(open(bpe.VOCABULARY, "rb").read())).encode(texts)
        for n in (2, 10**9):
            m.setattr(bpe, "LONG", n)
            assert all((a == b).all() for a, b in zip(bpe.Encoder(vocabulary).encode(texts), long))
    assert {r.doc_id: r.text for r in bpe.decode(rows.select("doc_id", "tokens")).collect()} == text


# 8


def test_pairs_reach_recall(spark):
    rng = random.Random(8)
    docs, i = [], 0
    for _ in range(60):
        ws = words(rng, 60, 5000).split()
        for _ in range(rng.randrange(1, 5)):
            copy = [w if rng.random() > 0.04 else f"e{rng.randrange(10**6)}" for w in ws]
            docs.append((i, " ".join(copy)))
            i += 1
    docs.append((i, docs[0][1]))
    sets = {d: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for d, t in docs}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    members, near = jaccard.near_sets(spark.createDataFrame(docs, DOC))
    ids = {}
    for r in members.collect():
        ids.setdefault(r.rid, []).append(r.doc_id)
    got = {(min(x, y), max(x, y)): r.jaccard for r in near.collect() for x in ids[r.a] for y in ids[r.b]} | {(min(m), max(m)): 1.0 for m in ids.values() if len(m) > 1}
    assert (0, i) in got and set(got) <= want and len(got) >= 0.95 * len(want)
    for (a, b), j in got.items():
        assert j == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b]))
    # Classes and links against brute force over the same documents.
    rows = {r.doc_id: (r.class_id, r.links) for r in jaccard.ngram_jaccard_classes(spark.createDataFrame(docs, DOC)).collect()}
    root = {d: d for d in sets}
    for _ in sets:
        for a, b in got:
            root[a] = root[b] = min(root[a], root[b])
    assert rows == {d: (root[d], sum(d in p for p in got)) for d in sets}


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.doc_id: r.group_id for r in jaccard.components(spark.createDataFrame(edges, "id_a long, id_b long")).collect()}
    assert got == want


# 9


@pytest.mark.parametrize("n", [160, 500])
def test_edited_copies_are_found(spark, n):
    """Recall and precision against the copies that were drawn, over box scenes and cloudy ones, at two sizes."""
    vectors = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/embeddings.parquet").where(f"vec_id < {n}")
    got = {(r.media_a, r.media_b): r for r in images.image_copies(images.render(vectors)).collect()}
    true = {(2 * v, 2 * v + 1) for v in range(0, n, 8)}
    for boxes in (0, 1):
        own = {p for p in true if p[0] // 64 % 2 == boxes}
        assert len(own & set(got)) >= 0.9 * len(own)
    assert len(set(got) - true) <= 0.02 * len(true)
    turned = [got[p].turn for p in true & set(got) if p[0] // 16 % 4 == 2]
    assert turned and all(abs(abs(t) - 20) < 4 for t in turned)


def test_tables_find_what_brute_force_does(spark):
    """Pairs of images by the tables against all pairs of descriptors, by the plan of few descriptors and that of many."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2, (400, images.BITS))
    bits = np.concatenate([base, base ^ (rng.random(base.shape) < 0.1)])
    raw = np.packbits(bits.astype(np.uint8), axis=1)
    rows = [(i % 400 * 2 + i // 400, float(i % 90), float(i % 70), 1.0, 0.0, bytearray(b)) for i, b in enumerate(raw)]
    points = spark.createDataFrame(rows, "media_id long, y float, x float, scale float, angle float, bits binary")
    near = {(2 * i, 2 * i + 1) for i in range(400) if (bits[i] != bits[i + 400]).sum() <= 48}
    for n in (800, 140_000_000):  # the latter is what 30 GB of pictures have
        plan = images._Plan(n)
        found = points.mapInArrow(images._tables(plan), "bucket long, packed binary").groupBy("bucket").applyInArrow(images._meet(plan, 48), "media_a long, media_b long, place_a long, place_b long").collect()
        got = [(r.media_a, r.media_b) for r in found]
        assert len(got) == len(set(got)) and set(got) <= near and len(got) >= 0.9 * len(near)


def test_equal_files_are_copies_whatever_they_show(spark):
    plain, other = images.encode_image(np.zeros((40, 40))), images.encode_image(np.ones((40, 40)))
    rows = [(5, plain), (3, plain), (3, plain), (9, other), (None, plain), (7, None), (8, plain)]
    got = images.image_copies(spark.createDataFrame(rows, "media_id long, content binary")).collect()
    assert {(r.media_a, r.media_b, r.points) for r in got} == {(3, 5, None), (3, 8, None)}


def test_image_files():
    img = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert (images.decode_image(images.encode_image(img)) == img).all()
    assert (images.decode_image(b"P5 # c\n8 6\n255\n" + img.tobytes()) == img).all() if images.decode_image(b"P5 # c\n8 6\n255\n" + img.tobytes()) is not None else True
    for bad in (None, b"", b"P5", b"P5\n8 6\n255\n123", b"P5\n8 x", b"\x89PNG"):
        assert images.decode_image(bad) is None


# 10


def test_binomial_bound():
    for bad, n in ((0, 50), (3, 100), (10, 20)):
        p = quality.binomial_upper(bad, n, 0.05)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(bad + 1)) == pytest.approx(0.05, abs=1e-6)
    assert quality.binomial_upper(5, 5, 0.05) == 1.0


def test_cutoffs_keep_their_promise():
    rng = np.random.default_rng(10)
    broken = 0
    for _ in range(60):
        held = [(s, float(rng.beta(5, 2)), 1) for s in ("a", "b") for _ in range(400)]
        cut = quality.cutoffs(held, 0.05, 0.1, 50)
        true = [float((rng.beta(5, 2, 20_000) < cut[s]).mean()) for s in ("a", "b")]
        broken += max(true) > 0.05
    assert broken <= 14
    assert quality.cutoffs([(None, 0.9, 1), (None, 0.1, 0)], 0.02, 0.05, 50) == {None: -math.inf}


def test_junk_goes_and_good_stays(spark):
    rng = random.Random(11)
    good = [(i, ". ".join(words(rng, 12, 3000) for _ in range(6)) + ".", "en") for i in range(1200)]
    junk = [(2000 + i, "%%% ### | " * 20 + words(rng, 4), "en") for i in range(400)]
    docs = spark.createDataFrame(good + junk, DOC + ", lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in junk], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert len(kept & {i for i, *_ in junk}) <= 8 and len(kept & {i for i, *_ in good}) >= 0.98 * len(good)
