"""Toxic language: a lexicon trie met with Levenshtein automata, hits weighed by their context."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import U64, chunks, written

#: Whole words known beforehand, without such as other languages' syllables make up; more stems are learned from labels.
SEEDS = ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "scumbag", "trash", "clown", "clowns", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "retard", "asshole", "bastard")
#: Words that report speech, or speak of words, in several languages.
REPORTING = frozenset("said says say quote quoted quotes called calls term terms word words slur insult insults wrote written headline title dit mot terme appelle sagte wort begriff nannte dijo palabra llamo término".split())
NEGATION = frozenset("not never isn't aren't wasn't don't no pas jamais nicht nie kein nunca".split())
ADDRESS = frozenset("you your you're u ur yourself tu vous toi ton du dich dein ihr usted tú eres".split())
#: Words of their own that an edit or two parts from a term.
ORDINARY = frozenset("crash brash thrash crown crowns clowned blown brown lover lovers lower lowers closer closers poser loner loners loners lodger loses losing idiom idioms boron regard regards record retort retire reward mustard custard basted empathetic apathetic sympathetic prophetic worthiness deathless trace trach tras scummy".split())
_LEET = str.maketrans("013457@$", "oieastas")
_ODD = re.compile(r"[0-9@$]")
_WORD = re.compile(r"[\w@$']+")
_OPEN, _CLOSE = "\"'«“‘„(", "\"'»”’“)"
REMEMBERED = 500_000


def allowed(term: str) -> int:
    """Edits under which a term of this length is still recognised."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class _Node:
    __slots__ = ("next", "word", "stem", "edits", "slack")

    def __init__(self) -> None:
        self.next: dict[str, _Node] = {}
        self.word = self.stem = None
        self.edits = self.slack = 0


def _letters(words: list[str], width: int) -> np.ndarray:
    """For each word and each of its first `width` letters, a bit for each letter up to there; some letters share theirs."""
    code = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
    return np.bitwise_or.accumulate(np.where(code > 0, U64(1) << code % U64(63), U64(0)), 1)


class Lexicon:
    """A trie of whole words and of stems, both found with misspellings.

    stems: beginnings of words, and how many edits each of them allows (none where they are
    but listed). ordinary: words that are not misspellings of any of them.
    """

    def __init__(self, terms: Iterable[str], stems: Mapping[str, int] | Iterable[str] = (), ordinary: Iterable[str] = ()):
        self.root = _Node()
        stems = dict(stems) if isinstance(stems, Mapping) else dict.fromkeys(stems, 0)
        terms = [t.lower() for t in terms if t]
        stems = {s.lower(): e for s, e in stems.items() if s}
        known = [(t, allowed(t)) for t in terms] + list(stems.items())
        for term in terms:
            self._add(term, allowed(term)).word = term
        for stem, slack in stems.items():
            node = self._add(stem, slack)
            node.stem, node.edits = stem, slack
        self.sizes = np.array([len(t) for t, _ in known], np.int64)
        self.spare = np.array([e for _, e in known], np.int64)
        self.whole = np.arange(len(known)) < len(terms)
        self.width = int((self.sizes + self.spare).max(initial=1))
        self.letters = _letters([t for t, _ in known], self.width)[:, -1] if known else np.zeros(0, np.uint64)
        self.ordinary = frozenset(ordinary)
        self.memo: dict[str, tuple[str, int] | None] = {}

    def _add(self, term: str, slack: int) -> _Node:
        node = self.root
        node.slack = max(node.slack, slack)
        for c in term:
            node = node.next.setdefault(c, _Node())
            node.slack = max(node.slack, slack)
        return node

    def matches(self, word: str) -> Iterator[tuple[int, str, bool]]:
        """(edits, term, whether it is a stem) of every term that a word may be.

        The word's Levenshtein automaton runs down the trie: for each number of edits a bit
        set of the positions it may be at. A whole word is met at the word's end, a stem
        wherever the automaton is when the stem ends. Swapped neighbours are two edits.
        """
        n = len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        end = 1 << n
        full = (end << 1) - 1
        stack = [(self.root, tuple(1 << e & full for e in range(self.root.slack + 1)))]
        while stack:
            node, states = stack.pop()
            if node.word is not None:
                for e, s in enumerate(states[: allowed(node.word) + 1]):
                    if s & end:
                        yield e, node.word, False
                        break
            if node.stem is not None:
                for e, s in enumerate(states[: node.edits + 1]):
                    if s:
                        yield e, node.stem, True
                        break
            for c, child in node.next.items():
                mask = at.get(c, 0)
                new, under, made = [], 0, 0
                for s in states[: child.slack + 1]:
                    made = ((s & mask) << 1 | under | under << 1 | made << 1) & full
                    new.append(made)
                    under = s
                if any(new):
                    stack.append((child, tuple(new)))

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a word is, and the edits between them; of several the one of fewest edits, then the first in order."""
        best = min(((e, t) for e, t, _ in self.matches(word) if not e or word not in self.ordinary), default=None)
        return best and (best[1], best[0])

    def _possible(self, words: list[str]) -> np.ndarray:
        """Whether a word can be any term by its length and the letters of its beginning: it may lack, and have besides, as many as there may be edits."""
        size = np.fromiter(map(len, words), np.int64, len(words))[:, None]
        seen = _letters(words, self.width)
        fits = (size >= self.sizes - self.spare) & (~self.whole | (size <= self.sizes + self.spare))
        fits &= np.bitwise_count(self.letters & ~seen[:, self.sizes + self.spare - 1]) <= self.spare
        fits &= np.bitwise_count(seen[:, np.maximum(self.sizes - self.spare, 1) - 1] & ~self.letters) <= np.maximum(self.spare, self.sizes <= self.spare)
        return fits.any(1)

    def learn(self, words: Iterable[str]) -> None:
        """Looks up words, without apostrophes, digits and signs read as letters, and remembers them."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > REMEMBERED:
            self.memo.clear()
        self.memo.update(dict.fromkeys(new))
        if not len(self.letters):
            return
        for lo in range(0, len(new), 20_000):
            own = new[lo : lo + 20_000]
            for read in (lambda w: w.strip("'_"), lambda w: w.strip("'_").translate(_LEET)):
                plain = [read(w) for w in own]
                for i in np.flatnonzero(self._possible(plain)).tolist():
                    self.memo[own[i]] = self.match(plain[i])
                own = [w for w in own if self.memo[w] is None and _ODD.search(w)]
                if not own:
                    break

    def look(self, word: str) -> tuple[str, int] | None:
        """What learn() found for a word."""
        if word not in self.memo:
            self.learn([word])
        return self.memo[word]


def weigh(text: str, lexicon: Lexicon, window: int = 8) -> tuple[float, int, list[str]]:
    """A text's score, its hits and their terms.

    Each hit weighs 0.9, less 0.02 for one edit and 0.1 for two. Within quotation marks it counts a third, near a
    word that reports speech half, after a negation 0.6 of it; near words that address
    somebody, or near another hit, 1.2 times. The score is the chance that one of the hits, taken as independent, is abuse.
    """
    spans = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text.lower())]
    hits = [(i, found) for i, (_, _, w) in enumerate(spans) if (found := lexicon.look(w))]
    clean = 1.0
    near = {i for i, _ in hits}
    for i, (term, edits) in hits:
        weight = (0.9, 0.88, 0.8)[edits]
        lo, hi = max(0, i - window), i + window + 1
        around = [w for _, _, w in spans[lo:hi]]
        start, end, own = spans[i]
        before, after = text[max(0, start - 1) : start], text[end : end + 1]
        quoted = (before and before in _OPEN and after and after in _CLOSE) or (own[0] == own[-1] == "'" and len(own) > 2)
        if not quoted:  # inside a longer quotation: an opening mark before, a closing one after, in the window
            head, tail = text[max(0, spans[lo][0] - 1) : start], text[end : spans[min(hi, len(spans)) - 1][1] + 1]
            quoted = ("“" in head and "”" in tail) or ("«" in head and "»" in tail) or (head.count('"') % 2 == 1 and '"' in tail)
        if quoted:
            weight /= 3
        if not REPORTING.isdisjoint(around):
            weight /= 2
        if not NEGATION.isdisjoint(w for _, _, w in spans[max(0, i - 3) : i]):
            weight *= 0.6
        if not ADDRESS.isdisjoint(around) or any(j != i and j in near for j in range(lo, hi)):
            weight *= 1.2
        clean *= 1 - min(weight, 0.99)
    return 1 - clean, len(hits), sorted({term for _, (term, _) in hits})


def learn_lexicon(docs: DataFrame, labels: DataFrame, terms: Iterable[str] = SEEDS, max_toxic: int = 4000, max_clean: int = 8000, shortest: int = 4, risk: float = 0.01) -> tuple[dict[str, int], list[str]]:
    """Stems that only toxic documents use, with the edits that each allows, and ordinary words that are like terms, from at most so many labelled documents of either kind.

    The sample is that of least hash of doc_id; repeated labels count as toxic if one is. A
    stem is a beginning of words, of shortest letters or more, of which
    toxic documents have at least 50 times as many as clean ones, in so many documents that
    chance would give none (at level risk over all stems); places with the same word before
    count once, so that copies of a document don't add up. Of stems that begin alike the
    shortest is taken and lengthened as long as it loses no occurrence. It allows as many
    edits as its length does (see allowed()) while no word of the clean sample is met by them.
    Words of clean documents that are not exactly a term, but within its edits, are
    ordinary. Without labels of both kinds nothing is learned; null texts and labels count for nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id", F.lit("lexicon")), "doc_id")
    sample = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample's size is bounded, so its ids may be broadcast whatever the corpus' size.
    own = text.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+").alias("w"))
    pair = F.posexplode("w").alias("i", "word")
    words = own.select("doc_id", "toxic", "w", pair).where(F.length("word") >= shortest).select("doc_id", "toxic", "word", F.when(F.col("i") > 0, F.get("w", F.col("i") - 1)).otherwise("").alias("before"))
    places = written(words.groupBy("word", "before").agg(F.min(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("doc"), F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")), "places")
    by_word = places.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    stems = F.explode(F.transform(F.sequence(F.lit(shortest), F.length("word")), lambda n: F.substring("word", 1, n))).alias("stem")
    by_stem = by_word.select(stems, "toxic", "clean").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    mass = by_stem.agg(F.sum("toxic"), F.sum("clean"), F.count("*")).first()
    if not mass[0] or not mass[1]:
        return {}, []
    need = max(5, int(log(risk / mass[2]) / log(mass[0] / (mass[0] + mass[1]))) + 1)
    likely = by_stem.where((F.col("toxic") >= need) & (F.col("clean") * 50 <= F.col("toxic")))
    spread = places.where("toxic > 0").select("word", "doc", stems).join(likely.select("stem"), "stem").groupBy("stem").agg(F.countDistinct("doc").alias("docs"))
    # Only stems of the bounded sample come to the driver.
    found = {r["stem"]: r["toxic"] for r in likely.join(spread.where(F.col("docs") >= need), "stem").select("stem", "toxic").collect()}
    out: list[str] = []
    for stem in sorted(found, key=lambda s: (len(s), s)):
        if any(stem.startswith(s) or s.startswith(stem) for s in out):
            continue
        while longer := [s for s in found if len(s) == len(stem) + 1 and s.startswith(stem) and found[s] == found[stem]]:
            stem = longer[0]
        out.append(stem)
    widest, fixed = {s: allowed(s) for s in out}, sorted(set(terms))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(fixed, widest)
        for batch in batches:
            words = batch.column("word").to_pylist()
            lexicon.learn(words)
            hits = [(w, *m) for w in words if lexicon.memo[w] for m in lexicon.matches(w) if m[0]]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string(), pa.bool_()))], ["word", "edits", "term", "stem"])

    met = by_word.where("clean > 0").select("word").mapInArrow(near, "word string, edits int, term string, stem boolean").collect()
    # Beyond the edits by which a stem met a clean word it is not looked for.
    return {s: min([e, *(r.edits - 1 for r in met if r.stem and r.term == s)]) for s, e in sorted(widest.items())}, sorted({r.word for r in met if not r.stem})


def toxic_documents(docs: DataFrame, terms: Iterable[str] = SEEDS, stems: Mapping[str, int] | Iterable[str] = (), ordinary: Iterable[str] = ORDINARY, threshold: float = 0.85, window: int = 8) -> DataFrame:
    """(doc_id, score, hits, terms) of the documents whose score is threshold or more.

    docs: doc_id and text; other columns are not read. Every word of every text is looked up in one pass without
    a shuffle; see weigh() for the score and Lexicon for stems and ordinary words. Null and empty texts have no hits and are not
    given; rows without a doc_id are judged alike, and repeated rows give a row each. An
    empty table, or an empty lexicon, gives no rows.
    """
    terms, ordinary = sorted(set(terms)), frozenset(ordinary)
    stems = dict(stems) if isinstance(stems, Mapping) else sorted(set(stems))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, stems, ordinary)
        for batch in batches:
            rows, out = [], []
            texts = batch.column("text").to_pylist()
            for i, j in chunks(texts):
                own = [(row, set(_WORD.findall(texts[row].lower()))) for row in range(i, j) if texts[row]]
                lexicon.learn(set().union(*[w for _, w in own]))
                for row, seen in own:
                    if any([lexicon.look(w) for w in seen]) and (found := weigh(texts[row], lexicon, window))[0] >= threshold:
                        rows.append(row)
                        out.append(found)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.string()))], ["doc_id", "score", "hits", "terms"]
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, hits int, terms array<string>")
