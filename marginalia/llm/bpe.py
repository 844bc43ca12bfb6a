"""Byte-pair encoding and decoding with a given vocabulary, by batched merge rounds in numpy."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import chunks, ranges

#: How texts are cut before merging: contractions, letters, digits, other signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers; when full, it starts anew.
REMEMBERED = 400_000
#: Bytes from which a piece is merged alone, by a heap.
LONG = 1_000
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Tokens by rank, and all pairs of tokens whose join is a token, as sorted keys."""

    def __init__(self, data: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, data.splitlines()))}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank))
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r in pairs], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two tokens' join, by binary search; _NONE where it is no token."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Tokens of one long piece; a heap holds its pairs, so that the time is n log n."""
        rank = self._rank_of
        sym: list = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # Pairs by rank, then place; one whose symbols have changed since is passed over.
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = r, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get(r << 32 | sym[k])) is not None:
                    heapq.heappush(heap, (x, i, r, sym[k]))
            h = before[i]
            if h >= 0 and (x := rank.get(sym[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, sym[h], r))
        return np.array([x for x in sym if x is not None], np.int64)

    @functools.cached_property
    def _rank_of(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist()))

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in one flat array, and how many each has.

        Pieces of LONG bytes or more, which would need as many rounds, are merged one by one.
        """
        long = [i for i, p in enumerate(pieces) if len(p) >= LONG]
        if not long:
            return self._merge_short(pieces)
        flat, n = self._merge_short([b"" if len(p) >= LONG else p for p in pieces])
        alone = [self.merge_long(pieces[i]) for i in long]
        at = np.append(0, np.cumsum(n))[long]
        n[long] = [len(x) for x in alone]
        return np.insert(flat, np.repeat(at, n[long]), np.concatenate(alone)), n

    def _merge_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of short pieces, all at once.

        In every round each unfinished piece has its leftmost pair of lowest rank merged.
        Only the ranks of pairs next to a merge are looked up again.
        """
        size = np.array([len(p) for p in pieces], np.int64)
        sym = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), size)
        done_sym, done_piece = [], []
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            n = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            open_ = np.repeat(least < _NONE, n)
            if not open_.all():
                done_sym.append(sym[~open_])
                done_piece.append(piece[~open_])
                sym, piece, rank = sym[open_], piece[open_], rank[open_]
                if not len(sym):
                    break
                keep = least < _NONE
                n, least = n[keep], least[keep]
                first = np.cumsum(n) - n
            hit = np.flatnonzero(rank == np.repeat(least, n))
            owner = piece[hit]
            hit = hit[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each piece
            sym[hit] = least
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, piece, rank = sym[keep], piece[keep], rank[keep]
            at = hit - np.arange(len(hit))  # one symbol went for each merge before
            for i in (at, at[at > 0] - 1):
                i = i[i < len(sym) - 1] if len(sym) else i[:0]
                same = piece[i] == piece[i + 1]
                rank[i] = _NONE
                i = i[same]
                rank[i] = self.pair_ranks(sym[i], sym[i + 1])
            if at[-1] == len(sym) - 1:
                rank[-1] = _NONE
        if not done_sym:
            return sym, np.zeros(len(pieces), np.int64)
        sym, piece = np.concatenate(done_sym), np.concatenate(done_piece)
        return sym[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=len(pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens; ids out of range are an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("token id out of range")
        return self.bytes[ranges(self.starts[ids], self.lengths[ids])].tobytes()


class Encoder:
    """Encodes texts, remembering the pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary = vocabulary
        self.find = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.lengths = self.starts = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in one flat array, and how many each has."""
        pieces: list[str] = []
        count = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self.find(text)
            count[i] = len(own)
            pieces += own
        if len(self.index) > REMEMBERED:
            self.forget()
        new = [p for p in dict.fromkeys(pieces) if p not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            sym, n = self.vocabulary.merge([p.encode() for p in new])
            self.flat = np.append(self.flat, sym.astype(np.int32))
            self.lengths = np.append(self.lengths, n)
            self.starts = np.cumsum(self.lengths) - self.lengths
        code = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        size = self.lengths[code]
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
        return self.flat[ranges(self.starts[code], size)], np.diff(ends)


def _worker(shared, pattern: str) -> Encoder:
    """One encoder for each Python worker and vocabulary, kept between tasks."""
    import pyspark

    kept = pyspark.__dict__.setdefault("_marginalia_encoders", {})
    key = (shared.value[0], pattern)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(Vocabulary(shared.value[1]), pattern)
    return kept[key]


def _share(df: DataFrame, path: str):
    """The vocabulary file, read by the driver alone and sent to every executor once; its size doesn't follow the corpus."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((path, f.read()))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, verify: bool = False) -> DataFrame:
    """(doc_id, tokens, n_tokens) for every row of docs (doc_id, text); other columns are not read.

    vocabulary: path of a file of base64 tokens and ranks, which must hold all single bytes.
    tokens equal those of sequential byte-pair merging of each piece that pattern finds,
    lowest rank first, leftmost on ties, however long the piece. Rows without a doc_id and repeated
    rows are encoded like others; an empty table gives no rows. An empty text has no tokens; a null text has null
    tokens and n_tokens 0. Text of special tokens is ordinary text. With verify, the column decodes tells
    whether the tokens decode to the very bytes of the text (null for a null text).
    """
    shared = _share(docs, vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(shared, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in chunks(texts):
                own = texts[i:j]
                ids, n = encoder.encode([t or "" for t in own])
                null = np.array([t is None for t in own])
                ends = np.append(0, np.cumsum(n)).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                out = [batch.column("doc_id").slice(i, j - i), tokens, pa.array(n)]
                names = ["doc_id", "tokens", "n_tokens"]
                if verify:
                    raw = [(t or "").encode() for t in own]
                    back = encoder.vocabulary.decode(ids)
                    if back == b"".join(raw):
                        same = [True] * len(own)
                    else:
                        same = [encoder.vocabulary.decode(ids[a:b]) == r for a, b, r in zip(ends[:-1], ends[1:], raw)]
                    out.append(pa.array([None if x else s for x, s in zip(null, same)], pa.bool_()))
                    names.append("decodes")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, tokens array<int>, n_tokens long" + ", decodes boolean" * verify)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows (doc_id, tokens); bytes that are not UTF-8 become U+FFFD, null tokens a null text.

    An id that the vocabulary does not have is an error; so is a null among the tokens.
    """
    shared = _share(encoded, vocabulary)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _worker(shared, PATTERN).vocabulary
        for batch in batches:
            lists = batch.column("tokens")
            null = np.asarray(lists.is_null())
            n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("null among tokens")
            ids = flat.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.append(0, np.cumsum(n))
            out = [None if x else vocab.decode(ids[a:b]).decode("utf-8", "replace") for a, b, x in zip(ends[:-1], ends[1:], null)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, text string")
