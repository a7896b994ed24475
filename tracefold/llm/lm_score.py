"""Subword lattice likelihood: the probability of a text over all its segmentations.

A text is its whitespace-separated words, each behind a word-start mark; pieces of the
vocabulary never cross words. A unigram model gives each piece a probability, and the probability of
a word is the sum over all ways to cut it into pieces, by the forward recursion in log
space, vectorised over the distinct words of a batch. The log-probability of a text is the sum over its words.

The vocabulary and its ranking come with an existing tokenizer file and are not trained.
That file ranks pieces (score = -rank) but gives no probabilities, so the ranks set a Zipf prior,
``p ~ 1 / (rank + offset)``, worth ``prior_words`` words. The corpus then weights it: the words of all
documents are counted, each distinct word's expected piece counts are taken over
all its segmentations (forward-backward, ``iterations`` times), and prior and counts are added. A
character without a piece of its own is spelled with the vocabulary's byte pieces.

Edge cases: null and empty texts have no words, log-probability 0 and null averages; very
long words are scored whole; null ids are passed through, repeated rows are counted and
scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm._text import as_texts, chunks, materialise, mix, table

MARK = "▁"
SCHEMA = "doc_id BIGINT, n_words BIGINT, n_scored_chars BIGINT, log_prob DOUBLE, log_prob_per_word DOUBLE, bits_per_char DOUBLE"
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_scored_chars", pa.int64()), ("log_prob", pa.float64()), ("log_prob_per_word", pa.float64()), ("bits_per_char", pa.float64())])
_BITS = 22
_BASE = np.uint64(0xD1342543DE82EF95)
_CACHE_WORDS = 300_000
_CHUNK_CHARS = 1 << 20  # words new to the cache make up lattices, the larger the better


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces and their beginnings by hash, of a size set by the tokenizer file alone."""

    keys: np.ndarray  # sorted hashes of all beginnings of pieces
    index: np.ndarray  # piece of each key, -1 for a mere beginning
    log_p: np.ndarray  # of all pieces
    byte_index: np.ndarray  # piece of each byte value, -1 if there is none
    bitmap: np.ndarray | None = None

    def with_probabilities(self, p: np.ndarray) -> Vocabulary:
        return replace(self, log_p=np.log(p / p.sum()), bitmap=None)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"bitmap": None}

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are beginnings of pieces, and the pieces that they are."""
        if self.bitmap is None:
            self.bitmap = np.zeros(1 << _BITS, bool)
            self.bitmap[self.keys >> np.uint64(64 - _BITS)] = True
        maybe = np.flatnonzero(self.bitmap[h >> np.uint64(64 - _BITS)])
        g = h[maybe]
        at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        good = self.keys[at] == g
        return maybe[good], self.index[at[good]]


def prefix_hashes(piece: str) -> list[int]:
    h, power, out = 0, 1, []
    for ch in piece:
        h, power = (h + (ord(ch) + 1) * power) & (2**64 - 1), power * int(_BASE) & (2**64 - 1)
        out.append(h)
    return out


def from_ranks(pieces: list[str], ranks: list[float], byte_pieces: dict[int, int], offset: float = 10.0) -> Vocabulary:
    """A vocabulary with the Zipf prior of its ranks; byte pieces take the rarest rank."""
    r = np.array(ranks, float)
    is_byte = np.zeros(len(pieces), bool)
    is_byte[list(byte_pieces.values())] = True
    r[is_byte] = r.max() if len(r) else 0
    p = 1 / (r + offset)
    found: dict[int, int] = {}
    for i, x in enumerate(pieces):
        if x and not is_byte[i]:
            *begin, whole = prefix_hashes(x)
            found[whole] = i
            for b in begin:
                found.setdefault(b, -1)
    h = mix(np.array(list(found), np.uint64))
    order = np.argsort(h)
    byte_index = np.full(256, -1)
    for b, i in byte_pieces.items():
        byte_index[b] = i
    return Vocabulary(h[order], np.array(list(found.values()), np.int32)[order], np.log(p / p.sum()), byte_index)


def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ranks, byte_pieces = [], [], {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        if sp.is_byte(i):
            byte_pieces[int(sp.id_to_piece(i)[1:-1], 16)] = len(pieces)
        pieces.append(sp.id_to_piece(i))
        ranks.append(-sp.get_score(i))
    return from_ranks(pieces, ranks, byte_pieces)


def _sorted_by(word: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Edges by place, then word; small whole numbers are sorted by radix."""
    narrow = lambda x: x.astype(np.uint16) if len(x) and x.max() < 65536 else x
    first = np.argsort(narrow(word), kind="stable")
    return first[np.argsort(narrow(place[first]), kind="stable")]


def _log_sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(x, begin)
    safe = np.where(np.isfinite(top), top, 0.0)
    size = np.diff(np.append(begin, len(x)))
    with np.errstate(divide="ignore"):
        return safe + np.log(np.add.reduceat(np.exp(x - safe.repeat(size)), begin))


class Lattice:
    """The graph of all pieces at all places of some words. Word i has nodes base[i] to base[i] + length[i]."""

    def __init__(self, words: list[str], v: Vocabulary) -> None:
        self.v = v
        marked = [MARK + w for w in words]
        self.length = np.array([len(w) for w in marked])
        start = np.concatenate([[0], np.cumsum(self.length)])
        self.base = start[:-1] + np.arange(len(words))
        c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(c)
        of = np.repeat(np.arange(len(words)), self.length)
        end = start[1:][of]
        at, h, power = np.arange(n), np.zeros(n, np.uint64), 1
        single = np.zeros(n, bool)
        begin, size, piece = [], [], []
        k = 0
        while len(at):
            h = h + (c[at + k] + np.uint64(1)) * np.uint64(power)
            power = power * int(_BASE) & (2**64 - 1)
            k += 1
            live, which = v.look_up(mix(h))
            at, h = at[live], h[live]
            whole = which >= 0
            begin.append(at[whole])
            size.append(np.full(int(whole.sum()), k))
            piece.append(which[whole])
            if k == 1:
                single[at[whole]] = True
            room = at + k < end[at]
            at, h = at[room], h[room]
        # Characters without a piece are spelled in bytes.
        spelled = np.flatnonzero(~single)
        floor = float(v.log_p.min()) - 5.0 if len(v.log_p) else -20.0
        self.bytes = [list(chr(int(c[i])).encode("utf-8", "surrogatepass")) for i in spelled]
        spelled_p = [sum(v.log_p[v.byte_index[b]] if v.byte_index[b] >= 0 else floor for b in bs) for bs in self.bytes]
        b = np.concatenate([*begin, spelled])
        self.word = of[b]
        self.source = b + self.word
        self.target = self.source + np.concatenate([*size, np.ones(len(spelled), int)])
        self.piece = np.concatenate([*piece, -1 - np.arange(len(spelled))])
        self.log_p = np.concatenate([v.log_p[np.concatenate(piece)] if piece else [], spelled_p])

    def _sweep(self, into: np.ndarray, out_of: np.ndarray, place: np.ndarray, a: np.ndarray) -> None:
        """Sums the mass of edges place by place, words side by side."""
        order = _sorted_by(self.word, place)
        into, out_of, lp = into[order], out_of[order], self.log_p[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place[order])) + 1, [len(order)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            node = into[lo:hi]
            first = np.flatnonzero(np.diff(node, prepend=-1))
            a[node[first]] = _log_sums(a[out_of[lo:hi]] + lp[lo:hi], first)

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Log-mass of all ways to each node, and of the words."""
        a = np.full(int(self.length.sum()) + len(self.length), -np.inf)
        a[self.base] = 0.0
        if len(a):
            self._sweep(self.target, self.source, self.target - self.base[self.word], a)
        return a, a[self.base + self.length]

    def scores(self) -> np.ndarray:
        return self.forward()[1]

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece over the words' segmentations, each word counted so often."""
        total = np.zeros(len(self.v.log_p))
        if not len(self.length):
            return total
        a, z = self.forward()
        b = np.full(len(a), -np.inf)
        b[self.base + self.length] = 0.0
        self._sweep(self.source, self.target, self.base[self.word] + self.length[self.word] - self.source, b)
        mass = np.exp(a[self.source] + self.log_p + b[self.target] - z[self.word]) * counts[self.word]
        own = self.piece >= 0
        total += np.bincount(self.piece[own], weights=mass[own], minlength=len(total))
        for bs, m in zip(self.bytes, mass[~own]):
            for byte in bs:
                if self.v.byte_index[byte] >= 0:
                    total[self.v.byte_index[byte]] += m
        return total


def batches_of(words: list[str], limit: int = 150_000) -> Iterator[tuple[int, int]]:
    return chunks(words, limit)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents: partial counts a task, then one shuffle by word."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
            held.clear()
            return out

        for b in batches:
            for t in b["text"].to_pylist():
                held.update(t.split())
                if len(held) > _CACHE_WORDS:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").where("text IS NOT NULL").mapInArrow(run, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


def fit_weights(docs: DataFrame, vocabulary: Vocabulary, prior_words: float, iterations: int) -> Vocabulary:
    """The vocabulary weighted by expected piece counts over all words of the corpus."""
    words = materialise(count_words(docs))
    prior = np.exp(vocabulary.log_p) * prior_words
    for _ in range(iterations):
        shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value.log_p))
            for b in batches:
                ws, n = b["word"].to_pylist(), b["n"].to_numpy()
                for lo, hi in batches_of(ws):
                    total += Lattice(ws[lo:hi], shared.value).expected(n[lo:hi])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["piece", "mass"])

        sums = words.mapInArrow(run, "piece INT, mass DOUBLE").groupBy("piece").agg(F.sum("mass").alias("mass")).toArrow()  # at most a row for each piece
        mass = prior.copy()
        mass[sums["piece"].to_numpy()] += sums["mass"].to_numpy()
        vocabulary = vocabulary.with_probabilities(mass)
    return vocabulary


def score_texts(texts: list[str], v: Vocabulary, cache: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """(words, characters with word marks, log-probability) of each text."""
    for lo, hi in chunks(texts, _CHUNK_CHARS):
        split = [t.split() for t in texts[lo:hi]]
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        new = sorted(set().union(*split) - cache.keys(), key=lambda w: (len(w), w))
        for a, b in batches_of(new):
            cache.update(zip(new[a:b], Lattice(new[a:b], v).scores().tolist()))
        for words in split:
            yield len(words), sum(map(len, words)) + len(words), sum(map(cache.__getitem__, words))


def lattice_scores(docs: DataFrame, vocabulary: str | None = None, prior_words: float = 100_000.0, iterations: int = 1) -> DataFrame:
    """The marginal log-probability of each document; see the module's docstring."""
    v = fit_weights(docs, load_vocabulary(vocabulary or default_vocabulary()), prior_words, iterations)
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in batches:
            rows = list(score_texts(as_texts(b["text"]), shared.value, cache))
            n, chars, lp = zip(*rows) if rows else ((), (), ())
            per_word = [x / k if k else None for x, k in zip(lp, n)]
            bits = [-x / np.log(2) / c if c else None for x, c in zip(lp, chars)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, f.type) for c, f in zip((n, chars, lp, per_word, bits), list(OUT)[1:]))], schema=OUT)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, SCHEMA)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"))
