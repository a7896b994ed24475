"""Language identification: family first, then pairwise linear SVMs within the family.

A text is the average of its character trigrams (lower-cased letters, any run of other
characters counts as one break) hashed to ``DIM`` features. A one-versus-rest linear SVM
picks the language family; within it every pair of languages has an SVM of its own, and the
language with most pairwise wins is taken (ties: larger sum of margins, then name). All
models are linear in the trigram counts, so that a whole text is scored by one table lookup
per trigram and model.

The models are trained on at most about ``per_language`` labelled rows a language, drawn by
a hash of the id. Edge cases: very long texts count whole; without a ``lang`` column, or any label, nothing can be learned and all is "und"; null, empty and letterless texts, or texts that are less than
``min_letter_share`` letters, are rejected with language ``und``; rows without a label are scored but
not learned from; with no labelled rows at all, all documents are ``und``; a language whose
family is not known is a family of its own; repeated rows are scored each; extra columns
are ignored, or passed through by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm._text import as_texts, chunks, code_points, mix, table

BITS = 13
DIM = 1 << BITS
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl"), "romance"),
    **dict.fromkeys(("pl", "cs", "sk", "ru", "uk", "bg", "sr", "hr", "sl"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
}
SCHEMA = "doc_id BIGINT, language STRING, family STRING, family_margin DOUBLE, language_margin DOUBLE, n_letters BIGINT, rejected BOOLEAN"
OUT = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("family", pa.string()), ("family_margin", pa.float64()), ("language_margin", pa.float64()), ("n_letters", pa.int64()), ("rejected", pa.bool_())])
_symbols: list[np.ndarray] = []


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # models x DIM: one a family, then one a pair
    bias: np.ndarray


def _symbol_table() -> np.ndarray:
    if not _symbols:
        _symbols.append(np.fromiter((i if chr(i).isalpha() else 0 for i in range(65536)), np.uint32, 65536))
    return _symbols[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features in order of the text, where each text's begin, and its letters and other signs.

    The last two characters before the break after a text yield no trigram of two texts.
    """
    c, starts = code_points([t.lower() for t in texts])
    s = _symbol_table()[np.minimum(c, 65535)]
    letter = s != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first break after a letter
    at = np.flatnonzero(keep)
    offsets = np.searchsorted(at, starts)
    x = s[at]
    g = (x * np.uint32(0x9E3779B1)) ^ (np.roll(x, 1) * np.uint32(0x85EBCA77)) ^ (np.roll(x, 2) * np.uint32(0xC2B2AE3D))
    g = (g * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    counts = np.concatenate([[0], np.cumsum(letter)])
    n = counts[starts[1:]] - counts[starts[:-1]]
    spaces = np.concatenate([[0], np.cumsum((c <= 32) | (c == 160))])
    return g, offsets, n, np.diff(starts) - (spaces[starts[1:]] - spaces[starts[:-1]])


def averages(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIM), np.float32)
    for lo, hi in chunks(texts):
        g, off, _, _ = trigrams(texts[lo:hi])
        for i in range(hi - lo):
            part = g[off[i] : off[i + 1]]
            if len(part):
                out[lo + i] = np.bincount(part, minlength=DIM) / len(part)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 50.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge SVM by accelerated gradient descent; y is -1 or 1."""
    n, d = x.shape
    w, b = np.zeros(d, np.float32), 0.0
    v, vb, t = w.copy(), b, 1.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    probe = np.random.default_rng(0).random(d, np.float32)
    for _ in range(8):
        probe = x.T @ (weight * (x @ probe))
        norm = float(np.linalg.norm(probe)) or 1.0
        probe /= norm
    rate = 1.0 / (1.0 + 2 * c * (norm + 1.0))
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + vb)) * y * weight
        new, nb = v - rate * (v - 2 * c * (x.T @ slack)), vb + rate * 2 * c * float(slack.sum())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, float(b)


def fit(texts: list[str], languages: list[str], families: dict[str, str] | None = None) -> Model | None:
    known = FAMILIES if families is None else families
    names = sorted(set(languages))
    if not names:
        return None
    members: dict[str, list[str]] = {}
    for x in names:
        members.setdefault(known.get(x, f"other:{x}"), []).append(x)
    x, label = averages(texts), np.array(languages)
    scale = float(np.sqrt((x * x).sum(axis=1).mean())) or 1.0
    x /= scale
    of = np.array([known.get(l, f"other:{l}") for l in languages])
    fams, pairs, models = sorted(members), [], []
    for f in fams:
        models.append(fit_svm(x, np.where(of == f, 1, -1).astype(np.float32)) if len(fams) > 1 else (np.zeros(DIM, np.float32), 0.0))
    for f in fams:
        for a, b in combinations(members[f], 2):
            own = (label == a) | (label == b)
            pairs.append((a, b))
            models.append(fit_svm(x[own], np.where(label[own] == a, 1, -1).astype(np.float32)))
    return Model(fams, members, pairs, np.stack([w for w, _ in models]) / scale, np.array([b for _, b in models]))


def predict(texts: list[str], model: Model | None, min_letters: int, min_letter_share: float) -> Iterator[tuple]:
    """(language, family, family margin, language margin, letters, rejected) of each text."""
    for lo, hi in chunks(texts):
        g, off, letters, signs = trigrams(texts[lo:hi])
        n = np.diff(off)
        bad = (letters < min_letters) | (letters < min_letter_share * signs) | (n == 0)
        if model is None:
            yield from (("und", "und", 0.0, 0.0, int(x), True) for x in letters)
            continue
        scores = np.empty((len(model.weights), hi - lo))
        for m, w in enumerate(model.weights):
            sums = np.add.reduceat(np.append(w[g], 0.0), np.minimum(off[:-1], len(g)), dtype=np.float64)
            scores[m] = np.where(n > 0, sums, 0.0) / np.maximum(n, 1) + model.bias[m]
        fam = scores[: len(model.families)]
        order = np.argsort(-fam, axis=0, kind="stable")
        for i in range(hi - lo):
            if bad[i]:
                yield "und", "und", 0.0, 0.0, int(letters[i]), True
                continue
            f = model.families[order[0, i]]
            margin = float(fam[order[0, i], i] - (fam[order[1, i], i] if len(fam) > 1 else 0.0))
            votes = {x: [0, 0.0] for x in model.members[f]}
            for (a, b), s in zip(model.pairs, scores[len(model.families) :, i]):
                if a in votes:
                    votes[a if s >= 0 else b][0] += 1
                    votes[a][1] += s
                    votes[b][1] -= s
            best = min(votes, key=lambda x: (-votes[x][0], -votes[x][1], x))
            yield best, f, margin, float(votes[best][1]), int(letters[i]), False


def train(docs: DataFrame, per_language: int = 400) -> Model | None:
    """Fit on a bounded, hash-drawn sample of the rows that have a label."""
    if "lang" not in docs.columns:
        return None
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        limit = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(limit)
    got = sorted((r["lang"], r["text"]) for r in rows.where(share <= limit).select("lang", "text").collect())
    return fit([t for _, t in got], [l for l, _ in got]) if got else None


def identify(docs: DataFrame, per_language: int = 400, min_letters: int = 3, min_letter_share: float = 0.3) -> DataFrame:
    """The language, family and margins of each document; see the module's docstring."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(predict(as_texts(b["text"]), shared.value, min_letters, min_letter_share))
            cols = [b["doc_id"], *(pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, list(OUT)[1:]))]
            yield pa.RecordBatch.from_arrays(cols, schema=OUT)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(score, SCHEMA)


def keep_identified(docs: DataFrame, per_language: int = 400, min_letters: int = 3, min_letter_share: float = 0.3) -> DataFrame:
    """The documents whose language is found, with all their columns; ``lang`` is set to what was found."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(predict(as_texts(b["text"]), shared.value, min_letters, min_letter_share))
            i = b.schema.get_field_index("lang")
            if i >= 0:
                b = b.set_column(i, b.schema.field(i), pa.array([r[0] for r in rows], b.schema.field(i).type))
            yield b.filter(pa.array([not r[5] for r in rows], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
