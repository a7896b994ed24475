"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

``P(grade <= j | x) = sigmoid(theta_j - w.x)`` for ordered thresholds theta and one weight
vector w shared by them all; x holds log2(1 + count) of
each word. The expected severity is
``sum_j P(grade > j)``.

The labels say toxic or not. Severity grades are made from them: words that mark
toxic documents (a one-sided chi-squared test, Bonferroni-corrected) are found first; a document labelled
clean has grade 0, and toxic ones have grades 1 to ``grades - 1`` by the quantiles of how many
marker words they hold. The model is fitted with an L1 penalty, which leaves weights of
zero to all but the words that matter. It is trained on at most about ``per_class`` labelled documents of each
class, drawn by a hash of the id, and weighted back to the shares of all labels.

Edge cases: null and empty texts hold no word and get the severity of the thresholds alone;
labels without id or toxicity are ignored, repeated ones count once, as toxic if any says so;
with no toxic or no clean labels severity is 0 for all; null ids are passed
through, repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm._text import as_texts, chunks, table, word_hashes

SCHEMA = "doc_id BIGINT, score DOUBLE, expected_severity DOUBLE, p_toxic DOUBLE, grade INT, n_features INT, toxic BOOLEAN"
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("expected_severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("n_features", pa.int32()), ("toxic", pa.bool_())])
_BITS = 20


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def words_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct word hashes of each text, and how often each stands there."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in chunks(texts):
        h, off = word_hashes(texts[lo:hi])
        out += [np.unique(h[off[i] : off[i + 1]], return_counts=True) for i in range(hi - lo)]
    return out


def fit(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, shares: tuple[float, float], grades: int = 4, features: int = 4096, l1: float = 3e-5, steps: int = 400) -> Model:
    """Select words, grade the documents and fit the ordinal model. shares: of clean and toxic labels."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, 500.0))
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return none
    every = np.concatenate([d for d, _ in docs])
    value = np.log2(1.0 + np.concatenate([c for _, c in docs]))
    size = np.array([len(d) for d, _ in docs])
    of = np.arange(len(docs)).repeat(size)
    vocab, at = np.unique(every, return_inverse=True)
    in1 = np.bincount(at, weights=toxic[of].astype(float), minlength=len(vocab))
    in0 = np.bincount(at, minlength=len(vocab)) - in1
    rate1, rate0 = (in1 + 0.5) / (n1 + 1), (in0 + 0.5) / (n0 + 1)
    z = (rate1 - rate0) / np.sqrt((in1 + in0 + 1) / (n1 + n0 + 2) * (1 / n1 + 1 / n0))
    seen = in1 + in0 >= 3
    # Bonferroni over a vocabulary of millions at most: z of 6 is p < 1e-9.
    marker = seen & (z > 6) & (rate1 > 4 * rate0)
    order = np.argsort(-np.abs(np.where(seen, z, 0)), kind="stable")[:features]
    held = np.bincount(of[marker[at]], minlength=len(docs))
    y = np.zeros(len(docs), np.int64)
    cuts = np.quantile(held[toxic], [j / (grades - 1) for j in range(1, grades - 1)])
    y[toxic] = 1 + (held[toxic, None] > cuts[None, :]).sum(axis=1)
    chosen = np.full(len(vocab), -1)
    chosen[order] = np.arange(len(order))
    use = chosen[at] >= 0
    row, col, x = of[use], chosen[at[use]], value[use]
    weight = np.where(toxic, shares[1] / n1, shares[0] / n0)
    weight /= weight.sum()
    base = np.array([np.clip((weight * (y <= j)).sum(), 1e-4, 1 - 1e-4) for j in range(grades - 1)])
    theta = np.maximum.accumulate(np.log(base / (1 - base)) + 1e-3 * np.arange(grades - 1))
    w = np.zeros(len(order))
    v, tv, momentum, rate, last = w.copy(), theta.copy(), 1.0, 4.0, np.inf

    def loss(w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = np.bincount(row, weights=w[col] * x, minlength=len(docs))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        up, low = sigmoid(edges[y + 1] - s), sigmoid(edges[y] - s)
        up[y == grades - 1], low[y == 0] = 1.0, 0.0
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p * weight, low * (1 - low) / p * weight
        gt = np.array([dl[y == j + 1].sum() - du[y == j].sum() for j in range(grades - 1)])
        return float(-(weight * np.log(p)).sum()), np.bincount(col, weights=(du - dl)[row] * x, minlength=len(w)), gt

    for _ in range(steps):  # FISTA with backtracking and restart
        f, gw, gt = loss(v, tv)
        while True:
            nw = v - rate * gw
            nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
            nth = np.maximum.accumulate(tv - rate * gt + 1e-6 * np.arange(grades - 1))
            d, dt = nw - v, nth - tv
            g = loss(nw, nth)[0]
            if g <= f + gw @ d + gt @ dt + (d @ d + dt @ dt) / (2 * rate) + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        total = g + l1 * np.abs(nw).sum()
        if total > last:
            v, tv, momentum, last = w.copy(), theta.copy(), 1.0, np.inf
            continue
        nm = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v, tv = nw + (momentum - 1) / nm * (nw - w), nth + (momentum - 1) / nm * (nth - theta)
        w, theta, momentum, last = nw, nth, nm, total
        rate *= 1.1
    used = np.flatnonzero(w)
    used = used[np.argsort(vocab[order[used]])]
    return Model(vocab[order[used]], w[used], theta)


def score(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """w.x and the number of features found, of each text."""
    total, found = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    if not len(model.words):
        return total, found
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[model.words >> np.uint64(64 - _BITS)] = True
    for lo, hi in chunks(texts):
        h, off = word_hashes(texts[lo:hi])
        pos = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)])
        at = np.minimum(np.searchsorted(model.words, h[pos]), len(model.words) - 1)
        hit = model.words[at] == h[pos]
        doc = np.searchsorted(off, pos[hit], "right") - 1
        pair, count = np.unique(doc * len(model.words) + at[hit], return_counts=True)
        doc, at = pair // len(model.words), pair % len(model.words)
        total[lo:hi] = np.bincount(doc, weights=model.weights[at] * np.log2(1.0 + count), minlength=hi - lo)
        found[lo:hi] = np.bincount(doc, minlength=hi - lo)
    return total, found


def train(docs: DataFrame, labels: DataFrame, per_class: int, **options) -> Model:
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = count.get(0, 0), count.get(1, 0)
    share = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(share <= F.when(F.col("toxic") > 0, F.lit(per_class / max(1, n1))).otherwise(F.lit(per_class / max(1, n0))))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    # The drawn ids are at most about two times per_class, whatever the corpus.
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words_of(as_texts(b["text"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array([x.view(np.int64) for x, _ in w], schema[2].type), pa.array([c for _, c in w], schema[3].type)], schema=schema)

    got = rows.mapInArrow(run, "doc_id BIGINT, toxic INT, words ARRAY<BIGINT>, counts ARRAY<BIGINT>").toArrow().sort_by("doc_id")
    if not len(got):
        return fit([], np.zeros(0, bool), (0.0, 0.0), **options)
    words, counts = got["words"].combine_chunks(), got["counts"].combine_chunks()
    bounds, flat, n = words.offsets.to_numpy(), words.values.to_numpy().view(np.uint64), counts.values.to_numpy()
    return fit([(flat[a:b], n[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], got["toxic"].to_numpy() > 0, (n0 / (n0 + n1), n1 / (n0 + n1)), **options)


def severity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, **options) -> DataFrame:
    """The expected severity, the probability of any toxicity and the likeliest grade of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = shared.value
            s, n = score(as_texts(b["text"]), m)
            above = sigmoid(s[:, None] - m.thresholds[None, :])
            p = -np.diff(np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1), axis=1)
            cols = [s, above.sum(axis=1), above[:, 0], p.argmax(axis=1), n, above[:, 0] >= 0.5]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, f.type) for c, f in zip(cols, list(OUT)[1:]))], schema=OUT)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, SCHEMA)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
