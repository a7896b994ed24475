import random

import numpy as np
import pytest

from tests.llm.conftest import prose
from tracefold.llm import toxicity as T

LABELS = "doc_id BIGINT, quality INT, toxic INT, text STRING, extra STRING"
BAD = [f"slur{i}" for i in range(8)]


def rows(n, seed=0, start=0):
    r, out = random.Random(seed), []
    for i in range(n):
        words, toxic = prose(seed * 10_000 + i, 60).split(), int(i % 5 == 0)
        for _ in range(r.randrange(2, 12) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        out.append((start + i, " ".join(words), toxic))
    return out


def fitted(n=400, **options):
    got = rows(n)
    toxic = np.array([t for *_, t in got]) > 0
    return T.fit(T.words_of([x for _, x, _ in got]), toxic, (float((~toxic).mean()), float(toxic.mean())), **options)


def labels(spark, got):
    return spark.createDataFrame([(i, 1, t, "clash", "x") for i, t in got], LABELS)


def test_held_out_documents(spark, make_docs):
    train, test = rows(400), rows(200, seed=1, start=1000)
    docs = make_docs([r[:2] for r in train + test])
    got = {r.doc_id: r for r in T.severity(docs, labels(spark, [(i, t) for i, _, t in train])).collect()}
    assert all(got[i].toxic == bool(t) for i, _, t in test)
    held = np.array([sum(w in BAD for w in x.split()) for _, x, _ in test])
    sev = np.array([got[i].expected_severity for i, *_ in test])
    order = [sev[(held >= a) & (held < b)].mean() for a, b in ((0, 1), (1, 5), (5, 8), (8, 12))]
    assert order == sorted(order)  # severity rises with what a document holds


def test_thresholds_are_ordered_and_shared():
    m = fitted()
    assert (np.diff(m.thresholds) > 0).all() and len(m.thresholds) == 3
    text = " ".join([BAD[0]] * 3 + [BAD[1], "river"])
    (s,), (n,) = T.score([text], m)
    w = dict(zip(m.words.tolist(), m.weights.tolist()))
    words, count = T.words_of([text])[0]
    assert s == pytest.approx(sum(w.get(int(x), 0) * np.log2(1 + c) for x, c in zip(words, count)))
    assert n == sum(int(x) in w for x in words)


def test_severity_is_the_sum_of_the_cumulative_links(spark, make_docs):
    got = rows(300)
    docs = make_docs([r[:2] for r in got])
    m = fitted(300)
    for r in T.severity(docs, labels(spark, [(i, t) for i, _, t in got])).collect()[:20]:
        above = T.sigmoid(r.score - m.thresholds)
        assert 0 <= r.expected_severity <= 3 and r.p_toxic == pytest.approx(above[0], abs=0.2)
        assert r.toxic == (r.p_toxic >= 0.5) and r.grade in range(4)


def test_no_signal_or_one_class():
    got = [x for _, x, _ in rows(40)]
    for toxic in (np.zeros(40, bool), np.ones(40, bool)):
        assert not len(T.fit(T.words_of(got), toxic, (0.5, 0.5)).words)


def test_odd_inputs(spark, odd_docs, no_docs, make_docs):
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(4, 1, 1, None, None), (4, 1, 0, None, None), (None, 1, 1, None, None), (5, None, None, None, None), (6, 1, 0, None, None), (999, 1, 1, None, None)], LABELS)
    for known in (none, odd):
        got = T.severity(odd_docs, known).collect()
        assert len(got) == odd_docs.count() and all(np.isfinite(r.expected_severity) for r in got)
    assert all(not r.toxic and r.expected_severity < 1e-6 for r in T.severity(odd_docs, none).collect())
    assert T.severity(no_docs, none).count() == 0
    both = make_docs([r[:2] for r in rows(200)]).unionByName(odd_docs)
    by = {r.doc_id: r for r in T.severity(both, labels(spark, [(i, t) for i, _, t in rows(200)])).collect() if r.doc_id in (1, 2, 3)}
    assert not any(r.toxic for r in by.values())


def test_end_of_a_long_text_counts():
    m = fitted()
    long = prose(1, 60_000)
    a, b = T.score([long, long + " " + " ".join(BAD * 3)], m)[0]
    assert b > a


def test_fit_same_as_a_plain_optimiser():
    """The penalised loss that is reached is that of a slow proximal descent on a plain loss with numerical gradients."""
    r = np.random.default_rng(4)
    vocab = np.sort(r.integers(1, 1 << 62, 6, dtype=np.uint64))
    docs, toxic = [], np.zeros(480, bool)
    for i in range(480):
        toxic[i] = i % 3 == 0
        p = np.array([0.6, 0.6, 0.6, 0.5, 0.3, 0.3]) if toxic[i] else np.array([0.04, 0.04, 0.04, 0.5, 0.4, 0.2])
        own = np.flatnonzero(r.random(6) < p)
        docs.append((vocab[own], r.integers(1, 4, len(own))))
    l1 = 1e-3
    m = T.fit(docs, toxic, (0.6, 0.4), grades=3, l1=l1, steps=600)
    x = np.zeros((480, 6))
    for i, (w, c) in enumerate(docs):
        x[i, np.searchsorted(vocab, w)] = np.log2(1 + c)
    # Words that mark toxic documents, and grades by how many of them a document holds.
    rate = lambda own: ((x[own] > 0).sum(axis=0) + 0.5) / (own.sum() + 1)
    n1, n0, seen = toxic.sum(), (~toxic).sum(), (x > 0).sum(axis=0)
    z = (rate(toxic) - rate(~toxic)) / np.sqrt((seen + 1) / 482 * (1 / n1 + 1 / n0))
    held = (x[:, (z > 6) & (rate(toxic) > 4 * rate(~toxic))] > 0).sum(axis=1)
    y = np.where(toxic, 1 + (held > np.quantile(held[toxic], 0.5)), 0)
    assert set(y) == {0, 1, 2}
    weight = np.where(toxic, 0.4 / n1, 0.6 / n0)

    def loss(theta, w):
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        s = x @ w
        return -(weight * np.log(np.maximum(T.sigmoid(edges[y + 1] - s) - T.sigmoid(edges[y] - s), 1e-12))).sum()

    theta, w = np.array([0.5, 1.5]), np.zeros(6)
    for _ in range(6000):
        both, g = np.concatenate([theta, w]), np.zeros(8)
        for j in range(8):
            step = np.eye(8)[j] * 1e-5
            g[j] = (loss((both + step)[:2], (both + step)[2:]) - loss((both - step)[:2], (both - step)[2:])) / 2e-5
        both -= 0.5 * g
        theta, w = np.maximum.accumulate(both[:2]), np.sign(both[2:]) * np.maximum(np.abs(both[2:]) - 0.5 * l1, 0)
    own = np.zeros(6)
    own[np.searchsorted(vocab, m.words)] = m.weights
    assert abs(loss(m.thresholds, own) + l1 * np.abs(own).sum() - loss(theta, w) - l1 * np.abs(w).sum()) < 1e-4
    assert np.allclose(own, w, atol=0.05) and np.allclose(m.thresholds, theta, atol=0.05)
