import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from tracefold.llm import lm_score as L

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba", "c", "<c3>", "<a9>"]
BYTES = {0xC3: 9, 0xA9: 10}


def small():
    return L.from_ranks(PIECES, [0, 3, 1, 2, 5, 4, 7, 6, 8, 0, 0], BYTES)


def ways(word, v):
    """All segmentations: (pieces, log-probability); a character without a piece is its bytes."""
    names = {p: i for i, p in enumerate(PIECES) if not p.startswith("<")}
    out = []

    def go(rest, used, lp):
        if not rest:
            out.append((used, lp))
            return
        for n in range(1, len(rest) + 1):
            if rest[:n] in names:
                i = names[rest[:n]]
                go(rest[n:], [*used, i], lp + v.log_p[i])
        if rest[0] not in names:
            got = [v.byte_index[b] for b in rest[0].encode()]
            floor = v.log_p.min() - 5
            go(rest[1:], [*used, *[g for g in got if g >= 0]], lp + sum(v.log_p[g] if g >= 0 else floor for g in got))

    go(L.MARK + word, [], 0.0)
    return out


WORDS = ["a", "ab", "abab", "babaaba", "cab", "é", "aéb", "xa", "abcabcab", "", "aaaaaaaaaa"]


def test_sum_over_all_segmentations():
    v = small()
    for w, got in zip(WORDS, L.Lattice(WORDS, v).scores()):
        want = math.log(math.fsum(math.exp(lp) for _, lp in ways(w, v)))
        assert got == pytest.approx(want, abs=1e-9), w


def test_expected_pieces_same_as_by_enumeration():
    v = small()
    n = np.arange(1, len(WORDS) + 1)
    want = np.zeros(len(PIECES))
    for w, k in zip(WORDS, n):
        every = ways(w, v)
        z = math.fsum(math.exp(lp) for _, lp in every)
        for used, lp in every:
            for i in used:
                want[i] += k * math.exp(lp) / z
    assert np.allclose(L.Lattice(WORDS, v).expected(n), want)


def test_marginal_is_more_than_the_best_way():
    v = small()
    for w, got in zip(WORDS, L.Lattice(WORDS, v).scores()):
        assert got >= max(lp for _, lp in ways(w, v)) - 1e-9


def test_counts_and_scores_same_as_plain_ones(spark, make_docs):
    r = random.Random(3)
    rows = [(i, prose(i, r.randrange(1, 90), r.choice(("en", "de", "fr")))) for i in range(60)]
    docs = make_docs(rows).repartition(5)
    counted = Counter(w for _, t in rows for w in t.split())
    assert {x.word: x.n for x in L.count_words(docs).collect()} == counted
    base = L.load_vocabulary(L.default_vocabulary())
    words = sorted(counted)
    mass = np.exp(base.log_p) * 1000.0 + L.Lattice(words, base).expected(np.array([counted[w] for w in words]))
    v = base.with_probabilities(mass)
    lp = dict(zip(words, L.Lattice(words, v).scores()))
    got = {x.doc_id: x for x in L.lattice_scores(docs, prior_words=1000.0).collect()}
    for i, t in rows:
        assert got[i].log_prob == pytest.approx(sum(lp[w] for w in t.split()), rel=1e-9)
        assert got[i].n_words == len(t.split())
        assert got[i].bits_per_char == pytest.approx(-got[i].log_prob / math.log(2) / sum(len(w) + 1 for w in t.split()), rel=1e-9)


def test_noise_is_less_likely_than_prose(make_docs):
    r = random.Random(5)
    noise = " ".join("".join(r.choice("qxzjkvw") for _ in range(6)) for _ in range(60))
    got = {x.doc_id: x.bits_per_char for x in L.lattice_scores(make_docs([(i, prose(i, 60)) for i in range(30)] + [(99, noise)])).collect()}
    assert got[99] > max(x for i, x in got.items() if i != 99)


def test_odd_inputs(odd_docs, no_docs):
    rows = L.lattice_scores(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    for i in (1, 2, 3):
        assert by[i].n_words == 0 and by[i].log_prob == 0 and by[i].bits_per_char is None and by[i].log_prob_per_word is None
    assert by[4].n_words == 60_000 and by[7].log_prob < 0
    assert len({(r.log_prob, r.n_words) for r in rows if r.doc_id == 5}) == 1
    assert L.lattice_scores(no_docs).count() == 0


def test_a_very_long_word(make_docs):
    (row,) = L.lattice_scores(make_docs([(1, "a" * 200_000)])).collect()
    assert row.n_words == 1 and math.isfinite(row.log_prob) and row.log_prob < 0
