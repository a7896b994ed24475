import random

import numpy as np
import pytest

from tests.llm.conftest import prose
from tracefold.llm import decontaminate as D
from tracefold.llm._text import word_hashes


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, items, rate=0.2, min_words=8):
    out = {}
    for d, text in docs:
        h, _ = word_hashes([text or ""])
        for i, item in items:
            w, _ = word_hashes([item or ""])
            if len(w) < min_words or not len(h):
                continue
            n, k = len(w), int(rate * len(w))
            best = min(plain_distance(w.tolist(), h[s : s + n].tolist()) for s in range(max(1, len(h) - n + 1)))
            if best <= k:
                out[d, i] = best
    return out


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        i = r.randrange(len(w))
        match r.randrange(3):
            case 0:
                w[i] = f"new{r.randrange(1000)}"
            case 1:
                w.insert(i, f"ins{r.randrange(1000)}")
            case 2:
                del w[i]
    return " ".join(w)


@pytest.fixture(scope="module")
def case(spark, make_docs):
    items = [(i, prose(100 + i, 12 + 3 * i)) for i in range(12)] + [(90, None), (91, ""), (92, "too short to count")]
    docs = []
    for d in range(60):
        body = prose(1000 + d, 60)
        if d % 2:
            i = d % 12
            body += " " + edited(items[i][1], d % 7, d).upper() + ", " + prose(2000 + d, 30)
        docs.append((d, body))
    docs += [(100, items[3][1]), (101, items[4][1].split(" ", 2)[2]), (102, None), (103, "")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id BIGINT, text STRING, doc_id STRING")
    return docs, items, make_docs(docs), benchmark


def test_same_as_brute_force_up_to_the_recall(case):
    docs, items, df, benchmark = case
    got = {(r.doc_id, r.item_id): r.distance for r in D.find_contamination(df, benchmark).collect()}
    want = brute(docs, items)
    assert set(got) <= set(want)
    assert len(want) > 25
    assert len(set(got) & set(want)) >= 0.95 * len(want)
    assert all(got[k] >= want[k] for k in got)
    exact = {k for k, v in want.items() if v == 0}
    assert exact and exact <= set(got)


def test_slices_of_the_benchmark_give_the_same(case):
    *_, df, benchmark = case
    key = lambda r: (r.doc_id, r.item_id)
    whole = {key(r) for r in D.find_contamination(df, benchmark).collect() if r.distance == 0}
    parts = {key(r) for r in D.find_contamination(df, benchmark, slice_chars=500).collect() if r.distance == 0}
    assert parts == whole


def test_drop_keeps_the_clean_with_all_columns(case):
    _, _, df, benchmark = case
    hit = {r.doc_id for r in D.find_contamination(df, benchmark).select("doc_id").distinct().collect()}
    kept = D.drop_contaminated(df, benchmark)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in df.collect()} - hit


def test_odd_inputs(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, prose(2, 80)), (None, prose(3, 50)), (2, None)], "item_id BIGINT, text STRING")
    got = [(r.doc_id, r.item_id) for r in D.find_contamination(odd_docs, items).collect()]
    assert sorted(got, key=str) == [(5, 1), (5, 1), (None, None)]
    assert D.drop_contaminated(odd_docs, items).count() == odd_docs.count() - 3
    assert D.find_contamination(no_docs, items).count() == 0
    assert D.find_contamination(odd_docs, items.where("false")).count() == 0
    assert D.drop_contaminated(odd_docs, items.where("false")).count() == odd_docs.count()


def test_edit_distances_of_rows():
    r = random.Random(5)
    a = [[r.randrange(1, 6) for _ in range(r.randrange(1, 9))] for _ in range(200)]
    b = [[r.randrange(1, 6) for _ in range(r.randrange(1, 9))] for _ in range(200)]
    pad = lambda x: np.array([y + [0] * (9 - len(y)) for y in x], np.uint64)
    got = D.edit_distances(pad(a), np.array([len(x) for x in a]), pad(b), np.array([len(x) for x in b]))
    assert got.tolist() == [plain_distance(x, y) for x, y in zip(a, b)]


def test_bit_parallel_distances():
    r = random.Random(6)
    for _ in range(150):
        a, b = ([r.randrange(1, 6) for _ in range(r.randrange(1, 40))] for _ in range(2))
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert list(D.bottom_row(x, y, False)) == [plain_distance(a, b[: j + 1]) for j in range(len(b))]
        assert list(D.bottom_row(x, y, True)) == [min(plain_distance(a, b[i : j + 1]) for i in range(j + 2)) for j in range(len(b))]


def test_all_windows_same_as_brute_force(case):
    docs, items, *_ = case
    named = [(i, t) for i, t in items if t]
    plan = D.make_plan([i for i, _ in named], [t for _, t in named], 0.2, 1.01, 2, 8, 7)  # no class reaches more than all
    assert all(c.walk is None for c in plan.classes)
    got = {(docs[d][0], plan.ids[i]): x for d, i, _, x, _ in D.scan_texts([t or "" for _, t in docs], plan)}
    assert got == brute(docs, items)


def test_long_items_are_recalled_among_short_ones():
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    items = [words(20) for _ in range(80)] + [words(300) for _ in range(20)] + [words(n) for n in (1500, 1500, 3000, 3000)]
    plan = D.make_plan(list(range(len(items))), [" ".join(x) for x in items], 0.2, 0.97, 2, 8, 7)
    docs = []
    for i, x in enumerate(items):
        x = list(x)
        for j in r.sample(range(len(x)), len(x) // 5):
            x[j] = f"new{r.randrange(10**6)}"
        docs.append(" ".join(words(30) + x + words(30)))
    found = {(d, i) for d, i, *_ in D.scan_texts(docs, plan)}
    assert found <= {(i, i) for i in range(len(items))}
    assert all((i, i) in found for i in range(100, 104))
    rng = np.random.default_rng(1)
    for c, group in enumerate(plan.classes):  # under fresh edits, each class on its own
        if group.walk is not None:
            i = rng.choice(np.flatnonzero(plan.of == c), 300)
            copies = np.zeros((300, group.words.shape[1]), np.uint64)
            for k, x in enumerate(i):
                copies[k, : plan.n[x]] = D._edited(plan.own[x], int(plan.k[x]), rng)
            hit = (D.embed(copies, plan.n[i], group.walk, group.at) == group.keys[:, plan.row[i]]).all(axis=2).any(axis=0)
            assert hit.mean() >= 0.94


def test_very_long_items_and_many_items():
    """An item of 100,000 words, and the memory of a plan of many items beside a long one."""
    import tracemalloc

    long = prose(1, 100_000)
    plan = D.make_plan([1, 2], [long, prose(2, 30)], 0.2, 0.97, 2, 8, 7)
    words = long.split()
    del words[500], words[90_000]
    found = list(D.scan_texts([" ".join(words), prose(3, 200), "x " + prose(2, 30)], plan))
    assert [(d, i) for d, i, *_ in found] == [(0, 0), (2, 1)] and found[0][3] <= 4
    r = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 10**6, 30)) for _ in range(4000)] + [prose(4, 600)]
    tracemalloc.start()
    D.make_plan(list(range(4001)), texts, 0.2, 0.97, 2, 8, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700e6
