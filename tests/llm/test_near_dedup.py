import itertools
import random

import numpy as np

from tests.llm.conftest import prose
from tracefold.llm import near_dedup as N


def copies(n, seed=0):
    r, out = random.Random(seed), []
    for d in range(n):
        base = prose(d // 4 if d % 3 else 1000 + d, 120).split()
        for _ in range(r.randrange(0, 9)):
            base[r.randrange(len(base))] = f"edit{r.randrange(100)}"
        out.append((d, " ".join(base)))
    return out


def brute(rows, k=64, t=32):
    """(id, signature) of each distinct document with words, and the linked pairs of them as indices."""
    sig, kept = N.signatures([x or "" for _, x in rows], k, 11)
    docs = sorted({(rows[i][0], s.tobytes()) for i, s in zip(kept, sig) if rows[i][0] is not None})
    s = [np.frombuffer(b, np.uint32) for _, b in docs]
    return docs, {(i, j): int((s[i] == s[j]).sum()) for i, j in itertools.combinations(range(len(docs)), 2) if (s[i] == s[j]).sum() >= t}


def groups_of(docs, links):
    group = list(range(len(docs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in links:
        x, y = sorted((find(i), find(j)))
        group[y] = x
    return [find(i) for i in range(len(docs))]


REPEATED = [(500, prose(7, 120)), (501, prose(7, 120)), (502, prose(7, 120)), (502, prose(7, 120)), (3, prose(1000, 120)), (7, prose(0, 120)), (7, prose(900, 60)), (900, prose(900, 60))]


def test_links_between_classes_same_as_brute_force(make_docs):
    rows = copies(140) + REPEATED
    docs, links = brute(rows)
    first = {}
    for i, (_, s) in enumerate(docs):
        first.setdefault(s, i)
    want = sorted((docs[i][0], docs[j][0], m) for (i, j), m in links.items() if docs[i][1] != docs[j][1] and first[docs[i][1]] == i and first[docs[j][1]] == j)
    for block in (2048, 3):  # also with posting lists cut into blocks
        got = N.near_pairs(make_docs(rows), block=block).collect()
        assert len({(r.key_a, r.key_b) for r in got}) == len(got)  # each once
        assert sorted((r.doc_a, r.doc_b, r.matches) for r in got) == want
    assert len(want) > 30


def test_documents_same_as_brute_force(make_docs):
    rows = copies(140) + REPEATED
    docs, links = brute(rows)
    group = groups_of(docs, links)
    n, best = [0] * len(docs), [0] * len(docs)
    for (i, j), m in links.items():
        for x in (i, j):
            n[x], best[x] = n[x] + 1, max(best[x], m)
    for block in (2048, 3):
        got = N.near_duplicates(make_docs(rows), block=block).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links, r.best_jaccard * 64) for r in got) == sorted((docs[i][0], docs[group[i]][0], n[i], best[i]) for i in range(len(docs)))
        # The key tells classes apart, also those of the same smallest id.
        assert len({r.class_key for r in got}) == len(set(group))
        assert len({(r.class_id, r.class_key) for r in got}) == len(set(group))


def test_long_lists_are_compared_in_arrays(make_docs):
    r, rows = random.Random(5), []
    base = prose(77, 150).split()
    for d in range(180):
        x = list(base)
        for _ in range(4):
            x[r.randrange(len(x))] = f"e{r.randrange(10**6)}"
        rows.append((d, " ".join(x)))
    docs, links = brute(rows)
    n = [0] * len(docs)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    for block in (2048, 70):
        assert sorted((r.doc_id, r.n_links) for r in N.near_duplicates(make_docs(rows), block=block).collect()) == [(d, c) for (d, _), c in zip(docs, n)]
    assert sum(n) > 180 * 100


def test_odd_inputs(odd_docs, no_docs):
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in N.near_duplicates(odd_docs).collect())
    assert got == [(i, i, 0) for i in range(1, 9)]  # doc 5 twice is one document; the rest is apart or has no words
    assert N.near_pairs(odd_docs).count() == 0 and N.near_pairs(no_docs).count() == 0 and N.near_duplicates(no_docs).count() == 0
    kept = N.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.where("doc_id = 5").count() == 1
    assert kept.count() == odd_docs.count() - 1
    assert N.drop_near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(make_docs):
    rows = copies(140) + REPEATED
    docs, links = brute(rows)
    group = groups_of(docs, links)
    want = sorted(docs[i][0] for i in set(group))
    for most in (1_000_000, 0):  # ids broadcast, and shuffled
        kept = N.drop_near_duplicates(make_docs(rows), broadcast_ids=most).collect()
        assert sorted(r.doc_id for r in kept) == want
        assert sorted((r.doc_id, r.text) for r in kept) == sorted(set((r.doc_id, r.text) for r in kept) & set(rows))


def edited(seed, i=40):
    x = prose(seed, 90).split()
    x[i] = "edit"
    return " ".join(x)


def test_no_text_is_lost_under_a_repeated_id(make_docs):
    a, b = prose(8, 90), prose(9, 90)
    kept = N.drop_near_duplicates(make_docs([(1, a), (1, b), (2, edited(8)), (3, edited(9))])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b)])
    # An id of which one text is redundant and another isn't, or has no words, keeps the other.
    kept = N.drop_near_duplicates(make_docs([(1, a), (2, edited(8)), (2, b), (2, ""), (2, None), (2, b), (None, a), (3, b.upper()), (3, b)])).collect()
    assert sorted((r.doc_id or 0, "-" if r.text is None else r.text) for r in kept) == sorted([(1, a), (2, b), (2, ""), (2, "-"), (0, a)])
    # Of rows of one id and signature the smallest text stays.
    kept = N.drop_near_duplicates(make_docs([(3, b), (3, b.upper()), (3, b)])).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(3, b.upper())]


def test_short_texts_and_case(make_docs):
    rows = [(1, "one two"), (2, "One, TWO!"), (3, "one"), (4, "two one"), (5, "one two three"), (6, "ONE two; three")]
    got = {r.doc_id: (r.class_id, r.best_jaccard) for r in N.near_duplicates(make_docs(rows)).collect()}
    assert got[1] == got[2] == (1, 1.0) and got[5] == got[6] == (5, 1.0)


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    got = {r.doc_id: r.group_id for r in N.components(spark.createDataFrame(chain, "doc_a BIGINT, doc_b BIGINT")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_estimate_follows_jaccard():
    r = random.Random(1)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(30):
            w = [f"w{r.randrange(10**6)}" for _ in range(300)]
            v = [x if r.random() < share else f"v{r.randrange(10**6)}" for x in w]
            grams = lambda x: {tuple(x[i : i + 3]) for i in range(len(x) - 2)}
            a, b = grams(w), grams(v)
            s, t = N.signatures([" ".join(w), " ".join(v)], 64, 11)[0]
            errors.append((s == t).mean() - len(a & b) / len(a | b))
        assert abs(np.mean(errors)) < 0.05
