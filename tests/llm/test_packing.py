import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import packing as P


def plain_pack(sizes, caps, bin_cost, quadratic):
    """The same rules by plain search through all bins."""
    bins = []  # [capacity, used], in the order they got their room
    where = []
    for i, s in enumerate(sizes):
        fits = [b for b in bins if b["cap"] - b["used"] >= s]
        if fits:
            room = min(b["cap"] - b["used"] for b in fits)
            b = max((b for b in fits if b["cap"] - b["used"] == room), key=lambda b: b["stamp"])
        else:
            def rate(c):
                rest = sum(x for x in sizes[i + 1 :] if x <= c - s)
                return (bin_cost + c + quadratic * c * c) / (s + min(c - s, rest))
            b = {"cap": min((c for c in sorted(caps) if c >= s), key=rate), "used": 0, "name": len(bins)}
            bins.append(b)
        where.append((b["name"], b["used"]))
        b["used"] += s
        b["stamp"] = i
    return where, [min(c for c in caps if c >= b["used"]) for b in bins], [b["used"] for b in bins]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_same_as_plain_search(sizes):
    sizes = sorted(sizes, reverse=True)
    which, start, cap, used = P.pack(np.array(sizes, np.int64), (16, 32, 64), 4.0, 1e-3)
    where, caps, fill = plain_pack(sizes, (16, 32, 64), 4.0, 1e-3)
    assert list(zip(which.tolist(), start.tolist())) == where
    assert cap.tolist() == caps and used.tolist() == fill


def check(rows, lengths, caps):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        by_bin.setdefault(r.bin_id, []).append(r)
    for d, n in lengths.items():
        at = 0
        for s, k in sorted(by_doc[d]):
            assert s == at
            at += k
        assert at == n
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.n_tokens
        assert at == b[0].used <= b[0].capacity and b[0].capacity == min(c for c in caps if c >= at)


def test_every_token_is_packed_once(make_docs):
    lengths = {i: (i * 37) % 700 + 1 for i in range(300)} | {1000: 20_000}
    docs = make_docs([(i, "ab " * n) for i, n in lengths.items()])
    for group in (100_000, 50):
        rows = P.pack_documents(docs, group_docs=group).collect()
        check(rows, lengths, P.CAPACITIES)
    whole = P.pack_documents(docs).collect()
    used = {r.bin_id: (r.used, r.capacity) for r in whole}
    assert sum(u for u, _ in used.values()) / sum(c for _, c in used.values()) > 0.97


def test_odd_inputs(odd_docs, no_docs):
    rows = P.pack_documents(odd_docs).collect()
    ids = [r.doc_id for r in rows]
    assert not {1, 2, 3} & set(ids) and ids.count(5) == 2 and ids.count(None) == 1 and 4 in ids and 6 in ids
    assert P.pack_documents(no_docs).count() == 0


def test_token_count(spark):
    df = spark.createDataFrame([("one, two!",), ("abcdefg",), ("Straße 12",), ("",), (None,)], "text STRING")
    assert [r[0] for r in df.select(P.token_count(df.text)).collect()] == [4, 2, 2, 0, None]
