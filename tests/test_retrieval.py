import numpy as np
import pytest

from tracefold.operators import retrieval as R

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, place INT"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 9) for i, e in rows], SCHEMA)


@pytest.mark.parametrize("block", (4096, 17))
def test_exact_search_same_as_brute_force(spark, block):
    x = np.random.default_rng(0).standard_normal((90, 8)).astype(np.float32)
    x[50] = x[3]  # a tie
    table = vectors(spark, enumerate(x))
    got = {}
    for r in R.topk_cosine(table, table.where("vec_id < 40"), k=5, block=block).collect():
        got.setdefault(r.query_id, {})[r.place] = r.vec_id
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(40):
        s = (u[q] * u).sum(axis=1)
        s[q] = -np.inf
        assert [got[q][p] for p in range(1, 6)] == np.lexsort((np.arange(90), -s))[:5].tolist()


def test_odd_vectors(spark):
    rows = [(1, [1, 0]), (2, [2, 0]), (3, [0, 1]), (4, None), (5, []), (6, [0, 0]), (7, [1, None]), (8, [float("nan"), 1]), (9, [1, 0, 0]), (None, [1, 0])]
    t = vectors(spark, rows)
    got = {(r.query_id, r.place): (r.vec_id, round(r.similarity, 9)) for r in R.topk_cosine(t, t).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (3, 0.0), (2, 1): (1, 1.0), (2, 2): (3, 0.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0)}
    none = vectors(spark, [])
    assert R.topk_cosine(none, t).count() == 0 and R.topk_cosine(t, none).count() == 0


def test_rates_of_nothing_are_zero(spark):
    r = R.refusal_rates(spark.createDataFrame([], "answerable BOOLEAN, refused BOOLEAN")).first()
    assert r.refusal_rate == 0 and r.false_refusal_rate == 0


def test_similarity_same_as_plain_edit_distance(spark):
    from pyspark.sql import functions as F

    from tracefold.operators import retrieval as R

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    pairs = [("modern  Rates", "rnodern rates"), ("é", "e"), ("", ""), ("", "x"), ("rates", "all the Rates\n here"), ("Größe", "Grosse"), ("abc", "")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a STRING, b STRING").select(R.span_similarity(F.col("a"), F.col("b"))).collect()]
    for (a, b), s in zip(pairs, got):
        a, b = (" ".join(x.lower().split()) for x in (a, b))
        assert abs(s - (1 if a in b else 1 - distance(a, b) / max(len(a), len(b), 1))) < 1e-12


def test_forms_of_one_value(spark):
    from pyspark.sql import functions as F

    from tracefold.operators import retrieval as R

    texts = ["$1.2 billion or 1,200,000,000 or 1.2B or 1.2bn", "10.4% or 10.4 percent or .104", "(1,234) or -1234", "5 million people, 7 Kings, 3 blue", None, "none"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select(R.quantities(F.col("t"))).collect()]
    assert got == [[1.2e9], [0.104], [-1234.0], [5e6, 7.0, 3.0], None, []]
