import random

import pyarrow as pa
import pytest

import corpus_pipeline as P
from tests.llm.conftest import prose

ITEM = prose(4242, 40)
KEY = "d18fc9fb6494384932af3bda6fe8102c0fa7a26774e22af3993a69e2"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents: clean ones, junk, copies, a benchmark passage and a key."""
    r, rows = random.Random(9), []
    for i in range(120):
        lang = ("en", "de", "fr", "es")[i % 4]
        rows.append((i, prose(i, 90, lang), lang))
    rows += [(200, "#### 1234 !!!! ----", None), (201, "", "en"), (202, None, None)]
    near = prose(8, 90, "en").split()
    near[40] = "edit"
    rows += [(210, prose(4, 90, "en"), "en"), (211, " ".join(near), "en"), (212, prose(4, 90, "en"), "en")]
    rows += [(220, f"{prose(300, 60)} {ITEM} {prose(301, 60)}", "en"), (230, f"{prose(302, 60)} token {KEY} {prose(303, 60)}", "en")]
    rows += [(240, prose(304, 9000), "en")]
    r.shuffle(rows)
    d = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, l, "s", None if t is None else len(t)) for i, t, l in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, prose(4343, 30)), (3, None)], "item_id BIGINT, text STRING").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_take_effect_in_order(spark, corpus, tmp_path):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, ids, texts = docs.columns, [], []
    for name, stage in P.STAGES:
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == columns
            texts.append({r.doc_id: r.text for r in docs.collect()})
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = set(range(120)) | {240}
    assert ids[0] == clean | {210, 211, 212, 220, 230}
    assert ids[1] == ids[0] - {210, 211, 212}  # the smallest id of each group stays
    assert ids[2] == ids[1] - {220}
    assert ids[3] == ids[2] and KEY not in texts[3][230] and "[secret]" in texts[3][230]
    assert all(texts[3][i] == texts[0][i] for i in clean)
    assert ids[4] == ids[3]


def test_run_gives_the_last_stage(spark, corpus):
    got = P.run(spark, corpus)
    assert {"bin_id", "capacity", "doc_id", "piece", "n_tokens"} <= set(got.columns)
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(range(120)) | {230, 240}


def test_empty_and_odd_documents(spark, tmp_path, odd_docs, no_docs):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        d = f"{tmp_path}/{name}"
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, ITEM)], "item_id BIGINT, text STRING").write.parquet(f"{d}/benchmark.parquet")
        assert P.run(spark, d).count() == 0  # without labels no language is known


def test_odd_documents_reach_every_stage(spark, tmp_path):
    """Repeated ids with the same and with other texts, null ids, short and very long texts, beside enough labels to learn from."""
    rows = [(i, prose(i, 90, lang), lang) for i, lang in zip(range(80), ("en", "de", "fr", "es") * 20)]
    near = prose(4, 90).split()
    near[40] = "edit"
    rows += [(4, prose(900, 90), "en"), (300, " ".join(near), "en"), (5, prose(5, 90, "de"), "de")]  # id 4 with two texts, a near copy of the first, a repeated row
    rows += [(None, prose(901, 90), "en"), (None, f"{prose(902, 60)} {ITEM}", "en"), (None, f"{prose(903, 60)} {KEY} {prose(904, 9)}", None)]
    rows += [(310, prose(905, 60_000), "en"), (311, None, "en"), (312, "", "en"), (313, " \n ", None), (314, "!!! ###", "de")]
    d = str(tmp_path)
    docs = spark.createDataFrame([(i, t, l, None, None if t is None else len(t)) for i, t, l in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (1, ITEM), (None, None), (3, "")], "item_id BIGINT, text STRING").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        if name != "best_fit_packing":
            kept.append(sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:30]) for r in docs.collect()))
    start = lambda i, lang="en", n=90: prose(i, n, lang)[:30]
    clean = [(i, start(i, lang)) for i, lang in zip(range(80), ("en", "de", "fr", "es") * 20)]
    odd = [(4, start(900)), (-1, start(901)), (-1, start(902)), (-1, start(903)), (310, start(905))]
    assert kept[0] == sorted(clean + odd + [(300, start(4)), (5, start(5, "de"))])
    assert kept[1] == sorted(clean + odd)
    assert kept[2] == kept[3] == sorted(clean + odd[:2] + odd[3:])
    sizes = docs.groupBy("doc_id").count().collect()
    assert {r.doc_id for r in sizes} == set(range(80)) | {None, 310}
    assert sum(r.n_tokens for r in docs.where("doc_id = 310").collect()) >= 60_000


def test_stages_bound_what_python_gets_at_once(spark, make_docs):
    """A batch of 10,000 texts, many times over, took executors of the pipeline over their memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches)

    try:
        for rows, most in (("10000", 1000), ("0", 1000), ("70", 70)):
            spark.conf.set(key, rows)
            P.secret_scan(spark, make_docs([]), "")
            got = [r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n BIGINT").collect()]
            assert sum(got) == 2500 and max(got) == most
    finally:
        spark.conf.set(key, before)
