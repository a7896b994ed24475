import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tracefold import streaming
from tracefold.operators import store as D
from tracefold.sources import files as S

SETS = "set_id STRING, status STRING, retrieval_eligible BOOLEAN, note STRING"
RULES = dict(keys=("set_id",), keep=("status", "note"), frozen=("retrieval_eligible",), defaults={"status": "undetermined", "retrieval_eligible": False})


def sets(spark, rows):
    return spark.createDataFrame(rows, SETS)


def test_upsert_keeps_decisions_and_takes_news(spark):
    stored = sets(spark, [("a", "operative", True, "kept"), ("b", "undetermined", False, None)])
    new = sets(spark, [("a", None, False, None), ("b", "superseded", None, "said"), ("c", None, None, None)])
    got = {tuple(r) for r in D.upsert(stored, new, **RULES).collect()}
    assert got == {("a", "operative", True, "kept"), ("b", "superseded", False, "said"), ("c", "undetermined", False, None)}


def test_second_ingest_changes_nothing(spark):
    new = sets(spark, [("a", "operative", True, "x"), ("b", None, None, None)])
    once = D.upsert(sets(spark, []), new, **RULES)
    twice = D.upsert(once, new, **RULES)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    docs = spark.createDataFrame([(1, "h1"), (2, "h2")], "doc_id BIGINT, sha256 STRING")
    assert {r.action for r in D.change_actions(docs, docs, ("doc_id",)).collect()} == {"unchanged"}
    moved = spark.createDataFrame([(1, "h1"), (2, "other"), (3, "h3")], "doc_id BIGINT, sha256 STRING")
    assert {r.doc_id: r.action for r in D.change_actions(docs, moved, ("doc_id",)).collect()} == {1: "unchanged", 2: "reextract", 3: "insert"}


def test_policy(spark):
    rows = [("a", "undetermined", True, None), ("b", "undetermined", False, None), ("c", "odd", False, None), ("d", "operative", True, None)]
    assert {r.set_id for r in D.policy_violations(sets(spark, rows)).collect()} == {"a", "c"}


def test_snapshots_are_seen_whole(spark, tmp_path):
    store = D.SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.read("sets") is None
    store.commit({"sets": sets(spark, [("a", "operative", True, None)]), "other": spark.range(3)})
    before = store.read("sets")
    store.commit({"sets": D.upsert(before, sets(spark, [("b", None, None, None)]), **RULES)})
    assert before.count() == 1 and store.read("sets").count() == 2 and store.read("other").count() == 3

    class Late(D.SnapshotStore):
        def _latest(self):
            return 1

    with pytest.raises(RuntimeError):
        Late(spark, f"file://{tmp_path}/s").commit({"other": spark.range(1)})
    assert store.read("other").count() == 3


def test_manifests(spark, tmp_path):
    put = lambda name, value: open(tmp_path / name, "w").write(json.dumps(value))
    parts = [{"page_offset": 3, "filename": "a.pdf"}, {"filing_party": "Q", "filename": "b.pdf"}]
    group = {"documents": parts, "selection_note": None, "status": "operative", "set_id": "1_5"}
    put("m.json", {"items": [{"sets": [group], "filing_party": "P", "item_number": 5, "control_number": "1"}]})
    got = {r.filename: r for r in S.read_manifest(spark, f"{tmp_path}/m.json").collect()}
    assert got["a.pdf"].page_offset == 3 and got["a.pdf"].filing_party == "P" and got["b.pdf"].filing_party == "Q" and got["b.pdf"].status == "operative"
    put("flat.json", [{"page_offset": 7, "filename": "c.pdf"}])
    assert [(r.filename, r.page_offset) for r in S.read_manifest(spark, f"{tmp_path}/flat.json").collect()] == [("c.pdf", 7)]
    assert S.read_prior(spark, f"file://{tmp_path}/none.json") is None
    (tmp_path / "broken.json").write_text('{"items": [')
    with pytest.raises(Exception):
        S.read_prior(spark, f"file://{tmp_path}/broken.json")[0].collect()


def test_served_folder(spark, tmp_path):
    for name in ("1_5_10.pdf", "1_5_9.PDF", "2_5_9.pdf", "notes.pdf", "1_5_9.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.filename: r for r in S.served_folder(spark, str(tmp_path), "1").collect()}
    assert set(got) == {"1_5_10.pdf", "1_5_9.PDF"} and not any(r.retrieval_eligible for r in got.values())
    assert {r.sha256 for r in S.contents(spark, str(tmp_path)).collect()} == {"2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"}


def docx(paragraphs, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(map(p, paragraphs)) + "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx(cells):
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = "".join("<row>" + "".join(f'<c r="{ref}" t="{"s" if isinstance(v, str) else "n"}"><v>{0 if isinstance(v, str) else v}</v></c>' for ref, v in row) + "</row>" for row in cells)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="A" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>Fuel cost</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_native_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["First", "Second"], [["Fuel cost", "1,200", "1,200", "(5)"]]))
    (tmp_path / "b.xlsx").write_bytes(xlsx([[("A1", "x"), ("C1", 7)], []]))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.odt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[-1]: r for r in S.read_natives(S.contents(spark, str(tmp_path))).collect()}
    assert got["a.docx"].text == "First\nSecond\nFuel cost\n1,200\n(5)" and got["a.docx"].grid == [["Fuel cost", "1,200", "(5)"]]
    assert got["b.xlsx"].grid == [["Fuel cost", "", "7"]] and got["b.xlsx"].text == "Fuel cost\t\t7"
    assert got["c.docx"].text is None and got["c.docx"].error and got["d.odt"].error
    pairs = S.native_pairs(S.read_natives(S.contents(spark, str(tmp_path))))
    assert {(r.label, r.token) for r in pairs.collect()} == {("Fuel cost", "1200"), ("Fuel cost", "-5"), ("Fuel cost", "7")}


def test_paginated_text_and_exports(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes(b"one\ftwo\xff\f")
    assert sorted((r.page_no, r.text) for r in S.paginated_text(spark, str(tmp_path)).collect()) == [(1, "one"), (2, "two\ufffd")]
    (tmp_path / "e.csv").write_text('a,b\n1,"x ""y""\nz"\n')
    assert S.read_export(spark, f"{tmp_path}/e.csv", ("a", "b")).first().b == 'x "y"\nz'
    with pytest.raises(ValueError):
        S.read_export(spark, f"{tmp_path}/e.csv", ("a", "missing"))
    S.write_report(spark.range(3), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 3


def test_stream_same_as_batch(spark, tmp_path):
    docs = spark.range(10).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    docs.write.parquet(f"{tmp_path}/in")
    seen = []
    run = lambda: streaming.ingest_stream(streaming.new_documents(spark, f"{tmp_path}/in", "doc_id BIGINT, text STRING"), f"{tmp_path}/cp", lambda df, n: seen.append((n, df.count()))).awaitTermination()
    run()
    run()
    assert sum(n for _, n in seen) == 10
    docs.where("doc_id < 4").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sum(n for _, n in seen) == 14


def test_event_windows(spark):
    t = dt.datetime(2024, 1, 1, 10, 59, 59)
    events = spark.createDataFrame([(t, "a", 1.0), (t + dt.timedelta(seconds=1), "a", 2.0), (t, "b", None)], "ts TIMESTAMP, event_type STRING, value DOUBLE")
    got = {(r.window_start.hour, r.event_type): (r.n, r.total) for r in streaming.event_windows(events).select(F.col("window_start"), "event_type", "n", "total").collect()}
    assert len(got) == 3 and (1, 2.0) in got.values() and (1, None) in got.values()


def test_last_entry_of_a_name_counts(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps([{"filename": "a.pdf", "description": "first", "page_offset": 1}, {"filename": "b.pdf"}, {"filename": "a.pdf", "description": "last"}, {"description": "no name"}]))
    got = {r.filename: (r.description, r.page_offset) for r in S.read_manifest(spark, f"{tmp_path}/flat.json").collect()}
    assert got == {"a.pdf": ("last", None), "b.pdf": (None, None)}
    items = [{"item_number": 1, "selection_note": "item", "sets": [{"set_id": "s", "status": "operative", "documents": [{"filename": "a.pdf", "page_offset": 1}]}, {"set_id": "t", "documents": []}]}, {"item_number": 2, "sets": [{"set_id": "s", "status": None, "documents": [{"filename": "a.pdf"}, {"filename": None}]}]}]
    (tmp_path / "nested.json").write_text(json.dumps({"items": items}))
    got = {r.filename: (r.item_number, r.page_offset, r.selection_note) for r in S.read_manifest(spark, f"{tmp_path}/nested.json").collect()}
    assert got == {"a.pdf": (2, None, None)}
    sets, docs = S.read_prior(spark, f"file://{tmp_path}/nested.json")
    assert {r.set_id: r.status for r in sets.collect()} == {"s": None, "t": None}  # one without documents is kept
    assert {r.filename: r.page_offset for r in docs.collect()} == {"a.pdf": None}
    sets, docs = S.read_prior(spark, f"file://{tmp_path}/flat.json")
    assert sets.count() == 0 and {r.filename: r.description for r in docs.collect()} == {"a.pdf": "last", "b.pdf": None}


def test_folder_source(spark, tmp_path):
    for name in ("70001_3_9.pdf", "40000_3_9.pdf", "notes.pdf"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "manifest.json").write_text(json.dumps([{"filename": "70001_3_9.pdf", "page_offset": 4}]))
    source = S.FolderSource(spark, f"file://{tmp_path}")
    listed = source.list_documents("70001")
    assert [(r.filename, r.page_offset) for r in listed.collect()] == [("70001_3_9.pdf", 4)]
    assert [bytes(r.content) for r in source.fetch(listed).collect()] == [b"70001_3_9.pdf"]


def test_ingest_twice_is_ingest_once(spark):
    docs = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", "h2")], "doc_id BIGINT, source_url STRING, sha256 STRING")
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id BIGINT, text STRING")
    anchors = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "doc_id BIGINT, page_no INT")
    dockets = spark.createDataFrame([(7, "title")], "docket INT, title STRING")
    new = {"dockets": dockets, "documents": docs, "texts": texts, "anchors": anchors}
    once = D.ingest({k: v.limit(0) for k, v in new.items()}, new)
    assert D.dry_run(once).first().asDict() == {"documents": 2, "reextracted": 2, "unchanged": 0, "texts": 2}
    again = D.ingest(once | {"documents": once["documents"].drop("changed")}, new | {"documents": docs.withColumn("source_url", F.lit("moved"))})
    assert D.dry_run(again).first().asDict() == {"documents": 2, "reextracted": 0, "unchanged": 2, "texts": 0}
    for t in ("dockets", "texts", "anchors"):
        assert sorted(map(tuple, again[t].collect())) == sorted(map(tuple, new[t].collect()))
    assert {r.source_url for r in again["documents"].collect()} == {"u1", "u2"}
    changed = spark.createDataFrame([(2, "u2", "other")], "doc_id BIGINT, source_url STRING, sha256 STRING")
    last = D.ingest(once | {"documents": once["documents"].drop("changed")}, new | {"documents": changed, "texts": texts.where("doc_id = 2").withColumn("text", F.lit("new")), "anchors": anchors.limit(0)})
    assert {(r.doc_id, r.text) for r in last["texts"].collect()} == {(1, "one"), (2, "new")} and [r.doc_id for r in last["anchors"].collect()] == [1]
