"""Documented behaviour of the operators on literal rows."""

import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracefold.functions import names, numbers, text, triage as R
from tracefold.operators import chunks as C, pages as P, sets as S, triage as T


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = {
    "1,234.50": ["1234.5"], "$ 45": ["45"], "(1,234)": ["-1234"], "(0)": ["0"], "-0": ["0"], "-$45": ["45"], "$-45": ["-45"], "2019-04-05": ["2019", "-4", "-5"],
    "12\n%": ["12%"], "10.40%": ["10.4%"], "(7": ["7"], "7)": ["7"], "x(1)": ["-1"], "007": ["7"], "0.50": ["0.5"], "100": ["100"], "no": [], "": [], "(7\n)": ["-7"],
}


def test_canonical_numbers(spark):
    got = column(spark, list(CASES), lambda c: F.transform(numbers.raw_tokens(c), numbers.canonical))
    assert dict(zip(CASES, got)) == CASES


def plainly(text):
    out = []
    for m in re.finditer(r"(\()?\s*\$?\s*(-)?([0-9][0-9,]*(?:\.[0-9]+)?)\s*(\))?\s*(%)?", text):
        d = Decimal(m[3].replace(",", ""))
        if m[2] or (m[1] and m[4]):
            d = -d if d else d
        s = format(d, "f")
        s = s.rstrip("0").rstrip(".") if "." in s else s
        out.append(s + (m[5] or ""))
    return out


def test_canonical_same_as_decimals(spark):
    found = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(alphabet="0123456789,.$()-% \nx", max_size=25))
    def collect(t):
        found.append(t)

    collect()
    got = column(spark, found, lambda c: F.transform(numbers.raw_tokens(c), numbers.canonical))
    assert got == [plainly(t) for t in found]


def test_furniture(spark):
    given = ["(1) first item", "Rate base (45) 12", "Contents ........ 17\nnext", "a\n  (12)\nb", "(123) kept"]
    assert column(spark, given, numbers.strip_furniture) == [" first item", "Rate base (45) 12", "\nnext", "a\n\nb", "(123) kept"]


def test_normal_form(spark):
    assert column(spark, ["ﬁne", "co­op", "a\r\nb\rc", None], text.norm_text) == ["fine", "coop", "a\nb\nc", None]


def test_marks_of_pages(spark):
    rows = ["x 00001 00002", "Page 3 of 9 PAGE 4 OF 9", "nothing 123", "00001234 0000"]
    assert column(spark, rows, text.last_stamp) == ["00002", None, None, "00001234"]
    assert column(spark, rows, text.page_label) == [None, "3 of 9", None, None]
    assert column(spark, ["Control Number: 1 Item Number: 2", "Item Number: 2", "control number: item number:"], text.is_cover) == [True, False, False]


@pytest.mark.parametrize("name, want", [("1_22_333.pdf", ("1", 22, "333")), ("/a/b/1_2_3.PDF", ("1", 2, "3")), ("1_2.pdf", (None,) * 3), ("x1_2_3.pdf", (None,) * 3), (None, (None,) * 3)])
def test_names(spark, name, want):
    assert tuple(column(spark, [name], names.parse_filename)[0]) == want


def test_page_ranges(spark):
    got = column(spark, ["Pages 101 to 200", "page 1-7", "Vol. pages 3 – 4", "Volume 2", None], names.page_range)
    assert [tuple(r) for r in got] == [(101, 200), (1, 7), (3, 4), (None, None), (None, None)]


def test_persons_and_organisations(spark):
    people = ["Jane Doe", "Smith, John", "Jane M. Doe", "O'Neil, Mary-Ann"]
    others = [None, "", "Cher", "Staff Group", "Acme Energy", "City of X", "A B C D", "A1 Storage", "H-E-B, LP"]
    assert column(spark, people + others, R.looks_like_person) == [True] * len(people) + [False] * len(others)


def test_triage_order_and_default(spark):
    rows = [(" conf ", "Motion", None), (None, "Motion to intervene", "Jane Doe"), (None, "Confidential motion to intervene", None), (None, "Direct testimony", "Acme Energy"), (None, None, None), (None, "", ""), (None, "  Eratta  sheet", None), (None, "Native Files", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, item_type STRING, description STRING, party STRING")
    judged = T.triage(df).orderBy("i")
    assert [(r.include, r.reason) for r in judged.collect()] == [(False, "confidential"), (False, "pii_risk"), (False, "confidential"), (True, None), (True, None), (True, None), (False, "out_of_scope"), (False, "non_text")]
    counts = {r.outcome: r.n for r in T.summarize(judged).collect()}
    assert counts == {"included": 3, "confidential": 2, "pii_risk": 1, "procedural": 0, "non_text": 1, "out_of_scope": 1}
    assert {r.n for r in T.summarize(judged.limit(0)).collect()} == {0}


def test_sets_by_gaps(spark):
    refs = [("1", 5, str(d), f"1_5_{d}.pdf") for d in (100, 132, 165, 166)] + [("1", 6, str(d), f"1_6_{d}.pdf") for d in (9, 10, 42)]
    got = {(r.item_number, r.document_id): (r.set_id, r.part_ordinal, r.n_parts) for r in S.document_sets(spark.createDataFrame(refs, "control_number STRING, item_number INT, document_id STRING, filename STRING")).collect()}
    assert got[5, "132"] == ("1_5_a", 1, 2) and got[5, "165"] == ("1_5_b", 0, 2)  # 32 apart is one set, 33 is two
    assert got[6, "9"] == ("1_6", 0, 3) and got[6, "10"][1] == 1 and got[6, "42"][1] == 2  # by number, not by sign


PAGES = [(1, 1, "one two"), (1, 2, "three\n"), (1, 3, ""), (2, 1, "Page 1 of 1")]


def pages_of(spark, rows=PAGES):
    return spark.createDataFrame(rows, "doc_id BIGINT, page_no INT, text STRING")


def test_spans_tile_the_text(spark):
    spans = P.page_spans(pages_of(spark))
    got = {(r.doc_id, r.page_no): (r.char_start, r.char_end) for r in spans.collect()}
    assert got == {(1, 1): (0, 8), (1, 2): (8, 14), (1, 3): (14, 15), (2, 1): (0, 12)}
    lengths = P.extract(pages_of(spark)).select("doc_id", "n_chars")
    assert P.span_violations(spans, lengths).count() == 0
    moved = spans.withColumn("char_start", F.col("char_start") + (F.col("page_no") == 2).cast("int"))
    assert [r.problem for r in P.span_violations(moved, lengths).collect()] == ["gap or overlap"]


def test_offsets_at_the_edges(spark):
    spans = P.page_spans(pages_of(spark))
    asked = spark.createDataFrame([(1, o) for o in (0, 7, 8, 14, 15)], "doc_id BIGINT, offset BIGINT")
    assert {r.offset: r.page_no for r in P.resolve_offsets(asked, spans).collect()} == {0: 1, 7: 1, 8: 2, 14: 3, 15: None}


TABLE = "Schedule A\n(in thousands)\nCash\n$\n100\n(5)\nPlant and land\n7\n8\n9\n"


def test_tables_keep_their_rows_and_header(spark):
    lines = P.lines_of(P.page_spans(pages_of(spark, [(1, 1, TABLE)])))
    assert {r.kind for r in C.page_kinds(lines).collect()} == {"table"}
    headed = C.with_header(C.with_kind(lines))
    assert {r.header_end for r in headed.collect()} == {2}


def test_same_result_however_it_is_partitioned(spark):
    many = pages_of(spark, [(d, p, f"Line {d} {p}\nanother line of text here\n00{p:03d}") for d in range(20) for p in range(1, 6)])
    a = P.page_spans(many.repartition(1)).orderBy("doc_id", "page_no").collect()
    assert a == P.page_spans(many.repartition(13)).orderBy("doc_id", "page_no").collect()
