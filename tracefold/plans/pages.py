"""Queries on pages, anchors, lines and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import chunks as C, pages as P
from tracefold.plans import inputs as I
from tracefold.plans import query


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_spans(I.pages(spark, sf))


_S, _L = f"WITH {I.SPANS_SQL}\n", f"WITH RECURSIVE {I.LINES_SQL}"


@query(_S + "SELECT doc_id, page_no, char_start, char_end FROM spans")
def page_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).select("doc_id", "page_no", "char_start", "char_end")


@query(_S + "SELECT doc_id, page_no, bates, page_label, anchor_scheme, anchor_value FROM spans")
def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).select("doc_id", "page_no", "bates", "page_label", "anchor_scheme", "anchor_value")


@query(_S + "SELECT doc_id, page_no FROM spans WHERE is_cover_sheet")
def cover_sheets(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).where("is_cover_sheet").select("doc_id", "page_no")


@query(_S + "SELECT doc_id, page_no, anchor_value FROM spans WHERE NOT is_cover_sheet")
def citable_pages(spark: SparkSession, sf: str) -> DataFrame:
    return P.citable(_spans(spark, sf)).select("doc_id", "page_no", "anchor_value")


@query(_S + "SELECT doc_id, count(*) FILTER (NOT is_cover_sheet AND anchor_scheme = 'bates') AS bates, count(*) FILTER (NOT is_cover_sheet AND anchor_scheme = 'page_label') AS page_label, count(*) FILTER (NOT is_cover_sheet AND anchor_scheme = 'pdf_page') AS pdf_page FROM spans GROUP BY doc_id")
def anchor_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return P.anchor_coverage(_spans(spark, sf))


_OFFSETS = ", offsets AS (SELECT doc_id, CAST((n_chars * k) // 4 AS BIGINT) AS \"offset\" FROM documents, (SELECT unnest([0, 1, 2, 3, 4, 40]) AS k))"


@query(f"WITH {I.SPANS_SQL}{_OFFSETS}\nSELECT o.doc_id, o.\"offset\", s.page_no, s.page_no + CAST(o.doc_id % 3 AS INT) * 100 AS filing_page, s.anchor_scheme, s.anchor_value FROM offsets o LEFT JOIN spans s ON s.doc_id = o.doc_id AND s.char_start <= o.\"offset\" AND o.\"offset\" < s.char_end")
def offset_to_page(spark: SparkSession, sf: str) -> DataFrame:
    """Six offsets of each document, some beyond its end, resolved to page, filing page and anchor."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    offsets = d.select("doc_id", F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 4, 40)))).alias("k"), "n_chars").select("doc_id", F.expr("n_chars * k div 4").alias("offset"))
    return P.resolve_offsets(offsets, _spans(spark, sf), F.col("doc_id").cast("int") % 3 * 100).select("doc_id", "offset", "page_no", "filing_page", "anchor_scheme", "anchor_value")


@query("SELECT doc_id, substring(text, CAST(n_chars // 3 AS BIGINT) + 1, 40) AS slice FROM documents")
def slice_check(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a = F.expr("CAST(n_chars div 3 AS INT)")
    return d.select("doc_id", P.slice_text(F.col("text"), a, a + 40).alias("slice"))


_LAYERS = f"WITH {I.SPANS_SQL},\nlayers AS (SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS page_count FROM spans GROUP BY doc_id),\nprobed AS (SELECT *, n_chars / CAST(page_count AS DOUBLE) AS chars_per_page, n_chars / CAST(page_count AS DOUBLE) >= 200 AS has_text_layer FROM layers)\n"


@query(_LAYERS + "SELECT doc_id, n_chars, page_count, chars_per_page, has_text_layer, CASE WHEN has_text_layer THEN 'ok' ELSE 'no_text_layer' END AS status FROM probed")
def text_layer(spark: SparkSession, sf: str) -> DataFrame:
    return P.text_layers(I.pages(spark, sf))


_EDGES = ", ".join(f"({a}, {b}, (SELECT count(*) FROM probed WHERE chars_per_page >= {a}{f' AND chars_per_page < {b}' if b != 'NULL' else ''}))" for a, b in zip((0, *P.HISTOGRAM_EDGES), (*P.HISTOGRAM_EDGES, "NULL")))


@query(_LAYERS + f"SELECT CAST(low AS INT) AS low, CAST(high AS INT) AS high, n, repeat('#', CAST(least(n, 50) AS INT)) AS bar FROM (VALUES {_EDGES}) v(low, high, n)")
def cpp_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram(P.text_layers(I.pages(spark, sf)), "chars_per_page")


@query(_LAYERS + "SELECT count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS total_pages, CAST(sum(CASE WHEN has_text_layer THEN page_count ELSE 0 END) AS BIGINT) AS digital_pages, sum(CASE WHEN has_text_layer THEN page_count ELSE 0 END) * 100.0::DOUBLE / sum(page_count) AS coverage FROM probed")
def probe_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.probe_summary(P.text_layers(I.pages(spark, sf)))


@query(_S + ", whole AS (SELECT doc_id, string_agg(text, '' ORDER BY page_no) AS text FROM spans GROUP BY doc_id) SELECT doc_id, sha256(text) AS sha256, length(text) AS n_chars FROM whole")
def extract_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts put together from normalised pages."""
    return P.extract(I.pages(spark, sf)).select("doc_id", F.sha2("text", 256).alias("sha256"), "n_chars")


def _shifted(spans: DataFrame) -> DataFrame:
    """Spans with faults on purpose: every 11th page begins one character late, every 13th ends before it begins."""
    k = F.col("doc_id") + F.col("page_no")
    return spans.withColumn("char_start", F.col("char_start") + (k % 11 == 0).cast("int")).withColumn("char_end", F.when(k % 13 == 0, F.col("char_start") - 5).otherwise(F.col("char_end")))


_VIOLATIONS = """lengths AS (SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM spans GROUP BY doc_id),
chained AS (SELECT f.*, lag(char_end, 1, 0) OVER (PARTITION BY doc_id ORDER BY page_no) AS before, lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) IS NULL AS last FROM faulty f),
judged AS (SELECT c.doc_id, page_no, char_start, char_end, CASE WHEN char_start <> before THEN 'gap or overlap' WHEN char_end < char_start THEN 'inverted' WHEN last AND char_end <> n_chars THEN 'doesn''t end with the text' END AS problem FROM chained c JOIN lengths USING (doc_id))
SELECT * FROM judged WHERE problem IS NOT NULL"""


@query(f"WITH {I.SPANS_SQL}, faulty AS (SELECT doc_id, page_no, char_start, char_end FROM spans), {_VIOLATIONS}")
def span_violations(spark: SparkSession, sf: str) -> DataFrame:
    """No rows: page spans tile their documents."""
    s = _spans(spark, sf)
    return P.span_violations(s, s.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars")))


@query(f"WITH {I.SPANS_SQL}, late AS (SELECT doc_id, page_no, char_start + CASE WHEN (doc_id + page_no) % 11 = 0 THEN 1 ELSE 0 END AS char_start, char_end FROM spans), faulty AS (SELECT doc_id, page_no, char_start, CASE WHEN (doc_id + page_no) % 13 = 0 THEN char_start - 5 ELSE char_end END AS char_end FROM late), {_VIOLATIONS}")
def span_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Faults put into the spans on purpose are all found."""
    s = _spans(spark, sf)
    return P.span_violations(_shifted(s), s.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars")))


@query(_L + " SELECT doc_id, page_no, line_no, text, char_start, char_end FROM lines")
def lines(spark: SparkSession, sf: str) -> DataFrame:
    return P.lines_of(_spans(spark, sf)).select("doc_id", "page_no", "line_no", "text", "char_start", "char_end")


@query(_L + " SELECT doc_id, page_no, count(*) FILTER (is_numeric) AS n_numeric, count(*) FILTER (is_blank) AS n_blank, count(*) AS n_lines FROM lines GROUP BY ALL")
def line_class(spark: SparkSession, sf: str) -> DataFrame:
    return P.lines_of(_spans(spark, sf)).groupBy("doc_id", "page_no").agg(F.count_if("is_numeric").alias("n_numeric"), F.count_if("is_blank").alias("n_blank"), F.count("*").alias("n_lines"))


_KINDS = ",\nkinds AS (SELECT doc_id, page_no, CASE WHEN coalesce(avg(length(text)) FILTER (NOT is_blank), 15) >= 15 THEN 'prose' ELSE 'table' END AS kind FROM lines GROUP BY ALL)"
_HEADERS = _KINDS + """,
content AS (SELECT *, coalesce(lead(is_numeric, 1) OVER w, FALSE) AND coalesce(lead(is_numeric, 2) OVER w, FALSE) AND coalesce(lead(is_numeric, 3) OVER w, FALSE) AS three FROM lines WHERE NOT is_blank WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
opening AS (SELECT doc_id, page_no, min(line_no) AS first FROM content WHERE three AND NOT is_numeric GROUP BY ALL),
headers AS (SELECT l.doc_id, l.page_no, CAST(coalesce(any_value(o.first), least(count(*), 30)) AS INT) AS header_end FROM lines l LEFT JOIN opening o ON o.doc_id = l.doc_id AND o.page_no = l.page_no GROUP BY ALL)"""
_ROWS = _HEADERS + """,
below AS (SELECT l.*, row_number() OVER (PARTITION BY l.doc_id, l.page_no ORDER BY line_no) AS k FROM lines l JOIN headers h ON h.doc_id = l.doc_id AND h.page_no = l.page_no WHERE NOT is_blank AND line_no >= header_end),
table_rows AS (SELECT *, CAST(sum(CASE WHEN NOT is_numeric OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS INT) AS row_no FROM below)"""
_CHUNKS = _ROWS + r""",
units AS (SELECT r.doc_id, r.page_no, 'table' AS kind, row_no AS unit, CAST(sum(length(text)) AS BIGINT) AS size, FALSE AS blank FROM table_rows r JOIN kinds k ON k.doc_id = r.doc_id AND k.page_no = r.page_no AND kind = 'table' GROUP BY ALL
  UNION ALL SELECT l.doc_id, l.page_no, 'prose', line_no + 1, length(text), is_blank FROM lines l JOIN kinds k ON k.doc_id = l.doc_id AND k.page_no = l.page_no AND kind = 'prose'),
citable AS (SELECT u.* FROM units u JOIN spans s ON s.doc_id = u.doc_id AND s.page_no = u.page_no AND NOT is_cover_sheet),
packed AS (SELECT doc_id, page_no, kind, unit, 0 AS batch, CASE WHEN kind = 'prose' AND size >= 1200 AND blank THEN 1 ELSE 0 END AS next, CASE WHEN kind = 'prose' AND size >= 1200 AND blank THEN 0 ELSE 1 END AS held, CASE WHEN kind = 'prose' AND size >= 1200 AND blank THEN 0 ELSE size END AS total FROM citable WHERE unit = 1
  UNION ALL SELECT doc_id, page_no, kind, unit, b, CASE WHEN kind = 'prose' AND t >= 1200 AND blank THEN b + 1 ELSE b END, CASE WHEN kind = 'prose' AND t >= 1200 AND blank THEN 0 ELSE 1 END, CASE WHEN kind = 'prose' AND t >= 1200 AND blank THEN 0 ELSE t END
  FROM (SELECT u.doc_id, u.page_no, u.kind, u.unit, u.blank, p.next + CASE WHEN held > 0 AND total + u.size > CASE WHEN u.kind = 'prose' THEN 2000 ELSE 1200 END THEN 1 ELSE 0 END AS b, CASE WHEN held > 0 AND total + u.size > CASE WHEN u.kind = 'prose' THEN 2000 ELSE 1200 END THEN u.size ELSE total + u.size END AS t
    FROM packed p JOIN citable u ON u.doc_id = p.doc_id AND u.page_no = p.page_no AND u.unit = p.unit + 1)),
heads AS (SELECT l.doc_id, l.page_no, string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY line_no) || chr(10) || chr(10) AS context, min(char_start) AS context_char_start, max(char_end) AS context_char_end FROM lines l JOIN headers h ON h.doc_id = l.doc_id AND h.page_no = l.page_no JOIN kinds k ON k.doc_id = l.doc_id AND k.page_no = l.page_no AND kind = 'table' WHERE NOT is_blank AND line_no < header_end GROUP BY ALL),
placed AS (SELECT l.doc_id, l.page_no, p.kind, p.batch, l.line_no, l.text, l.char_start, l.char_end FROM packed p JOIN lines l ON p.kind = 'prose' AND l.doc_id = p.doc_id AND l.page_no = p.page_no AND l.line_no + 1 = p.unit AND NOT is_blank
  UNION ALL SELECT l.doc_id, l.page_no, p.kind, p.batch, l.line_no, l.text, l.char_start, l.char_end FROM packed p JOIN table_rows l ON p.kind = 'table' AND l.doc_id = p.doc_id AND l.page_no = p.page_no AND l.row_no = p.unit),
bodies AS (SELECT doc_id, page_no, kind, batch, string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY line_no) AS body, min(char_start) AS char_start, max(char_end) AS char_end FROM placed GROUP BY ALL),
chunks AS (SELECT b.doc_id, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.page_no, batch) - 1 AS ordinal, b.page_no AS page_start, b.page_no AS page_end, b.kind, coalesce(context, '') || body AS text, b.char_start, b.char_end, coalesce(context, '') AS context, context_char_start, context_char_end, anchor_scheme, anchor_value
  FROM bodies b JOIN spans s ON s.doc_id = b.doc_id AND s.page_no = b.page_no LEFT JOIN heads h ON h.doc_id = b.doc_id AND h.page_no = b.page_no)"""


@query(_L + _KINDS + " SELECT doc_id, page_no, kind FROM kinds")
def page_kind(spark: SparkSession, sf: str) -> DataFrame:
    return C.page_kinds(P.lines_of(_spans(spark, sf)))


@query(_L + _HEADERS + " SELECT doc_id, page_no, header_end FROM headers")
def header_end(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_header(P.lines_of(_spans(spark, sf))).groupBy("doc_id", "page_no").agg(F.first("header_end").alias("header_end"))


@query(_L + _ROWS + " SELECT doc_id, page_no, line_no, row_no FROM table_rows")
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return C.table_rows(P.lines_of(_spans(spark, sf))).select("doc_id", "page_no", "line_no", "row_no")


def _chunks(spark: SparkSession, sf: str, *columns: str, kind: str | None = None) -> DataFrame:
    return C.chunks(_spans(spark, sf), columns or C.COLUMNS, kind)


_SHOWN = ("doc_id", "ordinal", "text", "char_start", "char_end")


@query(_L + _CHUNKS + " SELECT * FROM chunks")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(_L + _CHUNKS + " SELECT doc_id, ordinal, text, char_start, char_end FROM chunks WHERE kind = 'table'")
def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, *_SHOWN, kind="table").withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(_L + _CHUNKS + " SELECT doc_id, ordinal, text, char_start, char_end FROM chunks WHERE kind = 'prose'")
def chunk_prose(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, *_SHOWN, kind="prose").withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(_L + _CHUNKS + " SELECT doc_id, ordinal, CAST(CASE WHEN which = 1 AND context_char_start IS NOT NULL THEN 1 ELSE 0 END AS INT) AS span_no, CASE WHEN which = 0 THEN context_char_start ELSE char_start END AS span_start, CASE WHEN which = 0 THEN context_char_end ELSE char_end END AS span_end FROM chunks, (SELECT unnest([0, 1]) AS which) WHERE which = 1 OR context_char_start IS NOT NULL")
def chunk_spans(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunk_spans(_chunks(spark, sf, "doc_id", "ordinal", "char_start", "char_end", "context_char_start", "context_char_end")).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(_L + _CHUNKS + ", sized AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS k, count(*) OVER () AS c FROM chunks) SELECT count(*) AS chunks, count(*) FILTER (kind = 'table') AS \"table\", count(*) FILTER (kind = 'prose') AS prose, count(*) FILTER (anchor_scheme = 'pdf_page') AS weakly_anchored, CAST((SELECT n FROM sized WHERE k = c // 2) AS INT) AS median_chars, CAST(max(length(text)) AS INT) AS max_chars FROM chunks")
def chunk_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.summarize(_chunks(spark, sf, "kind", "n_chars", "anchor_scheme"))


@query(_L + _CHUNKS + ", planted AS (SELECT doc_id, ordinal, CASE WHEN (doc_id + ordinal) % 11 = 0 THEN 'span outside of the document' WHEN (doc_id + ordinal) % 13 = 0 THEN 'body differs from its span' END AS problem FROM chunks) SELECT * FROM planted WHERE problem IS NOT NULL")
def chunk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk is checked against its document; those with faults put in on purpose are found, and no other."""
    s = _spans(spark, sf)
    whole = s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "").alias("text"))
    k = F.col("doc_id") + F.col("ordinal")
    faulty = C.chunks(s).withColumn("char_end", F.when(k % 11 == 0, F.col("char_end") + 1_000_000_000).otherwise(F.col("char_end"))).withColumn("text", F.when(k % 13 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    return C.chunk_violations(faulty, whole, check_context=True).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(_S + ", kinds AS (SELECT d.source AS set_id, s.* FROM spans s JOIN documents d ON d.doc_id = s.doc_id) SELECT set_id, count(*) FILTER (NOT is_cover_sheet AND anchor_scheme = 'bates') AS bates, count(*) FILTER (NOT is_cover_sheet AND anchor_scheme = 'page_label') AS page_label, count(*) FILTER (NOT is_cover_sheet AND anchor_scheme = 'pdf_page') AS pdf_page, (SELECT count(*) FROM kinds WHERE NOT is_cover_sheet AND anchor_scheme = 'pdf_page') AS weak_total FROM kinds GROUP BY set_id")
def anchor_set_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Citable pages by anchor scheme for each set of documents, beside the number of weakly anchored pages in all."""
    sets = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("source").alias("set_id"))
    return P.with_weak_total(P.anchor_coverage(_spans(spark, sf).join(sets, "doc_id"), "set_id"))


@query(_L + _ROWS + ", table_pages AS (SELECT k.doc_id, k.page_no FROM kinds k JOIN spans s ON s.doc_id = k.doc_id AND s.page_no = k.page_no WHERE kind = 'table' AND NOT is_cover_sheet) SELECT t.doc_id, t.page_no FROM table_pages t WHERE NOT EXISTS (SELECT 1 FROM table_rows r WHERE r.doc_id = t.doc_id AND r.page_no = t.page_no)")
def uncovered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Table pages that are all header and so give no chunk."""
    s = _spans(spark, sf)
    held = C.with_header(C.with_kind(P.lines_of(s))).where("kind = 'table'").groupBy("doc_id", "page_no").agg(F.count_if(~F.col("is_blank") & (F.col("line_no") >= F.col("header_end"))).alias("n"))
    return held.where("n = 0").join(P.citable(s).select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi").select("doc_id", "page_no")
