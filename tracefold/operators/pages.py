"""Pages of a document: spans, anchors, coverage and offsets.

Input pages are (doc_id, page_no, text), page_no from 1. All windows are partitioned by document,
so that one exchange on doc_id serves spans, lines and chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import text as T

SCAN_THRESHOLD = 200
HISTOGRAM_EDGES = (50, 100, 200, 500, 1000, 2000, 4000)


def page_spans(pages: DataFrame, normalise: bool = True) -> DataFrame:
    """Each page with its ended text and half-open character span in the document's text, marks and anchor."""
    body = T.end_line(T.norm_text(F.col("text")) if normalise else F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    out = pages.select("doc_id", "page_no", body.alias("text"))
    out = out.withColumn("char_end", F.sum(F.length("text")).over(w)).withColumn("char_start", F.col("char_end") - F.length("text"))
    out = out.select("*", T.last_stamp(F.col("text")).alias("bates"), T.page_label(F.col("text")).alias("page_label"), T.is_cover(F.col("text")).alias("is_cover_sheet"))
    return out.select("*", T.scheme(F.col("bates"), F.col("page_label")).alias("anchor_scheme"), T.citation(F.col("bates"), F.col("page_label"), F.col("page_no")).alias("anchor_value"))


def citable(spans: DataFrame) -> DataFrame:
    return spans.where(~F.col("is_cover_sheet"))


def extract(pages: DataFrame, threshold: int = SCAN_THRESHOLD, normalise: bool = True) -> DataFrame:
    """One row a document: whole text, counts, whether it has a text layer, and the status."""
    spans = page_spans(pages, normalise)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "")
    docs = spans.groupBy("doc_id").agg(joined.alias("text"), F.count("*").alias("page_count"))
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).withColumns(text_layer(F.col("n_chars"), F.col("page_count"), threshold))


def text_layer(n_chars: Column, n_pages: Column, threshold: int = SCAN_THRESHOLD) -> dict[str, Column]:
    """Characters a page (0 without pages), whether that is a text layer, and the status."""
    cpp = F.coalesce(F.try_divide(n_chars.cast("double"), n_pages.cast("double")), F.lit(0.0))
    return {"chars_per_page": cpp, "has_text_layer": cpp >= threshold, "status": F.when(cpp >= threshold, "ok").otherwise("no_text_layer")}


def text_layers(pages: DataFrame, threshold: int = SCAN_THRESHOLD, normalise: bool = True) -> DataFrame:
    """As extract, without the text: nothing but lengths is shuffled."""
    body = T.end_line(T.norm_text(F.col("text")) if normalise else F.col("text"))
    docs = pages.select("doc_id", F.length(body).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_chars"), F.count("*").alias("page_count"))
    return docs.withColumns(text_layer(F.col("n_chars"), F.col("page_count"), threshold))


def span_violations(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Spans that don't tile their document of (doc_id, n_chars); texts without pages. No rows: all is well."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    s = spans.select("doc_id", "page_no", "char_start", "char_end", F.lag("char_end", 1, 0).over(w).alias("before"), F.lead("page_no").over(w).isNull().alias("last"))
    s = s.join(lengths.select("doc_id", "n_chars"), "doc_id", "full")
    problem = F.when(F.col("page_no").isNull() & (F.col("n_chars") > 0), "text without pages")
    problem = problem.when(F.col("char_start") != F.col("before"), "gap or overlap").when(F.col("char_end") < F.col("char_start"), "inverted")
    problem = problem.when(F.col("last") & (F.col("char_end") != F.col("n_chars")), "doesn't end with the text")
    return s.withColumn("problem", problem).where("problem IS NOT NULL").select("doc_id", "page_no", "char_start", "char_end", "problem")


def anchor_coverage(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Citable pages by anchor scheme, zeros kept."""
    counts = [F.count_if(~F.col("is_cover_sheet") & (F.col("anchor_scheme") == s)).alias(s) for s in T.SCHEMES]
    return spans.groupBy(key).agg(*counts)


def with_weak_total(coverage: DataFrame) -> DataFrame:
    """Coverage rows, each with the pages of all that have the weakest anchor."""
    return coverage.crossJoin(F.broadcast(coverage.agg(F.coalesce(F.sum("pdf_page"), F.lit(0)).alias("weak_total"))))


def resolve_offsets(offsets: DataFrame, spans: DataFrame, page_offset: Column | None = None) -> DataFrame:
    """The page, filing page and anchor of each (doc_id, offset); nulls outside the document."""
    s = spans.select(F.col("doc_id").alias("d"), "page_no", "char_start", "char_end", "anchor_scheme", "anchor_value")
    at = (F.col("doc_id") == F.col("d")) & (F.col("offset") >= F.col("char_start")) & (F.col("offset") < F.col("char_end"))
    out = offsets.join(s, at, "left").drop("d", "char_start", "char_end")
    return out.withColumn("filing_page", F.col("page_no") + (F.lit(0) if page_offset is None else page_offset))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Characters start to end, counted from 0."""
    return F.substring(text, start + 1, end - start)


def histogram(values: DataFrame, column: str, edges: tuple[int, ...] = HISTOGRAM_EDGES) -> DataFrame:
    """Values in [previous edge, edge), the last without an end, zeros kept, and a bar of at most 50 marks."""
    lows = (0, *edges)
    counts = [F.count_if((F.col(column) >= lo) & (F.lit(True) if hi is None else F.col(column) < hi)).alias(f"c{i}") for i, (lo, hi) in enumerate(zip(lows, (*edges, None)))]
    rows = F.array(*(F.struct(F.lit(lo).alias("low"), F.lit(hi).cast("int").alias("high"), F.col(f"c{i}").alias("n")) for i, (lo, hi) in enumerate(zip(lows, (*edges, None)))))
    return values.agg(*counts).select(F.inline(rows)).withColumn("bar", F.repeat(F.lit("#"), F.least(F.col("n"), F.lit(50)).cast("int")))


def probe_summary(documents: DataFrame) -> DataFrame:
    """Documents, pages, pages of documents with a text layer, and their share."""
    out = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"), F.coalesce(F.sum(F.when(F.col("has_text_layer"), F.col("page_count")).otherwise(0)), F.lit(0)).alias("digital_pages"))
    return out.withColumn("coverage", F.coalesce(F.try_divide(F.col("digital_pages") * 100.0, F.col("total_pages").cast("double")), F.lit(0.0)))


def lines_of(spans: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text, char_start, char_end, is_numeric, is_blank) of all pages, line_no from 0."""
    one = spans.select("doc_id", "page_no", F.col("char_start").alias("at"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    w = Window.partitionBy("doc_id", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("char_end", F.col("at") + F.sum(F.length("text") + 1).over(w) - 1).withColumn("char_start", F.col("char_end") - F.length("text"))
    return one.select("doc_id", "page_no", "line_no", "text", "char_start", "char_end", T.is_numeric(F.col("text")).alias("is_numeric"), T.is_blank(F.col("text")).alias("is_blank"))
