"""Layout-aware chunks: prose packed by lines, tables by rows under their page's header.

A page with short lines is a table. Its header ends at the first label that three numeric
lines follow; from there on a label owns the numeric lines after it, and rows are never
split. Packing is greedy and so sequential within a page; it runs as a loop over the page's
own units, in parallel over documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.operators.by_set import each_key

CHARS_PER_LINE = 15.0
NUMERIC_RUN = 3
MAX_HEADER_LINES = 30
TARGET_CHARS = 1200
MAX_CHARS = 2000
_PAGE = ("doc_id", "page_no")


def page_kinds(lines: DataFrame, threshold: float = CHARS_PER_LINE) -> DataFrame:
    """(doc_id, page_no, kind): prose if lines that aren't blank have enough characters on average, or if all are blank."""
    mean = F.avg(F.when(~F.col("is_blank"), F.length("text")))
    return lines.groupBy(*_PAGE).agg(F.when(F.coalesce(mean, F.lit(threshold)) >= threshold, "prose").otherwise("table").alias("kind"))


def with_kind(lines: DataFrame, threshold: float = CHARS_PER_LINE) -> DataFrame:
    mean = F.avg(F.when(~F.col("is_blank"), F.length("text"))).over(Window.partitionBy(*_PAGE))
    return lines.withColumn("kind", F.when(F.coalesce(mean, F.lit(threshold)) >= threshold, "prose").otherwise("table"))


def with_header(lines: DataFrame) -> DataFrame:
    """Adds header_end, the number of lines before the page's first data row."""
    content = Window.partitionBy(*_PAGE, "is_blank").orderBy("line_no")
    ahead = [F.coalesce(F.lead("is_numeric", i).over(content), F.lit(False)) for i in range(1, NUMERIC_RUN + 1)]
    opens = ~F.col("is_blank") & ~F.col("is_numeric")
    for a in ahead:
        opens = opens & a
    page = Window.partitionBy(*_PAGE)
    first = F.min(F.when(F.col("opens"), F.col("line_no"))).over(page)
    out = lines.withColumn("opens", opens)
    return out.withColumn("header_end", F.coalesce(first, F.least(F.count("*").over(page), F.lit(MAX_HEADER_LINES))).cast("int")).drop("opens")


def table_rows(lines: DataFrame) -> DataFrame:
    """The lines below the header that aren't blank, each with its row, from 1."""
    body = with_header(lines).where((F.col("line_no") >= F.col("header_end")) & ~F.col("is_blank"))
    w = Window.partitionBy(*_PAGE).orderBy("line_no")
    starts = ~F.col("is_numeric") | (F.row_number().over(w) == 1)
    return body.withColumn("starts", starts.cast("int")).withColumn("row_no", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("starts")


def packed(sizes: Iterable[tuple[int, bool]], prose: bool) -> list[int]:
    """The batch of each unit of (size, blank) in order."""
    out, batch, held, size, most = [], 0, 0, 0, MAX_CHARS if prose else TARGET_CHARS
    for n, blank in sizes:
        if held and size + n > most:
            batch, held, size = batch + 1, 0, 0
        held, size = held + 1, size + n
        out.append(batch)
        if prose and blank and size >= TARGET_CHARS:
            batch, held, size = batch + 1, 0, 0
    return out


_NUMERIC = re.compile(T.NUMERIC_LINE)
_SHORT = 24


def _line(line: str) -> tuple[str, bool]:
    """A line stripped, and whether it holds nothing but signs of numbers."""
    bare = line.strip(T.WHITE)
    return bare, bare != "" and _NUMERIC.fullmatch(bare) is not None


_short_line = lru_cache(maxsize=1 << 16)(_line)


def page_chunks(text: str, start: int) -> Iterator[tuple]:
    """(kind, context, body, char_start, char_end, context_char_start, context_char_end) of each chunk of a page that begins at ``start``."""
    lines, at = [], start
    for line in text.split("\n"):
        n = len(line)
        lines.append((at, n, *(_short_line(line) if n <= _SHORT else _line(line))))
        at += n + 1
    content = [(i, x) for i, x in enumerate(lines) if x[2]]
    if not content:
        return
    prose = sum(x[1] for _, x in content) / len(content) >= CHARS_PER_LINE
    context, first, last, units = "", None, None, lines
    if prose:
        of = packed(((n, not bare) for _, n, bare, _ in lines), True)
    else:
        run, opens = 0, min(len(lines), MAX_HEADER_LINES)
        for i, x in reversed(content):
            if x[3]:
                run += 1
            else:
                if run >= NUMERIC_RUN:
                    opens = i
                run = 0
        heads, units = [x for i, x in content if i < opens], [x for i, x in content if i >= opens]
        if heads:
            context, first, last = "\n".join(x[2] for x in heads) + "\n\n", heads[0][0], heads[-1][0] + heads[-1][1]
        rows, row_of = [], []
        for x in units:
            if not rows or not x[3]:
                rows.append(0)
            rows[-1] += x[1]
            row_of.append(len(rows) - 1)
        batches = packed(((n, False) for n in rows), False)
        of = [batches[r] for r in row_of]
    for _, mine in groupby(zip(of, units), lambda x: x[0]):
        held = [x for _, x in mine if x[2]]
        if held:
            yield "prose" if prose else "table", context, "\n".join(x[2] for x in held), held[0][0], held[-1][0] + held[-1][1], first, last


COLUMNS = {"doc_id": "BIGINT", "ordinal": "INT", "page_start": "INT", "page_end": "INT", "kind": "STRING", "text": "STRING", "char_start": "BIGINT", "char_end": "BIGINT", "context": "STRING", "context_char_start": "BIGINT", "context_char_end": "BIGINT", "anchor_scheme": "STRING", "anchor_value": "STRING"}


def chunks(spans: DataFrame, columns: Iterable[str] = tuple(COLUMNS), kind: str | None = None) -> DataFrame:
    """All chunks of citable pages with their spans, context and anchor, or those of one kind; ordinals run through the document from 0 over both. ``n_chars`` is the length of the text.

    A document's pages come one after the other and each is cut in one pass; lines are no rows, and only the columns asked for are made.
    """
    columns, kinds = tuple(columns), COLUMNS | {"n_chars": "INT"}
    at = [tuple(kinds).index(c) for c in columns]

    def run(doc_id, pages):
        ordinal = -1
        for page_no, text, start, scheme, value in sorted(pages, key=lambda p: p[0]):
            if text is None:
                continue
            for a, context, body, *span in page_chunks(text, start):
                ordinal += 1
                if kind is None or a == kind:
                    whole = context + body
                    row = (doc_id, ordinal, page_no, page_no, a, whole, span[0], span[1], context, span[2], span[3], scheme, value, len(whole))
                    yield tuple(row[i] for i in at)

    pages = spans.where(~F.col("is_cover_sheet")).select("doc_id", "page_no", "text", "char_start", "anchor_scheme", "anchor_value")
    return each_key(pages.sortWithinPartitions("doc_id", "page_no"), run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def chunk_body(text: Column, context: Column) -> Column:
    return F.substring(text, F.length(context) + 1, F.length(text))


def chunk_spans(c: DataFrame) -> DataFrame:
    """All document ranges a chunk's text comes from: its context, if it has one, and its body."""
    span = lambda a, b: F.struct(F.col(a).alias("s"), F.col(b).alias("e"))
    both = F.filter(F.array(span("context_char_start", "context_char_end"), span("char_start", "char_end")), lambda x: x["s"].isNotNull())
    return c.select("doc_id", "ordinal", F.posexplode(both).alias("span_no", "x")).select("doc_id", "ordinal", "span_no", F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"))


def chunk_violations(c: DataFrame, documents: DataFrame, check_context: bool = False) -> DataFrame:
    """Chunks whose spans lie outside of the document or whose body isn't what their span holds."""
    d = documents.select("doc_id", F.col("text").alias("document"))
    j = c.join(d, "doc_id")
    n = F.length("document")
    bad = lambda a, b: F.col(a).isNotNull() & ~((F.col(a) >= 0) & (F.col(a) < F.col(b)) & (F.col(b) <= n))
    shown = lambda a, b: T.rendered(F.split(F.substring(F.col("document"), F.col(a) + 1, F.col(b) - F.col(a)), "\n"))
    problem = F.when(bad("char_start", "char_end") | bad("context_char_start", "context_char_end"), "span outside of the document")
    problem = problem.when(shown("char_start", "char_end") != T.strip(chunk_body(F.col("text"), F.col("context"))), "body differs from its span")
    if check_context:
        problem = problem.when(F.col("context_char_start").isNotNull() & (shown("context_char_start", "context_char_end") != T.strip(F.col("context"))), "context differs from its span")
    return j.withColumn("problem", problem).where("problem IS NOT NULL").select("doc_id", "ordinal", "problem")


def summarize(c: DataFrame) -> DataFrame:
    """Chunks by kind, upper median and largest size, and how many have the weakest anchor, of (kind, n_chars, anchor_scheme).

    The element at n div 2 of all sizes in order is found from counts by size, so nothing is collected in one place and chunks are made once.
    """
    counts = {"k": F.count("*"), "table": F.count_if(F.col("kind") == "table"), "prose": F.count_if(F.col("kind") == "prose"), "weak": F.count_if(F.col("anchor_scheme") == "pdf_page")}
    sizes = c.groupBy("n_chars").agg(*(v.alias(k) for k, v in counts.items()))
    # One row for each size that occurs.
    run = sizes.withColumn("upto", F.sum("k").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("k").over(Window.partitionBy()))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n_chars")))
    some = lambda x: F.coalesce(x, F.lit(0))
    return run.agg(some(F.sum("k")).alias("chunks"), some(F.sum("table")).alias("table"), some(F.sum("prose")).alias("prose"), some(F.sum("weak")).alias("weakly_anchored"), some(middle).alias("median_chars"), some(F.max("n_chars")).alias("max_chars"))
