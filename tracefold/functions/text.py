"""Words, lines, normal form and page marks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

#: All that is white space in any script, information separators and next line included.
WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMERIC_LINE = rf"^[-0-9%.,()${WHITE}]*$"
#: Texts of nothing but signs that compatibility composition leaves alone, and soft hyphens.
PLAIN = r"^[\x00-\x7f\xad\xc0-\xff]*$"
STAMP = r"\b(0000{1,3}[0-9]{1,4})\b"
LABEL = r"(?i)\bpage\s+([0-9]+)\s+of\s+([0-9]+)\b"
COVER_MARKS = ("Addendum StartPage", "Control Number:", "Item Number:")
SCHEMES = ("bates", "page_label", "pdf_page")


@lru_cache(maxsize=1)
def _nfkc():
    """Made on first use, as it needs a running session."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(run, "string", PandasUDFType.SCALAR_ITER)


def norm_text(text: Column) -> Column:
    """Compatibility composition, no soft hyphens, line feeds only. What is ASCII, or Latin-1 letters of its own, needs no look at the tables of composition."""
    composed = F.when(text.rlike(PLAIN), text).otherwise(_nfkc()(F.when(~text.rlike(PLAIN), text)))
    return F.regexp_replace(F.replace(composed, F.lit("­"), F.lit("")), "\r\n?", "\n")


def end_line(text: Column) -> Column:
    """A page's text, ended by a line feed."""
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def word_types(text: Column) -> Column:
    """The distinct lower-cased runs of three or more Latin letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))


def strip(text: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.trim(text, F.lit(WHITE))


def is_blank(line: Column) -> Column:
    return strip(line) == ""


def is_numeric(line: Column) -> Column:
    return ~is_blank(line) & line.rlike(NUMERIC_LINE)


def last_stamp(text: Column) -> Column:
    """The last zero-led stamp on a page, null without one."""
    found = F.regexp_extract_all(text, F.lit(STAMP), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def page_label(text: Column) -> Column:
    """The first "Page n of m" of a page as "n of m", null without one."""
    n = F.regexp_extract(text, LABEL, 1)
    return F.when(n != "", F.concat(n, F.lit(" of "), F.regexp_extract(text, LABEL, 2)))


def is_cover(text: Column) -> Column:
    """A page with at least two of the three marks of a cover sheet."""
    return sum((text.contains(m).cast("int") for m in COVER_MARKS), F.lit(0)) >= 2


def scheme(bates: Column, label: Column) -> Column:
    return F.when(bates.isNotNull(), "bates").when(label.isNotNull(), "page_label").otherwise("pdf_page")


def citation(bates: Column, label: Column, page_no: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Bates "), bates), F.concat(F.lit("p. "), label), F.concat(F.lit("PDF page "), page_no.cast("string")))


def rendered(lines: Column) -> Column:
    """Stripped lines that aren't blank, on lines of their own."""
    return F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n")
