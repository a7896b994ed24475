"""Served file names, page ranges and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SERVED = r"(?i)^([0-9]+)_([0-9]+)_([0-9]+)\.pdf$"
RANGE = r"(?i)pages?\s+([0-9]+)\s*(?:–|-|to)\s*([0-9]+)"


def parse_filename(path: Column) -> Column:
    """A struct of control number, item number and document id, all null if the name has another form."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    ok = base.rlike(SERVED)
    part = lambda i: F.when(ok, F.regexp_extract(base, SERVED, i))
    return F.struct(part(1).alias("control_number"), part(2).cast("int").alias("item_number"), part(3).alias("document_id"))


def page_range(description: Column) -> Column:
    """(first, last) that a description claims, nulls without a claim. For reports only, never for offsets."""
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(description, RANGE, i), F.lit("")), F.lit("999999999")).cast("int")
    return F.struct(part(1).alias("first_page"), part(2).alias("last_page"))


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)
