"""Manifests: what people have asserted on filings, sets and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOC_FIELDS = ("document_id", "page_offset", "description", "source_url")
SET_FIELDS = ("set_id", "status", "retrieval_eligible", "selection_note")
KEPT_SET_FIELDS = SET_FIELDS[1:]
KEPT_DOC_FIELDS = ("page_offset", "description")


def _field(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name.split(".")[-1] in df.select(name.rpartition(".")[0] + ".*" if "." in name else "*").columns else None


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last in order; the columns of order go."""
    kept = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_r")).select(key, "_r.*")


def _exploded(items: DataFrame, outer: bool) -> DataFrame:
    """Items by set (s) and document (d), with their places."""
    e = F.posexplode_outer if outer else F.posexplode
    i = items if "_i" in items.columns else items.withColumn("_i", F.lit(0))
    return i.select("*", F.posexplode("sets").alias("_s", "s")).select("*", e("s.documents").alias("_d", "d"))


def flatten(items: DataFrame) -> DataFrame:
    """One row for each file name of nested items: what its document says itself, else its set, else its item. Nulls never override;
    of several entries of a name the last counts, by the items' place ``_i`` if they have one."""
    d = _exploded(items, False).where("d.filename IS NOT NULL")
    at = lambda *levels: [c for c in (_field(d, x) for x in levels) if c is not None]
    names = ["control_number", "item_number", "filing_date", "filing_party", "filing_description", "item_type", *SET_FIELDS, *DOC_FIELDS]
    cols = [F.coalesce(*own).alias(n) for n in names if (own := at(f"d.{n}", f"s.{n}", n))]
    return last_wins(d.select(F.col("d.filename").alias("filename"), *cols, "_i", "_s", "_d"), "filename", "_i", "_s", "_d")


def prior_sets(items: DataFrame) -> DataFrame:
    """What people have said of each set, also of sets without documents; the last entry counts."""
    d = _exploded(items, True).where("s.set_id IS NOT NULL")
    return last_wins(d.select("s.set_id", *(F.col(f"s.{f}").alias(f) for f in KEPT_SET_FIELDS), "_i", "_s"), "set_id", "_i", "_s")


def prior_documents(items: DataFrame) -> DataFrame:
    """What people have said of each file itself, not of its set or item; the last entry counts."""
    d = _exploded(items, False).where("d.filename IS NOT NULL")
    cols = [(F.col(f"d.{f}") if _field(d, f"d.{f}") is not None else F.lit(None).cast("string")).alias(f) for f in KEPT_DOC_FIELDS]
    return last_wins(d.select("d.filename", *cols, "_i", "_s", "_d"), "filename", "_i", "_s", "_d")


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed files with what the manifest says of them; the page offset is 0 and retrieval off unless asserted."""
    j = files.join(manifest, "filename", "left")
    return j.withColumn("page_offset", F.coalesce("page_offset", F.lit(0))).withColumn("retrieval_eligible", F.coalesce("retrieval_eligible", F.lit(False)))


def carry_over(fresh: DataFrame, prior: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Fresh rows, with earlier assertions put back wherever there are any."""
    old = prior.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    j = fresh.join(old, key, "left")
    return j.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in fresh.columns), F.coalesce(*(F.col(f"_{f}").cast("string") for f in fields)).isNotNull().alias("carried"))


def counts(items: DataFrame, carried: DataFrame) -> DataFrame:
    """Items, sets, documents, items that await a set, sets of several parts, and rows of carry_over on which something was carried."""
    n = F.coalesce(F.size("sets"), F.lit(0))
    docs = F.aggregate("sets", F.lit(0), lambda a, s: a + F.size(s["documents"]))
    multi = F.size(F.filter("sets", lambda s: F.size(s["documents"]) > 1))
    return items.agg(F.count("*").alias("items"), F.sum(n).alias("sets"), F.sum(docs).alias("documents"), F.count_if(n == 0).alias("awaiting"), F.sum(multi).alias("multipart")).crossJoin(carried.agg(F.count_if("carried").alias("carried")))
