"""Multi-part filings: parts whose ids run close together are one set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = 32
_ITEM = ("control_number", "item_number")


def document_sets(refs: DataFrame, gap: int = GAP) -> DataFrame:
    """Adds set_id, part_ordinal (from 0) and n_parts; a new set starts where an id is more than gap above the one before."""
    number = F.col("document_id").cast("bigint")
    w = Window.partitionBy(*_ITEM).orderBy(number)
    out = refs.withColumn("_new", F.coalesce((number - F.lag(number).over(w) > gap).cast("int"), F.lit(0)))
    out = out.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    many = F.max("_run").over(Window.partitionBy(*_ITEM)) > 0
    name = F.concat(F.col("control_number"), F.lit("_"), F.col("item_number").cast("string"), F.when(many, F.concat(F.lit("_"), F.char(F.col("_run") + 97))).otherwise(""))
    part = Window.partitionBy(*_ITEM, "_run")
    out = out.withColumn("set_id", name).withColumn("part_ordinal", F.row_number().over(part.orderBy(number)) - 1).withColumn("n_parts", F.count("*").over(part).cast("int"))
    return out.drop("_new", "_run")


def set_labels(sets: DataFrame) -> DataFrame:
    """(set_id, label, parts): the file's name, or the first and last id of a set of several."""
    ordered = F.array_sort(F.collect_list(F.struct("part_ordinal", "filename", "document_id")))
    g = sets.groupBy("set_id", *_ITEM).agg(ordered.alias("p"))
    span = F.concat(F.col("control_number"), F.lit("_"), F.col("item_number").cast("string"), F.lit(" ["), F.col("p")[0]["document_id"], F.lit(".."), F.element_at("p", -1)["document_id"], F.lit("]"))
    return g.select("set_id", F.when(F.size("p") == 1, F.col("p")[0]["filename"]).otherwise(span).alias("label"), F.size("p").alias("n_parts"), F.col("p")[0]["filename"].alias("first_part"))


def join_verdicts(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each set with the verdict that was measured under its first part, if any."""
    return labels.join(verdicts.withColumnRenamed("document", "first_part"), "first_part", "left")


def pair_natives(listing: DataFrame, items: DataFrame) -> DataFrame:
    """Native files of each item by its key in the file's name or in a folder's, best format first.

    The key is taken out of the path, so that files and items meet in an equi-join.
    """
    path = F.col("path")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    inside, whole = r"(?<![0-9])(?=([0-9]+_[0-9]+)_)", r"(?:^|/)(?=([0-9]+_[0-9]+)(?:/|$))"
    found = lambda of, pattern: F.regexp_extract_all(of, F.lit(pattern), F.lit(1))
    keys = F.array_distinct(F.concat(found(name, inside), found(folder, inside), found(folder, whole)))
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    rank = F.coalesce(*(F.when(F.col("suffix") == s, i) for i, s in enumerate(("docx", "pdf", "xlsx", "xlsm"))))
    files = listing.select(path, name.alias("name"), suffix.alias("suffix"), F.explode(keys).alias("key")).where(~F.col("name").startswith("~$")).withColumn("rank", rank).where("rank IS NOT NULL")
    j = items.select(*_ITEM, F.concat("control_number", F.lit("_"), F.col("item_number").cast("string")).alias("key")).join(files, "key").drop("key").distinct()
    w = Window.partitionBy(*_ITEM).orderBy("rank", "name", "path")
    return j.select(*_ITEM, "path", F.row_number().over(w).alias("place")).withColumn("is_primary", F.col("place") == 1)
