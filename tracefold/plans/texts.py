"""Queries on running text: numbers, words, furniture, names and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import names, numbers as N, text as T
from tracefold.operators import fidelity
from tracefold.plans import inputs as I
from tracefold.plans import query
from tracefold.sources.files import table

_ID = "kind, id"


@query(f"WITH {I.TEXTS_SQL},\n{I.bag_sql('texts', _ID, 'bag')}\nSELECT kind, id, token, n FROM bag")
def num_counter(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the bag of canonical numbers of every text."""
    return fidelity.bag(I.texts(spark, sf), "kind", "id")


_RAW = f"WITH {I.TEXTS_SQL},\nfound AS (SELECT kind, id, unnest(regexp_extract_all({I.bare_sql('text')}, '{I.TOKEN}')) AS raw FROM texts)"


@query(f"{_RAW}\nSELECT kind, id, raw, count(*) AS n FROM found GROUP BY ALL")
def num_tokens(spark: SparkSession, sf: str) -> DataFrame:
    raw = I.texts(spark, sf).select("kind", "id", F.explode(N.raw_tokens(N.strip_furniture(F.col("text")))).alias("raw"))
    return raw.groupBy("kind", "id", "raw").agg(F.count("*").alias("n"))


@query(f"{_RAW},\nforms AS (SELECT DISTINCT raw FROM found),\n{I.canonical_sql('forms', 'raw AS r', 'canon').replace('raw AS r, raw,', 'raw,').replace('SELECT raw AS r, CASE', 'SELECT raw, CASE')}\nSELECT raw, token FROM canon")
def num_canon(spark: SparkSession, sf: str) -> DataFrame:
    raw = I.texts(spark, sf).select(F.explode(N.raw_tokens(N.strip_furniture(F.col("text")))).alias("raw")).distinct()
    return N.with_canonical(raw.withColumn("form", F.col("raw")), "form", "token").select("raw", "token")


@query(f"WITH {I.TEXTS_SQL} SELECT kind, id, {I.bare_sql('text')} AS bare, length(text) - length({I.bare_sql('text')}) AS n_removed FROM texts")
def furniture(spark: SparkSession, sf: str) -> DataFrame:
    bare = N.strip_furniture(F.col("text"))
    return I.texts(spark, sf).select("kind", "id", bare.alias("bare"), (F.length("text") - F.length(bare)).cast("bigint").alias("n_removed"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS n_types, list_aggregate(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))), 'string_agg', ' ') AS types FROM documents")
def word_types(spark: SparkSession, sf: str) -> DataFrame:
    w = T.word_types(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("bigint").alias("n_types"), F.when(F.size(w) > 0, F.array_join(F.array_sort(w), " ")).alias("types"))


@query()
def norm_text(spark: SparkSession, sf: str) -> DataFrame:
    """Compatibility composition has no SQL; the tests compare it with the library's own."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.norm_text(F.col("text")).alias("text"))


_HASH = "WITH hashed AS (SELECT doc_id, sha256(text) AS sha256, length(text) AS n FROM documents)"


@query(f"{_HASH} SELECT doc_id, sha256, n FROM hashed")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", names.content_hash(F.col("text")).alias("sha256"), F.length("text").cast("bigint").alias("n"))


@query("SELECT item_id, d.k AS doc_id, len(list_intersect(i.w, d.w)) AS common, len(i.w) AS item_words, CASE WHEN len(i.w) > 0 THEN len(list_intersect(i.w, d.w)) / CAST(len(i.w) AS DOUBLE) * 100.0 ELSE 100.0 END AS word_accuracy FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark) i JOIN (SELECT doc_id AS k, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) d ON d.k = item_id")
def word_compare_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Word types of each benchmark item against the document of the same number."""
    a = table(spark, sf, "benchmark").select(F.col("item_id").alias("set_id"), "text")
    b = table(spark, sf, "documents").select(F.col("doc_id").alias("set_id"), "text")
    j = fidelity.compare_words(a, b)
    return j.select(F.col("set_id").alias("item_id"), F.col("set_id").alias("doc_id"), F.col("common").cast("bigint").alias("common"), F.col("native_words").cast("bigint").alias("item_words"), "word_accuracy")
