"""Which filings enter the corpus, and the report on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions import triage as R


def triage(filings: DataFrame, item_type: str = "item_type", description: str = "description", party: str = "party") -> DataFrame:
    """Adds include, reason and matched_rule.

    The verdict comes out of a generator, as filters on it are not pushed beneath one: they would take the normalised description apart and make it anew for each rule.
    """
    normal = filings.withColumn("_t", R.normalize_description(F.col(description)))
    judged = normal.withColumn("_v", F.explode(F.array(R.evaluate(F.col(item_type), F.col("_t"), F.col(party)))))
    return judged.select(*filings.columns, "_v.include", "_v.reason", "_v.matched_rule")


def summarize(judged: DataFrame) -> DataFrame:
    """(outcome, n, share): included and every reason, zeros kept; share in per cent, 0 without filings."""
    domain = ("included", *R.REASONS)
    counts = judged.agg(F.count("*").alias("all"), *(F.count_if(F.col("include") if d == "included" else F.col("reason") == d).alias(d) for d in domain))
    rows = F.array(*(F.struct(F.lit(d).alias("outcome"), F.col(d).alias("n")) for d in domain))
    return counts.select("all", F.inline(rows)).select("outcome", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("all")), F.lit(0.0)).alias("share"))


def curated(judged: DataFrame, chosen: DataFrame, key: str = "item_number") -> DataFrame:
    """The chosen filings, with a warning where triage would drop them."""
    j = judged.join(chosen.select(key), key, "left_semi")
    return j.withColumn("would_drop", ~F.col("include"))


def absent(judged: DataFrame, chosen: DataFrame, key: str = "item_number") -> DataFrame:
    return chosen.join(judged.select(key), key, "left_anti")


def stray(downloaded: DataFrame, chosen: DataFrame, key: str = "item_number") -> DataFrame:
    return downloaded.select(key).distinct().join(chosen.select(key), key, "left_anti")
