"""Idempotent ingest into snapshots of parquet tables, and the invariants they must hold.

An upsert is a full join of the stored rows with the new ones; the result is written as a
new snapshot, and a numbered commit file is added at the end, so that readers see all of it or none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("operative", "superseded", "undetermined")


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...], keep: tuple[str, ...] = (), frozen: tuple[str, ...] = (), defaults: dict | None = None) -> DataFrame:
    """Rows of both by key, new over stored; the columns and order of stored.

    keep: a null in the new row keeps what is stored. frozen: set on insert only. defaults: for nulls, on insert only.
    """
    defaults = defaults or {}
    a, b = stored.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    j = a.join(b, list(keys), "full")
    cols = []
    for c in stored.columns:
        if c in keys:
            cols.append(F.col(c))
            continue
        if c not in new.columns:
            first = F.lit(defaults.get(c))
            cols.append(F.when(F.col("_old"), F.col(f"a.{c}")).otherwise(first).alias(c))
            continue
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        insert = F.coalesce(y, F.lit(defaults[c])) if c in defaults else y
        update = x if c in frozen else F.coalesce(y, x) if c in keep else y
        cols.append(F.when(F.col("_old").isNull(), insert).when(F.col("_new").isNull(), x).otherwise(update).alias(c))
    return j.select(*cols)


def change_actions(stored: DataFrame, new: DataFrame, keys: tuple[str, ...], digest: str = "sha256") -> DataFrame:
    """New rows with their action: insert, reextract where the digest differs, unchanged. Only keys and digests of the stored side are read."""
    old = stored.select(*keys, F.col(digest).alias("_digest"), F.lit(True).alias("_there"))
    j = new.join(old, list(keys), "left")
    return j.withColumn("action", F.when(F.col("_there").isNull(), "insert").when(F.col("_digest").eqNullSafe(F.col(digest)), "unchanged").otherwise("reextract")).drop("_digest", "_there")


def ingest_counts(filings: DataFrame, sets: DataFrame, actions: DataFrame, anchors: DataFrame) -> DataFrame:
    """What an ingest writes, as one row; computing it without writing is the dry run."""
    n = lambda d, c: d.agg(F.count("*").alias(c))
    acts = actions.agg(F.count("*").alias("documents"), F.count_if(F.col("action") != "unchanged").alias("reextracted"), F.count_if(F.col("action") == "unchanged").alias("unchanged"))
    return n(filings, "filings").crossJoin(n(sets, "sets")).crossJoin(acts).crossJoin(n(anchors, "anchors"))


def replace_by_key(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows of other keys, and the new rows."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def ingest(stored: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after an ingest, from those stored and new: dockets, documents (doc_id, source_url, sha256), texts and anchors (doc_id, ...).

    Dockets are inserted and never updated. A document keeps its first ``source_url``; ``changed`` tells the new ones and
    those of another digest, and texts and anchors are replaced for these alone. ``SnapshotStore.commit`` writes the result; ``dry_run`` counts it.
    """
    plain = [c for c in new["dockets"].columns if c != "docket"]
    acts = change_actions(stored["documents"], new["documents"], ("doc_id",)).select("doc_id", (F.col("action") != "unchanged").alias("changed"))
    changed = acts.where("changed").select("doc_id")
    documents = upsert(stored["documents"], new["documents"], ("doc_id",), frozen=("source_url",)).join(acts, "doc_id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    fresh = lambda t: new[t].join(changed, "doc_id", "left_semi")
    # A changed document loses its old rows also where it has no new ones.
    kept = lambda t: stored[t].join(changed, "doc_id", "left_anti")
    return {"dockets": upsert(stored["dockets"], new["dockets"], ("docket",), frozen=tuple(plain)), "documents": documents, **{t: kept(t).unionByName(fresh(t)) for t in ("texts", "anchors")}}


def dry_run(tables: dict[str, DataFrame]) -> DataFrame:
    """The counts of an ingest's tables, which are not written."""
    return tables["documents"].agg(F.count("*").alias("documents"), F.count_if("changed").alias("reextracted"), F.count_if(~F.col("changed")).alias("unchanged")).withColumn("texts", F.col("reextracted"))


def policy_violations(sets: DataFrame) -> DataFrame:
    """Sets of unknown status, and undetermined sets that can be retrieved."""
    problem = F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status").when((F.col("status") == "undetermined") & F.col("retrieval_eligible"), "undetermined but retrievable")
    return sets.withColumn("problem", problem).where("problem IS NOT NULL").select("set_id", "problem")


def duplicate_content(documents: DataFrame, digest: str = "sha256") -> DataFrame:
    """Digests that several documents share."""
    return documents.groupBy(digest).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key the parent lacks."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


class SnapshotStore:
    """Named parquet tables under a root; a commit is seen whole once its file is there."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _hadoop(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> int:
        """The number of the last commit, 0 before the first."""
        fs = self._hadoop()
        found = fs.globStatus(self._path("commits/*.json")) or []
        return max((int(f.getPath().getName().split(".")[0]) for f in found), default=0)

    def pointers(self) -> dict[str, str]:
        n = self._latest()
        if not n:
            return {}
        stream = self._hadoop().open(self._path(f"commits/{n:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame | None:
        at = self.pointers().get(name)
        return self.spark.read.parquet(f"{self.root}/{at}") if at else None

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Writes all tables aside, then names them in one new commit; a commit made by others meanwhile raises.

        Of two writers at the same moment one is refused on file systems whose rename doesn't overwrite, as that of HDFS.
        """
        n, new = self._latest(), self.pointers()
        for name, df in tables.items():
            at = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{at}")
            new[name] = at
        fs = self._hadoop()
        fs.mkdirs(self._path("commits"))
        aside, target = self._path(f"commits/{uuid.uuid4().hex}.tmp"), self._path(f"commits/{n + 1:012d}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            raise RuntimeError(f"commit {n + 1} of {self.root} was made by another writer")
