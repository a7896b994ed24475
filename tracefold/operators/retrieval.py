"""Retrieval and evaluation as designed: exact cosine top-k, span checks, ranking and refusal metrics.

The large training-scale search is a part of its own; this one is exact, for a given set of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: How far a product of whole blocks may be from the sum of one pair's products, which decides.
_ROUGH = 1e-9
#: Pairs whose sums are taken at once, and queries whose products with a batch of vectors are held at once.
_PAIRS, _ROWS = 1 << 16, 512


def _first(k: int, group: np.ndarray, sim: np.ndarray, vid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each group the k rows of the largest similarity, ties by id, in order, with their places from 0."""
    order = np.lexsort((vid, -sim, group))
    group, sim, vid = group[order], sim[order], vid[order]
    starts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if len(group) else np.zeros(0, np.int64)
    place = np.arange(len(group)) - np.repeat(starts, np.diff(starts, append=len(group)))
    keep = place < k
    return group[keep], sim[keep], vid[keep], place[keep]


class _Nearest:
    """The k nearest of all vectors seen so far to each query of a block; what is held doesn't grow with the vectors."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.k, self.ids, self.unit = k, ids[order], unit[order]
        self.sim, self.near = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def see(self, vid: np.ndarray, v: np.ndarray) -> None:
        for lo in range(0, len(self.ids), _ROWS):
            q, ids = self.unit[lo : lo + _ROWS], self.ids[lo : lo + _ROWS]
            rough = q @ v.T
            a, b = np.searchsorted(ids, vid, "left"), np.searchsorted(ids, vid, "right")
            for j in np.flatnonzero(b > a):
                rough[a[j] : b[j], j] = -np.inf  # itself
            least = self.sim[lo : lo + _ROWS, -1]
            if len(vid) > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(rough, len(vid) - self.k, axis=1)[:, len(vid) - self.k])
            row, col = np.nonzero((rough >= (least - _ROUGH)[:, None]) & (rough > -np.inf))
            if not len(row):
                continue
            sim = np.concatenate([(q[row[i : i + _PAIRS]] * v[col[i : i + _PAIRS]]).sum(axis=1) for i in range(0, len(row), _PAIRS)])
            hit = np.unique(row)
            old = np.repeat(hit, self.k)
            held = np.isfinite(self.sim[lo + hit]).ravel()
            row, sim, near, place = _first(self.k, np.concatenate([row, old[held]]), np.concatenate([sim, self.sim[lo + hit].ravel()[held]]), np.concatenate([vid[col], self.near[lo + hit].ravel()[held]]))
            self.sim[lo + row, place], self.near[lo + row, place] = sim, near

    def found(self) -> tuple[np.ndarray, ...]:
        ok = np.isfinite(self.sim)
        return np.repeat(self.ids, self.k).reshape(self.sim.shape)[ok], self.sim[ok], self.near[ok]


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray]]:
    """(whether they ask, size, ids, unit vectors) of the rows of a batch that are alike in both."""
    asks, ids, e = batch["asks"].to_numpy(zero_copy_only=False), batch["id"].to_numpy(), batch["e"]
    flat, ends = e.flatten().to_numpy().astype(np.float64), np.cumsum(pc.list_value_length(e).to_numpy())
    sizes = np.diff(ends, prepend=0)
    for ask in (True, False):
        for n in np.unique(sizes[asks == ask]):
            own = np.flatnonzero((asks == ask) & (sizes == n))
            x = flat[(ends[own] - n)[:, None] + np.arange(n)]
            yield ask, int(n), ids[own], x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest_of(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a block of queries and, after them, all vectors, the k nearest to each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        blocks: dict[int, _Nearest] | None = None
        for batch in batches:
            for ask, n, ids, x in _by_size(batch):
                if ask:
                    asked.setdefault(n, []).append((ids, x))
                    continue
                if blocks is None:
                    blocks = {m: _Nearest(*map(np.concatenate, zip(*of)), k) for m, of in asked.items()}
                    asked.clear()
                if n in blocks:
                    blocks[n].see(ids, x)
        if blocks:
            # Rows that ask under one id share its places.
            qid, sim, near, place = _first(k, *map(np.concatenate, zip(*(b.found() for b in blocks.values()))))
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(near), pa.array(sim), pa.array(place + 1, pa.int32())], names=["query_id", "vec_id", "similarity", "place"])

    return run


def topk_cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1 << 16) -> DataFrame:
    """The k vectors most like each query, itself left out; ties go to the smaller id.

    Exact: all vectors go by each block of queries, so the work grows with queries times vectors.
    A task holds one block, of at most about ``block`` queries, and a batch of vectors; results
    are k rows a query. There are about two blocks a core, so what is shuffled grows with the
    vectors alone as long as blocks are not full. Vectors of other lengths than the query's, and
    those without length or with null, NaN or infinite entries, are neither found nor ask.
    """
    usable = "NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(e, x -> x != 0)"
    kind = lambda d: "array<float>" if d.schema["embedding"].dataType.elementType.typeName() == "float" else "array<double>"
    same = kind(vectors) if kind(vectors) == kind(queries) else "array<double>"
    v, q = (d.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast(same).alias("e")).where("id IS NOT NULL AND e IS NOT NULL").where(usable) for d in (vectors, queries))
    asked = queries.count()
    blocks = max(1, -(-asked // block), min(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-asked // 256)))
    q = q.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), F.lit(True).alias("asks"), "id", "e")
    v = v.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(False).alias("asks"), "id", "e")
    rows = q.unionByName(v).repartitionById(blocks, F.col("b")).sortWithinPartitions(F.desc("asks"))
    return rows.select("asks", "id", "e").mapInArrow(_nearest_of(k), "query_id BIGINT, vec_id BIGINT, similarity DOUBLE, place INT")


def ranking_metrics(ranked: DataFrame, relevant: Column, k: int) -> DataFrame:
    """hit@k and mean reciprocal rank of (query_id, place) rows."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(relevant & (F.col("place") <= k), F.col("place"))).alias("first"))
    return first.agg(F.count("*").alias("queries"), F.count("first").alias("hits"), F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("hit_at_k"), F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"))


def refusal_rates(answers: DataFrame) -> DataFrame:
    """Of (answerable, refused): refusals of unanswerable questions, and false ones of answerable questions."""
    a, r = F.col("answerable"), F.col("refused")
    counts = answers.agg(F.count_if(~a).alias("unanswerable"), F.count_if(~a & r).alias("refused_rightly"), F.count_if(a).alias("answerable_n"), F.count_if(a & r).alias("refused_wrongly"))
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0))
    return counts.select("*", share("refused_rightly", "unanswerable").alias("refusal_rate"), share("refused_wrongly", "answerable_n").alias("false_refusal_rate"))


def latency_percentiles(events: DataFrame, value: str, *keys: str) -> DataFrame:
    """Discrete p50 and p95: values that occur."""
    exact = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return events.groupBy(*keys).agg(F.count(value).alias("n"), exact(0.5).alias("p50"), exact(0.95).alias("p95"))


def span_supported(claim: Column, source: Column, start: Column, end: Column) -> Column:
    """Whether the claim's words stand in its span, white space and case aside."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "))
    return F.contains(plain(F.substring(source, start + 1, end - start)), plain(claim))


#: A number as it stands in prose, with what scales it: words of size, letters of size, or a share in hundredths.
QUANTITY = r"(?i)\(?\$?-?(?:[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)\)?\s?(?:%|(?:percent|pct|billion|bn|b|million|mn|m|thousand|k)\b)?"
SCALES = (("billion|bn|b", 1e9), ("million|mn|m", 1e6), ("thousand|k", 1e3), ("percent|pct|%", 0.01))


def quantities(text: Column) -> Column:
    """The values of all numbers in a text: ``$1.2 billion``, ``1.2B`` and ``1,200,000,000`` are one value, as are ``10.4%``, ``10.4 percent`` and ``.104``."""

    def value(raw: Column) -> Column:
        size = F.regexp_extract(raw, r"([A-Za-z%]+)$", 1)
        scale = F.lit(1.0)
        for words, by in SCALES:
            scale = F.when(size.rlike(f"(?i)^({words})$"), F.lit(by)).otherwise(scale)
        negative = raw.contains("-") | (raw.contains("(") & raw.contains(")"))
        digits = F.regexp_replace(raw, "[^0-9.]", "").cast("double")
        return F.round(F.when(negative, -digits).otherwise(digits) * scale, 6)

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0)), value))


def untraceable(answer: Column, context: Column) -> Column:
    """The values of an answer that its cited context doesn't hold; null texts hold none."""
    none = F.array().cast("array<double>")
    return F.array_except(F.coalesce(quantities(answer), none), F.coalesce(quantities(context), none))


def span_similarity(claim: Column, span: Column) -> Column:
    """1 less the edit distance of both, white space and case aside, by the longer one; 1 for what stands in the span word for word."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "))
    a, b = plain(claim), plain(span)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(F.contains(b, a), 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(longer, F.lit(1)))


def refusal(similarity: Column, declined: Column, failed_share: Column, untraced: Column, least_similarity: float = 0.3, most_failed: float = 0.2) -> Column:
    """Why an answer is refused, null if it isn't: no context, the model's own word, claims that fail, a number without a source; the first that holds."""
    out = F.when(F.coalesce(similarity, F.lit(0.0)) < least_similarity, "no_relevant_context").when(declined, "model_declined")
    return out.when(failed_share > most_failed, "verification_failed").when(untraced > 0, "untraceable_numeric")


def numeric_accuracy(answers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Of (given, expected, cost): how many numbers are right within the tolerance, and the cost a query. A missing number is wrong."""
    right = F.coalesce(F.abs(F.col("given") - F.col("expected")) <= F.abs(F.col("expected")) * tolerance, F.lit(False))
    counts = answers.agg(F.count("*").alias("queries"), F.count_if(right).alias("right"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("queries").cast("double")), F.lit(0.0))
    return counts.select("queries", "right", share("right").alias("numeric_accuracy"), share("cost").alias("cost_per_query"))
