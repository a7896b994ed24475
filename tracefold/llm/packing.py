"""Best-fit packing into sequences of several permitted lengths.

Documents are token runs; one longer than the largest permitted length is cut into full
pieces of that length and a rest. Documents are spread over groups of about ``group_docs``
by a hash of their id, and each group is packed on its own, longest piece first:

* a piece goes to the open bin with the least room that still holds it;
* if none does, a bin is opened, of the permitted length with the least expected cost a
  token. The expectation fills the rest of the new bin with the pieces still to come that
  fit it, as far as they go. A bin of length c costs ``bin_cost + c + quadratic * c^2``;
* at the end every bin is downsized to the least permitted length that holds its contents.

Tokens are counted as alphanumeric runs cut every ``piece_chars`` characters plus single
other signs, on the JVM, or taken from ``length_col``.

Edge cases: null and empty texts have no tokens and are not packed; null ids are packed as
one more document; rows that repeat are packed each; ties are broken by id, then piece; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm._text import table

CAPACITIES = (256, 512, 1024, 2048, 4096)
SCHEMA = "bin_id STRING, capacity INT, used INT, doc_id BIGINT, piece INT, token_start BIGINT, n_tokens INT, bin_start INT"


def token_count(text, piece_chars: int = 6):
    """A stand-in for subword counts: words in pieces of ``piece_chars``, and each other sign."""
    return F.regexp_count(text, F.lit(rf"[\p{{L}}\p{{N}}]{{1,{piece_chars}}}|[^\p{{L}}\p{{N}}\s]"))


class OpenBins:
    """Bins by room left; the least room that holds a piece is found by bit tricks."""

    def __init__(self) -> None:
        self.rooms: dict[int, list[int]] = {}
        self.mask = 0

    def add(self, room: int, index: int) -> None:
        self.rooms.setdefault(room, []).append(index)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest fit, the latest bin of equals."""
        m = self.mask >> size
        if not m:
            return None
        room = size + (m & -m).bit_length() - 1
        index = self.rooms[room].pop()
        if not self.rooms[room]:
            self.mask ^= 1 << room
        return room, index


def pack(sizes: np.ndarray, capacities: tuple[int, ...], bin_cost: float, quadratic: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, start in bin) of each piece, and capacity and contents of each bin; sizes fall."""
    caps = sorted(capacities)
    cost = [bin_cost + c + quadratic * c * c for c in caps]
    which, start = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    # The pieces of at most r tokens are a tail of the sizes; after[i] is the mass from i on.
    after = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0]]).tolist()
    rising, rooms = (-sizes).tolist(), OpenBins()
    cap: list[int] = []
    used: list[int] = []
    for i, size in enumerate(sizes.tolist()):
        got = rooms.take(size)
        if got is None:
            best, c = None, caps[-1]
            for x, price in zip(caps, cost):
                if x >= size:
                    rest = x - size
                    tail = after[max(i + 1, bisect.bisect_left(rising, -rest))] if rest else 0
                    rate = price / (size + min(rest, tail))
                    if best is None or rate < best:
                        best, c = rate, x
            room, b = c, len(cap)
            cap.append(c)
            used.append(0)
        else:
            room, b = got
        which[i], start[i] = b, used[b]
        used[b] += size
        if room > size:
            rooms.add(room - size, b)
    small = [caps[bisect.bisect_left(caps, u)] for u in used]
    return which, start, np.array(small, np.int64), np.array(used, np.int64)


def _packer(capacities: tuple[int, ...], bin_cost: float, quadratic: float):
    top = max(capacities)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("n", "descending")])
        n = rows["n"].to_numpy().astype(np.int64)
        parts = -(-n // top)
        doc = np.arange(len(n)).repeat(parts)
        piece = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(parts)])[:-1].repeat(parts)
        size = np.minimum(top, n[doc] - piece * top)
        order = np.lexsort((piece, doc, -size))
        which, start, cap, used = pack(size[order], capacities, bin_cost, quadratic)
        doc, piece, size = doc[order], piece[order], size[order]
        g = key[0].as_py()
        names = pa.array([f"{g}-{b}" for b in range(len(cap))]).take(pa.array(which))
        cols = [names, pa.array(cap[which], pa.int32()), pa.array(used[which], pa.int32()), rows["doc_id"].combine_chunks().take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * top, pa.int64()), pa.array(size, pa.int32()), pa.array(start, pa.int32())]
        return pa.table(cols, names=["bin_id", "capacity", "used", "doc_id", "piece", "token_start", "n_tokens", "bin_start"])

    return run


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = 16.0, quadratic: float = 2e-5, group_docs: int = 100_000, length_col: str | None = None) -> DataFrame:
    """A row for each piece with its bin; see the module's docstring."""
    n = F.col(length_col) if length_col else token_count(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), n.cast("bigint").alias("n")).where("n > 0")
    groups = max(1, -(-docs.count() // group_docs))
    # Mixed once more, or the groups would go along with the shuffle's own hash.
    rows = rows.withColumn("g", F.pmod(F.xxhash64(F.xxhash64("doc_id"), F.lit(17)), F.lit(groups)))
    return rows.groupBy("g").applyInArrow(_packer(tuple(capacities), bin_cost, quadratic), SCHEMA)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
