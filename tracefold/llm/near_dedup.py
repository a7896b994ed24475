"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Each text becomes the set of its word 3-grams (all words, if it has fewer) and a
   signature of ``coordinates`` minima under independent multiply-shift hashes.
2. Documents of one signature are a class, which is compared once for all of them.
3. Each class is posted under each coordinate-value pair. Values that no other class
   has are dropped; a class that keeps fewer than ``matches`` of them has no partner.
4. *Prefix.* Values are ordered by rarity. Two signatures with at least t common values
   share one among the first (s - t + 1) of the s values that each keeps, so only these lists are
   merged, and frequent values hardly ever are.
5. *Skip.* The long lists that are left are not merged: whether a candidate stands in them is looked
   up in its signature, which names the one list of each coordinate that it is in. So all collisions of a pair are
   counted when it is met; a pair counts under the lowest coordinate of its common prefix values only and
   is skipped under the others. Pairs with at least t collisions are links.

Lists are sorted on the shuffle and handled many at a time as arrays; long ones are cut into blocks that meet
pairwise, so that no task gets a whole list. Pairs are not emitted: what leaves a task is a row
for each class that it linked, with its number of links and the smallest class that it is connected with
there, so results grow with the documents. ``near_pairs`` gives the links one by one.

Edge cases: null, empty and wordless texts have no signature and are classes of their own without links; very
long texts are signed whole; null ids are ignored; rows that repeat an id and its signature are one document, other texts
under the id are documents of their own, told apart by ``class_key``; ties are broken by the smaller id, then
the smaller key; an empty table gives no rows; extra columns are ignored, or kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm._text import as_texts, chunks, materialise, mix, table, word_hashes

SIG = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("sig", pa.list_(pa.int32()))])
_R1, _R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hash_family(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, coordinates, dtype=np.uint64).astype(np.uint32), rng.integers(0, 1 << 32, coordinates, dtype=np.uint64).astype(np.uint32) | np.uint32(1))


def signatures(texts: list[str], coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The MinHash signatures of the texts that have words, and the indices of these texts."""
    out, kept = [np.empty((0, coordinates), np.uint32)], [np.zeros(0, np.int64)]
    salt, factor = hash_family(coordinates, seed)
    for lo, hi in chunks(texts):
        h, off = word_hashes(texts[lo:hi])
        n = np.diff(off)
        if not len(h):
            continue
        g = h.copy()
        if len(h) > 2:
            g[:-2] = mix(h[:-2] * _R1 + h[1:-1] * _R2 + h[2:])
        # A text's last two words begin no 3-gram; in a text of one or two words they stand alone.
        gram = np.ones(len(h), bool)
        for back in (1, 2):
            gram[(off[1:] - back)[n > 2]] = False
        short = np.flatnonzero((n > 0) & (n <= 2))
        for d in short:
            g[off[d] : off[d + 1]] = mix(h[off[d] : off[d + 1]])
        x = (g[gram] >> np.uint64(32)).astype(np.uint32)
        begin = np.concatenate([[0], np.cumsum(gram)])[off[:-1]][n > 0]
        sig = np.empty((len(begin), coordinates), np.uint32)
        for k in range(coordinates):
            sig[:, k] = np.minimum.reduceat((x ^ salt[k]) * factor[k], begin)
        out.append(sig)
        kept.append(lo + np.flatnonzero(n > 0))
    return np.concatenate(out), np.concatenate(kept)


def sign(docs: DataFrame, coordinates: int, seed: int) -> DataFrame:
    """(doc_id, key, sig) of all rows with an id; key, a digest of the signature, and sig are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, kept = signatures(as_texts(b["text"]), coordinates, seed)
            keys: list[bytes | None] = [None] * len(b)
            size = np.zeros(len(b), np.int64)
            for i, s in zip(kept.tolist(), sig):
                keys[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            size[kept] = coordinates
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.view(np.int32).ravel()), mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(keys, pa.binary()), lists], schema=SIG)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id BIGINT, key BINARY, sig ARRAY<INT>")


@dataclass
class Lists:
    """Rows of posting lists, sorted by list: ``group`` numbers the lists, ``side`` is -1 where all of a list meet."""

    group: np.ndarray
    side: np.ndarray
    k: np.ndarray
    node: np.ndarray
    sig: np.ndarray
    prefix: np.ndarray  # bits of the coordinates in the prefix

    def links(self, t: int, small: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, matches) of the pairs that count under their list."""
        begin = np.flatnonzero(np.r_[True, np.diff(self.group) != 0]) if len(self.group) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(self.group))
        size = (end - begin).repeat(end - begin)
        rows = np.flatnonzero(size <= small)
        for step in range(1, small):
            # Neighbours at this distance in all short lists at once.
            rows = rows[rows + step < len(self.group)]
            rows = rows[self.group[rows] == self.group[rows + step]]
            if not len(rows):
                break
            for lo in range(0, len(rows), 1 << 15):
                i = rows[lo : lo + (1 << 15)]
                yield self._count(i, i + step, t)
        for lo, hi in zip(begin[end - begin > small], end[end - begin > small]):
            if self.side[lo] < 0:
                left = right = np.arange(lo, hi)
            else:
                left, right = (lo + np.flatnonzero(self.side[lo:hi] == x) for x in (self.side[lo:hi].min(), self.side[lo:hi].max()))
            columns = np.ascontiguousarray(self.sig[right].T)
            some = max(1, (1 << 18) // len(right))
            for a in range(0, len(left), some):
                rows = left[a : a + some]
                m = np.zeros((len(rows), len(right)), np.uint8)
                for k in range(self.sig.shape[1]):
                    m += self.sig[rows, k, None] == columns[k]
                i, j = np.nonzero(m >= t)
                i, j = rows[i], right[j]
                up = i < j if self.side[lo] < 0 else np.ones(len(i), bool)
                i, j = i[up], j[up]
                for cut in range(0, len(i), 1 << 15):
                    yield self._count(i[cut : cut + (1 << 15)], j[cut : cut + (1 << 15)], t)

    def _count(self, i: np.ndarray, j: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        apart = (self.side[i] < 0) | (self.side[i] != self.side[j])
        i, j = i[apart], j[apart]
        same = self.sig[i] == self.sig[j]
        n = np.count_nonzero(same, axis=1)
        good = n >= t
        i, j, n, same = i[good], j[good], n[good], same[good]
        common = self.prefix[i] & self.prefix[j] & _bits(same)
        first = common & (~common + np.uint64(1))
        own = first == np.uint64(1) << self.k[i].astype(np.uint64)
        return i[own], j[own], n[own]


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of up to 64 flags as bits of a number."""
    out = np.zeros((len(flags), 8), np.uint8)
    packed = np.packbits(flags, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")[:, 0]


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Lists, np.ndarray]]:
    """The rows of sorted batches as whole lists, and how many documents each row's class has."""
    rest: pa.Table | None = None
    names = ("k", "v", "b1", "b2")
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        keys = np.stack([rest[c].to_numpy() for c in names])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        if len(change):
            yield _as_lists(rest.slice(0, change[-1] + 1))
            rest = rest.slice(change[-1] + 1)
    if rest is not None and len(rest):
        yield _as_lists(rest)


def _as_lists(t: pa.Table) -> tuple[Lists, np.ndarray]:
    keys = np.stack([t[c].to_numpy() for c in ("k", "v", "b1", "b2")])
    group = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
    sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    side = np.where(keys[2] == keys[3], -1, t["side"].to_numpy())
    return Lists(group, side, keys[0], t["node"].to_numpy(), sig, t["prefix"].to_numpy().view(np.uint64)), t["copies"].to_numpy()


def smallest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the smallest row that links lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


@dataclass
class Classes:
    """What the comparison is about: rows (doc_id, key, n), classes (key, node, sig, first_id, copies), and their posting lists."""

    rows: DataFrame
    classes: DataFrame
    lists: DataFrame
    matches: int

    def compare(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        return self.lists.repartition("k", "v", "b1", "b2").sortWithinPartitions("k", "v", "b1", "b2", "node").mapInArrow(run, schema)


def post(docs: DataFrame, coordinates: int, matches: int, seed: int, block: int) -> Classes:
    """The classes of the documents, posted under the rarest of the values that they share."""
    if not 0 < matches <= coordinates <= 64:
        raise ValueError("matches and coordinates have to be 1 to 64, and matches not above coordinates")
    signed = materialise(sign(docs, coordinates, seed))
    rows = materialise(signed.groupBy("doc_id", "key").agg(F.count("*").alias("n")))
    members = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    sigs = signed.where("key IS NOT NULL").groupBy("key").agg(F.first("sig").alias("sig"))
    # The numbers are those that the checkpoint holds.
    classes = materialise(members.join(sigs, "key").withColumn("node", F.monotonically_increasing_id()))
    posts = classes.select("node", F.posexplode("sig").alias("k", "v"))
    shared = posts.groupBy("k", "v").agg(F.count("*").alias("df")).where("df > 1")
    held = posts.join(shared, ["k", "v"])
    kept = held.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "k", "v"))).alias("x")).where(F.size("x") >= matches)
    kept = kept.select("node", F.slice("x", 1, F.size("x") - matches + 1).alias("x"))
    bits = F.expr("aggregate(x, 0L, (a, p) -> a | shiftleft(1L, p.k))")
    heads = kept.join(classes.select("node", "sig", "copies"), "node").select("node", "sig", "copies", bits.alias("prefix"), F.explode("x").alias("x"))
    cut = F.ceil(F.col("x.df") / block).cast("int")
    heads = heads.select("node", "sig", "copies", "prefix", "x.k", "x.v", cut.alias("blocks"), F.pmod(F.xxhash64("node"), cut).cast("int").alias("side"))
    heads = heads.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lists = heads.select("k", "v", F.least("side", "other").alias("b1"), F.greatest("side", "other").alias("b2"), "side", "node", "copies", "prefix", "sig")
    return Classes(rows, classes, lists, matches)


PAIR = pa.schema([("node_a", pa.int64()), ("node_b", pa.int64()), ("matches", pa.int32())])
TIE = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("best", pa.int32())])


def near_pairs(docs: DataFrame, coordinates: int = 64, matches: int = 32, seed: int = 11, block: int = 2048) -> DataFrame:
    """(doc_a, key_a, doc_b, key_b, matches): each link between two classes once, by their smallest ids; doc_a <= doc_b."""
    c = post(docs, coordinates, matches, seed, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists, _ in _whole_lists(batches):
            for i, j, n in lists.links(matches):
                yield pa.RecordBatch.from_arrays([pa.array(lists.node[i]), pa.array(lists.node[j]), pa.array(n.astype(np.int32))], schema=PAIR)

    pairs = c.compare(run, "node_a BIGINT, node_b BIGINT, matches INT")
    name = lambda x: c.classes.select(F.col("node").alias(f"node_{x}"), F.col("first_id").alias(f"doc_{x}"), F.hex("key").alias(f"key_{x}"))
    pairs = pairs.join(name("a"), "node_a").join(name("b"), "node_b")
    low, high = (f(F.struct("doc_a", "key_a"), F.struct(F.col("doc_b").alias("doc_a"), F.col("key_b").alias("key_a"))) for f in (F.least, F.greatest))
    pairs = pairs.select(low.alias("x"), high.alias("y"), "matches")
    return pairs.select(F.col("x.doc_a").alias("doc_a"), F.col("x.key_a").alias("key_a"), F.col("y.doc_a").alias("doc_b"), F.col("y.key_a").alias("key_b"), "matches")


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(doc_id, group_id) of all ids in pairs; the group is the smallest id reachable.

    Alternates large-star and small-star steps on the edges, whose number never grows, until nothing changes. Minima
    are aggregated before they are joined back, so that the join can split the edges of a hot centre.
    """

    def told(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = materialise(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    before = told(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        m = large.join(low, "u")
        small = m.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = materialise(small)
        after = told(edges)
        if after == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct())
        before = after


def judged(docs: DataFrame, coordinates: int = 64, matches: int = 32, seed: int = 11, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) of all rows, and (key, first_id, copies, links, best, group_id, group_key) of all classes: the group's
    smallest id, and the smallest key of the classes with that id."""
    c = post(docs, coordinates, matches, seed, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists, copies in _whole_lists(batches):
            node, at = np.unique(lists.node, return_inverse=True)
            size = np.zeros(len(node), np.int64)
            size[at] = copies
            links, best, a, b = np.zeros(len(node), np.int64), np.zeros(len(node), np.int32), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, n in lists.links(matches):
                i, j = at[i], at[j]
                for x, y in ((i, j), (j, i)):
                    np.add.at(links, x, size[y])
                    np.maximum.at(best, x, n.astype(np.int32))
                a.append(i)
                b.append(j)
                if sum(map(len, a)) > 1 << 20:  # links already known to connect are kept as a forest
                    root = smallest_reached(np.concatenate(a), np.concatenate(b), len(node))
                    a, b = [np.arange(len(node))], [root]
            root = smallest_reached(np.concatenate(a), np.concatenate(b), len(node))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some]), pa.array(best[some])], schema=TIE)

    ties = materialise(c.compare(run, "node BIGINT, root BIGINT, links BIGINT, best INT"))
    total = ties.groupBy("node").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    groups = components(ties, "node", "root").select(F.col("doc_id").alias("node"), "group_id")
    named = c.classes.select("node", "key", "first_id", "copies").join(total, "node", "left").join(groups, "node", "left")
    named = named.withColumn("group_id", F.coalesce("group_id", "node"))
    first = named.groupBy("group_id").agg(F.min(F.struct("first_id", "key")).alias("g"))
    named = named.join(first, "group_id")
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    best = F.when(F.col("copies") > 1, coordinates).otherwise(F.coalesce("best", F.lit(0)))
    return c.rows, named.select("key", "first_id", "copies", links.alias("links"), best.alias("best"), F.col("g.first_id").alias("group_id"), F.col("g.key").alias("group_key"))


def near_duplicates(docs: DataFrame, coordinates: int = 64, **options) -> DataFrame:
    """(doc_id, class_id, class_key, n_links, best_jaccard): a row for each document.

    ``class_id`` is the smallest id that links lead to, its own without links; ``class_key`` tells classes of the same
    smallest id apart (null without words); ``n_links`` is the number of documents that it is linked with, and
    ``best_jaccard`` the estimate of the nearest, 0 without links.
    """
    rows, classes = judged(docs, coordinates, **options)
    j = rows.join(classes, "key", "left")
    return j.select("doc_id", F.coalesce("group_id", "doc_id").alias("class_id"), F.hex("group_key").alias("class_key"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.coalesce("best", F.lit(0)) / F.lit(float(coordinates))).alias("best_jaccard"))


def drop_near_duplicates(docs: DataFrame, coordinates: int = 64, seed: int = 11, broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id, with all columns.

    A row goes only if its own text is redundant. Of rows that repeat both id and signature the one of the smallest text stays; rows
    without an id or without words all stay. Only ids meet the documents; they are broadcast where no more
    than ``broadcast_ids`` were counted, of 8 bytes each, and shuffled beyond.
    """
    rows, classes = judged(docs, coordinates, seed=seed, **options)
    j = rows.join(classes, "key", "left").withColumn("stays", F.col("key").isNull() | ((F.col("key") == F.col("group_key")) & (F.col("doc_id") == F.col("group_id"))))
    fate = j.withColumn("again", F.col("stays") & F.col("key").isNotNull() & (F.col("n") > 1))
    ids = fate.groupBy("doc_id").agg(F.max("stays").alias("some"), F.min("stays").alias("all"), F.max("again").alias("again"))
    ids = materialise(ids.where("NOT all OR again").select("doc_id", (F.col("some") | F.col("again")).alias("mixed")))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_ids else df

    own = F.col("doc_id").cast("bigint")
    out = docs.join(small(ids.select(F.col("doc_id").alias("_id"))), own == F.col("_id"), "left_anti")
    mixed = ids.where("mixed").select(F.col("doc_id").alias("_id"))
    if mixed.isEmpty():
        return out
    # Ids with rows of both fates: their texts are signed once more.
    some = docs.join(small(mixed), own == F.col("_id"), "left_semi")
    keyed = _with_key(some, coordinates, seed).join(fate.where("stays").select(F.col("doc_id").alias("_id"), F.col("key").alias("_kept")), (own == F.col("_id")) & F.col("_key").eqNullSafe(F.col("_kept")), "left_semi")
    wordless = keyed.where("_key IS NULL").select(docs.columns)
    one = keyed.where("_key IS NOT NULL").groupBy(own.alias("_id"), "_key").agg(F.min_by(F.struct(*docs.columns), F.col("text")).alias("_r")).select("_r.*")
    return out.unionByName(wordless).unionByName(one)


def _with_key(docs: DataFrame, coordinates: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, kept = signatures(as_texts(b["text"]), coordinates, seed)
            keys: list[bytes | None] = [None] * len(b)
            for i, s in zip(kept.tolist(), sig):
                keys[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, "_key"])

    out = docs.withColumn("_key", F.lit(None).cast("binary"))
    return docs.mapInArrow(run, out.schema)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
