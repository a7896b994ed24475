"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact verification.

Texts are sequences of lower-cased words. A document is contaminated by an item of n words
when one of its windows of n words (or the whole document, if it is shorter) lies within
k = floor(rate * n) word edits of the item.

1. *Windows.* If k edits turn the item into the window, one of k + 1 disjoint segments of
   the item stands in the window verbatim, at most k words from its place. Windows are laid
   wherever a document holds a segment, at all 2k + 1 shifts: by the pigeonhole principle
   no window within the threshold is left out, and no other window needs embedding.
2. *CGK.* A shared random walk per repetition maps item and window to strings in which
   edits become substitutions: the pointer into the word sequence moves on or stays by a
   random bit of (step, word).
3. *Bit sampling.* Each repetition compares sampled coordinates; one agreeing repetition
   makes a candidate. Their number is set on the plan for each length class on its own: its
   items are given k random edits, and repetitions are added until the wanted share of them collides.
4. *Verification.* Exact word edit distance. Where a class does not reach the wanted share at the
   bound of repetitions, that class and all of longer items go without 2 and 3: all their windows are
   verified, in order of lower bounds (common words; the best alignment that ends with the window),
   until no other can be better.

Edge cases: null and empty documents and items match nothing; very long ones are compared whole; of windows at equal distance the first counts; items under ``min_words``
words are ignored as too common to be evidence; equal items each report; repeated document
rows each report once per row; ids may be null and are passed through; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm._text import as_texts, batch_of, chunks, mix, table, word_hashes

SCHEMA = "doc_id BIGINT, item_id BIGINT, n_words INT, distance INT, start_word INT"
OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("distance", pa.int32()), ("start_word", pa.int32())])
_R = np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 22


@dataclass
class LengthClass:
    """Items of about one size. Without a walk, all windows of theirs are verified."""

    words: np.ndarray | None = None  # items x longest, 0 beyond the end
    walk: np.ndarray | None = None  # repetitions x steps, odd multipliers
    at: np.ndarray | None = None  # repetitions x samples, as shares of 2n
    keys: np.ndarray | None = None  # repetitions x items x samples
    needed: int = 0


@dataclass
class Plan:
    """What a scan needs of one slice of the benchmark; its size is bounded by the slice."""

    ids: list
    own: list  # words of each item
    n: np.ndarray
    k: np.ndarray
    seeds: dict  # q -> (sorted hashes, item of each, offset of each)
    bitmap: dict  # q -> presence by leading bits
    classes: list
    of: np.ndarray  # class of each item
    row: np.ndarray  # its place in the class


def grams(h: np.ndarray, q: int) -> np.ndarray:
    g = h[: len(h) - q + 1]
    for j in range(1, q):
        g = g * _R + h[j : len(h) - q + 1 + j]
    return mix(g)


def embed(words: np.ndarray, n: np.ndarray, walk: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sampled CGK coordinates: repetitions x rows x samples. words: rows x length, 0-padded."""
    reps, rows, last = len(walk), len(words), words.shape[1]
    some = max(1, (1 << 25) // max(1, reps * int(2 * n.max()) if rows else 1))  # bounds the steps held at once
    if rows > some:
        return np.concatenate([embed(words[lo : lo + some], n[lo : lo + some], walk, at) for lo in range(0, rows, some)], axis=1)
    padded = np.concatenate([words, np.zeros((rows, 1), np.uint64)], axis=1)
    row = np.arange(rows)[None, :]
    steps = int(2 * n.max()) if rows else 0
    size = np.int16 if last < 1 << 15 else np.int32
    p = np.zeros((reps, rows), size)
    past = np.empty((steps, reps, rows), size)
    for j in range(steps):
        past[j] = p
        move = (padded[row, p] * walk[:, j, None]) >> np.uint64(63)
        p = np.minimum(p + move.astype(size), last)
    j = (at[:, None, :] * (2 * n)[None, :, None]).astype(np.int64)
    where = past[j, np.arange(reps)[:, None, None], np.arange(rows)[None, :, None]]
    return padded[np.arange(rows)[None, :, None], where]


def edit_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Word edit distance of each row of a (first la words) to the same row of b (first lb)."""
    rows, ramp = len(a), np.arange(b.shape[1] + 1)
    d = np.broadcast_to(ramp, (rows, len(ramp))).astype(np.int32)
    out = d[np.arange(rows), lb].copy()
    for i in range(int(la.max()) if rows else 0):
        e = np.empty_like(d)
        e[:, 0] = i + 1
        e[:, 1:] = np.minimum(d[:, 1:] + 1, d[:, :-1] + (b != a[:, i, None]))
        d = np.minimum.accumulate(e - ramp, axis=1) + ramp
        out = np.where(la == i + 1, d[np.arange(rows), lb], out)
    return out


def bottom_row(item: np.ndarray, text: np.ndarray, anywhere: bool) -> Iterator[int]:
    """After each word of the text, the distance of the item to all of it so far, or to the nearest part that ends there (anywhere).

    Bit-parallel, after Myers and Hyyrö: a column of the table is two integers of one bit a word of the item.
    """
    places: dict[int, list[int]] = {}
    for i, x in enumerate(item.tolist()):
        places.setdefault(x, []).append(i)
    frequent = {x: sum(1 << i for i in at) for x, at in places.items() if len(at) > 8}  # masks of all would take n * n bits
    full, score = (1 << len(item)) - 1, len(item)
    up, down, top = full, 0, 1 << (len(item) - 1)
    for x in text.tolist():
        eq = frequent[x] if x in frequent else sum(1 << i for i in places.get(x, ()))
        level = (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(level | up)), up & level
        score += bool(right & top) - bool(left & top)
        right, left, eq = (right << 1 | (not anywhere)) & full, left << 1 & full, eq | down
        up, down = left | (full & ~(eq | right)), right & eq
        yield score


def _distance(item: np.ndarray, window: np.ndarray, limit: int) -> int:
    """Word edit distance; anything above the limit stands for what is above it."""
    score, rest = len(item), len(window)
    for score in bottom_row(item, window, False):
        rest -= 1
        if score - rest > limit:
            return limit + 1
    return score


def best_window(item: np.ndarray, k: int, text: np.ndarray, anchors: np.ndarray) -> tuple[int, int] | None:
    """(distance, start) of the nearest and then first window of the item's size up to k words from an anchor, if within k."""
    n, size = len(item), min(len(item), len(text))
    last = len(text) - size

    def held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many of the ranges a to b hold each start."""
        return np.cumsum(np.bincount(a, minlength=last + 2) - np.bincount(b + 1, minlength=last + 2))[: last + 1]

    laid = held(np.clip(anchors - k, 0, last), np.clip(anchors + k, 0, last)) > 0
    # Of a word that the item has c times, a window shares at most its first c.
    known, times = np.unique(item, return_counts=True)
    word = np.minimum(np.searchsorted(known, text), len(known) - 1)
    p = np.flatnonzero(known[word] == text)
    p = p[np.argsort(word[p], kind="stable")]
    word = word[p]
    back = np.arange(len(p)) - times[word]
    before = np.where((back >= 0) & (word[np.maximum(back, 0)] == word), p[np.maximum(back, 0)], -1)
    a, b = np.maximum(p - size, before) + 1, np.minimum(p, last)
    a = np.maximum(a, 0)
    bound = n - held(a[a <= b], b[a <= b])
    starts = np.flatnonzero(laid & (bound <= k))
    if not len(starts):
        return None
    ends = np.fromiter(bottom_row(item, text[starts[0] : starts[-1] + size], True), np.int64)
    bound = np.maximum(bound[starts], ends[starts + size - 1 - starts[0]])
    best = (k + 1, -1)
    for least in sorted(zip(bound.tolist(), starts.tolist())):
        if least >= best:
            break
        best = min(best, (_distance(item, text[least[1] : least[1] + size], min(k, best[0])), least[1]))
    return best if best[0] <= k else None


def _edited(words: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The item after k random edits, cut or filled to its size."""
    x = list(words)
    for _ in range(k):
        kind, i = rng.integers(3), int(rng.integers(max(1, len(x))))
        new = np.uint64(rng.integers(1, 1 << 63))
        if kind == 0 and x:
            x[i] = new
        elif kind == 1:
            x.insert(i, new)
        elif len(x) > 1:
            del x[i]
    x = x[: len(words)] + [np.uint64(rng.integers(1, 1 << 63)) for _ in range(len(words) - len(x))]
    return np.array(x, np.uint64)


def make_plan(ids: list, texts: list[str], rate: float, recall: float, samples: int, min_words: int, seed: int, most: int = 96, trials: int = 400, longest: int = 2048) -> Plan | None:
    """Segments of all items, and for each length class as many repetitions as the wanted recall takes.

    ``trials`` is the number of edited items that the recall of a class is set on; ``most`` bounds
    the repetitions, and classes from the first on that needs more, or that holds items of more than ``longest`` words, whose
    walks would take long for nothing, are verified without them.
    """
    h, off = word_hashes([t.replace("\x00", " ") for t in texts])
    keep = [i for i in range(len(texts)) if off[i + 1] - off[i] >= min_words]
    if not keep:
        return None
    own = [h[off[i] : off[i + 1]] for i in keep]
    n = np.array([len(x) for x in own])
    k = np.floor(rate * n).astype(int)
    seeds: dict[int, list] = {}
    for i, x in enumerate(own):
        q = int(n[i] // (k[i] + 1))
        for s in range(k[i] + 1):
            seeds.setdefault(q, []).append((grams(x[s * q : s * q + q], q)[0], i, s * q))
    by_q, bitmap = {}, {}
    for q, found in seeds.items():
        found.sort()
        hs, items, offs = (np.array(x) for x in zip(*found))
        by_q[q] = (hs.astype(np.uint64), items.astype(np.int64), offs.astype(np.int64))
        bitmap[q] = np.zeros(1 << _BITS, bool)
        bitmap[q][by_q[q][0] >> np.uint64(64 - _BITS)] = True
    # Classes are of about equal numbers of edits, a quarter of an octave wide.
    _, of = np.unique(np.floor(4 * np.log2(k + 1)), return_inverse=True)
    classes, row = [], np.zeros(len(own), np.int64)
    exact = False
    for c in range(of.max() + 1):
        items = np.flatnonzero(of == c)
        row[items] = np.arange(len(items))
        made = None if exact or n[items].max() > longest else _repetitions([own[i] for i in items], k[items], recall, samples, np.random.default_rng([seed, c]), most, trials)
        exact = made is None
        classes.append(made or LengthClass())
    # All take as many as the class that needs most, so that short items have no less for being apart.
    reps = max(c.needed for c in classes)
    for i, c in enumerate(classes):
        if c.walk is not None:
            c.walk, c.at = c.walk[:reps], c.at[:reps]
            c.keys = embed(c.words, n[of == i], c.walk, c.at)
    return Plan([ids[i] for i in keep], own, n, k, by_q, bitmap, classes, of, row)


def _repetitions(own: list[np.ndarray], k: np.ndarray, recall: float, samples: int, rng: np.random.Generator, most: int, trials: int) -> LengthClass | None:
    """The class of these items and how many repetitions recall them; None if ``most`` do not."""
    n = np.array([len(x) for x in own])
    words = np.zeros((len(own), n.max()), np.uint64)
    for i, x in enumerate(own):
        words[i, : n[i]] = x
    walk = rng.integers(0, 1 << 63, (most, 2 * int(n.max())), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at = rng.random((most, samples))
    pick = rng.integers(0, len(own), trials)
    copies = np.zeros((trials, n.max()), np.uint64)
    for r, i in enumerate(pick):
        copies[r, : n[i]] = _edited(own[i], int(k[i]), rng)
    hit = (embed(copies, n[pick], walk, at) == embed(words[pick], n[pick], walk, at)).all(axis=2)
    reached = np.logical_or.accumulate(hit, axis=0).mean(axis=1) >= recall
    if not reached.any():
        return None
    return LengthClass(words, walk, at, needed=int(np.argmax(reached)) + 1)


def scan_texts(texts: list[str], plan: Plan) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, words, distance, start): the best window of each contaminated pair."""
    h, off = word_hashes(texts)
    found = []
    for q, (hs, items, offs) in plan.seeds.items():
        if len(h) < q:
            continue
        g = grams(h, q)
        pos = np.flatnonzero(plan.bitmap[q][g >> np.uint64(64 - _BITS)])
        lo, hi = np.searchsorted(hs, g[pos]), np.searchsorted(hs, g[pos], "right")
        times = hi - lo
        pos, lo = pos[times > 0].repeat(times[times > 0]), lo[times > 0].repeat(times[times > 0])
        if len(pos):
            run = np.arange(len(pos)) - np.concatenate([[0], np.cumsum(times[times > 0])])[:-1].repeat(times[times > 0])
            found.append((pos, items[lo + run], offs[lo + run], np.full(len(pos), q)))
    if not found:
        return
    pos, item, offset, q = (np.concatenate(x) for x in zip(*found))
    doc = np.searchsorted(off, pos, "right") - 1
    inside = pos + q <= off[doc + 1]
    pos, item, offset, doc = pos[inside], item[inside], offset[inside], doc[inside]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for c, group in enumerate(plan.classes):
        mine = plan.of[item] == c
        if mine.any():
            (_sampled if group.walk is not None else _all)(plan, group, h, off, item[mine], doc[mine], (pos - offset)[mine], best)
    for (d, i), (x, s) in sorted(best.items()):
        yield d, i, int(plan.n[i]), x, s


def _all(plan: Plan, group: LengthClass, h: np.ndarray, off: np.ndarray, item: np.ndarray, doc: np.ndarray, anchor: np.ndarray, best: dict) -> None:
    """Adds the best window of each pair of document and item, of all that are laid."""
    order = np.lexsort((doc, item))
    item, doc, anchor = item[order], doc[order], anchor[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(item) != 0) | (np.diff(doc) != 0)])
    for lo, hi in zip(cut, np.r_[cut[1:], len(item)]):
        i, d = int(item[lo]), int(doc[lo])
        found = best_window(plan.own[i], int(plan.k[i]), h[off[d] : off[d + 1]], np.unique(anchor[lo:hi] - off[d]))
        if found:
            best[d, i] = found


def _sampled(plan: Plan, group: LengthClass, h: np.ndarray, off: np.ndarray, item: np.ndarray, doc: np.ndarray, anchor: np.ndarray, best: dict) -> None:
    """Adds the best window of each pair of document and item, of those that a repetition makes candidates."""
    k = plan.k[item]
    span = 2 * k + 1
    shift = np.arange(span.sum()) - np.concatenate([[0], np.cumsum(span)])[:-1].repeat(span) - k.repeat(span)
    item, doc = item.repeat(span), doc.repeat(span)
    start = anchor.repeat(span) + shift
    start = np.maximum(np.minimum(start, off[doc + 1] - plan.n[item]), off[doc])
    item, doc, start = np.unique(np.stack([item, doc, start]), axis=1)
    col = np.arange(group.words.shape[1])[None, :]
    for lo in range(0, len(item), 2048):  # bounds the memory of the walk
        it, dc, st = item[lo : lo + 2048], doc[lo : lo + 2048], start[lo : lo + 2048]
        size = np.minimum(plan.n[it], off[dc + 1] - st)
        win = np.where(col < size[:, None], h[np.minimum(st[:, None] + col, len(h) - 1)], np.uint64(0))
        cand = (embed(win, plan.n[it], group.walk, group.at) == group.keys[:, plan.row[it]]).all(axis=2).any(axis=0)
        it, dc, st, size, win = it[cand], dc[cand], st[cand], size[cand], win[cand]
        dist = edit_distances(group.words[plan.row[it]], plan.n[it], win, size)
        for i, d, s, x in zip(it, dc, st, dist):
            if x <= plan.k[i]:
                new = (int(x), int(s - off[d]))
                key = (int(d), int(i))
                best[key] = min(new, best.get(key, new))


def plans(benchmark: DataFrame, rate: float, recall: float, samples: int, min_words: int, slice_chars: int, seed: int) -> Iterator[Plan]:
    """A plan for each slice of at most about ``slice_chars`` characters of benchmark.

    Each slice is shipped to all tasks, so its size is set here; a benchmark beyond one
    slice takes one scan of the documents a slice.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, math.ceil(total / slice_chars))
    for s in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == s)
        rows = sorted(part.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        plan = make_plan([r[0] for r in rows], [r[1] for r in rows], rate, recall, samples, min_words, seed)
        if plan:
            yield plan


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.97, samples: int = 2, min_words: int = 8, slice_chars: int = 8_000_000, seed: int = 7) -> DataFrame:
    """A row for each document and item that it contains; see the module's docstring."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    out = None
    for plan in plans(benchmark, rate, recall, samples, min_words, slice_chars, seed):
        shared = spark.sparkContext.broadcast(plan)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for b in batches:
                ts, ids, rows = as_texts(b["text"]), b["doc_id"], []
                for lo, hi in chunks(ts):
                    rows += [(ids[lo + d].as_py(), p.ids[i], n, x, s) for d, i, n, x, s in scan_texts(ts[lo:hi], p)]
                if rows:
                    yield batch_of(rows, OUT)

        found = texts.mapInArrow(scan, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, with all their columns; null texts stay."""
    options = {"rate": 0.2, "recall": 0.97, "samples": 2, "min_words": 8, "slice_chars": 8_000_000, "seed": 7} | options
    for plan in plans(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(plan)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ts = as_texts(b["text"])
                good = np.ones(len(ts), bool)
                for lo, hi in chunks(ts):
                    for d, *_ in scan_texts(ts[lo:hi], shared.value):
                        good[lo + d] = False
                yield b.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
