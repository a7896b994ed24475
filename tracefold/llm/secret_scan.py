"""Secret scanning by a randomness test battery with false-discovery control.

Candidates are all maximal runs of at least ``min_len`` characters of ``A-Za-z0-9+/_-``. As a
key may be joined to words (``token_<key>``, ``api/v1/<key>``), the hypotheses are the run, each part of it
between ``+/_-``, and each stretch of hexadecimal parts joined by dashes, of ``min_len`` or more.
The encoding of each is inferred from the signs it uses (decimal, hexadecimal also with
dashes, base32, base36, base62, base64, letters), which sets its alphabet of k symbols. Then

* *battery*: Pearson's chi-squared test of uniformity over the alphabet, the runs test about
  the middle of the alphabet, and the test of lag-1 serial correlation, each against uniform
  random symbols, combined by Fisher's method. A token that fails it at ``alpha`` is patterned, not random.
* *evidence*: the likelihood ratio of uniform symbols to the corpus's own characters (counted
  over all documents, restricted to the alphabet). Its inverse is a p-value for "ordinary
  text" by Markov's inequality and shrinks with the length of the token.
* *false-discovery control*: the p-value of a hypothesis is that of the evidence divided by the battery's, so the
  worse a token fits randomness, the more evidence it takes; being no smaller, it stays a p-value. Weighted Benjamini-Hochberg at level q over all hypotheses of
  the corpus, with weights in proportion to length, as short tokens have little power. A run counts
  as one rejection however many of its hypotheses are rejected; the widest of nested ones are the findings.
  Tokens that fail the battery keep p = 1. The step-up point is found on bins of log p-values, whose number is
  fixed, so it needs no global sort; rounding is to the strict side.

Edge cases: null and empty texts have no candidates; very long texts are scanned whole; tokens of equal p-values are findings together or not at all; a corpus without candidates has no
findings; every occurrence of a repeated token is a hypothesis and a finding of its own;
repeated rows likewise; null ids are passed through; extra columns are ignored, or passed through by ``redact_secrets``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm._text import as_texts, chunks, code_points, materialise, table

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
ENCODINGS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters_mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64_url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
    "mixed": SYMBOLS,
}
NAMES = list(ENCODINGS)
BIN, BINS = 0.05, 8000
_classes: list[np.ndarray] = []

_PART = re.compile(r"[^+/_-]+")
_DASHED = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]+(?:-+[0-9a-f]+)+|[0-9A-F]+(?:-+[0-9A-F]+)+)(?![A-Za-z0-9])")

CANDIDATE = "doc_id BIGINT, start INT, token STRING, hypotheses INT, signs BIGINT, histogram ARRAY<BIGINT>"
SCORED = "doc_id BIGINT, start INT, length INT, encoding STRING, token_sha256 STRING, p_uniformity DOUBLE, p_runs DOUBLE, p_serial DOUBLE, p_battery DOUBLE, log_evidence DOUBLE, bin INT, above INT, top INT"


def _class_table() -> np.ndarray:
    """0: other, 1: a sign of a token, 2: any other letter or digit, which no token stands next to."""
    if not _classes:
        c = np.fromiter((2 if chr(i).isalnum() else 0 for i in range(65536)), np.uint8, 65536)
        c[[ord(x) for x in SYMBOLS]] = 1
        _classes.append(c)
    return _classes[0]


def candidates(texts: list[str], min_len: int, histogram: np.ndarray | None = None) -> Iterator[tuple[int, int, str]]:
    """(text, start, token) of all candidates; adds the tokens' signs in the texts to the histogram."""
    for lo, hi in chunks(texts):
        c, starts = code_points(texts[lo:hi])
        k = _class_table()[np.minimum(c, 65535)]
        if histogram is not None:
            histogram += np.bincount(c[c < 128], minlength=128)[[ord(x) for x in SYMBOLS]]
        inside = np.concatenate([[0], (k != 0).view(np.int8), [0]])
        edge = np.diff(inside)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a >= min_len
        a, b = a[long], b[long]
        foreign = np.concatenate([[0], np.cumsum(k == 2)])
        pure = foreign[a] == foreign[b]
        a, b = a[pure], b[pure]
        doc = np.searchsorted(starts, a, "right") - 1
        for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist()):
            s = x - int(starts[d])
            token = texts[lo + d][s : s + y - x]
            body = token.strip("+/_-")
            if len(body) >= min_len:
                yield lo + d, s + token.index(body), body


def hypotheses(token: str, min_len: int) -> list[tuple[int, int]]:
    """Where the hypotheses of a run begin and end: the run, then what stands within it. Any two are nested or apart."""
    found = [(0, len(token))]
    if not token.isalnum():
        inner = [m.span() for pattern in (_DASHED, _PART) for m in pattern.finditer(token)]
        found += [x for x in dict.fromkeys(inner) if x[1] - x[0] >= min_len and x != found[0]]
    return found


def infer(token: str) -> tuple[int, str]:
    """The index of the token's encoding, and the token as symbols of its alphabet."""
    x = set(token)
    dashless = token.replace("-", "")
    for name in ("decimal", "hex", "hex_upper"):
        if set(dashless) <= set(ENCODINGS[name]):
            return NAMES.index(name), dashless
    if token.isalpha() and (token[1:].islower() or token.isupper()):
        return NAMES.index("letters"), token.lower()
    for name in NAMES[4:]:
        if x <= set(ENCODINGS[name]):
            return NAMES.index(name), token
    raise ValueError("not a candidate")


_erfc = np.vectorize(math.erfc, otypes=[float])


def _two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2))


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of chi-squared by the Wilson-Hilferty transformation."""
    v = 2 / (9 * df)
    return 0.5 * _erfc((np.cbrt(np.maximum(x, 1e-12) / df) - (1 - v)) / np.sqrt(v) / math.sqrt(2))


def log_models(histogram: np.ndarray) -> list[np.ndarray]:
    """For each encoding, log(uniform / corpus) of each symbol, by the smoothed corpus counts.

    In an alphabet of one case, a letter counts in either, as capitals may stand in few words but keys.
    """
    count = dict(zip(SYMBOLS, (histogram + 1.0).tolist()))
    out = []
    for alphabet in ENCODINGS.values():
        one_case = alphabet in (alphabet.upper(), alphabet.lower())
        p = np.array([count[s] + (count[s.swapcase()] if one_case and s.isalpha() else 0) for s in alphabet])
        out.append(-np.log(len(alphabet)) - np.log(p / p.sum()))
    return out


def battery(tokens: list[str], models: list[np.ndarray]) -> dict[str, np.ndarray]:
    """All statistics of the tokens."""
    found = [infer(t) for t in tokens]
    enc = np.array([e for e, _ in found], np.int64)
    keys = ("p_uniformity", "p_runs", "p_serial", "log_evidence")
    out = {k: np.ones(len(tokens)) for k in keys}
    for e in np.unique(enc):
        alphabet = ENCODINGS[NAMES[e]]
        k = len(alphabet)
        code = np.full(128, -1)
        code[[ord(x) for x in alphabet]] = np.arange(k)
        mine = np.flatnonzero(enc == e)
        for lo in range(0, len(mine), 8192):
            rows = mine[lo : lo + 8192]
            n = np.array([len(found[r][1]) for r in rows])
            s = code[np.frombuffer("".join(found[r][1] for r in rows).encode(), np.uint8)]
            at = np.concatenate([[0], np.cumsum(n)])
            of = np.arange(len(rows)).repeat(n)
            count = np.bincount(of * k + s, minlength=len(rows) * k).reshape(len(rows), k)
            x2 = (count.astype(float) ** 2).sum(axis=1) * k / n - n
            # The exact variance under uniformity is (n - 1) / n of the asymptotic one.
            out["p_uniformity"][rows] = chi2_upper((k - 1) + np.maximum(x2 - (k - 1), -(k - 1) + 1e-9) / np.sqrt(np.maximum(1 - 1 / n, 0.5)), np.full(len(rows), k - 1.0))
            high = s >= k / 2
            n1 = np.add.reduceat(high.astype(np.int64), at[:-1])
            change = np.concatenate([[0], np.cumsum(high[1:] != high[:-1])])
            runs = 1 + change[at[1:] - 1] - change[at[:-1]]
            mean = 2.0 * n1 * (n - n1) / n + 1
            var = (mean - 1) * (mean - 2) / np.maximum(n - 1, 1)
            out["p_runs"][rows] = np.where(var > 0, _two_sided((runs - mean) / np.sqrt(np.where(var > 0, var, 1))), 2.0 ** (1 - np.minimum(n, 1000)))
            mid = s - (np.add.reduceat(s, at[:-1]) / n)[of]
            prod = np.append(mid[1:] * mid[:-1], 0.0)
            prod[at[1:] - 1] = 0
            power = np.add.reduceat(mid * mid, at[:-1])
            r1 = np.add.reduceat(prod, at[:-1]) / np.where(power > 0, power, 1)
            out["p_serial"][rows] = np.where(power > 0, _two_sided((r1 + 1 / n) * np.sqrt(n)), 2.0 ** (1 - np.minimum(n, 1000)))
            out["log_evidence"][rows] = np.add.reduceat(models[e][s], at[:-1])
    fisher = -2 * sum(np.log(np.maximum(out[k], 1e-300)) for k in keys[:3])
    out["p_battery"] = chi2_upper(fisher, np.full(len(tokens), 6.0)) if tokens else fisher
    return out | {"encoding": enc}


@dataclass
class Control:
    """What decides on a token, from statistics over the whole corpus."""

    models: list[np.ndarray]
    mean_length: float
    alpha: float
    least_bin: int = BINS + 1

    def bins(self, tokens: list[str], stats: dict[str, np.ndarray]) -> np.ndarray:
        """Bins of -log(p / weight), rounded down; those that fail the battery are at 0."""
        n = np.array([len(t) for t in tokens], float)
        fit = np.maximum(stats["p_battery"], 1e-300)
        x = np.maximum(stats["log_evidence"] + np.log(fit), 0) + np.log(n / self.mean_length)
        x = np.where((fit >= self.alpha) & (stats["log_evidence"] + np.log(fit) > 0), x, 0.0)
        return np.clip(np.floor(x / BIN), 0, BINS).astype(np.int64)


def judge(runs: list[str], min_len: int, control: Control) -> dict[str, np.ndarray | list]:
    """Of all hypotheses of the runs: run, offset, token, statistics, bin, the highest bin of those around it
    (above), and at the first of each run the highest bin of all (top; elsewhere -1)."""
    spans = [(r, a, b) for r, token in enumerate(runs) for a, b in hypotheses(token, min_len)]
    tokens = [runs[r][a:b] for r, a, b in spans]
    stats = battery(tokens, control.models)
    bins = control.bins(tokens, stats) if tokens else np.zeros(0, np.int64)
    above, top = np.full(len(spans), -1), np.full(len(spans), -1)
    first = 0
    for i, (r, a, b) in enumerate(spans):
        first = i if i == 0 or spans[i - 1][0] != r else first
        top[first] = max(top[first], bins[i])
        # The run comes first, then dashed stretches, then parts, so what is around a hypothesis is before it.
        for j in (j for j in range(first, i) if spans[j][1] <= a and b <= spans[j][2]):
            above[i] = max(above[i], bins[j])
    return stats | {"run": [r for r, _, _ in spans], "offset": [a for _, a, _ in spans], "token": tokens, "bin": bins, "above": above, "top": top}


def step_up(counts: dict[int, int], total: int, q: float) -> int:
    """The least bin whose p-value the Benjamini-Hochberg procedure still rejects."""
    best, rejected = BINS + 1, 0
    for b in sorted(counts, reverse=True):
        rejected += counts[b]
        if b > 0 and total * math.exp(-b * BIN) <= q * rejected:
            best = b
    return best


def _extract(docs: DataFrame, min_len: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("token", pa.string()), ("hypotheses", pa.int32()), ("signs", pa.int64()), ("histogram", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = np.zeros(len(SYMBOLS), np.int64)
        for b in batches:
            rows = list(candidates(as_texts(b["text"]), min_len, histogram))
            if rows:
                i, s, t = zip(*rows)
                spans = [hypotheses(x, min_len) for x in t]
                sizes = [pa.array([len(x) for x in spans], pa.int32()), pa.array([sum(y - x for x, y in z) for z in spans], pa.int64())]
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(i)), pa.array(s, pa.int32()), pa.array(t), *sizes, pa.nulls(len(t), schema[5].type)], schema=schema)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:5]), pa.array([histogram.tolist()], schema[5].type)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("text IS NOT NULL").mapInArrow(run, CANDIDATE)


def calibrate(docs: DataFrame, min_len: int, alpha: float, q: float) -> tuple[DataFrame, Control]:
    """All hypotheses with their statistics, and the control that decides on them."""
    found = materialise(_extract(docs, min_len))
    histogram = np.zeros(len(SYMBOLS))
    for r in found.where("token IS NULL").select(F.posexplode("histogram")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        histogram[r["pos"]] = r["n"]
    tokens = found.where("token IS NOT NULL")
    total, signs = tokens.agg(F.coalesce(F.sum("hypotheses"), F.lit(0)), F.sum("signs")).first()
    control = Control(log_models(histogram), signs / total if total else 1.0, alpha)
    shared = docs.sparkSession.sparkContext.broadcast(control)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = judge(b["token"].to_pylist(), min_len, shared.value)
            ts, run = s["token"], pa.array(s["run"], pa.int64())
            cols = [b["doc_id"].take(run), pa.array(np.array(b["start"].take(run)) + np.array(s["offset"], np.int32), pa.int32()), pa.array([len(t) for t in ts], pa.int32()), pa.array([NAMES[e] for e in s["encoding"]], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in ts], pa.string())]
            cols += [pa.array(s[k], pa.float64()) for k in ("p_uniformity", "p_runs", "p_serial", "p_battery", "log_evidence")]
            cols += [pa.array(s[k], pa.int32()) for k in ("bin", "above", "top")]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORED.split(", ")])

    scored = materialise(tokens.select("doc_id", "start", "token").mapInArrow(test, SCORED))
    counts = {r["bin"]: r["n"] for r in scored.where("top >= 0").groupBy(F.col("top").alias("bin")).agg(F.count("*").alias("n")).collect()}
    control.least_bin = step_up(counts, total, q)
    return scored, control


def scan_secrets(docs: DataFrame, min_len: int = 16, alpha: float = 1e-4, q: float = 0.01) -> DataFrame:
    """A row for each finding: where it stands, its encoding, statistics and digest, not the secret itself."""
    scored, control = calibrate(docs, min_len, alpha, q)
    return scored.where((F.col("bin") >= control.least_bin) & (F.col("above") < control.least_bin)).drop("bin", "above", "top")


def redact_secrets(docs: DataFrame, min_len: int = 16, alpha: float = 1e-4, q: float = 0.01) -> DataFrame:
    """All documents with each finding replaced by ``[secret]``, and ``n_chars`` brought up to date."""
    _, control = calibrate(docs, min_len, alpha, q)
    shared = docs.sparkSession.sparkContext.broadcast(control)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b["text"].to_pylist()
            rows = list(candidates([t or "" for t in column], min_len))
            if rows:
                x = judge([t for _, _, t in rows], min_len, shared.value)
                hit = np.flatnonzero((x["bin"] >= shared.value.least_bin) & (x["above"] < shared.value.least_bin))
                found = [(rows[x["run"][h]][0], rows[x["run"][h]][1] + x["offset"][h], len(x["token"][h])) for h in hit]
                for i, s, n in sorted(found, reverse=True):
                    column[i] = column[i][:s] + "[secret]" + column[i][s + n :]
                for name, values in (("text", column), ("n_chars", [None if t is None else len(t) for t in column])):
                    at = b.schema.get_field_index(name)
                    if at >= 0:
                        old = b.column(at)
                        new = values if name == "text" else [v if t is not None else o for v, t, o in zip(values, column, old.to_pylist())]
                        b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
