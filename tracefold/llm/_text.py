"""Vectorised text primitives shared by the training-data operators.

Texts of an Arrow batch are handled in chunks of bounded size as one array of
code points, so that no operator loops over characters or words in Python.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_CHARS = 1 << 18
BATCH_ROWS = 1000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, one machine alone makes a folder of its own, and a cluster is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="tracefold-checkpoint-")
            atexit.register(shutil.rmtree, shared[7:], ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints for a table that outlives its job; it is deleted with the session's end."""
    place = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, place)
    return place


def discard(spark: SparkSession, place: str) -> None:
    """Deletes a folder of the shared file system, if the session still runs."""
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """From here on, this session sends at most ``BATCH_ROWS`` rows at once to Python (fewer, if it is set so).

    Spark's 10,000 texts are buffers of tens of MB on either side of the socket, beside the heap, whose room is not given back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def chunks(texts: Sequence[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text is a chunk of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed; the start of each text and the end."""
    raw = ("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(raw, np.uint32), starts


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        keep = np.fromiter((chr(i).isalnum() for i in range(65536)), bool, 65536)
        keep[65535] = True  # stands for all code points beyond the first plane
        salt = mix(np.arange(1, 65537, dtype=np.uint64) * _GOLD) | np.uint64(1)
        _tables["letters"] = np.where(keep, salt, np.uint64(0))
    return _tables["letters"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "powers" not in _tables or len(_tables["powers"]) < n:
        room = max(n, 2 * CHUNK_CHARS)
        base = 0xD1342543DE82EF95
        for key, b in (("powers", base), ("inverses", pow(base, -1, 1 << 64))):
            x = np.full(room, b, np.uint64)
            x[0] = 1
            _tables[key] = np.multiply.accumulate(x)
    return _tables["powers"][:n], _tables["inverses"]


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased alphanumeric words, and where each text's words start.

    A text without words has an empty range.
    """
    c, starts = code_points([t.lower() for t in texts])
    v = _letters()[np.minimum(c, 65535)]
    inside = v != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = np.flatnonzero(first)
    offsets = np.searchsorted(at, starts)
    if not len(at):
        return np.zeros(0, np.uint64), offsets
    powers, inverses = _powers(len(v))
    return mix(np.add.reduceat(v * powers, at) * inverses[at]), offsets


def as_texts(column: pa.Array) -> list[str]:
    """An Arrow column as strings; null counts as the empty text."""
    return [t or "" for t in column.to_pylist()]


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
