"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset (local mode)."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="cohortmill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends at most 1000 rows at once to Python workers, as whole texts go there; a smaller number stays."""
    if int(spark.conf.get(_BATCH_ROWS)) not in range(1, 1001):
        spark.conf.set(_BATCH_ROWS, "1000")


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that a lost executor costs no recomputation of its lineage.

    Nothing reads the shuffle files of the write again, so Spark deletes them as it ends; the session's own setting stays.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing will read again, as all that was made of them is materialised."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, a null text read as empty; all other columns are left out."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def checked_broadcast(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """`df` with a broadcast hint where it has at most `rows` rows, and whether it has."""
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df), small


# ---- numpy kernels over the bytes of a batch of texts -------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of _P and of its inverse modulo 2 ** 64, kept for the next call."""
    if not _TABLES or len(_TABLES[0]) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        size = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            _TABLES[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64))), dtype=np.uint64) for x in (_P, inverse)]
    return _TABLES


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which `is_word` (256 booleans) holds."""
    w = np.zeros(len(data) + 2, bool)
    w[1:-1] = is_word[data]
    edges = np.flatnonzero(w[1:] != w[:-1])
    return edges[::2], edges[1::2]


def running_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power up to each place, from which `span_hashes` takes differences."""
    run = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        x = data.astype(np.uint64)
        x += np.uint64(1)
        x *= _powers(len(data) + 1)[0][: len(data)]
        np.cumsum(x, out=run[1:])
    return run


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, run: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands: differences of running sums of byte times power, moved to the origin. `run`, of `running_sums`, can be given where several kinds of spans are hashed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    run = running_sums(data) if run is None else run
    with np.errstate(over="ignore"):
        h = (run[ends] - run[starts]) * _powers(len(data) + 1)[1][starts]
        return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time through `mix64`; no sums, so no words are made to collide by their structure. Words of over 256 bytes by BLAKE2."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix64(size.astype(np.uint64) + _P)
        left = np.flatnonzero(size <= 256)
        for j in range(0, 256, 8):
            left = left[size[left] > j]
            if not len(left):
                break
            rest = np.minimum(size[left] - j, 8).astype(np.uint64)
            lane = lanes[starts[left] + j] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * rest))
            h[left] = mix64((h[left] ^ lane) * _P + np.uint64(j + 1))
    for i in np.flatnonzero(size > 256):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct n-word shingles, sorted; a shorter sequence counts as one shingle; no words, none."""
    if len(words) < n:
        n = len(words)
    if not n:
        return words
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = mix64(h + words[i : len(words) - n + 1 + i]) * _P
    return np.unique(mix64(h))


def tidy() -> None:
    """Gives back what a finished piece of work leaves in the pools of a Python worker, which goes on with other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(work):
    """A function on batches that tidies up when it ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            tidy()

    return run


def text_blocks(batches, chars: int = 300_000):
    """Batches of (id, text) as runs of whole rows of about `chars` characters: (id column slice, texts). A longer text stands alone."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            b = batch.slice(at, 1000)
            texts = b.column(1).to_pylist()
            start, held = 0, 0
            for i, t in enumerate(texts):
                if i > start and held + len(t) > chars:
                    yield b.column(0).slice(start, i - start), texts[start:i]
                    start, held = i, 0
                held += len(t)
            if start < len(texts):
                yield b.column(0).slice(start), texts[start:]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, a space after each, and where each text starts, with the end of all as the last."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=at[1:])
    return np.frombuffer(b" ".join(raw) + b" ", np.uint8), at
