"""What the operators share: tables in the cluster's shared folder, word bounds and hashes in NumPy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1
#: Rows that a function of arrow_map gets at once, and bytes of a batch between the JVM and Python, both ends of which hold it.
SLICE, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what setCheckpointDir was given; one of our own only where neither is set."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="tokenpress-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Tables of one run, under the shared folder. Saving cuts lineage; a lost executor costs no more than the tasks it ran."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tokenpress/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """did: doc_id, or the largest long if null. th: a hash of the text. Together they name a document in joins; equal rows are one document."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"),
        F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"), *more,
    )


def doc_id(col: str = "did") -> F.Column:
    return F.when(F.col(col) != LAST, F.col(col)).alias("doc_id")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns, given as a dict of arrays or lists; an iterator of such dicts makes several batches.
    The function gets slices of SLICE rows, so that what it makes of a batch of long texts stays small."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                made = fn(batch.slice(i, SLICE))
                yield from [made] if isinstance(made, dict) else made

    return arrow_map_all(df, each, schema)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch, if it is higher: its other limit, rows, bounds nothing where texts are
    long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def arrow_map_all(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """arrow_map with a function from all batches of a partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for cols in fn(batches):
                yield as_batch(cols)
        finally:
            give_back()

    def as_batch(cols: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and executors count what they hold."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives no bytes."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most so much together, or of one."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept by the worker."""
    import sys

    kept = sys.__dict__.setdefault("_tokenpress_powers", {})
    if len(kept.get("p", ())) < n:
        n = max(n, 1 << 20)
        for k, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            kept[k] = np.cumprod(a)
    return kept["p"], kept["q"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of UTF-8 bytes."""
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word, whatever its place."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    p, q = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=total[1:])
    return mixed((total[ends] - total[begins]) * q[begins])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1] * _ODD[0]
    for i in range(1, n):
        out = out + h[i : len(h) - n + 1 + i] * _ODD[i]
    return mixed(out)
