"""What the operators share: written intermediate tables, text identity, rolling hashes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir.

    Only a local master, where there is but one machine, may go without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="strandline-"))
    path = f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def save(df: DataFrame, arrow_rows: int = 256, group_rows: int = 0) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: this cuts the lineage, so a lost
    executor costs only the tasks that were running. Batches sent to Python hold `arrow_rows` rows at
    most meanwhile, which bounds a worker's memory when rows are long. Readers take up to 4096 rows of a row
    group at once; `group_rows` bounds a group where so many long rows would not fit."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(arrow_rows))
    try:
        out = df.write.option("compression", "zstd")
        (out.option("parquet.block.row.count.limit", group_rows) if group_rows else out).parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, arrow_rows: int = 256) -> None:
    """For a frame that the caller will write: batches sent to Python hold no more rows from now on."""
    if int(spark.conf.get(ARROW_ROWS)) > arrow_rows:
        spark.conf.set(ARROW_ROWS, str(arrow_rows))


def drop_saved(*frames: DataFrame) -> None:
    """Remove tables that save() wrote and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/strandline-" in f:
                target = spark._jvm.org.apache.hadoop.fs.Path(f)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished jobs now instead of at the driver's next collection."""
    spark._jvm.System.gc()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, a function from batches to batches, which at its end gives the worker's free memory back to the system:
    workers outlive their tasks, and what they hold counts while other stages run."""

    @functools.wraps(run)
    def tidied(frames: Iterator) -> Iterator:
        try:
            yield from run(frames)
        finally:
            release()

    return tidied


def release() -> None:
    """Drop the tables of powers, Arrow's free buffers and the allocator's free pages of this process."""
    global _powers, _inverse
    _powers, _inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: str | Column = "text") -> Column:
    """16 bytes that identify a text: the head of its SHA-256. A null text counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.substring(F.unhex(F.sha2(F.coalesce(col, F.lit("")), 256)), 1, 16)


# -- rolling hashes ----------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, root in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, root, np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64 over bytes that a random table spreads."""
    n = len(data)
    _grow(n + 1)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[:n], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end), the same wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _inverse[start])


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` bytes."""
    n = len(prefix) - width
    return mix((prefix[width:] - prefix[:n]) * _inverse[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about `limit` bytes; a row longer than that stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
