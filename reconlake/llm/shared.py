"""Helpers that the operators of this subpackage share: tables, the shared folder, ragged arrays."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's `spark.checkpoint.dir`, as a full address.

    Spark itself completes the setting (a path without a scheme is one of the default file system) and makes the
    session's own folder in it. Where the session names none (tests on one machine), a temporary folder
    becomes the checkpoint folder of the session.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="reconlake-"))
    named = context.getCheckpointDir()
    return named.replace("file:/", "file:///", 1) if named.startswith("file:/") and not named.startswith("file://") else named


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path for one run's tables or files in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks_for(rows: int, per_block: int) -> int:
    """How many blocks of about `per_block` rows hold `rows` rows; 1 at least."""
    return max(1, -(-rows // per_block))


def spread(columns: list[str], blocks: int, seed: int = 7) -> Column:
    """A block number from 0 to `blocks` - 1 by a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), F.lit(blocks)).cast("int")


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after the other, and where each begins, with the end; a null text counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_slices(offsets: np.ndarray, most_bytes: int):
    """Row ranges (first, past last) whose texts hold about `most_bytes` at most; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        past = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        past = min(max(past, first + 1), n)
        yield first, past
        first = past


def release() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def give_back() -> None:
    """The same with unreachable objects: reused workers wait beside the executor's JVM and should be small then."""
    gc.collect()
    release()


#: What empties tables that a worker process keeps between tasks of one kind.
CACHES: list = []


def frugal(work):
    """`work`, a function over batches for one task: tables kept for tasks of another kind go first, freed memory at its end."""

    def run(batches):
        for forget in CACHES:
            forget()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
