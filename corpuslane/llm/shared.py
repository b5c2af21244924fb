"""What several operators need: the shared folder, written tables, bit filters and column names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTER_BITS = 1 << 26
SLICE_WORDS = 1 << 10
ARROW_BYTES = 8 << 20
_SENT: set[str] = set()
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Only a one-machine session without that setting gets a folder of its own; on a cluster the
    missing setting is an error, since executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: int) -> DataFrame:
    """``df`` written once to the shared folder, with options of the writer, and read back: lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> None:
    """Send this package to the executors once, and bound Arrow batches by bytes, so that long
    texts do not pile up in a Python worker."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in package.rglob("*.py"):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(str(target))
        _SENT.add(context.applicationId)
    if int(spark.conf.get(_ARROW).rstrip("bB")) > ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))


def row_of(df: DataFrame, *outputs: str) -> Column:
    """All columns of ``df`` as one struct, without those that an operator is about to add, in any
    letter case. Inside it they cannot clash with an operator's own columns; ``_row.*`` gives them back."""
    taken = {n.lower() for n in outputs}
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]).alias("_row")


def row_key(*columns: Column) -> Column:
    """A 64-bit key of a row's identity: the same for repeated rows only."""
    flags = [c.isNull() for c in columns]
    return F.xxhash64(*flags, *columns)


def bit_filter(df: DataFrame, column: str, bits: int = FILTER_BITS) -> Broadcast:
    """A bitmap of the hashed longs in ``column``, for dropping rows before a shuffle.

    Its size is ``bits`` / 8 bytes whatever the input; when it fills up it only drops less, so
    the join behind it decides. Bits are set in the tasks, slice by slice; the driver
    receives at most ``bits`` / 8 bytes.
    """
    if bits % (64 * SLICE_WORDS):
        raise ValueError(f"bits must be a multiple of {64 * SLICE_WORDS}")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            put(own, np.asarray(batch.column(0)).view(np.uint64))
        for at in np.flatnonzero(own.reshape(-1, SLICE_WORDS).any(axis=1)):
            yield pa.record_batch([pa.array([at], pa.int64()), pa.array([own[at * SLICE_WORDS : (at + 1) * SLICE_WORDS].tobytes()])], ["slice", "bits"])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, own in _or_runs(parts):
            yield pa.record_batch([pa.array([at], pa.int64()), pa.array([own.tobytes()])], ["slice", "bits"])

    kind = "slice long, bits binary"
    ready(df.sparkSession)
    slices = df.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(gather, kind)
    slices = slices.repartition(F.col("slice")).sortWithinPartitions("slice").mapInArrow(merge, kind)
    whole = np.zeros(bits // 64, np.uint64)
    for row in slices.collect():
        whole[row["slice"] * SLICE_WORDS : (row["slice"] + 1) * SLICE_WORDS] |= np.frombuffer(row["bits"], np.uint64)
    return df.sparkSession.sparkContext.broadcast(whole)


def _or_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    at, own = -1, np.zeros(SLICE_WORDS, np.uint64)
    for batch in parts:
        for s, b in zip(batch.column(0).to_pylist(), batch.column(1)):
            if s != at:
                if at >= 0:
                    yield at, own
                at, own = s, np.zeros(SLICE_WORDS, np.uint64)
            own |= np.frombuffer(b.as_buffer(), np.uint64)
    if at >= 0:
        yield at, own


def put(bitmap: np.ndarray, hashes: np.ndarray) -> None:
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    np.bitwise_or.at(bitmap, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))


def held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def in_filter(bitmap: Broadcast) -> Callable[..., Column]:
    """Whether a column of hashed longs passes a bit filter; nulls do not."""

    def run(keys: pa.Array) -> pa.Array:
        return pa.array(held(bitmap.value, np.asarray(pc.fill_null(keys, 0)).view(np.uint64)) & np.asarray(pc.is_valid(keys)))

    return F.arrow_udf(run, returnType="boolean")


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list array whose rows take ``counts`` values each, in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def struct_udf(fn: Callable[..., pa.Array], fields: str) -> Callable[..., Column]:
    """An Arrow function of columns that returns a struct column with ``fields``."""
    return F.arrow_udf(fn, returnType=T.StructType.fromDDL(fields))
