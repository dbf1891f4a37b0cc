"""Shared-folder tables, text chunks and packed blocks for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). One machine may do without, as in tests; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """How many partitions to deal df into: at least the session's, at most `bytes_each` of its size each.

    The size is the plan's estimate. A plan that has none multiplies Spark's stand-in for unknown sizes, or sizes of
    inputs with each other; from a petabyte on the rows' own texts are counted instead, whatever the reason.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 50:
        text = F.coalesce(F.octet_length("text"), F.lit(0)) if "text" in df.columns else F.lit(0)
        size = int(df.agg(F.sum(text + 8 * len(df.columns))).first()[0] or 0)
    return max(least, -(-size // bytes_each))


def document_chunk(n: int) -> Column:
    """The chunk, 0 to n-1, of a row: all rows of a doc_id in one; rows without one, which may be many, by their texts."""
    return F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_PRESS = zstandard.ZstdCompressor(level=1)
_OPEN = zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """An array as compressed byte planes; its dtype is the reader's to know."""
    x = np.ascontiguousarray(x)
    if not len(x):
        return bytes(8)
    return len(x).to_bytes(8, "little") + _PRESS.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    kind = np.dtype(dtype)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(_OPEN.decompress(blob[8:]), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def bits(x: np.ndarray) -> bytes:
    return pack(np.packbits(x)) + len(x).to_bytes(8, "little")


def unbits(blob: bytes) -> np.ndarray:
    return np.unpackbits(unpack(blob[:-8], "u1"))[: int.from_bytes(blob[-8:], "little")].astype(bool)


def settle(forget: bool = True) -> None:
    """Give freed memory back to the system: Python workers wait for their next task, and a waiting worker should be small.

    forget: also drop what an encoder has kept in this worker.
    """
    tokens = sys.modules.get("gavel.llm.tokens")
    if forget and tokens:
        tokens._LOADED.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settled(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f of one group, then settle()."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            settle()

    return run


def settled_pair(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """f of two groups, then settle()."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            settle()

    return run
