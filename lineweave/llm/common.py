"""What the training-data operators share: tables in the shared folder, text arrays, grouped batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that goes to Python: texts can be long, so batches hold few rows.
BATCH_ROWS = 500
#: Bytes of text that a numpy kernel looks at in one go; a longer single text is one piece of its own.
PIECE_BYTES = 2 << 20

_U = np.uint64
with np.errstate(over="ignore"):
    _RADIX = _U(0x9E3779B97F4A7C15)
    _INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds few whole texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share. It is set here only where the session has none and runs in
    one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "local-cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lineweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: later stages don't depend on the executors
    that made them, and no stage before it runs twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._lineweave_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of cut() that no later step reads."""
    for t in tables:
        path = getattr(t, "_lineweave_path", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """The rows as a table of their own; removes the tables of cut() that they were made from."""
    out = cut(df)
    drop(*tables)
    return out


def partitions(df: DataFrame, per: int = 1) -> int:
    """How many partitions to deal rows to: what the session sets for shuffles, which a user sizes to the input."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * per


def filesystem(uri: str):
    """The pyarrow file system and path of a folder of shared_dir()."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- texts as arrays


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, and where each begins, ending with the length. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and at which word each text begins."""
    inside = ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = off[:-1][off[:-1] < off[1:]]
    last = off[1:][off[:-1] < off[1:]] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, r, r^2 ... modulo 2^64, or the same of 1/r."""
    key = "inverse" if inverse else "radix"
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, PIECE_BYTES + 1)
        x = np.full(size, _INVERSE if inverse else _RADIX, _U)
        x[0] = 1
        p = np.cumprod(x, dtype=_U)
        if size > 8 * PIECE_BYTES:
            return p[:n]
        _powers[key] = p
    return _powers[key][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """c so that (c[j] - c[i]) / r^i depends on values[i:j] alone."""
    c = np.zeros(len(values) + 1, _U)
    np.cumsum(values.astype(_U, copy=False) * powers(len(values)), dtype=_U, out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans of a prefix_hash()."""
    return mix64((c[end] - c[start]) * powers(len(c), True)[start])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


# ---------------------------------------------------------------- grouped batches


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by keys, as tables of whole groups with the rows at which groups begin. Groups must have a
    bounded size; the callers split hot ones before."""
    held: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t[k].combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < 20_000:
            continue
        t = pa.Table.from_batches(held)
        at = bounds(t)
        if len(at) > 2:
            yield t.slice(0, at[-2]), at[:-1]
            t = t.slice(at[-2])
        held, rows = t.to_batches(), t.num_rows
        rows = 0 if rows < 20_000 else rows // 2  # a group that has outgrown the batch waits until it has doubled
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield t, bounds(t)


def spread(groups: DataFrame, n: int, keys: list[str], kernel: Callable, schema: str) -> DataFrame:
    """Runs kernel(table, bounds) over groups: rows of one group meet in one task, sorted by the keys."""

    def run(batches):
        for t, at in by_group(batches, keys):
            yield from kernel(t, at)

    return groups.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


# ---------------------------------------------------------------- ordered ranges


def bounds_of(df: DataFrame, key: str, n: int) -> list:
    """At most n - 1 values of key, ascending, that cut its rows into ranges of about equal size."""
    if n < 2:
        return []
    found = df.approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)
    return sorted({int(x) for x in found})


def range_of(key: str, bounds: list):
    """Column: how many of the bounds are at most key (null: none), by a tree of comparisons."""
    from pyspark.sql import functions as F

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))
