"""What several operators share: staged tables, and tokens and hashes of whole Arrow batches of text in numpy.

Texts are handled as UTF-8 bytes. A token is a maximal run of bytes other than space and 0x09-0x0D;
A-Z are lowered, nothing else. Token hashes are polynomial over bytes modulo 2**64, then mixed.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; only a longer single text exceeds it.
GROUP_BYTES = 1 << 20
#: Bytes whose token hashes are computed at once.
SEGMENT = 1 << 18

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, the warehouse, or on a local master a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="waymark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/waymark-work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what `staged` wrote for df, which nothing reads any more."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """df, to be broadcast if it was counted to have so many rows (of some numbers and a short string) at most; else Spark chooses the join."""
    return F.broadcast(df) if df.count() <= rows else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of texts go to Python workers in batches of a few MB; the default of 10,000 rows takes tens of MB on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy() -> None:
    """Gives what a worker has freed back to the system, as workers stay for the stages to come."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's only
        trim(0)


def tidied(run):
    """A function over batches that gives back what the worker has freed, when it is through."""

    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


def bit_table(rows: DataFrame, col: str, bits: int) -> np.ndarray:
    """2**bits bits, eight a byte, lowest first: those whose number stands in the column are set. Bits are gathered on the executors, in pieces of 4 KB."""
    pieces = rows.where(F.col(col).isNotNull()).groupBy(F.shiftright(F.col(col), 15).alias("piece")).agg(F.bitmap_construct_agg(F.col(col).bitwiseAND((1 << 15) - 1)).alias("b"))
    out = np.zeros((max(1, 1 << max(0, bits - 15)), 1 << 12), dtype=np.uint8)
    found = pieces.toArrow()
    for piece, b in zip(found.column("piece").to_pylist(), found.column("b"), strict=True):
        out[piece] = np.frombuffer(b.as_buffer(), dtype=np.uint8)
    return out.ravel()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, base: int = _P) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    p = np.full(n, base & _MASK, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


_POW: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, SEGMENT + 4096)
        p, q = powers(size), powers(size, pow(_P, -1, 1 << 64))
        if size > 4 * SEGMENT:
            return p, q
        _POW["p"], _POW["q"] = p, q
    return _POW["p"], _POW["q"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans data[start:end], which are in order and don't overlap."""
    out = np.zeros(len(start), dtype=np.uint64)
    i, n = 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        p, q = _tables(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * p[: b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


class Texts:
    """A run of rows' texts as one buffer. data: bytes as written, low: with A-Z lowered; offsets: of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.low = _LOWER[data]

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every token, in order."""
        size = len(self.data)
        if not size:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        solid = ~_WS[self.data]
        edge = np.zeros(size + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.empty(size, dtype=bool)
        before[0], before[1:] = True, ~solid[:-1]
        start = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.empty(size, dtype=bool)
        after[-1], after[:-1] = True, ~solid[1:]
        end = np.flatnonzero(solid & (after | edge[1:])) + 1
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8", "replace")


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, dtype=np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, dtype=np.uint8)
    return raw, offsets - first


def groups(batch: pa.RecordBatch, text: str = "text"):
    """(first row, Texts) over runs of rows of about GROUP_BYTES."""
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, side="right")) - 1))
        yield i, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of longs; null is -1 in the array (the operators keep nulls by their own column)."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
    return np.asarray(col.fill_null(-1) if col.null_count else col)


def slices(data: np.ndarray, bounds: np.ndarray, item: int) -> pa.Array:
    """A binary column of data's bytes cut at bounds, which count items of so many bytes."""
    offsets = pa.array((bounds * item).astype(np.int64)).buffers()[1]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data).tobytes())])
