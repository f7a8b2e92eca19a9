"""Helpers shared by the training-data operators: staging in the shared folder, Arrow text
buffers as numpy arrays, and vectorised word splitting and hashing."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship as ship_package
from ..sources.io import shared_dir

#: Text handled at once by the numpy code, in bytes (a longer document is handled alone).
CHUNK_BYTES = 1 << 20

_staged: dict[str, list[tuple[SparkSession, str]]] = {}
_owner: ContextVar[str] = ContextVar("owner", default="")


#: Rows of an Arrow batch: documents can be long, and a batch is held whole by a Python worker.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors and bound the batches their Python workers get: a setting
    of the session, which its other queries get too (a lower one of the session's own stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    ship_package(spark)


def lean(run):
    """``run`` over batches, after whose last one the worker returns free memory to the system:
    workers outlive their tasks, and what idle ones hold counts as well."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # a C library without it

    return held


@contextmanager
def staging_for(owner: str):
    """What is staged within belongs to ``owner``, for ``release_staged``."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/inkveil-{uuid.uuid4().hex[:12]}-{name}"
    _staged.setdefault(_owner.get(), []).append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor
    costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_staged(owner: str) -> None:
    """Delete what ``owner`` has staged.  Only for callers that have written the owner's results."""
    for spark, path in _staged.pop(owner, []):
        delete_path(spark, path)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with underscores in front until no column has the name (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- Bloom filters

#: Bits a key, hashes, and the largest filter: 64 MB.  Beyond 45 million keys a filter of that size
#: rules out less, and more rows go the exact way that follows every filter.
FILTER_BITS, FILTER_HASHES, FILTER_MOST = 12, 4, 1 << 29


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """FILTER_HASHES bit places for each 64-bit key."""
    h = mix(keys)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(FILTER_HASHES)], 1).astype(np.int64)


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bloom filter over the one column (long) of a staged table, sized by its rows: at most
    FILTER_MOST bits come to the driver."""
    bits = max(1 << 16, min(FILTER_MOST, 1 << (FILTER_BITS * max(1, keys.count()) - 1).bit_length()))

    def places(batches):
        for batch in batches:
            p = np.unique(_places(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits).ravel())
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([pa.array((p >> 6).astype(np.int32)), pa.array((np.uint64(1) << (p & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    words = keys.mapInArrow(lean(places), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys the filter does not rule out."""
    p = _places(keys, 64 * len(words))
    with np.errstate(over="ignore"):
        return ((words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def may_have(words: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which identifiers the filter does not rule out; never null ones."""
    return may_hold(words, ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & np.asarray(ids.is_valid())


def split_rows(df: DataFrame, test) -> tuple[DataFrame, DataFrame]:
    """(rows that fail, rows that pass) a test of Arrow batches: two narrow scans."""

    def scan(wanted: bool):
        def run(batches):
            for batch in batches:
                ok = test(batch)
                yield batch.filter(pa.array(ok if wanted else ~ok))

        return df.mapInArrow(lean(run), df.schema)

    return scan(False), scan(True)


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose identifier is not in the one column of ``ids``: a filter over the
    identifiers lets most rows stay where they are, and only the rest are joined."""
    (key,) = free_names(docs.columns, "gone")
    gone = stage(ids.select(F.col(ids.columns[0]).cast("long").alias(key)).distinct(), "gone")
    held, at = docs.sparkSession.sparkContext.broadcast(key_filter(gone)), docs.columns.index(id_col)
    clear, maybe = split_rows(docs, lambda batch: may_have(held.value, batch.column(at).cast(pa.int64())))
    return clear.unionByName(maybe.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a row: (starts, ends, runs before each row)."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    edge = mask.copy()
    edge[1:] &= ~mask[:-1] | cut[1:n]
    starts = np.flatnonzero(edge)
    last = mask.copy()
    last[:-1] &= ~mask[1:] | cut[1:n]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e] for each span: a polynomial from prefix sums, then mixed.  Equal
    bytes give equal hashes; callers verify bytes where unequal spans must not meet."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
