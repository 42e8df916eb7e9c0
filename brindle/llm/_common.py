"""Shared tools of the llm operators: materialised tables, id filters, vectorised word and
shingle hashing, and connected components."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir of the session.  Where it is unset, a local session
    (in tests) gets one of our own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "brindle-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; removed when this driver process ends."""
    path = f"{shared_dir(spark)}/brindle-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path with Hadoop's file system, so that any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone at exit
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and outlives executors.

    Not compressed: these tables hold hashes and ids, and native compressors cost memory."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "none").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_brindle_path", None)
        if path:
            remove(t.sparkSession, path)


#: Rows and bytes that go to a Python worker at once: buffers on both sides grow with them.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Let the session send small Arrow batches, so that a worker's memory does not depend on how long the
    texts are; an even smaller setting stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def least_hashes(df: DataFrame, key: str, k: int, total: int) -> DataFrame:
    """The k rows of the least hashes `key` (uniform longs) of a table of `total` rows.

    A threshold from the number of rows comes first, so that a partition sends few more than its share and
    not k rows.  Rows that share a hash may leave fewer than k."""
    share = (k + 10 * math.sqrt(k) + 10) / max(total, 1)
    if share < 1:
        df = df.where(F.col(key) <= int(share * 2.0**64) - 2**63)
    return df.orderBy(key).limit(k)


# --------------------------------------------------------------------------- id filters

MAX_FILTER_BITS = 1 << 25  # 4 MB of bitmap at most, whatever the number of ids


def keep_probable(df: DataFrame, key: str, ids: DataFrame, n_ids: int) -> DataFrame:
    """Rows of df whose key may be among ids: those that mark_probable() marks."""
    return mark_probable(df, key, ids, n_ids, "_maybe").where("_maybe").select(*df.columns)


def mark_probable(df: DataFrame, key: str, ids: DataFrame, n_ids: int, name: str) -> DataFrame:
    """df with a boolean `name`: whether the key may be among ids (one column, same type), by a one-hash
    bitmap.

    The bitmap has 16 bits an id up to MAX_FILTER_BITS, so it is broadcast under a fixed bound.
    False positives are marked too (the caller's join decides); no id of the list is missed."""
    bits = 1 << 15
    while bits < min(16 * max(n_ids, 1), MAX_FILTER_BITS):
        bits <<= 1
    col = ids.columns[0]
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = (
        ids.select(bit(F.col(col)).alias("b"))
        .groupBy((F.col("b") / 32768).cast("long").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.pmod("b", F.lit(32768))).alias("_map"))
    )
    pos = F.pmod("_bit", F.lit(32768))
    byte = F.conv(F.hex(F.substring("_map", (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn("_bit", bit(F.col(key)))
        .withColumn("_bucket", (F.col("_bit") / 32768).cast("long"))
        .join(F.broadcast(maps), "_bucket", "left")
        .select(*df.columns, F.coalesce(byte.bitwiseAND(F.pow(F.lit(2.0), F.pmod("_bit", F.lit(8))).cast("int")) != 0, F.lit(False)).alias(name))
    )


# --------------------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, component): the smallest id reachable, for every id of the edge list.

    Alternating large-star and small-star contraction; each round is two aggregations and two
    joins over the edges, written to the shared folder, and neighbourhoods are never gathered."""
    x, y = F.col(a), F.col(b)
    cur = materialise(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = materialise(small, "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(cur)
        cur = nxt
        if now == mark or now[0] == 0:
            break
        mark = now
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# --------------------------------------------------------------------------- text in Arrow

SEGMENT = 1 << 19  # bytes hashed at once


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string array without copies; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def row_slices(arr: pa.Array, limit: int = SEGMENT):
    """Bounds (lo, hi) of runs of rows of at most `limit` bytes of text, or of one longer row, so that
    what is computed for a batch does not grow with it."""
    _, off = string_buffers(arr)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def _rng_u64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = _rng_u64(11, 256)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng_u64(12, 64) | np.uint64(1)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, SEGMENT)
        _POW[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, r, np.uint64)))) for r in (_R, _R_INV)]
    return _POW[0], _POW[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _segment_words(buf: np.ndarray, breaks: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in one segment; breaks: document starts in it."""
    solid = ~_SPACE[buf]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    before[breaks] = False
    first = np.flatnonzero(solid & ~before)
    if not len(first):
        return np.zeros(0, np.uint64), first
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[breaks[breaks > 0] - 1] = False
    last = np.flatnonzero(solid & ~after)
    pw, inv = _powers(len(buf))
    value = (_FOLDED if fold else _BYTE)[buf] * pw[: len(buf)]
    total = np.cumsum(value)
    h = (total[last] - total[first] + value[first]) * inv[first]
    return mix64(h + (last - first + 1).astype(np.uint64) * _R), first


def word_hashes(data: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+` and, per document, the bounds of its words.

    Works through segments of about SEGMENT bytes, cut at document starts or else at blanks, so
    memory stays bounded for texts of any length.  fold: A-Z count as a-z."""
    parts, at = [], []
    lo, end = int(off[0]), int(off[-1])
    while lo < end:
        hi = min(lo + SEGMENT, end)
        if hi < end:
            cut = int(off[np.searchsorted(off, hi, "right") - 1])
            if cut > lo:
                hi = cut
            else:
                stop = int(off[np.searchsorted(off, lo, "right")])
                step = hi
                while True:
                    blank = np.flatnonzero(_SPACE[data[step : min(step + SEGMENT, stop)]])
                    if len(blank):
                        hi = step + int(blank[0])
                        break
                    step += SEGMENT
                    if step >= stop:
                        hi = stop
                        break
        inside = off[np.searchsorted(off, lo, "left") : np.searchsorted(off, hi, "left")] - lo
        h, first = _segment_words(data[lo:hi], np.unique(inside), fold)
        parts.append(h)
        at.append(first + lo)
        lo = hi
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    first = np.concatenate(at) if at else np.zeros(0, np.int64)
    return h, np.searchsorted(first, off)


def _times_r(k: int) -> np.uint64:
    return np.uint64(k * int(_R) & (1 << 64) - 1)


def shingles(w: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the word n-grams of one document in order; with fewer words, of the whole
    sequence; none without words."""
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, _times_r(k), np.uint64)
    for j in range(k):
        h += w[j : len(w) - k + 1 + j] * _PLACE[j]
    return mix64(h)


def all_shingles(w: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of many documents at once: hashes and per-document bounds."""
    count = np.diff(bounds)
    m = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(m)))
    out = np.empty(out_at[-1], np.uint64)
    if len(w) >= n:
        h = np.full(len(w) - n + 1, _times_r(n), np.uint64)
        for j in range(n):
            h += w[j : len(w) - n + 1 + j] * _PLACE[j]
        h = mix64(h)
        long = np.flatnonzero(count >= n)
        pos = np.repeat(bounds[:-1][long] - out_at[:-1][long], m[long])
        slot = np.repeat(out_at[:-1][long], m[long]) + _ramp(m[long])
        out[slot] = h[slot + pos]
    for d in np.flatnonzero((count > 0) & (count < n)):
        out[out_at[d]] = shingles(w[bounds[d] : bounds[d + 1]], n)[0]
    return out, out_at


def _ramp(m: np.ndarray) -> np.ndarray:
    """0..m[0]-1, 0..m[1]-1, ..."""
    if not len(m):
        return np.zeros(0, np.int64)
    ends = np.cumsum(m)
    return np.arange(ends[-1]) - np.repeat(ends - m, m)
