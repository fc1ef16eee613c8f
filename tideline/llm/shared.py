"""Helpers of the operators: tables, stored intermediates, words and hashes of texts."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1_500_000
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one, ``spark.checkpoint.dir``. Where that is
    unset (tests on one machine) a temporary folder takes its place. Folders are
    deleted when the driver's Python ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _made.setdefault("local", "file://" + tempfile.mkdtemp(prefix="tideline-"))
    app = spark.sparkContext.applicationId
    base = f"{root.rstrip('/')}/llm-{app}"
    if base not in _made:
        _made[base] = base
        atexit.register(_drop, spark, base)
    return f"{base}/{tag}-{uuid.uuid4().hex[:12]}"


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before: the folder stays for the cluster's own cleaning
        pass


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later uses
    and lost executors cost a read, not the work again. Meanwhile tasks exchange Arrow
    batches of ``BATCH_ROWS`` rows, so a batch of texts takes a few MB on either side. The
    write's shuffle files are dropped as soon as it is done."""
    spark = df.sparkSession
    folder = run_folder(spark, tag)
    before = {k: spark.conf.get(k) for k in (BATCH_SETTING, CLEAN_SETTING)}
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    spark.conf.set(CLEAN_SETTING, True)
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- texts as bytes -------------------------------------------------------


@functools.cache
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """What was freed goes back to the system, as far as the C library can: workers live
    on and would hold the peak of one step through the next ones."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """(slice of the batch, bytes, offsets): rows in pieces of about ``most`` bytes,
    one row at least; null is the empty text. Memory is given back before each batch."""
    give_back()
    at = batch.schema.get_field_index(column)
    texts = batch.column(at)
    sizes = np.diff(_offsets(texts)) if len(texts) else np.zeros(0, np.int64)
    begin = 0
    while begin < len(texts):
        end, held = begin, 0
        while end < len(texts) and (end == begin or held + sizes[end] <= most):
            held += int(sizes[end])
            end += 1
        part = batch.slice(begin, end - begin)
        yield (part, *utf8(part.column(at)))
        begin = end


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    raw = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind one another, and where each begins and the last ends."""
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(texts)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and its row; words never cross rows."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    after[-1:], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        step = np.full(max(n, SLICE_BYTES + 1024), base, np.uint64)
        step[0] = 1
        _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``rolling_hash`` takes the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BACK, len(data), "back"), out=sums[1:])
    return sums


def rolling_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of overlapping spans. Long spans can be made that collide, so it
    serves only where the bytes are compared after it."""
    raw = (sums[ends] - sums[starts]) * _power(_BASE, len(sums), "base")[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


UNROLLED = 4
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span's bytes, the same wherever the span stands: the sum of its
    8-byte blocks, each mixed with its place. Other seeds give independent hashes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    sizes = ends - starts
    key = mix(np.array([seed], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]
    total = np.zeros(len(starts), np.uint64)

    def blocks(at: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        block = words[at] & _MASKS[np.minimum(size, 8)]
        return mix(mix(block + key) ^ mix((number + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + key))

    for k in range(UNROLLED):
        on = np.flatnonzero(sizes > 8 * k)
        if not len(on):
            break
        total[on] += blocks(starts[on] + 8 * k, sizes[on] - 8 * k, np.full(1, k, np.uint64))
    long = np.flatnonzero(sizes > 8 * UNROLLED)
    if len(long):
        many = (sizes[long] + 7) // 8 - UNROLLED
        first = np.cumsum(many) - many
        number = np.arange(int(many.sum())) - np.repeat(first, many) + UNROLLED
        sums = blocks(np.repeat(starts[long], many) + 8 * number, np.repeat(sizes[long], many) - 8 * number, number.astype(np.uint64))
        total[long] += np.add.reduceat(sums, first)
    return mix(total ^ mix(sizes.astype(np.uint64) + key))


_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words; a row with fewer words gives its
    whole sequence as one."""
    total = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        total += words[k : k + len(total)] * _STEP[k]
    whole = rows[: len(total)] == rows[width - 1 :] if len(total) else np.zeros(0, bool)
    hashes, at = mix(total[whole]), rows[: len(total)][whole]
    counts = np.bincount(rows, minlength=n_rows)
    if ((counts > 0) & (counts < width)).any():
        short = counts[rows] < width
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        place = (np.arange(len(rows)) - first[rows])[short]
        sums = np.zeros(n_rows, np.uint64)
        np.add.at(sums, rows[short], words[short] * _STEP[place])
        few = np.flatnonzero((counts > 0) & (counts < width))
        hashes = np.concatenate([hashes, mix(sums[few] + _STEP[40 + counts[few]])])
        at = np.concatenate([at, few])
    return hashes, at


def distinct_in_rows(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered by row, then hash; each hash once in a row."""
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order].astype(np.uint32), kind="stable")]
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[fresh], rows[fresh]


def by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Sums of ``values`` per row, wrapping at 64 bits."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64), out=sums[1:])
    edge = np.searchsorted(rows, np.arange(n_rows + 1))
    return sums[edge[1:]] - sums[edge[:-1]]


def lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, kind))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every linked id: the smallest id that it reaches.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each a
    minimum per node joined back; rounds are stored, so a lost executor costs a read. The
    joins merge at every size, as broadcasts in every round would fill the driver.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        keep = low.where("m < u").select("u", F.col("m").alias("v"))
        edges = large.unionByName(keep).where("u <> v").distinct()
        down = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(down.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("id"), "label").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
        before = now
