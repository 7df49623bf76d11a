"""Shared pieces of the training-data operators: Arrow batch mapping, stored tables, byte buffers, code tables.

Every helper works on whole texts. Python runs only on Arrow batches inside
tasks; Spark partitions and shuffles the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelrank.session import scratch_path, ship_package

# Upper bound on one Arrow batch sent to a Python worker; a single longer row still travels whole.
BATCH_BYTES = 16 * 1024 * 1024
# Bytes handled by one vectorised numpy step, whatever the document lengths.
STEP_BYTES = 1 << 20


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, so that long documents cannot fill a worker; let workers import this package. A lower
    bound that is set already stays."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) > limit:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared checkpoint folder and read it back: a lineage cut that survives lost
    executors. The table is removed when the application ends, or by `discard`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables whose every result is stored itself: nothing may read them again, lost executors included."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_memory() -> None:
    """Give freed memory of a Python worker back to the system: workers are reused, and the C library otherwise keeps the
    peak of every earlier group."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_mod(col: str | Column, m: int) -> Column:
    """crc32 of the value's text, modulo m; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def map_batches(df: DataFrame, inputs: dict[str, Column], outputs: dict[str, T.DataType],
                fn: Callable[..., list[pa.Array]], keep: list[str]) -> DataFrame:
    """Columns `keep` of df followed by `outputs`, computed batch by batch from the `inputs` expressions.

    `fn(*arrays)` gets one Arrow array per input and returns one per output, as long as the input. A kept column with
    the name of an output is replaced by the output.
    """
    bounded_batches(df.sparkSession)
    keep = [c for c in keep if c not in outputs]
    schema = T.StructType([T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
                          + [T.StructField(c, t) for c, t in outputs.items()])
    n_keep, n_in = len(keep), len(inputs)
    selected = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
                         *[c.alias(f"_in_{i}") for i, c in enumerate(inputs.values())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()  # of what the worker did before
        for b in batches:
            if b.num_rows:
                made = fn(*[b.column(n_keep + i) for i in range(n_in)])
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n_keep)] + made, names=names)
                del made
        free_memory()

    out = selected.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c) for c in outputs])


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary array as one buffer, and the row offsets in it; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def row_blocks(off: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows holding at most `limit` bytes, or one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting (numpy's own hashes them, which takes several times as long and more memory)."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


class CodeTable:
    """Row numbers of distinct 64-bit codes by open addressing in numpy arrays (bounded: 4 to 8 slots a code)."""

    def __init__(self, codes: np.ndarray):
        codes = codes.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.row = np.full(1 << bits, -1, np.int32)
        todo, pos = np.arange(len(codes)), self._slot(codes)
        while len(todo):
            free = self.row[pos[todo]] < 0
            tried = todo[free]
            at = pos[tried]
            self.row[at] = tried
            won = self.row[at] == tried
            self.keys[at[won]] = codes[tried[won]]
            todo = np.concatenate([todo[~free], tried[~won]])
            pos[todo] = (pos[todo] + 1) & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 where it is not in the table."""
        codes = codes.astype(np.uint64, copy=False)
        pos = self._slot(codes)
        out = self.row[pos]
        left = np.flatnonzero((out >= 0) & (self.keys[pos] != codes))
        while len(left):
            at = (pos[left] + 1) & self.mask
            pos[left] = at
            out[left] = self.row[at]
            left = left[(out[left] >= 0) & (self.keys[at] != codes[left])]
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply-xorshift), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# -- words as 64-bit hashes, computed for many documents in one vectorised pass ---------------------------------------

_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the rolling-hash base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, STEP_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def prefix_hash(buf: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """S with S[j] - S[i] = base**i times the hash of buf[i:j], modulo 2**64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value[buf] * powers(len(buf))[0][: len(buf)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span; equal spans have equal hashes wherever they stand."""
    return (s[end] - s[start]) * powers(len(s) - 1)[1][start]


def word_spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (maximal run without `space` bytes, inside one document), and words per document."""
    word = ~space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.zeros(len(buf), bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, off))


def word_hashes(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixed hash of every A-Z-lower-cased word, with its start, end and the words per document."""
    low = LOWER[buf]
    start, end, n = word_spans(low, off, space)
    return mix64(span_hash(prefix_hash(low), start, end)), start, end, n


# Words for matching edited text: every ASCII byte that is neither letter nor digit separates.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_SHINGLE_ODD = np.array([pow(0xD1342543DE82EF95, k + 1, 2**64) | 1 for k in range(64)], np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of one document; of the whole sequence, if it is shorter."""
    k = min(k, len(words))
    if k == 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h += words[i: len(words) - k + 1 + i] * _SHINGLE_ODD[i]
    return mix64(h)


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0)


def parts_for(total: int, each: int) -> int:
    return max(1, -(-int(total) // each))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Even split of 64-bit hashes into shards by their upper half."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, last + 1) of sorted keys; shard_of rises with the key."""
    s = shard_of(keys, shards)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]]) if len(s) else np.zeros(1, int)
    for i, j in zip(cut[:-1], cut[1:]):
        yield int(s[i]), int(i), int(j)
