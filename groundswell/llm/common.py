"""Pieces that several document operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, unchanged, as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is set, a local session (tests) gets a folder of its own; a cluster an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not found and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key): text with null as empty, and a 64-bit key that tells rows of one doc_id apart."""
    text = text_or_empty("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


# --- vectorised text, for mapInArrow -------------------------------------------------

#: Bytes of a batch sent to a Python worker, where the session has Spark's default: each task holds one on both sides.
BATCH_BYTES, _DEFAULT_BYTES, _BATCH_KEY = "4m", "67108864b", "spark.sql.execution.arrow.maxBytesPerBatch"


def _give_back() -> None:
    """Freed memory goes back to the system: workers are reused by later stages, which share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes, which stay set in the session; a worker keeps its caches alone after a task."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, _DEFAULT_BYTES) == _DEFAULT_BYTES:
        conf.set(_BATCH_KEY, BATCH_BYTES)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(lean, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of blocks of whole texts of about ``most`` bytes; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a block, and each text's first word (with the end, one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Masks of the lowest n bytes, and salts of the places of 8-byte pieces in a word (beyond them, made from the place).
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits for each word, from its bytes alone: pieces of eight bytes are mixed with their places, summed, and mixed with the length.

    Mixing is not linear, so words of a few letters in different orders don't meet as they do under polynomials
    modulo 2**64. Hashes of different ``salt`` are independent of each other."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each byte on
    sizes = ends - starts
    pieces = (sizes + 7) >> 3
    first = np.cumsum(pieces) - pieces
    if len(first) == int(pieces.sum()):
        place, begin, left = np.zeros(len(starts), np.uint64), starts, sizes
    else:
        word = np.repeat(np.arange(len(starts)), pieces)
        place = (np.arange(len(word)) - first[word]).astype(np.uint64)
        begin = starts[word] + 8 * place.astype(np.int64)
        left = ends[word] - begin
    value = at_byte[begin] & _LOW[np.minimum(left, 8)]
    key = mix(np.array([salt], np.uint64) + _STEP)[0]
    value = mix((value ^ key) + mix(place * _ODD + key))
    total = value if len(value) == len(starts) else np.add.reduceat(value, first)
    return mix(total ^ (sizes.astype(np.uint64) * _STEP + key))


def prefix_bytes(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` bytes (16 at most) from each of ``starts``, as two integers of eight; they lie inside ``data``."""
    at_byte = np.ndarray((len(data) + 8,), "<u8", buffer=np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
    low = at_byte[starts] & _LOW[min(n, 8)]
    return low, at_byte[starts + 8] & _LOW[n - 8] if n > 8 else np.zeros(len(starts), np.uint64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two that follow each other."""
    return mix(a * _ODD + (b ^ (b >> np.uint64(29))) * _STEP)


def window_hashes(each: np.ndarray, length: int) -> np.ndarray:
    """64 bits for each run of ``length`` hashes (runs that cross texts are the caller's to leave out), by doubling:
    a run's hash is made of its halves', and of the binary digits of ``length`` the larger come first."""
    m = len(each) - length + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, at, have, size = None, 0, mix(each), 1
    parts = []
    while size <= length:
        if length & size:
            parts.append((size, have))
        if size * 2 <= length:
            have = _joined(have[: len(have) - size], have[size:])
        size *= 2
    for size, part in reversed(parts):
        own = part[at : at + m]
        out = own if out is None else _joined(out, own)
        at += size
    return mix(out ^ np.uint64(length))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join that adaptive execution can split where a key is hot.

    A side that was grouped by the same keys would be joined as it lies, and then its partitions can't be split; a
    second key derived from the first (one bit, so that rows stay short) makes the join deal out both sides itself.
    """
    tag = F.xxhash64(*keys) > 0
    return left.withColumn("_tag", tag).join(right.withColumn("_tag", tag), ["_tag", *keys], how).drop("_tag")
