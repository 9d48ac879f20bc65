"""Shared tables, whole-batch tokenising on bytes, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once in a Python worker; a longer text is one chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of one Arrow batch that goes to a Python worker, where the session doesn't say: rows alone don't bound long texts.
BATCH_BYTES, _BATCH_KEY, _DEFAULT = "4MB", "spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", "67108864b")


# --- Python workers ---------------------------------------------------------------------------------------------------

def _release() -> None:
    """Gives back what a task has freed; workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def in_arrow(df: DataFrame, work: Callable, schema) -> DataFrame:
    """df.mapInArrow(work, schema) with batches bounded by bytes, and memory given back after each task."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            _release()

    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) in _DEFAULT:  # a session that says otherwise keeps what it says
        conf.set(_BATCH_KEY, BATCH_BYTES)
    return df.mapInArrow(run, schema)


# --- tables in the shared folder -------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own in local mode, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no more than their running tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)

    def table(self, df: DataFrame) -> DataFrame:
        """df, written once and read back with its own schema (also when it is empty)."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # for drop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later step reads."""
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


# --- bytes, words and hashes -----------------------------------------------------------------------------------------

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are hashed with those of all other words at once; longer words are hashed one by one.
_AT_ONCE = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_hash(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each byte range: its 8-byte blocks go one after the other through mix(), so that, unlike with a polynomial,
    no family of strings is known to collide; two given ones do with a chance of 2**-64."""
    h = mix(size.astype(np.uint64) * _ODD)
    blocks = np.lib.stride_tricks.as_strided(np.append(buf, np.zeros(8, np.uint8)), (len(buf) + 1, 8), (1, 1))
    todo, at = np.arange(len(start)), 0
    long = np.flatnonzero(size > _AT_ONCE)
    for i in long.tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i] : start[i] + size[i]].tobytes())
    if len(long):
        todo = np.flatnonzero(size <= _AT_ONCE)
    while len(todo):
        left = size[todo] - at
        block = np.ascontiguousarray(blocks[start[todo] + at]).view("<u8")[:, 0]
        block &= _FULL >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        h[todo] = mix((h[todo] ^ block) * _ODD + np.uint64(at + 1))
        todo = todo[left > 8]
        at += 8
    return h


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a followed by b."""
    return mix(a * _ODD + mix(b ^ np.uint64(0xD1B54A32D192ED03)))


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of several texts: byte ranges, the text each belongs to, and a 64-bit hash of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool, hashed: bool = True, between: np.ndarray = _WS):
        """between: which bytes stand between words."""
        self.buf, self.offsets, self.docs = buf, offsets, len(offsets) - 1
        n = len(buf)
        ws = between[buf]
        before, after = np.empty(n + 1, bool), np.empty(n + 1, bool)
        before[0] = after[n - 1 :] = True
        before[1:] = ws
        after[: max(0, n - 1)] = ws[1:]
        before[offsets[:-1]] = True
        after[(offsets[1:] - 1)[offsets[1:] > 0]] = True
        self.start = np.flatnonzero(~ws & before[:n])
        self.end = np.flatnonzero(~ws & after[:n]) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.docs)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        if hashed:
            self.hash = byte_hash(LOWER[buf] if lower else buf, self.start, self.end - self.start)

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """A hash of the k words from each word on; those that run over the end of a text have no meaning (see inside()). Hashes
        of 1, 2, 4, ... words are chained, so k costs its logarithm. Other seeds give hashes that say nothing of one another."""
        w = mix(self.hash + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)) if seed else self.hash
        m = len(w) - k + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        done, acc, width = 0, None, 1
        while True:
            if k & width:
                part = w[done : done + m]
                acc = part if acc is None else follow(acc, part)
                done += width
            if done == k:
                return mix(acc + np.uint64(k))
            w = follow(w[:-width], w[width:])
            width *= 2

    def inside(self, k: int) -> np.ndarray:
        """Which starts have all their k words in one text."""
        m = max(0, len(self.start) - k + 1)
        return self.doc[:m] == self.doc[k - 1 : k - 1 + m]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with at most limit bytes, or of one longer row; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    off = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, len(texts))
        yield i, whole[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# --- connected components --------------------------------------------------------------------------------------------


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links(a, b), for every node with a link to another.

    Alternating large-star and small-star rounds on DataFrames: every round is one aggregation and one join, and its
    edges are written to the shared folder, so nothing is collected and lineage stays short. Rounds grow with the
    logarithm of the number of nodes in a component.
    """
    edges = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.table(small.select("e.u", "e.v").where("u <> v").distinct())
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        scratch.drop(edges)
        edges = after
        if now == before:
            break
        before = now
    root = edges.groupBy("u").agg(F.min("v").alias("component"))
    return root.select(F.col("u").alias("node"), "component").union(root.select(F.col("component").alias("node"), "component").distinct())
