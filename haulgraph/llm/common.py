"""Shared pieces: written cut points, byte-level tokens, packed columns, connected components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local session without one gets its own."""
    if top := spark.conf.get("spark.checkpoint.dir", None):
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir: a folder that the driver and all executors share")
    return "/tmp/checkpoints"


class Scratch:
    """Tables written to the cluster's shared checkpoint folder to cut lineage.

    A written table survives the loss of any executor. ``drop`` removes those that are no longer read, ``only`` all but
    some of those written since ``mark``; what a lazy result still reads stays until ``close`` or the driver's exit.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name = f"haulgraph-{uuid.uuid4().hex}"
        self.root = f"{checkpoint_dir(spark)}/{self.name}"
        self.count = 0
        self.held: dict[int, str] = {}
        atexit.register(self.close)

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        self.held[self.count] = path
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_number = self.count
        return out

    def mark(self) -> int:
        return self.count

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._remove(self.held.pop(df._scratch_number, None))

    def only(self, mark: int, *frames: DataFrame) -> None:
        """Of the tables written since ``mark``, only ``frames`` stay."""
        kept = {df._scratch_number for df in frames}
        for k in [k for k in self.held if k > mark and k not in kept]:
            self._remove(self.held.pop(k))

    def close(self) -> None:
        self.held = {}
        self._remove(self.root)

    def _remove(self, path: str | None) -> None:
        if path is None:
            return
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone at exit; only clean-up is lost
            pass


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores after it, so that no column of ``frames`` has it (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def trim() -> None:
    """Give freed memory back to the system, so that an idle worker holds little of what its last task used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(f):
    """``f``, over batches or a group, with memory given back after it."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(it)
        finally:
            trim()

    return batches


def tidy_group(f):
    def group(*tables: pa.Table) -> pa.Table:
        try:
            return f(*tables)
        finally:
            trim()

    def one(table: pa.Table) -> pa.Table:
        return group(table)

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        return group(left, right)

    return two if f.__code__.co_argcount == 2 else one


# --- hashing ---------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x2545F4914F6CDD1D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate(([U64(1)], np.full(n - 1, BASE, U64))))
            _powers["down"] = np.cumprod(np.concatenate(([U64(1)], np.full(n - 1, BASE_INVERSE, U64))))
    return _powers["up"], _powers["down"]


BYTE_VALUE = mix(np.arange(256, dtype=U64) + U64(77))
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _slices(space: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts at white space, each of about ``limit`` bytes (a longer single word stays whole)."""
    at, n = 0, len(space)
    while at < n:
        end = min(at + limit, n)
        if end < n:
            back = np.flatnonzero(space[at:end])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(space[end:])
                end = end + int(ahead[0]) + 1 if len(ahead) else n
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, value: np.ndarray = LOWER_VALUE, space: np.ndarray = IS_SPACE, affixes: tuple[int, ...] = ()):
    """Words of the rows ``data[offsets[i]:offsets[i+1]]``: hash, row, start and end of each, in order.

    For each of ``affixes`` one more array follows: the hash of a word's first k bytes, or last -k; 0 for shorter words.

    A word is a longest run of bytes outside ``space``; with UTF-8 and ASCII white space these are the runs of
    characters outside it. Memory is bounded by SLICE_BYTES, or the longest single word.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    hashes, starts, ends = [], [], []
    more: list[list[np.ndarray]] = [[] for _ in affixes]
    body = data[lo:hi]
    blank = space[body]
    cut = np.zeros(len(body) + 1, bool)
    cut[offsets[:-1] - lo] = True
    for a, b in _slices(blank, SLICE_BYTES):
        white = blank[a:b]
        first = ~white
        begin = first.copy()
        begin[1:] &= white[:-1] | cut[a + 1 : b]
        finish = first.copy()
        finish[:-1] &= white[1:] | cut[a + 1 : b]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        if not len(s):
            continue
        up, down = powers(b - a + 1)
        total = np.zeros(b - a + 1, U64)
        np.cumsum(value[body[a:b]] * up[: b - a], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] ^ (e - s).astype(U64)))
        for k, out in zip(affixes, more, strict=True):
            x, y = (s, np.minimum(s + k, e)) if k > 0 else (np.maximum(e + k, s), e)
            out.append(np.where(e - s > abs(k), mix((total[y] - total[x]) * down[x] ^ U64(k & 0xFFFF) << U64(32)), U64(0)))
        starts.append(s + (a + lo))
        ends.append(e + (a + lo))
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none, *(np.zeros(0, U64) for _ in affixes)
    s = np.concatenate(starts)
    row = np.searchsorted(offsets, s, side="right") - 1
    return np.concatenate(hashes), row, s, np.concatenate(ends), *map(np.concatenate, more)


def binary_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"") if column.null_count else column
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def row_chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(end, n)
        at = end


# --- packed columns --------------------------------------------------------------------------------------------------

_codec: list[pa.Codec] = []


def _zstd() -> pa.Codec:
    if not _codec:
        _codec.append(pa.Codec("zstd", compression_level=1))
    return _codec[0]


def pack(values: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()
    return len(values).to_bytes(8, "little") + (_zstd().compress(planes, asbytes=True) if planes else b"")


def unpack(blob: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(_zstd().decompress(blob[8:], n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(dtype)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, with the length at the end."""
    n = len(sorted_values)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n]))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits: sorted hashes have sorted buckets."""
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


# --- connected components --------------------------------------------------------------------------------------------


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the edges (a, b): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortens the paths to roots by self joins and contracts
    the edges. Nothing is gathered on the driver but a flag per round; the joins read written tables, so adaptive
    execution can split a hot root. Tables of its own that are read no more go.
    """
    mark = scratch.mark()
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    live = scratch.cut(edges.filter("a <> b").select(*ends).distinct())
    first, hops = live, []
    while not live.isEmpty():
        parent = scratch.cut(live.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("p")))
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.cut(parent.select("u", "p").join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            scratch.drop(parent)
            parent = jumped
            if jumped.filter("moved").isEmpty():
                break
        hops.append(parent)
        to = lambda c: parent.select(F.col("u").alias(c), F.col("p").alias(f"{c}_root"))  # noqa: B023, E731
        moved = live.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        live, old = scratch.cut(moved.filter("a <> b").select(*ends).distinct()), live
        if old is not first:
            scratch.drop(old)
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    labels = nodes.select("node", F.col("node").alias("root"))
    for parent in hops:
        labels = labels.join(parent.select(F.col("u").alias("root"), F.col("p").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = scratch.cut(labels)
    scratch.only(mark, out)
    return out
