"""What the operators share: a shared working folder, and numpy kernels over Arrow text buffers.

The kernels work on the UTF-8 bytes of a whole slice of rows at once; a slice holds about
``SLICE_BYTES`` of text (one row at least), so that memory stays flat however long the texts are.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
U64 = np.uint64


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of
    its own machine, which is all there is; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def free_name(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where the table has columns of these names (case doesn't count)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str):
    """A column by its whole name, whatever signs that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the JVM may be gone by then
        pass


class Tables:
    """Tables written to the shared folder, cutting the lineage there; read back, they survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(_at_exit, spark, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shared_path = path
        return out

    def release(self) -> None:
        """Shuffle files stay on the executors' disks until the driver collects its garbage; after a large step, now."""
        gc.collect()
        time.sleep(0.5)  # until the JVM has let go of what Python has
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Only for tables that no later plan reads."""
        for t in tables:
            _remove(self.spark, t._shared_path)


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits (the public splitmix64 constants); a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once; plain sorting beats np.unique's hash table by far."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        size = 1 << max(17, (n - 1).bit_length())
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["p"][:n], _pow["i"][:n]


BYTE = seeded(256, 7)
BYTE[65:91] = BYTE[97:123]
#: White space, controls and ASCII punctuation part words; every byte of a longer UTF-8 sequence is part of one.
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offset (length n + 1). A null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if big else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, text: int = 1, size: int | None = None):
    """Cuts record batches so that each piece holds about SLICE_BYTES of the text column, one row at least."""
    size = size or SLICE_BYTES
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        _, off = text_bytes(b.column(text))
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            j = min(j, n)
            yield b.slice(i, j - i)
            i = j


def words(buf: np.ndarray, off: np.ndarray):
    """(hash, row, start, end) of each word; case of ASCII letters doesn't count."""
    n = len(buf)
    if not n:
        e = np.empty(0, np.int64)
        return np.empty(0, U64), e, e, e
    inside = ~SEPARATOR[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, inv = powers(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(BYTE[buf] * p, out=total[1:])
    h = mix((total[end] - total[start]) * inv[start])
    return h, np.searchsorted(off, start, "right") - 1, start, end


def shingles(h: np.ndarray, row: np.ndarray, k: int):
    """(hash, row) of each run of k words within a row; a shorter row has one shingle of all its words."""
    if not len(h):
        return h, row
    n_rows = int(row[-1]) + 1
    per = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    m = len(h)
    out, at = np.empty(0, U64), np.empty(0, np.int64)
    if m >= k:
        full = row[: m - k + 1] == row[k - 1 :]
        acc = np.zeros(m - k + 1, U64)
        for j in range(k):
            acc = acc * U64(0x5851F42D4C957F2D) + h[j : m - k + 1 + j]
        out, at = mix(acc[full]), row[: m - k + 1][full]
    few = np.flatnonzero((per > 0) & (per < k))
    if len(few):
        acc = np.zeros(len(few), U64)
        for j in range(k - 1):
            ok = per[few] > j
            acc[ok] = acc[ok] * U64(0x5851F42D4C957F2D) + h[first[few[ok]] + j]
        out, at = np.concatenate([out, mix(acc ^ U64(0xABCD))]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Of each row in 0..n-1 (row ascends), wrapping as uint64."""
    out = np.zeros(n, U64)
    if len(values):
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[at]] = np.add.reduceat(values, at)
    return out


def one_permutation(h: np.ndarray, row: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The least rest of a hash for each of 2**bits buckets, n x 2**bits; all ones where a bucket is empty."""
    m = 1 << bits
    reg = np.full(n * m, ~U64(0), U64)
    np.minimum.at(reg, row * m + (h >> U64(64 - bits)).astype(np.int64), (h << U64(bits)) >> U64(1))
    return reg.reshape(n, m)


REFILLS = 3


def refilled(reg: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Registers of one_permutation() with the empty ones filled from further hashes: REFILLS more permutations, then a
    hash of its own for each register that is still empty. Two sets agree in a register with a probability of their
    Jaccard index, in each independently, however small they are. Rows without members stay empty."""
    n, m = reg.shape
    bits = m.bit_length() - 1
    none = ~U64(0)
    reg = reg.copy()
    some = np.bincount(row, minlength=n) > 0
    seeds = seeded(m + REFILLS, 41)
    for t in range(REFILLS + 1):
        need = np.flatnonzero((reg == none).any(1) & some)
        if not len(need):
            return reg
        place = np.full(n, -1)
        place[need] = np.arange(len(need))
        mine = place[row] >= 0
        x, at, old = h[mine], place[row[mine]], reg[need]
        if t < REFILLS:
            new = one_permutation(mix(x + seeds[m + t]), at, len(need), bits)
        else:
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            new = np.empty((len(need), m), U64)
            for k in range(m):
                new[:, k] = np.minimum.reduceat(mix(x + seeds[k]), first) >> U64(1)
        reg[need] = np.where(old == none, new, old)
    return reg


def bands(reg: np.ndarray, rows: int) -> np.ndarray:
    """A hash for every `rows` registers in turn, with the band's number mixed in; int64, n x (m / rows)."""
    n, m = reg.shape
    b = m // rows
    acc = np.broadcast_to(seeded(b, 99), (n, b)).copy()
    r = reg[:, : b * rows].reshape(n, b, rows)
    for j in range(rows):
        acc = mix(acc * U64(0x5851F42D4C957F2D) + r[:, :, j])
    return acc.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


# ---------------------------------------------------------------- documents
def with_id(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that can be named in a result: those with an id and a text."""
    return docs.where(F.col(id_col).isNotNull() & F.col("text").isNotNull())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- arrays summed over partitions
_BLOCKS = "part long, block int, data binary"


def blocks_of(x: np.ndarray, block: int = 1 << 14):
    """A batch of (part, block, data) for an array (float64 or int64) that this partition adds to the sum."""
    from pyspark import TaskContext

    task = TaskContext.get()
    flat = np.ascontiguousarray(x).reshape(-1)
    n = -(-len(flat) // block)
    data = [flat[i * block : (i + 1) * block].tobytes() for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array([task.partitionId() if task else 0] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(data, pa.binary())], ["part", "block", "data"])


def summed(df: DataFrame, kind, shape, fan: int = 256) -> np.ndarray:
    """The sum over partitions, by a tree of two levels, so that no task holds more than `fan` blocks a key at first."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for b in table.column("data").to_pylist():
            x = np.frombuffer(b, kind)
            total = x.copy() if total is None else total + x
        return pa.table({"part": table.column("part").slice(0, 1), "block": table.column("block").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    once = df.withColumn("part", F.floor(F.col("part") / fan)).groupBy("part", "block").applyInArrow(add, _BLOCKS)
    rows = once.withColumn("part", F.lit(0).cast("long")).groupBy("part", "block").applyInArrow(add, _BLOCKS).collect()
    out = np.zeros(int(np.prod(shape)), kind)
    if rows:
        flat = np.concatenate([np.frombuffer(r["data"], kind) for r in sorted(rows, key=lambda r: r["block"])])
        out[: len(flat)] = flat
    return out.reshape(shape)
