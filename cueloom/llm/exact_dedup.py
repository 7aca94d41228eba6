"""Exact duplicates against immutable snapshots, screened by static binary-fuse filters.

Documents come in batches. Of every batch that is in, a snapshot is kept that never changes: its digests, in shards,
and for each shard a 3-wise binary-fuse filter of 8-bit fingerprints (Graf and Lemire, 2022). An incoming digest that no
snapshot's filter knows is new; one that a filter knows joins that snapshot's exact bucket, and the texts' bytes decide.
Duplicates within the batch itself are grouped by digest, and the bytes decide there too. A batch's new texts become
the next snapshot.

Cases: a null doc_id or null text is in no group; the empty text is a text like others; repeated rows (of one doc_id)
are copies of each other and are listed once; the kept copy is the least doc_id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BATCHES = 2
#: Digests in a shard, about; a filter takes some 9 bits for each.
SHARD = 500_000


class Fuse:
    """A static filter: no false negatives, about one false positive in 256."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys)
        n = len(keys)
        self.n = n
        if n < 2:
            size, self.segment = 12, 4
        else:
            self.segment = 1 << min(18, max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
            size = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) * n
        self.count = max(1, math.ceil(size / self.segment) - 2)
        self.seed = 1
        while not self._build(keys):
            self.seed += 1
            if self.seed % 20 == 0:
                self.count = math.ceil(self.count * 1.1) + 1

    def _places(self, keys: np.ndarray):
        h = C.mix(keys + C.U64(self.seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        first = ((h >> C.U64(32)) * C.U64(self.count * self.segment)) >> C.U64(32)
        mask = C.U64(self.segment - 1)
        h1 = (first + C.U64(self.segment)) ^ ((h >> C.U64(18)) & mask)
        h2 = (first + C.U64(2 * self.segment)) ^ (h & mask)
        print8 = (h ^ (h >> C.U64(32))).astype(np.uint8)
        return np.stack([first, h1, h2]).astype(np.int64), print8

    def _build(self, keys: np.ndarray) -> bool:
        size = (self.count + 2) * self.segment
        at, print8 = self._places(keys)
        n = len(keys)
        ids = np.arange(n, dtype=np.int64)
        degree = np.bincount(at.reshape(-1), minlength=size)
        total = np.zeros(size, np.int64)  # the sum of the keys' numbers in a place names the last one
        for p in at:
            np.add.at(total, p, ids)
        left, order = np.ones(n, bool), []
        single = np.flatnonzero(degree == 1)
        while len(single):
            k, first = np.unique(total[single], return_index=True)
            place = single[first]
            order.append((k, place))
            left[k] = False
            for p in at:
                np.subtract.at(degree, p[k], 1)
                np.subtract.at(total, p[k], k)
            near = np.unique(at[:, k])
            single = near[degree[near] == 1]
        if left.any():
            return False
        self.prints = np.zeros(size, np.uint8)
        for k, place in reversed(order):
            v = print8[k].copy()
            for p in at:
                v ^= np.where(p[k] == place, 0, self.prints[p[k]]).astype(np.uint8)
            self.prints[place] = v
        return True

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not self.n or not len(keys):
            return np.zeros(len(keys), bool)
        at, print8 = self._places(keys)
        return (self.prints[at[0]] ^ self.prints[at[1]] ^ self.prints[at[2]]) == print8

    def dumps(self) -> bytes:
        return np.array([self.n, self.segment, self.count, self.seed], np.int64).tobytes() + self.prints.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> Fuse:
        self = cls.__new__(cls)
        self.n, self.segment, self.count, self.seed = np.frombuffer(data[:32], np.int64).tolist()
        self.prints = np.frombuffer(data[32:], np.uint8)
        return self


def _build(table: pa.Table) -> pa.Table:
    filt = Fuse(table.column("digest").to_numpy().view(C.U64))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "filter": pa.array([filt.dumps()], pa.binary())})


def _screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    """The digests that a filter of the shard knows."""
    keys = incoming.column("digest").to_numpy().view(C.U64)
    known = np.zeros(len(keys), bool)
    for f in filters.column("filter").to_pylist():
        known |= Fuse.loads(f).has(keys)
    return pa.table({"digest": pa.array(keys[known].view(np.int64))})


def shard_of(n: int):
    return F.pmod(F.shiftrightunsigned("digest", 7), F.lit(n)).cast("long")


def copies(docs: DataFrame, batches: int = BATCHES, shard: int = SHARD) -> DataFrame:
    """(doc_id, group_id) of all documents whose text another one has; group_id is the least doc_id of these.

    The batches are ranges of doc_id; every document is in one, and the order of arrival is that of doc_id."""
    spark = docs.sparkSession
    tables = C.Tables(spark, "exact")
    rows = C.with_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    part = sum((F.col("doc_id") > F.lit(x)).cast("int") for x in cuts) if cuts else F.lit(0)
    keyed = rows.withColumn("part", part).withColumn("digest", F.xxhash64("text"))
    table = tables.write(keyed.select("doc_id", "part", "digest"))
    shards = max(1, math.ceil(table.count() / batches / shard))
    table = table.withColumn("shard", shard_of(shards))
    known: DataFrame | None = None  # digest of each text in a snapshot, and its filter by shard
    filters: DataFrame | None = None
    suspects = []
    for i in range(len(cuts) + 1):
        new = table.where(F.col("part") == i)
        # copies within the batch
        suspects.append(new.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
        if filters is not None:
            hits = new.select("shard", "digest").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screen, "digest long")
            suspects.append(hits.join(known, "digest", "left_semi").distinct())
        fresh = new.select("shard", "digest").distinct()
        if i < len(cuts):
            snap = tables.write(fresh.groupBy("shard").applyInArrow(_build, "shard long, filter binary"))
            filters = snap if filters is None else filters.union(snap)
            known = fresh.select("digest") if known is None else known.union(fresh.select("digest"))
    maybe = suspects[0]
    for s in suspects[1:]:
        maybe = maybe.union(s)
    maybe = tables.write(maybe.distinct())
    # the bytes decide: the least doc_id of a bucket leads, what differs from it (a clash of digests) is grouped by text
    bucket = keyed.select("doc_id", "digest", "text").join(maybe, "digest", "left_semi")
    lead = bucket.groupBy("digest").agg(F.min(F.struct("doc_id", "text")).alias("lead"))
    judged = tables.write(bucket.join(lead, "digest").select("doc_id", F.when(F.col("text") == F.col("lead.text"), F.col("lead.doc_id")).alias("group_id"), F.when(F.col("text") != F.col("lead.text"), F.col("text")).alias("other")))
    plain = judged.where("other is null").select("doc_id", "group_id")
    clash = judged.where("other is not null")
    heads = clash.groupBy("other").agg(F.min("doc_id").alias("group_id"))
    placed = plain.union(clash.select("doc_id", "other").join(heads, "other").select("doc_id", "group_id"))
    many = placed.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    out = tables.write(placed.join(many, "group_id").select("doc_id", "group_id").distinct())
    tables.drop(maybe, judged)
    return out


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(C.read(spark, sf_dir, "documents"))


OP6_SQL = """
WITH g AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS n
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
)
SELECT DISTINCT doc_id, group_id FROM g WHERE n > 1
"""
