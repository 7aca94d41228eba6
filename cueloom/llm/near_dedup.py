"""Near-duplicate documents by HyperMinHash.

Each document is the set of its runs of three words (case, punctuation and spacing don't count). A register keeps,
for its bucket of the hash space, the leading-zero count of the least hash and some mantissa bits after it; buckets
that a small set leaves empty are filled from further hashes. Bands of four registers name candidates; of each
candidate the Jaccard index is estimated from the registers, corrected for the collisions that so short registers
have; what isn't far below the threshold is verified on the sets (of 32-bit hashes, which clash once in 4e9 members).

The groups are the connected components of the verified pairs (see components.py for large buckets).

Cases: a null doc_id or a null text, and a text without words, is in no group. A doc_id's different texts are documents
of their own: each may be in a group, so that a doc_id can be in several. Rows that repeat both count as one. A group
has two doc_ids at least. Groups are led by their least doc_id, and among its texts by the least hash; ties can't be
left, as what ties is equal. Very long texts are used whole, a slice being one text at least. An empty table gives an
empty result; other columns are ignored (op) or returned as they are (stage), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import MARKS, bucket_components, marks

SHINGLE = 3
BITS, BAND = 7, 4
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
THRESHOLD = 0.6
#: An estimate lower than the threshold by this much (over four standard errors) isn't verified.
MARGIN = 0.18
#: Bytes of text handled at once; working arrays are some thirty times that.
SLICE = 1 << 17


def pack(rest: np.ndarray) -> np.ndarray:
    """Leading zeros (of 64 - BITS bits) and MANTISSA bits after the first one, as uint16; order is kept within buckets."""
    width = 64 - BITS
    empty = rest == ~C.U64(0)
    x = np.where(empty, C.U64(1), (rest >> C.U64(BITS - 1)) | C.U64(1))
    top = np.frexp(x.astype(np.float64))[1].astype(np.int64)  # bits in x; rounding up to a power is put right here
    top -= ((x >> (top - 1).astype(C.U64)) == 0).astype(np.int64)
    zeros = width - top
    shift = top - 1 - MANTISSA
    mant = np.where(shift >= 0, x >> np.maximum(shift, 0).astype(C.U64), x << np.maximum(-shift, 0).astype(C.U64)) & C.U64((1 << MANTISSA) - 1)
    out = (np.minimum(zeros, 62).astype(np.uint16) << MANTISSA) | mant.astype(np.uint16)
    out[empty] = EMPTY
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of two unrelated sets of n and m members, registers that agree by chance (HyperMinHash's approximation)."""
    hi, lo = np.maximum(n, m).astype(float), np.maximum(np.minimum(n, m), 1).astype(float)
    ratio = hi / lo
    return 0.169919487159739 * 2.0 ** (BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard of rows of registers a and b of sets of about n and m members."""
    seen = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & seen).sum(1)
    used = seen.sum(1)
    return np.clip(same - expected_collisions(n, m) * used / (1 << BITS), 0, None) / np.maximum(used, 1)


def _sets(h: np.ndarray, row: np.ndarray):
    """Sorted 32-bit members of each row's set, and their rows."""
    key = C.distinct((row.astype(C.U64) << C.U64(32)) | (h >> C.U64(32)))
    return (key & C.U64(0xFFFFFFFF)).astype(np.uint32), (key >> C.U64(32)).astype(np.int64)


def _signatures(batches):
    for b in C.slices(batches, 2, SLICE):
        buf, off = C.text_bytes(b.column(2))
        n = b.num_rows
        h, row, _, _ = C.words(buf, off)
        s, at = C.shingles(h, row, SHINGLE)
        reg = pack(C.refilled(C.one_permutation(s, at, n, BITS), s, at))
        per = np.bincount(at, minlength=n)
        digest = C.mix(C.sums(C.mix(s ^ C.U64(0x1234567)), at, n) + per.astype(C.U64)).view(np.int64)
        keep = np.flatnonzero(per > 0)
        m1, m2 = marks(reg[keep, :MARKS])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(digest[keep]), pa.array(per[keep]), pa.array(m1), pa.array(m2), pa.array([r.tobytes() for r in reg[keep]], pa.binary())],
            ["doc_id", "rid", "id", "n", "m1", "m2", "reg"],
        )


def _banded(batches):
    for b in batches:
        if not b.num_rows:
            continue
        reg = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, 1 << BITS)
        x = C.bands(reg, BAND)
        k = x.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), k)), pa.array(x.reshape(-1))], ["id", "band"])


def _estimated(batches):
    for b in batches:
        if not b.num_rows:
            continue
        a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, 1 << BITS) for i in (2, 3))
        n, m = (b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
        keep = pa.array(estimate(a, c, n, m) >= THRESHOLD - MARGIN)
        yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in (0, 1)], ["a", "b"])


def _members(batches):
    for b in C.slices(batches, 1, SLICE):
        buf, off = C.text_bytes(b.column(1))
        h, row, _, _ = C.words(buf, off)
        s, at = _sets(*C.shingles(h, row, SHINGLE))
        per = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=b.num_rows))])
        yield pa.RecordBatch.from_arrays([b.column(0), C.list_array(s.view(np.int32), per, pa.int32())], ["id", "members"])


def _verified(known: DataFrame, pairs: DataFrame, tables: C.Tables) -> DataFrame:
    """Those of pairs (a, b) whose exact Jaccard index reaches THRESHOLD."""
    left = known.select(F.col("id").alias("a"), F.col("reg").alias("ra"), F.col("n").alias("na"))
    right = known.select(F.col("id").alias("b"), F.col("reg").alias("rb"), F.col("n").alias("nb"))
    likely = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_estimated, "a long, b long")
    likely = tables.write(likely)
    both = likely.join(known.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(known.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    common = F.size(F.array_intersect("ma", "mb"))
    out = tables.write(both.where(common >= F.lit(THRESHOLD) * (F.size("ma") + F.size("mb") - common)).select("a", "b"))
    tables.drop(likely)
    return out


def _row_hash(docs: DataFrame):
    """Of a row's doc_id and text: rows that repeat both have the same."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def grouped(docs: DataFrame, tables: C.Tables) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, lead_doc, lead_rid) of every different (doc_id, text) in a group of two or more, and the (rid) that
    several rows have."""
    texts = C.with_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash(docs).alias("rid"), F.lower("text").alias("text"))
    sig = tables.write(texts.mapInArrow(_signatures, "doc_id long, rid long, id long, n long, m1 long, m2 long, reg binary"))
    kinds = tables.write(sig.groupBy("id").agg(F.first("rid").alias("rid"), *(F.first(c).alias(c) for c in ("n", "m1", "m2", "reg"))))  # all rows of an id have the same set
    rows = kinds.select("id", "reg").mapInArrow(_banded, "id long, band long")

    def sets(ids: DataFrame) -> DataFrame:
        """(id, n, reg, members) of the ids. The join shuffles at every size, so that plans stay alike as tables grow."""
        asked = kinds.select("id", "rid").join(ids, "id", "left_semi").hint("merge")
        members = texts.select("rid", "text").join(asked, "rid").select("id", "text").mapInArrow(_members, "id long, members array<int>").groupBy("id").agg(F.first("members").alias("members"))
        return tables.write(members.join(kinds.select("id", "n", "reg"), "id"))

    root = bucket_components(rows, kinds, THRESHOLD, sets, lambda known, pairs: _verified(known, pairs, tables), tables)
    members = sig.select("doc_id", "rid", "id").distinct().join(root, "id", "left").select("doc_id", "rid", F.coalesce("root", "id").alias("root"))
    # a group's leader, and whether it has another (doc_id, text): sums and minima only, which are made before the shuffle
    lead = members.groupBy("root").agg(F.min("doc_id").alias("lead_doc"), F.count("*").alias("size")).where("size > 1").select("root", "lead_doc")
    many = tables.write(members.join(lead, "root"))
    first = many.where("doc_id = lead_doc").groupBy("root").agg(F.min("rid").alias("lead_rid"))
    out = tables.write(many.join(first, "root").select("doc_id", "rid", "lead_doc", "lead_rid"))
    again = tables.write(sig.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid"))
    tables.drop(sig, kinds, root, many)
    return out, again


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of all documents in groups of two or more; group_id is the group's least doc_id, which stays."""
    tables = C.Tables(docs.sparkSession, "near")
    found, _ = grouped(docs, tables)
    # groups within one doc_id aren't listed
    others = found.groupBy("lead_doc", "lead_rid").agg(F.max("doc_id").alias("most")).where("most > lead_doc").select("lead_doc", "lead_rid")
    return found.join(others, ["lead_doc", "lead_rid"], "left_semi").select("doc_id", F.col("lead_doc").alias("group_id")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without those that near-repeat another one; columns as they came. Of each group its leader stays; of rows
    that repeat doc_id and text one stays, by the hash of its columns. Rows without a doc_id or without words stay."""
    tables = C.Tables(docs.sparkSession, "keep")
    found, again = grouped(docs, tables)
    gone = found.where("rid <> lead_rid").select("rid").distinct()
    (rid,) = C.free_name(docs, "_rid")
    named = docs.withColumn(rid, F.when(docs["doc_id"].isNotNull() & docs["text"].isNotNull(), _row_hash(docs)))
    gone, again = (x.withColumnRenamed("rid", rid).hint("merge") for x in (gone, again))
    own = [C.col(c) for c in docs.columns]
    out = named.join(gone, rid, "left_anti")
    if again.isEmpty():
        return out.select(*own)
    row = F.struct(*own)
    once = out.join(again, rid, "left_semi").groupBy(rid).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    return out.join(again, rid, "left_anti").select(*own).union(once)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "documents"))
