"""Fuzzy duplicate lines by MinHash.

A line is the set of its runs of SHINGLE bytes, after lower-casing and with everything but letters and digits as one
blank. Lines that are equal after that are one kind from the start (by two 64-bit hashes). Of each kind a MinHash of
BANDS * BAND registers (one permutation, empty ones filled from registers that a hash names) is cut in bands; of kinds
that share a band, those that four bits of 32 registers don't show to be far apart are compared by the exact Jaccard
index of their sets (of 32-bit hashes), and distributed union-find joins those that reach THRESHOLD. Of each component
one line stays, the first by doc_id and line number. At the threshold the bands find 90 % of the pairs, at 0.8 97 %,
above it more. One changed letter leaves lines of 39 bytes or more above the threshold, a changed word of five letters
lines of 67 or more.

Cases: a line without letters and digits is never a duplicate; a line shorter than SHINGLE is a set of one; rows with
a null doc_id or text are left alone; rows that repeat (same doc_id, same text) count as one document and are treated
alike, different texts of one doc_id are ordered by their hash; lines of equal place can't differ otherwise, so that
there are no ties; very long texts and lines are used whole, a slice being one text at least; an empty table gives an
empty result; other columns are ignored (op) or kept (stage), whatever their names. The stage takes the duplicate lines
out of the texts and puts n_chars right where it changed a text; a document of which no letter or digit is left goes,
one that had none before stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import MARKS, bucket_components, marks

SHINGLE = 5
BAND, BANDS = 6, 12
REGISTERS = BAND * BANDS
THRESHOLD = 0.75
#: Bytes of text handled at once: the working arrays, some ten times that, stay in a core's cache.
SLICE = 1 << 17
_OTHER = C.seeded(256, 23)
_OTHER[65:91] = _OTHER[97:123]
#: Registers to fill an empty one from, in turn; then the least hash of all.
_DONORS = (C.seeded(16 * REGISTERS, 77) >> C.U64(32)).astype(np.int64).reshape(16, REGISTERS) % REGISTERS


def signatures(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """MinHash registers of n sets of hashes, each of which has a member; row ascends."""
    none = ~C.U64(0)
    reg = np.full(n * REGISTERS, none, C.U64)
    place = ((h >> C.U64(32)) * C.U64(REGISTERS)) >> C.U64(32)
    np.minimum.at(reg, row * REGISTERS + place.astype(np.int64), C.mix(h))
    reg = reg.reshape(n, REGISTERS)
    own = reg != none
    r, k = np.nonzero(~own)
    for t in range(len(_DONORS)):
        if not len(r):
            return reg
        d = _DONORS[t][k]
        ok = own[r, d]
        reg[r[ok], k[ok]] = C.mix(reg[r[ok], d[ok]] + C.U64(t + 1))
        r, k = r[~ok], k[~ok]
    if len(r):
        reg[r, k] = C.mix(np.where(own, reg, none).min(1)[r] + C.U64(99))
    return reg


def normal_lines(buf: np.ndarray, off: np.ndarray):
    """Of texts: the kept bytes (0 for a blank), each line's offset in them, and each line's row and number."""
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    newline = buf == 10
    first = edge[:n].copy()
    first[1:] |= newline[:-1]
    start = np.flatnonzero(first)
    inside = ~C.SEPARATOR[buf]
    keep = inside.copy()
    keep[1:] |= inside[:-1] & ~first[1:] & ~newline[1:]  # one blank after a word
    at = np.flatnonzero(keep)
    # not at the end of a line
    offsets = np.append(np.searchsorted(at, start), len(at))
    end = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    end = end[~inside[at[end]]]
    at = np.delete(at, end)
    offsets -= np.searchsorted(end, offsets)
    kept = buf[at] * inside[at]
    row = np.searchsorted(off, start, "right") - 1
    # a text that ends in a newline has an empty last line, which doesn't matter here
    first_of = np.searchsorted(row, row)
    return kept, offsets, row, np.arange(len(start)) - first_of


def prefix_sums(kept: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of the bytes' values by place: the hash of any stretch is a difference of two."""
    total = np.zeros(len(kept) + 1, C.U64)
    np.cumsum(table[kept] * C.powers(len(kept) + 1)[0][: len(kept)], out=total[1:])
    return total


def line_shingles(total: np.ndarray, offsets: np.ndarray):
    """(hash, line) of every run of SHINGLE bytes; a shorter line that isn't empty has one. total: prefix_sums()."""
    n = len(total) - 1
    inv = C.powers(n + 1)[1]
    size = np.diff(offsets)
    line = np.repeat(np.arange(len(size)), size)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    one = C.mix((total[offsets[short + 1]] - total[offsets[short]]) * inv[offsets[short]] ^ C.U64(0x5A5A))
    m = n - SHINGLE + 1
    if m <= 0:
        return one, short
    ok = line[:m] == line[SHINGLE - 1 :]
    run = total[SHINGLE:] - total[:-SHINGLE]
    run *= inv[:m]
    h, l = C.mix(run[ok]), line[:m][ok]
    if len(short):
        h, l = np.concatenate([h, one]), np.concatenate([l, short])
        order = np.argsort(l, kind="stable")
        h, l = h[order], l[order]
    return h, l


def _hash(total: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    inv = C.powers(len(total))[1]
    return C.mix((total[offsets[1:]] - total[offsets[:-1]]) * inv[offsets[:-1]] + np.diff(offsets).astype(C.U64))


_LINES = "doc_id long, rid long, line_no int, h1 long, h2 long, m1 long, m2 long, " + ", ".join(f"b{i} long" for i in range(BANDS))


def _lines(batches):
    for b in C.slices(batches, 2, SLICE):
        kept, offsets, row, number = normal_lines(*C.text_bytes(b.column(2)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if not len(full):
            continue
        total = prefix_sums(kept, C.BYTE)
        h, line = line_shingles(total, offsets)
        slot = np.full(len(offsets), -1)
        slot[full] = np.arange(len(full))
        reg = signatures(h, slot[line], len(full))
        x = C.bands(reg, BAND)
        h1, h2 = (_hash(t, offsets)[full].view(np.int64) for t in (total, prefix_sums(kept, _OTHER)))
        at = pa.array(row[full])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), pa.array(number[full].astype(np.int32)), pa.array(h1), pa.array(h2), *(pa.array(m) for m in marks(reg[:, :MARKS])), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(BANDS))],
            _NAMES,
        )


_NAMES = [c.split()[0] for c in _LINES.split(", ")]


def _wanted(batches):
    """The lines (h1, line) of texts whose numbers are asked for. In: text, numbers, hashes."""
    for b in C.slices(batches, 0):
        ids, out = [], []
        for text, numbers, hashes in zip(*(b.column(i).to_pylist() for i in range(3))):
            lines = text.split("\n")
            ids += hashes
            out += [lines[k] for k in numbers]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "line"])


def _keys(col: pa.Array) -> np.ndarray:
    """Sorted (line << 32 | 32-bit shingle) of all lines; each row of the column is one line."""
    kept, offsets, row, _ = normal_lines(*C.text_bytes(col))
    h, line = line_shingles(prefix_sums(kept, C.BYTE), offsets)
    return C.distinct((row[line].astype(C.U64) << C.U64(32)) | (h >> C.U64(32)))


def _sets(ids: np.ndarray, col: pa.Array):
    """Each pair's sorted (pair << 32 | 32-bit shingle) of one side; a line that is in many pairs is cut up once."""
    _, first, which = np.unique(ids, return_index=True, return_inverse=True)
    k = _keys(col.take(pa.array(first)))
    off = np.searchsorted(k >> C.U64(32), np.arange(len(first) + 1, dtype=C.U64))
    size = (off[1:] - off[:-1])[which]
    pair = np.repeat(np.arange(len(ids), dtype=C.U64), size)
    at = np.arange(len(pair)) + np.repeat(off[which] - (np.cumsum(size) - size), size)
    return (pair << C.U64(32)) | (k[at] & C.U64(0xFFFFFFFF)), size


def jaccard(ids_a: np.ndarray, a: pa.Array, ids_b: np.ndarray, b: pa.Array) -> np.ndarray:
    """Of the lines of each pair; equal ids have equal lines."""
    (x, n), (y, m) = _sets(ids_a, a), _sets(ids_b, b)
    z = np.sort(np.concatenate([x, y]))
    both = np.bincount((z[1:][z[1:] == z[:-1]] >> C.U64(32)).astype(np.int64), minlength=len(n))
    return both / np.maximum(n + m - both, 1)


def _similar(batches):
    for b in C.slices(batches, 2, SLICE):
        ids = [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        keep = pa.array(jaccard(ids[0], b.column(2), ids[1], b.column(3)) >= THRESHOLD)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def _numbered(docs: DataFrame) -> DataFrame:
    return C.with_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")


def _kinds(lines: DataFrame, tables: C.Tables) -> DataFrame:
    """(id, h1, h2, n, rid, line_no, m1, m2, b0, ...): one row for each kind of line. id is h1; where kinds that differ
    have the same h1, their ids are further hashes of both."""
    one = ("rid", "line_no", "m1", "m2", *(f"b{i}" for i in range(BANDS)))  # of any one line of the kind
    kinds = tables.write(lines.groupBy("h1").agg(F.min("h2").alias("h2"), F.max("h2").alias("most"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in one)))
    out = kinds.where("h2 = most").drop("most").withColumn("id", F.col("h1"))
    clash = kinds.where("h2 < most").select("h1")
    if clash.isEmpty():
        return out
    apart = lines.join(clash, "h1", "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in one))
    return tables.write(out.unionByName(apart.withColumn("id", F.xxhash64("h1", "h2"))))


def duplicate_lines(docs: DataFrame, tables: C.Tables | None = None) -> DataFrame:
    """(doc_id, rid, line_no, kept_doc_id, kept_line_no) of every line that goes; lines count from 0."""
    spark = docs.sparkSession
    tables = tables or C.Tables(spark, "lines")
    texts = _numbered(docs)
    lines = tables.write(texts.select("doc_id", "rid", F.lower("text").alias("text")).mapInArrow(_lines, _LINES))
    kinds = _kinds(lines, tables)
    wide, lines = lines, tables.write(lines.select("doc_id", "rid", "line_no", "h1", "h2"))
    tables.drop(wide)
    tables.release()
    rows = kinds.select("id", F.explode(F.array(*(f"b{i}" for i in range(BANDS)))).alias("band"))

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, line). The joins shuffle at every size, so that plans stay alike as tables grow."""
        asked = kinds.select("id", "rid", "line_no").join(ids.hint("merge"), "id", "left_semi")
        ask = asked.groupBy("rid").agg(F.collect_list(F.struct("line_no", "id")).alias("ask")).select("rid", F.col("ask.line_no").alias("numbers"), F.col("ask.id").alias("hashes")).hint("merge")
        got = texts.select("rid", "text").join(ask, "rid").select(F.lower("text").alias("text"), "numbers", "hashes").mapInArrow(_wanted, "id long, line string")
        return tables.write(got.groupBy("id").agg(F.first("line").alias("line")))

    def verify(known: DataFrame, pairs: DataFrame) -> DataFrame:
        both = pairs.join(known.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(known.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
        return tables.write(both.select("a", "b", "la", "lb").mapInArrow(_similar, "a long, b long"))

    root = bucket_components(rows, kinds.select("id", "m1", "m2"), THRESHOLD, texts_of, verify, tables)
    placed = kinds.select("id", "h1", "h2", "n").join(root, "id", "left").where("n > 1 or root is not null").select("h1", "h2", F.coalesce("root", "id").alias("root"))
    members = tables.write(lines.select("doc_id", "rid", "line_no", "h1", "h2").join(placed, ["h1", "h2"]).select("doc_id", "rid", "line_no", "root").distinct())
    first = members.groupBy("root").agg(F.min("doc_id").alias("kept_doc_id"))
    least = members.join(first, "root").where("doc_id = kept_doc_id")
    first = least.groupBy("root").agg(F.min("rid").alias("kept_rid"), F.min("kept_doc_id").alias("kept_doc_id"))
    least = members.join(first, "root").where("doc_id = kept_doc_id and rid = kept_rid").groupBy("root", "kept_doc_id", "kept_rid").agg(F.min("line_no").alias("kept_line_no"))
    gone = members.join(least, "root").where("doc_id > kept_doc_id or rid > kept_rid or (rid = kept_rid and line_no > kept_line_no)")
    out = tables.write(gone.select("doc_id", "rid", "line_no", "kept_doc_id", "kept_line_no"))
    tables.drop(lines, root, members)
    return out


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go; columns as they came."""
    rid, gone, own = C.free_name(docs, "_rid", "_gone", "_own")
    found = duplicate_lines(docs).groupBy(F.col("rid").alias(rid)).agg(F.collect_set("line_no").alias(gone)).hint("merge")
    named = docs.withColumn(rid, F.when(docs["doc_id"].isNotNull() & docs["text"].isNotNull(), F.xxhash64(docs["doc_id"].cast("long"), docs["text"])))
    left = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    j = named.join(found, rid, "left").withColumn(own, F.when(F.col(gone).isNotNull(), left))
    j = j.where(F.col(gone).isNull() | F.col(own).rlike(r"[\p{L}\p{N}]"))
    new = {c: C.col(c) for c in docs.columns}
    changed = F.col(gone).isNotNull()
    for c in docs.columns:
        if c == "text":
            new[c] = F.when(changed, F.col(own)).otherwise(C.col(c)).alias(c)
        elif c == "n_chars":
            new[c] = F.when(changed, F.length(own).cast(docs.schema[c].dataType)).otherwise(C.col(c)).alias(c)
    return j.select(*new.values())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(C.read(spark, sf_dir, "documents")).select("doc_id", "line_no", "kept_doc_id", "kept_line_no").distinct()
