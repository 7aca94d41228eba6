"""Distributed union-find: connected components by local forests, then alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Edges of a partition that are turned into a forest at once.
FOREST = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges' nodes that aren't their component's least."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        p, q = root[x], root[y]
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(ids)))
    return ids[far], ids[root[far]]


def _forests(batches):
    held, n = [], 0

    def out():
        u, v = forest(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for x in batches:
        held.append([x.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        n += x.num_rows
        if n >= FOREST:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _star(e: DataFrame, large: bool) -> DataFrame:
    """e holds (u, v), v < u. Large: each neighbour above u joins u's least; small: each below u joins it, and u too."""
    if large:
        e = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = e.join(least, "u")
    if large:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: the end."""
    one = e.groupBy("u").agg(F.count("*").alias("n"))
    roots = e.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("n")).distinct()
    both = one.union(roots).groupBy("u").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return both.where("n > 1 or k > 1").isEmpty()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(id, root) of every node that has an edge, root being the least id of its component. edges: (a, b), long.

    Loops and repeated edges don't matter; no edges give no rows. Each task first turns its own edges into a forest
    (FOREST of them at a time), so that the rounds only join what tasks left apart. Every round is written to the
    shared folder.
    """
    e = tables.write(edges.where("a <> b").select("a", "b").mapInArrow(_forests, "u long, v long").distinct())
    while not _stars(e):
        nxt = tables.write(_star(_star(e, True), False))
        tables.drop(e)
        e = nxt
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


# ---------------------------------------------------------------- marks: 32 registers at four bits in two longs
MARKS = 32


def marks(reg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest four bits of MARKS registers (n x MARKS) of each row."""
    x = (reg & reg.dtype.type(15)).astype(np.uint64)
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return tuple((x[:, k : k + 16] << shift).sum(1, dtype=np.uint64).view(np.int64) for k in (0, 16))


def agreeing(x: str, y: str) -> Column:
    """How many of the marks of rows x and y (prefixes of columns m1, m2) agree, in the JVM."""
    total = F.lit(MARKS)
    for m in ("m1", "m2"):
        d = F.col(x + m).bitwiseXOR(F.col(y + m))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total - F.bit_count(d)
    return total


def least_agreeing(threshold: float, errors: float = 4.0) -> int:
    """Marks that a pair at the threshold has in common, less so many standard errors. A sixteenth of the others agree by chance."""
    p = threshold + (1 - threshold) / 16
    return max(1, int(np.floor(MARKS * p - errors * np.sqrt(MARKS * p * (1 - p)))))


def _repeated(batches):
    """Of (band, id), sorted by band, the rows whose band others have too. The last row waits for the next batch."""
    held, before = [np.empty(0, np.int64)] * 2, False
    for x in batches:
        if not x.num_rows:
            continue
        band, ids = (np.concatenate([h, x.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
        same = band[1:] == band[:-1]
        many = np.zeros(len(band), bool)
        many[1:], many[0] = same, before
        many[:-1] |= same
        at = np.flatnonzero(many[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(band[at]), pa.array(ids[at])], ["band", "id"])
        held, before = [band[-1:], ids[-1:]], bool(many[-1])
    if before:
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["band", "id"])


def bucket_components(rows: DataFrame, marked: DataFrame, threshold: float, prepare: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], tables: Tables) -> DataFrame:
    """(id, root) of the components of the graph whose edges are the pairs that share a band and that verify() keeps.

    rows: (band, id), each once. marked: (id, m1, m2), a written table. Pairs whose marks show that they are far below the threshold
    are left out inside the join. prepare: DataFrame of the ids (id) that share a band -> what verify needs of them, a
    written table. verify: that and a DataFrame of (a, b) -> those of it that are similar, in a written table. A large
    bucket isn't compared pair by pair: every member is compared with the least one, and after union-find two members
    only where they are still in different components. The components are those that all pairs would give.
    """
    enough = least_agreeing(threshold)
    rows = tables.write(rows.select("band", "id").repartition("band").sortWithinPartitions("band").mapInArrow(_repeated, "band long, id long"))
    all_rows, rows = rows, tables.write(rows.join(marked.select("id", "m1", "m2").hint("merge"), "id"))
    tables.drop(all_rows)
    del all_rows
    tables.release()
    known = prepare(rows.select("id").distinct())
    least = rows.groupBy("band").agg(F.min("id").alias("least"))
    head = rows.join(least, "band").where("id = least").select("band", F.col("id").alias("a"), F.col("m1").alias("xm1"), F.col("m2").alias("xm2"))
    rest = rows.select("band", F.col("id").alias("b"), F.col("m1").alias("ym1"), F.col("m2").alias("ym2"))
    pairs = tables.write(head.join(rest, "band").where((F.col("a") != F.col("b")) & (agreeing("x", "y") >= enough)).select("a", "b").distinct())
    first = verify(known, pairs)
    root = tables.write(components(first, tables))
    placed = rows.select("band", "id", "m1", "m2").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    placed = tables.write(placed.join(apart, "band"))
    x, y = (placed.select("band", F.col("id").alias(i), F.col("root").alias(r), F.col("m1").alias(s + "m1"), F.col("m2").alias(s + "m2")) for i, r, s in (("a", "p", "x"), ("b", "q", "y")))
    more = x.join(y, "band").where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & (agreeing("x", "y") >= enough)).select("a", "b").distinct()
    second = verify(known, more.join(pairs, ["a", "b"], "left_anti"))
    named = root.withColumnRenamed("root", "to")
    joins = second
    for c in ("a", "b"):  # components of the first pairs are nodes of the second ones
        joins = joins.join(named.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    top = tables.write(components(joins, tables))
    lower = root.join(top.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    out = tables.write(lower.union(top.join(root, "id", "left_anti").select("id", "root")))
    tables.drop(rows, known, pairs, first, root, placed, second, top)
    return out
