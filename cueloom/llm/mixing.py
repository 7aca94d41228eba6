"""Mixing sources to target weights by iterative proportional fitting.

The tokens (words) of all documents are counted by source, language and topic. Raking scales these cells in turn until
their sums agree with the targets of each of the three margins; a cell's factor is its calibrated weight a token.
Documents are then sampled: each is kept with probability min(1, scale * factor of its cell), where the scale makes
the expected tokens equal BUDGET of all tokens. The draw is a hash of the document's id, so a rerun keeps the same rows.

The topic is found from the words: the vocabulary is hashed to TOPICS classes, and a document gets the class whose
share in it exceeds most its share of the whole corpus. Targets are given as {category: weight}; without one a margin's
targets are its shares of tokens to the power TEMPER, which lifts small categories.

Cases: a null or empty text has no tokens and is never sampled; a null source or language is a category of its own;
a target without documents is left out and the others scaled up, a category without a target gets 0; equal lifts go to
the lower class; very long texts are counted whole; repeated rows are drawn alike; a row without doc_id is drawn by its text; an empty table gives an
empty result; the operator's columns topic, tokens and mix_weight take the place of such columns of the input (topic and
tokens stay as _input_topic and _input_tokens), the stage returns the input's columns and mix_weight, the inverse of
the probability, which takes the place of one of that name. After ROUNDS rounds raking ends with a warning.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TOPICS = 8
TEMPER = 0.7
BUDGET = 0.5
SEED = 20
ROUNDS, ENOUGH = 500, 1e-10
#: Up to so many cells are raked in the driver's memory; more are raked as tables, with the same result.
LOCAL_CELLS = 200_000
MARGINS = ("source", "lang", "topic")


def _counted(col: pa.Array) -> np.ndarray:
    buf, off = C.text_bytes(col)
    h, row, _, _ = C.words(buf, off)
    t = (h >> C.U64(33)).astype(np.int64) % TOPICS
    return np.bincount(row * TOPICS + t, minlength=len(col) * TOPICS).reshape(len(col), TOPICS)


def _class_totals(batches):
    total = np.zeros(TOPICS, np.int64)
    for b in C.slices(batches, 0):
        total += _counted(b.column(0)).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(range(TOPICS), pa.int32()), pa.array(total)], ["class", "n"])


def class_totals(docs: DataFrame) -> np.ndarray:
    """Words of each vocabulary class in all documents."""
    out = np.zeros(TOPICS, np.int64)
    for r in docs.select(F.lower("text")).mapInArrow(_class_totals, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r["n"]
    return out


def _topic_of(totals: np.ndarray):
    scale = 1.0 / np.maximum(totals, 1)

    @F.arrow_udf("struct<topic:int,tokens:bigint>")
    def topic(text: pa.Array) -> pa.Array:
        parts = []
        for b in C.slices([pa.RecordBatch.from_arrays([text], ["t"])], 0):
            n = _counted(b.column(0))
            tokens = n.sum(1)
            parts.append(pa.StructArray.from_arrays([pa.array((n * scale).argmax(1).astype(np.int32), mask=tokens == 0), pa.array(tokens)], ["topic", "tokens"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("topic", pa.int32()), ("tokens", pa.int64())]))

    return topic(F.lower("text"))


def _targets(shares: dict, given: dict | None) -> dict:
    raw = {k: (given.get(k, 0.0) if given is not None else v**TEMPER) for k, v in shares.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else {k: 0.0 for k in raw}


def rake(keys: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Cells' weights (sum 1). keys: a column of category numbers for each margin."""
    w = tokens / max(tokens.sum(), 1)
    for _ in range(ROUNDS):
        off = 0.0
        for m, goal in enumerate(targets):
            now = np.bincount(keys[:, m], w, len(goal))
            ratio = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            off = max(off, float(np.abs(goal - now).max(initial=0)))
            w = w * ratio[keys[:, m]]
        if off < ENOUGH:
            return w
    warnings.warn(f"raking hasn't settled in {ROUNDS} rounds: margins are off by {off:.2g}", stacklevel=2)
    return w


def scale_for(budget: float, tokens: np.ndarray, factor: np.ndarray) -> float:
    """The scale for which sum(tokens * min(1, scale * factor)) is the budget, or as near as it can be."""
    use = factor > 0
    t, f = tokens[use], factor[use]
    order = np.argsort(-f, kind="stable")
    t, f = t[order], f[order]
    full = np.concatenate([[0], np.cumsum(t)])
    rest = np.concatenate([np.cumsum((t * f)[::-1])[::-1], [0]])
    for k in range(len(f)):  # the first k are taken whole
        if rest[k] > 0 and (s := (budget - full[k]) / rest[k]) * f[k] <= 1:
            return max(float(s), 0.0)
    return float(1 / f[-1]) if len(f) else 0.0


def _local_factors(cells: DataFrame, given: dict) -> DataFrame:
    spark = cells.sparkSession
    rows = sorted(cells.collect(), key=lambda r: tuple((r[m] is None, str(r[m])) for m in MARGINS))
    names = [sorted({r[m] for r in rows}, key=lambda x: (x is None, str(x))) for m in MARGINS]
    keys = np.array([[names[i].index(r[m]) for i, m in enumerate(MARGINS)] for r in rows], np.int64).reshape(len(rows), 3)
    tokens = np.array([r["tokens"] for r in rows], float)
    goals = []
    for i, m in enumerate(MARGINS):
        share = np.bincount(keys[:, i], tokens, len(names[i])) / max(tokens.sum(), 1)
        t = _targets(dict(zip(names[i], share)), given.get(m))
        goals.append(np.array([t[x] for x in names[i]]))
    factor = rake(keys, tokens, goals) / np.maximum(tokens, 1)
    p = np.minimum(1.0, scale_for(BUDGET * tokens.sum(), tokens, factor) * factor)
    found = spark.createDataFrame([(*(r[m] for m in MARGINS), float(x)) for r, x in zip(rows, p)], "source string, lang string, topic int, p double")
    return F.broadcast(found)  # LOCAL_CELLS rows at most


def _table_factors(cells: DataFrame, given: dict, tables: C.Tables) -> DataFrame:
    """The same over tables, for more cells than the driver should hold; each margin has fewer categories than cells."""
    spark = cells.sparkSession
    cells = tables.write(cells)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    w = tables.write(cells.withColumn("w", F.col("tokens") / F.lit(float(total))))
    goals = {}
    for m in MARGINS:
        share = w.groupBy(m).agg(F.sum("w").alias("s"))
        raw = F.pow("s", F.lit(TEMPER))
        if given.get(m) is not None:
            t = spark.createDataFrame(list(given[m].items()), f"{m} {dict(cells.dtypes)[m]}, raw double")
            share, raw = share.join(t, share[m].eqNullSafe(t[m]), "left").select(share[m], F.coalesce("raw", F.lit(0.0)).alias("s")), F.col("s")
        share = share.select(m, raw.alias("goal"))
        s = share.agg(F.sum("goal")).first()[0] or 1.0
        goals[m] = tables.write(share.withColumn("goal", F.col("goal") / F.lit(s)))
    for _ in range(ROUNDS):
        off = 0.0
        for m in MARGINS:
            now = tables.write(w.groupBy(m).agg(F.sum("w").alias("now")))
            g = goals[m]
            off = max(off, now.join(g, now[m].eqNullSafe(g[m])).agg(F.max(F.abs(F.col("goal") - F.col("now")))).first()[0] or 0.0)
            ratio = now.join(g, now[m].eqNullSafe(g[m])).select(g[m].alias("k"), F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("ratio"))
            nxt = tables.write(w.join(ratio, w[m].eqNullSafe(ratio["k"])).select(*MARGINS, "tokens", (F.col("w") * F.col("ratio")).alias("w")))
            tables.drop(w, now)
            w = nxt
        if off < ENOUGH:
            break
    else:
        warnings.warn(f"raking hasn't settled in {ROUNDS} rounds: margins are off by {off:.2g}", stacklevel=2)
    f = F.col("w") / F.col("tokens")
    lo, hi = 0.0, float(w.where("w > 0").agg(F.max(F.col("tokens") / F.col("w"))).first()[0] or 1.0)
    for _ in range(7):  # each time a 256th of the interval
        grid = np.linspace(lo, hi, 257)
        got = w.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(float(x)) * f)).alias(f"g{i}") for i, x in enumerate(grid))).first()
        at = int(np.searchsorted(np.array([got[i] or 0.0 for i in range(257)]), BUDGET * total))
        at = min(max(at, 1), 256)
        lo, hi = float(grid[at - 1]), float(grid[at])
    return w.select(*MARGINS, F.least(F.lit(1.0), F.lit(hi) * f).alias("p"))


def probabilities(counted: DataFrame, given: dict | None = None, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """(source, lang, topic, p) of every cell. counted: source, lang, topic, tokens."""
    cells = counted.where("tokens > 0").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    tables = C.Tables(counted.sparkSession, "mix")
    cells = tables.write(cells)
    if cells.count() <= local_cells:
        return _local_factors(cells, given or {})
    return _table_factors(cells, given or {}, tables)


def sample(docs: DataFrame, given: dict | None = None, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """The sampled rows with their columns, topic, tokens and mix_weight (1 / probability). given: targets by margin."""
    text = _topic_of(class_totals(docs))
    r, s, l, t, q = C.free_name(docs, "_r", "_s", "_l", "_t", "_p")
    with_topic = docs.withColumn(r, text).where(F.col(f"{r}.tokens") > 0)
    counted = with_topic.select(docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.col(f"{r}.topic").alias("topic"), F.col(f"{r}.tokens").alias("tokens"))
    p = probabilities(counted, given, local_cells)
    p = p.select(F.col("source").alias(s), F.col("lang").alias(l), F.col("topic").alias(t), F.col("p").alias(q))
    drawn = F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), docs["text"]), F.lit(SEED)).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    hit = with_topic.join(p, docs["source"].cast("string").eqNullSafe(F.col(s)) & docs["lang"].cast("string").eqNullSafe(F.col(l)) & (F.col(f"{r}.topic") == F.col(t))).where(drawn < F.col(q))
    own = [C.col(c) for c in docs.columns if c.lower() not in ("topic", "tokens", "mix_weight")]
    return hit.select(*own, F.col(f"{r}.topic").alias("topic"), F.col(f"{r}.tokens").alias("tokens"), (F.lit(1.0) / F.col(q)).alias("mix_weight"), *(C.col(c).alias(f"{KEPT}{c}") for c in docs.columns if c.lower() in ("topic", "tokens")))


#: What the stage finds columns by that the operator's have replaced.
KEPT = "_input_"


def mixed(docs: DataFrame) -> DataFrame:
    """The stage: the input's columns and mix_weight."""
    replaced = ("topic", "tokens")
    return sample(docs).select(*(C.col(KEPT + c).alias(c) if c.lower() in replaced else C.col(c) for c in docs.columns if c.lower() != "mix_weight"), "mix_weight")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return sample(docs).select("doc_id", "source", "lang", "topic", "tokens", "mix_weight")
