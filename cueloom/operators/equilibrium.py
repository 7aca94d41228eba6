"""Association weights at equilibrium: W = pinv(P) Q, from conditional probabilities.

Counting is distributed; P (cues x cues) is the only matrix that is held whole, in the driver, where it is inverted.
It doesn't grow with the events, only with the distinct cues, whose number is checked against LARGEST. Its inverse goes
to the executors in row blocks as a table, and the product with Q is a join and a sum, so that the number of outcomes
is unbounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts as K
from .order import written

#: Beyond so many cues the inverse is a randomised one of a lower rank.
EXACT = 20_000
#: Beyond so many it isn't tried: use iterative learning, or keep fewer cues.
LARGEST = 40_000


def pinv(p: np.ndarray, tolerance: float = np.sqrt(np.finfo(float).eps)) -> np.ndarray:
    """Moore-Penrose; singular values up to `tolerance` times the largest count as 0."""
    u, s, v = np.linalg.svd(p, full_matrices=False)
    keep = s > max(tolerance * (s[0] if len(s) else 0), 0)
    return (v[keep].T / s[keep]) @ u[:, keep].T


def randomised_pinv(p: np.ndarray, rank: int | None = None, over: int = 200, seed: int = 1) -> np.ndarray:
    """Of the leading singular values (three quarters of them unless said otherwise), by a random projection."""
    n, m = p.shape
    k = int(n * 0.75) if rank is None else rank
    if k > n:
        raise ValueError("rank: at most the matrix's size")
    y = p @ np.random.default_rng(seed).standard_normal((m, min(k + over, m)))
    q, _ = np.linalg.qr(y)
    u, s, v = np.linalg.svd(q.T @ p, full_matrices=False)
    keep = s > (s[0] if len(s) else 0) * 1e-12
    return (v[keep].T / s[keep]) @ (q @ u[:, keep]).T


def weights_from_counts(cues: DataFrame, outcomes: DataFrame, by_row_sum: bool = False, exact: int = EXACT) -> DataFrame:
    """(cue, outcome, weight) of every cue and outcome."""
    spark = cues.sparkSession
    totals = K.row_sums(outcomes) if by_row_sum else K.diagonal(cues)
    p = K.cue_probabilities(cues, totals).toArrow()
    a, b = (p.column(i).to_numpy() for i in (0, 1))
    names, at = np.unique(np.concatenate([a, b]).astype(str), return_inverse=True)
    n = len(names)
    if n > LARGEST:
        raise ValueError(f"{n} cues: the pseudo-inverse takes {LARGEST} at most")
    if not n:
        return outcomes.select("cue", "outcome", F.lit(0.0).alias("weight")).limit(0)
    dense = np.zeros((n, n))
    dense[at[: len(a)], at[len(a) :]] = p.column(2).to_numpy()
    inverse = pinv(dense) if n < exact else randomised_pinv(dense)
    columns = pa.table({"cue": pa.array(names), "inverse": pa.array(list(np.ascontiguousarray(inverse.T)), pa.list_(pa.float64()))})
    q = K.outcome_probabilities(outcomes, totals)
    # W[:, o] = sum over cues c of inverse[:, c] Q[c, o]: one row of the sum for each outcome, added up position by position
    inv = written(spark.createDataFrame(columns), "inverse")

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for x in batches:
            o, w, v = x.column(0).to_pylist(), x.column(1).to_numpy(zero_copy_only=False), x.column(2)
            flat = v.flatten().to_numpy().reshape(len(o), n)
            for i, name in enumerate(o):
                if name in total:
                    total[name] += w[i] * flat[i]
                else:
                    if total:  # sorted by outcome: the one before is complete
                        yield _rows(total, names)
                        total = {}
                    total[name] = w[i] * flat[i]
        if total:
            yield _rows(total, names)

    joined = q.join(inv, "cue").select("outcome", "p", "inverse")
    return joined.repartition("outcome").sortWithinPartitions("outcome").mapInArrow(add, "cue string, outcome string, weight double")


def _rows(total: dict[str, np.ndarray], names: np.ndarray) -> pa.RecordBatch:
    (outcome, w), = total.items()
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array([outcome] * len(names), pa.string()), pa.array(w)], ["cue", "outcome", "weight"])


def estimate_weights(
    events: DataFrame,
    unique: bool = True,
    by_row_sum: bool = False,
    add_background: bool = False,
    max_events: int | None = None,
    cached_counts: str | None = None,
) -> DataFrame:
    """(cue, outcome, weight) at equilibrium. events: (event_id, cues, outcomes, freq).

    max_events: only events with a lower event_id. cached_counts: a folder where the counts are kept as Parquet; counts
    that are there already are used instead of the events. One cue and one outcome alone can't be told apart: an error.
    """
    spark = events.sparkSession
    if add_background and by_row_sum:
        raise ValueError("a background goes with the diagonal's probabilities only")
    if max_events is not None:
        events = events.where(F.col("event_id") < max_events)
    if cached_counts and _exists(spark, cached_counts + "/cues"):
        cues, outcomes = spark.read.parquet(cached_counts + "/cues"), spark.read.parquet(cached_counts + "/outcomes")
    else:
        events = guarded(events)
        cues, outcomes = K.cooccurrence(events, unique), K.cue_outcome(events, unique)
        if add_background:
            cues, outcomes = K.with_background(events, cues, outcomes)
        if cached_counts:
            cues.write.parquet(cached_counts + "/cues")
            outcomes.write.parquet(cached_counts + "/outcomes")
            cues, outcomes = spark.read.parquet(cached_counts + "/cues"), spark.read.parquet(cached_counts + "/outcomes")
        else:
            cues, outcomes = written(cues, "cues"), written(outcomes, "outcomes")
    sizes = outcomes.agg(F.count_distinct("cue"), F.count_distinct("outcome")).first()
    if sizes[0] == 1 and sizes[1] == 1:
        raise ValueError("one cue and one outcome only: nothing to estimate")
    return weights_from_counts(cues, outcomes, by_row_sum)


def guarded(events: DataFrame) -> DataFrame:
    """Events, with an error where cues or outcomes are null or hold an empty name."""
    for c in ("cues", "outcomes"):
        bad = F.col(c).isNull() | F.exists(c, lambda x: x.isNull() | (x == ""))
        events = events.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c}: nulls or empty names")).cast("array<string>")).otherwise(F.col(c)))
    return events


def residual(weights: DataFrame, cues: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(outcome, gap): the largest |P W - Q| of each outcome, 0 where Q lies in the range of P."""
    totals = K.diagonal(cues)
    p, q = K.cue_probabilities(cues, totals), K.outcome_probabilities(outcomes, totals)
    pw = p.join(weights.withColumnRenamed("cue", "cue2"), "cue2").groupBy(F.col("cue1").alias("cue"), "outcome").agg(F.sum(F.col("p") * F.col("weight")).alias("pw"))
    return pw.join(q, ["cue", "outcome"], "left").groupBy("outcome").agg(F.max(F.abs(F.col("pw") - F.coalesce("p", F.lit(0.0)))).alias("gap"))


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
