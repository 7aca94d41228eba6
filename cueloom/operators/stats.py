"""How well predictions fit: crosstables and their statistics, likelihoods, concordance. rows: (key, observed, freq)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crosstable(rows: DataFrame) -> DataFrame:
    """(observed, predicted, n). rows: (observed, predicted, freq)."""
    return rows.groupBy("observed", "predicted").agg(F.sum("freq").alias("n"))


def class_scores(table: DataFrame) -> DataFrame:
    """(outcome, recall, precision) of each outcome; null where nothing was observed, or predicted."""
    right = table.where("observed = predicted").select(F.col("observed").alias("outcome"), F.col("n").alias("hit"))
    seen = table.groupBy(F.col("observed").alias("outcome")).agg(F.sum("n").alias("seen"))
    said = table.groupBy(F.col("predicted").alias("outcome")).agg(F.sum("n").alias("said"))
    hit = F.coalesce("hit", F.lit(0))
    return seen.join(said, "outcome", "full").join(right, "outcome", "left").select("outcome", (hit / F.col("seen")).alias("recall"), (hit / F.col("said")).alias("precision"))


def table_scores(table: DataFrame) -> DataFrame:
    """One row: accuracy, lambda and tau of the crosstable, their standardised differences and one-sided p-values."""
    rows = table.groupBy("observed").agg(F.sum("n").alias("r"))
    n = rows.agg(F.sum("r").alias("total"))
    e0 = rows.crossJoin(F.broadcast(n)).agg(F.max("total").alias("total"), (F.max("total") - F.max("r")).alias("e_lambda"), F.sum(F.col("r") * (F.col("total") - F.col("r")) / F.col("total")).alias("e_tau"))
    hit = table.agg(F.sum(F.when(F.col("observed") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    x = e0.crossJoin(hit).withColumn("e", F.col("total") - F.col("hit"))

    def d(e):
        return (e - F.col("e")) / F.col("total") / F.sqrt(e / F.col("total") * (1 - e / F.col("total")) / F.col("total"))

    x = x.select(
        (F.col("hit") / F.col("total")).alias("accuracy"),
        (1 - F.col("e") / F.col("e_lambda")).alias("lambda"),
        (1 - F.col("e") / F.col("e_tau")).alias("tau"),
        d(F.col("e_lambda")).alias("d_lambda"),
        d(F.col("e_tau")).alias("d_tau"),
    )
    return x.withColumn("p_lambda", upper_normal(F.col("d_lambda"))).withColumn("p_tau", upper_normal(F.col("d_tau")))


def upper_normal(x):
    """1 - the normal distribution function: a continued fraction's tail and a series' centre, as one fitted rational.

    The complementary error function by Chebyshev coefficients (fractional error below 1.2e-7 everywhere).
    """
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + z / 2)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = t * F.exp(poly - z * z) / 2
    return F.when(x >= 0, tail).otherwise(1 - tail)


def likelihood(p: DataFrame, rows: DataFrame, zero: float = 1e-10, parameters: int = 0, key: str = "event_id", normalise: bool = True) -> DataFrame:
    """One row: log-likelihoods and deviances of the model and without one, R2 (likelihood, Nagelkerke), AIC, BIC.

    p: (key, outcome, p); rows: (key, observed, freq); zero stands for a probability of 0; parameters: the model's.
    """
    if normalise:
        p = p.select(key, "outcome", (F.col("p") / F.sum("p").over(Window.partitionBy(key))).alias("p"))
    hit = rows.join(p, (rows[key] == p[key]) & (rows["observed"] == p["outcome"]), "left").select("freq", F.when(F.coalesce("p", F.lit(0.0)) == 0, zero).otherwise(F.col("p")).alias("p"))
    model = hit.agg(F.sum(F.col("freq") * F.log("p")).alias("ll_model"))
    classes = rows.groupBy("observed").agg(F.sum("freq").alias("n"))
    total = classes.agg(F.sum("n").alias("total"))
    null = classes.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("total"))).alias("ll_null"), F.max("total").alias("total"))
    m, z, n, k = F.col("ll_model"), F.col("ll_null"), F.col("total"), F.lit(parameters)
    return model.crossJoin(null).select(
        "ll_null",
        "ll_model",
        (-2 * z).alias("deviance_null"),
        (-2 * m).alias("deviance_model"),
        (1 - m / z).alias("r2_likelihood"),
        ((1 - F.exp(-2 * (m - z) / n)) / (1 - F.exp(2 * z / n))).alias("r2_nagelkerke"),
        (2 * k - 2 * m).alias("aic"),
        (k * F.log(n) - 2 * m).alias("bic"),
    )


def degrees_of_freedom(n_data: int, n_outcomes: int, parameters: int) -> tuple[int, int]:
    """(null, model)."""
    return n_outcomes * n_data, n_outcomes * n_data - parameters


def concordance(scored: DataFrame) -> DataFrame:
    """One row c: the share of (positive, negative) pairs in which the positive one scores higher, ties counting half.

    scored: (score, positive boolean, freq). Equal scores are added up first; what is ranked are the distinct scores,
    range-partitioned sums giving the running totals of each.
    """
    g = scored.groupBy("score").agg(F.sum(F.when(F.col("positive"), F.col("freq")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("positive"), 0).otherwise(F.col("freq"))).alias("neg"))
    below = running(g, "score", "neg")
    x = below.agg(F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return x.select((F.col("won") / (F.col("pos") * F.col("neg"))).alias("c"))


def running(df: DataFrame, by: str, value: str, buckets: int = 64) -> DataFrame:
    """df with `before`, the sum of value over all rows that are less by `by`: sums of value ranges, then within each."""
    ends = df.agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / buckets
    b = df.crossJoin(F.broadcast(ends)).withColumn("_b", F.when(width > 0, F.least(F.floor((F.col(by) - F.col("_lo")) / width), F.lit(buckets - 1))).otherwise(0))
    sums = b.groupBy("_b").agg(F.sum(value).alias("_s"))
    offset = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # `buckets` rows
    w = Window.partitionBy("_b").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("_w", F.coalesce(F.sum(value).over(w), F.lit(0))).join(F.broadcast(offset), "_b").select(*df.columns, (F.col("_o") + F.col("_w")).alias("before"))


def chi_square_tail(spark, x: float, df: float) -> float:
    """1 - the chi-square distribution function, from the mathematics library on Spark's classpath."""
    if df <= 0:
        return float("nan")
    return 1.0 - spark.sparkContext._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(df)).cumulativeProbability(float(x))
