"""Counting over events: frequencies of names, co-occurrence, background, conditional probabilities.

Pairs are made inside each event by nested generators, so that counting is one shuffle of partial sums, with no join.
Equal events are added up first (`compact`), which for tables of few kinds leaves next to nothing to pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENVIRON = "Environ"


def compact(events: DataFrame) -> DataFrame:
    """Each kind of event (same cues, same outcomes) once, with its frequencies added up."""
    return events.groupBy("cues", "outcomes").agg(F.sum("freq").alias("freq"))


def name_counts(events: DataFrame, of: str = "cues") -> DataFrame:
    """(name, n): frequency-weighted, each occurrence in an event counted."""
    return events.select(F.explode(of).alias("name"), "freq").groupBy("name").agg(F.sum("freq").alias("n"))


def cooccurrence(events: DataFrame, unique: bool = True) -> DataFrame:
    """(cue1, cue2, n), both orders and the diagonal.

    With unique=False a cue that an event has n times counts n times on the diagonal and n x m times beside it.
    """
    e = compact(events.select(F.array_sort(F.array_distinct("cues") if unique else "cues").alias("cues"), F.array().cast("array<string>").alias("outcomes"), "freq"))
    one = e.select("cues", "freq", F.posexplode("cues").alias("i", "cue1"))
    two = one.select("i", "cue1", "freq", F.posexplode("cues").alias("j", "cue2"))
    return two.where("cue1 <> cue2 or i = j").groupBy("cue1", "cue2").agg(F.sum("freq").alias("n"))


def cue_outcome(events: DataFrame, unique: bool = True) -> DataFrame:
    """(cue, outcome, n); an outcome counts once in an event, a cue as often as it is there unless unique."""
    e = compact(events.select(F.array_sort(F.array_distinct("cues") if unique else "cues").alias("cues"), F.array_sort(F.array_distinct("outcomes")).alias("outcomes"), "freq"))
    one = e.select("outcomes", "freq", F.explode("cues").alias("cue"))
    return one.select("cue", F.explode("outcomes").alias("outcome"), "freq").groupBy("cue", "outcome").agg(F.sum("freq").alias("n"))


def background(events: DataFrame) -> DataFrame:
    """(cue, outcome, n) of the cue Environ, which every event has."""
    return events.select(F.explode(F.array_distinct("outcomes")).alias("outcome"), "freq").groupBy("outcome").agg(F.sum("freq").alias("n")).select(F.lit(ENVIRON).alias("cue"), "outcome", "n")


def with_background(events: DataFrame, cues: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both counts with the cue Environ added; its own count is the sum of all frequencies."""
    each = cues.where("cue1 = cue2").select("cue1", "n")
    e = F.lit(ENVIRON)
    corner = events.agg(F.sum("freq").alias("n")).where("n is not null").select(e.alias("cue1"), e.alias("cue2"), "n")
    more = each.select("cue1", e.alias("cue2"), "n").union(each.select(e.alias("cue1"), F.col("cue1").alias("cue2"), "n")).union(corner)
    return cues.unionByName(more), outcomes.unionByName(background(events))


def cue_probabilities(cues: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(cue1, cue2, p): of cue2 where cue1 is. totals: (cue, total) to divide by instead of the diagonal; 0 counts as 1."""
    t = totals if totals is not None else cues.where("cue1 = cue2").select(F.col("cue1").alias("cue"), F.col("n").alias("total"))
    return cues.join(t.withColumnRenamed("cue", "cue1"), "cue1", "left").select("cue1", "cue2", (F.col("n") / _divisor()).alias("p"))


def outcome_probabilities(outcomes: DataFrame, totals: DataFrame) -> DataFrame:
    """(cue, outcome, p): of the outcome where the cue is. totals: (cue, total)."""
    return outcomes.join(totals, "cue", "left").select("cue", "outcome", (F.col("n") / _divisor()).alias("p"))


def _divisor():
    return F.when(F.coalesce(F.col("total"), F.lit(0)) == 0, 1).otherwise(F.col("total"))


def diagonal(cues: DataFrame) -> DataFrame:
    """(cue, total) of the cue counts."""
    return cues.where("cue1 = cue2").select(F.col("cue1").alias("cue"), F.col("n").alias("total"))


def row_sums(outcomes: DataFrame) -> DataFrame:
    """(cue, total) of the cue-outcome counts, the older way of normalising."""
    return outcomes.groupBy("cue").agg(F.sum("n").alias("total"))
