"""Learning from streams: weights kept as state, and co-occurrence counts that grow with each micro-batch."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import counts as K
from ..operators.learn import Block, Rates


def stream_weights(events: DataFrame, outcomes: list[str], rates: Rates = Rates(), blocks: int = 8, unique: bool = True) -> DataFrame:
    """A stream of (block, next_event, late, cue, outcome, weight): each block's weights whenever it has learned.

    events: a stream (event_id, cues, outcomes), event_id from 0 without gaps. What comes early waits until the gap is
    filled; what was learned before is counted as late and dropped. The outcomes are given, since all are updated by
    every event. Use output mode "update".
    """
    if rates.alphas is not None or rates.betas is not None:
        raise ValueError("streams learn with the default rates")
    parts = {b: outcomes[b::blocks] for b in range(min(blocks, len(outcomes)))}
    lam, alpha, beta = float(rates.lam), float(rates.alpha), float(rates.beta)

    def update(key, frames, state: GroupState):
        (b,) = key
        now, at, late, waiting = Block(lam, unique, alpha), 0, 0, {}
        for o in parts[b]:
            now.outcome(o, beta)
        if state.exists:
            at, late, cues, w, early = state.get
            for c in json.loads(cues):
                now._row(c)
            if now.w is not None:
                now.w[: len(now.cues)] = np.frombuffer(bytes.fromhex(w)).reshape(len(now.cues), -1)
            waiting = {int(k): v for k, v in json.loads(early).items()}
        for f in frames:
            for e, c, o in zip(f["event_id"], f["cues"], f["outcomes"]):
                if e < at or int(e) in waiting:
                    late += 1
                else:
                    waiting[int(e)] = (list(c), list(o))
        while at in waiting:
            c, o = waiting.pop(at)
            now.event(c, None, o)
            at += 1
        n = len(now.cues)
        w = np.ascontiguousarray(now.w[:n]) if now.w is not None else np.zeros((0, len(now.beta)))
        state.update((at, late, json.dumps(list(now.cues)), w.tobytes().hex(), json.dumps(waiting)))
        names, k = list(now.cues), len(now.beta)
        yield pd.DataFrame({"block": np.full(n * k, b, np.int32), "next_event": np.full(n * k, at), "late": np.full(n * k, late), "cue": np.repeat(np.array(names, object), k), "outcome": list(now.names) * n, "weight": w.reshape(-1)})

    every = events.select(F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))).alias("block"), "event_id", "cues", "outcomes")
    return every.groupBy("block").applyInPandasWithState(
        update,
        "block int, next_event long, late long, cue string, outcome string, weight double",
        "next_event long, late long, cues string, weights string, early string",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def stream_counts(events: DataFrame) -> DataFrame:
    """A stream of (kind, a, b, n): cue-cue and cue-outcome counts so far, for equilibrium weights. Output mode "update" or
    "complete"; the counts of a batch are partial sums in the JVM."""
    cues = F.array_distinct("cues")
    pairs = events.select(cues.alias("cues"), F.array_distinct("outcomes").alias("outcomes"), "freq")
    one = pairs.select("cues", "outcomes", "freq", F.explode("cues").alias("a"))
    both = one.select("a", "freq", F.explode(F.concat(F.transform("cues", lambda x: F.struct(F.lit("cue").alias("kind"), x.alias("b"))), F.transform("outcomes", lambda x: F.struct(F.lit("outcome").alias("kind"), x.alias("b"))))).alias("x"))
    return both.groupBy("x.kind", "a", "x.b").agg(F.sum("freq").alias("n"))


def weights_of(counts: DataFrame) -> DataFrame:
    """Equilibrium weights of what stream_counts() has come to."""
    from ..operators.equilibrium import weights_from_counts

    cues = counts.where("kind = 'cue'").select(F.col("a").alias("cue1"), F.col("b").alias("cue2"), "n")
    outs = counts.where("kind = 'outcome'").select(F.col("a").alias("cue"), F.col("b").alias("outcome"), "n")
    return weights_from_counts(cues, outs)


__all__ = ["stream_weights", "stream_counts", "weights_of", "K"]
