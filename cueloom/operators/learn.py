"""Iterative (Rescorla-Wagner) learning: the events replayed in order, every outcome's weights updated by each.

Outcomes don't influence each other, so that they are cut in blocks, and each block replays all events by itself. The
events are packed first, where they are: runs of CHUNK event numbers, each with its kinds of events once and a code for
each event. What a block's task sorts and reads are runs, few bytes for an event; memory holds a run and the block's
weights, however many events there are.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import written

BLOCK = 64
#: Up to so many outcomes have a block each; blocks of up to FEW outcomes are replayed by numbers, others by numpy rows.
SINGLE, FEW = 16, 8
SHIFT = 15
CHUNK = 1 << SHIFT
_OUT = "event_count long, cue string, outcome string, weight double"


@dataclass(frozen=True)
class Rates:
    """Learning rates; alphas: (cue, value) and betas: (outcome, value) override the defaults. Values outside (0, 1] don't count."""

    alpha: float = 0.1
    beta: float = 0.1
    lam: float = 1.0
    alphas: DataFrame | None = None
    betas: DataFrame | None = None

    def __post_init__(self):
        for name in ("alpha", "beta"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name}: above 0, at most 1")
        if self.lam <= 0:
            raise ValueError("lam: above 0")


@dataclass
class Block:
    """The weights of a block of outcomes, replayed event by event."""

    lam: float
    unique: bool
    alpha: float
    names: dict[str, int] = field(default_factory=dict)
    beta: list[float] = field(default_factory=list)
    cues: dict[str, int] = field(default_factory=dict)
    w: np.ndarray | None = None
    alphas: dict[str, float] = field(default_factory=dict)

    def outcome(self, name: str, beta: float) -> None:
        self.names[name] = len(self.beta)
        self.beta.append(beta)

    def _row(self, cue: str) -> int:
        if self.w is None:
            self.b = np.array(self.beta)
            self.w = np.zeros((256, len(self.beta)))
        i = self.cues.setdefault(cue, len(self.cues))
        if i >= len(self.w):
            self.w = np.concatenate([self.w, np.zeros_like(self.w)])
        return i

    def put(self, cue: str, outcome: str, weight: float) -> None:
        i = self._row(cue)
        if outcome in self.names:
            self.w[i, self.names[outcome]] = weight

    def event(self, cues: Sequence[str], alphas: Sequence[float] | None, outcomes: Iterable[str]) -> None:
        if len(cues):
            self._step(*self._prepared(cues, alphas, outcomes))

    def _prepared(self, cues, alphas, outcomes):
        rows = np.array([self._row(c) for c in cues])
        a = np.full(len(rows), self.alpha) if alphas is None else np.array(alphas)
        if self.unique and len(rows) > 1:
            rows, first = np.unique(rows, return_index=True)
            a = a[first]
        m = np.zeros(len(self.b))
        for o in outcomes:
            if (k := self.names.get(o)) is not None:
                m[k] = 1 if self.unique else m[k] + 1
        return rows, a[:, None], self.lam * m, np.maximum(m, 1)

    def _step(self, rows, a, goal, times) -> None:
        v = self.w[rows].sum(0)
        step = self.b * (goal - v * times)
        if self.unique:
            self.w[rows] += a * step
        else:
            np.add.at(self.w, rows, a * step)

    def run(self, kinds: Sequence[tuple], codes: Sequence[int]) -> None:
        """Events by their kinds, (cues, outcomes), which are numbered in the order in which they first come."""
        ready: dict[int, tuple] = {}
        for c in codes:
            if c not in ready:
                cues, outs = kinds[c]
                ready[c] = self._prepared(cues, [self.alphas.get(x, self.alpha) for x in cues], outs) if cues else ()
            if k := ready[c]:
                self._step(*k)

    def table(self, count: int, changed: bool = True) -> pa.RecordBatch:
        n, k = len(self.cues), len(self.beta)
        w = self.w[:n] if self.w is not None else np.zeros((n, k))
        cues, outs = np.array(list(self.cues), object), np.array(list(self.names), object)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n * k, count)), pa.array(np.repeat(cues, k), pa.string()), pa.array(np.tile(outs, n), pa.string()), pa.array(np.ascontiguousarray(w).reshape(-1))],
            ["event_count", "cue", "outcome", "weight"],
        )

    def column(self, name: str) -> np.ndarray:
        n = len(self.cues)
        return self.w[:n, self.names[name]] if self.w is not None else np.zeros(n)


class Few(Block):
    """A block of few outcomes: plain numbers, one outcome after another, with the same steps in the same order."""

    def _row(self, cue: str) -> int:
        if self.w is None:
            self.w = [[] for _ in self.beta]
        i = self.cues.setdefault(cue, len(self.cues))
        if i == len(self.w[0]):
            for x in self.w:
                x.append(0.0)
        return i

    def put(self, cue: str, outcome: str | None, weight: float) -> None:
        i = self._row(cue)
        if outcome in self.names:
            self.w[self.names[outcome]][i] = weight

    def _steps(self, kinds: Sequence[tuple], used: int) -> list[list[tuple]]:
        """For each outcome (rows with their alphas, goal, times) of the first `used` kinds; registers their cues."""
        out = [[] for _ in self.beta]
        for cues, outs in kinds[:used]:
            rows = [(self._row(c), self.alphas.get(c, self.alpha)) for c in cues]
            rows = tuple(sorted(dict(rows).items())) if self.unique else tuple(rows)
            for name, k in self.names.items():
                m = float(outs.count(name))
                m = min(m, 1.0) if self.unique else m
                out[k].append((rows, self.lam * m, max(m, 1.0)))
        return out

    def run(self, kinds: Sequence[tuple], codes: Sequence[int]) -> None:
        if not codes:
            return
        for w, beta, steps in zip(self.w_of(), self.beta, self._steps(kinds, max(codes) + 1)):
            for rows, goal, times in map(steps.__getitem__, codes):
                v = 0.0
                for r, _ in rows:
                    v += w[r]
                step = beta * (goal - v * times)
                for r, a in rows:
                    w[r] += a * step

    def w_of(self) -> list[list[float]]:
        if self.w is None:
            self.w = [[] for _ in self.beta]
        return self.w

    def traced(self, kinds: Sequence[tuple], codes: Sequence[int], marked: Sequence[bool], take: Sequence) -> list[list]:
        """run(), and what take[k] finds in the weights of the k-th outcome after each event that is marked."""
        found = []
        for w, beta, steps, get in zip(self.w_of(), self.beta, self._steps(kinds, len(kinds)), take):
            out = []
            for (rows, goal, times), mark in zip(map(steps.__getitem__, codes), marked):
                v = 0.0
                for r, _ in rows:
                    v += w[r]
                step = beta * (goal - v * times)
                for r, a in rows:
                    w[r] += a * step
                if mark:
                    out.append(get(w))
            found.append(out)
        return found

    def table(self, count: int, changed: bool = True) -> pa.RecordBatch:
        lists = self.w_of()
        self.w = np.array(lists).T.reshape(len(self.cues), len(self.beta))
        try:
            return super().table(count, changed)
        finally:
            self.w = lists

    def column(self, name: str) -> np.ndarray:
        return np.array(self.w_of()[self.names[name]])


def _packed(events: DataFrame) -> DataFrame:
    """(first, names, ids, codes) of each run of events: its kinds as JSON in the order in which they first come, event
    numbers (none if they follow each other), codes of kinds."""

    def pack(batches):
        now, kinds, ids, codes = None, {}, [], []

        def run():
            e, c = np.concatenate(ids), np.concatenate(codes)
            plain = e[-1] - e[0] == len(e) - 1 and (np.diff(e) == 1).all()
            kind = np.uint8 if len(kinds) <= 1 << 8 else np.uint16 if len(kinds) <= 1 << 16 else np.uint32
            return pa.RecordBatch.from_arrays([pa.array([int(e[0])]), pa.array([list(kinds)], pa.list_(pa.string())), pa.array([b"" if plain else e.tobytes()], pa.binary()), pa.array([c.astype(kind).tobytes()], pa.binary())], ["first", "names", "ids", "codes"])

        for b in batches:
            if not b.num_rows:
                continue
            if b.column(0).null_count:
                raise ValueError("iterative learning: events without a number")
            e, d = b.column(0).to_numpy(), b.column(1).dictionary_encode()
            names, at, part = d.dictionary.to_pylist(), d.indices.to_numpy(), e >> SHIFT
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(e)]
            for lo, hi in zip(cuts, cuts[1:]):
                if part[lo] != now:
                    if ids:
                        yield run()
                    now, kinds, ids, codes = part[lo], {}, [], []
                used, first, inverse = np.unique(at[lo:hi], return_index=True, return_inverse=True)
                code = np.empty(len(used), np.int64)
                for k in np.argsort(first):
                    code[k] = kinds.setdefault(names[used[k]], len(kinds))
                ids.append(e[lo:hi])
                codes.append(code[inverse])
        if ids:
            yield run()

    rows = events.select(F.col("event_id").cast("long").alias("event_id"), F.to_json(F.struct("cues", "outcomes")).alias("kind"))
    rows = rows.repartition(F.shiftright("event_id", SHIFT)).sortWithinPartitions("event_id")
    return rows.mapInArrow(pack, "first long, names array<string>, ids binary, codes binary")


def _inputs(events: DataFrame, rates: Rates, outcomes: DataFrame | None, initial: DataFrame | None, blocks: int | None, group: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """Headers (a block's outcomes, alphas, its initial weights) and runs of events for each block. group: (outcome, block)
    of the outcomes to learn."""
    spark = events.sparkSession
    none = lambda kind: F.lit(None).cast(kind)
    if group is None:
        names = (outcomes.select("outcome") if outcomes is not None else events.select(F.explode("outcomes").alias("outcome"))).distinct()
        if outcomes is None and initial is not None:
            names = names.union(initial.select("outcome")).distinct()
        names = written(names, "outcomes")
        n = names.count()
        if blocks is None and n <= SINGLE:
            group = [(r[0], i) for i, r in enumerate(names.collect())]
    if group is not None:
        names, k = spark.createDataFrame(group, "outcome string, block int"), max((b for _, b in group), default=0) + 1
    else:
        k = blocks or max(1, -(-n // BLOCK))
        names = names.withColumn("block", F.pmod(F.xxhash64("outcome"), F.lit(k)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("block")

    def head(df: DataFrame, block, kind: int, named, value) -> DataFrame:
        return df.select(block, F.lit(kind).alias("kind"), none("long").alias("first"), F.array(*named).alias("names"), value.alias("value"), none("binary").alias("ids"), none("binary").alias("codes"))

    beta = F.lit(float(rates.beta))
    if rates.betas is not None:
        given = rates.betas.where("value > 0 and value <= 1").select("outcome", "value")
        names, beta = names.join(given, "outcome", "left"), F.coalesce("value", beta)
    rows = head(names, F.col("block"), 0, ["outcome"], beta)
    if rates.alphas is not None:
        rows = rows.union(head(rates.alphas.where("value > 0 and value <= 1"), every, 1, ["cue"], F.col("value")))
    if initial is not None:
        rows = rows.union(head(initial.join(names.select("outcome", "block"), "outcome"), F.col("block"), 2, ["cue", "outcome"], F.col("weight")))
        if group is not None:  # blocks of single outcomes have the cues of all
            rows = rows.union(head(initial.select("cue").distinct(), every, 2, ["cue"], F.lit(0.0)))
    runs = _packed(events).select(every, F.lit(3), "first", "names", none("double"), "ids", "codes")
    return rows.union(runs).repartition(4 * k if k <= SINGLE else k, "block").sortWithinPartitions("block", "kind", "first")


def _blocks(batches, lam: float, unique: bool, alpha: float, few: int):
    """(block, its weights, ids, kinds, codes) of each run of events in turn; a block without events comes once, ids None."""

    def made(heads):
        now = (Few if sum(k == 0 for k, *_ in heads) <= few else Block)(lam, unique, alpha)
        for kind, names, value in heads:
            if kind == 0:
                now.outcome(names[0], value)
            elif kind == 1:
                now.alphas[names[0]] = value
            else:
                now.put(names[0], names[1] if len(names) > 1 else None, value)
        return now

    block, heads, now = None, [], None
    for batch in batches:
        columns = [batch.column(i) for i in range(7)]
        for row in range(batch.num_rows):
            b, kind, first, names, value, ids, codes = (c[row].as_py() for c in columns)
            if b != block:
                if block is not None and now is None and heads[0][0] == 0:
                    yield block, made(heads), None, None, None
                block, heads, now = b, [], None
            if kind < 3:
                heads.append((kind, names, value))
                continue
            if now is None:
                if not heads or heads[0][0] != 0:  # no outcomes
                    continue
                now = made(heads)
            n = len(names)
            codes = np.frombuffer(codes, np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32)
            e = np.frombuffer(ids, np.int64) if ids else np.arange(first, first + len(codes))
            kinds = [(x.get("cues") or [], x.get("outcomes") or []) for x in map(json.loads, names)]
            yield b, now, e, kinds, codes.tolist()
    if block is not None and now is None and heads and heads[0][0] == 0:
        yield block, made(heads), None, None, None


def _checked(events: DataFrame) -> DataFrame:
    one = F.when(F.col("freq") == 1, F.col("freq")).otherwise(F.raise_error(F.lit("iterative learning takes events of frequency 1: expand() them")).cast("long"))
    return events.select("event_id", "cues", "outcomes", one.alias("freq")).where("freq = 1")


def learned(events: DataFrame, rates: Rates = Rates(), unique: bool = True, snapshots: Sequence[int] = (), initial: DataFrame | None = None, outcomes: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(event_count, cue, outcome, weight) after the last event, and at the snapshots asked for.

    event_count is an event's number plus one; 0 is the state before any. Events: unique event_id, frequency 1.
    unique=False: an event's repeated cues and outcomes count each time. initial: weights (cue, outcome, weight) to go on
    from. outcomes: learn these only, the others are never computed.
    """
    rows = _inputs(_checked(events), rates, outcomes, initial, blocks)
    marks, lam, alpha = sorted(set(snapshots)), float(rates.lam), float(rates.alpha)

    def replay(batches):
        now, block, last, todo = None, None, 0, []

        def close():
            for s in todo:
                yield now.table(s)
            if last not in marks:
                yield now.table(last)

        for b, weights, ids, kinds, codes in _blocks(batches, lam, unique, alpha, FEW):
            if b != block:
                if now is not None:
                    yield from close()
                now, block, last, todo = weights, b, 0, list(marks)
            if ids is None:
                continue
            done = 0
            while todo and todo[0] <= ids[-1]:
                to = int(np.searchsorted(ids, todo[0]))
                now.run(kinds, codes[done:to])
                done = to
                yield now.table(todo.pop(0))
            now.run(kinds, codes[done:])
            last = int(ids[-1]) + 1
        if now is not None:
            yield from close()

    return rows.mapInArrow(replay, _OUT)


def learn_weights(events: DataFrame, rates: Rates = Rates(), unique: bool = True, runs: int = 1, shuffle: int | None = None, **more) -> DataFrame:
    """(cue, outcome, weight) after all events. runs: how often the events are replayed, each time in another order if
    shuffle is a seed."""
    from .events import shuffled

    if runs > 1 or shuffle is not None:
        size = (events.agg(F.max("event_id")).first()[0] or 0) + 1
        parts = []
        for r in range(runs):
            one = shuffled(events, shuffle + r) if shuffle is not None else events
            parts.append(one.withColumn("event_id", F.col("event_id") + F.lit(r * size)).select("event_id", "cues", "outcomes", "freq"))
        events = parts[0]
        for p in parts[1:]:
            events = events.unionByName(p)
    return learned(events, rates, unique, **more).drop("event_count")


# ---------------------------------------------------------------- traces
@dataclass(frozen=True)
class When:
    """Event counts of a trace: every n-th (0 too), the given ones, or the first n (0..n-1)."""

    every: int | None = None
    at: tuple[int, ...] = ()
    first: int | None = None

    def __contains__(self, count: int) -> bool:
        return bool(self.marks(np.array([count]))[0])

    def marks(self, counts: np.ndarray) -> np.ndarray:
        out = np.isin(counts, self.at) if self.at else np.zeros(len(counts), bool)
        if self.every:
            out |= counts % self.every == 0
        return out if self.first is None else out | (counts < self.first)


def traced(events: DataFrame, links: Sequence[tuple[str, str]] = (), cosine: Sequence[tuple[str, str]] = (), euclid: Sequence[tuple[str, str]] = (), when: When = When(every=1), rates: Rates = Rates(), unique: bool = True, initial: DataFrame | None = None) -> DataFrame:
    """(event_count, kind, a, b, value): weights of (cue, outcome) links, cosine and Euclidean distances of outcomes.

    Only the outcomes that are traced are learned, in one block those whose distances are traced. A cosine is NaN while a
    column is all 0. A run's values leave the block's task as arrays, to be unpacked elsewhere.
    """
    spark = events.sparkSession
    block = {o: i for i, o in enumerate(sorted({o for _, o in links} | {o for p in (*cosine, *euclid) for o in p}))}
    if not block:
        raise ValueError("nothing to trace")
    for a, b in (*cosine, *euclid):
        block = {o: block[a] if i == block[b] else i for o, i in block.items()}
    number = {i: k for k, i in enumerate(sorted(set(block.values())))}
    block = {o: number[i] for o, i in block.items()}
    rows = _inputs(_checked(events), rates, None, initial, None, list(block.items()))
    lam, alpha = float(rates.lam), float(rates.alpha)
    what = [("link", c, o) for c, o in links] + [("cosine", a, b) for a, b in cosine] + [("euclid", a, b) for a, b in euclid]

    def values(kind: str, a: str, b: str, column):
        if kind == "link":
            return column(b)[:, a]
        x, y = column(a), column(b)
        if kind == "euclid":
            return np.sqrt(((x - y) ** 2).sum(1))
        n = np.sqrt((x * x).sum(1) * (y * y).sum(1))
        with np.errstate(invalid="ignore"):
            return np.where(n > 0, (x * y).sum(1) / n, np.nan)

    def replay(batches):
        block, mine = None, []

        def made(now, counts, found, wide):
            for k, kind, a, b in mine:
                def column(o):
                    x = np.array(found[now.names[o]], float)
                    return x.reshape(len(counts), len(now.cues)) if wide else x.reshape(len(counts), -1)

                at = (now.cues[a] if wide else links_of[b].index(a)) if kind == "link" else a
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(counts[0])]), pa.array([counts]), pa.array([values(kind, at, b, column)])], ["what", "first", "event_count", "value"])

        for b, now, ids, kinds, codes in _blocks(batches, lam, unique, alpha, len(what) * 2):
            if ids is None:
                continue
            begun, block = b == block, b
            if not begun:
                mine = [(k, *x) for k, x in enumerate(what) if x[2] in now.names]
                links_of = {o: [a for _, kind, a, x in mine if kind == "link" and x == o] for o in now.names}
                for a in (a for x in links_of.values() for a in x):
                    now._row(a)
                wide = any(kind != "link" for _, kind, *_ in mine)
            mark = when.marks(ids + 1)
            size = len(codes)
            if wide:  # columns are copied at each mark: few of long ones at a time
                size = max(1, (1 << 22) // max(1, len(now.cues) + sum(len(c) for c, _ in kinds)))
            take = [list.copy if wide else _taker([now.cues[a] for a in links_of[o]]) for o in now.names]
            if not begun and int(ids[0]) in when:
                yield from made(now, ids[:1], [[get(w)] for get, w in zip(take, now.w_of())], wide)
            for lo in range(0, len(codes), size):
                m = mark[lo : lo + size]
                if wide:
                    now._steps(kinds, len(kinds))  # all cues have their rows before a column is copied
                found = now.traced(kinds, codes[lo : lo + size], m.tolist(), take)
                if m.any():
                    yield from made(now, ids[lo : lo + size][m] + 1, found, wide)

    out = rows.mapInArrow(replay, "what int, first long, event_count array<long>, value array<double>").repartition("what", "first")
    names = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in what))
    each = out.select(F.element_at(names, F.col("what") + 1).alias("n"), F.inline(F.arrays_zip("event_count", "value")))
    return each.select("event_count", "n.kind", "n.a", "n.b", "value")


def _taker(rows: Sequence[int]):
    """The function that takes these rows of a list; none gives (), one gives its number."""
    return itemgetter(*rows) if rows else lambda w: ()


def trace_link(events: DataFrame, cue: str, outcome: str, rates: Rates = Rates(), unique: bool = False, runs: int = 1, shuffle: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The weight of one link after each trial, (trial, weight), and its equilibrium weight, (weight)."""
    from .equilibrium import estimate_weights
    from .events import expand, shuffled

    trials = expand(events)
    if shuffle is not None:
        trials = shuffled(trials, shuffle)
    if runs > 1:
        size = (trials.agg(F.max("event_id")).first()[0] or 0) + 1
        whole = trials
        for r in range(1, runs):
            again = shuffled(trials, shuffle + r) if shuffle is not None else trials
            whole = whole.unionByName(again.withColumn("event_id", F.col("event_id") + r * size))
        trials = whole
    steps = traced(trials, [(cue, outcome)], rates=rates, unique=unique).where("event_count > 0").select(F.col("event_count").alias("trial"), F.col("value").alias("weight"))
    end = estimate_weights(events, unique=unique).where((F.col("cue") == cue) & (F.col("outcome") == outcome)).select("weight")
    return steps, end


# ---------------------------------------------------------------- a learner with a state
class Learner:
    """Weights and the number of the next event; each call of learn() goes on from there."""

    def __init__(self, events: DataFrame, rates: Rates = Rates(), unique: bool = True, weights: DataFrame | None = None, next_event: int = 0):
        self.events, self.rates, self.unique = events, rates, unique
        self.weights, self.next_event = weights, next_event

    @classmethod
    def from_weights(cls, events: DataFrame, weights: DataFrame, next_event: int, **more) -> Learner:
        """To resume learning."""
        return cls(events, weights=weights, next_event=next_event, **more)

    def learn(self, count: int | None = None) -> DataFrame:
        """(cue, outcome, weight) after `count` more events (all that are left); the table is in the shared folder."""
        from .events import span

        part = span(self.events, self.next_event, count)
        last = part.agg(F.max("event_id")).first()[0]
        if last is None:
            import warnings

            warnings.warn("no events are left to learn", stacklevel=2)
            return self.get_weights()
        outcomes = self.events.select(F.explode("outcomes").alias("outcome"))
        if self.weights is not None:
            outcomes = outcomes.union(self.weights.select("outcome"))
        self.weights = written(learned(part, self.rates, self.unique, initial=self.weights, outcomes=outcomes).drop("event_count"), "weights")
        self.next_event = last + 1
        return self.weights

    def get_weights(self, cues: Sequence[str] | None = None, outcomes: Sequence[str] | None = None) -> DataFrame:
        """The weights, or those of the names asked for; the selection reaches the scan."""
        w = self.weights if self.weights is not None else self.events.sparkSession.createDataFrame([], "cue string, outcome string, weight double")
        if cues is not None:
            w = w.where(F.col("cue").isin(list(cues)))
        return w.where(F.col("outcome").isin(list(outcomes))) if outcomes is not None else w

    def copy(self) -> Learner:
        return Learner(self.events, self.rates, self.unique, self.weights, self.next_event)

    def reset(self) -> None:
        self.weights, self.next_event = None, 0

    def relearn(self, rates: Rates | None = None) -> DataFrame:
        """The same events from the start, with other rates if given."""
        n, self.rates = self.next_event, rates or self.rates
        self.reset()
        return self.learn(n or None)

    def view(self, following: int = 1, before: int = 0) -> DataFrame:
        """Events about the next one to be learned."""
        from .events import view

        start = max(0, self.next_event - before)
        return view(self.events, start, self.next_event + following - start)

    def __eq__(self, other) -> bool:
        if not isinstance(other, Learner) or (self.next_event, self.unique) != (other.next_event, other.unique):
            return False
        a, b = self.get_weights(), other.get_weights()
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    __hash__ = None

    def __repr__(self) -> str:
        return f"Learner(next_event={self.next_event}, alpha={self.rates.alpha}, beta={self.rates.beta}, lam={self.rates.lam}, unique={self.unique})"


def cosine_similarity(weights: DataFrame) -> DataFrame:
    """(a, b, cosine) of the outcomes' columns of weights."""
    x = weights.select("cue", F.col("outcome").alias("a"), F.col("weight").alias("x"))
    y = weights.select("cue", F.col("outcome").alias("b"), F.col("weight").alias("y"))
    return x.join(y, "cue").where("a <= b").groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("cosine"))


def spark_fold(events: DataFrame, rates: Rates = Rates()) -> SparkSession:
    """The weights by a fold inside the JVM, for few events: (outcome, cue, weight) without Python."""
    e = _checked(events).agg(F.array_sort(F.collect_list(F.struct("event_id", F.array_distinct("cues").alias("cues"), "outcomes"))).alias("e"))
    names = events.select(F.explode("cues").alias("cue")).agg(F.array_sort(F.collect_set("cue")).alias("names"))
    outs = events.select(F.explode("outcomes").alias("outcome")).distinct()
    one = outs.crossJoin(e).crossJoin(names)
    ab, lam = float(rates.alpha * rates.beta), float(rates.lam)

    def step(w, x):
        v = F.aggregate(F.zip_with(w, F.col("names"), lambda a, n: F.when(F.array_contains(x["cues"], n), a).otherwise(0.0)), F.lit(0.0), lambda s, y: s + y)
        goal = F.when(F.array_contains(x["outcomes"], F.col("outcome")), F.lit(lam)).otherwise(0.0)
        return F.zip_with(w, F.col("names"), lambda a, n: F.when(F.array_contains(x["cues"], n), a + F.lit(ab) * (goal - v)).otherwise(a))

    w = F.aggregate("e", F.transform("names", lambda _: F.lit(0.0)), step)
    return one.select("outcome", F.explode(F.arrays_zip(F.col("names").alias("cue"), w.alias("weight"))).alias("z")).select(F.col("z.cue").alias("cue"), "outcome", F.col("z.weight").alias("weight"))
