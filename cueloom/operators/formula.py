"""Events from tables by a formula: response ~ predictors, with interactions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import numbered, written
from .stats import running

_TOKEN = re.compile(r"\s*(?:([A-Za-z_][\w.]*|`[^`]+`)|(\d+)|([-+*:^().]))")
Term = tuple[str, ...]


class _Parser:
    """Sums of products of interactions of powers, each expanded to a list of terms."""

    def __init__(self, text: str, dot: Sequence[str]):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"formula: {text[at:].strip()!r} isn't understood")
            self.tokens.append(m[1].strip("`") if m[1] else m[2] or m[3])
            at = m.end()
        self.names = {t for t in self.tokens if re.match(r"[^\W\d]", t)}
        self.dot, self.i = dot, 0

    def peek(self) -> str | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def take(self, *what: str) -> str | None:
        if (t := self.peek()) is not None and (not what or t in what):
            self.i += 1
            return t
        return None

    @staticmethod
    def cross(a: list[Term], b: list[Term]) -> list[Term]:
        return _unique([tuple(dict.fromkeys(x + y)) for x in a for y in b])

    def sum(self) -> list[Term]:
        out = self.product()
        while op := self.take("+", "-"):
            more = self.product()
            gone = {frozenset(t) for t in more}
            out = _unique(out + more) if op == "+" else [t for t in out if frozenset(t) not in gone]
        return out

    def product(self) -> list[Term]:
        out = self.interaction()
        while self.take("*"):
            more = self.interaction()
            out = _unique(out + more + self.cross(out, more))
        return out

    def interaction(self) -> list[Term]:
        out = self.power()
        while self.take(":"):
            out = self.cross(out, self.power())
        return out

    def power(self) -> list[Term]:
        base = out = self.atom()
        while self.take("^"):
            n = self.take()
            if not (n and n.isdigit() and int(n)):
                raise ValueError("formula: ^ needs a whole number")
            for _ in range(int(n) - 1):
                out = _unique(out + self.cross(out, base))
        return out

    def atom(self) -> list[Term]:
        t = self.take()
        if t == "(":
            out = self.sum()
            if not self.take(")"):
                raise ValueError("formula: ) is missing")
            return out
        if t == ".":
            return [(c,) for c in self.dot]
        if t in ("0", "1"):
            return []
        if t in self.names:
            return [(t,)]
        raise ValueError(f"formula: {t or 'its end'!r} isn't a predictor")


def _unique(terms: list[Term]) -> list[Term]:
    return list({frozenset(t): t for t in reversed(terms)}.values())[::-1]


def parse(formula: str, columns: Sequence[str] = (), frequency: str | None = None) -> tuple[str, list[Term]]:
    """The response, and the terms: main effects first, then interactions by order. "." means all other columns."""
    left, tilde, right = formula.partition("~")
    response = left.strip().strip("`")
    if not tilde or not response:
        raise ValueError("formula: response ~ predictors")
    p = _Parser(right, [c for c in columns if c not in (response, frequency, "event_id")])
    terms = p.sum()
    if p.peek() is not None or not terms:
        raise ValueError(f"formula: {p.peek() or 'no predictors'!r}")
    return response, sorted(terms, key=len)


def _rounded(x: float, digits: int = 3) -> float:
    """As SQL rounds: x times 1000, halves away from 0, over 1000. Python's round() goes by the number's exact value, which
    may be just below a half that is written as one."""
    y = x * 10**digits
    if not math.isfinite(y):
        return x
    whole = math.trunc(y)
    return (whole + math.copysign(1, y) if abs(y - whole) >= 0.5 else whole) / 10**digits


def _quantiles(df: DataFrame, c: Column, at: Sequence[float]) -> list[float] | None:
    """Exact quantiles: values are counted, and those of the ranks asked for found by running totals of the counts."""
    counted = written(df.select(c.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")), "values")
    n, largest = counted.agg(F.sum("n"), F.max(F.abs("v"))).first()
    if n is None:
        return None
    if not math.isfinite(largest):
        return df.agg(F.percentile(c, list(at))).first()[0]
    ranks = {q: (n - 1) * q for q in at}
    wanted = sorted({f(r) for r in ranks.values() for f in (math.floor, math.ceil)})
    end = F.col("before") + F.col("n")
    hit = F.lit(False)
    for r in wanted:
        hit = hit | ((F.col("before") <= r) & (end > r))
    rows = running(counted, "v", "n").where(hit).select("v", "before", end.alias("end")).collect()
    value = {r: x["v"] for r in wanted for x in rows if x["before"] <= r < x["end"]}
    low = {q: math.floor(r) for q, r in ranks.items()}
    return [value[low[q]] + (value[math.ceil(r)] - value[low[q]]) * (r - low[q]) for q, r in ranks.items()]


def quantile_groups(df: DataFrame, column: str, groups: int = 2, accuracy: int | None = None) -> Column:
    """The label of each value's quantile group, [low,high), the last one [low,high]; equal cuts are merged.

    Cuts are exact, those of SQL's quantile_cont; with `accuracy` they are approx_percentile's.
    """
    at = [i / groups for i in range(groups + 1)]
    c = F.col(column).cast("double")
    cuts = df.agg(F.percentile_approx(c, at, accuracy)).first()[0] if accuracy else _quantiles(df, c, at)
    if cuts is None:
        return F.lit(None).cast("string")
    cuts = sorted({_rounded(x) for x in cuts})
    cuts = cuts if len(cuts) > 1 else cuts * 2
    label = lambda i, end: f"[{cuts[i]:.3f},{cuts[i + 1]:.3f}{end}"
    out = None
    for i in range(len(cuts) - 2):
        hit = c < cuts[i + 1]
        out = out.when(hit, label(i, ")")) if out is not None else F.when(hit, label(i, ")"))
    last = F.lit(label(len(cuts) - 2, "]"))
    return F.when(c.isNotNull(), out.otherwise(last) if out is not None else last)


def _present(df: DataFrame, *names: str) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")


def events_from_formula(
    df: DataFrame,
    formula: str,
    frequency: str | None = None,
    discretise: Callable[[DataFrame, str], Column] | None = quantile_groups,
    check_values: bool = True,
    ignore_absent: str | Sequence[str] | None = None,
    separator: str = "",
    order: Sequence[str | Column] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """(event_id, cues, outcomes, freq, *keep): a cue for each term, the predictor's name before its value.

    A predictor's null, an underscore in a value (unless check_values replaces it) and a row whose values are all
    absent raise an error when the rows are read. event_id is the table's own, or the row's number in `order`, or null.
    """
    response, terms = parse(formula, df.columns, frequency)
    predictors = list(dict.fromkeys(p for t in terms for p in t))
    _present(df, response, *predictors)
    absent = [ignore_absent] if isinstance(ignore_absent, str) else list(ignore_absent or ())
    if "event_id" not in df.columns:
        df = numbered(df, order) if order else df.withColumn("event_id", F.lit(None).cast("long"))
    value = {}
    for p in predictors:
        x = F.col(p)
        if discretise and isinstance(df.schema[p].dataType, T.NumericType):
            x = discretise(df, p)
        x = x.cast("string")
        x = F.coalesce(x, F.raise_error(F.lit(f"predictor {p} has nulls")).cast("string"))
        x = F.translate(x, "_", ".") if check_values else F.when(x.contains("_"), F.raise_error(F.lit(f"underscore in a value of {p}")).cast("string")).otherwise(x)
        cue = F.concat(F.lit(f"{p}{separator}"), x)
        value[p] = F.when(~x.isin(absent), cue) if absent else cue
    made = [value[t[0]] if len(t) == 1 else F.nullif(F.concat_ws(":", *(value[p] for p in t)), F.lit("")) for t in terms]
    cues = F.array(*made)
    if absent:
        cues = F.array_distinct(F.filter(cues, lambda c: c.isNotNull()))
        cues = F.when(F.size(cues) > 0, cues).otherwise(F.raise_error(F.lit("all cues are absent")).cast("array<string>"))
    freq = F.col(frequency).cast("long") if frequency else F.lit(1).cast("long")
    return df.select(F.col("event_id").cast("long").alias("event_id"), cues.alias("cues"), F.array(F.col(response).cast("string")).alias("outcomes"), freq.alias("freq"), *keep)


def tabled(df: DataFrame, formula: str, frequency: str | None = None, discretise: Callable[[DataFrame, str], Column] | None = quantile_groups, **more) -> tuple[DataFrame, str]:
    """Each combination of the formula's columns once, and the name of the column that holds its frequency.

    Numeric predictors are discretised first, by all rows. `event_id` is null. The rows are written.
    """
    response, terms = parse(formula, df.columns, frequency)
    predictors = list(dict.fromkeys(p for t in terms for p in t))
    _present(df, response, *predictors)
    cut = {p: discretise(df, p) for p in predictors if discretise and isinstance(df.schema[p].dataType, T.NumericType)}
    taken = {c.lower() for c in [response, *predictors]}
    name = frequency or "freq"
    while name.lower() in taken:
        name = "_" + name
    freq = F.col(frequency).cast("long") if frequency else F.lit(1).cast("long")
    rows = df.select(response, *(cut[p].alias(p) if p in cut else F.col(p) for p in predictors), freq.alias(name))
    few = rows.groupBy(response, *predictors).agg(F.sum(name).alias(name))
    return written(few if "event_id" in taken else few.withColumn("event_id", F.lit(None).cast("long")), "tabled"), name
