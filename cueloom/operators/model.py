"""The formula-driven classifier: fit, predict, statistics, analysis of deviance, cross-validation, variable importance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import activate, stats
from .counts import compact
from .equilibrium import estimate_weights
from .events import expand
from .formula import events_from_formula, parse, tabled
from .learn import Rates, learn_weights
from .order import numbered, written


@dataclass(frozen=True)
class Model:
    formula: str
    frequency: str | None
    data: DataFrame
    events: DataFrame
    weights: DataFrame
    options: dict
    kinds: DataFrame | None = None  # each kind of event once, with its frequencies added up

    # ------------------------------------------------------------ prediction
    def coded(self, data: DataFrame | None = None) -> DataFrame:
        if data is None:
            return self.events
        if "event_id" not in data.columns:
            data = numbered(data, data.columns)
        response, _ = parse(self.formula, self.data.columns, self.frequency)
        if response not in data.columns:
            data = data.withColumn(response, F.lit(None).cast("string"))
        return events_from_formula(data, self.formula, self.frequency if self.frequency in data.columns else None, **self.options)

    def predict(self, kind: str = "choice", data: DataFrame | None = None) -> DataFrame:
        """kind: "choice" (event_id, predicted), "acts" (event_id, outcome, activation), "probs" (event_id, outcome, p)."""
        if kind not in ("choice", "acts", "probs"):
            raise ValueError("kind: choice, acts or probs")
        rows = activate.with_kinds(self.coded(data))
        values = activate.kind_activations(rows, self.weights)
        if kind != "acts":
            values = activate.probabilities(values, activate.KIND)
        return activate.spread(rows, activate.predictions(values, activate.KIND) if kind == "choice" else values)

    # ------------------------------------------------------------ statistics
    def observed(self) -> DataFrame:
        return self.events.select("event_id", F.element_at("outcomes", 1).alias("observed"), "freq")

    def parameters(self) -> int:
        return self.weights.count()

    def statistics(self) -> dict:
        """Likelihoods, degrees of freedom, crosstable scores; concordance where there are two outcomes.

        All is computed by kinds of events, weighted by their frequencies: the events are read once at most.
        """
        key = activate.KIND
        rows = activate.with_kinds(self.kinds if self.kinds is not None else written(compact(self.events), "compact"))
        p = written(activate.probabilities(activate.kind_activations(rows, self.weights), key), "probs")
        seen = written(rows.groupBy(key, F.element_at("outcomes", 1).alias("observed")).agg(F.sum("freq").alias("freq")), "seen")
        out = stats.likelihood(p, seen, parameters=self.parameters(), key=key).first().asDict()
        n_data = seen.agg(F.sum("freq")).first()[0]
        names = sorted(r[0] for r in self.weights.select("outcome").distinct().collect())
        out["df_null"], out["df_model"] = stats.degrees_of_freedom(n_data, len(names), self.parameters())
        chosen = activate.predictions(p, key)
        table = written(stats.crosstable(seen.join(chosen, key)), "crosstable")
        out |= stats.table_scores(table).first().asDict()
        out["crosstable"], out["by_outcome"] = table, stats.class_scores(table)
        if len(names) == 2:
            first = chosen.agg(F.min("predicted")).first()[0]
            scored = seen.join(p.where(F.col("outcome") == first), key).select(F.col("p").alias("score"), (F.col("observed") == first).alias("positive"), "freq")
            out["c"] = stats.concordance(scored).first()["c"]
        return out

    def summary(self, most: int = 10) -> str:
        s = self.statistics()
        rows = self.weights.orderBy("cue", "outcome").limit(most).collect()
        head = [f"{self.formula}", f"null deviance {s['deviance_null']:.2f} on {s['df_null']}, model {s['deviance_model']:.2f} on {s['df_model']}", f"AIC {s['aic']:.2f}, BIC {s['bic']:.2f}, accuracy {s['accuracy']:.4f}"]
        return "\n".join([*head, *(f"{r['cue']} -> {r['outcome']}: {r['weight']:.6g}" for r in rows)])

    def plot_data(self, what: str = "weights", bins: int = 20, predictors: str | None = None) -> DataFrame:
        """What a plot shows: "weights": histogram (bin, low, n) of those whose cue matches a pattern; "probs": ranked probabilities."""
        if what == "probs":
            return activate.ranked(self.predict("probs"))
        w = self.weights.where(F.col("cue").rlike(predictors)) if predictors else self.weights
        ends = w.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
        width = (F.col("hi") - F.col("lo")) / bins
        return w.crossJoin(F.broadcast(ends)).select(F.least(F.when(width > 0, F.floor((F.col("weight") - F.col("lo")) / width)).otherwise(0), F.lit(bins - 1)).alias("bin"), "lo", width.alias("width")).groupBy("bin").agg((F.first("lo") + F.col("bin") * F.first("width")).alias("low"), F.count("*").alias("n"))

    def __repr__(self) -> str:
        return f"Model({self.formula!r})"


def fit(formula: str, data: DataFrame, frequency: str | None = None, method: str = "danks", rates: Rates = Rates(), order: Sequence[str] = (), **options) -> Model:
    """A classifier of the response by the predictors. method: "danks" (equilibrium) or "irw" (iterative, in `order`)."""
    if "event_id" not in data.columns:
        data = numbered(data, list(order) or data.columns)
    events = events_from_formula(data, formula, frequency, **options)
    kinds = written(compact(events), "compact")
    if method == "danks":
        weights = estimate_weights(kinds)
    elif method == "irw":
        weights = learn_weights(expand(events), rates)
    else:
        raise ValueError("method: danks or irw")
    return Model(formula, frequency, data, events, written(weights, "weights"), options, kinds)


def _for_table(options: dict) -> dict:
    """Options of a fit of tabled() rows, which have the formula's columns only."""
    return {k: v for k, v in options.items() if k != "keep"}


def anova(*models: Model) -> list[dict]:
    """Rows (model, df, deviance, change of df, change of deviance, p). One model: its terms are added one after another;
    several: compared as they are given. They need the same response and the same data size."""
    if not models:
        raise ValueError("anova: a model or more")
    one = len(models) == 1
    if one:
        m = models[0]
        response, terms = parse(m.formula, m.data.columns, m.frequency)
        data, frequency = tabled(m.data, m.formula, m.frequency, **m.options)
        models = tuple(fit(f"{response} ~ {' + '.join(':'.join(t) for t in terms[: k + 1])}", data, frequency, **_for_table(m.options)) for k in range(len(terms)))
    responses = {parse(m.formula, m.data.columns, m.frequency)[0] for m in models}
    if len(responses) > 1:
        raise ValueError("anova: models of different responses")
    rows, sizes = [], set()
    for m in models:
        s = m.statistics()
        if not one:
            sizes.add(m.events.count())
        rows.append({"model": m.formula, "df": s["df_model"], "deviance": s["deviance_model"], "df_null": s["df_null"], "deviance_null": s["deviance_null"]})
    if len(sizes) > 1:
        raise ValueError("anova: models of data of different sizes")
    spark = models[0].data.sparkSession
    before = (rows[0]["df_null"], rows[0]["deviance_null"])
    for r in rows:
        d, x = before[0] - r["df"], before[1] - r["deviance"]
        r |= {"df_change": d, "deviance_change": x, "p": stats.chi_square_tail(spark, abs(x), abs(d))}
        before = (r["df"], r["deviance"])
    return rows


def folds(data: DataFrame, k: int, order: Sequence[str], seed: int | None = None) -> DataFrame:
    """The rows with fold 0..k-1: k equal runs of the order (or of a hash of it, if a seed is given). The first rows fill
    up the last run, so that they are in two folds."""
    keys = [F.xxhash64(*order, F.lit(seed)), *map(F.col, order)] if seed is not None else list(order)
    n = numbered(data.drop("_row"), keys, "_row")
    n = written(n, "folds")
    total = n.count()
    size = -(-total // k)
    pad = n.where(F.col("_row") < size * k - total).withColumn("_row", F.col("_row") + total)
    return n.unionByName(pad).withColumn("fold", F.floor(F.col("_row") / size).cast("int")).drop("_row")


def cross_validate(formula: str, data: DataFrame, k: int = 10, frequency: str | None = None, order: Sequence[str] = (), seed: int | None = None, fold_column: str | None = None, **options) -> tuple[list[dict], dict]:
    """Statistics of each fold, fitted on the others, and their mean, least and greatest."""
    data = data if fold_column else folds(data, k, list(order) or data.columns, seed)
    column = fold_column or "fold"
    data = written(data, "folded")
    names = sorted(r[0] for r in data.select(column).distinct().collect())
    rows = []
    for f in names:
        train, test = data.where(F.col(column) != f).drop(column), data.where(F.col(column) == f).drop(column, "event_id")
        m = fit(formula, train.drop("event_id"), frequency, **options)
        test = numbered(test, test.columns)
        held = Model(formula, frequency, test, m.coded(test), m.weights, options)
        s = held.statistics()
        rows.append({"fold": f} | {n: v for n, v in s.items() if isinstance(v, (int, float))})
    keys = [n for n in rows[0] if n != "fold"]
    mean = {n: sum(r[n] for r in rows) / len(rows) for n in keys if all(n in r for r in rows)}
    return rows, {"mean": mean, "min": {n: min(r[n] for r in rows) for n in mean}, "max": {n: max(r[n] for r in rows) for n in mean}}


def variable_importance(formula: str, data: DataFrame, frequency: str | None = None, seed: int = 1, **options) -> list[dict]:
    """For each predictor: accuracy (and concordance) of a fit in which that predictor's values change places."""
    response, terms = parse(formula, data.columns, frequency)
    base = written(numbered(data.drop("event_id"), [c for c in data.columns if c != "event_id"]), "base")

    def scores(rows: DataFrame) -> dict:
        few, f = tabled(rows, formula, frequency, **options)
        return fit(formula, few, f, **_for_table(options)).statistics()

    full = scores(base)
    rows = [{"predictor": None, "accuracy": full["accuracy"], "c": full.get("c")}]
    for p in dict.fromkeys(x for t in terms for x in t):
        other = numbered(base.select(F.col("event_id").alias("_old"), F.col(p).alias("_p")), [F.xxhash64("_old", F.lit(seed)), F.col("_old")]).select("event_id", "_p")
        mixed = base.join(other, "event_id").withColumn(p, F.col("_p")).drop("_p")
        s = scores(mixed)
        rows.append({"predictor": p, "accuracy": s["accuracy"], "c": s.get("c")})
    return rows
