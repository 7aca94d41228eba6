import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.functions import coding, text
from cueloom.operators import activate, counts, equilibrium, events, formula, learn, model, stats
from cueloom.operators.learn import Rates, When
from cueloom.sources import files

SCHEMA = events.SCHEMA
HAND = [(0, ["this", "is", "cue"], ["the", "test"], 1), (1, ["this", "cue"], ["the", "here"], 1)]


def brute(rows, alpha=0.1, beta=0.1, lam=1.0, unique=True):
    outs = {o for _, _, os, _ in rows for o in os}
    w = {}
    for _, cues, os, _ in sorted(rows):
        cs = list(dict.fromkeys(cues)) if unique else cues
        for o in outs:
            v = sum(w.get((c, o), 0.0) for c in cs)
            m = os.count(o) if not unique else int(o in os)
            step = alpha * beta * (lam * m - v * max(m, 1))
            for c in cs:
                w[c, o] = w.get((c, o), 0.0) + step
    return w


def as_dict(df):
    return {(r["cue"], r["outcome"]): r["weight"] for r in df.collect()}


def test_hand_made_events(spark):
    e = spark.createDataFrame(HAND, SCHEMA)
    a = spark.createDataFrame([("this", 0.5), ("is", 0.3), ("cue", 0.4)], "cue string, value double")
    b = spark.createDataFrame([("the", 1.0), ("test", 0.2), ("here", 0.0001), ("other", 7.0)], "outcome string, value double")
    got = as_dict(learn.learn_weights(e, Rates(lam=100.0, alphas=a, betas=b)))
    want = {("this", "the"): 55, ("this", "test"): 8.2, ("this", "here"): 0.005, ("is", "the"): 30, ("is", "test"): 6, ("is", "here"): 0, ("cue", "the"): 44, ("cue", "test"): 6.56, ("cue", "here"): 0.004}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("unique", [True, False])
def test_replay_against_brute_force(spark, unique):
    rng = np.random.default_rng(3)
    rows = [(i, [f"c{k}" for k in rng.integers(0, 6, 3)], [f"o{k}" for k in rng.integers(0, 4, 2)], 1) for i in range(60)]
    e = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, unique=unique)
    assert as_dict(learn.learn_weights(e, unique=unique, blocks=3)) == pytest.approx(want)
    if unique:
        assert as_dict(learn.spark_fold(e)) == pytest.approx(want)
        one = learn.Learner(e)
        one.learn(25)
        assert as_dict(one.learn()) == pytest.approx(want)
        snap = learn.learned(e, snapshots=[20]).where("event_count = 20").drop("event_count")
        part = brute(rows[:20])
        assert all(v == pytest.approx(part.get(k, 0.0)) for k, v in as_dict(snap).items())
        t = {r["event_count"]: r["value"] for r in learn.traced(e, [("c1", "o1")], when=When(at=(0, 60))).collect()}
        assert t == pytest.approx({0: 0.0, 60: want["c1", "o1"]})


def test_frequencies_above_one_are_refused(spark):
    e = spark.createDataFrame([(0, ["a"], ["b"], 2)], SCHEMA)
    with pytest.raises(Exception, match="frequency 1"):
        learn.learn_weights(e).collect()
    assert events.expand(e).count() == 2


def test_equilibrium_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, sorted({f"c{k}" for k in rng.integers(0, 5, 3)}), [f"o{rng.integers(0, 3)}"], int(rng.integers(1, 4))) for i in range(40)]
    cs, os = sorted({c for r in rows for c in r[1]}), sorted({o for r in rows for o in r[2]})
    cc, co = np.zeros((len(cs), len(cs))), np.zeros((len(cs), len(os)))
    for _, c, o, f in rows:
        for x in c:
            for y in c:
                cc[cs.index(x), cs.index(y)] += f
            co[cs.index(x), os.index(o[0])] += f
    w = np.linalg.pinv(cc / np.diag(cc)[:, None], np.sqrt(np.finfo(float).eps)) @ (co / np.diag(cc)[:, None])
    got = as_dict(equilibrium.estimate_weights(spark.createDataFrame(rows, SCHEMA)))
    assert got == pytest.approx({(c, o): w[i, j] for i, c in enumerate(cs) for j, o in enumerate(os)}, abs=1e-9)
    full = rng.normal(size=(12, 12))
    assert np.allclose(equilibrium.randomised_pinv(full, 12), np.linalg.inv(full))


def test_duplicate_counts(spark):
    e = spark.createDataFrame([(0, ["a", "a", "b"], ["o", "o"], 2)], SCHEMA)
    got = {(r[0], r[1]): r[2] for r in counts.cooccurrence(e, unique=False).collect()}
    assert got == {("a", "a"): 4, ("a", "b"): 4, ("b", "a"): 4, ("b", "b"): 2}
    assert {tuple(r) for r in counts.cue_outcome(e, unique=False).collect()} == {("a", "o", 4), ("b", "o", 2)}


def test_formula():
    assert formula.parse("y ~ a*b")[1] == [("a",), ("b",), ("a", "b")]
    assert formula.parse("y ~ (a + b + c)^2 - a:c")[1] == [("a",), ("b",), ("c",), ("a", "b"), ("b", "c")]
    assert formula.parse("y ~ .", ["y", "a", "f"], "f")[1] == [("a",)]
    for bad in ("y", "y ~", "y ~ a +", "y ~ (a", "y ~ a $ b"):
        with pytest.raises(ValueError):
            formula.parse(bad)


def test_events_from_formula_guards(spark):
    df = spark.createDataFrame([("x", "p_q", None)], "y string, a string, b string")
    assert formula.events_from_formula(df, "y ~ a").collect()[0]["cues"] == ["ap.q"]
    with pytest.raises(Exception, match="nulls"):
        formula.events_from_formula(df, "y ~ b").collect()
    with pytest.raises(Exception, match="absent"):
        formula.events_from_formula(df.fillna("z"), "y ~ b", ignore_absent="z").collect()


def test_coding(spark):
    df = spark.createDataFrame([("hello", "hel.lo", ["a", "b", "c"]), ("", "", [])], "s string, t string, c array<string>")
    r = df.select(coding.ortho(F.col("s")), coding.ortho(F.col("s"), (1,)), coding.ortho(F.col("t"), (2,), True), coding.combine(F.col("c"), 3), coding.combine(F.col("c"), adjacent=True)).collect()
    assert list(r[0]) == ["#h_he_el_ll_lo_o#", "h_e_l_l_o", "#hel_hello_lo#", ["a", "b", "c", "ab", "ac", "bc", "abc"], ["a", "b", "c", "ab", "bc"]]
    assert list(r[1]) == ["##", "", "##", [], []]
    u = spark.createDataFrame([("né",)], "s string").select(text.encode_unicode(F.col("s")).alias("e"))
    assert u.select("e", text.decode_unicode(F.col("e"))).collect()[0] == ("110*233*", "né")


def test_windows_need_more_words_than_they_hold(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, "a"), (4, "")], "doc_id int, text string")
    lists = events.word_lists(events.words_of(d, breaks=False))
    assert [tuple(r) for r in events.windows(lists, 1).orderBy("doc_id", "pos").collect()] == [(2, 0, ["a", "b", "c"]), (2, 1, ["b", "c", "d"])]
    assert events.windows(lists, 0).count() == 8
    one = events.letter_events(events.windows(lists, 0).where("doc_id = 3"), 3, smaller=True).collect()[0]
    assert one["cues"] == ["#", "#", "#a#", "a"]


def test_probabilities_predictions_and_ties(spark):
    acts = spark.createDataFrame([(0, "x", 0.0), (0, "y", 0.0), (1, "x", 1.0), (1, "y", 3.0)], "event_id int, outcome string, activation double")
    p = activate.probabilities(acts)
    assert {(r[0], r[1]): r[2] for r in p.collect()} == pytest.approx({(0, "x"): 0.5, (0, "y"): 0.5, (1, "x"): 0.25, (1, "y"): 0.75})
    assert dict(map(tuple, activate.predictions(p).collect())) == {0: "x", 1: "y"}


def test_concordance(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(0, 8)), bool(rng.integers(0, 2)), int(rng.integers(1, 3))) for _ in range(80)]
    won = sum(f * g * ((a > b) + (a == b) / 2) for a, y, f in rows if y for b, z, g in rows if not z)
    n = sum(f for _, y, f in rows if y) * sum(f for _, y, f in rows if not y)
    assert stats.concordance(spark.createDataFrame(rows, "score double, positive boolean, freq int")).first()["c"] == pytest.approx(won / n)


def test_classifier(spark):
    rows = [("u", "a", "p"), ("u", "a", "q"), ("v", "b", "p"), ("v", "b", "q"), ("v", "a", "p")] * 4
    df = spark.createDataFrame(rows, "y string, a string, b string")
    m = model.fit("y ~ a + b", df)
    s = m.statistics()
    assert s["accuracy"] == pytest.approx(0.8) and s["df_null"] == 40 and 0 <= s["c"] <= 1
    assert len(model.anova(m)) == 2
    assert m.predict("choice", spark.createDataFrame([("b", "p")], "a string, b string")).first()["predicted"] == "v"


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Cues\tOutcomes\tFrequency\na_b\tx\t3\nB_c\ty_x\t2\n")
    e = files.tabular(spark, str(tmp_path / "t.txt"))
    assert [tuple(r) for r in e.orderBy("event_id").collect()] == [(0, ["a", "b"], ["x"], 3), (1, ["b", "c"], ["x", "y"], 2)]
    made = files.EventDataset.write(e, str(tmp_path / "set"), kind="tabular")
    assert made.count() == 2 and files.EventDataset.open(spark, str(tmp_path / "set")).differences(made) == {}
    (tmp_path / "d").write_text("a\t0\na\t1\n")
    with pytest.raises(ValueError, match="more than once"):
        files.dictionary(spark, str(tmp_path / "d"))


def test_statistics_by_kinds_of_events(spark):
    rng = np.random.default_rng(11)
    rows = [(f"y{rng.integers(0, 3)}", f"a{rng.integers(0, 3)}", f"b{rng.integers(0, 2)}", float(rng.integers(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(rows, "y string, a string, b string, x double")
    m = model.fit("y ~ a + b", df)
    assert m.kinds.count() <= 18 and m.kinds.agg(F.sum("freq")).first()[0] == 300
    s, seen, p = m.statistics(), {r["event_id"]: r["observed"] for r in m.observed().collect()}, {}
    for r in m.predict("probs").collect():
        p.setdefault(r["event_id"], {})[r["outcome"]] = r["p"]
    assert len(p) == 300
    assert s["ll_model"] == pytest.approx(sum(np.log(p[i][o]) for i, o in seen.items()))
    chosen = {r["event_id"]: r["predicted"] for r in m.predict().collect()}
    assert s["accuracy"] == pytest.approx(sum(chosen[i] == o for i, o in seen.items()) / 300)
    assert {(r["observed"], r["predicted"]): r["n"] for r in s["crosstable"].collect()} == {k: n for k in {(o, chosen[i]) for i, o in seen.items()} if (n := sum((o, chosen[i]) == k for i, o in seen.items()))}
    few, freq = formula.tabled(df, "y ~ a + x", discretise=formula.quantile_groups)
    assert few.count() < 60 and few.agg(F.sum(freq)).first()[0] == 300
    whole, part = model.fit("y ~ a + x", df).statistics(), model.fit("y ~ a + x", few, freq).statistics()
    assert part["deviance_model"] == pytest.approx(whole["deviance_model"]) and part["df_model"] == whole["df_model"]
    rows = model.variable_importance("y ~ a + x", df)
    assert rows[0]["accuracy"] == pytest.approx(whole["accuracy"]) and [r["predictor"] for r in rows] == [None, "a", "x"]
    assert model.anova(model.fit("y ~ a + x", df))[1]["deviance"] == pytest.approx(whole["deviance_model"])


def test_activations_by_kinds_of_rows(spark):
    rows = spark.createDataFrame([(0, ["a", "b"], ["x"], 1), (1, ["b", "a", "a"], ["y"], 2), (2, ["n"], ["x"], 1), (3, [], ["y"], 1)], SCHEMA)
    w = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.25), ("b", "x", 2.0)], "cue string, outcome string, weight double")
    want = {(i, o): v for i, vs in enumerate([(3.0, 0.25)] * 2 + [(0.0, 0.0)] * 2) for o, v in zip("xy", vs)}
    assert {(r[0], r[1]): r[2] for r in activate.activations(rows, w).collect()} == want
    assert activate.kind_activations(activate.with_kinds(rows), w).count() == 6


def test_windows_of_rows(spark):
    d = spark.createDataFrame([(1, "a bé c"), (2, "a b c𝄞 dd e"), (3, "a"), (4, ""), (5, "ab cd ef gh"), (6, None)], "doc_id int, text string")
    words = events.words_of(d, breaks=False)
    plans = []
    for radius in (0, 1, 2):
        rows = events.word_windows(words, radius, grams=(1, 2, 3))
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        want = events.windows(events.word_lists(words), radius)
        assert sorted(map(tuple, rows.select("doc_id", "pos", "window").collect())) == sorted(map(tuple, want.collect()))
        for n, smaller in ((1, False), (2, True), (3, True)):
            assert sorted(map(tuple, events.letter_events(rows, n, smaller).collect())) == sorted(map(tuple, events.letter_events(want, n, smaller).collect()))
    assert not any("collect_list" in p or "Python" in p for p in plans)  # no text as an array, none in Python


def test_windows_of_known_words_sort_once(spark):
    words = events.words_of(spark.createDataFrame([(1, "a q b c q d"), (2, "q a b q c")], "doc_id int, text string"), breaks=False)
    names = spark.createDataFrame([(x,) for x in "abcd"], "name string")
    got = events.word_windows(events.known_words(words, names, renumber=False), 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.windows(events.word_lists(events.known_words(words, names)), 1).collect())) == [(1, 0, ["a", "b", "c"]), (1, 1, ["b", "c", "d"])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_letter_events_of_empty_words(spark):
    w = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (1, 3, "c")], "doc_id int, pos int, word string")
    got = events.letter_events(events.word_windows(w, 1, grams=(3,)), 3).where("pos = 0").collect()[0]
    assert got["cues"] == sorted(["#a#", "a##", "##b", "#b#"])


@pytest.mark.parametrize("form", ["NFC", "NFKC", "NFD", "NFKD"])
def test_normal_forms(spark, form):
    import unicodedata

    rows = ["été", "ﬁ Å", "plain", "", None, "한", "\U0001d15e"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(text.normal_form(F.col("t"), form))
    assert [r[0] for r in df.collect()] == [r if r is None else unicodedata.normalize(form, r) for r in rows]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_ngrams_of_any_length(spark):
    rows = ["", "a", "ab", "é" * 3, "abcdefghij", "x" * 18, "0123456789" * 4, "a𝄞b𝄞c"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select(coding.ngrams(F.col("s"), 3)).collect()
    assert [r[0] for r in got] == [[r[i : i + 3] for i in range(len(r) - 2)] for r in rows]


def test_context_counts_of_a_long_line(spark):
    line = " ".join(f"w{i % 7}" for i in range(50))
    got = {r["Outcomes"]: (r["Cues"], r["Frequency"]) for r in events.context_counts(spark.createDataFrame([(1, line + "\none\n\na b c")], "doc_id int, text string"), 3, 2).collect()}
    assert len(got) == 8 and sum(f for _, f in got.values()) == 49
    assert got["a_b_c"] == ("#a_a#_#b_b#_#c_c#", 1)


def test_runs_of_events(spark):
    rng = np.random.default_rng(8)
    many = [f"o{k}" for k in range(20)]
    rows = [(i * 1500, [f"c{k}" for k in rng.integers(0, 6, 3)], [many[k] for k in rng.integers(0, 3, 2)] + ([many[i % 20]] if i % 3 == 0 else []), 1) for i in range(80)]
    e = spark.createDataFrame(rows, SCHEMA)
    assert learn._packed(e.select("event_id", "cues", "outcomes")).count() == len({r[0] >> learn.SHIFT for r in rows})  # not a row for each event
    for unique in (True, False):
        want = brute(rows, unique=unique)
        assert as_dict(learn.learn_weights(e, unique=unique)) == pytest.approx(want)  # numpy rows: 20 outcomes
        few = e.withColumn("outcomes", F.filter("outcomes", lambda x: x.isin(many[:3])))
        short = [(i, c, [o for o in os if o in many[:3]], f) for i, c, os, f in rows]
        want = brute(short, unique=unique)
        assert as_dict(learn.learn_weights(few, unique=unique)) == pytest.approx(want)
        snap = {(r["event_count"], r["cue"], r["outcome"]): r["weight"] for r in learn.learned(few, unique=unique, snapshots=[31500, 31501]).collect()}
        assert {k[0] for k in snap} == {31500, 31501, 79 * 1500 + 1}
        for count, n in ((31500, 21), (31501, 22)):
            part = brute(short[:n], unique=unique)
            assert {k[1:]: v for k, v in snap.items() if k[0] == count} == pytest.approx({(c, o): part.get((c, o), 0.0) for c in {x for r in short[:n] for x in r[1]} for o in many[:3]})
        at = tuple(r[0] + 1 for r in rows[::7])
        got = {(r["event_count"], r["kind"], r["a"], r["b"]): r["value"] for r in learn.traced(few, [("c1", "o1"), ("c2", "o2"), ("none", "o2")], [("o0", "o1")], [("o0", "o1")], When(at=(0, *at)), unique=unique).collect()}
        assert len(got) == 5 * (len(at) + 1)
        for k, count in enumerate(at):
            w = brute(short[: 7 * k + 1], unique=unique)
            x, y = (np.array([w.get((f"c{c}", o), 0.0) for c in range(6)]) for o in ("o0", "o1"))
            assert got[count, "link", "c2", "o2"] == pytest.approx(w.get(("c2", "o2"), 0.0)) and got[count, "link", "none", "o2"] == 0
            assert got[count, "euclid", "o0", "o1"] == pytest.approx(np.linalg.norm(x - y))
            if x.any() and y.any():
                assert got[count, "cosine", "o0", "o1"] == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y))


def test_initial_weights_and_alphas_of_cues_without_events(spark):
    e = spark.createDataFrame([(0, ["a"], ["x"], 1), (1, ["a", "b"], ["y"], 1)], SCHEMA)
    first = spark.createDataFrame([("q", "x", 0.5)], "cue string, outcome string, weight double")
    a = spark.createDataFrame([("a", 0.5), ("b", 7.0), ("z", 0.2)], "cue string, value double")
    got = as_dict(learn.learn_weights(e, Rates(alphas=a), initial=first))
    assert got == pytest.approx({("q", "x"): 0.5, ("q", "y"): 0, ("a", "x"): 0.0475, ("b", "x"): -0.0005, ("a", "y"): 0.05, ("b", "y"): 0.01})


@pytest.mark.parametrize("values", [[0.0, 372195.1125, 400000.0, 500000.0, 600000.0], None])
def test_quantile_cuts_are_those_of_sql(spark, values):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(2)
    for size in (1,) if values else (1, 2, 7, 150, 400):
        x = values or [float(v) for v in np.round(rng.uniform(1000, 5e5, size), 2)] * 3
        df = spark.createDataFrame([(v,) for v in x], "x double")
        cuts = duckdb.connect().execute("SELECT list_transform(quantile_cont(v, [0.0, 0.25, 0.5, 0.75, 1.0]), lambda x: round(x, 3)) FROM (SELECT unnest(?) AS v)", [x]).fetchall()[0][0]
        assert formula._quantiles(df, F.col("x"), [0.0, 0.25, 0.5, 0.75, 1.0]) == duckdb.connect().execute("SELECT quantile_cont(v, [0.0, 0.25, 0.5, 0.75, 1.0]) FROM (SELECT unnest(?) AS v)", [x]).fetchall()[0][0]
        low = {r[0].strip("[)]").split(",")[0] for r in df.select(formula.quantile_groups(df, "x", 4)).collect()}
        assert low <= {f"{v:.3f}" for v in cuts}
    assert formula._rounded(372195.1125) == 372195.113 != round(372195.1125, 3)
    assert [formula._rounded(v) for v in (-372195.1125, 0.25, -0.0004, float("inf"))] == [-372195.113, 0.25, 0.0, float("inf")]
