"""The registered queries over the driver's tables, each with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coding, text
from ..operators import activate, counts, equilibrium, events, learn, model, stats
from ..operators.formula import events_from_formula, quantile_groups
from ..operators.learn import Rates, When
from ..operators.order import written
from ..streaming import learner as streams

QUERIES = {}
ORACLE: dict[str, str] = {}
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
RATES = Rates(alpha=0.1, beta=0.1, lam=1.0)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def R(c, digits: int = 6):
    return F.round(c, digits)


# ---------------------------------------------------------------- event streams of the tables
FORMULA = "o_orderpriority ~ o_orderstatus + c_mktsegment"


def order_table(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("event_id"), "o_orderstatus", "c_mktsegment", "o_orderpriority")


def order_events(spark, d, formula: str = FORMULA, **more) -> DataFrame:
    return events_from_formula(order_table(spark, d), formula, **more)


OC = """oc AS (SELECT o_orderkey AS event_id, 'o_orderstatus' || o_orderstatus AS c1, 'c_mktsegment' || c_mktsegment AS c2, o_orderpriority AS outcome
  FROM orders JOIN customer ON o_custkey = c_custkey),
cu AS (SELECT event_id, c1 AS cue, outcome FROM oc UNION ALL SELECT event_id, c2, outcome FROM oc)"""


def line_events(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.format_string("%.2f", "l_discount").alias("l_discount"), F.year("l_shipdate").alias("year"))
    return events_from_formula(t, "year ~ l_returnflag + l_linestatus + l_discount", discretise=None)


LI = """li AS (SELECT ['l_returnflag' || l_returnflag, 'l_linestatus' || l_linestatus, 'l_discount' || printf('%.2f', l_discount)] AS cues, CAST(year(l_shipdate) AS VARCHAR) AS outcome FROM lineitem)"""


def user_events(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", F.array(F.concat(F.lit("prev_"), F.coalesce(before, F.lit("none"))), F.lit("any")).alias("cues"), F.array("event_type").alias("outcomes"), F.lit(1).cast("long").alias("freq"))


def doc_words(spark, d) -> DataFrame:
    return events.words_of(table(spark, d, "documents").select("doc_id", "text"), breaks=False)


DW = r"""dw AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word
  FROM (SELECT doc_id, list_filter(string_split_regex(lower(trim(nfc_normalize(text))), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents)),
kw AS (SELECT word AS name FROM dw GROUP BY word HAVING count(*) >= 5)"""
KNOWN = DW + """,
kn AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, word FROM dw WHERE word IN (SELECT name FROM kw)),
kn2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM kn WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
win AS (SELECT * FROM kn2 WHERE n > 3 AND w3 IS NOT NULL)"""


def word_list(words: DataFrame) -> DataFrame:
    """The words that occur five times or more, a list of outcomes that grows with the corpus."""
    return words.groupBy(F.col("word").alias("name")).agg(F.count("*").alias("n")).where("n >= 5").select("name")


def known_windows(spark, d, radius: int, grams: tuple[int, ...] = ()) -> DataFrame:
    words = doc_words(spark, d)
    return events.word_windows(events.known_words(words, word_list(words), renumber=False), radius, grams=grams)


# ---------------------------------------------------------------- coding
_GRAMS = "list_transform(range(1, length({s}) - {n} + 2), lambda i: substr({s}, i, {n}))"


def _grams(n: int, s: str = "('#' || p_name || '#')") -> str:
    return _GRAMS.format(s=s, n=n)


@query(f"SELECT p_partkey, array_to_string({_grams(2)}, '_') AS cues FROM part")
def ortho_bigrams(spark, d):
    return table(spark, d, "part").select("p_partkey", coding.ortho(F.col("p_name")).alias("cues"))


@query(f"SELECT p_partkey, array_to_string(list_concat(list_concat({_grams(1, 'p_name')}, {_grams(2)}), {_grams(3)}), '_') AS cues FROM part")
def ortho_1_3grams(spark, d):
    return table(spark, d, "part").select("p_partkey", coding.ortho(F.col("p_name"), (1, 2, 3)).alias("cues"))


@query("""SELECT p_partkey, array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || t[i + 1]), '_') AS cues
FROM (SELECT p_partkey, list_concat(list_concat(['#'], string_split(p_name, ' ')), ['#']) AS t FROM part)""")
def ortho_tokenized(spark, d):
    return table(spark, d, "part").select("p_partkey", coding.ortho(F.translate("p_name", " ", "."), (2,), tokenized=True).alias("cues"))


_PARTS = "SELECT p_partkey, list_concat(string_split(p_name, ' '), [p_brand, p_type]) AS w FROM part"


@query(f"""SELECT p_partkey, array_to_string(list_concat(w, flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i + 1, len(w) + 1), lambda j: w[i] || w[j])))), '_') AS cues FROM ({_PARTS})""")
def cue_coding_pairs(spark, d):
    w = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(coding.combine(w, 2), "_").alias("cues"))


@query(f"SELECT p_partkey, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])), '_') AS cues FROM ({_PARTS})")
def cue_coding_adjacent(spark, d):
    w = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(coding.combine(w, adjacent=True), "_").alias("cues"))


@query(f"WITH {OC} SELECT event_id, c1 || '_' || c2 AS \"Cues\", outcome AS \"Outcomes\", CAST(1 AS BIGINT) AS \"Frequency\" FROM oc")
def events_by_formula(spark, d):
    return events.to_frame(order_events(spark, d))


@query(f"WITH {OC} SELECT event_id, c1 || '_' || c2 || '_' || c1 || ':' || c2 AS \"Cues\", outcome AS \"Outcomes\", CAST(1 AS BIGINT) AS \"Frequency\" FROM oc")
def events_interaction(spark, d):
    return events.to_frame(order_events(spark, d, "o_orderpriority ~ o_orderstatus * c_mktsegment"))


@query(f"WITH {OC} SELECT event_id, CASE WHEN c1 = 'o_orderstatusP' THEN c2 ELSE c1 || '_' || c2 || '_' || c1 || ':' || c2 END AS \"Cues\", outcome AS \"Outcomes\", CAST(1 AS BIGINT) AS \"Frequency\" FROM oc")
def events_ignore_absent(spark, d):
    return events.to_frame(order_events(spark, d, "o_orderpriority ~ o_orderstatus * c_mktsegment", ignore_absent="P"))


@query("""WITH q AS (SELECT list_transform(quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]), lambda x: round(x, 3)) AS c FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice < c[2] THEN printf('[%.3f,%.3f)', c[1], c[2]) WHEN o_totalprice < c[3] THEN printf('[%.3f,%.3f)', c[2], c[3])
 WHEN o_totalprice < c[4] THEN printf('[%.3f,%.3f)', c[3], c[4]) ELSE printf('[%.3f,%.3f]', c[4], c[5]) END AS label FROM orders, q""")
def discretise_quantiles(spark, d):
    t = table(spark, d, "orders")
    return t.select("o_orderkey", quantile_groups(t, "o_totalprice", 4).alias("label"))


# ---------------------------------------------------------------- text
@query("SELECT doc_id, lower(trim(nfc_normalize(text))) AS text FROM documents")
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\p{L}-]', ' ' || chr(1) || ' ', 'g') AS text FROM documents")
def punct_replace(spark, d):
    return table(spark, d, "documents").select("doc_id", text.punctuation_to_breaks(F.col("text")).alias("text"))


@query(f"WITH {DW} SELECT word, count(*) AS n FROM dw GROUP BY word")
def tokenise(spark, d):
    return doc_words(spark, d).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {DW} SELECT DISTINCT word, translate(word, '{ALPHABET}', '') = '' AS valid FROM dw")
def valid_letters(spark, d):
    return doc_words(spark, d).select("word").distinct().select("word", text.in_alphabet(F.col("word"), ALPHABET).alias("valid"))


@query(f"WITH {DW} SELECT DISTINCT word FROM dw WHERE NOT EXISTS (SELECT 1 FROM kw WHERE name = word)")
def unknown_words(spark, d):
    words = doc_words(spark, d)
    return events.unknown_words(words, word_list(words))


@query(f"WITH {KNOWN} SELECT doc_id, count(*) AS n FROM kn GROUP BY doc_id")
def known_word_filter(spark, d):
    words = doc_words(spark, d)
    return events.known_words(words, word_list(words)).groupBy("doc_id").agg(F.count("*").alias("n"))


def _coded(ev: DataFrame) -> DataFrame:
    return ev.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("cues", "_").alias("cues"), F.array_join("outcomes", "_").alias("outcomes"))


@query(f"""WITH {KNOWN}, s AS (SELECT doc_id, pos, '#' || word || '#' || w2 || '#' || w3 || '#' AS s, list_sort([word, w2, w3]) AS o FROM win)
SELECT doc_id, pos, array_to_string(list_sort({_grams(3, 's')}), '_') AS cues, array_to_string(o, '_') AS outcomes FROM s""")
def word_trigram_events(spark, d):
    return _coded(events.letter_events(known_windows(spark, d, 1, (3,)), 3))


@query(f"""WITH {KNOWN}, s AS (SELECT doc_id, pos, '#' || word || '#' AS s, word FROM kn)
SELECT doc_id, pos, array_to_string(list_sort({_grams(1, 's')}), '_') AS cues, word AS outcomes FROM s""")
def word_unigram_events(spark, d):
    return _coded(events.letter_events(known_windows(spark, d, 0, (1,)), 1))


@query(f"WITH {KNOWN} SELECT doc_id, pos, array_to_string(list_sort([word, w3]), '_') AS cues, w2 AS outcomes FROM win")
def whole_word_events(spark, d):
    return _coded(events.word_events(known_windows(spark, d, 1), 2))


@query(r"""WITH l AS (SELECT list_filter(string_split_regex(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)),
o AS (SELECT array_to_string(w[s : s + 1], '_') AS o FROM (SELECT w, unnest(range(1, len(w))) AS s FROM l)),
c AS (SELECT o AS "Outcomes", count(*) AS "Frequency", '#' || replace(o, '_', '#') || '#' AS s FROM o GROUP BY o)
SELECT array_to_string(""" + _grams(2, "s") + """, '_') AS "Cues", "Outcomes", "Frequency" FROM c""")
def context_window_counts(spark, d):
    return events.context_counts(table(spark, d, "documents"), 2, 2)


# ---------------------------------------------------------------- names and thresholds
@query(f"WITH {LI} SELECT cue AS name, count(*) AS n FROM (SELECT unnest(cues) AS cue FROM li) GROUP BY cue ORDER BY n DESC, name LIMIT 10")
def top_cues(spark, d):
    return events.top_names(line_events(spark, d), "cues", 10)


@query(f"WITH {LI} SELECT outcome AS name, count(*) AS n FROM li GROUP BY outcome ORDER BY n DESC, name LIMIT 5")
def top_outcomes(spark, d):
    return events.top_names(line_events(spark, d), "outcomes", 5)


@query(f"""WITH {OC}, kc AS (SELECT cue FROM cu GROUP BY cue ORDER BY count(*) DESC, cue LIMIT 6), ko AS (SELECT outcome FROM oc GROUP BY outcome ORDER BY count(*) DESC, outcome LIMIT 4)
SELECT event_id, c1 || '_' || c2 AS "Cues", outcome AS "Outcomes", CAST(1 AS BIGINT) AS "Frequency" FROM oc
WHERE c1 IN (SELECT cue FROM kc) AND c2 IN (SELECT cue FROM kc) AND outcome IN (SELECT outcome FROM ko)""")
def tabular_threshold_events(spark, d):
    return events.to_frame(events.threshold(order_events(spark, d), 6, 4))


@query(f"WITH {OC} SELECT row_number() OVER (ORDER BY cue) - 1 AS id, cue AS name FROM (SELECT DISTINCT cue FROM cu)")
def cue_dictionary(spark, d):
    return events.dictionary(order_events(spark, d), "cues")


@query(f"WITH {OC} SELECT row_number() OVER (ORDER BY outcome) - 1 AS id, outcome AS name FROM (SELECT DISTINCT outcome FROM oc)")
def outcome_dictionary(spark, d):
    return events.dictionary(order_events(spark, d), "outcomes")


# ---------------------------------------------------------------- counting
@query(f"WITH {LI}, e AS (SELECT row_number() OVER () AS i, cues FROM li), x AS (SELECT i, unnest(cues) AS cue FROM e) SELECT a.cue AS cue1, b.cue AS cue2, count(*) AS n FROM x a JOIN x b USING (i) GROUP BY ALL")
def cooc_cues(spark, d):
    return counts.cooccurrence(line_events(spark, d))


@query(f"""WITH {OC}, x AS (SELECT event_id, c1 AS cue, 1 AS k FROM oc UNION ALL SELECT event_id, c2, 2 FROM oc UNION ALL SELECT event_id, c2, 3 FROM oc)
SELECT a.cue AS cue1, b.cue AS cue2, count(*) AS n FROM x a JOIN x b USING (event_id) WHERE a.cue <> b.cue OR a.k = b.k GROUP BY ALL""")
def cooc_cues_duplicates(spark, d):
    e = order_events(spark, d)
    return counts.cooccurrence(e.withColumn("cues", F.concat("cues", F.slice("cues", 2, 1))), unique=False)


@query(f"WITH {LI} SELECT cue, outcome, count(*) AS n FROM (SELECT unnest(cues) AS cue, outcome FROM li) GROUP BY ALL")
def cooc_cue_outcome(spark, d):
    return counts.cue_outcome(line_events(spark, d))


@query(f"WITH {LI} SELECT 'Environ' AS cue, outcome, count(*) AS n FROM li GROUP BY outcome")
def background_counts(spark, d):
    return counts.background(line_events(spark, d))


PQ = OC + """, cc AS (SELECT a.cue AS cue1, b.cue AS cue2, count(*) AS n FROM cu a JOIN cu b USING (event_id) GROUP BY ALL),
co AS (SELECT cue, outcome, count(*) AS n FROM cu GROUP BY ALL), t AS (SELECT cue1 AS cue, n AS total FROM cc WHERE cue1 = cue2),
w AS (SELECT cue, outcome, n / total AS weight FROM co JOIN t USING (cue)),
acts AS (SELECT event_id, outcome, sum(coalesce(weight, 0)) AS activation FROM (SELECT event_id, cue, w.outcome, weight FROM (SELECT event_id, cue FROM cu) JOIN w USING (cue)) GROUP BY ALL),
sh AS (SELECT CASE WHEN abs(min(activation)) = 0 THEN 1e-10 ELSE abs(min(activation)) END AS s FROM acts),
probs AS (SELECT event_id, outcome, (activation + s) / sum(activation + s) OVER (PARTITION BY event_id) AS p FROM acts, sh),
pred AS (SELECT event_id, outcome AS predicted FROM (SELECT event_id, outcome, row_number() OVER (PARTITION BY event_id ORDER BY round(p, 9) DESC, outcome) AS k FROM probs) WHERE k = 1),
ct AS (SELECT outcome AS observed, predicted, count(*) AS n FROM oc JOIN pred USING (event_id) GROUP BY ALL)"""


def _pq(spark, d):
    """Each kind of event once, with frequencies, and its counts: the tables are read once."""
    e = written(counts.compact(order_events(spark, d)), "compact")
    cues, outs = counts.cooccurrence(e), counts.cue_outcome(e)
    return e, cues, outs


@query(f"WITH {PQ} SELECT cue1, cue2, round(n / total, 6) AS p FROM cc JOIN t ON cue = cue1")
def cond_prob_cues(spark, d):
    _, cues, _ = _pq(spark, d)
    return counts.cue_probabilities(cues).withColumn("p", R("p"))


@query(f"WITH {PQ} SELECT cue, outcome, round(weight, 6) AS p FROM w")
def cond_prob_outcomes(spark, d):
    _, cues, outs = _pq(spark, d)
    return counts.outcome_probabilities(outs, counts.diagonal(cues)).withColumn("p", R("p"))


@query(f"WITH {PQ}, r AS (SELECT cue, sum(n) AS total FROM co GROUP BY cue) SELECT cue1, cue2, round(n / total, 6) AS p FROM cc JOIN r ON cue = cue1")
def cond_prob_rowsum(spark, d):
    _, cues, outs = _pq(spark, d)
    return counts.cue_probabilities(cues, counts.row_sums(outs)).withColumn("p", R("p"))


# The weights of least norm in SQL: cues of each variable add up to 1 in every event, so that P is singular along the
# differences z of such sums, and nowhere else here. P + sum(z z') isn't, and solves for the weights that have no part
# along z; Gauss and Jordan's steps over a list of rows.
def _equilibrium(extra_cues: str = "", extra_outcomes: str = "", z: str = "CASE WHEN a.cue LIKE 'o_o%' THEN 1 ELSE -1 END * CASE WHEN b.cue LIKE 'o_o%' THEN 1 ELSE -1 END") -> str:
    return PQ + f""", ec AS (SELECT cue1, cue2, n FROM cc{extra_cues}), eo AS (SELECT cue, outcome, n FROM co{extra_outcomes}),
et AS (SELECT cue1 AS cue, n AS total, row_number() OVER (ORDER BY cue1) AS k FROM ec WHERE cue1 = cue2),
en AS (SELECT outcome, row_number() OVER (ORDER BY outcome) AS j FROM (SELECT DISTINCT outcome FROM oc)),
em AS (SELECT a.k, list(coalesce(n, 0) / a.total + {z} ORDER BY b.k) AS l FROM et a CROSS JOIN et b LEFT JOIN ec ON cue1 = a.cue AND cue2 = b.cue GROUP BY a.k),
eq AS (SELECT a.k, list(coalesce(n, 0) / a.total ORDER BY j) AS l FROM et a CROSS JOIN en LEFT JOIN eo ON eo.cue = a.cue AND eo.outcome = en.outcome GROUP BY a.k),
gj AS (SELECT 1 AS s, list(list_concat(em.l, eq.l) ORDER BY k) AS r FROM em JOIN eq USING (k)
  UNION ALL SELECT s + 1, list_transform(r, lambda x, i: CASE WHEN i = s THEN list_transform(x, lambda y: y / r[s][s]) ELSE list_transform(x, lambda y, j: y - x[s] * r[s][j] / r[s][s]) END) FROM gj WHERE s <= len(r)),
ew AS (SELECT cue, outcome, r[k][(SELECT count(*) FROM et) + j] AS weight FROM gj, et, en WHERE s = (SELECT max(s) FROM gj))"""


@query(f"WITH RECURSIVE {_equilibrium()} SELECT cue, outcome, round(weight, 6) AS weight FROM ew")
def equilibrium_weights(spark, d):
    return equilibrium.estimate_weights(order_events(spark, d)).withColumn("weight", R("weight"))


_ENVIRON = (
    " UNION ALL SELECT 'Environ', cue, total FROM t UNION ALL SELECT cue, 'Environ', total FROM t UNION ALL SELECT 'Environ', 'Environ', count(*) FROM oc",
    " UNION ALL SELECT 'Environ', outcome, count(*) FROM oc GROUP BY outcome",
    " + ".join(f"CASE WHEN a.cue LIKE '{v}' THEN 1 WHEN a.cue = 'Environ' THEN -1 ELSE 0 END * CASE WHEN b.cue LIKE '{v}' THEN 1 WHEN b.cue = 'Environ' THEN -1 ELSE 0 END" for v in ("o_o%", "c_m%")),
)


@query(f"WITH RECURSIVE {_equilibrium(*_ENVIRON)} SELECT cue, outcome, round(weight, 6) AS weight FROM ew")
def equilibrium_background(spark, d):
    return equilibrium.estimate_weights(order_events(spark, d), add_background=True).withColumn("weight", R("weight"))


@query(f"WITH {OC} SELECT DISTINCT outcome, CAST(0.0 AS DOUBLE) AS gap FROM oc")
def equilibrium_residual(spark, d):
    e, cues, outs = _pq(spark, d)
    return equilibrium.residual(equilibrium.estimate_weights(e), cues, outs).select("outcome", R("gap").alias("gap"))


# ---------------------------------------------------------------- scoring with a fixed weight table
def fixed_weights(spark, d) -> tuple[DataFrame, DataFrame]:
    """Kinds of events, and outcomes' conditional probabilities as weights."""
    e, cues, outs = _pq(spark, d)
    return activate.with_kinds(e), counts.outcome_probabilities(outs, counts.diagonal(cues)).withColumnRenamed("p", "weight")


KIND = activate.KIND


def _kinds(spark, d) -> tuple[DataFrame, DataFrame]:
    """What was observed of each kind of events, and the kind's probabilities."""
    e, w = fixed_weights(spark, d)
    seen = e.groupBy(KIND, F.element_at("outcomes", 1).alias("observed")).agg(F.sum("freq").alias("freq"))
    return seen, activate.probabilities(activate.kind_activations(e, w), KIND)


def _pred(p: DataFrame) -> DataFrame:
    return activate.predictions(p.withColumn("p", F.round("p", 9)), KIND)


def _each(spark, d, values: DataFrame) -> DataFrame:
    """What a table says of a kind, for each event."""
    return activate.spread(activate.with_kinds(order_events(spark, d)), values)


def _table(spark, d) -> DataFrame:
    seen, p = _kinds(spark, d)
    return stats.crosstable(seen.join(_pred(p), KIND))


@query(f"WITH {PQ} SELECT event_id, outcome, round(activation, 6) AS activation FROM acts")
def activations(spark, d):
    return activate.activations(order_events(spark, d), fixed_weights(spark, d)[1]).withColumn("activation", R("activation"))


@query(f"WITH {PQ}, k AS (SELECT min(event_id) AS event_id FROM oc GROUP BY c1, c2) SELECT event_id, outcome, round(activation, 6) AS activation FROM acts JOIN k USING (event_id)")
def activations_unique(spark, d):
    return activate.unique_activations(activate.activations(order_events(spark, d), fixed_weights(spark, d)[1]).withColumn("activation", R("activation")))


@query(f"WITH {PQ} SELECT event_id, outcome, round(p, 6) AS p FROM probs")
def acts_probs(spark, d):
    return _each(spark, d, _kinds(spark, d)[1].withColumn("p", R("p")))


@query(f"WITH {PQ} SELECT event_id, predicted FROM pred")
def predictions(spark, d):
    return _each(spark, d, _pred(_kinds(spark, d)[1]))


@query(f"WITH {PQ} SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY round(p, 9) DESC, outcome) AS INTEGER) AS rank, outcome, round(p, 6) AS p FROM probs")
def rank_probabilities(spark, d):
    return _each(spark, d, activate.ranked(_kinds(spark, d)[1].withColumn("p", F.round("p", 9)), KIND).withColumn("p", R("p")))


@query(f"""WITH {OC}, {LI} SELECT DISTINCT 'cue' AS kind, cue AS name FROM (SELECT unnest(cues) AS cue FROM li)
UNION ALL SELECT DISTINCT 'outcome', outcome FROM li""")
def unseen_cues(spark, d):
    return activate.unseen(line_events(spark, d), fixed_weights(spark, d)[1])


# ---------------------------------------------------------------- statistics
@query(f"WITH {PQ} SELECT observed, predicted, n FROM ct")
def crosstable(spark, d):
    return _table(spark, d)


@query(f"""WITH {PQ}, r AS (SELECT observed AS outcome, sum(n) AS seen, sum(CASE WHEN observed = predicted THEN n ELSE 0 END) AS hit FROM ct GROUP BY observed),
s AS (SELECT predicted AS outcome, sum(n) AS said FROM ct GROUP BY predicted)
SELECT outcome, round(hit / seen, 6) AS recall, round(coalesce(hit, 0) / said, 6) AS precision FROM r FULL JOIN s USING (outcome)""")
def recall_precision(spark, d):
    return stats.class_scores(_table(spark, d)).select("outcome", R("recall").alias("recall"), R("precision").alias("precision"))


@query(f"""WITH {PQ}, r AS (SELECT observed, sum(n) AS r FROM ct GROUP BY observed), n AS (SELECT sum(r) AS n, max(r) AS m FROM r),
e AS (SELECT n.n AS n, n - m AS el, (SELECT sum(r * (n.n - r) / n.n) FROM r) AS et, n - (SELECT coalesce(sum(n), 0) FROM ct WHERE observed = predicted) AS e FROM n)
SELECT round((n - e) / n, 6) AS accuracy, round(1 - e / el, 6) AS lambda, round(1 - e / et, 6) AS tau,
round((el - e) / n / sqrt(el / n * (1 - el / n) / n), 6) AS d_lambda, round((et - e) / n / sqrt(et / n * (1 - et / n) / n), 6) AS d_tau FROM e""")
def accuracy_lambda_tau(spark, d):
    s = stats.table_scores(_table(spark, d))
    return s.select(*(R(c).alias(c) for c in ("accuracy", "lambda", "tau", "d_lambda", "d_tau")))


@query(f"""WITH {PQ}, m AS (SELECT sum(ln(CASE WHEN p = 0 THEN 1e-10 ELSE p END)) AS m FROM oc JOIN probs USING (event_id, outcome)),
z AS (SELECT sum(n * ln(n / t)) AS z, max(t) AS n FROM (SELECT count(*) AS n, (SELECT count(*) FROM oc) AS t FROM oc GROUP BY outcome))
SELECT round(z, 4) AS ll_null, round(m, 4) AS ll_model, round(-2 * z, 4) AS deviance_null, round(-2 * m, 4) AS deviance_model, round(1 - m / z, 6) AS r2_likelihood,
round((1 - exp(-2 * (m - z) / n)) / (1 - exp(2 * z / n)), 6) AS r2_nagelkerke, round(2 * 40 - 2 * m, 4) AS aic, round(40 * ln(n) - 2 * m, 4) AS bic FROM m, z""")
def loglik_deviance_aic_bic(spark, d):
    seen, p = _kinds(spark, d)
    s = stats.likelihood(p, seen, parameters=40, key=KIND)
    four = ("ll_null", "ll_model", "deviance_null", "deviance_model", "aic", "bic")
    return s.select(*(R(c, 4 if c in four else 6).alias(c) for c in s.columns))


@query(f"""WITH {PQ}, x AS (SELECT round(p, 9) AS p, oc.outcome = '1-URGENT' AS y FROM oc JOIN probs USING (event_id) WHERE probs.outcome = '1-URGENT'),
g AS (SELECT p, sum(CASE WHEN y THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y THEN 0 ELSE 1 END) AS neg FROM x GROUP BY p),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS c FROM b""")
def concordance(spark, d):
    seen, p = _kinds(spark, d)
    one = p.where("outcome = '1-URGENT'").join(seen, KIND).select(F.round("p", 9).alias("score"), (F.col("observed") == "1-URGENT").alias("positive"), "freq")
    return stats.concordance(one).select(R("c").alias("c"))


# ---------------------------------------------------------------- folds, views, expansion
@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS t FROM orders), s AS (SELECT *, CAST(ceil(t / 7.0) AS BIGINT) AS size FROM n),
a AS (SELECT o_orderkey, r, size FROM s UNION ALL SELECT o_orderkey, r + t, size FROM s WHERE r < size * 7 - t) SELECT o_orderkey, CAST(r // size AS INTEGER) AS fold FROM a""")
def kfold_assignment(spark, d):
    return model.folds(table(spark, d, "orders").select("o_orderkey"), 7, ["o_orderkey"])


@query(f"WITH {OC} SELECT event_id AS \"Event\", c1 || '+' || c2 AS \"Cues\", outcome AS \"Outcomes\", CAST(1 AS BIGINT) AS \"Frequency\" FROM oc WHERE event_id BETWEEN 100 AND 149")
def event_view(spark, d):
    return events.view(order_events(spark, d), 100, 50, glue="+")


@query(f"WITH {OC} SELECT event_id, c1 || '_' || c2 AS \"Cues\", outcome AS \"Outcomes\", CAST(1 AS BIGINT) AS \"Frequency\" FROM oc WHERE event_id >= 500")
def event_slice(spark, d):
    return events.to_frame(events.span(order_events(spark, d), 500))


@query("""WITH e AS (SELECT o_orderkey, o_orderkey % 4 AS f, o_orderstatus AS c, o_orderpriority AS o FROM orders), x AS (SELECT o_orderkey, c, o, unnest(range(1, f + 1)) AS k FROM e)
SELECT row_number() OVER (ORDER BY o_orderkey, k) - 1 AS event_id, c AS "Cues", o AS "Outcomes", CAST(1 AS BIGINT) AS "Frequency" FROM x""")
def frequency_expand(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.array("o_orderstatus").alias("cues"), F.array("o_orderpriority").alias("outcomes"), (F.col("o_orderkey") % 4).alias("freq"))
    return events.to_frame(events.expand(t))


# ---------------------------------------------------------------- iterative learning
def _replay(alpha: str = "0.1", beta: str = "0.1", times: int = 1, until: str = "true") -> str:
    """st(outcome, w): each outcome's weights, a list by cu.k, after the events `until`; a fold over the list of events."""
    v = f"(x.m - ({times} * s.w[x.k] + s.w[ka]))"
    return f"""pv AS (SELECT event_id, 'prev_' || coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'none') AS cue, event_type AS outcome FROM events),
cu AS (SELECT cue, first, row_number() OVER (ORDER BY cue) AS k FROM (SELECT cue, min(event_id) AS first FROM pv GROUP BY cue UNION ALL SELECT 'any', min(event_id) FROM pv)),
al AS (SELECT list(CAST({alpha} AS DOUBLE) ORDER BY k) AS a, max(CASE WHEN cue = 'any' THEN k END) AS ka FROM cu),
seq AS (SELECT o.outcome, CAST({beta} AS DOUBLE) AS b, list({{'w': CAST(NULL AS DOUBLE[]), 'k': k, 'm': CASE WHEN pv.outcome = o.outcome THEN CAST(1 AS DOUBLE) ELSE 0 END}} ORDER BY event_id) AS e
  FROM pv JOIN cu USING (cue), (SELECT DISTINCT outcome FROM pv) o WHERE {until} GROUP BY o.outcome),
st AS (SELECT outcome, list_reduce(e, lambda s, x: {{'w': list_transform(s.w, lambda y, j: CASE WHEN j = x.k THEN y + {times} * a[j] * (b * {v}) WHEN j = ka THEN y + a[j] * (b * {v}) ELSE y END), 'k': x.k, 'm': x.m}},
  {{'w': list_transform(a, lambda y: CAST(0 AS DOUBLE)), 'k': CAST(0 AS BIGINT), 'm': CAST(0 AS DOUBLE)}}).w AS w FROM seq, al)"""


_WEIGHTS = "SELECT cue, outcome, round(w[k], 9) AS weight FROM st, cu"
#: sq(i, outcome, w): the same after every event; a recursion, as a fold keeps its end only.
_STEPS = _replay() + """,
ev AS (SELECT event_id + 1 AS i, k, outcome FROM pv JOIN cu USING (cue)),
sq AS (SELECT CAST(0 AS BIGINT) AS i, outcome, list_transform(a, lambda y: CAST(0 AS DOUBLE)) AS w FROM (SELECT DISTINCT outcome FROM pv), al
  UNION ALL SELECT ev.i, sq.outcome, list_transform(w, lambda y, j: CASE WHEN j = ev.k OR j = ka THEN y + 0.1::DOUBLE * (0.1::DOUBLE * ((CASE WHEN ev.outcome = sq.outcome THEN 1 ELSE 0 END) - (w[ev.k] + w[ka]))) ELSE y END) FROM sq JOIN ev ON ev.i = sq.i + 1, al)"""


@query(f"WITH {_replay()} {_WEIGHTS}")
def rw_weights(spark, d):
    return learn.learn_weights(user_events(spark, d), RATES).withColumn("weight", R("weight", 9))


@query(f"WITH {_replay(times=2)} {_WEIGHTS}")
def rw_weights_duplicates(spark, d):
    e = user_events(spark, d).withColumn("cues", F.concat("cues", F.slice("cues", 1, 1)))
    return learn.learn_weights(e, RATES, unique=False).withColumn("weight", R("weight", 9))


@query(f"WITH {_replay('CASE cue WHEN {0}any{0} THEN 0.05 WHEN {0}prev_click{0} THEN 0.3 ELSE 0.1 END'.format(chr(39)), 'CASE o.outcome WHEN {0}view{0} THEN 0.2 ELSE 0.1 END'.format(chr(39)))} {_WEIGHTS}")
def rw_alpha_beta(spark, d):
    a = spark.createDataFrame([("any", 0.05), ("prev_click", 0.3)], "cue string, value double")
    b = spark.createDataFrame([("view", 0.2)], "outcome string, value double")
    return learn.learn_weights(user_events(spark, d), Rates(alphas=a, betas=b)).withColumn("weight", R("weight", 9))


def _snapshot(count: str) -> str:
    return f"SELECT CAST({count} AS BIGINT) AS event_count, cue, outcome, round(w[k], 9) AS weight FROM (WITH {_replay(until=f'event_id < {count}')} SELECT * FROM st, cu WHERE first < {count})"


@query(" UNION ALL ".join(_snapshot(n) for n in ("100", "500", "(SELECT max(event_id) + 1 FROM events)")))
def rw_snapshot(spark, d):
    return learn.learned(user_events(spark, d), RATES, snapshots=(0, 100, 500)).withColumn("weight", R("weight", 9))


@query(f"WITH {_replay()} {_WEIGHTS}")
def rw_resume(spark, d):
    one = learn.Learner(user_events(spark, d), RATES)
    one.learn(400)
    again = learn.Learner.from_weights(one.events, one.weights, one.next_event, rates=RATES)
    return again.learn().withColumn("weight", R("weight", 9))


@query(f"WITH RECURSIVE {_STEPS} SELECT i AS event_count, 'link' AS kind, cue AS a, outcome AS b, round(w[k], 9) AS value FROM sq, cu WHERE (cue, outcome) IN (('any', 'view'), ('prev_click', 'purchase'))")
def rw_trace(spark, d):
    return learn.traced(user_events(spark, d), [("any", "view"), ("prev_click", "purchase")], when=When(every=1), rates=RATES).withColumn("value", R("value", 9))


@query(f"""WITH RECURSIVE {_STEPS} SELECT x.i AS event_count, 'cosine' AS kind, 'view' AS a, 'click' AS b,
CASE WHEN x.i = 0 THEN CAST('nan' AS DOUBLE) ELSE round(list_dot_product(x.w, y.w) / sqrt(list_dot_product(x.w, x.w) * list_dot_product(y.w, y.w)), 9) END AS value
FROM sq x JOIN sq y USING (i) WHERE x.outcome = 'view' AND y.outcome = 'click' AND x.i % 10 = 0""")
def rw_cosine_trace(spark, d):
    return learn.traced(user_events(spark, d), cosine=[("view", "click")], when=When(every=10), rates=RATES).withColumn("value", R("value", 9))


@query(" UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS event_count, 'euclid' AS kind, 'view' AS a, 'click' AS b, round(list_distance(x.w, y.w), 9) AS value FROM (WITH {_replay(until=f'event_id < {n}')} SELECT * FROM st) x, (WITH {_replay(until=f'event_id < {n}')} SELECT * FROM st) y WHERE x.outcome = 'view' AND y.outcome = 'click'" for n in (1, 10, 100, 1000)))
def rw_euclid_trace(spark, d):
    return learn.traced(user_events(spark, d), euclid=[("view", "click")], when=When(at=(1, 10, 100, 1000)), rates=RATES).withColumn("value", R("value", 9))


# ---------------------------------------------------------------- the classifier
def flagship(spark: SparkSession, d: str) -> DataFrame:
    return model.fit(FORMULA, order_table(spark, d)).predict("probs")


@query(f"""WITH RECURSIVE {_equilibrium()}, ea AS (SELECT event_id, ew.outcome, sum(weight) AS activation FROM cu JOIN ew USING (cue) GROUP BY ALL),
es AS (SELECT CASE WHEN abs(min(activation)) = 0 THEN 1e-10 ELSE abs(min(activation)) END AS s FROM ea)
SELECT event_id, outcome, round((activation + s) / sum(activation + s) OVER (PARTITION BY event_id), 6) AS p FROM ea, es""")
def classifier_probabilities(spark, d):
    return flagship(spark, d).withColumn("p", R("p"))


@query()
def classifier_statistics(spark, d):
    s = model.fit(FORMULA, order_table(spark, d)).statistics()
    return spark.createDataFrame(sorted((k, float(v)) for k, v in s.items() if isinstance(v, (int, float))), "statistic string, value double")


@query()
def classifier_anova(spark, d):
    rows = model.anova(model.fit(FORMULA, order_table(spark, d)))
    return spark.createDataFrame([(r["model"], float(r["df"]), r["deviance"], float(r["df_change"]), r["deviance_change"], r["p"]) for r in rows], "model string, df double, deviance double, df_change double, deviance_change double, p double")


@query()
def classifier_importance(spark, d):
    rows = model.variable_importance(FORMULA, order_table(spark, d))
    return spark.createDataFrame([(r["predictor"], r["accuracy"]) for r in rows], "predictor string, accuracy double")


# ---------------------------------------------------------------- streams
@query("SELECT 'cue' AS kind, event_type AS a, event_type AS b, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'outcome', event_type, CAST(user_id % 10 AS VARCHAR), count(*) FROM events GROUP BY ALL")
def stream_counts(spark, d):
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    e = s.select(F.array("event_type").alias("cues"), F.array((F.col("user_id") % 10).cast("string")).alias("outcomes"), F.lit(1).cast("long").alias("freq"))
    got: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        got.append(written(batch, "stream"))

    streams.stream_counts(e).writeStream.outputMode("complete").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return got[-1]
