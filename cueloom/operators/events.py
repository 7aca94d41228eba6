"""Learning events: (event_id, cues, outcomes, freq) from frames, tabular files, running text; views and slices of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.coding import ngrams
from .order import numbered

SCHEMA = "event_id long, cues array<string>, outcomes array<string>, freq long"


def from_frame(df: DataFrame, order: Sequence[str | Column] = (), lower: bool = False, sort: bool = False, separator: str = "_") -> DataFrame:
    """From columns Cues and Outcomes ("a_b") and perhaps Frequency (1 where there is none).

    event_id: the frame's own column, or the row's number in `order`, or null (order matters to iterative learning only).
    """
    for c in ("Cues", "Outcomes"):
        if c not in df.columns:
            raise ValueError(f"column {c} is missing")
    if "event_id" not in df.columns:
        df = numbered(df, order) if order else df.withColumn("event_id", F.lit(None).cast("long"))
    out = {}
    for c in ("Cues", "Outcomes"):
        x = F.coalesce(F.col(c).cast("string"), F.raise_error(F.lit(f"{c} has nulls")).cast("string"))
        names = X.split_names(F.lower(x) if lower else x, separator)
        out[c] = F.array_sort(names) if sort else names
    freq = F.col("Frequency").cast("long") if "Frequency" in df.columns else F.lit(1).cast("long")
    return df.select(F.col("event_id").cast("long").alias("event_id"), out["Cues"].alias("cues"), out["Outcomes"].alias("outcomes"), freq.alias("freq"))


def to_frame(events: DataFrame, glue: str = "_") -> DataFrame:
    """(event_id, Cues, Outcomes, Frequency), the inverse of from_frame()."""
    return events.select("event_id", F.array_join("cues", glue).alias("Cues"), F.array_join("outcomes", glue).alias("Outcomes"), F.col("freq").alias("Frequency"))


# ---------------------------------------------------------------- names and thresholds
def top_names(events: DataFrame, of: str, k: int) -> DataFrame:
    """(name, n) of the k most frequent cues or outcomes, by name among equals."""
    from .counts import name_counts

    return name_counts(events, of).orderBy(F.desc("n"), "name").limit(k)


def dictionary(events: DataFrame, of: str = "cues") -> DataFrame:
    """(id, name): distinct names, numbered by name from 0."""
    return numbered(events.select(F.explode(of).alias("name")).distinct(), ["name"], "id")


def keep_known(events: DataFrame, cues: DataFrame | None = None, outcomes: DataFrame | None = None, key: Sequence[str] = ("event_id",)) -> DataFrame:
    """Events all of whose cues are known, with their known outcomes, of which there must be one. cues, outcomes: (name).

    The names are joined to the exploded events, so that dictionaries may be of any size; event_id must be unique.
    """
    key = list(key)
    if cues is not None:
        known = cues.select(F.col("name").alias("_n"), F.lit(True).alias("_k"))
        one = events.select(*key, F.explode("cues").alias("_n")).join(known, "_n", "left")
        bad = one.where("_k is null").select(*key).distinct()
        events = events.join(bad, key, "left_anti")
    if outcomes is not None:
        known = outcomes.select(F.col("name").alias("_n"))
        one = events.select(*key, F.posexplode("outcomes").alias("_i", "_n")).join(known, "_n", "left_semi")
        kept = one.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_n"))), lambda x: x["_n"]).alias("outcomes"))
        events = events.drop("outcomes").join(kept, key).select(*events.columns)
    return events


def threshold(events: DataFrame, max_cues: int = 30_000, max_outcomes: int = 60_000) -> DataFrame:
    """The tabular rule: only the most frequent names count; an event with a cue that is cut goes, with no outcome left too."""
    return keep_known(events, top_names(events, "cues", max_cues), top_names(events, "outcomes", max_outcomes))


# ---------------------------------------------------------------- running text
def words_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", lower: bool = True, breaks: bool = True, form: str | None = "NFC") -> DataFrame:
    """(doc, pos, word) of all words; with breaks, signs of punctuation become break tokens."""
    t = X.clean(F.col(text), lower, form)
    t = X.tokens(X.punctuation_to_breaks(t) if breaks else t)
    return docs.select(F.col(doc), F.posexplode(t).alias("pos", "word"))


def known_words(words: DataFrame, outcomes: DataFrame, doc: str = "doc_id", renumber: bool = True) -> DataFrame:
    """Words in the list of outcomes (name), numbered anew in each document: windows span what was left out."""
    kept = words.join(outcomes.select(F.col("name").alias("word")).distinct(), "word", "left_semi")
    if not renumber:  # word_windows() does
        return kept.select(doc, "pos", "word")
    return kept.select(doc, (F.row_number().over(Window.partitionBy(doc).orderBy("pos")) - 1).alias("pos"), "word")


def unknown_words(words: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(word) that aren't in the list of outcomes, each once."""
    return words.select("word").distinct().join(outcomes.select(F.col("name").alias("word")), "word", "left_anti")


def word_lists(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, words array) in order."""
    return words.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))


def windows(lists: DataFrame, radius: int = 1, doc: str = "doc_id") -> DataFrame:
    """(doc, pos, window array) of 2 radius + 1 words; texts must have more words than that, and the last position that
    begins a window is the last but two (with radius 0 every word is one). Windows are cut inside each text's array."""
    n = F.size("words")
    last = n if radius == 0 else n - 2
    enough = n > 2 * radius + 1 if radius else n > 0
    fits = F.least(last, n - 2 * radius)
    starts = F.when(enough, F.sequence(F.lit(1), fits)).otherwise(F.array().cast("array<int>"))
    return lists.select(doc, "words", F.explode(starts).alias("_s")).select(doc, (F.col("_s") - 1).alias("pos"), F.slice("words", F.col("_s"), F.lit(2 * radius + 1)).alias("window"))


def word_windows(words: DataFrame, radius: int = 1, doc: str = "doc_id", grams: Sequence[int] = ()) -> DataFrame:
    """windows() of (doc, pos, word) rows in the order of pos: the words that follow are looked up in the rows, which are
    sorted once, so that no text is held as an array, nor copied for each of its words. The windows' pos counts from 0.

    grams: sizes, up to 3, of which the n-grams of "#w1#w2#" are made as `_grams1`..: those of each word once, instead of
    once in each of its windows, and those across words.
    """
    width = 2 * radius + 1
    w = Window.partitionBy(doc).orderBy("pos")
    after = lambda c, k: F.lead(c, k).over(w) if k else F.col(c)
    own = words.select(doc, "pos", "word", F.concat(F.lit("#"), "word", F.lit("#")).alias("_s"))
    own = own.select(doc, "pos", "word", *((F.split("word", "") if n == 1 else ngrams(F.col("_s"), n)).alias(f"_g{n}") for n in grams))
    out = own.select(doc, (F.row_number().over(w) - 1).alias("pos"), *(after("word", k).alias(f"_w{k}") for k in range(width + (radius > 0))), *(after(f"_g{n}", k).alias(f"_g{n}_{k}") for n in grams for k in range(width)))
    if radius:  # more words than a window: one before it or after it
        out = out.where(F.col(f"_w{width - 1}").isNotNull() & ((F.col("pos") > 0) | F.col(f"_w{width}").isNotNull()))
    across = {
        1: [F.array_repeat(F.lit("#"), width + 1)],
        2: [],
        3: [F.array(*(F.concat(F.substring(f"_w{k}", -1, 1), F.lit("#"), F.substring(f"_w{k + 1}", 1, 1)) for k in range(width - 1)))] if radius else [],
    }
    return out.select(doc, "pos", F.array(*(f"_w{k}" for k in range(width))).alias("window"), *(F.concat(*(f"_g{n}_{k}" for k in range(width)), *across[n]).alias(f"_grams{n}") for n in grams))


def _sizes(n: int, smaller: bool) -> list[int]:
    return {1: [1], 2: [1, 2], 3: [1, 3]}[n] if smaller else [n]


def letter_events(win: DataFrame, n: int = 3, smaller: bool = False, doc: str = "doc_id", alphabet: str | None = None) -> DataFrame:
    """(doc, pos, cues, outcomes, freq): n-grams of "#w1#w2#", outcomes are the window's words.

    smaller: single letters too, and below 3 pairs; n = 3 has no pairs then. Outcomes with letters outside the alphabet
    are left out of the outcomes, not of the cues' text.
    """
    s = F.concat(F.lit("#"), F.array_join("window", "#"), F.lit("#"))
    sizes = _sizes(n, smaller)
    win = win.select("*", s.alias("_s"))
    whole = ~F.array_contains("window", "")  # the n-grams that are there already are those of words of a letter or more
    cues = [F.when(whole, F.col(f"_grams{k}")).otherwise(ngrams(F.col("_s"), k)) if f"_grams{k}" in win.columns else ngrams(F.col("_s"), k) for k in sizes]
    outcomes = F.col("window")
    if alphabet is not None:
        outcomes = F.filter(outcomes, lambda w: X.in_alphabet(w, alphabet))
    both = F.concat(*cues) if len(cues) > 1 else cues[0]
    return win.select(doc, "pos", F.sort_array(both).alias("cues"), F.sort_array(outcomes).alias("outcomes"), F.lit(1).cast("long").alias("freq"))


def word_events(win: DataFrame, at: int = 2, cues: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, pos, cues, outcomes, freq): the word at place `at` (from 1) of the window is the outcome, the others are cues.
    With a list of cues (name) others are left out, and events without a cue go."""
    rest = F.concat(F.slice("window", 1, at - 1) if at > 1 else F.array().cast("array<string>"), F.slice("window", F.lit(at + 1), F.greatest(F.size("window") - at, F.lit(0))))
    out = win.select(doc, "pos", F.sort_array(rest).alias("cues"), F.array(F.element_at("window", at)).alias("outcomes"), F.lit(1).cast("long").alias("freq"))
    if cues is not None:
        one = out.select(doc, "pos", "outcomes", F.explode("cues").alias("name")).join(cues.select("name").distinct(), "name", "left_semi")
        out = one.groupBy(doc, "pos", "outcomes").agg(F.array_sort(F.collect_list("name")).alias("cues")).select(doc, "pos", "cues", "outcomes", F.lit(1).cast("long").alias("freq"))
    return out.where(F.size("cues") > 0)


def in_order(events: DataFrame, order: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """With event_id for iterative learning, instead of the document and position."""
    return numbered(events, list(order)).select("event_id", "cues", "outcomes", "freq")


def from_corpus(docs: DataFrame, outcomes: DataFrame | None = None, radius: int = 1, n: int = 3, smaller: bool = False, letters: bool = True, cues: DataFrame | None = None, at: int = 2, lower: bool = True, alphabet: str | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Events of running text, documents by id: unknown words are dropped, then windows are cut and coded."""
    words = words_of(docs, doc, text, lower)
    words = known_words(words, outcomes, doc, renumber=False) if outcomes is not None else words
    win = word_windows(words, radius, doc, _sizes(n, smaller) if letters and n <= 3 else ())
    found = letter_events(win, n, smaller, doc, alphabet) if letters else word_events(win, at, cues, doc)
    return in_order(found, (doc, "pos"))


def from_extended(lines: DataFrame, order: str = "line", n: int = 3, smaller: bool = False, radius: int = 0, doc: str | None = None) -> DataFrame:
    """Events of a corpus with one token a line: the first TAB field is the form that makes cues, the others are outcomes."""
    fields = F.split("value", "\t")
    one = lines.select(*([doc] if doc else [F.lit(0).alias("_doc")]), F.col(order).alias("pos"), F.element_at(fields, 1).alias("form"), F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0))).alias("tags")).where("form <> ''")
    key = doc or "_doc"
    w = Window.partitionBy(key).orderBy("pos")
    width = 2 * radius + 1
    span = w.rowsBetween(0, width - 1)
    win = one.select(key, "pos", F.collect_list("form").over(span).alias("window"), F.flatten(F.collect_list("tags").over(span)).alias("outcomes")).where(F.size("window") == width)
    coded = letter_events(win.select(key, "pos", "window"), n, smaller, key).drop("outcomes").join(win.select(key, "pos", F.array_sort("outcomes").alias("outcomes")), [key, "pos"])
    return in_order(coded, (key, "pos"))


def context_counts(docs: DataFrame, width: int = 3, n: int = 3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(Cues, Outcomes, Frequency): windows of `width` words of each line, counted; cues are n-grams of "#a#b#"."""
    lists = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).select(X.tokens(F.col("line")).alias("words"))
    at = F.when(F.size("words") >= width, F.sequence(F.lit(1), F.size("words") - width + 1)).otherwise(F.array().cast("array<int>"))
    each = F.transform(at, lambda i: F.array_join(F.slice("words", i, F.lit(width)), "_"))  # the words aren't copied for each
    win = lists.select(F.explode(each).alias("Outcomes"))
    counted = win.groupBy("Outcomes").agg(F.count("*").alias("Frequency"))
    coded = counted.select("Outcomes", "Frequency", F.concat(F.lit("#"), F.translate("Outcomes", "_", "#"), F.lit("#")).alias("_s"))
    return coded.select(F.array_join(ngrams(F.col("_s"), n), "_").alias("Cues"), "Outcomes", "Frequency")


# ---------------------------------------------------------------- views
def view(events: DataFrame, start: int = 0, count: int = 10, glue: str = "_", frequency: bool = True) -> DataFrame:
    """(Event, Cues, Outcomes, Frequency) of `count` events from event_id `start` on: a range that reaches the scan."""
    out = events.where(F.col("event_id").between(start, start + count - 1)).select(F.col("event_id").alias("Event"), F.array_join("cues", glue).alias("Cues"), F.array_join("outcomes", glue).alias("Outcomes"), F.col("freq").alias("Frequency"))
    return out if frequency else out.drop("Frequency")


def span(events: DataFrame, start: int = 0, count: int | None = None) -> DataFrame:
    """Events from `start` on, `count` of them."""
    out = events.where(F.col("event_id") >= start)
    return out if count is None else out.where(F.col("event_id") < start + count)


def expand(events: DataFrame, order: Sequence[str | Column] = ("event_id",)) -> DataFrame:
    """Each event as often as its frequency, with frequency 1 and numbered anew; none where the frequency isn't above 0."""
    many = events.where("freq > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("freq"))).alias("_copy"))
    return numbered(many.withColumn("freq", F.lit(1).cast("long")), [*order, "_copy"]).select("event_id", "cues", "outcomes", "freq")


def shuffled(events: DataFrame, seed: int = 1) -> DataFrame:
    """The same events in another order, decided by a hash of each one's number."""
    return numbered(events.withColumnRenamed("event_id", "_old"), [F.xxhash64("_old", F.lit(seed)), F.col("_old")]).select("event_id", "cues", "outcomes", "freq")
