"""Language identification by hyperdimensional profiles.

Every letter has a random vector of D entries +-1, derived from its code point. A run of three letters is bound by
multiplying the vectors, each permuted (rotated) by its place; a text is the bundle (sum) of its runs, and a language
the bundle of all its labelled documents. A text gets the language whose bundle is nearest by cosine.

Everything but letters counts as one space. A text is rejected if it has no letters, or if its best cosine is below the
least one for its length. These are measured on all labelled documents, by the binary logarithm of their number of
runs: the lesser of what all but a few own cosines exceed (their mean less OWN standard deviations) and what cosines to
other languages hardly reach (the mean of the next best one, and OTHER standard deviations). Lengths of which fewer than
ENOUGH documents are labelled reject nothing but texts without letters.

Cases: a null or empty text has no letters and is rejected (language "und", cosine null); null labels don't train;
with no labelled document everything is rejected; equal cosines go to the language first by name; repeated rows get
equal results, one each; very long texts are used whole; an empty table gives an empty result; other columns stay as
they are, and a column of the input that is named like one of the result only survives in the stage, which returns the
input's columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

D = 1024
ENOUGH, OWN, OTHER = 100, 4.0, 2.0
LENGTHS = 40
ROWS, RUNS = 512, 2048  # documents, and distinct runs, multiplied at once
SLICE = 1 << 18
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 0 for anything else."""
    if "letters" not in _tables:
        t = np.zeros(0x110000, np.uint32)
        for i in range(0x323B0):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _tables["letters"] = t
    return _tables["letters"]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """+-1 for each code point, one row each."""
    words = (D + 63) // 64
    bits = C.mix(C.mix(points.astype(C.U64) + C.U64(0x51ED27))[:, None] + C.seeded(words, 3)[None, :])
    return np.unpackbits(bits.view(np.uint8), axis=1)[:, :D].astype(np.int8) * np.int8(2) - np.int8(1)


def run_vectors(triples: np.ndarray) -> np.ndarray:
    """Bound vectors of (first, second, third) code points, float32."""
    points, at = np.unique(triples, return_inverse=True)
    at = at.reshape(triples.shape)
    v = letter_vectors(points)
    return (np.roll(v, 2, 1)[at[:, 0]] * np.roll(v, 1, 1)[at[:, 1]] * v[at[:, 2]]).astype(np.float32)


def runs(col: pa.Array):
    """(row, triple index, count) of every distinct run of each row, and the triples' code points."""
    buf, off = C.text_bytes(col)
    n = len(col)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(lead))
    if len(cp) != len(row):  # malformed bytes: row by row
        parts = [np.frombuffer((x or "").encode("utf-32-le", "replace"), np.uint32) for x in col.to_pylist()]
        cp, row = np.concatenate([*parts, np.empty(0, np.uint32)]), np.repeat(np.arange(n, dtype=np.int64), [len(p) for p in parts])
    low = _letters()[cp]
    # a space before and after each row's letters, and one for each gap
    keep = low > 0
    keep[:-1] |= low[1:] > 0
    low, row = low[keep], row[keep]
    if not len(low):
        return np.empty((3, 0), np.int64), np.empty((0, 3), np.uint32)
    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    ends = np.concatenate([cut[1:], [len(low)]])
    places = np.concatenate([ends, cut])  # where one row ends and the next begins, the end goes first
    low, row = np.insert(low, places, 0), np.insert(row, places, np.concatenate([row[cut], row[cut]]))
    used = np.zeros(0x110000, bool)
    used[low] = True
    points = np.flatnonzero(used)
    place = np.zeros(0x110000, np.int64)
    place[points] = np.arange(len(points))
    i, a = place[low], len(points)
    tri = (i[:-2] * a + i[1:-1]) * a + i[2:]
    ok = (row[:-2] == row[2:]) & (low[1:-1] > 0)
    key = row[:-2][ok] * a**3 + tri[ok]
    if n * a**3 < 2**32:
        key = key.astype(np.uint32)
    key, count = np.unique(key, return_counts=True)
    key = key.astype(np.int64)
    kinds, at = np.unique(key % a**3, return_inverse=True)
    triples = points[np.stack([kinds // a**2, kinds // a % a, kinds % a], 1)]
    return np.stack([key // a**3, at, count]), triples


def _bundles(batches):
    """(lang, place, value): what this partition adds to each language's bundle."""
    total: dict[str, np.ndarray] = {}
    for b in C.slices(batches, 1, SLICE):
        (row, at, count), triples = runs(b.column(1))
        if not len(triples):
            continue
        langs = b.column(0).to_pylist()
        names = sorted(set(langs))
        place = {x: k for k, x in enumerate(names)}
        of = np.array([place[x] for x in langs])
        m = np.bincount(of[row] * len(triples) + at, count, len(names) * len(triples)).reshape(len(names), -1)
        sums = sum(m[:, i : i + RUNS] @ run_vectors(triples[i : i + RUNS]).astype(np.float64) for i in range(0, len(triples), RUNS))
        for x, v in zip(names, np.rint(sums).astype(np.int64)):
            total[x] = total[x] + v if x in total else v
    for x, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([x] * D, pa.string()), pa.array(range(D), pa.int32()), pa.array(v)], ["lang", "place", "value"])


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """The bundle of each language over all documents with a label. D numbers a language come to the driver."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    found = rows.mapInArrow(_bundles, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value")).toArrow()
    out: dict[str, np.ndarray] = {}
    for lang, place, value in zip(*(found.column(i).to_pylist() for i in range(3))):
        out.setdefault(lang, np.zeros(D))[place] = value
    return {k: out[k] / np.linalg.norm(out[k]) for k in sorted(out) if np.any(out[k])}


def scored(col: pa.Array, prototypes: np.ndarray):
    """Of each row: the best prototype, its cosine, the next one's, and the number of runs."""
    n = len(col)
    best, cos, second, size = np.zeros(n, np.int64), np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int64)
    (row, at, count), triples = runs(col)
    if not len(row) or not len(prototypes):
        return best, cos, second, size
    edge = np.searchsorted(row, np.arange(0, n + ROWS, ROWS))
    for k in range(len(edge) - 1):
        lo, hi = edge[k], edge[k + 1]
        if lo == hi:
            continue
        r0, m = k * ROWS, min(ROWS, n - k * ROWS)
        used, place = np.unique(at[lo:hi], return_inverse=True)
        v = np.zeros((m, D), np.float32)
        for i in range(0, len(used), RUNS):
            own = (place >= i) & (place < i + RUNS) if len(used) > RUNS else slice(None)
            dense = np.zeros((m, min(RUNS, len(used) - i)), np.float32)
            dense[row[lo:hi][own] - r0, place[own] - i] = count[lo:hi][own]
            v += dense @ run_vectors(triples[used[i : i + RUNS]])
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        some = norm > 0
        c = np.where(some[:, None], (v @ prototypes.T) / np.where(some, norm, 1)[:, None], np.nan)
        got = np.flatnonzero(some)
        b = c[got].argmax(1)
        best[r0 + got], cos[r0 + got] = b, c[got, b]
        if c.shape[1] > 1:
            second[r0 + got] = np.partition(c[got], -2, 1)[:, -2]
        size[r0 : r0 + m] = np.bincount(row[lo:hi] - r0, count[lo:hi], m)
    return best, cos, second, size


def _length(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(size, 1).astype(float))[1] - 1, LENGTHS - 1)


def least_cosines(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> np.ndarray:
    """By length, the least cosine that is accepted. Six sums for each length come to the driver."""
    names = list(prototypes)
    if len(names) < 2:
        return np.full(LENGTHS, -1.0)
    p = np.array([prototypes[k] for k in names], np.float32)

    def sums(batches):
        total = np.zeros((LENGTHS, 5))
        for b in C.slices(batches, 1, SLICE):
            best, cos, second, size = scored(b.column(1), p)
            right = np.array(names, object)[best] == np.array(b.column(0).to_pylist(), object)
            own = np.flatnonzero(right & ~np.isnan(second))
            for k, x in enumerate((np.ones(len(own)), cos[own], cos[own] ** 2, second[own], second[own] ** 2)):
                total[:, k] += np.bincount(_length(size[own]), x, LENGTHS)
        yield pa.RecordBatch.from_arrays([pa.array(range(LENGTHS), pa.int32()), *(pa.array(total[:, k]) for k in range(5))], ["length", "n", "a", "aa", "b", "bb"])

    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    found = rows.mapInArrow(sums, "length int, n double, a double, aa double, b double, bb double").groupBy("length").agg(*(F.sum(c).alias(c) for c in ("n", "a", "aa", "b", "bb"))).collect()
    out = np.full(LENGTHS, -1.0)
    for r in found:
        if r["n"] >= ENOUGH:
            own, other = r["a"] / r["n"], r["b"] / r["n"]
            far = [np.sqrt(max(x / r["n"] - m * m, 0)) for x, m in ((r["aa"], own), (r["bb"], other))]
            out[r["length"]] = min(own - OWN * far[0], other + OTHER * far[1])
    return out


def _detector(prototypes: dict[str, np.ndarray], least: np.ndarray):
    names = list(prototypes)
    p = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), D)
    kind = "struct<language:string,cosine:double,margin:double,accepted:boolean>"

    @F.arrow_udf(kind)
    def detect(text: pa.Array) -> pa.Array:
        parts = []
        for piece in C.slices([pa.RecordBatch.from_arrays([text], ["t"])], 0, SLICE):
            best, cos, second, size = scored(piece.column(0), p)
            known = ~np.isnan(cos)
            accepted = known & (np.nan_to_num(cos, nan=-2.0) >= least[_length(size)])
            language = np.where(accepted, np.array([*names, "und"], object)[np.where(known, best, -1)], "und")
            parts.append(pa.StructArray.from_arrays([pa.array(language, pa.string()), pa.array(np.round(cos, 6), mask=~known), pa.array(np.round(cos - second, 6), mask=np.isnan(second)), pa.array(accepted)], ["language", "cosine", "margin", "accepted"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("language", pa.string()), ("cosine", pa.float64()), ("margin", pa.float64()), ("accepted", pa.bool_())]))

    return detect


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], least: np.ndarray) -> DataFrame:
    """(doc_id, language, cosine, margin, accepted) of every row."""
    found = docs.select("doc_id", _detector(prototypes, least)("text").alias("r"))
    return found.select("doc_id", "r.language", "r.cosine", "r.margin", "r.accepted")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows whose language is accepted; columns as they came."""
    prototypes = train(docs)
    return docs.where(_detector(prototypes, least_cosines(docs, prototypes))("text").getField("accepted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    prototypes = train(docs)
    return identify(docs, prototypes, least_cosines(docs, prototypes))
