"""Benchmark decontamination by latent semantic retrieval.

All documents are cut in passages of PASSAGE words; their TF-IDF matrix (words hashed to TERMS columns, passages of
length 1) is decomposed by a randomised SVD: every passage is added, with a random sign, to one of SKETCH rows, the
sums' columns are scaled to length 1, and their singular vectors are the latent space. Windows over the documents, as long as the benchmark's items
or up to half as long again, and the items themselves are folded into that space; those whose cosine reaches NEAR are
candidates. Of these a bound is tested first: a window of REACH item lengths must hold PARAPHRASE of the item's words.
Then the item leaks if in such a window the longest common subsequence of words covers VERBATIM of the item, or, as a
paraphrase, PARAPHRASE of it and ANSWER of its answer (the column `answer` of the benchmark if it has one, else the
item's last sentence). Items of fewer than LEAST_WORDS words, which chance would match, leak where they stand as they are.

Cases: null ids or texts on either side and texts without words give no rows; texts shorter than a window are one
window; very long texts are searched whole; repeated rows, and several texts of one doc_id, are found once, the largest
share counting and among equal shares the kind "verbatim"; no documents or no items give an empty result; other columns
are ignored (op) or returned as they are (stage, which drops the rows whose text leaks; rows without an id or a text
stay), whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PASSAGE = 48
TERM_BITS = 14
TERMS = 1 << TERM_BITS
RANK, SKETCH = 128, 144
#: Words of a block; windows begin and end between blocks.
STEP = 4
NEAR = 0.5
REACH = 1.5
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
LEAST_WORDS = 5
#: Items that are searched at once; more are searched in turns.
ITEMS = 20_000
SLICE = 1 << 17


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> C.U64(64 - TERM_BITS)).astype(np.int64)


def _passages(row: np.ndarray) -> np.ndarray:
    """The number of each word's passage within the slice."""
    first = np.concatenate([[True], row[1:] != row[:-1]])
    at = np.flatnonzero(first)
    place = np.arange(len(row)) - np.repeat(at, np.diff(np.concatenate([at, [len(row)]])))
    return np.cumsum(place % PASSAGE == 0) - 1


def _pairs(batch):
    """(passage, term, count) of every distinct pair of the slice, by passage, and a hash of each passage's words."""
    h, row, _, _ = C.words(*C.text_bytes(batch.column(0)))
    if not len(h):
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, C.U64)
    passage = _passages(row)
    key = np.sort((passage << TERM_BITS) | _terms(h))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at] >> TERM_BITS, key[at] & (TERMS - 1), np.diff(np.concatenate([at, [len(key)]])), C.mix(C.sums(h, passage, int(passage[-1]) + 1))


def _frequencies(batches):
    total = np.zeros(TERMS + 1, np.int64)  # the last is the number of passages
    for b in C.slices(batches, 0, SLICE):
        p, t, _, each = _pairs(b)
        total[:TERMS] += np.bincount(t, minlength=TERMS)
        total[TERMS] += len(each)
    yield C.blocks_of(total)


def _sketch_with(idf: np.ndarray):
    def sketch(batches):
        total = np.zeros(SKETCH * TERMS, np.float32)
        for b in C.slices(batches, 0, SLICE):
            p, t, n, each = _pairs(b)
            if not len(p):
                continue
            w = n * idf[t].astype(float)
            norm = np.sqrt(np.bincount(p, w * w))
            sign = np.where(each & C.U64(1), 1.0, -1.0) / np.maximum(norm, 1e-12)
            to = ((each >> C.U64(32)) % C.U64(SKETCH)).astype(np.int64)
            # float32 sums of what float64 adds up in a slice
            key, at = np.unique(to[p] * TERMS + t, return_inverse=True)
            total[key] += np.bincount(at, w * sign[p]).astype(np.float32)
        yield C.blocks_of(total)

    return sketch


class Space:
    """Weights of terms, and the map of weighted terms to latent coordinates (whitened, as folding in asks for)."""

    def __init__(self, docs: DataFrame):
        text = docs.where("text is not null").select(F.lower("text").alias("text"))
        f = C.summed(text.mapInArrow(_frequencies, C._BLOCKS), np.int64, (TERMS + 1,))
        self.idf = np.log((1 + f[TERMS]) / (1 + f[:TERMS])).astype(np.float32)
        rows = C.summed(text.mapInArrow(_sketch_with(self.idf), C._BLOCKS), np.float32, (SKETCH, TERMS)).astype(float)
        rows /= np.maximum(np.linalg.norm(rows, axis=0), 1e-12)  # else frequent terms alone would make up the space
        # the right singular vectors, by way of the small side
        lam, q = np.linalg.eigh(rows @ rows.T)
        lam, q = lam[::-1][:RANK], q[:, ::-1][:, :RANK]
        keep = lam > lam[0] * 1e-8 if len(lam) and lam[0] > 0 else np.zeros(len(lam), bool)
        s, q = np.sqrt(lam[keep]), q[:, keep]
        u = rows.T @ q / s
        u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1, 1)
        self.map = (u / s).astype(np.float32) * self.idf[:, None]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits (Hyyroe)."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = at.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Item:
    def __init__(self, item_id: int, text: str, answer: str | None):
        low = text.lower()
        self.id = item_id
        self.h = C.words(*C.text_bytes(pa.array([low])))[0]
        if not answer:
            parts = [x for x in re.split(r"[.!?\n]+", low) if re.search(r"\w", x)]
            answer = parts[-1] if parts else ""
        self.answer = C.words(*C.text_bytes(pa.array([answer.lower()])))[0]
        self.reach = math.ceil(REACH * len(self.h))
        self.fewest = math.ceil(PARAPHRASE * len(self.h) - 1e-9)

    def leaks(self, words: np.ndarray) -> tuple[float, str] | None:
        """Within these words."""
        share = lcs(self.h, words) / len(self.h)
        if share >= VERBATIM:
            return share, "verbatim"
        if share >= PARAPHRASE and len(self.answer) and lcs(self.answer, words) / len(self.answer) >= ANSWER:
            return share, "paraphrase"
        return None


def window_length(n: int) -> int:
    """The least of 8, 12, 16, 24, 32, 48 and so on that isn't less than n, in words."""
    k = 8
    while k < n:
        k = k * 3 // 2 if k & (k - 1) == 0 else k * 4 // 3
    return k


class Blocks:
    """Latent sums over the blocks of STEP words of a slice's rows; after each row, blocks of nothing."""

    def __init__(self, table: np.ndarray, t: np.ndarray, row: np.ndarray, longest: int):
        """table: of the terms, and a last row of zeros."""
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        self.words = np.diff(np.concatenate([first, [len(row)]]))
        self.size = -(-self.words // STEP)
        self.first, room = first, self.size + (longest // STEP - 1)
        self.start = np.cumsum(room) - room
        padded = np.full(int(room.sum()) * STEP, len(table) - 1)
        padded[np.arange(len(row)) - np.repeat(first, self.words) + np.repeat(self.start, self.words) * STEP] = t
        v = table[padded[0::STEP]]
        for k in range(1, STEP):
            v += table[padded[k::STEP]]
        self.sums = {1: v}

    def _sum(self, k: int) -> np.ndarray:
        """Of k blocks from each one on, k being a power of two or three times one."""
        if k not in self.sums:
            a, b = (k // 2, k // 2) if k & (k - 1) == 0 else (k * 2 // 3, k // 3)
            x, y = self._sum(a), self._sum(b)
            n = len(self.sums[1])
            out = x[: n - k + 1] + y[a : a + n - k + 1]
            self.sums[k] = out
        return self.sums[k]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the windows of `length` words, about a quarter of it apart, and the first word of each."""
        k, stride = length // STEP, max(1, length // (4 * STEP))
        many = np.maximum(1, -(-(self.size - k) // stride) + 1)
        which = np.repeat(np.arange(len(many)), many)
        block = (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)) * stride
        return self._sum(k)[self.start[which] + block], self.first[which] + block * STEP


class Search:
    """What a worker needs for some items."""

    def __init__(self, space_map: np.ndarray, items: list[Item], near: float):
        self.near, self.items = near, items
        self.table = np.concatenate([space_map, np.zeros((1, space_map.shape[1]), np.float32)])
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for i, x in enumerate(items):
            by.setdefault(window_length(len(x.h)), []).append(i)
        for n, who in by.items():
            f = np.array([space_map[_terms(items[i].h)].sum(0, dtype=np.float64) for i in who])
            f /= np.maximum(np.linalg.norm(f, axis=1), 1e-12)[:, None]
            self.groups[n] = np.array(who), f.astype(np.float32)
        self.longest = max(by, default=8)
        # the items' words as a hashed set; it may hold more, never less
        self.bits = max(10, (32 * sum(len(x.h) for x in items)).bit_length())
        self.salt = (C.seeded(max(len(items), 1), 61) >> C.U64(32)).astype(np.uint32)
        self.held = np.zeros(1 << self.bits, bool)
        for i, x in enumerate(items):
            self.held[self._place(x.h, self.salt[i])] = True
        self.reach = np.array([x.reach for x in items], np.int64)
        self.fewest = np.array([x.fewest for x in items], np.int64)

    def _place(self, h: np.ndarray, salt) -> np.ndarray:
        return (((h >> C.U64(20)).astype(np.uint32) ^ salt) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def _likely(self, h: np.ndarray, start: np.ndarray, item: np.ndarray, length: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of candidates: where, about the window, the words that hold most of the item begin; -1 if they can't hold enough."""
        out = np.full(len(start), -1)
        for k in range(0, len(start), 4096):
            s, i, a, b = (x[k : k + 4096] for x in (start, item, lo, hi))
            wide = int(self.reach[i].max(initial=1))
            at = (s - wide // 2)[:, None] + np.arange(length + wide)
            inside = (at >= a[:, None]) & (at < b[:, None])
            hit = self.held[self._place(h[np.clip(at, 0, len(h) - 1)], self.salt[i][:, None])] & inside
            total = np.zeros((len(s), hit.shape[1] + 1), np.int32)
            np.cumsum(hit, axis=1, out=total[:, 1:])
            for r in np.unique(self.reach[i]):
                own = np.flatnonzero(self.reach[i] == r)
                held = total[own, r:] - total[own, :-r]
                most = held.argmax(1)
                enough = held[np.arange(len(own)), most] >= self.fewest[i[own]]
                out[k + own[enough]] = np.maximum(at[own, most], a[own])[enough]
        return out

    def found(self, h: np.ndarray, row: np.ndarray):
        """(row, item, share, kind) of every leak in a slice; h, row: of its words."""
        blocks = Blocks(self.table, _terms(h), row, self.longest)
        of_first = np.repeat(np.arange(len(blocks.first)), blocks.words)
        todo: dict[tuple[int, int], set[int]] = {}
        for n, (who, folded) in self.groups.items():
            v, start = blocks.windows(n)
            least = self.near * np.sqrt(np.einsum("ij,ij->i", v, v))
            for k in range(0, len(who), 1024):
                w, i = np.nonzero(v @ folded[k : k + 1024].T >= np.maximum(least, 1e-12)[:, None])
                s, i = start[w], who[i + k]
                lo = blocks.first[of_first[s]]
                hi = lo + blocks.words[of_first[s]]
                best = self._likely(h, s, i, n, lo, hi)
                ok = best >= 0
                for a, j, x, y in zip(best[ok].tolist(), i[ok].tolist(), lo[ok].tolist(), hi[ok].tolist()):
                    step = max(1, len(self.items[j].h) // 8)
                    last = max(x, y - self.items[j].reach)
                    todo.setdefault((x, j), set()).update(max(x, min(b, last)) for b in (a - step, a, a + step))
        for (x, j), starts in todo.items():
            item, best = self.items[j], None
            end = x + int(blocks.words[of_first[x]])
            for b in sorted(starts):
                got = item.leaks(h[b : min(end, b + item.reach)])
                best = max(best, got) if best and got else best or got
            if best:
                yield int(row[x]), item, *best


def _phrases(items: list[Item]) -> dict[int, dict[int, list[Item]]]:
    """Of short items: by length, the hash of their words."""
    out: dict[int, dict[int, list[Item]]] = {}
    for x in items:
        key, _ = C.shingles(x.h, np.zeros(len(x.h), np.int64), len(x.h))
        out.setdefault(len(x.h), {}).setdefault(int(key[0]), []).append(x)
    return out


def _search_with(space_map: np.ndarray, items: list[Item], near: float):
    def search(batches):
        it = Search(space_map, [x for x in items if len(x.h) >= LEAST_WORDS], near)
        phrases = _phrases([x for x in items if 0 < len(x.h) < LEAST_WORDS])
        for b in C.slices(batches, 1, SLICE):
            ids = b.column(0).to_pylist()
            h, row, _, _ = C.words(*C.text_bytes(b.column(1)))
            if not len(h):
                continue
            out = [(ids[r], x.id, share, kind) for r, x, share, kind in it.found(h, row)] if it.items else []
            for n, short in phrases.items():
                key, at = C.shingles(h, row, n)
                for k in np.flatnonzero(np.isin(key, np.array(list(short), C.U64))):
                    # a text of fewer words has one shingle, which has another hash
                    out += [(ids[at[k]], x.id, 1.0, "verbatim") for x in short[int(key[k])]]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.string()))], ["doc_id", "item_id", "share", "kind"])

    return search


_FOUND = "doc_id long, item_id long, share double, kind string"


def _leaks(text: DataFrame, docs: DataFrame, benchmark: DataFrame, near: float, at_once: int) -> DataFrame:
    """Rows of _FOUND. text: (doc_id, text in lower case), the id being what names a row."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", (F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")).alias("answer"))
    turns = max(1, math.ceil(items.count() / at_once))
    space = Space(docs).map
    tables = C.Tables(docs.sparkSession, "leaks") if turns > 1 else None
    out = None
    for k in range(turns):
        mine = items if turns == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == k)
        some = [Item(*r) for r in sorted(mine.collect(), key=lambda r: (r["item_id"], r["text"], r["answer"] or ""))]
        found = text.mapInArrow(_search_with(space, some, near), _FOUND)
        found = tables.write(found) if tables else found
        out = found if out is None else out.union(found)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, near: float = NEAR, at_once: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, share, kind) of every item that a document leaks."""
    text = C.with_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    out = _leaks(text, docs, benchmark, near, at_once)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "kind")).alias("m")).select("doc_id", "item_id", F.round("m.share", 6).alias("share"), "m.kind")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text leaks no item; columns as they came."""
    (rid,) = C.free_name(docs, "_rid")
    named = docs.withColumn(rid, F.when(docs["doc_id"].isNotNull() & docs["text"].isNotNull(), F.xxhash64(docs["doc_id"].cast("long"), docs["text"])))
    text = named.where(F.col(rid).isNotNull()).select(F.col(rid).alias("doc_id"), F.lower(docs["text"]).alias("text"))
    gone = _leaks(text, docs, benchmark, NEAR, ITEMS).select(F.col("doc_id").alias(rid)).distinct()
    return named.join(gone, rid, "left_anti").select(*(C.col(c) for c in docs.columns))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
