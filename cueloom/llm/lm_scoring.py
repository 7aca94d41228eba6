"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Tokens are words, counted over all documents by a 64-bit hash. Every word that occurs OWN times or more has vectors of
its own, so that vocabulary and parameters grow with the corpus. Of rarer words, too few to learn vectors from, those
that occur equally often share one token and its vectors, and each has an equal share of the token's probability; a
word that the corpus doesn't hold counts like one that occurs once. The start of a text is a token of its own. The
model predicts a word from the CONTEXT words before it: their vectors, weighted entry by entry for each place, add up
to a prediction. Its product with a vector, plus a bias, is a score. Up to VOCABULARY tokens there is one softmax; with
more, the other ones are in classes (by frequency, of about the third root of their number) and the classes in groups:
the most frequent tokens and the groups share a softmax, each group has one over its classes and each class one over
its tokens.

It is trained in numpy by noise-contrastive estimation: against NOISE samples of the unigram distribution, shared by a
batch, without normalising; the tokens that are in classes, and their classes, once more against samples of such. Every partition
of the corpus trains on all its tokens, from the same start (the unigram model), and the parameters are averaged with
the partitions' tokens as weights, a token's own vectors with its occurrences. Scoring normalises the softmaxes by
batched matrix products.

Cases: a null or empty text has 0 tokens, log-probability 0 and no perplexity; every row gets a row, repeated ones
too, and ids may be null; words of equal count go by their hash where the order of tokens must be settled; very long
texts are scored whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

OWN = 10
VOCABULARY = 1024
D, CONTEXT = 24, 2
NOISE, BATCH, RATE = 64, 2048, 0.15
SEED = 4
#: Tokens whose parameters are averaged together, and numbers of the shared parameters.
BLOCK, SHARED = 256, 1 << 14
SLICE = 1 << 20


#: Words of a partition that are counted before their counts go on.
HELD = 1 << 20


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(h)
    h, n = h[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.add.reduceat(n, at)


def _count(batches):
    held, size = [], 0

    def out(parts):
        h, n = _added(parts)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    for b in C.slices(batches, 0, SLICE):
        h = np.sort(C.words(*C.text_bytes(b.column(0)))[0])
        if not len(h):
            continue
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        held.append((h[at], np.diff(np.concatenate([at, [len(h)]]))))
        size += len(at)
        if size >= HELD:
            held = [_added(held)]
            size = len(held[0][0])
            if size >= HELD // 2:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


class Vocabulary:
    """Hash of a word -> token, the tokens' shares (add one half), and the log share of a word in its token."""

    def __init__(self, h: np.ndarray, n: np.ndarray, once: int):
        """h, n: of the words that occur twice or more; once: the number of those that occur once."""
        order = np.argsort(h)
        self.h, n = h[order], n[order]
        words = np.bincount(n[n < OWN], minlength=OWN)
        words[1] = max(once, 1)
        counts = np.flatnonzero(words)  # 1 is the first
        own = np.flatnonzero(n >= OWN)
        mass = np.concatenate([words[counts] * counts, n[own]]) + 0.5
        by_mass = np.argsort(-mass, kind="stable")
        place = np.empty(len(mass), np.int32)
        place[by_mass] = np.arange(len(mass))
        self.share = mass[by_mass] / mass.sum()
        self.log_part = np.zeros(len(mass))
        self.log_part[place[: len(counts)]] = -np.log(words[counts])
        self.rare = int(place[0])
        self.token = np.empty(len(n), np.int32)
        self.token[own] = place[len(counts) :]
        few = n < OWN
        self.token[few] = place[np.searchsorted(counts, n[few])]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Where each word is in self.h, or would be: from the first of its bucket on, of which each holds about one."""
        if not hasattr(self, "start"):
            bits = max(1, len(self.h).bit_length())
            self.shift = C.U64(64 - bits)
            self.start = np.searchsorted(self.h >> self.shift, np.arange(1 << bits, dtype=C.U64)).astype(np.int32)
        at = self.start[(h >> self.shift).astype(np.int64)]
        last = len(self.h) - 1
        go = np.flatnonzero(self.h[np.minimum(at, last)] < h)
        while len(go):
            at[go] += 1
            go = go[at[go] <= last]
            go = go[self.h[at[go]] < h[go]]
        return np.minimum(at, last)

    def of(self, col: pa.Array):
        """(token, row) of each word."""
        h, row, _, _ = C.words(*C.text_bytes(col))
        if not len(self.h):
            return np.full(len(h), self.rare, np.int64), row
        at = self._find(h)
        return np.where(self.h[at] == h, self.token[at], self.rare).astype(np.int64), row


class Layout:
    """Units (single tokens, then groups of classes of tokens) for a number of tokens that go by falling frequency."""

    def __init__(self, n: int):
        self.n = n
        self.single = n if n <= VOCABULARY else VOCABULARY // 4
        self.size = max(1, round((n - self.single) ** (1 / 3)))
        self.classes = -(-(n - self.single) // self.size)
        self.per = max(1, math.isqrt(self.classes))
        self.units = self.single + -(-self.classes // self.per)

    def of_class(self, w: np.ndarray) -> np.ndarray:
        return (w - self.single) // self.size

    def unit(self, w: np.ndarray) -> np.ndarray:
        return np.where(w < self.single, w, self.single + self.of_class(w) // self.per)


class Parameters:
    """Units' vectors u and biases v, a weight vector c for each place before the word; and for each token, the start
    of a text being the last, a context vector r, a word vector q and a bias b (rows of own: r, q, b). After the tokens
    come the classes, which have no r."""

    def __init__(self, layout: Layout, shared: np.ndarray, own: np.ndarray):
        n = layout.units
        self.layout, self.shared, self.own = layout, shared, own
        self.u, self.v, self.c = shared[: n * D].reshape(n, D), shared[n * D : n * (D + 1)], shared[n * (D + 1) :].reshape(CONTEXT, D)
        self.r, self.q, self.b = own[:, :D], own[:, D : 2 * D], own[:, 2 * D]

    @classmethod
    def full(cls, layout: Layout, value: float) -> Parameters:
        return cls(layout, np.full(layout.units * (D + 1) + CONTEXT * D, value, np.float32), np.full((layout.n + 1 + layout.classes, 2 * D + 1), value, np.float32))

    @classmethod
    def start(cls, share: np.ndarray) -> Parameters:
        rng = np.random.default_rng(SEED)
        self = cls.full(Layout(len(share)), 0)
        self.own[:, : 2 * D] = rng.standard_normal((len(self.own), 2 * D), np.float32) * np.float32(0.1)
        self.u[:] = rng.normal(0, 0.1, self.u.shape)
        self.v[:] = np.log(unit_share(self.layout, share))
        self.b[: len(share)], self.c[:] = np.log(share), 1.0
        self.b[len(share) + 1 :] = np.log(class_share(self.layout, share))
        return self


def unit_share(layout: Layout, share: np.ndarray) -> np.ndarray:
    return np.bincount(layout.unit(np.arange(layout.n)), share, layout.units)


def class_share(layout: Layout, share: np.ndarray) -> np.ndarray:
    return np.bincount(layout.of_class(np.arange(layout.single, layout.n)), share[layout.single :], layout.classes)


def examples(token: np.ndarray, row: np.ndarray, start: int = 0) -> np.ndarray:
    """For each token the CONTEXT tokens before it in its row, nearest first; `start` before the start."""
    out = np.full((CONTEXT, len(token)), start, np.int64)
    for k in range(1, CONTEXT + 1):
        if len(token) > k:
            same = row[k:] == row[:-k]
            out[k - 1, k:] = np.where(same, token[:-k], start)
    return out


def _scatter(at: np.ndarray, g: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Adds the rows g to the rows `at`, which may repeat, of out (contiguous)."""
    k = g.shape[1]
    np.add.at(out.reshape(-1), (at[:, None] * k + np.arange(k)).reshape(-1), g.reshape(-1))
    return out


def _distinct(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token once, ascending, and where each of `at` is in that. A batch's tokens and their places fit in 64 bits."""
    bits = len(at).bit_length()
    s = np.sort((at << bits) | np.arange(len(at)))
    at, place = s >> bits, s & ((1 << bits) - 1)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    inverse = np.empty(len(at), np.int64)
    inverse[place] = np.cumsum(new) - 1
    return at[new], inverse


class Noise:
    """Samples of a distribution over the tokens from `first` on."""

    def __init__(self, share: np.ndarray, first: int = 0):
        share = share / share.sum()
        self.first, self.log, self.cumulative = first, np.log(NOISE * share).astype(np.float32), np.cumsum(share)

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        return self.first + np.minimum(np.searchsorted(self.cumulative, rng.random(NOISE)), len(self.log) - 1)

    def log_of(self, w: np.ndarray) -> np.ndarray:
        return self.log[w - self.first]


def _contrast(pred, target, log_target, noise, log_noise):
    """Of the targets' rows (vector, bias), one for each row of pred, against rows of noise; pred ends with a 1. Returns
    what goes to pred (without the 1), to the targets as factors of pred, and to the noise."""
    up = np.einsum("ij,ij->i", pred, target)
    up -= log_target
    less = -noise
    less[:, D] += log_noise
    down = pred @ less.T
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is the 0 that is meant
        for x in (up, down):
            np.exp(x, out=x)
            x += 1
            np.reciprocal(x, out=x)
    to_pred = target[:, :D] * up[:, None]
    to_pred -= down @ noise[:, :D]
    return to_pred, up[:, None], -(down.T @ pred)


def _ada(rows: np.ndarray, g: np.ndarray, n: int) -> None:
    """A step of AdaGrad for rows that hold values and then their sums of squares; its size doesn't depend on the batch's."""
    k = g.shape[1]
    g *= np.float32(32 / n)
    square = rows[:, k:]
    square += g * g
    g *= np.float32(RATE)
    g /= np.sqrt(square)
    rows[:, :k] += g


class Trainer:
    """Noise-contrastive estimation with AdaGrad. Rows of units (u, v), of tokens as context (r) and of tokens and
    classes as targets (q, b) each have their sums of squares beside them. A step touches only the rows of its batch."""

    def __init__(self, share: np.ndarray):
        p = Parameters.start(share)
        self.layout, units = p.layout, p.layout.units
        self.units, self.context, self.target = (np.ones((rows, 2 * k), np.float32) for rows, k in ((units, D + 1), (len(p.own), D), (len(p.own), D + 1)))
        self.units[:, :D], self.units[:, D], self.c = p.u, p.v, np.concatenate([p.c, np.ones_like(p.c)], 1)
        self.context[:, :D], self.target[:, : D + 1] = p.r, p.own[:, D:]
        self.noise = Noise(unit_share(self.layout, share))
        if self.layout.classes:
            self.inner = Noise(share[self.layout.single :], self.layout.single), Noise(class_share(self.layout, share), self.layout.n + 1)
        self.rng = np.random.default_rng(SEED + 1)
        self.n, self.seen = 0, np.zeros(len(p.own), np.int64)

    def step(self, w: np.ndarray, ctx: np.ndarray) -> None:
        n, layout = len(w), self.layout
        x = self.noise.draw(self.rng)
        which, at = _distinct(ctx.reshape(-1))
        context = self.context.take(which, 0)
        rows = np.ascontiguousarray(context[:, :D]).take(at, 0).reshape(CONTEXT, n, D)
        pred = np.ones((n, D + 1), np.float32)
        pred[:, :D] = sum(self.c[k, :D] * rows[k] for k in range(CONTEXT))
        unit = layout.unit(w)
        values = np.ascontiguousarray(self.units[:, : D + 1])
        dpred, up, to_noise = _contrast(pred, values.take(unit, 0), self.noise.log_of(unit), values.take(x, 0), self.noise.log_of(x))
        _ada(self.units, _scatter(x, to_noise, _scatter(unit, up * pred, np.zeros_like(values))), n)
        tail = np.flatnonzero(w >= layout.single)
        if len(tail):
            some, m, t = pred.take(tail, 0), len(tail), w[tail]
            parts = [p for targets, noise in zip((t, layout.n + 1 + layout.of_class(t)), self.inner) for p in (targets, noise.draw(self.rng))]
            of, place = _distinct(np.concatenate(parts))
            target = self.target.take(of, 0)
            values = np.ascontiguousarray(target[:, : D + 1])
            g, i = np.zeros_like(values), 0
            for targets, y, noise in zip(parts[::2], parts[1::2], self.inner):
                a, b = place[i : i + m], place[i + m : i + m + NOISE]
                d, up, to_noise = _contrast(some, values.take(a, 0), noise.log_of(targets), values.take(b, 0), noise.log_of(y))
                dpred[tail] += d
                _scatter(b, to_noise, _scatter(a, up * some, g))
                i += m + NOISE
            _ada(target, g, n)
            self.target[of] = target
            np.add.at(self.seen, parts[2], 1)
        gc = np.stack([np.einsum("ij,ij->j", dpred, rows[k]) for k in range(CONTEXT)])
        np.multiply(dpred, self.c[:, None, :D], out=rows)
        _ada(context, _scatter(at, rows.reshape(-1, D), np.zeros((len(which), D), np.float32)), n)
        self.context[which] = context
        _ada(self.c, gc, n)
        self.n += n
        np.add.at(self.seen, w, 1)
        self.seen[layout.n] += np.count_nonzero(ctx == layout.n)

    def blocks(self, start: Parameters):
        """(block, n, data): how far the parameters went from the start, and the weights. Shared ones have blocks under 0."""
        far = np.concatenate([self.units[:, :D].ravel(), self.units[:, D], self.c[:, :D].ravel()]) - start.shared
        for i in range(0, len(far), SHARED):
            yield -1 - i // SHARED, np.array([self.n]), far[i : i + SHARED].astype(np.float32)
        for i in range(0, len(self.seen), BLOCK):
            n = self.seen[i : i + BLOCK]
            if n.any():
                at = np.flatnonzero(n)
                own = np.concatenate([self.context[i + at, :D], self.target[i + at, : D + 1]], 1)
                yield i // BLOCK, np.stack([at, n[at]]), (own - start.own[i + at]).astype(np.float16)


_AVERAGED = "block int, n binary, data binary"


def _train_with(vocabulary: Vocabulary):
    def train(batches):
        t = Trainer(vocabulary.share)
        for b in C.slices(batches, 0, SLICE):
            w, row = vocabulary.of(b.column(0))
            ctx = examples(w, row, len(vocabulary.share))
            for i in range(0, len(w), BATCH):
                t.step(w[i : i + BATCH], ctx[:, i : i + BATCH])
        if t.n:
            rows = [(k, n.astype(np.int64).tobytes(), x.tobytes()) for k, n, x in t.blocks(Parameters.start(vocabulary.share))]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.binary(), pa.binary()))], ["block", "n", "data"])

    return train


def _average(table: pa.Table) -> pa.Table:
    block = table.column("block")[0].as_py()
    total, weight = None, None
    for n, data in zip(table.column("n").to_pylist(), table.column("data").to_pylist()):
        n = np.frombuffer(n, np.int64)
        if block < 0:
            x = np.frombuffer(data, np.float32).astype(float)
            total, weight = (0, 0) if total is None else (total, weight)
            total, weight = total + x * n[0], weight + n[0]
        else:
            at, n = n.reshape(2, -1)
            if total is None:
                total, weight = np.zeros((BLOCK, 2 * D + 1)), np.zeros((BLOCK, 1))
            total[at] += np.frombuffer(data, np.float16).reshape(len(at), -1).astype(float) * n[:, None]
            weight[at] += n[:, None]
    x = (total / np.maximum(weight, 1)).astype(np.float32)
    return pa.table({"block": pa.array([block], pa.int32()), "n": pa.array([b""], pa.binary()), "data": pa.array([x.tobytes()], pa.binary())})


def train(docs: DataFrame) -> tuple[Vocabulary, Parameters]:
    """The vocabulary and the averaged parameters. Words that occur twice or more and their parameters come to the driver."""
    text = docs.where("text is not null").select(F.lower("text").alias("text"))
    tables = C.Tables(docs.sparkSession, "words")
    counts = tables.write(text.mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    found = counts.where("n > 1").toArrow()
    h, n = (found.column(i).to_numpy() for i in range(2))
    vocabulary = Vocabulary(h.view(C.U64), n, counts.where("n = 1").count())
    tables.drop(counts)
    p = Parameters.start(vocabulary.share)
    rows = text.mapInArrow(_train_with(vocabulary), _AVERAGED).groupBy("block").applyInArrow(_average, _AVERAGED).select("block", "data").toArrow()
    for block, data in zip(rows.column("block").to_pylist(), rows.column("data")):
        x = np.frombuffer(data.as_buffer(), np.float32)
        if block < 0:
            p.shared[(-1 - block) * SHARED :][: len(x)] += x
        else:
            own = p.own[block * BLOCK : (block + 1) * BLOCK]
            own += x.reshape(BLOCK, -1)[: len(own)]
    return vocabulary, p


def _log_sum(x: np.ndarray, y: np.ndarray, none: np.ndarray | None = None) -> np.ndarray:
    """log(sum(exp(x y))) over the last axis, scores named by none left out. Most scores can be used by exp() as they are;
    where their sum shows that some left float32, or that all nearly did, it is made anew less the largest one."""
    s = x @ y
    if none is not None:
        s += none
    with np.errstate(over="ignore"):
        np.exp(s, out=s)
        total = s @ np.ones(s.shape[-1], np.float32)
    if total.min() > 1e-20 and total.max() < 1e30:
        return np.log(total)
    s = (x @ y).astype(float)
    if none is not None:
        s += none
    m = s.max(-1)
    return m + np.log(np.exp(s - m[..., None]).sum(-1))


def _log_sums(pred: np.ndarray, rows: np.ndarray, at_once: int = 256) -> np.ndarray:
    """log(sum(exp(pred rows'))) of each row of pred; both have the bias in their last column."""
    out = np.empty(len(pred))
    wide = np.ascontiguousarray(rows.T)
    for i in range(0, len(pred), at_once):
        out[i : i + at_once] = _log_sum(pred[i : i + at_once], wide)
    return out


def _contexts(ctx: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One example of each different context, and the context of each example, by number."""
    first, inverse = np.arange(ctx.shape[1]), np.zeros(ctx.shape[1], np.int64)
    for c in ctx:
        key = inverse * (n + 1) + c
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        first = order[new]
        inverse = np.empty(len(key), np.int64)
        inverse[order] = np.cumsum(new) - 1
    return first, inverse


def log_probabilities(p: Parameters, w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Normalised, one for each token. What a softmax adds up to is found once for each different context."""
    if not len(w):
        return np.empty(0)
    layout = p.layout
    first, context = _contexts(ctx, layout.n)
    pred = np.ones((len(first), D + 1), np.float32)
    pred[:, :D] = sum(p.c[k] * p.r[ctx[k][first]] for k in range(CONTEXT))
    units = np.concatenate([p.u, p.v[:, None]], 1)
    norm = _log_sums(pred, units)
    out = np.empty(len(w))
    unit = layout.unit(w)
    for i in range(0, len(w), 8192):
        j = slice(i, i + 8192)
        out[j] = np.einsum("ij,ij->i", pred.take(context[j], 0), units.take(unit[j], 0)) - norm[context[j]]
    tail = np.flatnonzero(w >= layout.single)
    if len(tail):
        key = layout.of_class(w[tail]) * len(first) + context[tail]
        order = np.argsort(key)
        tail, key = tail[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        which = np.cumsum(new) - 1
        t, once, c = w[tail], context[tail[new]], key[new] // len(first)
        some, rows = pred.take(once, 0), p.own[:, D:]
        norm = _class_log_sums(some, c, rows[layout.single : layout.n], layout.size)
        norm += _class_log_sums(some, c // layout.per, rows[layout.n + 1 :], layout.per)
        own = np.empty(len(t))
        for i in range(0, len(t), 8192):
            j = slice(i, i + 8192)
            x = rows[t[j]]
            x += rows[layout.n + 1 + c[which[j]]]
            own[j] = np.einsum("ij,ij->i", some.take(which[j], 0), x)
        out[tail] += own - norm[which]
    return out


#: Rows of pred that share a copy of their class at least and at most, and numbers that are handled at once.
PIECE, PIECES, AT_ONCE = 8, 128, 1 << 17


def _class_log_sums(pred: np.ndarray, key: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """log(sum(exp(pred rows'))) over the class `key` of each row of pred, classes being each `size` rows; key ascends."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.concatenate([first, [len(key)]]))
    piece = PIECE
    while piece < PIECES and 3 * piece * len(first) < 2 * len(key):
        piece *= 2
    pieces = -(-many // piece)
    start = np.repeat((np.cumsum(pieces) - pieces) * piece - first, many) + np.arange(len(key))
    padded = np.zeros((int(pieces.sum()) * piece, D + 1), np.float32)
    padded[start] = pred
    padded = padded.reshape(-1, piece, D + 1)
    of = np.repeat(key[first], pieces)
    out = np.empty((len(of), piece))
    inner = np.arange(size)
    at_once = max(1, AT_ONCE // (size * max(piece, D + 1)))
    for i in range(0, len(of), at_once):
        at = of[i : i + at_once, None] * size + inner
        none = None
        if at[-1, -1] >= len(rows):  # the last class may have fewer
            none = np.where(at >= len(rows), np.float32(-1e30), np.float32(0))[:, None, :]
            at = np.minimum(at, len(rows) - 1)
        out[i : i + at_once] = _log_sum(padded[i : i + at_once], rows[at].transpose(0, 2, 1), none)
    return out.reshape(-1)[start]


def score(docs: DataFrame, vocabulary: Vocabulary, p: Parameters) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row."""
    layout, shared, own = p.layout, p.shared, p.own

    def scored(batches):
        p = Parameters(layout, shared, own)
        for b in C.slices(batches, 1, SLICE):
            n = b.num_rows
            w, row = vocabulary.of(b.column(1))
            size = np.bincount(row, minlength=n)
            total = np.bincount(row, log_probabilities(p, w, examples(w, row, layout.n)) + vocabulary.log_part[w], n) if len(w) else np.zeros(n)
            per = np.exp(-total / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(np.round(total, 4)), pa.array(np.round(per, 4), mask=size == 0)], ["doc_id", "n_tokens", "log_prob", "perplexity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(scored, "doc_id long, n_tokens long, log_prob double, perplexity double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return score(docs, *train(docs))
