"""Personal data by a semi-Markov conditional random field.

Tokens are runs of letters and digits, and single other signs. A segmentation cuts the tokens into segments, each of a
type: O (one token) or an entity of up to LONGEST tokens. A segment's score is a weighted sum of features of its whole
span (form, checksums, ranges, what stands beside it), and neighbouring types add a transition score; dynamic
programming over the bounded segments finds the best boundaries and types together. The weights are trained here, by
the conditional likelihood of the true segmentation, on made-up sentences (TRAINING of them, from a fixed seed).

An entity must begin and end with a run of letters or digits (or begin with + or an opening bracket) and hold a digit
or an @, and it has at most SPACES gaps. Tokens far from every digit and @ can then only be O, so that the programme is
run on the neighbourhoods of these signs; a text is cut only at a blank with nothing of the kind within reach, and
whole texts are covered.

Cases: null ids and null or empty texts give no rows; equal scores go to the earlier type, O first; every text
of a repeated doc_id is scanned, and equal findings are listed once; very long texts are scanned whole; an empty table gives an empty result; other columns are
ignored. Positions count characters from 0.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TYPES = ("O", "EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN")
#: An IBAN of 34 characters in groups of four has 8 gaps; an e-mail address has at most 254 characters. Nothing but an
#: address has more than SHORT tokens.
LONGEST, SPACES, SHORT = 254, 8, 17
TRAINING, EPOCHS, RATE, DECAY = 400, 4, 0.5, 1e-4
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9@]")

_FORM = [
    re.compile(p)
    for p in (
        r"[\w.+%\-]+@[^\W_](?:[^\W_]|-)*(?:\.[^\W_](?:[^\W_]|-)*)+",
        r"(?:\d{1,3}\.){3}\d{1,3}",
        r"(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}",
        r"\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}",
        r"\d{3}[ .\-]\d{3}[ .\-]\d{4}",
        r"\d{3}-\d{2}-\d{4}",
        r"\d{13,19}",
        r"\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}",
        r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?",
        r"\d+",
    )
]


def _luhn(digits: str) -> bool:
    t = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


N_FEATURES = 24


def features(span: str, before: str, after: str, n: int) -> list[int]:
    """The features of a whole span that hold; before and after: the signs beside it, n: its tokens."""
    out = [0]
    put = out.append
    forms = [bool(f.fullmatch(span)) for f in _FORM]
    out += [1 + i for i, x in enumerate(forms) if x]
    digits = re.sub(r"\D", "", span) if span.isascii() else "".join(c for c in span if c in "0123456789")
    if (forms[6] or forms[7]) and digits[0] in "23456":
        put(11 if _luhn(digits) else 12)
    if forms[1]:
        put(13 if all(int(x) < 256 for x in span.split(".")) else 14)
    if forms[8]:
        put(15 if _iban(span) else 16)
    if not any(forms):
        put(17)
    if before and (before.isalnum() or before in "@_-+/" or before == "." or (before == "(" and ")" in after)):
        put(18)
    if after and (after.isalnum() or after in "@_-/"):
        put(19)
    if "@" in span:
        put(20)
    if n == 1:
        put(21)
    if 7 <= len(digits) <= 15:
        put(22)
    if forms[5] and (digits[:3] in ("000", "666") or digits[0] == "9"):
        put(23)
    return out


def candidates(text: str, tokens: list[tuple[int, int]]):
    """(first token, tokens, features) of every segment that may be an entity."""
    out, n = [], len(tokens)
    kind = []
    for a, b in tokens:
        s = text[a:b]
        kind.append((s[0].isalnum(), s in "+(", bool(_TRIGGER.search(s)), s))
    gap = [i > 0 and tokens[i][0] > tokens[i - 1][1] for i in range(n)]
    # one past the last token of the run without gaps, if an @ is still to come in it
    to_sign, end, sign = [0] * n, n, False
    for i in range(n - 1, -1, -1):
        sign |= kind[i][3] == "@"
        to_sign[i] = end if sign else 0
        if gap[i]:
            end, sign = i, False
    for i in range(n):
        if not (kind[i][0] or kind[i][1]):
            continue
        trigger, spaces = False, 0
        for j in range(i, min(n, i + LONGEST, max(i + SHORT, to_sign[i]))):
            if j > i and gap[j]:
                spaces += 1
                if spaces > SPACES:
                    break
            trigger |= kind[j][2]
            if not kind[j][0] or not trigger:
                continue
            a, b = tokens[i][0], tokens[j][1]
            span = text[a:b]
            if j - i >= SHORT and (spaces or not _FORM[0].fullmatch(span)):
                continue
            if any(c.isalpha() for c in span) and ("@" not in span or spaces) and not (len(span) > 14 and span[:2].isupper() and span[2:4].isdigit()):
                continue
            # a full stop ends a sentence unless something follows it at once
            after = text[b : b + 1]
            if after in (".", ",") and text[b + 1 : b + 2].isalnum():
                after = "-"
            out.append((i, j - i + 1, features(span, text[a - 1 : a] if a else "", after, j - i + 1)))
    return out


class Model:
    def __init__(self):
        self.w = np.zeros((len(TYPES), N_FEATURES))
        self.t = np.zeros((len(TYPES), len(TYPES)))

    def scores(self, cands):
        """{(first, tokens): scores of the types but O}."""
        return {(i, d): self.w[1:, f].sum(1) for i, d, f in cands}

    def decode(self, n: int, cands):
        """Best segments (first, tokens, type) that aren't O."""
        by_end: dict[int, list] = {}
        for (i, d), s in self.scores(cands).items():
            by_end.setdefault(i + d, []).append((i, d, s))
        k = len(TYPES)
        v = np.full((n + 1, k), -np.inf)
        v[0, 0] = 0.0
        back: list[list] = [[None] * k for _ in range(n + 1)]
        for e in range(1, n + 1):
            got = v[e - 1] + self.t[:, 0]
            p = int(got.argmax())
            v[e, 0], back[e][0] = got[p], (e - 1, p)
            for i, d, s in by_end.get(e, ()):
                got = v[i][:, None] + self.t[:, 1:]
                p = got.argmax(0)
                total = got[p, np.arange(k - 1)] + s
                for y in np.flatnonzero(total > v[e, 1:]):
                    v[e, y + 1], back[e][y + 1] = total[y], (i, int(p[y]))
        out, e, y = [], n, int(v[n].argmax())
        while e > 0:
            i, p = back[e][y]
            if y:
                out.append((i, e - i, y))
            e, y = i, p
        return out[::-1]

    def gradient(self, n: int, cands, gold: list):
        """Adds to (dw, dt) the gradient of the log-likelihood of the gold segments; returns them."""
        k = len(TYPES)
        score = self.scores(cands)
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        feats = {(i, d): f for i, d, f in cands}
        for (i, d), s in score.items():
            by_end.setdefault(i + d, []).append((i, d, s))
            by_start.setdefault(i, []).append((i, d, s))
        lse = lambda x, axis=0: (m := x.max(axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))
        low = -1e30
        a = np.full((n + 1, k), low)
        a[0, 0] = 0
        for e in range(1, n + 1):
            a[e, 0] = lse(a[e - 1] + self.t[:, 0])
            for i, d, s in by_end.get(e, ()):
                a[e, 1:] = np.logaddexp(a[e, 1:], lse(a[i][:, None] + self.t[:, 1:]) + s)
        b = np.full((n + 1, k), low)
        b[n] = 0
        for e in range(n - 1, -1, -1):
            b[e] = self.t[:, 0] + b[e + 1, 0]
            for i, d, s in by_start.get(e, ()):
                b[e] = np.logaddexp(b[e], lse(self.t[:, 1:] + (s + b[e + d, 1:])[None, :], 1))
        z = lse(a[n])
        dw, dt = np.zeros_like(self.w), np.zeros_like(self.t)
        for e in range(1, n + 1):
            dt[:, 0] -= np.exp(np.minimum(a[e - 1] + self.t[:, 0] + b[e, 0] - z, 0))
            for i, d, s in by_end.get(e, ()):
                p = np.exp(np.minimum(a[i][:, None] + self.t[:, 1:] + (s + b[e, 1:])[None, :] - z, 0))
                dt[:, 1:] -= p
                dw[1:, feats[i, d]] -= p.sum(0)[:, None]
        true = {(i, d): y for i, d, y in gold}
        at, last = 0, 0
        starts = {i: (d, y) for (i, d), y in true.items()}
        while at < n:
            d, y = starts.get(at, (1, 0))
            if y:
                dw[y, feats[at, d]] += 1
            dt[last, y] += 1
            at, last = at + d, y
        return dw, dt


def tokenise(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def made_up(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence and its entities (start, end, type)."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syll = ["ta", "ren", "ko", "li", "mu", "sa", "der", "pon", "vi", "el", "or", "na"]
    word = lambda: "".join(pick(*syll) for _ in range(int(rng.integers(1, 4))))

    def card():
        n = pick(15, 16, 16, 16)
        body = pick("4", "5", "37", "6") + num(n)
        body = body[: n - 1]
        return next(body + str(c) for c in range(10) if _luhn(body + str(c)))

    def iban():
        country, body = pick("DE", "FR", "GB", "ES", "MT", "BR", "LC"), pick(num(18), num(18), num(pick(11, 16, 20, 23, 25, 26)), "".join(pick("A", "K", "R", "Z") for _ in range(4)) + num(pick(14, 21, 22, 23, 24, 25, 26)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{check:02d}{body}"
        return pick(whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)))

    def entity():
        y = int(rng.integers(1, len(TYPES)))
        if y == 1:
            s = word() + pick("", "." + num(2), "_" + word(), "-" + word(), "+" + word()) + "@" + word() + pick("", num(1), "." + word()) + "." + pick("com", "org", "example.com", "net", "co.uk")
        elif y == 2:
            a, b, c = num(3), num(3), num(4)
            s = pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+49 {num(3)} {num(7)[:4]} {num(3)}", f"+33 {num(2)} {num(2)} {num(2)} {num(2)}", f"+44{num(10)}", f"{a}.{b}.{c}")
        elif y == 3:
            s = ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
        elif y == 4:
            c = card()
            s = pick(c, c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4))) if len(c) == 16 else c
        elif y == 5:
            s = f"{pick('1', '2', '3', '5')}{num(2)}-{num(2)}-{num(4)}"
        else:
            s = iban()
        return s, y

    def decoy():
        c = card()
        bad = c[:-1] + str((int(c[-1]) + int(rng.integers(1, 10))) % 10)
        return pick(num(int(rng.integers(1, 9))), "20" + num(2), f"{num(1)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(2)}:{num(2)}", bad, bad, " ".join(bad[i : i + 4] for i in range(0, len(bad), 4)), f"{num(4)}-{num(2)}-{num(2)}", f"{word()}{num(2)}", "@" + word(), f"{word()} @ {num(2)}", f"{num(3)}.{num(3)}.9{num(2)}.8{num(2)}", f"{int(rng.integers(300, 999))}.{num(2)}.{num(2)}.{num(2)}", f'"{num(4)}a{num(6)}bc{num(9)}d"', f"#{num(7)}", f"{num(3)},{num(3)}.{num(2)}", f"9{num(2)}-{num(2)}-{num(4)}", num(10), f"{num(2)}/{num(2)}/{num(4)}", f"(20{num(2)})", f"{num(12)}", f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}", f"AB{num(20)}")

    text, gold = "", []
    for _ in range(int(rng.integers(3, 10))):
        r = rng.random()
        if r < 0.35:
            s, y = entity()
            gold.append((len(text), len(text) + len(s), y))
        else:
            s = decoy() if r < 0.65 else word()
        text += s + pick(" ", " ", " ", " ", ". ", ", ", "### ", "!! ")
        if r < 0.65 and rng.random() < 0.7:
            text += word() + " "
    return text, gold


@lru_cache(maxsize=1)
def trained() -> Model:
    rng = np.random.default_rng(11)
    data = []
    for _ in range(TRAINING):
        text, gold = made_up(rng)
        tokens = tokenise(text)
        first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i for i, (_, b) in enumerate(tokens)}
        cands = candidates(text, tokens)
        have = {(i, d) for i, d, _ in cands}
        seg = [(first[a], last[b] - first[a] + 1, y) for a, b, y in gold if a in first and b in last]
        if len(seg) == len(gold) and all((i, d) in have for i, d, _ in seg):
            data.append((len(tokens), cands, seg))
    m = Model()
    gw, gt = np.full_like(m.w, 1e-8), np.full_like(m.t, 1e-8)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            dw, dt = m.gradient(*data[k])
            dw, dt = dw - DECAY * m.w, dt - DECAY * m.t
            gw += dw**2
            gt += dt**2
            m.w += RATE * dw / np.sqrt(gw)
            m.t += RATE * dt / np.sqrt(gt)
    m.w[0] = 0
    return m


REACH = 96  # characters about a digit or @ that may belong with it
_GROUPS = re.compile(r"(?: [A-Z0-9]{1,4}(?![^\W_])){0,8}")  # of an IBAN, which may end in groups without digits


def neighbourhoods(text: str) -> list[tuple[int, int]]:
    """Stretches, ending at blanks, that hold every digit and @ and all that may be one entity with it."""
    out: list[list[int]] = []
    for m in re.finditer(r"[0-9@]+", text):
        if out and m.start() - out[-1][1] <= REACH:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    spans = []
    for a, b in out:
        end = spans[-1][1] if spans else 0
        if b <= end:
            continue
        while a > end and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        b = _GROUPS.match(text, b).end()
        head = re.search(r"(?:\S+\s){0,1}$", text[max(0, a - 40) : a])  # "+" or "(" or an IBAN's letters may stand apart
        spans.append((max(end, a - len(head[0]) if head else a), b))
    return spans


def entities(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, type), by position."""
    out = []
    for a, b in neighbourhoods(text):
        part = text[a:b]
        tokens = tokenise(part)
        cands = candidates(part, tokens)
        if cands:
            out += [(a + tokens[i][0], a + tokens[i + d - 1][1], TYPES[y]) for i, d, y in model.decode(len(tokens), cands)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, kind) of every entity."""
    model = trained()

    def find(batches):
        for b in C.slices(batches):
            rows = [(d, *x) for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in entities(text, model)]
            cols = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start_pos", "end_pos", "kind"])

    rows = C.with_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    t = F.col("text")
    hit = t.contains("@")
    for d in "0123456789":
        hit |= t.contains(d)
    return rows.where(hit).mapInArrow(find, "doc_id long, start_pos long, end_pos long, kind string").distinct()


def op7_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.read(spark, sf_dir, "documents"))
