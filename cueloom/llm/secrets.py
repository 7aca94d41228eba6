"""Secret scans by assignment-aware lexing.

Source and configuration text is lexed into name-literal pairs: name = "literal", "name": 'literal', name: literal,
NAME=literal, name := "a" + other. Constants are propagated: a name on the right stands for the literal that was last
assigned to it in the text, and joined parts make one literal. A pair's score is the sensitivity of its target's name
(by its words) times how much the literal looks like a secret: length, entropy, mixture of classes, white space (several
words may be a passphrase, with words of a sentence they hardly are), no placeholder; a private key in PEM form is one.
A literal whose own form names its issuer (a known prefix and length), and a PEM private key, count with no target as well.

Cases: null ids and null or empty texts give no rows; of equal places the best score counts, the first among equals; every text
of a repeated doc_id is scanned, and equal findings are listed once; of one text every position is listed once; very
long texts are scanned whole; an empty table gives an empty result; other columns are ignored. Positions count characters from 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEAST = 0.5
NAMES = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.95, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8, "bearer": 0.9, "signature": 0.6, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("connection", "string"): 0.7}
HARMLESS = {"public", "count", "max", "min", "num", "length", "len", "type", "name", "example", "placeholder", "prompt", "label", "hint", "limit", "expiry", "expires"}
ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})(?![A-Za-z0-9])")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s\\:,\-]*?-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
_PEM_HEAD = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
_PART = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`[^`\n]*+`|[A-Za-z0-9_./+\-=$<>{}~!@#%^&*]+"
_NAME = re.compile(r"(?<![\w.\-])([A-Za-z_][\w.\-]*+)[\"']?[ \t]*(?:=>|:=|(?<![=!<>])=(?!=)|:(?!//))[ \t]*(?=\S)")
_RHS = re.compile(_PART)
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_IDENT = re.compile(r"[A-Za-z_][\w.]*")
_HOLDER = re.compile(r"^(?:x+|\*+|\.+|0+|changeme|example|placeholder|none|null|true|false|undefined|todo|test|dummy|<.*>|\$\{.*\}|\$\w+|\{\{.*\}\}|%.*%|process\.env.*|os\.environ.*|getenv.*)$", re.I)

_OWNED = re.compile(r"(?:my|your)(?:[\W_]*(?:own|new|super|actual|real|account|api|app|access|auth|aws|bearer|bot|client|company|connection|credentials?|database|db|encryption|github|id|key|login|name|passwd|passphrase|password|pass|private|project|pwd|secret|service|signing|string|token|user|value|example|placeholder|goes|here))*[\W_]*", re.I)
#: Words of sentences and prompts, which are no passphrases.
_SENTENCE = frozenset("a an and are as at be by can cannot choose confirm do does enter for forgot from has have here if in incorrect invalid is it its must new no not of on or please required reset should that the their this to use was when will with wrong you your".split())


def sensitivity(name: str) -> float:
    w = [x.lower() for x in _WORDS.findall(name)]
    best = max([0.0, *(NAMES.get(x, 0.0) for x in w), *(PAIRS.get(p, 0.0) for p in zip(w, w[1:])), *(NAMES.get(a + b, 0.0) for a, b in zip(w, w[1:]))])
    return best * (0.2 if HARMLESS & set(w) else 1.0)


def likeness(literal: str) -> float:
    n = len(literal)
    if _PEM_HEAD.search(literal):
        return 1.0
    if n < 6 or _HOLDER.match(literal) or _OWNED.fullmatch(literal) or not literal.strip():
        return 0.0
    words = literal.split()
    spaced = 1.0 if len(words) == 1 else 0.1 if _SENTENCE & {w.lower().strip(".,:;!?") for w in words} else 0.75
    count = Counter(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in count.values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    score = min(1.0, entropy / 3.2) * min(1.0, n / 10)
    return score * spaced if classes >= 2 else score * spaced * (0.9 if n >= 24 and entropy > 3.5 else 0.45)


def pairs(text: str):
    """(start, end, name, literal, propagated) of every assignment of a literal, in order."""
    known: dict[str, str] = {}
    for m in _NAME.finditer(text):
        name, at, parts, span, via = m[1], m.end(), [], None, False
        while p := _RHS.match(text, at):
            raw = p[0]
            quoted = raw[0] in "\"'`"
            if quoted:
                value = raw[1:-1]
            elif _IDENT.fullmatch(raw.rstrip(";,")) and raw.rstrip(";,") in known:
                value, via = known[raw.rstrip(";,")], True
            else:
                value = raw.rstrip(";,.)}]>!#$%&*")
            lead = 1 if quoted else 0
            span = (span[0] if span else p.start() + lead, p.start() + lead + (len(value) if quoted or not via else len(raw)))
            parts.append(value)
            plus = _PLUS.match(text, p.end())
            if not plus:
                break
            at = plus.end()
        if span:
            literal = "".join(parts)
            known[name] = literal
            yield *span, name, literal, via


def secrets(text: str) -> list[tuple]:
    """(start, end, target, score, rule), by position."""
    best: dict[int, tuple] = {}

    def put(start, end, name, score, rule):
        if score >= LEAST and (start not in best or score > best[start][3]):
            best[start] = (start, end, name, round(score, 4), rule)

    for start, end, name, literal, via in pairs(text):
        if s := sensitivity(name):
            put(start, end, name, s * likeness(literal), "propagated" if via else "assigned")
    for m in ISSUED.finditer(text):
        put(m.start(), m.end(), None, 0.95, "issued")
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            put(m.start(), m.end(), None, 0.95, "issued")
    return [best[k] for k in sorted(best)]


def _find(batches):
    for b in C.slices(batches):
        rows = [(d, *x) for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in secrets(text)]
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start_pos", "end_pos", "target", "score", "rule"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, target, score, rule) of every secret."""
    rows = C.with_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    t = F.col("text")
    hit = t.contains("=") | t.contains(":")
    for p in ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "PRIVATE KEY-----"):
        hit |= t.contains(p)
    return rows.where(hit).mapInArrow(_find, "doc_id long, start_pos long, end_pos long, target string, score double, rule string").distinct()


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.read(spark, sf_dir, "documents"))
