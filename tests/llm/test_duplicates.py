"""Near-duplicate documents (op1) and lines (op5), queries and stages, against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cueloom.llm import common, components, line_dedup, near_dedup

ODD = [(None, "no id here"), (5000, None), (5001, ""), (5002, "...!?"), (5003, "word " * 3000), (5004, "same text here"), (5004, "same text here"), (5005, "one text of this number"), (5005, "quite another thing under it")]
CLASHING = ["_rid", "_gone", "_own", "_d", "_r", "band", "id", "root", "rid"]


def frame(spark, rows):
    more = [(f"m{k}", k % 3, -k) for k in range(len(rows))]
    return spark.createDataFrame([(i, t, len(t or ""), *(m[0] for _ in CLASHING)) for (i, t), m in zip(rows, more)], "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHING))


def vocabulary(seed=1, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 9))) for _ in range(n)], r


def union(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


# ---------------------------------------------------------------- documents
def shingles(t):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
    return frozenset(" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def documents():
    words, r = vocabulary()
    base = [" ".join(r.choice(words) for _ in range(r.randint(20, 120))) for _ in range(60)]
    rows = []
    for k, t in enumerate(base):
        rows.append((k, t))
        for c in range(k % 4):
            w = t.split()
            for _ in range(c * len(w) // 60):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((100 + 10 * k + c, " ".join(w).upper() if c == 1 else ", ".join(w)))
    return rows + [(100, base[7]), (7, base[9])] + ODD  # one text under two numbers, and another text under a number


def brute_documents(rows):
    kinds = sorted({(i, t) for i, t in rows if i is not None and t is not None and shingles(t)})
    sets = [shingles(t) for _, t in kinds]
    pairs = [(x, y) for x in range(len(kinds)) for y in range(x + 1, len(kinds)) if len(sets[x] & sets[y]) >= 0.6 * len(sets[x] | sets[y])]
    return kinds, union(pairs)


def test_near_duplicates_against_brute_force(spark):
    rows = documents()
    kinds, root = brute_documents(rows)
    groups = {}
    for x, r in root.items():
        groups.setdefault(r, set()).add(kinds[x][0])
    want = {(d, min(g)) for g in groups.values() if len(g) > 1 for d in g}
    got = {tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert len(want) > 90 and got == want


def test_keep_one_against_brute_force(spark):
    rows = documents()
    kinds, root = brute_documents(rows)
    docs = frame(spark, rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect())
    loose = [(i, t) for i, t in rows if i is None or t is None or not shingles(t)]
    groups = {}
    for x, k in enumerate(kinds):
        groups.setdefault(root.get(x, x), []).append(k)
    assert len(got) == len(loose) + len(groups)
    left = sorted(got, key=str)
    for g in groups.values():  # of each group one of the least number's texts
        least = {(str(i), str(t)) for i, t in g if i == min(g)[0]}
        assert len(least & set(left)) == 1
    assert {(str(i), str(t)) for i, t in loose} <= set(got) and {("5005", ODD[-1][1]), ("5005", ODD[-2][1])} <= set(got)


def test_no_documents(spark):
    none = frame(spark, ODD).where("doc_id < 0")
    assert near_dedup.near_duplicates(none).collect() == near_dedup.keep_one(none).collect() == line_dedup.duplicate_lines(none).collect() == line_dedup.without_duplicate_lines(none).collect() == []


# ---------------------------------------------------------------- lines
def grams(line):
    t = " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", line.lower())).encode()
    return frozenset(t[i : i + 5] for i in range(max(1, len(t) - 4))) if t else frozenset()


def pages():
    words, r = vocabulary(5)
    pool = []
    for k in range(100):
        t = ""
        while len(t) < 20 + 80 * (k % 40) / 40:
            t += r.choice(words) + " "
        pool.append(t.strip())
    rows = []
    for k in range(160):
        lines = []
        for _ in range(r.randint(1, 6)):
            t = r.choice(pool)
            how = r.randrange(4)
            if how == 1:
                at = r.randrange(len(t))
                t = t[:at] + "x" + t[at + 1 :]
            if how == 2:
                w = t.split()
                w[r.randrange(len(w))] = r.choice(words)
                t = " ".join(w)
            lines.append(t.upper() + "!" if how == 3 else t)
        lines.append("".join(r.choice("abcdefgh ") for _ in range(60)))
        rows.append((k, "\n".join(lines) + "\n" * (k % 2)))
    return rows + [(3, "a text of its own\n" + pool[0]), (3, "a text of its own\n" + pool[0])] + ODD


def brute_lines(rows):
    place = sorted({(i, t, k, x) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n")) if grams(x)}, key=lambda p: (p[0], p[1], p[2]))
    sets = [grams(p[3]) for p in place]
    links = [(a, b) for a in range(len(place)) for b in range(a + 1, len(place)) if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    return place, links


def test_lines_against_brute_force(spark):
    rows = pages()
    place, links = brute_lines(rows)
    root = union(links)
    found = line_dedup.duplicate_lines(frame(spark, rows)).collect()
    got = {(r["doc_id"], r["line_no"], r["kept_doc_id"], r["kept_line_no"]) for r in found}
    group = {}
    for x, p in enumerate(place):
        group.setdefault((p[0], p[2]), set()).add(root.get(x, x))
    assert all(group[a, b] & group[c, d] for a, b, c, d in got)  # nothing that brute force keeps apart
    gone = {(a, b) for a, b, *_ in got}
    want = {(place[x][0], place[x][2]) for x, r in root.items() if x != r}
    fuzzy = {(place[x][0], place[x][2]) for x, r in root.items() if x != r and not any(sets == grams(place[x][3]) for sets in (grams(place[y][3]) for y, q in root.items() if q == r and y < x))}
    assert len(want) > 150 and len(fuzzy) > 20
    assert len(gone & want) >= 0.97 * len(want) and len(gone & fuzzy) >= 0.9 * len(fuzzy)


def test_bands_find_nine_tenths_at_the_threshold():
    words, r = vocabulary(9)
    pairs = []
    while len(pairs) < 1500:
        t = " ".join(r.choice(words) for _ in range(r.randint(3, 15)))[:100]
        u = t
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(u))
            u = u[:at] + r.choice("abcdefgh") + u[at + 1 :]
        a, b = grams(t), grams(u)
        if 20 <= len(t) and 0.75 <= len(a & b) / len(a | b) < 1:
            pairs.append((t, u))

    def rows(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "rid", "text"])
        out = pa.Table.from_batches(line_dedup._lines([batch]))
        return np.stack([out.column(f"b{i}").to_numpy() for i in range(line_dedup.BANDS)], 1), np.stack([out.column(c).to_numpy() for c in ("m1", "m2")], 1)

    (a, x), (b, y) = rows([p[0] for p in pairs]), rows([p[1] for p in pairs])
    nibbles = lambda m: (m.view(np.uint64)[:, :, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4))) & np.uint64(15)
    near = (nibbles(x) == nibbles(y)).sum((1, 2)) >= components.least_agreeing(line_dedup.THRESHOLD)
    assert near.mean() > 0.995
    assert ((a == b).any(1) & near).mean() >= 0.9


def test_line_stage_takes_lines_out(spark):
    rows = pages()
    docs = frame(spark, rows)
    out = line_dedup.without_duplicate_lines(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = out.collect()
    gone = {}
    rid = {(r["doc_id"], r["text"]): r["h"] for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id, text) as h").collect()}
    for r in line_dedup.duplicate_lines(docs).collect():
        gone.setdefault(r["rid"], set()).add(r["line_no"])
    want = []
    for i, t in rows:
        g = gone.get(rid[i, t]) if i is not None and t is not None else None
        if g:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
            if not any(c.isalnum() for c in t):
                continue
        want.append((i, t, len(t or "")))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"], r["n_chars"])) for r in got)
    assert len({r["_gone"] for r in got}) > 50


def test_lines_of_one_hash_stay_apart(spark):
    lines = spark.createDataFrame([(1, 11, 0, 5, 6, *range(14)), (2, 12, 0, 5, 7, *range(20, 34)), (3, 13, 0, 5, 6, *range(14)), (4, 14, 0, 8, 9, *range(40, 54))], line_dedup._LINES)
    rows = line_dedup._kinds(lines, common.Tables(spark, "test")).collect()
    assert {(r["h1"], r["h2"], r["n"]) for r in rows} == {(5, 6, 2), (5, 7, 1), (8, 9, 1)} and len({r["id"] for r in rows}) == 3


def test_line_jaccard_against_sets():
    a, b = "the quick brown fox jumps over it", "the quick brown fox jumped over it"
    want = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    ids = np.array([1, 1]), np.array([2, 3])
    assert line_dedup.jaccard(ids[0], pa.array([a, a]), ids[1], pa.array([b, a])) == pytest.approx([want, 1.0])


# ---------------------------------------------------------------- union-find
def test_components_against_union_find(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST", 50)
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(80)] + [(9, 9)]
    want = union([p for p in pairs if p[0] != p[1]])
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    got = {x["id"]: x["root"] for x in components.components(edges, common.Tables(spark, "test")).collect()}
    assert got == want


# ---------------------------------------------------------------- kernels
@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_rows_of_repeated_bands_however_batches_are_cut(size):
    rng = np.random.default_rng(size)
    band = np.sort(np.concatenate([rng.integers(-50, 50, 60), np.full(20, 7), [99]]))
    ids = np.arange(len(band))
    cut = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (band, ids)], ["band", "id"]) for i in range(0, len(band), size)]
    got = [r for b in components._repeated([cut[0].slice(0, 0), *cut]) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert got == [(b, i) for b, i in zip(band, ids) if (band == b).sum() > 1]
    assert list(components._repeated([])) == []


def test_normal_lines_against_a_regular_expression():
    rng = random.Random(6)
    texts = ["", "\n", " \n a \n", "...!?", "tail \n", "\n lead", "é ß\nÜber"] + ["".join(rng.choice("aB \n.,é") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    kept, offsets, row, number = line_dedup.normal_lines(*common.text_bytes(pa.array(texts)))
    got = {(int(r), int(k)): kept[a:b].tobytes() for a, b, r, k in zip(offsets[:-1], offsets[1:], row, number)}
    want = {(r, k): re.sub(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", b"\0", x.encode()).strip(b"\0") for r, t in enumerate(texts) for k, x in enumerate(t.split("\n"))}
    assert {k: x for k, x in got.items() if x} == {k: x for k, x in want.items() if x}
