"""Decontamination (op8): the query and the stage against brute-force longest common subsequences over all windows."""

import random

import numpy as np
import pytest

from cueloom.llm import decontamination as D

CLASHING = ["_rid", "rid", "item_id", "share", "kind"]


def make(seed=1):
    r = random.Random(seed)
    common = ["de", "la", "en", "und", "der", "of"]
    rare = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    word = lambda: r.choice(common) if r.random() < 0.3 else r.choice(rare)
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(r.randint(12, 50)) + ". " + text(6) + ".") for k in range(40)]
    docs = [(k, text(r.randint(0, 400))) for k in range(150)]
    for k in range(120):
        w = r.choice(items)[1].replace(".", " . ").split()
        share = r.choice([1.0, 0.85, 0.75, 0.68, 0.62, 0.5])
        body = len(w) - 8
        for at in r.sample(range(body), min(body, round((1 - share) * len(w)))):
            w[at] = word()
        docs.append((200 + k, f"{text(r.randint(0, 200))}\n{' '.join(w).upper() if k % 2 else ' '.join(w)} {text(r.randint(0, 200))}"))
    bags = [(400 + k, " ".join(r.choice(items[k][1].split()) for _ in range(400))) for k in range(15)]  # an item's words, in any order
    return items, docs, bags


ODD = [(None, "no id"), (900, None), (901, ""), (902, "?!"), (903, "long text " * 8000)]


def brute(items, docs, window=D.REACH):
    found = {}
    its = [D.Item(i, t, None) for i, t in items]
    for d, t in docs:
        if d is None or t is None:
            continue
        h = D.C.words(*D.C.text_bytes(D.pa.array([t.lower()])))[0]
        for it in its:
            hit = np.isin(h, it.h)
            total = np.concatenate([[0], np.cumsum(hit)])
            for a in range(max(1, len(h) - it.reach + 1)):
                if total[min(len(h), a + it.reach)] - total[a] >= it.fewest and (got := it.leaks(h[a : a + it.reach])):
                    found[d, it.id] = max(found.get((d, it.id), got), got)
    return found


def tables(spark, items, docs):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*d, *"abcde") for d in docs], schema), spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def found(spark):
    items, docs, bags = make()
    docs = docs + ODD
    bench = items + [(None, "no id at all here"), (77, None), (78, ""), (79, "whole short phrase")]
    docs += [(950, "here is the whole short phrase again"), (951, "whole phrase short"), (951, docs[160][1])]
    d, b = tables(spark, bench, docs + bags)
    got = {(r["doc_id"], r["item_id"]): (r["share"], r["kind"]) for r in D.leaks(d, b).collect()}
    kept = [(r["doc_id"], r["text"]) for r in D.without_leaks(d, b).collect()]
    assert D.without_leaks(d, b).columns == d.columns
    return items, docs, bags, got, kept


def test_leaks_against_brute_force(found):
    items, docs, bags, got, _ = found
    want = brute(items, docs)
    short = {(950, 79): (1.0, "verbatim")}
    mine = {k: v for k, v in got.items() if k[0] < 400 or k[0] > 420}
    assert set(mine) <= set(want) | set(short) and short.items() <= mine.items()
    assert len(want) > 80 and len(set(mine) & set(want)) >= 0.95 * len(want)
    low = {k for k, v in want.items() if v[0] < 0.72}
    assert len(low) > 15 and len(low & set(mine)) >= 0.9 * len(low)
    assert all(v[0] <= want[k][0] + 1e-6 and v[0] >= want[k][0] - 0.15 for k, v in mine.items() if k in want)


def test_an_items_words_at_random_are_no_leak(found):
    items, _, bags, got, _ = found
    wrong = {d for d, _ in got} & {d for d, _ in bags}
    assert wrong <= {d for d, _ in brute(items, bags)} and len(wrong) <= 2


def test_stage_drops_rows_that_leak(found):
    items, docs, bags, got, kept = found
    bad = {d for d, _ in got}
    assert sorted(str(k) for k in kept) == sorted(str((d, t)) for d, t in docs + bags if d not in bad or (d == 951 and t == "whole phrase short"))


def test_turns_and_empty_tables(spark, found):
    items, docs, bags, got, _ = found
    d, b = tables(spark, items[:6], docs[150:200])
    assert sorted(D.leaks(d, b).collect()) == sorted(D.leaks(d, b, at_once=3).collect())
    none = d.where("doc_id < 0")
    assert D.leaks(none, b).collect() == D.leaks(d, b.where("item_id < 0")).collect() == D.without_leaks(none, b).collect() == []


def test_windows_are_sums_of_their_words():
    rng = np.random.default_rng(1)
    table = np.concatenate([rng.standard_normal((50, 3)), np.zeros((1, 3))]).astype(np.float32)
    row = np.repeat([0, 2, 3], [5, 130, 17])
    t = rng.integers(0, 50, len(row))
    blocks = D.Blocks(table, t, row, 96)
    for n in (8, 12, 16, 24, 32, 48, 64, 96):
        v, start = blocks.windows(n)
        for x, s in zip(v, start):
            assert x == pytest.approx(table[t[s : s + n]][row[s : s + n] == row[s]].sum(0), abs=1e-4)
        covered = {k for s in start for k in range(s, min(s + n, len(row))) if row[k] == row[s]}
        assert len(covered) == len(row)
    assert [D.window_length(n) for n in (1, 8, 9, 13, 17, 25, 500)] == [8, 8, 12, 16, 24, 32, 512]
