"""Ranked search, conversation repair and b-bit MinHash against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations, groupby

import numpy as np
import pytest

from catalogmap.llm import bbit_minhash, conversation_repair, max_sketch, queries
from tests.llm.brute_llm import WORD, upper_az_down

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------------------------------------- ranked search


def plain_search(docs, items, k):
    held = [(d, Counter(TERM.findall(upper_az_down(t or "")))) for d, t, *_ in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict = {}
    for item_id, text, *_ in items:
        asked.setdefault(item_id, set()).update(TERM.findall(upper_az_down(text or "")))
    out = []
    for item_id, terms in asked.items():
        scored = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item_id, r, None if nameless else d, -s) for r, (s, nameless, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def search_case():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ñandú", "x y", "ÀB", "it's", "a-b", "7"]
    texts = [None, "", " .,;! ", "one", "ONE one", "q " * 700 + "w1 w2", "ab\x00cd\x7fef", "é" * 3000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    texts += [texts[20]] * 15
    docs = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(None, "w1 w2 w3", "clash", 0), (9, "w3 one", "clash", 0), (9, "w3 one", "clash", 0)]
    items = [(0, "w1 W2 w2, w3"), (1, "one q ñandú Ñandú"), (2, None), (3, ""), (4, "unseen words"), (5, texts[20]), (6, "é ef"), (1, "w9"), (1, "w9"), (None, "w4 w5")]
    return docs, items


@pytest.mark.parametrize(("spread", "pairs", "cells"), [(8, 1 << 17, 1 << 22), (1, 4, 40)])
def test_ranked_search(spark, monkeypatch, spread, pairs, cells):
    docs, items = search_case()
    monkeypatch.setattr(max_sketch, "SPREAD", spread)
    monkeypatch.setattr(max_sketch, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(max_sketch, "CELLS", cells)
    d = spark.createDataFrame(docs, "doc_id long, text string, terms string, n int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in max_sketch.ranked_search(d, i, 5).collect()]
    assert sorted(got, key=str) == sorted(plain_search(docs, items, 5), key=str)


def test_search_counts_terms_by_a_join(spark, monkeypatch):
    docs, items = search_case()
    monkeypatch.setattr(max_sketch, "SENT_TERMS", 0)
    d, i = spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, max_sketch.ranked_search(d, i, 3).collect()), key=str) == sorted(plain_search(docs, items, 3), key=str)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert max_sketch.ranked_search(none, asked).count() == 0
    assert max_sketch.ranked_search(some, asked.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in max_sketch.ranked_search(some, asked).collect()] == [(1, 1, 1)]


def test_bounds_are_never_below_a_score():
    rng = random.Random(2)
    block = max_sketch.Block([(i, f"t{t}".encode(), rng.randint(0, 9000)) for i in range(4) for t in rng.sample(range(200), 20)])
    for size in (1, 30, 400):
        found = Counter(f"t{rng.randint(0, 199)}".encode() for _ in range(size * 9))
        counts = np.array(list(found.values()))
        sketch = max_sketch.sketch_of(list(found), counts)
        bounds = max_sketch.upper_bounds(block, sketch[None, :], np.array([37]))[0]
        for item, bound in enumerate(bounds.tolist()):
            assert bound >= sum(w * (10**9 * found[t] // (1000 * found[t] + 8 * 37)) for t, w in block.weights[item])


# ---------------------------------------------------------------------------------------------- conversation repair


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, turns) of one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        ink = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    best = {"": (0, "", ())}  # by the last initial written

    def better(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def inserted(table):
        table = dict(table)
        for _ in range(4):
            for state, (c, a, o) in list(table.items()):
                to = "a" if state == "u" else "u"
                better(table, to, (c + 2, a + "I", (*o, ({"a": "assistant", "u": "user"}[to], ""))))
        return table

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after: dict = {}
        for state, (c, a, o) in inserted(best).items():
            better(after, state, (c + 3, a + "D", o))
            if fault in ("b", "d"):
                continue
            more, to = c + (fault == "t"), "a" if state == "u" else "u"
            better(after, to, (more + 2, a + "R", (*o, ({"a": "assistant", "u": "user"}[to], text))))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                better(after, role[:1], (more, a + "K", (*o, (role, text))))
        best = after
    done = inserted(best)
    cost, audit, out = min(v for s, v in done.items() if s in ("", "a"))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, out


def talk(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "s", "Assistant", "usr"]
    texts = ["Yes.", "No", " \t", "", None, "What?", "so on", "Stop!  \n", "é…", "a.b"]
    return [(rng.choice([None, *range(n)]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.6 else f"t{rng.randint(0, n)}.") for _ in range(n)]


@pytest.mark.parametrize("pieces", [1, 17])
def test_conversation_repair(spark, pieces):
    rng = random.Random(pieces)
    rows = [(c, *r, "clash") for c in [None, *range(25)] for r in talk(rng, rng.randint(1, 12))]
    rows += [(77, *r, "clash") for r in talk(rng, 300)] + [(78, i, "user", "Same.", "x") for i in range(64)] + [(79, 1, "user", "Copy", "x")] * 40
    rows += [(80, 2 * i + j, ("user", "assistant")[j], f"Turn {i}.", "x") for i in range(60) for j in (0, 1)]
    rows += [(81, None, "system", "Null turns.", "x"), (81, None, "user", "of all", "x"), (82, 5, "assistant", "x" * 100_000, "x")]
    conf = {"spark.sql.shuffle.partitions": str(pieces), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        fixed = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string"))
        steps = fixed.steps.orderBy("conv_id", "place", "step").collect()
        faults = {r.conv_id: tuple(r)[1:] for r in fixed.faults.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal").collect()}
        digests = {r.conv_id: r for r in queries.repaired_digests(fixed.steps).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = {c: list(g) for c, g in groupby(steps, key=lambda r: r.conv_id)}
    by_id: dict = {}
    for c, turn, role, text, _ in rows:
        by_id.setdefault(c, []).append((turn, role, text))
    assert set(got) == set(by_id) == set(faults)
    for c, given in by_id.items():
        *counts, cost, audit, out = plain_repair(given)
        assert faults[c] == tuple(counts), c
        assert "".join(s.edit for s in got[c]) == audit, c
        assert sum(s.cost for s in got[c]) == cost
        assert tuple((s.role, s.text) for s in got[c] if s.edit != "D") == out
        assert (digests[c].cost, digests[c].audit) == (cost, audit)
        assert digests[c].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_runs_by_powers_equal_single_steps():
    rng = random.Random(4)
    for _ in range(200):
        symbol, length = rng.randrange(9), rng.randint(1, 70)
        after = tuple(rng.randint(0, 9) for _ in range(4))
        plain = after
        for _ in range(length):
            plain = conversation_repair.applied(conversation_repair.power(symbol, 0), plain)
        assert conversation_repair.before_run(symbol, length, after) == plain
        assert conversation_repair.applied(conversation_repair.run_matrix(symbol, length), after) == plain


def test_repair_of_nothing(spark):
    fixed = conversation_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert fixed.steps.count() == 0
    assert fixed.faults.count() == 0


# ---------------------------------------------------------------------------------------------- b-bit MinHash


def plain_sets(texts, width=4):
    out = []
    for t in texts:
        words = WORD.findall(upper_az_down(t or ""))
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def plain_classes(rows):
    sets, label = plain_sets([t for _, t, *_ in rows]), list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            label[root(j)] = root(i)
    least: dict = {}
    for i, r in enumerate(rows):
        least.setdefault(root(i), []).extend([] if r[0] is None else [r[0]])
    out = []
    for i, r in enumerate(rows):
        c = r[0] if not sets[i] else min(least[root(i)], default=None)
        out.append((r[0], len(sets[i]), c, r[0] == c))
    return out


def alike(seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    texts = [None, "", " \t\n", None, "one", "ONE", "one two three", "one two  three", "A B C D e", "a b c d E", "same " * 9000, "same " * 50]
    for family in range(8):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(9):
            new = list(base)
            for _ in range(rng.randint(0, 9)):  # about the threshold, on both sides
                new[rng.randrange(len(new))] = rng.choice(words)
            texts.append(" ".join(new))
        texts.append(" ".join([*base[:60], *(rng.choice(words) for _ in range(60))]))
    texts += [texts[-1]] * 20
    return [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[20], "clash"), (None, "nobody else has this text", "x"), (3, "one", "x"), (3, "one", "x")]


@pytest.mark.parametrize(("seed", "block_rows"), [(1, 1024), (2, 2)])
def test_bbit_minhash(spark, seed, block_rows):
    rows = alike(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = [tuple(r) for r in bbit_minhash.near_duplicates(docs, block_rows=block_rows).collect()]
    assert sorted(got, key=str) == sorted(plain_classes(rows), key=str)


def test_minhash_of_nothing(spark):
    assert bbit_minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, bbit_minhash.near_duplicates(blank).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.8, 1.0):
        found = []
        for _ in range(60):
            common, own = rng.integers(0, 1 << 63, int(300 * share), dtype=np.uint64), rng.integers(0, 1 << 63, (2, int(300 * (1 - share)) // 2), dtype=np.uint64)
            a, b = (np.concatenate([common, o]) for o in own)
            pa, pb = (bbit_minhash.packed(bbit_minhash.minima(x))[None, :] for x in (a, b))
            found.append(bbit_minhash.estimate(bbit_minhash.equal_slots(pa, pb)[0, 0]))
        assert abs(np.mean(found) - share) < 0.03


def test_meetings_leave_out_the_largest_component_with_itself(spark):
    lanes = ",".join(f"l{i}:bigint" for i in range(bbit_minhash.LANES))
    rows = spark.range(40).selectExpr("1L AS value", "id", "if(id < 34, 0, id) AS component", f"from_json('{{}}', 'struct<{lanes}>') AS sig")
    met = bbit_minhash._met(rows, 4).groupBy("left", "right").count().collect()
    assert all(r.right >= 0 for r in met)  # a block of the rest takes part
    assert len({(r.left, r.right) for r in met}) == 9 * 2 + 3
