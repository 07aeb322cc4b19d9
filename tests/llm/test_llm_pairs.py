"""SimHash classes, line alignment, decontamination and the pipeline against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalogmap.llm import decontaminate, line_align, simhash
from tests.llm import brute_llm as brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "do", "ki", "mu", "ter", "lin") for b in ("ra", "sol", "tan", "vek", "nip", "gor", "hal", "zu")]


def passage(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def near_texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \t\n", "one", "ONE", "one two three", " ", "x" * 50_000]
    for _ in range(6):
        words = passage(rng, 200).split()
        for _ in range(6):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(WORDS)
            texts.append(" ".join(changed))
    texts += [texts[-1]] * 5
    return texts


def test_fingerprint_blocks(monkeypatch):
    rng = random.Random(1)
    text = passage(rng, 500) + "\x0b" + passage(rng, 20).upper() + " é ü"
    whole = simhash.fingerprint(text)
    assert whole == brute.simhash(text)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_near_duplicates(spark, block_rows):
    rows = [(*r[:2], "clash") for r in rows_of(near_texts(3))] + [(None, "one", "x"), (None, "alone in its class, this one is", "y"), (3, "one", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_duplicates(docs, block_rows=block_rows).collect()), key=str)
    assert got == sorted(brute.near_classes([r[:2] for r in rows]), key=str)


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("max_bits", [0, 3, 4, 6])
def test_forest_links_join_what_is_near(max_bits):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    values = np.unique(np.concatenate([[c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))] for c in centres]))
    n = len(values)
    group, zero = np.zeros(n, int), np.zeros(n, int)
    u, v = simhash._forest_links(group, zero, np.ones(n, bool), values, max_bits)
    assert len(u) < n and all(np.bitwise_count(u ^ v) <= max_bits)
    label = {x: x for x in values.tolist()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        label[root(a)] = root(b)
    for a in values.tolist():
        for b in values.tolist():
            if (a ^ b).bit_count() <= max_bits:
                assert root(a) == root(b)


def line_texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    shared = ["\n".join(passage(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 5))) for _ in range(5)]
    long_line = passage(rng, 60)
    texts: list[str | None] = [None, "", "\n\n", "short line\n" * 5]
    for _ in range(40):
        parts = [passage(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 6))] + rng.sample(shared, rng.randint(0, 2)) + [long_line] * rng.randint(0, 2) + ["common line"] * rng.randint(0, 3)
        rng.shuffle(parts)
        texts.append("\n".join(parts))
    return [*texts, texts[-1], texts[-1]]


def has_words(line: str) -> bool:
    return bool(line.strip(" \t\r\v\f\n"))


def test_copied_lines_keep_every_first_copy(spark):
    """No run of least_words words is held twice by different documents, no line vanishes from all."""
    least, texts = 25, line_texts(5)
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    out = {r.doc_id: r for r in line_align.delete_copied_lines(docs, least).collect()}
    assert len(out) == len(texts) and out[0].text is None
    holders: dict[int, set[int]] = {}
    for i, r in out.items():
        for run in line_align.line_runs(r.text, least)[3]:
            if run:
                holders.setdefault(run, set()).add(i)
    before: dict[int, set[int]] = {}
    for i, t in enumerate(texts):
        for run in line_align.line_runs(t, least)[3]:
            if run:
                before.setdefault(run, set()).add(i)
    shared = {run for run, ids in before.items() if len(ids) > 1}
    assert shared and not [run for run in shared if len(holders.get(run, ())) > 1]
    assert all(min(ids) in holders[run] for run, ids in before.items() if run in holders)
    lines = lambda ts: {x for t in ts for x in (t or "").split("\n") if has_words(x)}
    assert lines(r.text for r in out.values()) == lines(texts)
    untouched = [i for i, t in enumerate(texts) if out[i].n_deleted == 0]
    assert all(out[i].text == texts[i] for i in untouched) and len(untouched) > 4
    # only lines that an earlier document holds go
    for i, r in out.items():
        left = (r.text or "").split("\n")
        gone = [x for x in (texts[i] or "").split("\n") if x not in left]
        assert all(any(x in (t or "").split("\n") for t in texts[:i]) for x in gone)


def test_copied_lines_edge_rows(spark):
    rng = random.Random(7)
    block = passage(rng, 30)
    docs = spark.createDataFrame([(None, block, 9), (5, block, 1), (5, block, 2), (6, "head\n" + block + "\n" + block, 3), (7, block + " ", 4)], "doc_id long, text string, n_deleted int")
    got = sorted(((r.doc_id, r.text, r.n_deleted) for r in line_align.delete_copied_lines(docs).collect()), key=str)
    assert got == sorted([(None, "", 1), (5, block, 0), (5, block, 0), (6, "head", 2), (7, "", 1)], key=str)
    assert line_align.delete_copied_lines(docs.limit(0)).count() == 0


def test_blocks_that_the_alignment_splits(spark):
    rng = random.Random(23)
    c, z, last, w = (passage(rng, 15) for _ in range(4))
    docs = spark.createDataFrame([(1, "\n".join((c, z, c, last))), (2, "\n".join((c, last, w)))], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_align.delete_copied_lines(docs).collect()}
    assert got == {1: ("\n".join((c, z, c, last)), 0), 2: (w, 2)}


def test_every_copy_of_a_corpus_goes(spark):
    """Equal to plain comparison of all stretches of all pairs, with lines of every length and chains of holders."""
    rng = random.Random(41)
    pool = [passage(rng, n) for n in (1, 2, 4, 7, 9, 12, 16, 20, 31, 40)]
    first, tail = passage(rng, 31), passage(rng, 20)
    texts = [first, f"{first}\n{tail}", f"{first}\n{tail}\n{passage(rng, 3)}"] + ["\n".join(rng.choices(pool, k=rng.randint(1, 7))) for _ in range(40)]
    want, seen = {}, set()
    for i, text in enumerate(texts):
        lines = text.split("\n")
        spans = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if len(" ".join(lines[a:b]).split()) >= 25]
        gone = {k for a, b in spans if tuple(lines[a:b]) in seen for k in range(a, b)}
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        seen |= {tuple(lines[a:b]) for a, b in spans}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_align.delete_copied_lines(docs).collect()} == want
    assert want[2] == texts[2].split("\n")[2]


def test_every_common_block_goes():
    rng = random.Random(29)
    for _ in range(400):
        lines = {i: rng.randint(1, 20) for i in range(1, 6)}
        a, b = ([rng.randint(1, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        runs = lambda x: [next((hash(tuple(x[i:e])) for e in range(i + 1, len(x) + 1) if sum(lines[k] for k in x[i:e]) >= 25), 0) for i in range(len(x))]
        held = {tuple(a[i:e]) for i in range(len(a)) for e in range(i + 1, len(a) + 1)}
        want = {k for i in range(len(b)) for e in range(i + 1, len(b) + 1) if tuple(b[i:e]) in held and sum(lines[k] for k in b[i:e]) >= 25 for k in range(i, e)}
        assert line_align.copied_places(a, runs(a), b, runs(b), [lines[k] for k in b], 25) == sorted(want)


def test_patience_anchors_rise():
    assert line_align.patience_anchors([1, 2, 3, 4, 5], [1, 4, 2, 3, 5], 0, 5, 0, 5) == [(0, 0), (1, 2), (2, 3), (4, 4)]
    assert line_align.patience_anchors([1, 1], [1, 1], 0, 2, 0, 2) == []


def contamination_case(seed: int):
    rng = random.Random(seed)
    items = [passage(rng, n) for n in (1, 4, 9, 14, 30, 60)] + ["", None]
    docs = [None, "", passage(rng, 300)]
    for item in items[3:6]:
        words = item.split()
        for changes in (0, 1, 2):
            changed = list(words)
            for k in range(changes):
                changed[len(words) * (k + 1) // 3] = "changed"
            docs.append(f"{passage(rng, 40)}. {' '.join(changed).upper()}, {passage(rng, 10)}")
        docs.append(" ".join(words[: len(words) // 3]))
    docs.append(items[1] + " end")
    return docs, items


def test_decontamination(spark):
    docs, items = contamination_case(11)
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, hash int")
    found = decontaminate.contaminated(spark.createDataFrame(rows_of(docs), DOCS), bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if brute.holds(doc, item)}
    # hits begin at a seed: an overlap of 13 tokens or more has one unless most of it is changed
    assert got == want and len(got) >= 9
    assert all(r.length >= r.matched >= 0.8 * r.length and r.start >= 0 for r in found)


def test_hits_of_pairs_do_not_go_to_the_driver(spark):
    """The hits of a pair take little room on disk and much in a hash table: they meet their documents by a shuffle."""
    docs, items = contamination_case(11)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.contaminated_texts(spark.createDataFrame(rows_of(docs), DOCS), bench)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [doc#" in plan and "BroadcastHashJoin [doc#" not in plan


def test_any_stretch_by_the_stated_rule():
    """A stretch is found exactly if some stretch of 13 tokens (or the whole short item) is 80 % equal."""
    rng, item = random.Random(17), np.arange(1000, 1200)
    for n in [1, 4, 5, 12, 13, 15, 20, 40, 200]:
        for _ in range(60):
            part = item[:n]
            doc = np.concatenate((np.zeros(5, int), part, np.zeros(5, int)))
            doc[[5 + i for i in range(n) if rng.random() < rng.choice((0.05, 0.2, 0.4))]] = 1
            equal = [int(x) for x in doc[5 : 5 + n] == part]
            valid = [(sum(equal[i:j]), i - j, -i) for i in range(n) for j in range(i + min(13, n), n + 1) if 5 * sum(equal[i:j]) >= 4 * (j - i)]
            got = decontaminate.best_stretch(doc, part, 5)
            assert (got is None) == (not valid)
            if got:
                at, length, matched = got
                assert matched == sum(equal[at - 5 : at - 5 + length]) == max(valid)[0] and length >= min(13, n) and 5 * matched >= 4 * length


def test_changed_words_beside_the_rim_are_found(spark):
    rng = random.Random(19)
    items = [passage(rng, n) for n in (12, 13, 60)]
    docs = []
    for k, at in ((0, [1]), (1, [2]), (2, [i for i in range(20, 60) if i % 2])):
        words = items[k].split()
        docs.append(f"{passage(rng, 30)} {' '.join('changed' if i in at else w for i, w in enumerate(words))} {passage(rng, 30)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(rows_of(docs), DOCS), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 1), (2, 2)}


def test_decontamination_edge_rows(spark):
    rng = random.Random(3)
    item = passage(rng, 20)
    docs = spark.createDataFrame([(None, item), (1, item), (1, item), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(None, 1), (None, None), (1, 1), (1, None)], key=str)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_repetitive_texts_meet_an_item_once(spark):
    rng = random.Random(12)
    docs = [(1, "again " * 20_000), (2, "again and " * 4_000), (3, passage(rng, 300))]
    bench = spark.createDataFrame([(1, "again " * 3_000), (2, "and again " * 900)], "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id): (r.length, r.matched) for r in found}[1, 1] == (3000, 3000)
    assert {(r.doc_id, r.item_id): (r.length, r.matched) for r in found}[2, 2] == (1800, 1800)
    assert all(r.doc_id < 3 for r in found)


def test_ranges_of_diagonals_are_those_of_all_pairs(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(decontaminate, "RANGES", 7)
    for _ in range(200):
        n, m = rng.randint(1, 40), rng.randint(1, 30)
        met = [(np.array(sorted(rng.sample(range(n), rng.randint(1, n)))), np.array(sorted(rng.sample(range(m), rng.randint(1, m))))) for _ in range(3)]
        want = sorted({int(a - p) for at, place in met for a in at for p in place})
        assert decontaminate.hit_diagonals(met, n, m).tolist() == want


def test_different_texts_of_one_id_are_told_apart(spark):
    rng = random.Random(6)
    leak, clean = passage(rng, 30), passage(rng, 60)
    docs = spark.createDataFrame([(1, f"{clean} {leak}"), (1, clean), (None, leak), (None, clean)], "doc_id long, text string")
    bench = spark.createDataFrame([(4, leak)], "item_id long, text string")
    keyed = decontaminate.contaminated_texts(docs, bench).join(docs.select(F.xxhash64("text").alias("text_key"), "text"), "text_key")
    assert {(r.doc_id, leak in r.text) for r in keyed.collect()} == {(1, True), (None, True)}


@pytest.mark.parametrize("name", ["gone_id", "gone_key", "gone_lines", "GONE_LINES", "key", "lines", "ord", "run", "n_deleted", "runs", "_id", "_key", "_spans", "span_id", "span_key", "spans", "term"])
def test_extra_columns_with_any_name(spark, name):
    from catalogmap.llm import pii

    rng = random.Random(2)
    block = passage(rng, 40)
    docs = spark.createDataFrame([(1, block, "mine"), (2, f"{block}\nmail joe@example.org", "yours")], f"doc_id long, text string, {name} string")
    found = line_align.delete_copied_lines(docs).orderBy("doc_id").collect()
    assert [r.n_deleted for r in found] == [0, 1] and found[1].text == "mail joe@example.org"
    clean = pii.sanitise(docs).orderBy("doc_id").collect()
    assert clean[1].text.endswith("mail [EMAIL]") and clean[1][name] == "yours"


def test_spaced_seed_ignores_the_unmarked():
    tokens = decontaminate.token_hashes("a b c d e f g h i")
    other = decontaminate.token_hashes("a b c X e f Y h i")
    assert decontaminate.seed_hashes(tokens, "111011011").tolist() == decontaminate.seed_hashes(other, "111011011").tolist()
    assert decontaminate.seed_hashes(tokens, "111111111").tolist() != decontaminate.seed_hashes(other, "111111111").tolist()


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decision holds in what it returns; the last one packs every remaining token."""
    rng = random.Random(13)
    item, block = passage(rng, 30), passage(rng, 60)
    clean = [passage(rng, 80) for _ in range(60)]
    toxic = [f"{passage(rng, 40)} vilest {passage(rng, 40)}" for _ in range(30)]
    texts = clean + toxic + [f"{block}\n{clean[1][:100]}", f"start words here\n{block}", block, clean[0].upper(), f"{passage(rng, 50)} {item}", None, "", "   "]
    rows = rows_of(texts) + [(None, passage(rng, 70), "en", "s", 1), (2, texts[2], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(60 <= i < 90)) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = {}
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = current
        if name != "packing":
            assert current.columns == docs.columns
    ids = lambda name: sorted(r.doc_id for r in at[name].collect() if r.doc_id is not None)
    assert not set(ids("toxicity")) & set(range(60, 90)) and set(range(60)) <= set(ids("toxicity"))
    lines = {r.doc_id: r for r in at["line_dedup"].collect()}
    assert lines[90].text == texts[90] and lines[91].text == "start words here" and lines[91].n_chars == 16 and 92 not in lines and {95, 96, 97} <= set(lines)
    kept = ids("simhash_near_dedup")
    assert 93 not in kept and {0, 95} <= set(kept) and not {96, 97} & set(kept) and len(kept) == len(set(kept))
    assert ids("benchmark_decontamination") == [i for i in kept if i != 94]
    assert at["benchmark_decontamination"].where("doc_id is null").count() == 1
    packed = at["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("want")).collect()
    assert all(r.n == r.want for r in packed) and len(packed) == at["benchmark_decontamination"].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at["packing"].count()
