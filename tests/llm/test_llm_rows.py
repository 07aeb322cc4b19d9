"""Toxicity, packing, chat formatting, quality, personal data, archives and URL rules."""

from __future__ import annotations

import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogmap.llm import chat_format, packing, pii, quality_trees, queries, toxicity, url_rules, warc
from catalogmap.llm.queries import public_encoder
from tests.llm import brute_llm as brute

SF = "/root/testdata/sf0.01"


# toxicity


def toxic_rows(n: int, seed: int, hidden: float = 0.0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["grubworm", "nastling", "vilecur", "rotbrain"]
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        yield i, " ".join(text), toxic


def test_toxicity_on_unseen_rows(spark):
    rows = list(toxic_rows(900, 1))
    model = toxicity.train(spark.createDataFrame([r for r in rows if r[0] % 3], "doc_id long, text string, toxic int"))
    unseen = [r for r in rows if r[0] % 3 == 0]
    scored = {r.doc_id: r.score for r in toxicity.score_documents(spark.createDataFrame(unseen, "doc_id long, text string, score int"), model).collect()}
    wrong = [i for i, _, toxic in unseen if (scored[i] >= 0.3) != bool(toxic)]
    assert len(wrong) <= 0.03 * len(unseen)
    edge = [(None, None), (1, ""), (1, ""), (2, "x" * 200_000), (3, "grubworm " * 20_000)]
    got = toxicity.score_documents(spark.createDataFrame(edge, "doc_id long, text string"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score for r in got}[3] > 0.9


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.train(empty)
    assert 0 <= toxicity.score_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).first().score < 0.3
    assert toxicity.score_documents(empty, model).count() == 0
    nulls = spark.createDataFrame([(None, "a", 1), (1, None, None), (2, None, 1), (3, "b", 0)], "doc_id long, text string, toxic int")
    assert toxicity.score_documents(nulls, toxicity.train(nulls)).count() == 4


# packing


def test_cached_encoder_gives_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))  # as it is
    encode = public_encoder()()
    odd = st.sampled_from([*" \n\t\r.,'a1é|<>", "\xa0", "\x85", "\u2028", "\u2003", "\x1c", "<|endoftext|>", "<|endoftext", "  ", "don't"])

    @settings(max_examples=1000, deadline=None)
    @given(st.lists(st.one_of(odd, st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
    def same(text):
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids

    same()
    for text in ("a<|endoftext|>b", " B|> \xa0 \xa0\x85", "a ", " a", " ", "", "a  b", "x \n y", "a\u2028 b", " <|endoftext|> <|endoftext|>", "q\t p"):
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_of_all_documents_are_the_tokenizers():
    import pyarrow.parquet as pq
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    encode = public_encoder()()
    for text in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist():
        assert np.frombuffer(encode(text or ""), "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("start")).unionByName(
        spark.createDataFrame([(-1, None, 0), (-2, "", 0), (-3, "word " * 30_000, 0), (-4, "dup", 0), (-4, "dup", 0)], "doc_id long, text string, start int")
    )
    rows = packing.pack(docs.coalesce(3), public_encoder()).collect()
    encode = public_encoder()()
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_seq[r.sequence_id].append(r)
    texts = docs.where("doc_id <> -4").collect()
    assert set(of_doc) == {t.doc_id for t in texts} | {-4}
    for t in texts:
        ids = encode(t.text or "") + (1).to_bytes(4, "little")
        at = 0
        for r in sorted(of_doc[t.doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)]) and r.doc_tokens == len(ids) // 4
            at += r.length
        assert at == len(ids) // 4
    assert len(of_doc[-4]) >= 2
    used = padded = 0
    steps = defaultdict(lambda: defaultdict(int))
    for parts in of_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len({(r.tier, r.step_group) for r in parts}) == 1
        used += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
        steps[parts[0].step_group][parts[0].tier] += 1
    assert padded <= 3 * 2048 and padded < 0.02 * used
    assert packing.pack(docs.limit(0), public_encoder()).count() == 0


def test_packer_fills_windows_and_balances_steps():
    packer = packing.Packer((4, 8, 16), 0, 64)
    lengths = [random.Random(4).choice([1, 2, 3, 5, 7, 9, 11, 15, 16, 40]) for _ in range(300)]
    for i, n in enumerate(lengths):
        packer.add((i, bytes(4 * n), n), n)
    rows = list(packer.close_windows(last=True))
    size, tier, group = defaultdict(int), {}, {}
    for _, _, length, _, _, seq, _, t, g in rows:
        size[seq] += length
        tier[seq], group[seq] = t, g
    assert sum(size.values()) == sum(lengths)
    assert sum(size[s] < tier[s] for s in size) <= 1
    for t in (4, 8, 16):
        per = defaultdict(int)
        for s in size:
            if tier[s] == t:
                per[group[s]] += 1
        if per:
            assert max(per.values()) - min(per.get(g, 0) for g in set(group.values())) <= 1
    with pytest.raises(ValueError):
        packing.pack(None, None, tiers=(100, 200))


# chat formatting


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("\\#</turn>:a \n"), max_size=40))
def test_escape_is_reversible(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert "##" not in escaped and chat_format.END not in escaped


def test_turn_spans_of_other_templates():
    turns = [("system", "s"), ("user", "hello"), ("assistant", ""), ("user", "again"), ("assistant", "ok a b")]
    inst = lambda ts: "".join(f"[INST]{t}[/INST]" if r != "assistant" else f"<{t}|" for r, t in ts)
    got = [piece[a:b] for _, piece, a, b in chat_format.turn_spans(iter(turns), inst)]
    assert got == [t for _, t in turns]
    rewriting = (
        lambda ts: f"{len(ts)} turns:" + "".join(t for _, t in ts) if ts else "",
        lambda ts: "".join(f"<{i if i else ''}{t}>" for i, (_, t) in enumerate(ts[-4:])),
        lambda ts: "".join(f"<{len(t)}:{t}>" for _, t in ts),
        lambda ts: "".join(f"<{t.strip()}>" for _, t in ts[:-1]) + "".join(f"<{t}>!" for _, t in ts[-1:]),
        lambda ts: "<" * min(len(ts), 5) + "",
    )
    for template in rewriting:
        with pytest.raises(chat_format.RewritesHistory):
            list(chat_format.turn_spans(iter(turns), template))


def test_real_prefixes_are_rendered():
    turns = [(r, f"text {i}") for i, r in enumerate(["user", "assistant"] * 4)]
    for window in (4, 6, 7):
        with pytest.raises(chat_format.RewritesHistory):
            list(chat_format.turn_spans(iter(turns), lambda ts, w=window: "".join(f"<{t}>" for _, t in ts[-w:])))

    def strict(ts):
        assert ts[0][0] == "user"
        return "".join(f"{i}:<{t}>" for i, (_, t) in enumerate(ts))

    got = list(chat_format.turn_spans(iter(turns), strict))
    assert "".join(piece for _, piece, _, _ in got) == strict(turns) and [piece[a:b] for _, piece, a, b in got] == [t for _, t in turns]


def test_a_declared_context_does_not_hide_lost_history():
    turns = [(r, f"text {i}") for i, r in enumerate(["user", "assistant"] * 5)]
    with pytest.raises(chat_format.RewritesHistory):
        list(chat_format.turn_spans(iter(turns), lambda ts: "".join(f"<{t}>" for _, t in ts[-4:]), 2))
    for n in (9, 10):  # noticed at the end where the length has not doubled again
        with pytest.raises(chat_format.RewritesHistory):
            list(chat_format.turn_spans(iter(turns[:n]), lambda ts: "".join(f"<{t}>" for _, t in ts[-8:]), 2))
    steps = list(chat_format.turn_spans(iter(turns), chat_format.plain_template, 2))
    assert "".join(piece for _, piece, _, _ in steps) == chat_format.plain_template(turns)


def test_format_conversations(spark):
    rows = [(1, 1, "assistant", "b\\## </turn>"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "first"), (None, 5, "us:er", "x"), (3, 0, "assistant", "t"), (3, 0, "assistant", "t")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))
    got = {r.conv_id: r for r in chat_format.format_conversations(data).collect()}
    want = {1: [("user", "a"), ("assistant", "b\\## </turn>")], 2: [("assistant", "first"), ("", "")], None: [("us:er", "x")], 3: [("assistant", "t")] * 2}
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.text == chat_format.plain_template(turns) and r.formatted_chars == len(r.text) and not r.rewrites_history
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert "".join(chat_format.unescape(r.text[s.start : s.end]) for s in r.spans if s.loss) == loss
    flagged = chat_format.format_conversations(data, render=lambda ts: str(len(ts)) if ts else "").collect()
    assert all(r.rewrites_history and r.text is None and r.n_turns == len(want[r.conv_id]) for r in flagged)
    assert chat_format.format_conversations(data.limit(0)).count() == 0
    many = spark.range(3000).selectExpr("9L conv_id", "id turn", "'assistant' role", "'t' text")
    assert chat_format.format_conversations(many, keep_text=False).first().loss_chars == 3000


# quality


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b#|é\x85\xa0"), max_size=60))
def test_quality_statistics(text):
    assert quality_trees.statistics(text)[:5] == brute.quality_base(text)


def test_quality_statistics_of_odd_texts():
    assert quality_trees.statistics(None)[:5] == (0,) * 5
    assert quality_trees.statistics("a b c " * 50_000)[:5] == (150_000, 150_000, 0, 0, 150_000)


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7)).astype(float)
    free = quality_trees.grow(x, y, np.zeros(3, int))
    test = rng.random((2000, 3))
    assert (((test[:, 0] > 0.5) ^ (test[:, 1] > 0.7)) == (free.probability(test) > 0.5)).mean() > 0.95
    noisy = (rng.random(3000) < 0.2 + 0.6 * x[:, 0] * np.sin(9 * x[:, 0]) ** 2).astype(float)
    for sign in (1, -1):
        forest = quality_trees.grow(x, noisy, np.array([sign, 0, 0]))
        for base in test[:20]:
            line = np.repeat(base[None], 200, 0)
            line[:, 0] = np.linspace(0, 1, 200)
            assert (sign * np.diff(forest.margin(line)) >= -1e-12).all()
    # the flat arrays walk as a plain tree does
    node_of = lambda i, row: i if free.left[i] == i else node_of(free.left[i] if row[free.feature[i]] <= free.threshold[i] else free.right[i], row)
    for row in test[:50]:
        assert np.isclose(free.margin(row[None])[0], free.start + sum(free.value[node_of(r, row)] for r in free.roots))


def test_quality_judges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("n_words"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    forest = quality_trees.train(docs, labels.where("coalesce(doc_id, 0) % 4 <> 1"))
    more = docs.unionByName(spark.createDataFrame([(None, None, "x"), (-1, "", "x"), (-1, "", "x")], docs.schema))
    got = quality_trees.judge(more, forest)
    assert got.count() == more.count() and got.where("n_words = 0 and (kept or not base_failed)").count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [r for r in got.collect() if r.doc_id in texts]
    for r in rows[:150]:
        words, chars, symbols, dup, repeat = brute.quality_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, dup, repeat)
        assert r.base_failed == (words < 50 or 100 * repeat > 50 * words)
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 4 = 1 and quality is not null").collect()}
    judged = [(r.kept, held[r.doc_id]) for r in rows if r.doc_id in held and not r.base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.95
    nothing = quality_trees.train(docs.limit(0), labels.limit(0))
    assert quality_trees.judge(docs.limit(3), nothing).count() == 3


# personal data


@pytest.fixture(scope="module")
def private_texts():
    rng = random.Random(5)
    pieces = ["a.b@c.de", "a@b.c_d@e.f", "@x.y", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111", "+1 (386) 555-3733", "+1.2.3.4.5.6.7.8", "++49 30 12345678", "+12", "é😀", "\n", " ", "x", "7", "-", "%+-_@", "0-0 0", "+4 "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    return [None, "", "7" * 3000, "a" * 30_000, "1 " * 9000, "a@b." * 5000, "+" + "1 " * 5000 + "x", *texts]


def test_base_spans(spark, private_texts):
    rows = [(i, t, "clash") for i, t in enumerate(private_texts)]
    got = pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s.kind < 4]
        assert mine == brute.base_spans(private_texts[r.doc_id]), private_texts[r.doc_id]


def test_op8_counts_the_spans_of_each_kind(spark, private_texts, tmp_path):
    texts = [*private_texts, "a@b.co 1.2.3.4 5.6.7.8 x@y.de 4111 1111 1111 1111, +1 (386) 555-3733", "+1 (386) 555-3733"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute.base_spans(texts[r.doc_id])
        counts = [sum(kind == k for kind, _, _ in want) for k in ("email", "ip", "card", "phone")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_disclosing_terms(spark):
    rng = random.Random(2)
    words = ["alpha", "bravo", "delta", "echo", "golf", "hotel", "india", "kilo", "lima", "mike", "oscar", "papa", "romeo", "sierra"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{some(8)} Zorbling {some(1)} joe@ex.com {some(9)}.") for i in range(8)]
    copy = f"{some(8)} copyterm {some(1)} ann@ex.com {some(9)}"
    rows += [(20 + i, copy) for i in range(9)] + [(100 + i, some(20)) for i in range(200)] + [(None, "a@b.co x"), (900, None), (901, ""), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = [(r.doc_id, texts[r.doc_id][s.start : s.end]) for r in pii.with_spans(docs).collect() for s in r.spans if s.kind == 4]
    assert sorted(found) == [(i, "Zorbling") for i in range(8)]
    clean = pii.sanitise(docs).collect()
    assert len(clean) == len(rows)
    by_id = {r.doc_id: r.text for r in clean}
    assert by_id[900] is None and by_id[901] == "" and by_id[None] == "[EMAIL] x" and by_id[100] == texts[100]
    assert "Zorbling" not in by_id[0] and by_id[0] == texts[0].replace("Zorbling", "").replace("joe@ex.com", "[EMAIL]")
    assert pii.with_spans(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_disclosing_terms_go_wherever_they_stand(spark):
    rng = random.Random(4)
    words = ["alpha", "bravo", "delta", "echo", "golf", "hotel", "india", "kilo", "lima", "mike", "oscar", "papa", "romeo", "sierra"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{some(8)} Zorbling {some(1)} joe@ex.com {some(9)}. {some(30)} ZORBLING é😀 {some(9)}") for i in range(8)]
    rows += [(50 + i, f"{some(9)} Zorbling") for i in range(4)] + [(50, rows[0][1])] + [(None, "alone: zorbling")] * 2 + [(100 + i, some(20)) for i in range(400)]
    docs, texts = spark.createDataFrame(rows, "doc_id long, text string"), [t for _, t in rows]
    found = pii.with_spans(docs).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(set)
    for r in found:
        by_id[r.doc_id].add(tuple((s.start, s.end) for s in r.spans if s.kind == 4))
    want = defaultdict(set)
    for (i, _), t in zip(rows, texts, strict=True):
        want[i].add(tuple((at, at + 8) for at in range(len(t)) if t[at : at + 8].lower() == "zorbling"))
    assert by_id == want
    assert not any("zorbling" in r.text.lower() for r in pii.sanitise(docs).collect())


def test_contexts_are_cut_from_the_whole_text(spark, private_texts):
    cards = "Zorbling, born 1 2 1970 in 3, " + "4111 1111 1111 1111" + " x 7 x 8, Quorling 9 a@b.co"
    texts = [cards, "é1 " * 300 + cards + " a@b.co 1😀" * 200, *private_texts]
    for r in pii.base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        text = texts[r.doc_id]
        assert r.value == text[r.start : r.end] and (r.before, r.after) == (text[max(0, r.start - 400) : r.start], text[r.end : r.end + 400])


def test_pii_plan_is_native(spark):
    plan = pii.sanitise(spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# archives


def test_archive_round_trip(spark, tmp_path):
    big = "<p>" + "wörd " * 400
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "", None), (None, "n", big), (7, "é", "x" * 3_000_000), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1))
    folder = f"file://{tmp_path}/archives"
    files = warc.write_archives(pages, folder)
    listed = spark.createDataFrame([(r.path,) for r in files.collect()], "path string")
    got = warc.read_archives(listed, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        html = {1: big, 2: big, 3: "small", 4: "small", 5: "", None: big, 7: "x" * 3_000_000}[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        revisit = r.page_id in (1, None)
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (2 if revisit else None)
        assert r.payload is None if revisit else bytes(r.payload) == html
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%20b%0D%0A"}
    empty = warc.write_archives(pages.limit(0), folder)
    assert empty.count() == 0 and warc.read_archives(empty.select("path"), folder).count() == 0


def test_archive_faults_are_found():
    whole = warc.record_bytes(1, "u", b"payload" * 300, None) + warc.record_bytes(2, "u", b"", 1)
    assert [r[0] for r in warc.read_records(io.BytesIO(whole))] == [1, 2]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(whole[:-5])))
    member = zlib.decompress(warc.record_bytes(1, "u", b"payload", None), 31)
    for broken in (member.replace(b"payload", b"paXload"), member.replace(b"WARC/1.1", b"WARC/9.9"), member + b"x", member[:-2]):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(packer.compress(broken) + packer.flush())))


# URL rules


@pytest.mark.parametrize("ranges", [1, 7])
def test_url_rules(spark, ranges):
    rng = random.Random(9)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "EXAMPLE.org", "example.org:80", "", "a..b", "org.", "é.org"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12", "/a?q", "/a#f", "?x", "#"]
    urls = [f"{rng.choice(['http', 'x', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "://", "a://b://c/d", "http://example.org/" + "y" * 20_000] + ["http://example.org/es/same"] * 40
    rules = [(rng.choice(hosts), rng.choice(paths[:6]), rng.choice(["allow", "block"])) for _ in range(25)] + [("org", "/", "allow"), ("org", "/", "block"), ("org", "/", "allow")]
    given_rules = spark.createDataFrame([*rules, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(None, urls[0], 1)], "page_id long, url string, key int")
    got = url_rules.judge_urls(pages, given_rules, ranges).collect()
    lower = [(brute.upper_az_down(h), p, v) for h, p, v in rules]
    want = sorted([(i, *brute.judged(u, lower)) for i, u in enumerate([*urls])] + [(None, *brute.judged(urls[0], lower))], key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert url_rules.judge_urls(pages.limit(0), given_rules).count() == 0
    assert url_rules.judge_urls(pages, given_rules.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0


def test_many_rules_of_one_host(spark):
    """Nested and neighbouring paths of one host, a subdomain between them, repeated paths."""
    rng = random.Random(31)
    paths = ["/" + "".join(rng.choices("ab/", k=rng.randint(0, 6))) for _ in range(300)]
    rules = [(rng.choice(["x.org", "x.org", "s.x.org", "org"]), p, rng.choice(["allow", "block"])) for p in paths]
    urls = [f"http://{rng.choice(['x.org', 's.x.org', 't.s.x.org', 'y.org'])}/{''.join(rng.choices('ab/c', k=rng.randint(0, 8)))}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), 3).collect()
    assert sorted(map(tuple, got)) == sorted((i, *brute.judged(u, rules)) for i, u in enumerate(urls))


def test_a_url_does_not_visit_all_rules_of_its_host():
    host = url_rules._Host("org,x,")
    for i in range(100_000):
        host.add(f"/{i:06d}/", (i,))
    calls, plain = [], host._enclosing
    host._enclosing = lambda at, path: calls.append(at) or plain(at, path)
    assert host.longest("/073210/page") == (73_210,) and host.longest("/0732/page") is None and host.longest("/") is None
    assert len(calls) == 3 and max(host.around) == -1


def test_op10_judges_by_the_rules_of_its_contract(spark, tmp_path):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    urls = [f"http://{h}{p}" for h in ("org", "example.org", "a.example.org", "x.com", "net") for p in ("/", "/es/x", "/en/1", "/en/12?q", "/en/2", "/fr/", "/de/x")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op10_url_filters(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, *brute.judged(u, rules)) for i, u in enumerate(urls))
