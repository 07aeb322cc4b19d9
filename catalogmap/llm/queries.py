"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmap.llm import bbit_minhash, chat_format, conversation_repair, decontaminate, line_align, max_sketch, packing, pii, quality_trees, simhash, toxicity, url_rules, warc
from catalogmap.llm.rows import map_rows
from catalogmap.plans.registry import Query, table
from catalogmap.session import scratch_dir

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn

    return add


def public_encoder():
    """The public byte-level BPE of 50,257 ids as byte_bpe_50k.json has it, its added tokens included."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return packing.byte_bpe_encoder(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, added)


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents; checked against brute force, as SQL has no XXH64 with a seed."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@query()
def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_encoder())


ADDED_CONVERSATION = "\\### Assistant: </turn> ok"


@query(
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), sized AS (
        SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '##', '#\#'), '</turn>', '<\/turn>')) AS text_chars,
            length(replace(replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:')) AS role_chars
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(text_chars + role_chars + 4 + 2 + 1 + 7 + 1) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """
)
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-7, 0, "user", ADDED_CONVERSATION), (-7, 1, "assistant", ADDED_CONVERSATION)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_format.format_conversations(given.unionByName(added), keep_text=False).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query(
    """
    WITH sized AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
    ), shared AS (
        SELECT payload_digest, max(page_id) AS kept FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN kept <> page_id THEN kept END AS refers_to
    FROM sized LEFT JOIN shared USING (payload_digest)
    """
)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages are written to the shared folder and read back."""
    folder = f"{scratch_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    listed = spark.createDataFrame([(r.path,) for r in files.collect()], "path string")
    return warc.read_archives(listed, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


@query(
    """
    WITH split AS (
        SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), urls AS (
        SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
    ), rules AS (
        SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'allow'),
            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(rule_host, rule_path, rule_verdict)
    ), fitting AS (
        SELECT page_id, max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := rule_verdict)) AS best
        FROM urls JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
    )
    SELECT urls.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
    FROM urls LEFT JOIN fitting ON urls.page_id = fitting.page_id
    """
)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def toxic_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents outside the held-out fold: (doc_id, text, toxic)."""
    return toxicity.labelled_documents(docs, labels.where(~held_out()))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; checked by accuracy on the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(toxic_labels(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents; statistics are checked by brute force."""
    docs = table(spark, sf_dir, "documents")
    forest = quality_trees.train(docs, table(spark, sf_dir, "labels"))
    return quality_trees.judge(docs, forest).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query()
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds; checked against brute force."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the blocks that they share with an earlier one; checked against brute force."""
    return line_align.delete_copied_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_deleted")


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents; checked against plain patterns in Python."""
    found = pii.with_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)

    def n_of(kind: int, name: str) -> Column:
        # one parameter only: a second one would be the span's index
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{name}")

    counts = [n_of(kind, name) for kind, name in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    f"""
    WITH words AS (
        SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents
    ), tf AS (SELECT d, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    size AS (SELECT d, count(*) AS n FROM words GROUP BY d),
    figures AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM tf, figures WHERE term IN (SELECT term FROM asked) GROUP BY term
    ), scores AS (
        SELECT item_id, doc_id, d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
        FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN size USING (d), figures GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 10
    """
)
def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    return max_sketch.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query(
    f"""
    WITH RECURSIVE texts AS (
        SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
    ), grams AS (
        SELECT DISTINCT d, array_to_string(words[i : i + 3], ' ') AS gram
        FROM (SELECT d, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM texts WHERE len(words) > 0)
    ), sizes AS (SELECT d, count(*) AS n FROM grams GROUP BY d),
    common AS (SELECT a.d AS a, b.d AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.d < b.d GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes x ON x.d = a JOIN sizes y ON y.d = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(d, o) AS (SELECT d, d FROM texts UNION SELECT reach.d, b FROM reach JOIN both_ways ON a = o),
    classes AS (SELECT reach.d, min(doc_id) AS component_id FROM reach JOIN texts ON texts.d = o GROUP BY reach.d)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
    FROM texts JOIN classes USING (d) LEFT JOIN sizes USING (d)
    """
)
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by their whole shingle sets."""
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` modulo 20; nulls are one space."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    marked = conversations.select("conv_id", "turn", *text, F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("fault")).where("fault <> 0")
    faulty = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    return marked.select("conv_id", "turn", role.alias("role"), faulty.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("col")


def repaired_digests(steps: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, repaired_sha256) of the edits of :func:`conversation_repair.repair`, read as a sorted stream."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            audit, cost, whole, between = [], 0, hashlib.sha256(), ""
            for _, _, _, edit, role, text, price in group:
                audit.append(edit)
                cost += price
                if role is not None:
                    whole.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                    between = "\n"
            yield conv_id, cost, "".join(audit), whole.hexdigest()

    order = ["conv_id", "place", "step"]
    ordered = steps.select(*order, "edit", "role", "text", "cost").repartition("conv_id").sortWithinPartitions(*order)
    return map_rows(ordered, run, "conv_id long, cost long, audit string, repaired_sha256 string")


CRC_TABLE = """crc(i, c, k) AS (SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i)
        UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8)"""


@query(
    rf"""
    WITH RECURSIVE {CRC_TABLE},
    keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
    ), hit AS (
        SELECT keyed.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS d FROM keyed, crc_table
    ), bad AS (
        SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
            CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM hit WHERE d <> 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text)) AS i FROM bad
    ), faulty AS (
        SELECT *, role[1] AS c, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
            WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE '' END AS f,
            coalesce(lag(role[1]) OVER w || role[1] NOT IN ('su', 'ua', 'au'), false) AS odd
        FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)
    ), counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
            count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n
        FROM faulty GROUP BY conv_id
    ), dp(conv_id, i, q0, qs, qu, qa) AS (
        SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}}, {{'c': 99999999, 'a': '', 'o': []::VARCHAR[]}},
            {{'c': 99999999, 'a': '', 'o': []::VARCHAR[]}}, {{'c': 99999999, 'a': '', 'o': []::VARCHAR[]}} FROM counts
        UNION ALL
        SELECT conv_id, i,
            {{'c': e0.c + 3, 'a': e0.a || 'D', 'o': e0.o}},
            least({{'c': es.c + 3, 'a': es.a || 'D', 'o': es.o}}, CASE WHEN keep AND c = 's' THEN {{'c': e0.c + more, 'a': e0.a || 'K', 'o': list_append(e0.o, said)}} ELSE far END),
            least({{'c': eu.c + 3, 'a': eu.a || 'D', 'o': eu.o}},
                CASE WHEN keep AND c = 'u' THEN {{'c': x.c + more, 'a': x.a || 'K', 'o': list_append(x.o, said)}} ELSE far END,
                CASE WHEN keep THEN {{'c': y.c + more + 2, 'a': y.a || 'R', 'o': list_append(y.o, 'user:' || text)}} ELSE far END),
            least({{'c': ea.c + 3, 'a': ea.a || 'D', 'o': ea.o}},
                CASE WHEN keep AND c = 'a' THEN {{'c': eu.c + more, 'a': eu.a || 'K', 'o': list_append(eu.o, said)}} ELSE far END,
                CASE WHEN keep THEN {{'c': eu.c + more + 2, 'a': eu.a || 'R', 'o': list_append(eu.o, 'assistant:' || text)}} ELSE far END)
        FROM (SELECT *, least(e0, es, ea) AS x, least(e0, es, ea) AS y FROM (
            SELECT *, least(qa, {{'c': eu.c + 2, 'a': eu.a || 'I', 'o': list_append(eu.o, 'assistant:')}}) AS ea FROM (
                SELECT dp.conv_id, faulty.i, q0 AS e0, qs AS es, qa, least(qu, {{'c': q0.c + 2, 'a': q0.a || 'I', 'o': list_append(q0.o, 'user:')}},
                    {{'c': qs.c + 2, 'a': qs.a || 'I', 'o': list_append(qs.o, 'user:')}}, {{'c': qa.c + 2, 'a': qa.a || 'I', 'o': list_append(qa.o, 'user:')}}) AS eu,
                    f NOT IN ('b', 'd') AS keep, faulty.c, CASE f WHEN 't' THEN 1 ELSE 0 END AS more, text, role || ':' || text AS said,
                    {{'c': 99999999, 'a': '', 'o': []::VARCHAR[]}} AS far
                FROM dp JOIN faulty ON faulty.conv_id IS NOT DISTINCT FROM dp.conv_id AND faulty.i = dp.i + 1)))
    ), closed AS (
        SELECT conv_id, least(q0, qa, {{'c': qu.c + 2, 'a': qu.a || 'I', 'o': list_append(qu.o, 'assistant:')}},
            {{'c': qs.c + 4, 'a': qs.a || 'II', 'o': list_append(list_append(qs.o, 'user:'), 'assistant:')}}) AS b
        FROM dp JOIN counts USING (conv_id) WHERE dp.i = counts.n
    )
    SELECT given.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) given LEFT JOIN counts USING (conv_id) LEFT JOIN closed USING (conv_id)
    """
)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after :func:`damaged`."""
    given = table(spark, sf_dir, "conversations")
    fixed = conversation_repair.repair(damaged(given))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal")
    faults = fixed.faults.select(F.col("conv_id").alias("_f"), *counts)
    digests = repaired_digests(fixed.steps).withColumnRenamed("conv_id", "_d")
    every = given.select("conv_id").distinct()
    every = every.join(faults, F.col("conv_id").eqNullSafe(F.col("_f")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    empty = hashlib.sha256().hexdigest()
    return every.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*counts, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
