"""Personal data: patterns, and terms that give a protected value away.

Everything runs as DataFrame expressions. ``split`` and ``regexp_extract_all`` with one pattern walk a text in
the same way, so the lengths of the stretches between matches give each match's place in code points.

Words near a protected value (an address or number found by the patterns) are counted with it over all
documents. The disclosure of a term is the share of its documents in which it stands beside that one
value; a term above the thresholds names the value even when the value itself is masked, so it is
generalised, or removed where it is all but certain, wherever it stands in any document. Contexts are told apart by min-hashes of their other
words, so that copies and near copies of a document are no evidence.

The quantifiers are possessive and a match may only begin where a run of its characters begins (or the last
match ended). That finds the same matches as the plain patterns in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogmap.llm.names import free_names
from catalogmap.session import cut, cut_counted

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = (EMAIL, IP, CARD, PHONE)
#: A text without these holds no match; a cheaper look than the pattern itself.
NEEDS = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", r"\+[0-9]")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
TERM = r"\p{L}{3,}"
#: Code points of text looked at on either side of a value.
REACH = 400
#: Min-hashes by which contexts are told apart.
SIGNS = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Doubles every second digit from the right; the sum must end in 0."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    return (
        F.when(kind == 1, value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
        .when(kind == 2, F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False))
        .when(kind == 3, n.between(8, 15))
        .otherwise(True)
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): a null text is empty; key tells texts of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))


def _reach(pieces: Column, back: bool) -> Column:
    """Up to REACH code points next to a match, from the pieces of text on one side, nearest first."""
    clipped = F.transform(pieces, lambda p: F.substring(p, -REACH, REACH) if back else F.substring(p, 1, REACH))

    def add(text: Column, p: Column) -> Column:
        return F.when(F.length(text) >= REACH, text).otherwise(F.concat(p, text) if back else F.concat(text, p))

    joined = F.aggregate(clipped, F.lit(""), add)
    return F.substring(joined, -REACH, REACH) if back else F.substring(joined, 1, REACH)


def _matches(keyed: DataFrame) -> DataFrame:
    """(doc_id, key, kind, nth, gap, value, valid, before, after) per match of a pattern; contexts of valid ones."""
    def walk(kind: int) -> Column:
        between, found = F.split("text", PATTERNS[kind], -1), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        holds = F.col("text").contains("@") if kind == 0 else F.col("text").rlike(NEEDS[kind])
        return F.when(holds, F.struct(F.lit(kind).alias("kind"), between.alias("between"), found.alias("found")))

    walked = keyed.select("doc_id", "key", F.explode(F.array(*map(walk, range(4)))).alias("w")).where("size(w.found) > 0")

    def side(i: Column, back: bool) -> Column:
        # a match and the stretch beside it have two code points at least, so that many pairs reach far enough
        pairs = F.least(F.lit(REACH), i if back else F.size("w.found") - 1 - i)
        places = F.when(pairs > 0, F.sequence(F.lit(1), pairs)).otherwise(F.array().cast("array<int>"))
        nearest = F.array(F.get("w.between", i if back else i + 1))
        more = F.transform(places, lambda k: F.concat(F.get("w.between", i - k), F.get("w.found", i - k)) if back else F.concat(F.get("w.found", i + k), F.get("w.between", i + k + 1)))
        return _reach(F.concat(nearest, more), back)

    def one(value: Column, i: Column) -> Column:
        valid = _valid(F.col("w.kind"), value)
        return F.struct(
            F.length(F.get("w.between", i)).alias("gap"), value.alias("value"), valid.alias("valid"),
            F.when(valid, side(i, True)).alias("before"), F.when(valid, side(i, False)).alias("after"),
        )

    each = walked.select("doc_id", "key", "w.kind", F.posexplode(F.transform("w.found", one)).alias("nth", "m"))
    return each.select("doc_id", "key", "kind", "nth", "m.*")


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, kind, start, end, value, before, after): valid matches, ends exclusive, in code points.

    kind is the number in KINDS. Rows that repeat doc_id and text are one document.
    """
    matches = _matches(_keyed(docs)).dropDuplicates(["doc_id", "key", "kind", "nth"])
    upto = "OVER (PARTITION BY doc_id, key, kind ORDER BY nth)"
    placed = matches.withColumn("end", F.expr(f"sum(gap + length(value)) {upto}")).withColumn("start", F.col("end") - F.length("value"))
    return placed.where("valid").select("doc_id", "key", "kind", "start", "end", "value", "before", "after")


def _words(context: Column, offset: Column, last: bool, width: int) -> Column:
    """(term, start, end) of up to ``width`` words at the near end of a context."""
    between, found = F.split(context, TERM, -1), F.regexp_extract_all(context, F.lit(TERM), F.lit(0))

    def length_of(parts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda total, p: total + F.length(p))

    def one(word: Column, i: Column) -> Column:
        start = offset + length_of(between, i + 1) + length_of(found, i)
        return F.struct(F.lower(word).alias("term"), start.alias("start"), (start + F.length(word)).alias("end"))

    every = F.transform(found, one)
    n = F.size(every)
    return F.slice(every, F.greatest(F.lit(1), n - width + 1), F.lit(width)) if last else F.slice(every, 1, width)


def context_terms(spans: DataFrame, width: int = 6) -> DataFrame:
    """(doc_id, key, kind, entity, term, start, end, s0, s1, s2): words beside protected values.

    s0 to s2 are min-hashes of the context's other words.
    """
    before = _words(F.col("before"), F.col("start") - F.length("before"), True, width)
    after = _words(F.col("after"), F.col("end"), False, width)
    entity = F.when(F.col("kind") == 0, F.lower("value")).when(F.col("kind") == 1, F.col("value")).otherwise(_digits(F.col("value")))
    near = spans.select("doc_id", "key", "kind", entity.alias("entity"), F.concat(before, after).alias("terms"))
    each = near.select("doc_id", "key", "kind", "entity", "terms", F.explode("terms").alias("t"))
    others = F.filter("terms", lambda o: o["term"] != F.col("t.term"))
    signs = [F.array_min(F.transform(others, lambda o, k=k: F.xxhash64(o["term"], F.lit(k)))).alias(f"s{k}") for k in range(SIGNS)]
    return each.select("doc_id", "key", "kind", "entity", "t.*", *signs)


def disclosing_terms(docs: DataFrame, near: DataFrame, least_contexts: int = 3, least_share: float = 0.5, least_bits: float = 4.0) -> DataFrame:
    """(kind, entity, term, disclosure): terms that reveal a value, from counts over all documents.

    disclosure is the share of the term's documents in which it stands beside the value. A term also needs
    ``least_contexts`` different contexts (by each of the min-hashes) and must raise the value's probability by ``least_bits`` bits.
    """
    distinct = [F.countDistinct(f"s{k}").alias(f"s{k}") for k in range(SIGNS)]
    together = near.groupBy("kind", "entity", "term").agg(*distinct, F.countDistinct("doc_id", "key").alias("both"))
    together = together.where(F.least(*(F.col(f"s{k}") for k in range(SIGNS))) >= least_contexts).select("kind", "entity", "term", "both")
    values = near.groupBy("kind", "entity").agg(F.countDistinct("doc_id", "key").alias("of_value"))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TERM), F.lit(0)), F.lower))
    everywhere = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    total = docs.agg(F.count(F.lit(1)).alias("documents"))
    joined = together.join(everywhere, "term").join(values, ["kind", "entity"]).join(F.broadcast(total))  # one row
    disclosure = F.least(F.lit(1.0), F.col("both") / F.col("of_term"))
    bits = F.log2(disclosure * F.col("documents") / F.col("of_value"))
    return joined.withColumn("disclosure", disclosure).where((F.col("disclosure") >= least_share) & (bits >= least_bits)).select("kind", "entity", "term", "disclosure")


def term_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, key, start, end, disclosure): every occurrence of ``terms`` (term, disclosure) in any document."""
    keyed, word = _keyed(docs), F.lit(TERM)
    held = keyed.select("doc_id", "key", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", word, F.lit(0)), F.lower))).alias("term"))
    holders = held.join(terms, "term").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    walked = keyed.join(holders, same, "left_semi").select("doc_id", "key", F.split("text", TERM, -1).alias("between"), F.regexp_extract_all("text", word, F.lit(0)).alias("found"))

    def one(value: Column, i: Column) -> Column:
        return F.struct(F.length(F.get("between", i)).alias("gap"), F.length(value).alias("n"), F.lower(value).alias("term"))

    each = walked.select("doc_id", "key", F.posexplode(F.transform("found", one)).alias("nth", "m")).select("doc_id", "key", "nth", "m.*")
    upto = "OVER (PARTITION BY doc_id, key ORDER BY nth)"
    placed = each.dropDuplicates(["doc_id", "key", "nth"]).withColumn("end", F.expr(f"sum(gap + n) {upto}")).withColumn("start", F.col("end") - F.col("n"))
    return placed.join(terms, "term").select("doc_id", "key", "start", "end", "disclosure")


def find_spans(docs: DataFrame, remove_share: float = 0.9, **thresholds) -> DataFrame:
    """(doc_id, key, spans) per document with any span; spans are (kind, start, end, disclosure, action).

    kind is the number in KINDS. Pattern spans are masked; a term is marked in every document, with its value or
    without, and is ``generalised``, from ``remove_share`` on
    ``removed``. A term never overlaps a pattern span. ``docs`` has doc_id and text; a null text is empty.
    """
    base = cut(base_spans(docs))
    near = cut(context_terms(base))
    terms, count = cut_counted(disclosing_terms(docs, near, **thresholds).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    shown = near.join(terms, "term").select("doc_id", "key", "start", "end", "disclosure")
    if count:
        shown = shown.unionByName(term_places(docs, terms))
    added = shown.groupBy("doc_id", "key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    span = lambda kind, disclosure, action: F.struct(kind.alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), disclosure.cast("double").alias("disclosure"), action.alias("action"))
    action = F.when(F.col("disclosure") >= remove_share, F.lit("removed")).otherwise(F.lit("generalised"))
    both = base.select("doc_id", "key", span(F.col("kind"), F.lit(None), F.lit("masked")).alias("span")).unionByName(
        added.select("doc_id", "key", span(F.lit(4), F.col("disclosure"), action).alias("span"))
    )
    grouped = both.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("span")).alias("every"))
    base_only, terms = F.filter("every", lambda s: s["kind"] < 4), F.filter("every", lambda s: s["kind"] == 4)
    apart = F.filter(terms, lambda t: ~F.exists(F.filter("every", lambda s: s["kind"] < 4), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return grouped.select("doc_id", "key", F.concat(base_only, apart).alias("spans"))


def with_spans(docs: DataFrame, **thresholds) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``; documents without any have an empty list."""
    found = find_spans(docs, **thresholds).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    rows = _keyed(docs).select("doc_id", "key")
    met = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["key"] == found["_key"]), "left")
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,disclosure:double,action:string>>")
    return met.select("doc_id", F.coalesce("spans", empty).alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in the order of the array."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with the spans replaced in ``text``: pattern spans by ``[EMAIL]`` and so on, generalised terms by
    ``[TERM]``, removed ones by nothing. A span that begins inside an earlier one is joined to it.

    All rows and columns stay; a null text stays null.
    """
    own_id, own_key, own_spans = free_names(docs, "span_id", "span_key", "spans")
    found = find_spans(docs, **thresholds).withColumnsRenamed({"doc_id": own_id, "key": own_key, "spans": own_spans})
    text = F.coalesce("text", F.lit(""))
    met = docs.join(found, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_key)), "left")
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def write(done: Column, s: Column) -> Column:
        tag = F.when(s["action"] == "removed", F.lit("")).otherwise(F.get(tags, s["kind"]))
        fresh = F.array(F.concat(F.substr("text", done["at"] + 1, s["start"] - done["at"]), tag))
        parts = F.when(s["start"] >= done["at"], F.concat(done["parts"], fresh)).otherwise(done["parts"])
        return F.struct(parts.alias("parts"), F.greatest(done["at"], s["end"]).alias("at"))

    by_start = F.array_sort(own_spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(by_start, start, write, lambda d: F.concat(F.array_join(d["parts"], ""), F.substr("text", d["at"] + 1, F.length("text").cast("long"))))
    return met.select(*[F.when(F.col(own_spans).isNotNull(), done).otherwise(F.col("text")).alias("text") if c == "text" else docs[c] for c in docs.columns])
