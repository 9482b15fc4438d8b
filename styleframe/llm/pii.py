"""Personal data by patterns and information-theoretic sanitisation (operator 10, DataFrame functions only).

Base spans (email, ip, card, phone) come from patterns; each valid match is a
protected entity at three levels of generality: its value, its group (the
domain of an email, the first two parts of an ip, the first six digits of a
card, the first four of a phone), and its kind.  Values that stand in one or two
documents each have no support of their own, but their group or kind may.  A
term (a lower-cased word of ``LETTERS`` letters or more) that stands within
``CONTEXT`` words of an entity co-occurs with it at each level.  Over the whole
corpus, with the same thresholds at each level, with p(e) the share of documents that hold the entity and
p(e | t) the share of the documents with the term in which it stands beside e,
the term discloses the entity if

    PMI(e; t) = log2(p(e | t) / p(e))  >=  IC(e) / ALPHA,   IC(e) = -log2 p(e)

(full disclosure is PMI = IC; an entity in every document has no information to
disclose), and if it was seen beside e in at least
``SUPPORT`` different contexts, so that copies of one passage are no evidence.
Disclosing terms are spans of kind ``term`` wherever they occur: removed if
they disclose fully, else generalised to the shape of the word.

Scale: three narrow passes over the texts.  The first finds base spans and their
contexts; co-occurrence rows are at most 3 levels x 2 ``CONTEXT`` terms per entity
occurrence, never pairs of a document's terms, and are combined by (entity, term)
before each shuffle, so that a kind, which all its occurrences share, is no hot key.  The second counts documents of the terms that passed the
support test, combined before its shuffle; the third reads only documents that
hold a disclosing term on past its filter.  Term tables are broadcast up to
``BROADCAST_TERMS`` rows, and joined by shuffle beyond it.

Edge rows: a null text is empty and has no spans; repeated rows each return a
row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styleframe.session import checkpoint

CONTEXT, LETTERS, SUPPORT, ALPHA = 4, 4, 3, 1.1
BROADCAST_TERMS = 200_000
KINDS = ("email", "ip", "card", "phone")

#: The patterns of the four kinds, written so that no part is tried twice: a run is entered at its
#: first character or where the last match ended, and possessively.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: texts without this have no match
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
LETTER = r"A-Za-z\x{80}-\x{10FFFF}"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    back = F.reverse(_digits(m))

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _small_part(p: Column) -> Column:
    p = F.regexp_replace(p, "^0+", "")
    return (F.length(p) == 0) | ((F.length(p) <= 3) & (p.cast("int") <= 255))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small_part),
    "card": lambda m: F.when(F.length(_digits(m)).between(13, 19), _luhn(m)).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
SPAN = "struct<a:int,z:int,v:string,l:string,r:string>"


def _words_only(c: Column) -> Column:
    return F.regexp_replace(c, rf"[^{LETTER}]+", " ")


def spans_of(text: Column, pattern, valid=lambda m: F.lit(True), contexts: bool = True) -> Column:
    """Array of (a, z, v, l, r): start and end in code points, value, nearest words on the left and right.

    The pieces between matches and the matches are walked together once for each side.  A walk carries
    the last ``CONTEXT`` words it has passed, of pieces and matches alike, and a word that is cut off
    by a match may go on behind it: so a context is that of the whole text, whatever lies between."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    none, n = F.lit(None).cast("string"), CONTEXT + 1  # a space at the outer end counts as an empty word

    def step(acc, x):
        a = acc["at"] + F.length(x["p"])
        z = a + F.length(x["m"])
        left = F.substring_index(_words_only(F.concat(acc["near"], x["p"])), " ", -n) if contexts else F.lit("")
        found = F.struct(a.alias("a"), z.alias("z"), x["m"].alias("v"), (left if contexts else none).alias("l"), none.alias("r"))
        more = F.when(x["m"].isNotNull() & valid(x["m"]), F.concat(acc["s"], F.array(found).cast(f"array<{SPAN}>"))).otherwise(acc["s"])
        near = F.substring_index(_words_only(F.concat(left, F.coalesce(x["m"], F.lit("")))), " ", -n) if contexts else F.lit("")
        return F.struct(F.coalesce(z, acc["at"]).alias("at"), near.alias("near"), more.alias("s"))

    def back(acc, x):
        some = x["m"].isNotNull() & valid(x["m"])
        more = F.when(some, F.concat(acc["s"], F.array(acc["near"]))).otherwise(acc["s"])
        near = F.substring_index(_words_only(F.concat(x["p"], F.coalesce(x["m"], F.lit("")), acc["near"])), " ", n)
        return F.struct(near.alias("near"), more.alias("s"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("near"), F.array().cast(f"array<{SPAN}>").alias("s"))
    spans = F.aggregate(both, start, step, lambda acc: acc["s"])
    if not contexts:
        return spans
    start = F.struct(F.lit("").alias("near"), F.array().cast("array<string>").alias("s"))
    rights = F.aggregate(F.reverse(both), start, back, lambda acc: F.reverse(acc["s"]))
    return F.zip_with(spans, rights, lambda s, r: F.struct(s["a"].alias("a"), s["z"].alias("z"), s["v"].alias("v"), s["l"].alias("l"), r.alias("r")))


def base_spans(text: Column, kind: str) -> Column:
    some = text.contains("@") if kind == "email" else text.rlike(GUARDS[kind])
    return F.when(some, spans_of(text, PATTERNS[kind], VALID[kind])).otherwise(F.array().cast(f"array<{SPAN}>"))


def listed(kind: str, spans: Column) -> Column:
    """Array of kind:start:end."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["a"].cast("string"), s["z"].cast("string")))


def words_of(text: Column) -> Column:
    """Lower-cased words of at least ``LETTERS`` letters (ASCII letters and all non-ASCII characters)."""
    return F.filter(F.split(F.lower(text), rf"[^{LETTER}]+"), lambda w: F.length(w) >= LETTERS)


def find_base(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, nr, email, ip, card, phone): base spans of each row, checkpointed; th is a hash of the text, nr tells rows apart."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), t.alias("text"))
    return checkpoint(rows.select("id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("nr"), *[base_spans(F.col("text"), k).alias(k) for k in KINDS]))


#: the group of a value: what several values of a kind share
GROUPS = {
    "email": lambda v: F.substring_index(v, "@", -1),
    "ip": lambda v: F.substring_index(v, ".", 2),
    "card": lambda v: F.substring(v, 1, 6),
    "phone": lambda v: F.substring(v, 1, 4),
}


def levels(kind: str, match: Column) -> Column:
    """Names of an entity, from the value to the kind: kind:value, kind/group, kind."""
    value = _digits(match) if kind in ("card", "phone") else F.lower(match)
    return F.array(F.concat(F.lit(kind + ":"), value), F.concat(F.lit(kind + "/"), GROUPS[kind](value)), F.lit(kind))


def co_occurrences(base: DataFrame) -> DataFrame:
    """(nr, e, t, c): row, entity at each level, term beside it, and a hash of the context."""
    def entities(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(levels(kind, s["v"]).alias("e"), s["l"].alias("l"), s["r"].alias("r")))

    tagged = F.concat(*[entities(k) for k in KINDS])
    rows = base.select("nr", F.explode(tagged).alias("x")).select("nr", "x.*")
    word = F.lit(rf"[^{LETTER}]+")
    left = F.filter(F.split(F.lower("l"), word), lambda w: w != "")
    right = F.filter(F.split(F.lower("r"), word), lambda w: w != "")
    beside = F.concat(F.slice(F.reverse(left), 1, CONTEXT), F.slice(right, 1, CONTEXT))
    rows = rows.select("nr", "e", beside.alias("ws"))
    terms = F.filter(F.array_distinct("ws"), lambda w: F.length(w) >= LETTERS)
    rows = rows.select("nr", "e", F.xxhash64("ws").alias("c"), F.explode(terms).alias("t"))
    return rows.select("nr", F.explode("e").alias("e"), "t", "c")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def disclosing_terms(docs: DataFrame, base: DataFrame, text: str = "text") -> DataFrame:
    """(t, full): terms whose disclosure of some entity exceeds the threshold; full if it is complete.

    All counts are of rows, repeated ones included."""
    beside = co_occurrences(base)
    n_docs = F.lit(max(1, base.count()))
    seen = beside.groupBy("e", "t", "c").agg(F.count("*").alias("n")).groupBy("e", "t").agg(F.count("*").alias("contexts"))
    pairs = beside.select("nr", "e", "t").distinct().groupBy("e", "t").agg(F.count("*").alias("n_both"))
    entities = beside.select("nr", "e").distinct().groupBy("e").agg(F.log2(n_docs / F.count("*")).alias("ic"))
    # documents with the term are at least those in which it stands beside any entity, which bounds p(e | t)
    # from above: words that stand beside many entities cannot disclose one, and are not counted further
    least = beside.select("nr", "t").distinct().groupBy("t").agg(F.count("*").alias("n_least"))
    open_ = (seen.where(F.col("contexts") >= SUPPORT).join(pairs, ["e", "t"]).join(entities, "e").join(least, "t")
             .where(_discloses(F.col("n_both") / F.col("n_least"))).select("t", "n_both", "ic"))
    open_ = checkpoint(open_)
    terms = checkpoint(open_.select("t").distinct())
    n_terms = terms.count()
    if n_terms == 0:
        return terms.select("t", F.lit(False).alias("full"))
    words = docs.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("t"))
    if n_terms <= BROADCAST_TERMS:
        words = words.join(F.broadcast(terms), "t", "left_semi")
    counts = words.groupBy("t").agg(F.count("*").alias("n_t"))
    given = F.least(F.lit(1.0), F.col("n_both") / F.col("n_t"))
    return checkpoint(open_.join(counts, "t").where(_discloses(given)).groupBy("t").agg(F.max(given >= 1).alias("full")))


def _discloses(given: Column) -> Column:
    """PMI >= IC / ALPHA, for p(e | t) and the column ic."""
    return (F.col("ic") > 0) & (F.log2(given) + F.col("ic") >= F.col("ic") / ALPHA)


def term_pattern(terms: Column) -> Column:
    """Pattern of the given words (letters only) as whole words in any case."""
    return F.concat(F.lit(rf"(?iu)(?<![{LETTER}])(?:"), F.array_join(F.array_sort(terms), "|"), F.lit(rf")(?![{LETTER}])"))


def term_spans(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, terms, full, term): the disclosing terms of each text that holds some, those that disclose
    fully, and the spans; one row per (id, th)."""
    n = terms.count()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    words = F.explode(F.array_distinct(words_of(F.col("text")))).alias("t")
    found = [F.collect_set("t").alias("terms"), F.collect_set(F.when(F.col("full"), F.col("t"))).alias("full")]
    if n <= BROADCAST_TERMS:  # the text goes along: it is only copied for documents that hold a term
        rows = (rows.select("id", "th", "text", words).join(F.broadcast(terms), "t")
                .groupBy("id", "th").agg(*found, F.first("text").alias("text")))
    else:
        held = rows.select("id", "th", words).join(terms, "t").groupBy("id", "th").agg(*found)
        held = held.withColumnsRenamed({"id": "_id", "th": "_th"})
        rows = rows.dropDuplicates(["id", "th"]).join(held, rows["id"].eqNullSafe(held["_id"]) & (rows["th"] == held["_th"]))
    return rows.select("id", "th", "terms", "full", spans_of(F.col("text"), term_pattern(F.col("terms")), contexts=False).alias("term"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = find_base(docs, doc_id, text)
    terms = disclosing_terms(docs, base, text)
    marks = base.withColumn("own", F.concat(*[listed(k, F.col(k)) for k in KINDS]))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    digest = F.sha2(F.array_join("own", ",").cast("binary"), 256).alias("base_sha256")
    if not terms.take(1):
        return marks.select(F.col("id").alias("doc_id"), *counts, digest, F.array_join("own", ",").alias("spans"))
    extra = checkpoint(term_spans(docs, terms, doc_id, text).select(F.col("id").alias("_id"), F.col("th").alias("_th"), listed("term", F.col("term")).alias("more")))
    marks = marks.join(extra, marks["id"].eqNullSafe(extra["_id"]) & (marks["th"] == extra["_th"]), "left")
    spans = F.array_join(F.concat("own", F.coalesce("more", F.array().cast("array<string>"))), ",")
    return marks.select(F.col("id").alias("doc_id"), *counts, digest, spans.alias("spans"))


def _rebuilt(text: Column, pattern, valid, put) -> Column:
    """Text with ``put(match)`` for each valid match."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))
    return F.array_join(F.transform(both, lambda x: F.concat(x["p"], F.when(x["m"].isNull(), F.lit("")).when(valid(x["m"]), put(x["m"])).otherwise(x["m"]))), "")


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): texts with entities replaced by their kind, fully disclosing terms removed and
    other disclosing terms generalised ([Name] for a capital, else [word])."""
    base = find_base(docs, doc_id, text)
    terms = disclosing_terms(docs, base, text)
    held = term_spans(docs, terms, doc_id, text).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "terms", "full")
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = rows.join(held, rows["id"].eqNullSafe(held["_id"]) & (rows["th"] == held["_th"]), "left")
    shape = lambda m: F.when(F.array_contains("full", F.lower(m)), F.lit("")).when(m.rlike("^[A-Z]"), F.lit("[Name]")).otherwise(F.lit("[word]"))
    out = F.when(F.col("terms").isNull(), F.col("text")).otherwise(_rebuilt(F.col("text"), term_pattern(F.col("terms")), lambda m: F.lit(True), shape))
    rows = rows.select("id", out.alias("text"))
    for k in KINDS:
        put = functools.partial(lambda kind, m: F.lit(f"<{kind}>"), k.upper())
        clean = _rebuilt(F.col("text"), PATTERNS[k], VALID[k], put)
        rows = rows.select("id", F.when(F.col("text").rlike(GUARDS[k]), clean).otherwise(F.col("text")).alias("text"))
    return rows.select(F.col("id").alias("doc_id"), "text")
