"""Instruction-build queries: aligned corpora, bitext prompts, dialect
normalisation, answer guards, conversation pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from styleframe.functions import keyed
from styleframe.functions.text import ARABIC_RANGES, WS
from styleframe.operators import hierarchy, instruct
from styleframe.plans import sqlx
from styleframe.plans.registry import register
from styleframe.sources.tables import table

C = F.col
SEED = 42


def aligned(spark, sf):
    """en documents (by doc_id) paired by line number with de, else fr."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    d = hierarchy.line_numbers(d, ["lang"], ["doc_id"])
    tgt = d.filter(C("lang") == "en").select("doc_id", "line_no", "text")
    pref = d.filter(C("lang") == "de").select("line_no", "text")
    fb = d.filter(C("lang") == "fr").select("line_no", "text")
    return instruct.align_by_position(tgt, pref, "line_no", fallback=fb)


ALIGN_SQL = """
ln AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS line_no
       FROM documents),
al AS (SELECT t.doc_id, t.line_no, t.text,
              coalesce(nullif(p.text, ''), nullif(f.text, ''), '') AS english
       FROM (SELECT * FROM ln WHERE lang = 'en') t
       LEFT JOIN (SELECT * FROM ln WHERE lang = 'de') p USING (line_no)
       LEFT JOIN (SELECT * FROM ln WHERE lang = 'fr') f USING (line_no))"""


# -- O-13 / O-48 ------------------------------------------------------------------
@register("aligned_corpora", ops=("O-13", "O-48"), sql=f"""
WITH {ALIGN_SQL}
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, md5(english) AS english_md5 FROM al
""")
def aligned_corpora(spark, sf):
    return aligned(spark, sf).select("doc_id", "line_no", F.md5("english").alias("english_md5"))


# -- O-27 / O-28 / O-45 ---------------------------------------------------------------
def _prefix_sql():
    en = "[" + ", ".join("'" + p + "'" for p in instruct.BITEXT_PREFIXES_EN_TO_DA) + "]"
    msa = "[" + ", ".join("'" + p + "'" for p in instruct.BITEXT_PREFIXES_MSA_TO_DA) + "]"
    u = keyed.sql_uniform(SEED, "doc_id")
    arabic = (f"length(regexp_replace(english, '[^{ARABIC_RANGES}]', '', 'g')) / "
              f"greatest(length(regexp_replace(english, '[^\\p{{L}}]', '', 'g')), 1) > 0.5")
    return (f"CASE WHEN {arabic} THEN {msa}[CAST(floor({u} * 3) AS INTEGER) + 1] "
            f"ELSE {en}[CAST(floor({u} * 5) AS INTEGER) + 1] END")


@register("bitext_prompts", ops=("O-27", "O-28", "O-45"), sql=f"""
WITH {ALIGN_SQL}
SELECT doc_id, md5({_prefix_sql()} || english) AS prompt_md5, md5(text) AS ground_truth_md5,
       'en' AS dialect, 'aligned' AS source
FROM al WHERE english <> ''
""")
def bitext_prompts(spark, sf):
    a = aligned(spark, sf)
    s = a.select("doc_id", "text", F.lit("en").alias("dialect"), F.lit("aligned").alias("source"),
                 F.when(C("english") != "", "bitext").otherwise("monolingual").alias("type"),
                 F.when(C("english") != "", C("english")).alias("english"))
    b = instruct.bitext_prompts(s, seed=SEED, key=("doc_id",))
    return b.select("doc_id", F.md5(C("prompt")[0]["content"]).alias("prompt_md5"),
                    F.md5("ground_truth").alias("ground_truth_md5"), "dialect", "source")


# -- O-37 / O-47 --------------------------------------------------------------------------
def _raw_label():
    return (F.when(C("lang") == "en", F.lit("Cairo")).when(C("lang") == "fr", F.lit("MOROCCO"))
            .when(C("lang") == "de", F.lit("syria")).otherwise(F.lit("Atlantis")))


_MAP_VALUES = ", ".join("('" + k.replace("'", "''") + "', '" + v + "')"
                        for k, v in instruct.DIALECT_TO_COUNTRY.items())
_NAME_VALUES = ", ".join("('" + k + "', '" + v + "')" for k, v in instruct.COUNTRY_TO_DIALECT_NAME.items())


@register("dialect_lookup", ops=("O-37", "O-47"), sql=f"""
WITH m(key, code) AS (VALUES {_MAP_VALUES}),
nm(code, name) AS (VALUES {_NAME_VALUES}),
d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'Cairo' WHEN 'fr' THEN 'MOROCCO' WHEN 'de' THEN 'syria'
                             ELSE 'Atlantis' END AS raw FROM documents),
r AS (SELECT d.doc_id, d.raw,
             coalesce(m1.code, m2.code, d.raw) AS code_exact,
             coalesce(m3.code, 'unknown') AS code_lower
      FROM d LEFT JOIN m m1 ON m1.key = d.raw LEFT JOIN m m2 ON m2.key = lower(d.raw)
             LEFT JOIN m m3 ON m3.key = lower(d.raw))
SELECT doc_id, raw, code_exact, code_lower,
       coalesce(nm.name, 'Arabic dialect (' || code_exact || ')') AS display_name
FROM r LEFT JOIN nm ON nm.code = r.code_exact
""")
def dialect_lookup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _raw_label().alias("raw"))
    m = instruct.mapping_table(spark)
    a = instruct.normalise_dialect(d, "raw", m, out="code_exact", fallback="raw")
    b = instruct.normalise_dialect(a, "raw", m, out="code_lower", fallback="unknown", lower_first=True)
    return b.select("doc_id", "raw", "code_exact", "code_lower",
                    instruct.display_name(C("code_exact")).alias("display_name"))


# -- O-29 / O-33 ------------------------------------------------------------------------------
def _pairs(spark, sf):
    return instruct.pair_turns(table(spark, sf, "conversations"))


PAIRS_SQL = """
c AS (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
p AS (SELECT conv_id, turn, text AS q, nt AS a FROM c WHERE role = 'user' AND nr = 'assistant')"""


@register("conversation_pairs", ops=("O-33",), sql=f"""
WITH {PAIRS_SQL}
SELECT conv_id, turn, md5(q) AS prompt_md5, md5(a) AS answer_md5, 2 AS n_messages FROM p
""")
def conversation_pairs(spark, sf):
    m = instruct.to_messages(_pairs(spark, sf))
    return m.select("conv_id", "turn", F.md5(C("prompt")[0]["content"]).alias("prompt_md5"),
                    F.md5("ground_truth").alias("answer_md5"), F.size("messages").alias("n_messages"))


def _strip_sql(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


@register("answer_guard", ops=("O-29",), sql=f"""
WITH {PAIRS_SQL},
g AS (SELECT conv_id, turn, q AS fallback,
             CASE WHEN turn % 3 = 0 THEN '"' || q || '"' WHEN turn % 5 = 0 THEN substr(q, 1, 4)
                  WHEN turn % 7 = 0 THEN '''' || q || '''' ELSE q END AS ins,
             CASE WHEN turn % 2 = 0 THEN substr(a, 1, 15) ELSE a END AS ans FROM p),
s AS (SELECT *, {_strip_sql('ins')} AS i1, {_strip_sql('ans')} AS a1 FROM g),
k AS (SELECT *, CASE WHEN starts_with(i1, '"') AND ends_with(i1, '"') THEN substr(i1, 2, length(i1) - 2)
                     ELSE i1 END AS i2 FROM s WHERE length(i1) >= 5),
k2 AS (SELECT *, CASE WHEN starts_with(i2, '''') AND ends_with(i2, '''') THEN substr(i2, 2, length(i2) - 2)
                      ELSE i2 END AS i3 FROM k)
SELECT conv_id, turn, md5(i3) AS instruction_md5,
       md5(CASE WHEN length(a1) < 20 THEN fallback ELSE a1 END) AS answer_md5
FROM k2
""")
def answer_guard(spark, sf):
    p = _pairs(spark, sf).select("conv_id", "turn", C("prompt")[0]["content"].alias("q"),
                                 C("ground_truth").alias("a"))
    t = C("turn")
    g = p.select("conv_id", "turn", C("q").alias("fallback"),
                 F.when(t % 3 == 0, F.concat(F.lit('"'), "q", F.lit('"')))
                 .when(t % 5 == 0, F.substring("q", 1, 4))
                 .when(t % 7 == 0, F.concat(F.lit("'"), "q", F.lit("'"))).otherwise(C("q")).alias("ins"),
                 F.when(t % 2 == 0, F.substring("a", 1, 15)).otherwise(C("a")).alias("ans"))
    r = instruct.guard_answer(g, "ins", "ans", "fallback")
    return r.select("conv_id", "turn", F.md5("ins").alias("instruction_md5"),
                    F.md5("ans").alias("answer_md5"))


__all__ = ["sqlx"]
