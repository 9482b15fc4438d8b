"""DuckDB SQL fragments for the oracles (independent of the Spark code path).

They reuse the same fixed regex classes, which both Java and RE2 read alike.
"""

from __future__ import annotations

from styleframe.functions.text import NOT_WS, SENTENCE_BOUNDARY, WORD, WS


def clean(x: str) -> str:
    t = f"regexp_replace({x}, 'http{NOT_WS}+', 'URL', 'g')"
    t = f"regexp_replace({t}, '&{WORD}+;?', '', 'g')"
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    return f"regexp_replace({t}, '^ | $', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def split_sentences(x: str) -> str:
    return f"regexp_split_to_array({x}, '{SENTENCE_BOUNDARY}')"


def kept_sentences(x: str, min_words: int = 5) -> str:
    return (f"list_filter(list_transform({split_sentences(x)}, lambda s: {clean('s')}), "
            f"lambda s: len({words('s')}) >= {min_words})")


def digest(seed, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"md5(concat_ws('|', {parts}))"


def sentences_cte(min_words: int = 5, min_sentences: int = 2, min_comments: int = 2) -> str:
    """CTEs c (comment rows with kept sentences) and sent (one row per sentence)."""
    return f"""
c0 AS (
  SELECT lang, source, doc_id, {kept_sentences('text', min_words)} AS sents
  FROM documents WHERE text NOT IN ('[deleted]', '[removed]') AND source <> '[deleted]'
),
c1 AS (SELECT * FROM c0 WHERE len(sents) >= {min_sentences}),
ok_users AS (
  SELECT lang, source FROM c1 GROUP BY lang, source
  HAVING count(DISTINCT doc_id) >= {min_comments}
),
c AS (SELECT c1.* FROM c1 SEMI JOIN ok_users USING (lang, source)),
sent AS (
  SELECT lang, source, doc_id, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx,
         unnest(sents) AS sentence
  FROM c
)"""


def user_splits_cte(test: int, dev: int, train: int, seed: int = 42) -> str:
    """CTE splits(lang, source, split) over the users in ok_users."""
    return f"""
ranked AS (
  SELECT lang, source, row_number() OVER (PARTITION BY lang
         ORDER BY {digest(seed, 'lang', 'source')}, source) AS rk
  FROM ok_users
),
splits AS (
  SELECT lang, source, unnest(CASE WHEN rk <= {test} THEN ['test']
                                   WHEN rk <= {test + dev} THEN ['dev']
                                   WHEN rk <= {test + dev + train} THEN ['train', 'pretrain']
                                   ELSE ['pretrain'] END) AS split
  FROM ranked
)"""


# --- vectors (sequential left folds, the same order Spark's aggregate uses) --
def vdot(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), "
            f"lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)), lambda x, y: x + y, 0.0)")


def vnorm(a: str) -> str:
    return f"sqrt({vdot(a, a)})"


def vunit(a: str) -> str:
    return (f"list_transform({a}, lambda x: CAST(x AS DOUBLE) / greatest({vnorm(a)}, 1e-12))")


def vsum(a: str) -> str:
    return f"list_reduce(list_transform({a}, lambda x: CAST(x AS DOUBLE)), lambda x, y: x + y, 0.0)"
