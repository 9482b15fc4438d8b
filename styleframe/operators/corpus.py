"""Corpus construction: removed-content filter, sentence split, HAVING filters,
user-level split, counts.

Work happens at the coarsest grain possible: the per-comment sentence filter
runs on an array column before any explode (no shuffle); the per-user HAVING is
a partial/final aggregate on one row per comment joined back with a semi join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from styleframe.functions import keyed
from styleframe.functions.text import (REMOVED_AUTHORS, REMOVED_BODIES, clean_texts,
                                       clean_word_count, clean_words, split_sentences)


def _cols(c) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


def drop_removed(df: DataFrame, text: str = "text", author: str | None = "author",
                 min_length: int = 10) -> DataFrame:
    """Drop removed bodies, non-person authors and texts shorter than min_length
    code points.  Cheap predicates only, so they run before any costly test."""
    return df.filter(usable(text, author, min_length))


def usable(text: str = "text", author: str | None = "author", min_length: int = 10) -> Column:
    """The condition of ``drop_removed``."""
    cond = ~F.col(text).isin(*REMOVED_BODIES) & (F.char_length(text) >= min_length)
    return cond if author is None else cond & ~F.col(author).isin(*REMOVED_AUTHORS)


def keep_languages(df: DataFrame, codes, text: str = "text", lang: str = "lang",
                   predictor=None) -> DataFrame:
    """Keep rows whose language is wanted.

    With ``predictor=None`` the language column is trusted.  Otherwise
    ``predictor`` is an iterator-of-Series ``pandas_udf`` (model loaded once
    per worker) applied to the newline-flattened text; cheap filters should be
    applied before this call so the model only sees survivors.
    """
    if predictor is None:
        return df.filter(F.col(lang).isin(*codes))
    from styleframe.functions.text import flatten_newlines
    pred = predictor(flatten_newlines(F.col(text)))
    return df.withColumn("_pred_lang", pred).filter(F.col("_pred_lang").isin(*codes)) \
        .drop("_pred_lang")


def kept_sentences(text) -> Column:
    """array<string> of cleaned sentences (split first, then clean each)."""
    return clean_texts(split_sentences(text))


def with_sentences(df: DataFrame, text: str = "text", min_words: int = 5,
                   out: str = "sentences") -> DataFrame:
    """Add the array of cleaned sentences with at least ``min_words`` words."""
    return df.withColumn(out, F.filter(kept_sentences(F.col(text)),
                                       lambda s: clean_word_count(s) >= min_words))


def require_sentences(df: DataFrame, n: int = 2, sentences: str = "sentences") -> DataFrame:
    """HAVING count(sentence) >= n per comment, evaluated on the array (no shuffle).

    A generator of one array or none: a filter would be pushed below the column and cut and clean each text twice."""
    kept = F.explode(F.filter(F.array(sentences), lambda s: F.size(s) >= n)).alias(sentences)
    return df.select(*[kept if c == sentences else F.col(c) for c in df.columns])


def require_comments(df: DataFrame, n: int = 2, user: Sequence[str] = ("lang", "source"),
                     comment: str = "doc_id", one_row_per_comment: bool = True, store: bool = False) -> DataFrame:
    """Keep users with at least ``n`` comments (HAVING + left-semi join).

    On a comment-level frame (one row per comment) the count is a plain
    partial/final hash aggregate, so a hot user costs one partial row per map
    task.  The semi join goes broadcast at runtime when the qualifying-user
    table is small (AQE), sort-merge with skew split otherwise.  ``store`` writes
    the qualifying users first: if they are few, the comments are not shuffled.
    """
    user = _cols(user)
    cnt = F.count(F.lit(1)) if one_row_per_comment else F.count_distinct(comment)
    ok = (df.select(*user, comment).groupBy(*user).agg(cnt.alias("_n"))
          .filter(F.col("_n") >= n).select(*user))
    if store:
        from styleframe.session import stored
        ok = stored(ok, "users")
    return df.join(ok, on=user, how="left_semi")


def explode_sentences(df: DataFrame, sentences: str = "sentences",
                      idx: str = "sent_idx", text: str = "sentence") -> DataFrame:
    """One row per kept sentence, with its position and its word array."""
    out = df.select(*[c for c in df.columns if c != sentences],
                    F.posexplode(sentences).alias(idx, text))
    return out.withColumn("words", clean_words(F.col(text)))


def to_comments(df: DataFrame, text: str = "text", user: Sequence[str] = ("lang", "source"),
                comment: str = "doc_id", min_words: int = 5, min_sentences: int = 2,
                min_comments: int | None = 2, materialize: bool = False) -> DataFrame:
    """One row per surviving comment with its array of kept sentences:
    split -> clean -> word filter -> per-comment HAVING -> per-user HAVING.

    The per-user HAVING reads the comment frame twice (count, then semi
    join).  ``materialize`` checkpoints the cleaned comment frame first (a
    reliable write to the shared folder), so the regex work runs once instead
    of once per branch.  ``min_comments=None`` skips the per-user HAVING (for
    callers that apply it on their own per-user aggregate)."""
    c = with_sentences(df.select(*_cols(user), comment, text), text, min_words)
    c = require_sentences(c.drop(text), min_sentences)
    if min_comments is None:
        return c
    if materialize:
        from styleframe.session import checkpoint
        c = checkpoint(c)
    return require_comments(c, min_comments, user, comment, store=materialize)


def to_sentences(df: DataFrame, text: str = "text", user: Sequence[str] = ("lang", "source"),
                 comment: str = "doc_id", min_words: int = 5, min_sentences: int = 2,
                 min_comments: int = 2) -> DataFrame:
    """``to_comments`` exploded to one row per sentence (sent_idx, sentence, words)."""
    return explode_sentences(to_comments(df, text, user, comment, min_words,
                                         min_sentences, min_comments))


SPLITS = ("test", "dev", "train", "pretrain")


def split_users(users: DataFrame, dialect: str = "lang", user: str = "source",
                test: int = 5, dev: int = 5, train: int = 200, seed: int = 42) -> DataFrame:
    """Per dialect, shuffle users by a keyed digest: first ``test`` go to test,
    the next ``dev`` to dev, the next ``train`` to train; pretrain is everyone
    after dev (so it contains train).  Returns (dialect, user, split), one row
    per (user, split).

    Only the first test+dev+train users per dialect need a rank, so the window
    carries ``row_number() <= k``, which Spark turns into a per-partition
    partial top-k before the shuffle: a dialect holding a third of all users
    still ships at most k rows per map task.  Everyone else is pretrain.
    """
    u = users.select(dialect, user).withColumn("_key", keyed.order_key(seed, dialect, user))
    k = test + dev + train
    w = Window.partitionBy(dialect).orderBy("_key", user)
    ranked = (u.withColumn("_rank", F.row_number().over(w))
              .filter(F.col("_rank") <= k).select(dialect, user, "_rank"))
    r = F.col("_rank")
    splits = (F.when(r.isNull(), F.array(F.lit("pretrain")))
              .when(r <= test, F.array(F.lit("test")))
              .when(r <= test + dev, F.array(F.lit("dev")))
              .otherwise(F.array(F.lit("train"), F.lit("pretrain"))))
    return (u.drop("_key").join(ranked, [dialect, user], "left")
            .select(dialect, user, F.explode(splits).alias("split")))


def per_user_counts(comments: DataFrame, dialect: str = "lang", user: str = "source",
                    sentences: str = "sentences") -> DataFrame:
    """comments and sentences per user from a comment-level frame (partial agg)."""
    return (comments.groupBy(dialect, user)
            .agg(F.count(F.lit(1)).alias("n_comments"),
                 F.sum(F.size(sentences)).cast("bigint").alias("n_sentences")))


def split_counts(comments: DataFrame, dialect: str = "lang", user: str = "source",
                 sentences: str = "sentences", min_comments: int | None = None,
                 **split_args) -> DataFrame:
    """users / comments / sentences per (dialect, split) from comment-level rows.

    The comment frame is reduced once to one row per user; the user split and
    the final join work on that small table (the same exchange is reused).
    With ``min_comments`` the per-user HAVING is applied here, on the per-user
    aggregate, so the comment frame (and its regex work) is read once.
    """
    per_user = per_user_counts(comments, dialect, user, sentences)
    if min_comments is not None:
        per_user = per_user.filter(F.col("n_comments") >= min_comments)
    splits = split_users(per_user.select(dialect, user), dialect, user, **split_args)
    return (per_user.join(splits, [dialect, user])
            .groupBy(dialect, "split")
            .agg(F.count(F.lit(1)).alias("n_users"),
                 F.sum("n_comments").alias("n_comments"),
                 F.sum("n_sentences").alias("n_sentences")))


def keep_ratio(df: DataFrame, kept: Column) -> DataFrame:
    """One row: total, kept and 100 * kept / max(total, 1)."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(kept).alias("kept")) \
        .withColumn("kept_pct", F.round(F.lit(100.0) * F.col("kept") /
                                        F.greatest(F.col("total"), F.lit(1)), 6))


def author_counts(df: DataFrame, author: str = "author", by: Sequence[str] = ()) -> DataFrame:
    """Comments per author (per input file when ``by`` is given), most first."""
    by = _cols(by)
    return (df.groupBy(*by, author).agg(F.count(F.lit(1)).alias("n_comments"))
            .orderBy(*by, F.desc("n_comments"), author))
