"""Corpus vocabulary and token-id encoding.

The vocabulary is the top-``size`` words by corpus count (ties by word).  The
top-N is a ``TakeOrderedAndProject`` (per-partition top-N, then a merge of at
most N rows per partition), so no single task ever sees the whole word table.
Encoding joins the first ``max_length`` words of each row to the vocabulary (AQE
picks the join by its measured size) and gathers ids back in order.
(A map column is not used: Spark looks keys up in a map by linear scan.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAD_ID = 0
UNK_ID = 1
FIRST_ID = 2


def build_vocab(df: DataFrame, words: str = "words", size: int = 50000) -> DataFrame:
    """(token, token_id, n): ids FIRST_ID.. in order of count desc, token asc."""
    counts = (df.select(F.explode(words).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    # the window runs over <= size rows (bounded by the parameter)
    w = Window.orderBy(F.desc("n"), F.asc("token"))
    return top.withColumn("token_id", (F.row_number().over(w) - 1 + FIRST_ID).cast("int"))


def encode(df: DataFrame, vocab: DataFrame, key, words: str = "words", out: str = "input_ids",
           max_length: int = 512, keep_existing: bool = True) -> DataFrame:
    """Map words to ids (unknown -> UNK_ID), truncated to ``max_length``.

    Only the first ``max_length`` positions are exploded; they are joined to
    the vocabulary and gathered back per row in position order (a row's list
    is bounded by ``max_length``).  Rows that already carry ``out`` keep it
    (entries already tokenised)."""
    key = [key] if isinstance(key, str) else list(key)
    toks = (df.select(*key, F.posexplode(words).alias("_pos", "token"))
            .filter(F.col("_pos") < max_length))
    j = toks.join(vocab.select("token", "token_id"), "token", "left")
    ids = (j.groupBy(*key)
           .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("token_id", F.lit(UNK_ID))
                                                     .alias("_id")))).alias("_l"))
           .select(*key, F.transform("_l", lambda x: x["_id"]).alias("_ids")))
    res = df.join(ids, key, "left")
    enc = F.coalesce(F.col("_ids"), F.array().cast("array<int>"))
    if keep_existing and out in df.columns:
        enc = F.coalesce(F.col(out), enc)
    return res.withColumn(out, enc).drop("_ids")
