"""Lexical model: character n-grams inside words, capped vocabulary,
sublinear TF-IDF with L2 rows, logistic regression.

Corpus totals of n-grams come from corpus totals of words, so each distinct word
is cut once; the vocabulary is a top-N of them.  Texts are dealt by document once;
the n-grams that the vocabulary knows are then counted where the document lies,
one row a document, from a bounded table of the words' n-grams.  Rows of one
(document, n-gram) are the form for vocabularies too large to be broadcast.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.ipc  # noqa: F401
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from styleframe.functions.text import WS_LITERAL
from styleframe.session import checkpoint, stored

C = F.col
#: vocabularies up to this many terms (a parameter of the fit) are broadcast
BROADCAST_TERMS = 1_000_000
#: numbers in one batch of documents; characters looked at together, so that the arrays stay in a core's cache
BATCH, PIECE = 1_000_000, 1 << 17
#: n-grams whose totals a task holds
TOTALS = 4_000_000
#: places of a plain table of trie steps (64 MB)
TABLE = 1 << 24


def _blank(text: str) -> F.Column:
    """The lower-cased text, all whitespace as blanks."""
    return F.translate(F.lower(C(text)), WS_LITERAL, " " * len(WS_LITERAL))


def word_counts(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, word, cnt) with lower-cased whitespace words (whitespace mapped to
    blanks by a char map, then a plain split)."""
    w = F.filter(F.split(_blank(text), " ", -1), lambda x: x != F.lit(""))
    return (df.select(doc, F.explode(w).alias("word"))
            .groupBy(doc, "word").agg(F.count(F.lit(1)).alias("cnt")))


def _grams(word: F.Column, lo: int, hi: int) -> F.Column:
    """Every substring of length lo..min(hi, len) of the blank-padded word."""
    pw = F.concat(F.lit(" "), word, F.lit(" "))
    L = F.char_length(pw)
    return F.flatten(F.transform(
        F.sequence(F.lit(lo), F.least(F.lit(hi), L)),
        lambda n: F.transform(F.sequence(F.lit(1), L - n + 1), lambda o: F.substring(pw, o, n))))


def _total_task(batches, lo: int, hi: int):
    """(word, count) -> (term, n) of every substring of lo..hi characters of the blank-padded words.

    A substring is one whole number of ``63 // hi`` bits a character; words with characters that no number
    is left for (or with U+0000, which arrays of text lose) are cut as text."""
    bits = 63 // hi
    number, known = np.zeros(0x110000, np.int64), np.zeros(1, np.uint32)
    held, size = [], 0

    def batch(keys, counts):
        letters = known[(keys[:, None] >> np.arange(hi) * bits) & (1 << bits) - 1]
        terms = np.ascontiguousarray(letters, np.uint32).view(f"<U{hi}").ravel()
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(counts)], names=["term", "n"])

    for b in batches:
        words, cnt = b.column(0).to_pylist(), b.column(1).to_numpy()
        code = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32)
        new = np.unique(code[number[code] == 0])
        new = new[new > 0][:(1 << bits) - len(known)]
        number[new] = np.arange(len(known), len(known) + len(new))
        known = np.concatenate([known, new])
        character = number[code]
        length = np.fromiter(map(len, words), np.int64, len(words)) + 2
        end = np.cumsum(length)
        plain = np.minimum.reduceat(character, end - length) > 0 if len(words) else np.zeros(0, bool)
        cut = {}
        for i in np.flatnonzero(~plain):
            padded = f" {words[i]} "
            for n in range(lo, min(hi, len(padded)) + 1):
                for o in range(len(padded) - n + 1):
                    cut[padded[o:o + n]] = cut.get(padded[o:o + n], 0) + int(cnt[i])
        if cut:
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), pa.array(list(cut.values()), pa.int64())], names=["term", "n"])
        place = np.flatnonzero(np.repeat(plain, length))
        left, counts, key = (np.repeat(end, length) - np.arange(len(code)))[place], np.repeat(cnt, length)[place], np.zeros(len(place), np.int64)
        for n in range(1, hi + 1):
            more = left >= n
            place, left, counts, key = place[more], left[more], counts[more], key[more]
            key = key + (character[place + n - 1] << (n - 1) * bits)
            if n >= lo:
                held.append((key, counts))
                size += len(key)
        if size > TOTALS:
            held = [_added(*(np.concatenate(x) for x in zip(*held)))]
            size = len(held[0][0])
            if size > TOTALS // 2:
                yield batch(*held[0])
                held, size = [], 0
    if held:
        yield batch(*_added(*(np.concatenate(x) for x in zip(*held))))


def ngram_totals(words: DataFrame, lo: int = 2, hi: int = 6) -> DataFrame:
    """(term, _tot) of distinct words and their counts (word, cnt)."""
    sums = words.select("word", "cnt").mapInArrow(functools.partial(_total_task, lo=lo, hi=hi), "term string, n bigint")
    return sums.groupBy("term").agg(F.sum("n").alias("_tot"))


class Trie:
    """The terms of a vocabulary as a trie, exact for any alphabet: the steps (node, character) -> node lie in a
    plain table while that has at most ``TABLE`` places, else in an open hash table.  Nodes with steps come first."""

    def __init__(self, terms: list[str], numbers: np.ndarray):
        code = np.frombuffer("".join(terms).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        start = np.cumsum(size) - size
        alphabet = np.unique(code)
        self.width = len(alphabet) + 1                       # 0: a character of no term
        self.character = np.zeros(0x110000, np.int32)
        self.character[alphabet] = np.arange(1, self.width)
        at, steps, nodes = np.zeros(len(terms), np.int64), [np.zeros(0, np.int64)], 1
        for depth in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > depth)
            step, which = np.unique(at[live] * self.width + self.character[code[start[live] + depth]], return_inverse=True)
            at[live] = which + nodes
            steps.append(step)
            nodes += len(step)
        step = np.concatenate(steps)                         # the k-th leads to node k + 1
        inner = np.zeros(nodes, bool)
        inner[0] = True
        inner[step // self.width] = True
        new = np.empty(nodes, np.int64)
        new[np.r_[np.flatnonzero(inner), np.flatnonzero(~inner)]] = np.arange(nodes)
        self.inner = int(inner.sum())
        self.number = np.full(nodes, -1, np.int32)
        self.number[new[at[size > 0]]] = numbers[size > 0]
        step, to = new[step // self.width] * self.width + step % self.width, new[1:].astype(np.int32)
        self.table = None
        if self.inner * self.width <= TABLE:
            self.table = np.zeros(self.inner * self.width, np.int32)
            self.table[step] = to
            return
        self.bits = int(4 * len(step)).bit_length()
        self.key, self.to = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int32)
        slot, left = self._slot(step), np.arange(len(step))
        while len(left):
            free = left[self.key[slot[left]] < 0]
            self.key[slot[free]], self.to[slot[free]] = step[free], to[free]     # of two at one place the last stays
            left = left[self.key[slot[left]] != step[left]]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1

    def _slot(self, step: np.ndarray) -> np.ndarray:
        return (step.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def walk(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The nodes that follow, 0 where none does."""
        if self.table is not None:
            return self.table[node * np.int32(self.width) + character]
        step = node.astype(np.int64) * self.width + character
        slot, to, left = self._slot(step), np.zeros(len(step), np.int32), np.arange(len(step))
        while len(left):
            key = self.key[slot[left]]
            hit = left[key == step[left]]
            to[hit] = self.to[slot[hit]]
            left = left[(key != step[left]) & (key >= 0)]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
        return to

    def found(self, code: np.ndarray, size: int, lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, numbers) of the terms of ``lo`` to ``hi`` characters that begin at the first ``size`` places of ``code``."""
        character = np.concatenate([self.character[code], np.zeros(hi, np.int32)])
        place, node, out = np.arange(size, dtype=np.int32), np.zeros(size, np.int32), []
        for depth in range(hi):
            node = self.walk(node, character[place + np.int32(depth)])
            live = np.flatnonzero(node)
            place, node = place[live], node[live]
            if depth + 1 >= lo:
                number = self.number[node]
                known = number >= 0
                out.append((place, number) if known.all() else (place[known], number[known]))
            more = node < self.inner
            place, node = place[more], node[more]
        return out


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _counted(trie: Trie, texts: list[str], group: np.ndarray, terms: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(group * terms + number, count), ascending, of the known n-grams of texts.

    A term has no blank but its first or last character and never two, so between blanks no n-gram is
    found that runs over the end of a word or a text."""
    code = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    kind = np.int32 if (int(group[-1]) + 1) * terms < 1 << 31 else np.int64
    base, parts = (group * terms).astype(kind), []
    ends = np.cumsum(size)
    for at in range(0, len(code), PIECE):
        n = min(PIECE, len(code) - at)
        first, last = np.searchsorted(ends, [at, at + n - 1], side="right")
        inside = np.minimum(ends[first:last + 1], at + n) - np.maximum(ends[first:last + 1] - size[first:last + 1], at)
        of = np.repeat(base[first:last + 1], inside)
        keys = np.concatenate([of[p] + m for p, m in trie.found(code[at:at + n + hi - 1], n, lo, hi)])
        keys.sort()
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
        parts.append((keys[start], np.diff(np.r_[start, len(keys)])))
    return parts[0] if len(parts) == 1 else _added(*(np.concatenate(x) for x in zip(*parts)))


def _known(batches, trie: Trie, terms: int, lo: int, hi: int):
    """Texts, equal documents adjacent, -> (documents, rows and known n-grams of each, idx, tf); ``idx`` ascending in a document.

    What comes first and may belong to the last document of the yield before is held until it is whole."""
    held = None
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
        lo_row = 0
        while lo_row < b.num_rows:
            hi_row = max(lo_row + 1, int(np.searchsorted(ends, (ends[lo_row - 1] if lo_row else 0) + PIECE, side="right")))
            some = b.slice(lo_row, hi_row - lo_row)
            lo_row = hi_row
            said = some.column(0).dictionary_encode("encode").indices.to_numpy()
            first = np.flatnonzero(np.r_[True, said[1:] != said[:-1]])
            rows = np.diff(np.r_[first, len(said)])
            keys, tf = _counted(trie, some.column(1).to_pylist(), np.repeat(np.arange(len(first)), rows), terms, lo, hi)
            docs, idx = some.column(0).take(pa.array(first)), (keys % terms).astype(np.int32)
            n = np.bincount(keys // terms, minlength=len(first))
            if held is not None:
                if held[0][0].as_py() == docs[0].as_py():
                    old, rest = held, n[0]
                    both = _added(np.concatenate([old[3], idx[:rest]]), np.concatenate([old[4], tf[:rest]]))
                    idx, tf = np.concatenate([both[0], idx[rest:]]), np.concatenate([both[1], tf[rest:]])
                    rows[0] += old[1][0]
                    n[0] = len(both[0])
                else:
                    yield held
            last = len(idx) - n[-1]
            if len(docs) > 1:
                yield docs[:-1], rows[:-1], n[:-1], idx[:last], tf[:last]
            held = docs[-1:], rows[-1:], n[-1:], idx[last:], tf[last:]
    if held is not None:
        yield held


def _lists(n: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Each of ``values`` as lists of ``n`` numbers."""
    offs = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
    return [pa.ListArray.from_arrays(offs, pa.array(v)) for v in values]


def _gram_task(batches, vocab, lo: int, hi: int, every: bool = False):
    """Texts, equal documents adjacent, -> (doc, idx, tf) of the documents with a known n-gram, ``idx`` ascending;
    ``every`` document, with the number of its rows, as (doc, n, idx, tf)."""
    terms, numbers = vocab.value
    width, held, size = max(1, len(terms)), [], 0

    def batch():
        docs, rows, n, idx, tf = zip(*held)
        docs, rows, n = pa.concat_arrays(docs), np.concatenate(rows), np.concatenate(n)
        idx, tf = np.concatenate(idx), np.concatenate(tf).astype(np.int64)
        if every:
            return pa.RecordBatch.from_arrays([docs, pa.array(rows.astype(np.int32)), *_lists(n, idx, tf)], names=["doc", "n", "idx", "tf"])
        return pa.RecordBatch.from_arrays([docs.filter(pa.array(n > 0)), *_lists(n[n > 0], idx, tf)], names=["doc", "idx", "tf"])

    for part in _known(batches, Trie(terms, numbers), width, lo, hi):
        held.append(part)
        size += len(part[3]) + len(part[0])
        if size > BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _frequency_task(batches, vocab, lo: int, hi: int):
    """Texts, equal documents adjacent, -> (idx, number of documents with that n-gram)."""
    terms, numbers = vocab.value
    total = np.zeros(max(1, len(terms)), np.int64)
    for _, _, _, idx, _ in _known(batches, Trie(terms, numbers), len(total), lo, hi):
        total += np.bincount(idx, minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["idx", "n"])


def _send(vocab: DataFrame, column: str):
    """Broadcast (terms, ``column``) of a vocabulary of at most ``BROADCAST_TERMS`` terms, in order of ``idx``."""
    got = vocab.select("term", "idx", column).toArrow().sort_by("idx")
    return vocab.sparkSession.sparkContext.broadcast((got.column("term").to_pylist(), got.column(column).to_numpy()))


def _dealt(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text), the rows of a document adjacent in one task."""
    return df.select(C(doc).alias("doc"), _blank(text).alias("text")).repartition(C("doc")).sortWithinPartitions("doc")


def _numbered(vocab: DataFrame):
    return _send(vocab.select("term", "idx", C("idx").alias("at")), "at")


def known_ngrams(df: DataFrame, vocab: DataFrame, doc: str = "doc_id", text: str = "text", lo: int = 2, hi: int = 6) -> DataFrame:
    """(doc, idx array, tf array): ``char_ngrams`` of the vocabulary's terms, one row a document that has any."""
    kind = df.schema[doc].dataType.simpleString()
    task, texts = functools.partial(_gram_task, vocab=_numbered(vocab), lo=lo, hi=hi), _dealt(df.where(C(text).isNotNull()), doc, text)
    out = texts.mapInArrow(task, f"doc {kind}, idx array<int>, tf array<bigint>").withColumnRenamed("doc", doc)
    out._steps = texts, task
    return out


def document_frequency(df: DataFrame, vocab: DataFrame, doc: str = "doc_id", text: str = "text", lo: int = 2, hi: int = 6) -> DataFrame:
    """(idx, _df): in how many documents each of the vocabulary's terms is; tasks send one row a term."""
    task = functools.partial(_frequency_task, vocab=_numbered(vocab), lo=lo, hi=hi)
    sums = _dealt(df.where(C(text).isNotNull()), doc, text).mapInArrow(task, "idx int, n bigint")
    return sums.groupBy("idx").agg(F.sum("n").alias("_df"))


def char_ngrams(df: DataFrame, doc: str = "doc_id", text: str = "text",
                lo: int = 2, hi: int = 6, vocab: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf) term frequencies of in-word character n-grams; those of a vocabulary as (doc, idx, tf) arrays.

    The texts are dealt by ``doc``; words and then n-grams are counted in that partitioning, so neither
    count shuffles, and the n-grams (many times the text) never leave the task.  Grams are generated
    once per (doc, distinct word), never per occurrence."""
    if vocab is not None:
        return known_ngrams(df, vocab, doc, text, lo, hi)
    wc = word_counts(df.select(doc, text).repartition(C(doc)), doc, text)
    g = wc.select(doc, "cnt", F.explode(_grams(C("word"), lo, hi)).alias("term"))
    return g.groupBy(doc, "term").agg(F.sum("cnt").alias("tf"))


def fit_tfidf(tf: DataFrame, doc: str = "doc_id", max_features: int = 80000,
              docs: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Vocabulary (term, idx, idf) from training term frequencies: top
    ``max_features`` by corpus count (ties by term), smooth idf.  The document
    count comes from ``docs`` when given (documents without any term count).

    ``tf`` may be the documents themselves (with ``text``): the same vocabulary from the totals of
    distinct words, and document counts of its terms alone."""
    whole = "term" not in tf.columns
    src = docs if docs is not None else tf.where(C(text).isNotNull()).select(doc).distinct() if whole else tf.select(doc).distinct()
    n_docs = src.agg(F.count(F.lit(1)).alias("_n"))
    if whole and max_features <= BROADCAST_TERMS:
        words = word_counts(tf.select(F.lit(0).alias("_all"), text), "_all", text)
        totals = ngram_totals(words)
        order = [C("_tot").desc(), C("term")]
        top = totals.orderBy(*order).limit(max_features)
        top = checkpoint(top.withColumn("idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int")))
        df = document_frequency(tf, top, doc, text)
        return F.broadcast(top.join(df, "idx").crossJoin(F.broadcast(n_docs))
                           .select("term", "idx", (F.log((1 + C("_n")) / (1 + C("_df"))) + 1).alias("idf")))
    if whole:
        tf = char_ngrams(tf, doc, text)
    stats = tf.groupBy("term").agg(F.sum("tf").alias("_tot"), F.count(F.lit(1)).alias("_df"))
    top = stats.orderBy(C("_tot").desc(), C("term")).limit(max_features)
    # the window covers <= max_features rows (a parameter bound)
    ranked = top.withColumn("idx", (F.row_number().over(
        Window.orderBy(C("_tot").desc(), C("term"))) - 1).cast("int"))
    vocab = (ranked.crossJoin(F.broadcast(n_docs))
             .select("term", "idx", (F.log((1 + C("_n")) / (1 + C("_df"))) + 1).alias("idf")))
    return F.broadcast(vocab) if max_features <= BROADCAST_TERMS else vocab


def _chain(batches, first, then):
    return then(first(batches) if first else batches)


def _weight_task(batches, vocab):
    """(doc, ..., idx, tf) -> (doc, ..., idx, w)."""
    idf = vocab.value[1]
    for b in batches:
        *rest, idx, tf = b.columns
        offs = idx.offsets.to_numpy()
        idx, tf = (c.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]] for c in (idx, tf))
        w = (1 + np.log(tf)) * idf[idx]
        n = np.diff(offs)
        if len(w):
            norm = np.maximum(np.sqrt(np.add.reduceat(w * w, (offs[:-1] - offs[0])[n > 0])), 1e-12)
            w /= np.repeat(norm, n[n > 0])
        yield pa.RecordBatch.from_arrays([*rest, *_lists(n, idx.astype(np.int32), w)], names=[*b.schema.names[:-1], "w"])


def tfidf(tf: DataFrame, vocab: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, term, idx, w): (1 + ln tf) * idf, L2-normalised per document;
    terms outside the vocabulary are ignored.  Of arrays of known terms
    (doc, idx, tf): (doc, idx, w) arrays, one row a document."""
    if "term" not in tf.columns:
        kind = tf.schema[doc].dataType.simpleString()
        task = functools.partial(_weight_task, vocab=_send(vocab, "idf"))
        rows, first = getattr(tf, "_steps", (tf.select(C(doc).alias("doc"), "idx", "tf"), None))   # as they come from known_ngrams: in the same task
        return rows.mapInArrow(functools.partial(_chain, first=first, then=task), f"doc {kind}, idx array<int>, w array<double>").withColumnRenamed("doc", doc)
    j = tf.join(vocab, "term").withColumn("_w", (1 + F.log("tf")) * C("idf"))
    # the norm is a window over one document's terms (bounded by that document)
    nrm = F.sqrt(F.sum(C("_w") * C("_w")).over(Window.partitionBy(doc)))
    return j.select(doc, "term", "idx", (C("_w") / F.greatest(nrm, F.lit(1e-12))).alias("w"))


def _vectors(df: DataFrame, size: int, doc: str) -> DataFrame:
    """The columns of ``df`` with (idx, w) as one column of sparse vectors: the fields that a vector is stored by are
    named a vector, no row passes through Python or a file."""
    stored_as = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
                         F.coalesce("idx", F.array().cast("array<int>")).alias("indices"), F.coalesce("w", F.array().cast("array<double>")).alias("values"))
    rest = [c for c in df.columns if c not in ("idx", "w")]
    out = df.select(*rest, stored_as.alias("features"))
    schema = T.StructType([f if f.name != "features" else T.StructField("features", VectorUDT()) for f in out.schema])
    spark = df.sparkSession
    kind = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(schema.json())
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), kind, False), spark)


def document_vectors(docs: DataFrame, vocab: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, features) of every document by a given vocabulary: terms outside it are ignored, and a
    document without any known term has the zero vector (of size 0 if the vocabulary is empty).

    The vectors, many times as large as the texts, are made anew where they are used and never written or
    shuffled; a repeated document has the vector of all its rows' text in each."""
    size = vocab.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
    if size <= BROADCAST_TERMS:
        kind = docs.schema[doc].dataType.simpleString()
        texts = _dealt(docs.select(doc, F.when(C(doc).isNotNull(), F.coalesce(C(text), F.lit(""))).otherwise("").alias(text)), doc, text)
        first = functools.partial(_gram_task, vocab=_numbered(vocab), lo=2, hi=6, every=True)
        task = functools.partial(_chain, first=first, then=functools.partial(_weight_task, vocab=_send(vocab, "idf")))
        g = texts.mapInArrow(task, f"doc {kind}, n int, idx array<int>, w array<double>")
        g = g.withColumn("n", F.explode(F.array_repeat(F.lit(0), C("n")))).drop("n").withColumnRenamed("doc", doc)
    else:
        w = tfidf(char_ngrams(docs, doc, text), vocab, doc)
        g = w.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("_p"))
        g = docs.select(doc).join(g, doc, "left").select(doc, "_p.idx", "_p.w")
    return _vectors(g, size, doc)


def _pack_task(batches):
    """Batches of (doc, n, idx, tf) -> one row each, compressed; of ``idx`` the steps from number to number."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in batches:
        idx, tf = b.column(2), b.column(3)
        lens = np.diff(idx.offsets.to_numpy())
        flat = np.diff(idx.flatten().to_numpy(), prepend=0).astype(np.int32), tf.flatten().to_numpy()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([(c, t) for c, t in (("doc", b.column(0).type), ("n", pa.int32()), ("idx", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())))]), options=options) as to:
            to.write_batch(pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_lists(lens, *flat)], names=["doc", "n", "idx", "tf"]))
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])


def _unpack_task(batches):
    for block in (x.as_py() for whole in batches for x in whole.column(0)):
        for b in pa.ipc.open_stream(block):
            lens = np.diff(b.column(2).offsets.to_numpy())
            idx = np.cumsum(b.column(2).flatten().to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_lists(lens, idx, b.column(3).flatten().to_numpy())], names=["doc", "n", "idx", "tf"])


def training_ngrams(docs: DataFrame, labels: DataFrame, vocab: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Known n-grams of the documents that have labels, as blocks of about ``BATCH`` whole numbers, compressed: about a
    byte an n-gram.  They are written once; an optimiser's passes make vectors of weights from them (``training_vectors``)."""
    marks = [c for c in labels.columns if c != doc]
    lab = labels.where(C(doc).isNotNull()).groupBy(doc).agg(F.collect_list(F.struct(*marks)).alias("marks"))
    named = docs.select(doc, F.coalesce(C(text), F.lit("")).alias(text)).join(lab, doc)
    named = named.select(F.to_json(F.struct(C(doc), "marks"), {"ignoreNullFields": "false"}).alias("doc"), text)
    first = functools.partial(_gram_task, vocab=_numbered(vocab), lo=2, hi=6, every=True)
    return stored(_dealt(named, "doc", text).mapInArrow(functools.partial(_chain, first=first, then=_pack_task), "block binary"), "lexical-training")


def training_vectors(blocks: DataFrame, docs: DataFrame, labels: DataFrame, vocab: DataFrame, label: str, doc: str = "doc_id") -> DataFrame:
    """(doc, label, features) of ``training_ngrams`` of ``docs`` and ``labels`` whose ``label`` is known, made where they
    are used: one row for each row of a document and of its labels."""
    size = vocab.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
    marks = T.ArrayType(T.StructType([f for f in labels.schema.fields if f.name != doc]))
    kind = T.StructType([T.StructField(doc, docs.schema[doc].dataType), T.StructField("marks", marks)])
    task = functools.partial(_chain, first=_unpack_task, then=functools.partial(_weight_task, vocab=_send(vocab, "idf")))
    w = blocks.mapInArrow(task, "doc string, n int, idx array<int>, w array<double>").withColumn("_k", F.from_json("doc", kind))
    each = F.expr(f"flatten(array_repeat(filter(_k.marks, m -> m.`{label}` is not null), n))")
    w = w.select(C(f"_k.{doc}").alias(doc), F.explode(each).alias("_m"), "idx", "w")
    return _vectors(w.select(doc, C(f"_m.{label}").cast("double").alias("label"), "idx", "w"), size, doc)


def save_lexical(path: str, vocab: DataFrame, models: dict) -> None:
    """The vocabulary and a model for each label, in one folder."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    for label, m in models.items():
        m.write().overwrite().save(f"{path}/model-{label}")


def load_lexical(spark, path: str, labels) -> tuple[DataFrame, dict]:
    """(vocabulary, label -> model) as saved."""
    return (spark.read.parquet(f"{path}/vocabulary"),
            {label: LogisticRegressionModel.load(f"{path}/model-{label}") for label in labels})


def fit_lexical(train: DataFrame, label: str = "label", c: float = 3.0,
                max_iter: int = 2000, features: str = "features", n: int | None = None):
    """Multinomial / binomial logistic regression with C -> regParam 1/(C n); ``n`` rows, counted if not given."""
    n = train.count() if n is None else n
    lr = LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter,
                            regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True)
    return lr.fit(train)
