"""Instruction-data build: dialect normalisation, distributions, bitext prompt
templates, answer guards, conversation assembly and aligned-corpus joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from styleframe.functions import keyed
from styleframe.functions.text import ARABIC_RANGES, WS, is_script, strip_wrapping_quotes
from styleframe.operators import cues
from styleframe.operators.hierarchy import line_numbers
from styleframe.session import scratch_path

# --- fixed values: dialect labels -> country codes (dataset vocabularies) ---
DIALECT_TO_COUNTRY = {
    "ALG": "dza", "ALX": "egy", "AMM": "jor", "ASW": "egy", "BAG": "irq",
    "BAS": "irq", "BEI": "lbn", "BEN": "lby", "CAI": "egy", "DAM": "syr",
    "DOH": "qat", "FES": "mar", "JED": "sau", "JER": "pse", "KHA": "sdn",
    "MOS": "irq", "MSA": "msa", "MUS": "omn", "RAB": "mar", "RIY": "sau",
    "SAL": "jor", "SAN": "yem", "SFX": "tun", "TRI": "lby", "TUN": "tun",
    "Algiers": "dza", "Cairo": "egy", "Damascus": "syr", "Fes": "mar",
    "Aleppo": "syr", "Alexandria": "egy", "Amman": "jor", "Aswan": "egy",
    "Baghdad": "irq", "Basra": "irq", "Beirut": "lbn", "Benghazi": "lby",
    "Doha": "qat", "Jeddah": "sau", "Mosul": "irq", "Muscat": "omn",
    "Rabat": "mar", "Salt": "jor", "Sanaa": "yem", "Sfax": "tun",
    "Tripoli": "lby", "Tunis": "tun",
    "Jerusalem": "pse", "Khartoum": "sdn", "Riyadh": "sau",
    "Egypt": "egy", "egypt": "egy",
    "Morocco": "mar", "morocco": "mar",
    "Algeria": "dza", "algeria": "dza",
    "Syria": "syr", "syria": "syr",
    "Palestine": "pse", "palestine": "pse",
    "Jordan": "jor", "jordan": "jor",
    "Sudan": "sdn", "sudan": "sdn",
    "Iraq": "irq", "iraq": "irq",
    "Lebanon": "lbn", "lebanon": "lbn",
    "Tunisia": "tun", "tunisia": "tun",
    "Libya": "lby", "libya": "lby",
    "Yemen": "yem", "yemen": "yem",
    "Saudi Arabia": "sau", "saudi arabia": "sau",
    "Qatar": "qat", "qatar": "qat",
    "Oman": "omn", "oman": "omn",
    "Kuwait": "kwt", "kuwait": "kwt",
    "Bahrain": "bhr", "bahrain": "bhr",
    "UAE": "are", "uae": "are",
    "Mauritania": "mrt", "mauritania": "mrt",
    "Somalia": "som", "somalia": "som",
    "Djibouti": "dji", "djibouti": "dji",
    "Comoros": "com", "comoros": "com",
    "egyptian": "egy", "egy": "egy", "EGY": "egy",
    "levantine": "syr", "lev": "syr", "LEV": "syr",
    "gulf": "sau", "glf": "sau", "GLF": "sau",
    "maghrebi": "mar", "mgr": "mar", "MGR": "mar",
    "iraqi": "irq", "irq": "irq", "IRQ": "irq",
    "saudi": "sau", "sau": "sau", "SAU": "sau",
    "moroccan": "mar", "mar": "mar", "MAR": "mar",
    "algerian": "dza", "dza": "dza", "DZA": "dza",
    "syrian": "syr", "syr": "syr", "SYR": "syr",
    "palestinian": "pse", "pse": "pse", "PSE": "pse",
    "jordanian": "jor", "jor": "jor", "JOR": "jor",
    "sudanese": "sdn", "sdn": "sdn", "SDN": "sdn",
    "tunisian": "tun", "tun": "tun", "TUN": "tun",
    "libyan": "lby", "lby": "lby", "LBY": "lby",
    "lebanese": "lbn", "lbn": "lbn", "LBN": "lbn",
    "yemeni": "yem", "yem": "yem", "YEM": "yem",
    "darija": "mar",
}

COUNTRY_TO_DIALECT_NAME = {
    "egy": "Egyptian Arabic",
    "sau": "Saudi Arabic",
    "mar": "Moroccan Arabic (Darija)",
    "dza": "Algerian Arabic",
    "syr": "Syrian Arabic",
    "pse": "Palestinian Arabic",
    "jor": "Jordanian Arabic",
    "sdn": "Sudanese Arabic",
    "irq": "Iraqi Arabic",
    "lbn": "Lebanese Arabic",
    "tun": "Tunisian Arabic",
    "lby": "Libyan Arabic",
    "yem": "Yemeni Arabic",
    "qat": "Qatari Arabic",
    "omn": "Omani Arabic",
    "kwt": "Kuwaiti Arabic",
}

TARGET_DIALECTS = ("egy", "mar", "pse", "sau", "syr", "jor")

BITEXT_PREFIXES_EN_TO_DA = (
    "ترجم للهجتك: ",
    "قول هاد الحكي بلهجتك: ",
    "كيف بتقول هاد بلهجتك: ",
    "حول للعامية: ",
    "اكتب هاد بالعامية: ",
)

BITEXT_PREFIXES_MSA_TO_DA = (
    "حول الجملة دي للهجتك: ",
    "قولها بالعامية: ",
    "اعد كتابتها باللهجة: ",
)
DROP_DIALECTS = ("", "unknown", "msa")

QUESTION_WORDS = {
    "egy": ("إيه", "ايه", "يعني إيه", "ممكن أعرف", "إيه رأيك", "ايه معنى"),
    "mar": ("شنو", "كيفاش", "شنو كتعني", "واش", "فين", "علاش"),
    "pse": ("شو", "ايش", "كيف", "احكيلي", "شو يعني", "ايش معنى"),
    "sau": ("وش", "ايش", "وشو", "كيف", "ايش هي", "ايش معنى"),
    "syr": ("شو", "كيف", "شو هي", "فيك تقلي", "احكي", "بدي تعطيني"),
    "jor": ("شو", "كيف", "ايش", "احكيلي", "شو يعني", "وين"),
}
DEFAULT_QUESTION_WORDS = ("شو", "ايش", "كيف")

QUESTION_TOPICS = (
    "food, recipes, or traditional dishes from the region",
    "local proverbs, sayings, or their meanings",
    "cultural traditions, celebrations, or customs",
    "geography, cities, or landmarks",
    "history, historical figures, or events",
    "local dialect words or expressions and their meanings",
    "nature, animals, or agriculture in the region",
    "arts, music, or literature",
)
# -----------------------------------------------------------------------------

SAMPLE_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("dialect", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("english", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("sub_dialect", T.StringType()),
    T.StructField("original_instruction", T.StringType()),
])


def mapping_table(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """The label -> code dictionary as a small dimension table (key, code)."""
    m = DIALECT_TO_COUNTRY if mapping is None else mapping
    return spark.createDataFrame(list(m.items()), "key string, code string")


def normalise_dialect(df: DataFrame, col: str, mapping: DataFrame, out: str = "dialect",
                      fallback: str = "raw", lower_first: bool = False) -> DataFrame:
    """Dictionary lookup with a per-loader fall-through.

    ``fallback``: 'raw' keeps the value, 'lower' keeps it lower-cased,
    anything else is a literal default (e.g. 'unknown').  ``lower_first``
    lower-cases before the lookup (so mixed-case keys miss, as some loaders
    do); otherwise the lookup is exact then lower-cased.  The mapping is a
    fixed-size dictionary, so it is broadcast."""
    m = F.broadcast(mapping)
    v = F.col(col)
    probe1 = F.lower(v) if lower_first else v
    j = (df.join(m.select(F.col("key").alias("_k1"), F.col("code").alias("_c1")),
                 probe1 == F.col("_k1"), "left")
         .join(m.select(F.col("key").alias("_k2"), F.col("code").alias("_c2")),
               F.lower(v) == F.col("_k2"), "left"))
    if fallback == "raw":
        fb = F.lower(v) if lower_first else v
    elif fallback == "lower":
        fb = F.lower(v)
    else:
        fb = F.lit(fallback)
    chain = F.col("_c1") if lower_first else F.coalesce(F.col("_c1"), F.col("_c2"))
    return j.withColumn(out, F.coalesce(chain, fb)).drop("_k1", "_c1", "_k2", "_c2")


def display_name(code: Column, names: dict | None = None) -> Column:
    m = COUNTRY_TO_DIALECT_NAME if names is None else names
    lit_map = F.create_map(*[x for kv in m.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(lit_map, code),
                      F.concat(F.lit("Arabic dialect ("), code, F.lit(")")))


def drop_unusable(df: DataFrame, dialect: str = "dialect") -> DataFrame:
    return df.filter(~F.col(dialect).isin(*DROP_DIALECTS))


def distribution(df: DataFrame, targets: Sequence[str] = TARGET_DIALECTS,
                 dialect: str = "dialect", source: str = "source") -> DataFrame:
    """Dialect and source counts in one pass (grouping sets), with target counts."""
    return (df.groupingSets([[dialect], [source]], dialect, source)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col(dialect).isin(*targets)).alias("n_target")))


def bitext_prompts(df: DataFrame, seed: int = 42, key: Sequence[str] = ("text",),
                   en_prefixes: Sequence[str] = BITEXT_PREFIXES_EN_TO_DA,
                   msa_prefixes: Sequence[str] = BITEXT_PREFIXES_MSA_TO_DA) -> DataFrame:
    """Bitext rows with a source side -> instruction pairs.

    The prefix list is chosen by the script of the source side (Arabic ->
    MSA prompts); the prefix inside a list is a keyed draw."""
    b = df.filter((F.col("type") == "bitext") & F.col("english").isNotNull())
    u = keyed.uniform(seed, *key)
    en = F.array(*[F.lit(p) for p in en_prefixes])
    msa = F.array(*[F.lit(p) for p in msa_prefixes])
    arabic = is_script(F.col("english"), ARABIC_RANGES)
    prefix = F.when(arabic, F.element_at(msa, (F.floor(u * len(msa_prefixes)) + 1).cast("int"))) \
        .otherwise(F.element_at(en, (F.floor(u * len(en_prefixes)) + 1).cast("int")))
    prompt = F.array(F.struct(F.lit("user").alias("role"),
                              F.concat(prefix, F.col("english")).alias("content")))
    return b.select(prompt.alias("prompt"), F.col("text").alias("ground_truth"),
                    "dialect", "source", F.lit("bitext").alias("type"), *[
                        c for c in key if c not in ("text", "dialect", "source", "type")])


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def guard_answer(df: DataFrame, instruction: str = "instruction", answer: str = "answer",
                 fallback: str = "text") -> DataFrame:
    """Generated instruction < 5 chars -> row dropped; wrapping quotes removed;
    answer < 20 chars -> the corpus text."""
    ins = _strip(F.col(instruction))
    ok = df.filter(ins.isNotNull() & (F.char_length(ins) >= 5))
    ans = _strip(F.col(answer))
    return (ok.withColumn(instruction, strip_wrapping_quotes(_strip(F.col(instruction))))
            .withColumn(answer, F.when(ans.isNull() | (F.char_length(ans) < 20), F.col(fallback))
                        .otherwise(ans)))


MESSAGE = T.StructType([T.StructField("role", T.StringType()),
                        T.StructField("content", T.StringType())])


def to_messages(df: DataFrame, prompt: str = "prompt", ground_truth: str = "ground_truth",
                out: str = "messages") -> DataFrame:
    """prompt turns + the assistant answer appended."""
    return df.withColumn(out, F.concat(F.col(prompt), F.array(F.struct(
        F.lit("assistant").alias("role"), F.col(ground_truth).alias("content")))))


def normalise_prompt(col: Column) -> Column:
    """A prompt stored as JSON text: an array of objects is a list of turns; any other value, malformed
    text and an empty array included, becomes one user turn with that text (null stays null).

    A turn without a role is the user's.  Content that is a list of parts is their texts, joined by line
    ends; content of another shape is its JSON text, and none is an empty text."""
    parsed = F.try_parse_json(col)
    turns = F.try_variant_get(parsed, "$", "array<variant>")

    def is_object(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    def content(turn: Column) -> Column:
        whole = F.try_variant_get(turn, "$.content", "variant")
        parts = F.try_variant_get(whole, "$", "array<variant>")
        text = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string"), F.to_json(x))
        joined = F.array_join(F.transform(parts, text), "\n")
        known = F.coalesce(joined, F.try_variant_get(whole, "$", "string"), F.to_json(whole))
        return F.when(F.is_variant_null(whole), F.lit("")).otherwise(F.coalesce(known, F.lit("")))

    message = lambda t: F.struct(
        F.coalesce(F.try_variant_get(t, "$.role", "string"), F.lit("user")).alias("role"), content(t).alias("content"))
    listed = F.coalesce((F.size(turns) > 0) & F.forall(turns, is_object), F.lit(False))
    one = F.array(F.struct(F.lit("user").alias("role"), col.alias("content")))
    return F.when(col.isNull(), F.lit(None)).when(listed, F.transform(turns, message)).otherwise(one)


def pair_turns(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
               role: str = "role", text: str = "text") -> DataFrame:
    """Each user turn followed by an assistant turn -> (prompt, ground_truth).

    The next turn comes from ``with_next``, so a hot conversation is spread."""
    nxt = with_next(conv, conv_id, turn, {role: "_next_role", text: "_next_text"})
    pairs = nxt.filter((F.col(role) == "user") & (F.col("_next_role") == "assistant"))
    return pairs.select(conv_id, turn, F.array(F.struct(F.lit("user").alias("role"),
                                                        F.col(text).alias("content"))).alias("prompt"),
                        F.col("_next_text").alias("ground_truth"))


def with_next(df: DataFrame, group: str, order: str, cols: dict[str, str]) -> DataFrame:
    """Add columns of the next row of the group in ``order`` (null for the last one).

    Rows are numbered by a distributed prefix sum and joined on (group, number), so no task holds
    a whole group (``lead`` over the group would)."""
    rows = line_numbers(df, [group], [order], out="_line")
    after = rows.select(F.col(group).alias("_g"), (F.col("_line") - 1).alias("_l"), *[F.col(c).alias(n) for c, n in cols.items()])
    return rows.join(after, (F.col(group) == F.col("_g")) & (F.col("_line") == F.col("_l")), "left").drop("_g", "_l", "_line")


def align_by_position(left: DataFrame, right: DataFrame, key: str, text: str = "text",
                      out: str = "english", fallback: DataFrame | None = None) -> DataFrame:
    """Attach the aligned line of another corpus by position (``key`` = line
    number); past the end -> ''.  With ``fallback``, a missing or empty
    preferred side falls back to the second corpus (e.g. MSA)."""
    r = right.select(F.col(key), F.col(text).alias("_pref"))
    j = left.join(r, key, "left")
    chosen = F.nullif(F.col("_pref"), F.lit(""))
    if fallback is not None:
        fb = fallback.select(F.col(key), F.col(text).alias("_fb"))
        j = j.join(fb, key, "left")
        chosen = F.coalesce(chosen, F.nullif(F.col("_fb"), F.lit("")))
        j = j.withColumn(out, F.coalesce(chosen, F.lit(""))).drop("_fb")
    else:
        j = j.withColumn(out, F.coalesce(chosen, F.lit("")))
    return j.drop("_pref")


def union_loaders(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of loader outputs onto the corpus-sample schema."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def run_loaders(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """Union of the loaders that work, and a report: loader -> '' or what its failure said.

    A loader fails when its input cannot be resolved (missing path, unreadable header) or when a
    task cannot read it: so each is written to the shared folder before it counts, a failed one is
    reported and left out whole, and the others go on.  Their rows are read from what was written."""
    frames, report = [], {}
    for name, load in loaders.items():
        path = scratch_path(spark, "loader")
        try:
            load().write.parquet(path)
            frames.append(spark.read.parquet(path))
            report[name] = ""
        except (PySparkException, Py4JJavaError, OSError, ValueError) as e:
            report[name] = str(e).strip().partition("\n")[0][:300] or type(e).__name__
    return union_loaders(frames) if frames else spark.createDataFrame([], SAMPLE_SCHEMA), report


def question_requests(df: DataFrame, key: Sequence[str], seed: int = 42, text: str = "text", dialect: str = "dialect",
                      out: str = "request") -> DataFrame:
    """Monolingual rows with the request that asks an annotator for a question which the text answers:
    the dialect's name and question words, and a topic drawn by key."""
    topics = F.array(*[F.lit(t) for t in QUESTION_TOPICS])
    topic = F.element_at(topics, (F.floor(keyed.uniform(seed, F.lit("topic"), *key) * len(QUESTION_TOPICS)) + 1).cast("int"))
    table = F.create_map(*[F.lit(x) for k, v in QUESTION_WORDS.items() for x in (k, ", ".join(v))])
    asked = F.coalesce(F.element_at(table, F.col(dialect)), F.lit(", ".join(DEFAULT_QUESTION_WORDS)))
    name = display_name(F.col(dialect))
    request = F.concat(F.lit("Ask one short question in "), name, F.lit(" (not Modern Standard Arabic) about "), topic,
                       F.lit(" to which the text below is a natural answer. Use question words like "), asked,
                       F.lit(". Give the question only and do not repeat the text.\n\nText:\n"), F.col(text))
    return df.filter(F.col("type") == "monolingual").withColumn(out, request)


def answer_requests(df: DataFrame, instruction: str = "instruction", text: str = "text", dialect: str = "dialect",
                    out: str = "request") -> DataFrame:
    """The request for a full answer to a generated question that uses the corpus text."""
    name = display_name(F.col(dialect))
    request = F.concat(F.lit("Answer in "), name, F.lit(" only, in three to six sentences, the question: "), F.col(instruction),
                       F.lit("\nUse this phrase in the answer: "), F.col(text))
    return df.withColumn(out, request)


def monolingual_instructions(df: DataFrame, annotator: Callable[[list[str]], list[str | None]], key: Sequence[str],
                             seed: int = 42) -> DataFrame:
    """(key..., prompt, ground_truth, dialect, source, type): question and answer asked one after the
    other of a text annotator.  A row whose question or answer request fails, or whose question is too
    short, is dropped; a too short answer is replaced by the text."""
    key = list(key)
    rows = question_requests(df, key, seed)
    asked = cues.annotate_text(rows, annotator, key, "request", "instruction")
    rows = answer_requests(rows.drop("request").join(asked, key))
    rows = rows.join(cues.annotate_text(rows, annotator, key, "request", "answer"), key)
    ok = guard_answer(rows)
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content")))
    return ok.select(*key, prompt.alias("prompt"), F.col("answer").alias("ground_truth"),
                     *[c for c in ("dialect", "source", "type") if c not in key])
