"""Golden fixtures for the file formats (edge rows from FIXTURES.md)."""

import json
import os

import zstandard
from pyspark.sql import functions as F

from styleframe.operators import corpus
from styleframe.sources import corpora, dumps, entries, sinks


def _write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, encoding=None if "b" in mode else "utf-8") as f:
        f.write(text)


DUMP_LINES = [
    "",
    "{bad json",
    json.dumps({"body": "no author field at all here", "id": "a1"}),
    json.dumps({"author": "u1", "body": "[deleted]", "id": "a2"}),
    json.dumps({"author": "AutoModerator", "body": "I am a bot, beep boop", "id": "a3"}),
    json.dumps({"author": "u2", "body": "123456789", "id": "a4"}),
    json.dumps({"author": "u2", "body": "1234567890", "id": "a5", "subreddit": "x"}),
    json.dumps({"author": "u3", "body": "a perfectly fine comment", "id": "a6"}),
]


def test_zst_dump_both_readers(spark, tmp):
    raw = ("\n".join(DUMP_LINES)).encode()        # no final newline
    p = os.path.join(tmp, "dump", "askreddit_RC_2020.zst")
    os.makedirs(os.path.dirname(p))
    with open(p, "wb") as f:
        f.write(zstandard.ZstdCompressor(write_content_size=True).compress(raw))
    for long_window in (False, True):
        lines = dumps.read_dump(spark, p, long_window=long_window)
        parsed = dumps.parse_comments(lines)
        assert parsed.count() == 6              # blank + bad JSON dropped, last line kept
        kept = corpus.drop_removed(parsed, "body", "author", 10)
        ids = sorted(r.id for r in kept.collect())
        assert ids == ["a1", "a5", "a6"]       # missing author -> '' is kept
    assert lines.select(dumps.subreddit_of(F.lit("AskReddit_RC.zst"))).first()[0] == "askreddit"


def test_author_map_sink_and_reader(spark, tmp):
    rows = [("en", "u1", f"text {i}", f"id{i}", "s") for i in range(25)] + [("fr", "u2", "bonjour", "x", "s")]
    df = spark.createDataFrame(rows, "dialect string, author string, text string, id string, subreddit string")
    sinks.write_author_map(df, tmp + "/am", chunk=4)
    back = dumps.read_author_map(spark, tmp + "/am")
    got = {(r.dialect, r.author): r.n for r in back.groupBy("dialect", "author").agg(F.count("*").alias("n")).collect()}
    assert got == {("en", "u1"): 25, ("fr", "u2"): 1}
    # lines are chunks: u1 is spread over several lines
    n_lines = spark.read.text(tmp + "/am/dialect=en").count()
    assert n_lines > 1
    # the foreign whole-file layout
    _write(tmp + "/foreign/mexico_data.json", json.dumps(
        {"[deleted]": [{"text": "x", "id": "1", "subreddit": "m"}],
         "ana": [{"text": "hola a todos", "id": "2", "subreddit": "m"}]}, indent=2))
    f = dumps.read_author_map(spark, tmp + "/foreign/*_data.json", whole_file=True)
    assert sorted((r.dialect, r.author) for r in f.collect()) == [("mexico", "[deleted]"), ("mexico", "ana")]


def test_labelled_tsv(spark, tmp):
    _write(tmp + "/dsl.tsv", "\n".join(["", "only one field", "  two fields\tes-AR,es-MX  ",
                                        "single\tpt", "trailing tab\t"]) + "\n")
    multi = entries.read_labelled_tsv(spark, tmp + "/dsl.tsv", multi=True).collect()
    assert sorted((r.sentence, tuple(r.tags)) for r in multi) == [
        ("single", ("pt",)), ("two fields", ("es-AR", "es-MX"))]
    one = entries.read_labelled_tsv(spark, tmp + "/dsl.tsv", multi=False).collect()
    assert sorted(tuple(r.tags) for r in one) == [("es-AR,es-MX",), ("pt",)]


def test_pan_folders(spark, tmp):
    root = tmp + "/pan"
    _write(root + "/problem001/candidate001/known01.txt", "first line\n\n  second line \n")
    _write(root + "/problem001/Unknown/unknown01.txt", "who wrote this\n")
    _write(root + "/problem001/Unknown/unknown02.txt", "not listed\n")
    _write(root + "/problem001/ground-truth.json",
           json.dumps({"ground_truth": [{"unknown-text": "unknown01.txt", "true-author": "candidate001"}]}))
    _write(root + "/problem002/candidate001/k.txt", "no truth file here\n")
    train, ev = entries.read_pan(spark, root)
    t = sorted((r.sentence, tuple(r.tags)) for r in train.collect())
    assert ("second line", ("problem001", "candidate001", "known01.txt", "line_1")) in t
    assert len(t) == 3
    e = sorted((r.sentence, tuple(r.tags)) for r in ev.collect())
    assert e == [("not listed", ("problem001", "unknown", "line_0")),
                 ("who wrote this", ("problem001", "candidate001", "line_0"))]


def test_hierarchy_nested_files(spark, tmp):
    data = [[[{"text": ["a", "b"], "text_ids": [1, 2], "feature": [1.0]},
              {"text": ["c"], "text_ids": [3], "feature": []}]],
            [[{"text": ["d"], "text_ids": [4]}]]]
    _write(tmp + "/h/argentina.json", json.dumps(data))
    h = entries.read_hierarchy(spark, tmp + "/h/*.json", nested_files=True).orderBy("user", "comment", "sent_idx")
    rows = h.collect()
    assert [r.dialect for r in rows] == ["argentina"] * 3
    assert rows[0].feature == [1.0] and rows[1].feature is None and rows[2].feature is None


def test_city_files(spark, tmp):
    d = tmp + "/madar"
    _write(d + "/MADAR.corpus.Cairo.tsv", "1\tezayak ya basha\n2\tabc\n3\tmesh fahem haga\n")
    _write(d + "/MADAR.corpus.English.tsv", "1\thow are you boss\n2\tx\n")
    _write(d + "/MADAR.corpus.MSA.tsv", "1\tkayfa haluka\n2\tmsa two\n3\tmsa three line\n")
    _write(d + "/MADAR.corpus.French.tsv", "1\tcomment ca va\n")
    _write(d + "/MADAR.corpus.Atlantis.tsv", "1\tunmapped city text\n")
    s = corpora.load_city_files(spark, d)
    got = sorted((r.city, r.text, r.english, r.type, r.dialect) for r in s.collect())
    assert ("Cairo", "ezayak ya basha", "how are you boss", "bitext", "egy") in got
    assert ("Cairo", "mesh fahem haga", "msa three line", "bitext", "egy") in got
    assert all(r[1] != "abc" for r in got)                       # < 5 chars dropped
    assert not any(r[0] in ("English", "French", "MSA") for r in got)


def test_sniffed_tsv_and_parallel_csv(spark, tmp):
    _write(tmp + "/masc_h/a.tsv", "Text\tCountry\nthis is a long enough text\tEgypt\nshort\tEgypt\n"
                                  "another long enough text\tNowhere\n")
    h = corpora.load_sniffed_tsv(spark, tmp + "/masc_h/a.tsv").collect()
    assert sorted((r.text, r.dialect) for r in h) == [("another long enough text", "unknown"),
                                                     ("this is a long enough text", "egy")]
    _write(tmp + "/masc_n/b.tsv", "EGY\tsome egyptian text here\nplain single field text\n")
    n = corpora.load_sniffed_tsv(spark, tmp + "/masc_n/b.tsv").collect()
    assert sorted((r.text, r.dialect) for r in n) == [("plain single field text", "unknown"),
                                                     ("some egyptian text here", "egy")]
    _write(tmp + "/sau.csv", "Dialect,English Text,MSA Translation,Dialect Translation\n"
                             "Najdi,hey,msa side,dialect one\nHijazi,hello there,,dialect two\n")
    p = corpora.load_parallel_csv(spark, tmp + "/sau.csv").collect()
    got = sorted((r.text, r.english, r.type, r.sub_dialect) for r in p)
    assert got == [("dialect one", "msa side", "bitext", "najdi"),
                   ("dialect two", "hello there", "bitext", "hijazi")]


def test_alias_csv_lowercases_before_lookup(spark, tmp):
    _write(tmp + "/habibi.csv", "SongID,Lyrics,SongDialect\n1,a verse long enough,Egypt\n"
                                "2,another verse here,Saudi Arabia\n3,short,Egypt\n")
    s = corpora.load_alias_csv(spark, tmp + "/habibi.csv").collect()
    assert sorted((r.text, r.dialect) for r in s) == [("a verse long enough", "egy"),
                                                     ("another verse here", "sau")]


def test_variety_rows_and_fallback(spark):
    rows = [("MSA", "standard text here", "i", "Egypt"), (None, "missing variety text", "i", "Egypt"),
            ("Egyptian", "dialect text here", "q", "egypt"), ("Gulf", "gulf dialect text", "q", "Atlantis")]
    df = spark.createDataFrame(rows, "language_variety string, output string, instruction string, country string")
    got = sorted((r.text, r.dialect) for r in corpora.load_variety_rows(df).collect())
    assert got == [("dialect text here", "egy"), ("gulf dialect text", "unknown")]
    fb = spark.createDataFrame([("", "a sentence long enough", "", "hello"), ("text long enough x", None, None, "hey!!!")],
                               "text string, sentence string, content string, english string")
    r = sorted((x.text, x.type) for x in corpora.load_fallback(fb).collect())
    assert r == [("a sentence long enough", "monolingual"), ("text long enough x", "bitext")]


def test_prompts_alias_and_instructions(spark, tmp):
    _write(tmp + "/p.csv", 'id,Prompt\n1,"multi\nline prompt"\n2,"tab\there"\n')
    p = entries.read_prompts(spark, tmp + "/p.csv").collect()
    assert sorted(r.prompt for r in p) == ["multi\nline prompt", "tab\there"]
    _write(tmp + "/i.jsonl", json.dumps({"prompt": [{"role": "user", "content": "q"}], "ground_truth": "a"}) + "\n"
           + json.dumps({"prompt": "plain string", "ground_truth": "b"}) + "\n")
    ins = entries.read_instructions(spark, tmp + "/i.jsonl").orderBy("ground_truth").collect()
    assert [(m.role, m.content) for m in ins[0].prompt] == [("user", "q")]
    assert [(m.role, m.content) for m in ins[1].prompt] == [("user", "plain string")]
