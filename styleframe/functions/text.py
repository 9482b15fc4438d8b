"""Column-level text functions (all JVM-side regex / string built-ins).

Regex classes are spelled out explicitly so that Java, Python and RE2 agree:
Java's ``\\s``/``\\w`` are ASCII by default and RE2's differ again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Whitespace as Python's str.split() / str.isspace() understands it.
WS_CHARS = ("\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
            "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}")
WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"
# Four ranges that hold all of it but the blank: quick to rule out.
MAYBE_WS = "[\\x00-\\x1F\\x{7F}-\\x{A0}\\x{1680}\\x{2000}-\\x{3000}]"
# The same whitespace set as literal characters (for translate()).
WS_LITERAL = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B))
              + "\u2028\u2029\u202f\u205f\u3000")
# A Python-style Unicode word character: letters, numbers, underscore.
WORD = "[\\p{L}\\p{N}_]"
# Sentence boundary: runs of . ! ? or newline.
SENTENCE_BOUNDARY = "[.!?\\n]+"
# Markers of removed content and authors that are not people.
REMOVED_BODIES = ("[deleted]", "[removed]")
REMOVED_AUTHORS = ("[deleted]", "[removed]", "AutoModerator")
# Arabic script blocks used by the script-ratio test.
ARABIC_RANGES = "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(text) -> Column:
    """URLs -> 'URL', HTML entities removed, whitespace collapsed and trimmed.

    The URL and entity rules only run on text that contains 'http' / '&'
    (a cheap substring test in front of the regex engine; same result)."""
    return F.element_at(clean_texts(F.array(_c(text))), 1)


def clean_texts(texts) -> Column:
    """``clean_text`` of every element: one ``transform`` per stage, so that a stage which reads its
    input more than once finds a value there, not the stages before it again."""
    t = F.transform(_c(texts), lambda s: F.when(s.contains("http"), F.regexp_replace(s, f"http{NOT_WS}+", "URL")).otherwise(s))
    t = F.transform(t, lambda s: F.when(s.contains("&"), F.regexp_replace(s, f"&{WORD}+;?", "")).otherwise(s))
    # every whitespace char -> ' ' (a char map, for texts that may hold one besides the blank), then collapse and trim
    t = F.transform(t, lambda s: F.when(s.rlike(MAYBE_WS), F.translate(s, WS_LITERAL, " " * len(WS_LITERAL))).otherwise(s))
    return F.transform(t, lambda s: F.trim(F.when(s.contains("  "), F.regexp_replace(s, " {2,}", " ")).otherwise(s)))


def clean_word_count(cleaned) -> Column:
    """Words in text produced by ``clean_text`` (single blanks, no edge blanks)."""
    c = _c(cleaned)
    return F.when(c == "", F.lit(0)).otherwise(
        F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def clean_words(cleaned) -> Column:
    """Word array of text produced by ``clean_text``."""
    c = _c(cleaned)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " ", -1))


def split_sentences(text) -> Column:
    """Split on runs of . ! ? and newline; empty pieces are kept (array<string>)."""
    return F.split(_c(text), SENTENCE_BOUNDARY, -1)


def words(text) -> Column:
    """Whitespace word split with no empty tokens (Python str.split())."""
    return F.filter(F.split(_c(text), f"{WS}+", -1), lambda w: w != F.lit(""))


def join_words(arr) -> Column:
    return F.array_join(_c(arr), " ")


def flatten_newlines(text) -> Column:
    """CR and LF become a blank (before a language test)."""
    return F.replace(F.replace(_c(text), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def tsv_safe(text) -> Column:
    """Tab and LF to a blank, CR removed: safe for one TSV field.

    One search for each character; ``translate`` looks every character of the text up in a map."""
    t = F.replace(F.replace(_c(text), F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return F.replace(t, F.lit("\r"), F.lit(""))


def strip(text) -> Column:
    """Python str.strip(): whitespace off both ends, found from the ends (a regex tries every place)."""
    return F.btrim(_c(text), F.lit(WS_LITERAL))


def char_len(text) -> Column:
    """Length in code points (Spark char_length counts code points)."""
    return F.char_length(_c(text))


def script_ratio(text, ranges: str = ARABIC_RANGES) -> Column:
    """Share of letters that fall in the given code-point ranges.

    chars in range / max(number of letters, 1).
    """
    t = _c(text)
    in_range = F.char_length(F.regexp_replace(t, f"[^{ranges}]", ""))
    letters = F.char_length(F.regexp_replace(t, "[^\\p{L}]", ""))
    return in_range / F.greatest(letters, F.lit(1))


def is_script(text, ranges: str = ARABIC_RANGES, share: float = 0.5) -> Column:
    return script_ratio(text, ranges) > F.lit(share)


def strip_wrapping_quotes(text) -> Column:
    """Drop one pair of wrapping double quotes, then one pair of single quotes.

    A lone quote character counts as wrapped (it starts and ends the text).
    """
    return _strip_pair(_strip_pair(_c(text), '"'), "'")


def _strip_pair(t: Column, q: str) -> Column:
    return F.when(
        t.startswith(q) & t.endswith(q),
        F.substring(t, F.lit(2), F.char_length(t) - 2),
    ).otherwise(t)
