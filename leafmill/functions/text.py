"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's `str.strip` sees it; the class reads the same in Java's engine and in RE2.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"
#: Words that go with a page number.
PAGE_WORDS = ("page", "pg", "p", "of", "no")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def squash(c: Column) -> Column:
    """Ends trimmed, runs of white space as one space."""
    return F.regexp_replace(strip(c), f"{WS}+", " ")


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))


def has_text_layer(c: Column, least: int = 50) -> Column:
    """Whether a text has at least `least` letters and digits; null has none."""
    return alnum_count(c) >= least


def line_key(line: Column) -> Column:
    """Key by which lines of different pages are the same: lower case, single spaces; in lines that are only a page number, digits count as `#`."""
    base = F.lower(squash(line))
    words = F.regexp_extract_all(base, F.lit(f"({WORD})"), 1)
    number = lambda w: w.rlike(r"^\p{Nd}+$")
    page_like = F.forall(words, lambda w: w.isin(*PAGE_WORDS) | number(w))
    worded = F.exists(words, lambda w: w.isin(*PAGE_WORDS))
    few = F.size(F.filter(words, number)) <= 1
    return F.when(page_like & (worded | few), F.regexp_replace(base, r"\p{Nd}+", "#")).otherwise(base)


def node_key(name: Column) -> Column:
    """Key of an entity name: single spaces, folded case."""
    return F.replace(F.lower(squash(F.coalesce(name, F.lit("")))), F.lit("ß"), F.lit("ss"))


def word_set(text: Column) -> Column:
    """Distinct words and numbers of more than one character, folded case."""
    folded = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.array_distinct(F.filter(F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{Nl}\p{No}]+|\p{Nd}+)"), 1), lambda w: F.length(w) > 1))


def plain_words(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and Devanagari, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([0-9a-z\x{900}-\x{97f}]+)"), 1))


def tidy(text: Column) -> Column:
    """Newlines at the ends gone, three or more of them as two."""
    return F.regexp_replace(F.btrim(text, F.lit("\n")), "\n{3,}", "\n\n")


def match_count(text: Column, query: str) -> Column:
    """Occurrences of a query in a text, in any case, not overlapping and never across lines. A blank query occurs nowhere."""
    q = query.strip().lower()
    if not q:
        return F.lit(0).cast("long")
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1)
    count = lambda l: (F.length(l) - F.length(F.replace(l, F.lit(q), F.lit("")))) / len(q)  # noqa: E731, E741
    return F.aggregate(lines, F.lit(0.0), lambda a, l: a + count(l)).cast("long")  # noqa: E741


def matched_segments(line: Column, query: str) -> Column:
    """Pieces of a line with whether each is a match, in order."""
    q = query.strip().lower()
    pieces = F.split(F.lower(line), F.concat(F.lit("\\Q"), F.lit(q), F.lit("\\E")), -1)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,is_match:boolean>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        own = F.struct(F.substring(line, a["at"], F.length(p)).alias("text"), F.lit(False).alias("is_match"))
        hit = F.struct(F.substring(line, a["at"] + F.length(p), F.lit(len(q))).alias("text"), F.lit(True).alias("is_match"))
        return F.struct((a["at"] + F.length(p) + len(q)).alias("at"), F.concat(a["out"], F.array(own, hit)).alias("out"))

    whole = F.aggregate(pieces, start, step, lambda a: a["out"])
    return F.filter(F.slice(whole, 1, F.size(whole) - 1), lambda s: s["text"] != "")


def xml_safe(text: Column) -> Column:
    """Null as empty text; control characters that XML forbids gone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]", "")


def unfenced(text: Column) -> Column:
    """Text of a fenced JSON block; other text as it is."""
    t = strip(text)
    return F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, r"^```(?i:json)?", ""), r"```$", ""))).otherwise(t)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
