"""One consistent form for text that looks the same.

The canonical form is: compatibility normalisation composed (NFKC), default-ignorable characters removed, every kind of space
mapped to the ordinary one, letters of another script inside a word mapped to the script of the word, full case folding.
Each distinct value is worked out once; ASCII texts never leave the JVM where only cases are sought.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmill.llm import mojibake
from leafmill.sources.tables import page_counts

#: Latin letters and the Cyrillic and Greek letters that look like them.
LATIN_CYRILLIC = dict(zip("AaBCcEeHIiJjKMOoPpSsTXxYy", "АаВСсЕеНІіЈјКМОоРрЅѕТХхУу", strict=True))
LATIN_GREEK = dict(zip("ABEZHIKMNOoTXYPvu", "ΑΒΕΖΗΙΚΜΝΟοΤΧΥΡνυ", strict=True))
FROM_CYRILLIC = {b: a for a, b in LATIN_CYRILLIC.items()} | {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "т": "t", "н": "h"}
FROM_GREEK = {b: a for a, b in LATIN_GREEK.items()} | {"α": "a", "ε": "e", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "χ": "x", "γ": "y", "ω": "w", "ό": "ó", "ά": "á", "ί": "í", "έ": "é", "ύ": "ú", "η": "n"}
CYRILLIC_GREEK = {LATIN_CYRILLIC[a]: LATIN_GREEK[a] for a in LATIN_CYRILLIC.keys() & LATIN_GREEK.keys()}
SCRIPT = {"L": r"A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "G": r"Ͱ-ͳͶͷͻ-ͽΆΈ-Ͽἀ-῾", "C": r"Ѐ-ҁҊ-ԯ"}
MAPS = {("G", "L"): FROM_GREEK, ("C", "L"): FROM_CYRILLIC, ("L", "C"): LATIN_CYRILLIC, ("L", "G"): LATIN_GREEK, ("C", "G"): CYRILLIC_GREEK, ("G", "C"): {b: a for a, b in CYRILLIC_GREEK.items()}}

SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Default-ignorable characters (from the Unicode property, without unassigned ones of the planes beyond).
IGNORABLE = "\u00ad\u034f\u061cᅟᅠ\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206fㅤ\ufe00-\ufe0f\ufeffﾠ"
ASTRAL_IGNORABLE = "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
#: Marks, and the vowels and finals of Hangul, that may make one character with what is before them: the second parts of decompositions.
MARKS = "\u0300-\u036f\u0483-\u0487" + "".join(
    sorted({chr(int(d[1], 16)) for c in [*range(0x370, 0x3100), *range(0x11000, 0x11A00)] if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and d[0][0] != "<" and int(d[1], 16) > 0x487})
) + "\u1161-\u1175\u11a8-\u11c2"
#: Letters and digits with a compatibility form, by block.
COMPAT = (
    "ªºĲĳŀĿſǄ-ǌǱ-ǳϐ-ϖϰ-ϵᴬ-ᵪⁱⁿ"
    "ₐ-ₜℂℊ-ℓℕℙ-ℝℤΩℨK-ℭℯ-ℱℳ-ℹⅅ-ⅉ"
    "Ⅰ-ⅿ①-⓿ﬀ-ﬆﬓ-ﬗ０-９Ａ-Ｚａ-ｚｦ-ﾟﾡ-ￜ"
)
#: Blocks of which each character counts whose compatibility form has a letter or digit: superscripts and subscripts, letterlike and enclosed
#: ones, squared words and units, Hangul letters, ideographs and Arabic forms. Signs in ordinary use (fractions, trade mark, number sign) do not.
BLOCKS = (
    (0xB2, 0xB3), (0xB9, 0xB9), (0x2E0, 0x2E4), (0x2B0, 0x2B8), (0x1D2C, 0x1DBF), (0x2070, 0x209C), (0x2C7C, 0x2C7D), (0x2460, 0x24FF), (0x3131, 0x318E), (0x3192, 0x33FF), (0xA69C, 0xA69D), (0xA7F2, 0xA7F9),
    (0xAB5C, 0xAB69), (0xF900, 0xFAD9), (0xFB00, 0xFDFB), (0xFE70, 0xFEFC), (0xFF10, 0xFFDC), (0x1EE00, 0x1EEBB), (0x1F100, 0x1F251), (0x1FBF0, 0x1FBF9), (0x2F800, 0x2FA1D),
)
COMPAT += "".join(chr(c) for a, b in BLOCKS for c in range(a, b + 1) if (n := unicodedata.normalize("NFKC", chr(c))) != chr(c) and any(x.isalnum() for x in n) and chr(c) not in "\u1160\u3164\uffa0")
ASTRAL_COMPAT = "\U0001d400-\U0001d7ff"

_SPACE = re.compile(f"[{SPACES}]")
_IGNORE = re.compile(f"[{IGNORABLE}{ASTRAL_IGNORABLE}]")
_COMPAT = re.compile(f"[{COMPAT}{ASTRAL_COMPAT}]+")
_MARKED = re.compile(f"[^\\W\\d_][{MARKS}]+")
RUN = re.compile(r"[A-Za-z]?[^\x00-\x7f]+[A-Za-z]?")
_ANY = re.compile(f"[{SPACES}{IGNORABLE}{MARKS}{COMPAT}{ASTRAL_IGNORABLE}{ASTRAL_COMPAT}]")
_LETTERS_OF_TWO = re.compile("|".join(f"[{SCRIPT[a]}][{SCRIPT[b]}]" for a in SCRIPT for b in SCRIPT if a != b))
#: Most distinct runs that a worker remembers.
CACHE = 200_000
_SUSPECT: dict[str, bool] = {}
_TWO = _LETTERS_OF_TWO
_WORD = re.compile(r"[^\W\d_]+")
_IN = {k: re.compile(f"[{v}]") for k, v in SCRIPT.items()}


def at_issue(text: str) -> bool:
    """Whether a text may have look-alike characters. Its runs beyond ASCII repeat, so that each distinct one is judged once."""
    if not text.isascii():
        for run in RUN.findall(text):
            if _SUSPECT.get(run) is None:
                if len(_SUSPECT) > CACHE:
                    _SUSPECT.clear()
                _SUSPECT[run] = bool(_ANY.search(run)) or bool(_LETTERS_OF_TWO.search(run))
            if _SUSPECT[run]:
                return True
    return False


def _one_script(m: re.Match[str]) -> str:
    word = m.group()
    counts = {k: len(p.findall(word)) for k, p in _IN.items()}
    if sum(v > 0 for v in counts.values()) < 2:
        return word
    # the script of the word is the one with letters that have no look-alike in the others, else the most frequent
    own = {k: sum(1 for c in word if _IN[k].match(c) and all(c not in MAPS[(k, o)] for o in SCRIPT if o != k and counts[o])) for k in SCRIPT}
    main = max(SCRIPT, key=lambda k: (own[k], counts[k], k == "L"))
    out = []
    for c in word:
        k = next((k for k, p in _IN.items() if p.match(c)), main)
        out.append(c if k == main else MAPS[(k, main)].get(c, c))
    return "".join(out)


def plain(text: str) -> str:
    """The text with ordinary characters for look-alike ones; its case, lines and signs stay."""
    text = _IGNORE.sub("", _SPACE.sub(" ", text))
    text = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if _MARKED.search(text):
        text = unicodedata.normalize("NFC", text)
    return _WORD.sub(_one_script, text) if _TWO.search(text) else text


def look_alikes(text: str) -> int:
    """How many places of a text differ from the ordinary character that they look like."""
    n = len(_SPACE.findall(text)) + len(_IGNORE.findall(text)) + len(_COMPAT.findall(text))
    n += sum(len(unicodedata.normalize("NFC", m)) < len(m) for m in _MARKED.findall(text))
    bare = _IGNORE.sub("", text) if n else text
    return n + sum(1 for m in _WORD.finditer(bare) if sum(bool(p.search(m.group())) for p in _IN.values()) > 1) if _TWO.search(bare) else n


def canonical(text: str) -> str:
    """The form to compare by: plain, NFKC, case-folded, runs of white space as one space, ends trimmed."""
    text = unicodedata.normalize("NFKC", plain(text)).casefold()
    return " ".join(unicodedata.normalize("NFKC", text).split())


def per_distinct(values: pd.Series, f) -> pd.Series:  # noqa: ANN001
    """`f` of every value, worked out once for each distinct one; null stays null."""
    codes, distinct = pd.factorize(values)
    made = pd.Series([f(v) for v in distinct], dtype=object)
    return pd.Series([None if c < 0 else made[c] for c in codes], index=values.index, dtype=object)


@F.pandas_udf(StringType())
def _canonical_udf(values: pd.Series) -> pd.Series:
    return per_distinct(values, canonical)


@F.pandas_udf(StringType())
def _plain_udf(values: pd.Series) -> pd.Series:
    return per_distinct(values, plain)


def with_canonical(df: DataFrame, column: str, out: str) -> DataFrame:
    """The table with the canonical form of a text column. Null gives null, blank text gives empty text; ties and repeats keep their rows."""
    return df.withColumn(out, _canonical_udf(F.col(column)))


def with_plain(df: DataFrame, column: str, out: str) -> DataFrame:
    """As `with_canonical`, keeping case, lines and signs."""
    return df.withColumn(out, _plain_udf(F.col(column)))


def _counted(df: DataFrame, keys: list[str], texts: list[str], skip_damaged: bool) -> DataFrame:
    """Keys of the rows of which a text has look-alike characters."""
    any_: Column = F.lit(False)
    for t in texts:
        any_ = any_ | F.coalesce(F.octet_length(t) > F.length(t), F.lit(False))
    few = df.where(any_).select(*keys, *texts)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def case(t: str) -> bool:
            return at_issue(t) and look_alikes(t) > 0 and not (skip_damaged and mojibake.restore(t)[1])

        for b in batches:
            hit = [any(row) for row in zip(*[per_distinct(b[t], case) for t in texts], strict=True)]
            yield b.loc[hit, keys]

    types = dict(df.dtypes)
    return few.mapInPandas(judge, ", ".join(f"`{k}` {types[k]}" for k in keys))


def found(pages: DataFrame, triples: DataFrame) -> DataFrame:
    """Distinct (place, doc_id, num) of pages and triples with look-alike characters; pages with encoding damage are left out."""
    p = _counted(page_counts(pages).select("doc_id", F.col("page").cast("long").alias("num"), "text"), ["doc_id", "num"], ["text"], True)
    t = _counted(triples.select("doc_id", F.col("seq").cast("long").alias("num"), "subject", "predicate", "object"), ["doc_id", "num"], ["subject", "predicate", "object"], False)
    both = p.select(F.lit("page").alias("place"), "doc_id", "num").unionByName(t.select(F.lit("triple").alias("place"), "doc_id", "num"))
    return both.distinct()
