"""Text that was decoded with another encoding than it was written in.

The characters of a line are mapped back to the bytes of a legacy encoding. An automaton on the byte structure of UTF-8 (of
Shift-JIS, GBK and EUC for runs without UTF-8 structure) finds the maximal well-formed multibyte spans, and only these spans
are decoded; everything else stays as it is. Since a single-byte table maps characters to bytes one by one, the
automaton over bytes is compiled into one over characters: a regular expression for each table.

Single-byte text read by another single-byte table has no structure to find. There the characters of a run are decoded
with the candidate tables, and the reading is taken if it is a plausible word of the script while the run itself is none.
Replacement characters mark damage that cannot be restored.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources.tables import page_counts

#: Encodings in which UTF-8 bytes are commonly misread, most common first.
READ_AS = ("cp1252", "cp1251", "cp1250", "cp437", "mac_roman", "koi8_r", "cp850", "cp866", "cp1253", "cp1254")
#: Pairs (read as, written in) of single-byte tables that are commonly mixed up.
SINGLE = (("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "koi8_r"), ("cp1252", "cp1250"), ("cp1252", "cp866"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("koi8_r", "cp1251"), ("cp1250", "cp1251"))
#: East Asian multibyte encodings read as cp1252.
WIDE = ("shift_jis", "gb18030", "euc_jp")
REPLACEMENT = "�"


@cache
def table(codec: str) -> dict[int, str]:
    """Characters of the bytes 0x80-0xff; bytes without one stand for the control character of their number, as in browsers."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[b] = c
    return out


@cache
def to_byte(codec: str) -> dict[str, int]:
    back = {c: b for b, c in table(codec).items()}
    if codec == "cp1252":  # latin-1 leaves the control characters as they are
        for b in range(0x80, 0xA0):
            back.setdefault(chr(b), b)
    return back


def _class(codec: str, lo: int, hi: int) -> str:
    chars = {c for c, b in to_byte(codec).items() if lo <= b <= hi}
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


@cache
def utf8_spans(codec: str) -> re.Pattern[str]:
    """Maximal runs of well-formed UTF-8 multibyte sequences, in the characters of the table."""
    k = lambda lo, hi: _class(codec, lo, hi)
    t = k(0x80, 0xBF)
    return re.compile(
        f"(?:{k(0xC2, 0xDF)}{t}|{k(0xE0, 0xE0)}{k(0xA0, 0xBF)}{t}|{k(0xE1, 0xEC)}{t}{t}|{k(0xED, 0xED)}{k(0x80, 0x9F)}{t}"
        f"|{k(0xEE, 0xEF)}{t}{t}|{k(0xF0, 0xF0)}{k(0x90, 0xBF)}{t}{t}|{k(0xF1, 0xF3)}{t}{t}{t}|{k(0xF4, 0xF4)}{k(0x80, 0x8F)}{t}{t})+"
    )


@cache
def leads(codec: str) -> frozenset[str]:
    """Characters that may begin a multibyte sequence."""
    return frozenset(c for c, b in to_byte(codec).items() if 0xC2 <= b <= 0xF4)


@cache
def trails(codec: str) -> frozenset[str]:
    """Characters that may follow one."""
    return frozenset(c for c, b in to_byte(codec).items() if 0x80 <= b <= 0xBF)


def _kept(e: UnicodeError) -> tuple[str, int]:
    """Bytes that no text has in an encoding stay the characters they came as."""
    t = table("cp1252")
    return "".join(chr(b) if b < 0x80 else t[b] for b in e.object[e.start : e.end]), e.end


KEEP = "leafmill-keep"
codecs.register_error(KEEP, _kept)


#: Letters and marks that ordinary text of the languages at hand has; a span of only these may be no damage at all.
ORDINARY = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿĄąĆćĘęŁłŃńŚśŹźŻżŒœΆ-ώЁА-яё’‘“”„«»–—…\s]+")
#: What a decoded span may consist of to be believed.
PLAUSIBLE = re.compile(
    r"[\x80-ſƒˆ˜Ά-ώЁА-яёऀ-ॿก-๛‐-›€™←-↙♀-♯\u3000-ヿ㐀-鿿\uff00-\uffef]+"
)
LETTER = re.compile(r"[À-ſΆ-ώЁ-ёऀ-ॿก-๛\u3040-ヿ㐀-鿿]")
CONTROLS = re.compile("[\x80-\x84\x86-\x9f]")
HIGH = r"\xa0-\xffŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™\x80-\x9f"
_HIGH = re.compile(f"[{HIGH}]")
#: Letters of the Latin script as in no word of a living language: four accented ones in a row.
HIGH_RUN = re.compile(r"[À-ÖØ-öø-ÿŒœŠšŸ]{4,}|(?<![\w])[À-ÖØ-öø-ÿ]{3}(?!\w)")
WIDE_RUN = re.compile(f"[{HIGH}][{HIGH}@-~]*[{HIGH}](?:[@-~](?![A-Za-z]))?")
#: A sign within a word that is a Polish or Czech letter in another table.
SIGN_IN_WORD = re.compile(r"[a-z][³¹¿][a-z]|\b[a-z]+[³¹](?=[\s,.;:]|$)|[œ\u009c][a-z]?[æ³]|[A-Z]³[a-z]|(?<!\w)¿[a-z]{2,}(?![^?]*\?)")
#: Upper and lower case the wrong way round, as between the two common Cyrillic tables.
CAPITALS = re.compile(r"[А-ЯЁ]{4,}[ ,.][А-ЯЁ]{4,}")
CASE_FLIP = re.compile(rf"[а-я][А-Я]{{3,}}|{CAPITALS.pattern}|[─-■][А-Яа-я─-■]{{2}}")


def mixed_scripts(text: str) -> bool:
    return bool(re.search(r"[À-ſ]", text)) + bool(re.search(r"[Ͱ-Ͽ]", text)) + bool(re.search(r"[Ѐ-ӿ]", text)) > 1


def _bytes(text: str, codec: str) -> bytes:
    back = to_byte(codec)
    return bytes(back[c] if c in back else ord(c) for c in text)


def believed(span: str, got: str, codec: str) -> bool:
    """Whether a span can hardly be what was written: it has signs that ordinary text lacks, letters of two scripts, or much of it is decoded."""
    if not ORDINARY.fullmatch(span) or len(got) >= 4 or mixed_scripts(span):
        return True
    # ordinary signs either way: not a capital letter with its closing quotation mark, nor letters only
    return codec == "cp1252" and span[0] in "ÃÅÐÑÎÏâ" and span[1:] not in ("”", "“", "’", "»") and not span.isalpha()


def _undo_utf8(line: str) -> tuple[str, int]:
    """The line with believable spans decoded, and how many these were; the table whose spans cover most counts."""
    best = (0, line, 0)
    beyond = sum(map(len, _RUN.findall(line)))
    chars = set(line)
    for codec in READ_AS:
        if leads(codec).isdisjoint(chars) or trails(codec).isdisjoint(chars):
            continue
        found = []
        sure = False
        for m in utf8_spans(codec).finditer(line):
            got = _bytes(m.group(), codec).decode("utf-8")  # well-formed
            if PLAUSIBLE.fullmatch(got) and got.strip("\xa0"):
                found.append((m.start(), m.end(), got))
                sure = sure or believed(m.group(), got, codec)
        if not sure:  # what ordinary text may hold as well counts only beside what it cannot
            continue
        parts, at, covered, decoded = [], 0, 0, 0
        for begin, end, got in found:
            parts += [line[at:begin], got]
            at = end
            decoded += end - begin
            covered += end - begin + sum(3 for c in got if LETTER.match(c))
        if covered > best[0]:
            best = (covered, "".join(parts) + line[at:], len(found))
            if decoded == beyond:  # nothing is left for another table
                break
    return best[1], best[2]


def _undo_wide(line: str) -> tuple[str, int]:
    """Runs that are wholly well-formed in an East Asian encoding and give mostly kana and ideographs."""
    best, most = (line, 0), 0.0
    if len(re.findall(f"[{HIGH}]", line)) < 4:
        return best
    for codec in WIDE:
        parts, at, wide, total = [], 0, 0, 0
        for m in WIDE_RUN.finditer(line):
            run = m.group()
            try:
                got = _bytes(run, "cp1252").decode(codec)
            except UnicodeDecodeError:
                got = _bytes(run, "cp1252").decode(codec, KEEP)  # well-formed spans only, the rest stays
                if len(_HIGH.findall(got)) > 2:
                    continue
            kana = len(re.findall(r"[、-。\u3040-ヿ，一-鿿]", got))
            usual = len(re.findall(r"[、-。\u3040-ヿ，。的了在和一是不]", got))
            if kana >= 0.8 * len(got) and kana >= 2:
                parts += [line[at : m.start()], got]
                at = m.end()
                wide += kana + 3 * usual
                total += 1
        if total and wide > most:
            best, most = ("".join(parts) + line[at:], total), wide
    return best if most >= 4 else (line, 0)


#: Lower-case letters by frequency in the scripts at hand, for the choice between single-byte tables.
FREQUENT = {"cyrillic": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", "greek": "αοιετσνηυρπκμλςωδίγόάέχθφβήξζύώψ"}


def _score(text: str) -> float:
    good = sum(2 for c in text if c in "оеаинтсрвлαοιετσνη") + sum(1 for c in text if c in FREQUENT["cyrillic"] or c in FREQUENT["greek"])
    bad = sum(3 for a, b in zip(text, text[1:]) if a.islower() and b.isupper()) + sum(3 for c in text if not c.isalpha())
    return (good - bad) / max(len(text), 1)


#: Mean score of a letter from which a reading as a single-byte table is believed before any other.
GOOD_READING = 1.15


def _read(c: str, back: dict[str, int], codec: str) -> str:
    """A character of one table read by another, where both have it."""
    try:
        return bytes([back[c]]).decode(codec) if c in back else c
    except UnicodeDecodeError:
        return c


def _undo_single(line: str) -> tuple[str, int, float]:
    """The line read by another single-byte table, the number of runs read anew, and the mean score of their letters."""
    best, top = (line, 0, 0.0), 0.0
    if HIGH_RUN.search(line):
        for written in ("cp1251", "cp1253", "koi8_r", "cp866"):
            out, n, score, letters = [], 0, 0.0, 0
            for w in re.split(r"(\s+)", line):
                core = w.strip(".,;:!?()\"'-–0123456789")
                if core and not core.isascii() and all(c in to_byte("cp1252") for c in core):
                    got = _bytes(core, "cp1252").decode(written, KEEP)
                    score += _score(got) * len(got)
                    letters += len(got)
                    n += 1
                    w = w.replace(core, got)
                out.append(w)
            if n and score > top:
                best, top = ("".join(out), n, score / letters), score
        return best
    if SIGN_IN_WORD.search(line):
        got = re.sub(r"[^\x00-\x7f]", lambda m: _bytes(m.group(), "cp1252").decode("cp1250", KEEP) if m.group() in to_byte("cp1252") else m.group(), line)
        return got, 1, GOOD_READING
    if CASE_FLIP.search(line):
        for read, written in (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866")):
            back = to_byte(read)
            got = re.sub(r"[^\x00-\x7f]", lambda m: _read(m.group(), back, written), line)
            s = _score("".join(c for c in got if not c.isascii()))
            if s > top and s > _score("".join(c for c in line if not c.isascii()).lower() if line.upper() == line else "".join(c for c in line if not c.isascii())) + 0.2:
                best, top = (got, 1, s), s
    return best


def restore_line(line: str) -> tuple[str, int, bool]:
    """(text, number of repairs, whole): `whole` is false if damage is left that cannot be restored. Text without damage comes back as it is."""
    if line.isascii():
        return line, 0, True
    n, now = 0, line
    for _ in range(3):  # text may have been through it more than once
        fixed, k = _undo_utf8(now)
        if not k:
            break
        now, n = fixed, n + k
    if n and len(_HIGH.findall(now)) > 0.3 * len(_HIGH.findall(line)):  # spans by chance, in another encoding
        wide = _undo_wide(line)
        if wide[1] and len(_HIGH.findall(wide[0])) < 0.1 * len(_HIGH.findall(line)):
            now, n = wide
    elif not n and REPLACEMENT not in now:
        single, k, good = _undo_single(now)
        wide = (now, 0) if k and good >= GOOD_READING else _undo_wide(now)
        now, n = wide if wide[1] else (single, k)
    whole = REPLACEMENT not in now and not CONTROLS.search(now)
    if not whole and not n:
        n = 1
    return now, n, whole


def restore(text: str | None) -> tuple[str | None, int, bool]:
    """`restore_line` for every line of a text. Null gives null, empty text is whole."""
    if text is None or text.isascii() or not suspicious(text):
        return text, 0, True
    out, n, whole = [], 0, True
    for line in text.split("\n"):
        fixed, k, w = restore_line(line) if not line.isascii() else (line, 0, True)
        out.append(fixed)
        n, whole = n + k, whole and w
    return "\n".join(out), n, whole


@cache
def _pairs() -> re.Pattern[str]:
    """A lead character and a trail character of one table side by side, or signs of the other kinds of damage."""
    both = [f"{_class(c, 0xC2, 0xDF)}{_class(c, 0x80, 0xBF)}|{_class(c, 0xE0, 0xF4)}{_class(c, 0x80, 0xBF)}{{2}}" for c in READ_AS]
    rest = [REPLACEMENT, CONTROLS.pattern, r"[À-ÖØ-öø-ÿŒœŠšŸ]{3,}", "[³¹¿æœ]", CASE_FLIP.pattern, f"[{HIGH}]{{3,}}"]
    return re.compile("|".join([*both, *rest]))


_RUN = re.compile(r"[^\x00-\x7f]+")
#: Most distinct runs that a worker remembers.
CACHE = 200_000
_SUSPECT: dict[str, bool] = {}


def suspicious(text: str) -> bool:
    """Whether a text may be damaged. Its runs beyond ASCII repeat, so that each distinct one is judged once."""
    for run in _RUN.findall(text):
        got = _SUSPECT.get(run)
        if got is None:
            if len(_SUSPECT) > CACHE:
                _SUSPECT.clear()
            got = _SUSPECT[run] = bool(_pairs().search(run))
        if got:
            return True
    return bool(CAPITALS.search(text))  # spans words, so no run beyond ASCII holds it


def restored_with_widths(text: str) -> tuple[str, list[int] | None]:
    """The restored text, and for each of its characters how many of the original it stands for; None where nothing was restored.

    Widths come from aligning the common ends of each line and sharing the rest by the bytes of the restored characters.
    """
    fixed, n, _ = restore(text)
    if not n or fixed == text:
        return text, None
    widths: list[int] = []
    for old, new in zip(text.split("\n"), fixed.split("\n"), strict=True):
        widths += _line_widths(old, new)
        widths.append(1)
    return fixed, widths[:-1]


def _line_widths(old: str, new: str) -> list[int]:
    if len(old) == len(new):
        return [1] * len(new)
    out, at = [], 0
    for k, c in enumerate(new):
        if at < len(old) and old[at] == c and (c.isascii() or len(old) - at == len(new) - k):
            width = 1
        elif k + 1 == len(new):
            width = len(old) - at
        else:  # up to where the next plain character is met again
            size = max(len(c.encode("utf-8", "surrogatepass")), 1)
            width = _twice(old, at, c) if _twice(old, at, c) else size
        out.append(width)
        at += width
    return out if at == len(old) else [1] * (len(new) - 1) + [max(1, len(old) - len(new) + 1)]


def _twice(old: str, at: int, c: str) -> int:
    """Width of a character damaged once or more, found by damaging it again."""
    for codec in READ_AS[:6]:
        t, now = table(codec), c
        for _ in range(3):
            now = "".join(chr(b) if b < 0x80 else t[b] for b in now.encode("utf-8", "surrogatepass"))
            if old.startswith(now, at):
                return len(now)
            loose = "".join(chr(b) for b in c.encode("utf-8", "surrogatepass"))
            if old.startswith(loose, at):
                return len(loose)
    for codec in WIDE:
        try:
            now = _read_wide(c, codec)
        except UnicodeEncodeError:
            continue
        if old.startswith(now, at):
            return len(now)
    return 0


def _read_wide(c: str, codec: str) -> str:
    t = table("cp1252")
    return "".join(chr(b) if b < 0x80 else t[b] for b in c.encode(codec))


def restored(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows of damaged texts: the keys, `restored` text, `repairs` and `whole`. Undamaged, null and empty texts give no row; repeated
    rows stay repeated. Only texts beyond ASCII leave the JVM."""
    few = df.select(*keys, F.col(text).alias("_text")).where(F.octet_length("_text") > F.length("_text"))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [restore(t) for t in b["_text"]]
            out = b[keys].assign(restored=[g[0] for g in got], repairs=[g[1] for g in got], whole=[g[2] for g in got])
            yield out[out["repairs"] > 0]

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", restored string, repairs int, whole boolean"
    return few.mapInPandas(fix, schema)


def found_pages(pages: DataFrame) -> DataFrame:
    """Distinct (doc_id, page) of damaged pages."""
    return restored(page_counts(pages), ["doc_id", "page"]).select("doc_id", "page").distinct()
