"""Variant spellings of the names of persons and organisations, linked within each job.

1. Each name is read once (`read`): its words in one form, the word of its kind if it is an organisation, initials, numbers. It comes
   under every word it has, each with a second sign: the initial of another word, or the kind of organisation.
2. A symmetric-delete index over the words of a job (each word and all its forms with one letter left out) finds the words that are one
   edit apart. A name is sent under each word it has and under every more frequent neighbour of that word, so that any two words an edit apart meet.
   Persons also come under what their words may be short for and under the ends of each two words, organisations under the starts of two words and
   under all letters: where nicknames, misspelled initials, abbreviations or gaps leave no word in common.
3. The full names that meet are aligned: their words are assigned to each other at least cost, where equal words, small edits, nicknames, initials
   and abbreviations match; names are one if every word of the shorter matches. Candidates come from an inner index of the other words, so that
   names of one family or of one given name are never all compared. Links make entities by hooking and pointer jumping over all jobs at once.
4. Short forms (an initial and a family word, a title and a family word, an organisation without its field, acronyms, abbreviated own words)
   belong to an entity only if just one of the job fits; those that fit none belong together if they are equal.

Numbers in a name must be equal. No word is too common, too short or too rare to count, and no name has too many words: running text (more than
`TEXT_WORDS` words) is linked where all its words are assigned to those of the other at the same costs, or where only its gaps differ (`alike`).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import canonical
from leafmill.session import checkpoint, materialised

#: Titles, and words that say nothing.
TITLES = frozenset("dr mr ms mrs miss prof sir herr frau mme".split())
FILLERS = frozenset("the of for and ltd inc plc gmbh llc de la du des der die das von".split())
#: Fillers that are known misspelled, too.
MISSPELLED = ("and", "the", "for")
#: Words of organisations with their abbreviations.
ORGANISATIONS = {
    "company": "co comp", "corporation": "corp", "society": "soc", "department": "dept dep", "association": "assoc assn", "university": "univ uni",
    "laboratory": "lab labs", "institute": "inst", "foundation": "fdn found fnd", "brothers": "bros bro", "bank": "bk", "college": "coll", "museum": "mus",
    "office": "off", "ministry": "min", "committee": "cttee comm", "council": "cncl", "school": "sch", "hospital": "hosp", "library": "lib", "agency": "agcy", "centre": "ctr center",
}
ABBREVIATED = {a: w for w, short in ORGANISATIONS.items() for a in [w, *short.split()]}
#: Given names and their nicknames.
NICKNAMES = {
    "alexander": "alex sandy sasha xander al", "charlotte": "lottie charlie lotte", "dorothea": "dora dot thea dolly dorothy", "elizabeth": "liz beth lizzie betty eliza bess libby", "frederick": "fred freddie rick fritz",
    "gabriela": "gabi gaby ela gabriele", "helene": "lena helen nelly", "ingrid": "inga inge", "josephine": "josie jo jojo fifi", "jurgen": "jurg jorg juri", "katherine": "kate kathy katie kat kitty kay", "lukasz": "luke lukas luki",
    "margaret": "maggie peggy meg greta madge marge", "nathaniel": "nate nat nathan", "oscar": "ozzie oskar ossie", "philippa": "pippa pip", "quentin": "quent quin", "robert": "rob bob bobby robbie bert", "theodore": "ted theo teddy",
    "urszula": "ula ursula ulla", "viktoria": "vicky vicki tori vika victoria", "william": "bill will billy willy liam", "yannick": "yann yan", "zacharias": "zack zach zak", "james": "jim jimmy jamie", "john": "jack johnny", "richard": "dick rick ricky",
    "michael": "mike mick", "thomas": "tom tommy", "edward": "ed ned eddie", "henry": "harry hal", "susan": "sue susie", "anthony": "tony", "benjamin": "ben", "daniel": "dan danny", "samuel": "sam", "joseph": "joe joey", "rebecca": "becky", "patricia": "pat trish",
}
FORMAL: dict[str, frozenset[str]] = {}
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        FORMAL[_s] = FORMAL.get(_s, frozenset()) | {_name}

#: More words than names have, fillers aside: beyond, nothing may be left out, so that each word must have its partner.
TEXT_WORDS = 64
#: Costs of names that are one stay below `MOST`. No word but an equal one costs less than `LEAST`, so that at most three are not equal.
MOST, LEAST = 0.7, 0.2
UNEQUAL = 3
#: Classes of words by hash: up to three other words on either side leave at least one class as it is.
CLASSES = 2 * UNEQUAL + 1

_PIECE = re.compile(r"[^\W_]+")
#: Gaps within names in Chinese, Japanese or Korean characters, which say nothing.
_HAN_GAP = re.compile(r"(?<=[぀-ヿ㐀-鿿가-힣])[\s·・]+(?=[぀-ヿ㐀-鿿가-힣])")
_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_DROP = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"})
_DIGIT = re.compile(r"\d")
_AS_LETTER = str.maketrans("01356", "olesb")
_OWN_CUT = re.compile(r"\s*[^\W\d_]{4}\.\s")


def fold(word: str) -> str:
    """A word in lower case without accents."""
    w = word.casefold()
    if w.isascii():
        return w
    w = unicodedata.normalize("NFKD", w.translate(_DROP))
    return "".join(c for c in w if not unicodedata.combining(c))


def tokens(name: str) -> tuple[list[str], list[str], int]:
    """(words, numbers, number of words before the first comma): glued words parted, accents and case gone; digits among letters are misread letters."""
    plain = name if name.isascii() else _HAN_GAP.sub("", canonical.plain(name))
    plain = _CAMEL.sub(" ", plain.replace("&", " and "))
    comma = plain.find(",")
    out, numbers, first = [], [], 0
    for m in _PIECE.finditer(plain):
        w = fold(m.group())
        if _DIGIT.search(w):
            letters = sum(c.isalpha() for c in w)
            if letters <= len(w) - letters or _DIGIT.search(w := w.translate(_AS_LETTER)):
                numbers.append(fold(m.group()))
                continue
        if w:
            out.append(w)
            first += comma < 0 or m.start() < comma
    return out, numbers, first


def words(name: str) -> list[str]:
    return tokens(name)[0]


def is_word(w: str) -> bool:
    """Whether a word is more than an initial: of two letters, or of one that stands for a word (Chinese, Japanese, Korean)."""
    return len(w) > 1 or "ᄀ" <= w


def deletes(word: str) -> list[str]:
    """The word and its forms with one letter left out; words of up to three letters only themselves."""
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}] if len(word) > 3 else [word]


def forms(word: str) -> list[str]:
    """As `deletes`, and of words of three letters too, which may stand for one of two letters."""
    return [word, word[1:], word[0] + word[2], word[:2]] if len(word) == 3 else deletes(word)


def near(a: str, b: str) -> bool:
    """Whether at most one letter was added, dropped, changed or swapped with its neighbour."""
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    if a == b:
        return True
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or a[i + 2 :] == b[i + 2 :] and a[i] == b[i + 1] and a[i + 1] == b[i]
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def within_two(a: str, b: str) -> bool:
    """Whether some form with one letter left out of the one is near such a form of the other, or they are near; forms as by `deletes`.

    Walks along both at once: whether a letter of either may still be left out and an edit be made is part of the state, so that time follows the length.
    """
    la, lb = len(a), len(b)
    if abs(la - lb) > 2:
        return False
    stack = [(0, 0, la > 3, lb > 3, True)]
    seen = set(stack)
    while stack:
        i, j, out_a, out_b, edit = stack.pop()
        if i == la and j == lb:
            return True
        step = []
        if edit:
            step += [(i + 1, j, out_a, out_b, False), (i, j + 1, out_a, out_b, False), (i + 1, j + 1, out_a, out_b, False)]
            for u in (1, 2) if out_a else (1,):  # swapped letters, also with the one left out between them
                for v in (1, 2) if out_b else (1,):
                    if i + u < la and j + v < lb and a[i] == b[j + v] and a[i + u] == b[j]:
                        step.append((i + u + 1, j + v + 1, out_a and u == 1, out_b and v == 1, False))
        if out_a:
            step.append((i + 1, j, False, out_b, edit))
        if out_b:
            step.append((i, j + 1, out_a, False, edit))
        if i < la and j < lb and a[i] == b[j]:
            step.append((i + 1, j + 1, out_a, out_b, edit))
        for x in step:
            if x[0] <= la and x[1] <= lb and x not in seen:
                seen.add(x)
                stack.append(x)
    return False


@lru_cache(maxsize=200_000)
def organisation_word(w: str) -> str | None:
    """The word of an organisation's kind that a word is, also abbreviated, or misspelled if it is a long one."""
    got = ABBREVIATED.get(w)
    if got or len(w) < 5:
        return got
    return next((o for o in _BY_FORM.get(w, ()) or {o for d in deletes(w) for o in _BY_FORM.get(d, ())} if near(w, o)), None)


_BY_FORM: dict[str, list[str]] = {}
for _o in ORGANISATIONS:
    for _d in deletes(_o) if len(_o) > 5 else [_o]:
        _BY_FORM.setdefault(_d, []).append(_o)


def formal(w: str) -> tuple[str, ...]:
    """The word, and the given names that it may stand for."""
    return (w, *FORMAL.get(w, ()))


def same_given(a: str, b: str) -> bool:
    """Whether two words may be one given name: equal, a nickname of the other or of a common name, or an edit away from such."""
    fa, fb = formal(a), formal(b)
    return any(x == y or min(len(x), len(y)) > 3 and near(x, y) or min(len(x), len(y)) == 3 != max(len(x), len(y)) and near(x, y) for x in fa for y in fb)


def word_cost(a: str, b: str, person: bool) -> float:
    """Cost of one word for another; 1 where they are different words."""
    if a == b:
        return 0.0
    shorter, longer = (a, b) if len(a) <= len(b) else (b, a)
    if len(shorter) > 3 and near(a, b):
        return 0.2
    if person:
        return 0.25 if same_given(a, b) else 1.0
    return 0.3 if len(shorter) > 2 and longer.startswith(shorter) or 1 < len(shorter) < len(longer) and near(a, b) else 1.0


def least_cost(a: list[str], b: list[str], person: bool) -> tuple[float, list[str]] | None:
    """Optimal assignment of the words of `a` to those of `b`, none of which is equal: (total, words of `b` left over). None if it costs `MOST` or more."""
    if len(a) > min(UNEQUAL, len(b)):
        return None
    costs = [[(j, c) for j, y in enumerate(b) if (c := word_cost(x, y, person)) < MOST] for x in a]
    best: dict[frozenset[int], float] = {frozenset(): 0.0}
    for row in costs:
        step: dict[frozenset[int], float] = {}
        for used, cost in best.items():
            for j, c in row:
                if j not in used and cost + c < min(MOST, step.get(used | {j}, MOST)):
                    step[used | {j}] = cost + c
        best = step
    if not best:
        return None
    used, cost = min(best.items(), key=lambda x: x[1])
    return cost, [y for j, y in enumerate(b) if j not in used]


def aligned(a: "Read", b: "Read") -> bool:
    """Whether two full names are of one entity."""
    if a.numbers != b.numbers or a.kind != b.kind:
        return False
    if len(a.words) > len(b.words):
        a, b = b, a
    rest_a, rest_b = list(a.words), list(b.words)
    for w in a.words:  # equal words go together at no cost
        if w in rest_b:
            rest_a.remove(w)
            rest_b.remove(w)
    if a.kind:
        if len(rest_a) < len(rest_b):  # misspelled words that say nothing
            rest_b = [w for w in rest_b if not any(near(w, f) for f in MISSPELLED)]
        if not rest_a and not rest_b:
            return True
        if len(rest_a) != len(rest_b) and len(a.words) > 1 and rest_a and within_two("".join(rest_a), "".join(rest_b)):  # gaps at other places
            return True
        if len(rest_a) == len(rest_b) > 1 and "".join(rest_a) == "".join(rest_b):
            return True
        return len(rest_a) == len(rest_b) and least_cost(rest_a, rest_b, False) is not None
    got = least_cost(rest_a, rest_b, True)
    return got is not None and _fitting(a.initials, b.initials, got[1])


def alike(a: "Read", b: "Read") -> bool:
    """Whether two running texts are one: their words but fillers go together at the costs of persons or of organisations, or only their gaps differ."""
    if a.numbers != b.numbers:
        return False
    ca, cb = (Counter(w for w in r.words if w not in FILLERS) for r in (a, b))
    rest_a, rest_b = list((ca - cb).elements()), list((cb - ca).elements())
    if len(rest_a) == len(rest_b) and any(least_cost(rest_a, rest_b, person) for person in (False, True)):
        return True
    return a.letters == b.letters != ""


def _fitting(a: str, b: str, left: list[str]) -> bool:
    """Whether the initials of a name do not speak against the other's, whose words `left` are not in the first."""
    rest = list(b)
    letters = [{f[0] for f in formal(w)} for w in left]
    open_ = 0
    for c in a:
        if c in rest:
            rest.remove(c)
        elif (k := next((i for i, s in enumerate(letters) if c in s), None)) is not None:
            letters.pop(k)
        else:
            open_ += 1
    return not open_ or not (rest or letters)


class Read(NamedTuple):
    """A name as read. sort: full, person by initials, bare family word, organisation without its field, short (acronym or abbreviated own word); many (running text)."""

    sort: str
    kind: str
    words: tuple[str, ...]
    initials: str = ""
    numbers: tuple[str, ...] = ()
    handles: tuple[str, ...] = ()
    letters: str = ""  # of all words, where they are enough for running text


def is_acronym(name: str) -> bool:
    bare = name.replace(".", "").strip()
    return len(bare) > 2 and bare.isalpha() and bare.isupper()


def read(name: str) -> Read | None:
    """What a name says; None for one that is neither a person's nor an organisation's."""
    if is_acronym(name):
        return Read("short", "", (), handles=("".join(words(name)),))
    ws, numbers, first = tokens(name)
    if not ws:
        return None
    n = tuple(numbers)
    letters = "".join(ws)
    if len(letters) <= TEXT_WORDS:
        letters = ""
    if len([w for w in ws if w not in FILLERS]) > TEXT_WORDS:
        return Read("many", "", tuple(ws), numbers=n, letters=letters)
    kinds = [organisation_word(w) for w in ws]
    at = next((i for i, k in enumerate(kinds) if k), None)
    if at is not None:
        kind, rest = kinds[at], [(i, w) for i, w in enumerate(ws) if i != at and w not in FILLERS and is_word(w)]
        if not rest or numbers and len(rest) < 2:
            return None
        if _OWN_CUT.match(name) and len(rest) > 1 and not kinds[0] and ws[0] not in TITLES:
            return Read("short", kind, (), handles=(f"{ws[0]}.{kind}{''.join(w for _, w in rest[1:])}",), numbers=n)
        own = next((w for i, w in rest if i >= first > at), None) or rest[0][1]  # behind a comma, or the first
        field = [w for _, w in rest if w != own]
        said = [w for w in ws if w not in (own, ws[at], "the")]
        made = {own[0] + kind[0] + "".join(w[0] for w in said if w not in drop) for drop in ((), ("and",), FILLERS)}
        return Read("full" if field else "field", kind, tuple(w for _, w in rest), numbers=n, handles=(*sorted(made), f"{own[:4]}.{kind}{''.join(field)}") if field else (), letters=letters if field else "")
    titled = any(w in TITLES for w in ws)
    long = [w for w in ws if is_word(w) and w not in TITLES and w not in FILLERS]
    initials = "".join(w for w in ws if not is_word(w))
    if len(long) > 1 or long and "ᄀ" <= long[0][0]:
        return Read("full", "", tuple(long), initials, n, letters=letters)
    if not long or numbers:
        return None
    return Read("initials", "", tuple(long), initials) if initials else Read("bare", "", tuple(long)) if titled else None


def places(r: Read) -> list[tuple[str, str, int]]:
    """(word, sign, rank): where a name is looked for. Signs: initials of the other words and of the given names they stand for, or the kind; with "=" where not words but what is made of several is looked for."""
    if r.sort == "many":
        classes: dict[int, list[str]] = defaultdict(list)
        said = [w for w in r.words if w not in FILLERS]
        for w in sorted(said):
            classes[crc32(w.encode()) % CLASSES].append(w)
        return [(_digest(f"{len(said)} {' '.join(classes[k])}"), f"={k}", 0) for k in range(CLASSES)] + [(_digest(r.letters), "=", 0)]
    if r.sort == "short":
        return []
    text = [(_digest(r.letters), "=", 0)] if r.letters else []  # met there by running text of which only gaps differ
    if r.kind:
        said = sorted(w[:3] for w in r.words if not any(near(w, f) for f in MISSPELLED))
        both = [(" ".join(said), f"=#{r.kind}", 0)] if len(said) == 2 else []  # both may be abbreviated
        return [(w, f"#{r.kind}", 0) for w in dict.fromkeys(r.words)] + both + [("".join(r.words), f"=#{r.kind}", 0), *text]  # and where all gaps differ
    if r.sort == "bare":
        return [(r.words[0], "*", 0)]
    if r.sort == "initials":
        return [(r.words[0], c, k) for k, c in enumerate(r.initials)]
    if len(r.words) == 1:
        return [(r.words[0], "", 0), *text]
    each = [formal(w) for w in r.words]
    out = {(g, f[0]) for i, ws in enumerate(each) for j, o in enumerate(each) if i != j for g in ws for f in o}
    ends = {" ".join(sorted((x[-2:], y[-2:]))) for a, b in combinations(each, 2) for x in a for y in b}  # where all initials are misspelled
    return [(w, c, 0) for w, c in sorted(out)] + [(e, "=@", 0) for e in ends] + text


def _digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


PIECE = "doc_id string, node_id long, sort string, kind string, words string, initials string, numbers string, word string, sign string, rank int, first boolean"


def pieces(nodes: DataFrame) -> DataFrame:
    """One row for each place of each distinct name; `first` marks one row for each of its words. Short forms and their full forms come by handles, as `sort` short and handle."""
    kept = nodes.where(F.col("doc_id").isNotNull() & F.col("node_id").isNotNull() & (F.length(F.trim("name")) > 0))
    kept = kept.select("doc_id", "node_id", "name").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 7 + [pa.int32(), pa.bool_()]
        for b in batches:
            at, rows, held = [], [], 0

            def made() -> pa.RecordBatch:
                ids = pa.array(at, pa.int64())  # noqa: B023
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]  # noqa: B023
                return pa.RecordBatch.from_arrays([b.column(0).take(ids).cast(pa.string()), b.column(1).take(ids), *columns], names=["doc_id", "node_id", "sort", "kind", "words", "initials", "numbers", "word", "sign", "rank", "first"])  # noqa: B023

            for k, name in enumerate(b.column(2).to_pylist()):
                if held > 16 << 20:
                    yield made()
                    at, rows, held = [], [], 0
                r = read(name)
                if r is None:
                    continue
                head = (r.sort, r.kind, " ".join(r.words), r.initials, " ".join(r.numbers))
                seen = set()
                before = len(rows)
                for w, sign, rank in places(r):
                    rows.append((*head, w, sign, rank, w not in seen))
                    seen.add(w)
                    at.append(k)
                for h in r.handles:
                    rows.append(("short" if r.sort == "short" else "handle", "", "", "", head[4], h, "", 0, False))
                    at.append(k)
                held += (len(rows) - before) * (100 + len(head[2]) + len(head[4]))
            if rows:
                yield made()

    return kept.mapInArrow(cut, PIECE)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each run of equal first `keys` columns; runs of one row are left out. At most one run is held beside a batch."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and row[:keys] != held[0][:keys]:
                if len(held) > 1:
                    yield held
                held = []
            held.append(row)
    if len(held) > 1:
        yield held


def stronger(found: DataFrame) -> DataFrame:
    """(doc_id, word, to, weight): the words one edit (of up to three letters: one letter more or less) from a word that are in more names of the job (or come first of equal ones).

    The symmetric-delete index is cut by the ends of words: an edit leaves the first or the last two letters as they are, or of four letters and less the outer ones.
    """
    counted = found.where("first AND length(word) > 1 AND NOT startswith(sign, '=')").groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    w = F.col("word")
    ends = F.array(F.concat(F.lit("<"), F.substring(w, 1, 2)), F.concat(F.lit(">"), F.substring(w, -2, 2)), F.when(F.length(w) <= 4, F.concat(F.lit("="), F.substring(w, 1, 1), F.substring(w, -1, 1))))
    rows = counted.select("doc_id", F.explode(F.array_compact(ends)).alias("end"), "word", "n").repartition("doc_id", "end").sortWithinPartitions("doc_id", "end")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches, 2):
            doc, end = group[0][:2]
            index: dict[str, list[tuple[str, int]]] = {}
            for _, _, x, n in group:
                met = set()
                for d in forms(x):
                    mates = index.setdefault(d, [])
                    for y, m in mates:
                        if y in met or len(x) == len(y) < 4 or not near(x, y):
                            continue
                        met.add(y)
                        if end[0] == ">" and x[:2] == y[:2] or end[0] == "=" and (x[:2] == y[:2] or x[-2:] == y[-2:]):
                            continue  # met at another end
                        out.append((doc, x, y, m) if (m, y) > (n, x) else (doc, y, x, n))
                    mates.append((x, n))
            if len(out) > 50_000:
                yield _batch(out, ["doc_id", "word", "to", "weight"], [pa.string()] * 3 + [pa.int64()])
                out = []
        if out:
            yield _batch(out, ["doc_id", "word", "to", "weight"], [pa.string()] * 3 + [pa.int64()])

    return rows.mapInArrow(pair, "doc_id string, word string, to string, weight long")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _looked(w: str, kind: str) -> set:
    """Forms under which a word is looked for among the other words of a place; those of organisations by hash, as forms of all their words joined are long (meeting by chance does no harm)."""
    return {hash(d) for d in (*forms(w), w[:3])} if kind else {d for f in formal(w) for d in deletes(f)}


class Meeting:
    """The names under one word and sign, of which the full ones are joined if they align."""

    def __init__(self, members: list[tuple[int, Read]], word: str = "", sign: str = "") -> None:
        self.parent: dict[int, int] = {}
        same: dict[tuple, int] = {}
        orders: set[tuple] = set()
        full: list[tuple[int, Read]] = []
        for node, r in members:
            self.parent.setdefault(node, node)
            key = (r.kind, tuple(sorted(r.words)), "".join(sorted(r.initials)), r.numbers)
            if key in same:  # the same but for order, accents and case
                self.join(node, same[key])
            if key not in same or r.kind and (key, r.words) not in orders:  # gaps are compared in the order of the words
                same.setdefault(key, node)
                orders.add((key, r.words))
                full.append((node, r))
        if sign == "=":
            self._join_texts(full)
        elif full and full[0][1].sort == "many":
            self._compare(full)
        elif len(full) > 1:
            self._align(full, word)

    def _join_texts(self, same: list[tuple[int, Read]]) -> None:
        """Names of the same letters are one if one of them is running text."""
        first = {r.numbers: node for node, r in same if r.sort == "many"}
        for node, r in same:
            if r.numbers in first:
                self.join(node, first[r.numbers])

    def _compare(self, texts: list[tuple[int, Read]]) -> None:
        """Running texts that have a class of words in common."""
        said = [frozenset(r.words) - FILLERS for _, r in texts]
        for i, j in combinations(range(len(texts)), 2):
            (x, a), (y, b) = texts[i], texts[j]
            if len(said[i] ^ said[j]) <= 2 * UNEQUAL and self.find(x) != self.find(y) and alike(a, b):
                self.join(x, y)

    def _align(self, full: list[tuple[int, Read]], word: str) -> None:
        """An inner index of the other words; each name looks where its least usual word is, among names with as many words or more.

        Words like that of the place stand in an index of their own, for another word may be like one of them, too.
        """
        index: dict[str | int, list[int]] = defaultdict(list)
        usual: dict[str, list[int]] = defaultdict(list)
        looks: list[list[set]] = []
        for k, (_, r) in enumerate(full):
            others = []
            for w in r.words:
                if w == word or len(word) > 3 and near(w, word):
                    usual[w].append(k)
                else:
                    others.append(w)
            others = others or list(r.words)
            mine = [_looked(w, r.kind) for w in others]
            if r.kind and len(others) > 1:
                mine.append({hash(d) for d in deletes("".join(others))})
            looks.append(mine)
            for d in set().union(*mine):
                index[d].append(k)
        like: dict[str | int, list[str]] = defaultdict(list)
        for w, at in usual.items():
            for d in _looked(w, full[at[0]][1].kind):
                like[d].append(w)
        for k, (node, r) in enumerate(full):
            sought = looks[k] if r.kind else [min(looks[k], key=lambda m: sum(len(index.get(d, ())) for d in m))]
            found_ = {j for m in sought for d in m if d in index for j in index[d]}
            found_ |= {j for w in {w for m in sought if not like.keys().isdisjoint(m) for d in m for w in like.get(d, ())} for j in usual[w]}
            for j in found_:
                other, o = full[j]
                if j == k or len(o.words) < len(r.words) or self.find(node) == self.find(other):
                    continue
                if aligned(r, o):
                    self.join(node, other)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def meetings(placed: DataFrame) -> DataFrame:
    """Rows (role, a, b, doc_id, g, sign, rank, own): `link` of a name to the first one of its entity at one place; `root` of the entities b at a
    place to which short forms come; `short` of such a form a, whose strongest word is `own`."""
    columns = ["doc_id", "g", "sign", "node_id", "sort", "kind", "words", "initials", "numbers", "rank", "own"]
    rows = placed.select(*columns).repartition("doc_id", "g", "sign").sortWithinPartitions("doc_id", "g", "sign")
    names = ["role", "a", "b", "doc_id", "g", "sign", "rank", "own"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def held() -> Iterator[list[tuple]]:
            now: list[tuple] = []
            for b in batches:
                for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if now and row[:3] != now[0][:3]:
                        if len(now) > 1 or now[0][4] != "full":
                            yield now
                        now = []
                    now.append(row)
            if now:
                yield now

        for group in held():
            doc, g, sign = group[0][:3]
            short = [r for r in group if r[4] in ("initials", "field")]
            m = Meeting([(r[3], Read(r[4], r[5], tuple(r[6].split(" ")), r[7], tuple(r[8].split(" ")) if r[8] else ())) for r in group if r[4] in ("full", "many")], g, sign)
            out += [("link", x, p, None, None, None, None, None) for x in m.parent if (p := m.find(x)) != x]
            out += [("short", r[3], None, doc, g, sign, r[9], r[10]) for r in short]
            if short:
                out += [("root", None, p, doc, g, sign, None, None) for p in {m.find(x) for x in m.parent}]
            if len(out) > 20_000:
                yield _batch(out, names, kinds)
                out = []
        if out:
            yield _batch(out, names, kinds)

    return rows.mapInArrow(meet, "role string, a long, b long, doc_id string, g string, sign string, rank int, own string")


def components(links: DataFrame) -> DataFrame:
    """(node, entity): the least id that each node hangs together with; nodes that are the least are not listed. `links` are (a, b), b < a.

    A node hooks its parents to the least of them, then parents are replaced by theirs, until nothing changes; each round is a checkpoint.
    """
    now = checkpoint(links.select("a", "b").distinct())
    while True:
        least = now.groupBy("a").agg(F.min("b").alias("p"))
        hooked = now.join(least, "a")
        step = hooked.select("a", F.col("p").alias("b")).unionByName(hooked.where("b <> p").select(F.col("b").alias("a"), F.col("p").alias("b"))).distinct()
        up = least.select(F.col("a").alias("b"), "p")
        step = step.join(up, "b", "left").select("a", F.coalesce("p", "b").alias("b")).distinct()
        step = checkpoint(step)
        same = step.count() == now.count() and step.join(now, ["a", "b"], "left_anti").isEmpty()
        now = step
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("entity"))


def _only(candidates: DataFrame, entities: DataFrame, key: list[str]) -> DataFrame:
    """(key, low, high): the least and greatest entity of the nodes `b` at each key."""
    of = candidates.join(entities.withColumnRenamed("node", "b"), "b", "left").withColumn("e", F.coalesce("entity", "b"))
    return of.groupBy(*key).agg(F.min("e").alias("low"), F.max("e").alias("high"))


def entities(nodes: DataFrame) -> DataFrame:
    """(node, entity): the nodes of each entity that has several, the least one of them standing for it.

    `node_id` is the key of a node. Null and blank names take no part; repeated rows count once; names that differ only in case, accents or order are one.
    """
    found = materialised(pieces(nodes))
    near_ = checkpoint(stronger(found))
    sought = found.where("sort IN ('full', 'many', 'initials', 'field', 'bare')").withColumn("own", F.col("word"))
    strongest = near_.groupBy("doc_id", "word").agg(F.max_by("to", F.struct("weight", "to")).alias("best"), F.collect_set("to").alias("tos"))  # at most some hundred words are an edit away
    with_near = sought.join(strongest, ["doc_id", "word"], "left")
    placed = with_near.withColumn("own", F.coalesce("best", "word")).withColumn("g", F.explode(F.coalesce(F.array_append("tos", F.col("word")), F.array("word")))).drop("tos", "best")
    placed = materialised(placed.select("doc_id", "g", "sign", "node_id", "sort", "kind", "words", "initials", "numbers", "rank", "own"))
    met = materialised(meetings(placed.where("sort <> 'bare'")))
    first = components(met.where("role = 'link'"))

    # by initials, and organisations without their field: the lowest rank at which something fits must fit one only
    place = ["doc_id", "g", "sign"]
    short = met.where("role = 'short'").select(F.col("a").alias("node"), *place, "rank", "own")
    fits = short.join(_only(met.where("role = 'root'").select("b", *place), first, place), place, "left")
    each = fits.groupBy("node", "rank").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min_by(F.struct("doc_id", "own", "sign"), "rank").alias("_k"))
    chosen = each.groupBy("node").agg(F.min_by(F.struct("low", "high"), F.when(F.col("low").isNotNull(), F.col("rank"))).alias("_f"), F.min_by("_k", "rank").alias("_k"))
    alone = chosen.where("_f IS NULL")
    equal = alone.groupBy("_k").agg(F.min("node").alias("entity"))
    by_short = chosen.where("_f.low = _f.high").select("node", F.col("_f.low").alias("entity")).unionByName(alone.join(equal, "_k").select("node", "entity"))

    # acronyms and abbreviated own words, by the handles of full forms
    handles = found.where("sort = 'handle'").select("doc_id", "word", "numbers", F.col("node_id").alias("b")).distinct()
    cut = found.where("sort = 'short'").select("doc_id", "word", "numbers", F.col("node_id").alias("node"))
    key = ["doc_id", "word", "numbers"]
    few = handles.join(cut.select(*key).distinct(), key, "left_semi")
    fits = cut.join(_only(few, first, key), key, "left").withColumn("_own", F.min("node").over(_by(key)))
    by_handle = fits.where("low IS NULL OR low = high").select("node", F.coalesce("low", "_own").alias("entity"))
    known = checkpoint(first.unionByName(by_short).unionByName(by_handle))

    # a title and a family word, by all persons who have the word
    bare = placed.where("sort = 'bare'").select(F.col("node_id").alias("node"), "doc_id", "g", "own")
    persons = placed.where("sort IN ('full', 'initials') AND kind = ''").select("doc_id", "g", F.col("node_id").alias("b"))
    few = persons.join(bare.select("doc_id", "g").distinct(), ["doc_id", "g"], "left_semi").distinct()
    fits = bare.join(_only(few, known, ["doc_id", "g"]), ["doc_id", "g"], "left")
    each = fits.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.struct("doc_id", "own")).alias("_k"))
    each = each.withColumn("_own", F.min("node").over(_by(["_k"])))
    by_title = each.where("low IS NULL OR low = high").select("node", F.coalesce("low", "_own").alias("entity"))
    named = known.unionByName(by_title).where("node <> entity")
    return named.unionByName(named.select(F.col("entity").alias("node"), "entity").distinct())


def _by(key: list[str]):  # noqa: ANN202
    from pyspark.sql.window import Window

    return Window.partitionBy(*key)


def found(nodes: DataFrame) -> DataFrame:
    """Distinct (node_a, node_b), node_a < node_b, of nodes that name the same person or organisation of a job: all pairs of each entity."""
    each = checkpoint(entities(nodes))
    a, b = each.select(F.col("node").alias("node_a"), "entity"), each.select(F.col("node").alias("node_b"), "entity")
    return a.join(b, "entity").where("node_a < node_b").select("node_a", "node_b")


def pairs_of(members: list[tuple[int, str]]) -> set[tuple[int, int]]:
    """Pairs of full names that align, each compared with each: the plain form, for tests."""
    read_ = [(n, r) for n, name in members if (r := read(name)) and r.sort == "full"]
    m = Meeting([])
    m.parent = {n: n for n, _ in read_}
    for (i, a), (j, b) in combinations(read_, 2):
        if aligned(a, b):
            m.join(i, j)
    return {(min(i, j), max(i, j)) for i, j in combinations(m.parent, 2) if m.find(i) == m.find(j)}
