"""Text of scanned pages as continuous paragraphs: running lines, words cut at line ends, misrecognised characters.

1. Running headers and footers: lines near the top and bottom of pages whose text, as read by a forgiving eye, comes again on a share of
   the pages of the job; lines a few edits away from one of these are running lines too. Page numbers: lines near the edges of which a number
   (Arabic or Roman) follows the page by a constant on most pages that have such a line.
2. The vocabulary is counted over the whole corpus. Its words are broadcast, up to a number of the most frequent ones; the rest of a larger
   vocabulary is joined to the pages that ask for such words.
3. A line ending in a hyphen is joined with the next if the corpus knows the joined word, unless it rather knows the word with its hyphen.
4. A word that the corpus hardly knows is misread if undoing usual confusions of a scanner gives a much more frequent one.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import canonical, mojibake
from leafmill.session import checkpoint, materialised
from leafmill.sources.tables import page_counts

#: Lines looked at from the top and the bottom of a page, share of a job's pages that a running line is on, and least number of them.
EDGE, SHARE, LEAST = 3, 0.2, 2
#: Letters from which a line must come again more often, as lines of the body may.
LONG = 32
#: Least count of a word of the vocabulary, share of all words from which it is frequent, and most words that are broadcast.
LEAST_COUNT, FREQUENT, MOST_WORDS = 6, 1e-6, 500_000
#: How many times more frequent the right word must be, for unknown words, known ones and frequent ones.
RATIO, RATIO_KNOWN, RATIO_FREQUENT = 5, 20, 100
#: Most verdicts that a worker remembers, and letters up to which a part of a text between spaces is remembered: longer ones hardly come again.
CACHE, REMEMBERED = 300_000, 40

#: What a scanner reads, and what was written.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("1", "l"), ("1", "i"), ("ri", "n"), ("n", "ri"), ("rn", "m"), ("m", "rn"), ("rri", "m"), ("ii", "u"), ("u", "ii"), ("ll", "u"), ("cl", "d"), ("d", "cl"),
    ("li", "h"), ("h", "li"), ("h", "ti"), ("h", "b"), ("b", "h"), ("5", "s"), ("s", "5"), ("0", "o"), ("o", "0"), ("0", "о"), ("9", "g"), ("9", "q"), ("6", "b"), ("6", "б"), ("8", "B"), ("f", "t"), ("t", "f"), ("vv", "w"), ("w", "vv"), ("m", "in"), ("in", "m"), ("m", "nn"), ("tl", "d"),
    ("г", "т"), ("т", "г"), ("н", "и"), ("и", "н"), ("н", "п"), ("п", "н"), ("л", "п"), ("п", "л"), ("ь1", "ы"), ("ы", "ьі"), ("3", "з"), ("щ", "ш"), ("ш", "щ"), ("с", "е"), ("е", "с"), ("4", "ч"),
    ("o", "σ"), ("v", "ν"), ("u", "υ"), ("ν", "υ"), ("υ", "ν"), ("0", "ο"), ("α", "ο"), ("ο", "α"), ("θ", "ο"), ("п", "т"), ("z", "2"), ("2", "z"), ("ß", "b"), ("b", "ß"),
)

HYPHENS = "-‐‑\xac\xad"
_BREAK = re.compile(rf"([^\W\d_][\w'’!|]*(?:-[\w'’!|]+)*)[{HYPHENS}][ \t\r\xa0]*$")
_LINE_BREAK = re.compile(rf"[{HYPHENS}][ \t\r\xa0]*\n")
_FIRST = re.compile(r"[ \t\xa0]*([\w!|]+(?:['’!|-][\w!|]+)*)")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOKEN = re.compile(r"[\w!|]+")
_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = re.compile(r"\d+")
_ROMAN = re.compile(r"(?<![^\W_])(?=[ivxlc])(c{0,3})(x[cl]|l?x{0,3})(i[xv]|v?i{0,3})(?![^\W_])")
_PAGE = re.compile(r"\W*(?:(?:page|seite|página|pagina|pág|pag|strona|str|стр|страница|σελίδα|σελ|पृष्ठ|p|s|第|ページ|頁|页)\.?\W*)?(?:\d+|[ivxlc]+)\W*(?:(?:of|von|de|sur|di|z|из|από|/|में से|の)\W*\d+)?\W*(?:页|頁|ページ)?\W*$", re.IGNORECASE)


def roman(text: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(text, [*text[1:], ""], strict=True):
        total += -values[a] if b and values[b] > values[a] else values[a]
    return total


#: Lines put right before.
_LEGIBLE: dict[str, str] = {}


def legible(line: str) -> str:
    """The line without encoding damage and look-alike characters."""
    if line.isascii() or not unclear(line, parts_of(line)):
        return line
    got = _LEGIBLE.get(line)
    if got is None:
        if len(_LEGIBLE) > CACHE:
            _LEGIBLE.clear()
        got = mojibake.restore_line(line)[0] if mojibake.suspicious(line) else line
        if canonical.at_issue(got):
            got = canonical.plain(got)
        _LEGIBLE[line] = got
    return got


_UNCLEAR: dict[str, bool] = {}
#: Parts between spaces in which nothing is unclear.
_CLEAR: set[str] = set()
_CAPITALS = re.compile("[А-ЯЁ]{4}")


def parts_of(text: str) -> set[str]:
    """The distinct parts of a text between spaces and line ends. No word, and no run beyond ASCII, reaches over these."""
    return set(text.replace("\n", " ").split(" "))


def unclear(text: str, parts: set[str]) -> bool:
    """Whether some line may not be legible: both tests on the runs beyond ASCII of each part of the text, each distinct one judged once."""
    capitals = False
    if len(_CLEAR) > CACHE:
        _CLEAR.clear()
    for part in parts - _CLEAR:
        if not part.isascii():
            for run in canonical.RUN.findall(part):
                got = _UNCLEAR.get(run)
                if got is None:
                    if len(_UNCLEAR) > CACHE:
                        _UNCLEAR.clear()
                    got = _UNCLEAR[run] = mojibake.suspicious(run) or canonical.at_issue(run)
                if got:
                    return True
            if _CAPITALS.search(part):
                capitals = True
                continue
        if len(part) <= REMEMBERED:
            _CLEAR.add(part)
    return capitals and bool(mojibake.CAPITALS.search(text))  # these span words


def edge_lines(text: str) -> list[tuple[int, str]]:
    """(line number, text) of the first and last EDGE lines that are not blank."""
    raw = text.split("\n")
    out: list[tuple[int, str]] = []
    for i, line in enumerate(raw):
        if len(out) == EDGE:
            break
        if s := line.strip():
            out.append((i, s))
    low: list[tuple[int, str]] = []
    for i in range(len(raw) - 1, out[-1][0] if out else -1, -1):
        if len(low) == EDGE:
            break
        if s := raw[i].strip():
            low.append((i, s))
    return out + low[::-1]


def forgiving(line: str) -> str:
    """Key of a line (folded, single spaces) by which confusions of a scanner hardly tell."""
    for read, key in _FOLD.items():  # faster than a table; no key is read as another
        line = line.replace(read, key)
    return line


_FOLD = {"rn": "m", "vv": "w", "0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "c": "e", "5": "s", "6": "b", "h": "b", "9": "g", "f": "t", "—": "–", "-": "–"}


_AROUND = " –-.[]()"


def numbered(line: str) -> tuple[str, list[int]]:
    """Template of a line (folded, single spaces) with its numbers as `#`, and the numbers."""
    found = [int(x) for x in _NUMBER.findall(line) if len(x) < 10]
    if found:
        return _NUMBER.sub("#", line), found
    core = line.strip(_AROUND)
    if 0 < len(core) < 16 and (m := _ROMAN.fullmatch(core)):  # no Roman number is longer
        return line.replace(core, "#r"), [roman(m.group())]
    return line, []


#: What was made of lines before; running lines repeat.
_EDGE: dict[str, tuple[str, str | None, list[int], bool]] = {}


def edge_signs(line: str) -> tuple[str, str | None, list[int], bool]:
    """(key, template or None, numbers, whether it looks like a page number) of a line."""
    got = _EDGE.get(line)
    if got is None:
        if len(_EDGE) > CACHE:
            _EDGE.clear()
        clean = " ".join(legible(line).casefold().split())
        template, numbers = numbered(clean)
        got = _EDGE[line] = (forgiving(clean), template if numbers else None, numbers, bool(numbers) and bool(_PAGE.match(clean)))
    return got


def edges(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, first, key, template, numbers, strict): the lines near the edges of each page; of a page written twice they come twice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, first, signs = [], [], [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                for place, (i, line) in enumerate(edge_lines(text)):
                    at.append(k)
                    no.append(i)
                    first.append(not place)
                    signs.append(edge_signs(line))
            if not at:
                continue
            kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_()]
            made = [pa.array(c, t) for c, t in zip(zip(*signs, strict=True), kinds, strict=True)]
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(no, pa.int32()), pa.array(first), *made], names=["doc_id", "page", "line_no", "first", "key", "template", "numbers", "strict"])

    kept = page_counts(pages).where(F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    return kept.select("doc_id", "page", "text").mapInArrow(cut, "doc_id string, page int, line_no int, first boolean, key string, template string, numbers array<long>, strict boolean")


def running_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_no) of running headers, running footers and page numbers; of a page written twice they come twice.

    Keys, templates and offsets of numbers are counted together, in one shuffle, where keys and templates bring their text along; lines are
    moved once, to the few running texts of their document.
    """
    lines = materialised(edges(pages))
    whole_page, whole_key, offset, any_number = range(4)
    template, none = F.xxhash64("template"), F.lit(None).cast("string")

    def sign(of: DataFrame, kind: int, h: Column, x: Column, text: Column) -> DataFrame:
        return of.select("doc_id", "page", F.lit(kind).cast("tinyint").alias("kind"), h.alias("h"), x.cast("int").alias("x"), text.alias("text"))

    made = lines.where(F.col("template").isNotNull())
    each = sign(lines.where("first"), whole_page, F.pmod("page", F.lit(64)).cast("long"), F.lit(0), none)  # of a large document, 64 counts
    each = each.unionAll(sign(lines.where(F.length("key") > 2), whole_key, F.xxhash64("key"), F.length("key"), F.col("key")))
    each = each.unionAll(sign(made, any_number, template, F.lit(0), F.col("template")))
    each = each.unionAll(sign(made.select("doc_id", "page", "template", F.explode("numbers").alias("number")), offset, template, F.col("number") - F.col("page"), none))
    alike = each.repartition("doc_id", "h").distinct().groupBy("doc_id", "kind", "h", "x", "text")
    counted = materialised(alike.agg(F.count("*").alias("n")).where((F.col("n") >= LEAST) | (F.col("kind") == whole_page)))
    size = counted.where(F.col("kind") == whole_page).groupBy("doc_id").agg(F.sum("n").alias("_pages"))
    least = F.greatest(F.lit(LEAST), F.ceil(F.col("_pages") * SHARE))
    long = F.greatest(F.lit(LEAST + 1), F.ceil(F.col("_pages") * SHARE * 1.5))  # long lines may be body
    met = counted.where(F.col("kind") != whole_page).join(size, "doc_id")
    # of a template, the pages with the offset and all pages with the template are compared within one group
    whole = F.max(F.when(F.col("kind") == any_number, F.col("n")))
    best = F.max(F.when(F.col("kind") == offset, F.col("n")))
    by_template = met.where(F.col("kind") != whole_key).groupBy("doc_id", "h", "_pages").agg(best.alias("n"), whole.alias("_t"), F.max("text").alias("text"))
    sequences = by_template.where((F.col("n") >= least) & (F.col("n") >= 0.6 * F.col("_t"))).select("doc_id", F.lit(False).alias("is_key"), "text")
    keys = met.where((F.col("kind") == whole_key) & (F.col("n") >= F.when(F.col("x") < LONG, least).otherwise(long))).select("doc_id", F.lit(True).alias("is_key"), "text")
    both = keys.unionByName(sequences).groupBy("doc_id")
    known = both.agg(F.collect_set(F.when(F.col("is_key"), F.col("text"))).alias("_keys"), F.collect_set(F.when(~F.col("is_key"), F.col("text"))).alias("_made"))  # few for each document
    alone = F.col("strict") & (F.get("numbers", F.lit(0)) == F.col("page"))
    joined = lines.select("doc_id", "page", "line_no", "key", "template", alone.alias("_alone")).join(known, "doc_id", "left")

    def near(text: str, share: float, k: Column) -> Column:
        """Whether a text is so few edits away from `k`, which it is not if their lengths differ by more."""
        edits = F.greatest(F.lit(1), F.floor(F.length(k) * share))
        return (F.abs(F.length(text) - F.length(k)) <= edits) & (F.levenshtein(text, k) <= edits)

    running = F.exists("_keys", lambda k: near("key", 0.25, k))
    sequence = F.exists("_made", lambda k: (F.length(k) > 3) & near("template", 0.2, k))
    # the dearest last: they are not asked where one before is true
    hit = reduce(or_, [F.coalesce(c, F.lit(False)) for c in (F.col("_alone"), F.array_contains("_keys", F.col("key")), F.array_contains("_made", F.col("template")), running, sequence)])
    return joined.where(hit).select("doc_id", "page", "line_no")


def furniture(pages: DataFrame) -> DataFrame:
    """Distinct (doc_id, page, line_no) of running headers, running footers and page numbers."""
    return running_lines(pages).distinct()


class Vocabulary(NamedTuple):
    """words: known words with their counts. frequent: count from which a word is frequent. rest: known words beyond those, null where there are none."""

    words: dict[str, int]
    frequent: float
    rest: DataFrame | None


def vocabulary(pages: DataFrame, most: int = MOST_WORDS) -> Vocabulary:
    """Words of the whole corpus with their counts; of words with hyphens the parts count too. Counted within each batch before the shuffle.

    At most `most` words, the most frequent ones, come to the driver; others stay a table. Repeated rows of a page count again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()
        parts: Counter[str] = Counter()  # between spaces; their words are sought once
        for b in batches:
            for t in b.column(0).to_pylist():
                parts.update(t.split())
            if len(parts) > CACHE:
                add(c, parts)
            if len(c) > CACHE:
                yield counted(c)
                c = Counter()
        add(c, parts)
        if c:
            yield counted(c)

    def add(c: Counter[str], parts: Counter[str]) -> None:
        for part, n in parts.items():
            for w in _WORD.findall(part.lower()):
                c[w] += n
        parts.clear()

    def counted(c: Counter[str]) -> pa.RecordBatch:
        for w, n in [x for x in c.items() if "-" in x[0]]:
            for part in w.split("-"):
                c[part] += n
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    words = page_counts(pages).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = checkpoint(words.where(F.col("n") >= LEAST_COUNT))  # read again, counted once
    known, all_ = kept.agg(F.count("*"), F.sum("n")).first()
    if known <= most:
        return Vocabulary(dict(kept.collect()), (all_ or 0) * FREQUENT, None)
    bands = kept.groupBy(F.floor(F.log2("n") * 16).alias("band")).agg(F.count("*").alias("k"), F.min("n").alias("low")).orderBy(F.desc("band")).collect()
    floor, held = None, 0
    for r in bands:  # a few hundred bands of about equal counts
        if held + r["k"] > most:
            break
        floor, held = r["low"], held + r["k"]
    words_ = dict(kept.where(F.col("n") >= floor).collect()) if floor else {}
    return Vocabulary(words_, all_ * FREQUENT, kept.where(F.col("n") < floor) if floor else kept)


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _wrong, _right in CONFUSIONS:
    _BY_FIRST.setdefault(_wrong[0], []).append((_wrong, _right))
_GROUPS = (("rri", "m"), ("rn", "m"), ("nn", "m"), ("in", "m"), ("ri", "n"), ("ii", "u"), ("ll", "u"), ("cl", "d"), ("tl", "d"), ("li", "h"), ("ti", "h"), ("vv", "w"), ("ь1", "ы"), ("ьі", "ы"))


def blurred(word: str) -> str:
    """The word with characters that a scanner confuses made one; words that two confusions apart nearly always agree."""
    for wrong, right in _GROUPS:
        if wrong in word:
            word = word.replace(wrong, right)
    return word.translate(_CLASSES)


_CLASSES = str.maketrans({c: group[0] for group in ("ec", "li!|1", "s5", "0oоοσαθ", "9gq", "6bhбß", "ft", "нипптгл", "се", "зЗ3", "шщ", "ч4", "vνυuy", "z2", "8B") for c in group})


class Reader:
    """Verdicts on words by a vocabulary."""

    def __init__(self, vocabulary: dict[str, int], frequent: float = 0.0) -> None:
        self.v, self.frequent, self.made = vocabulary, frequent, {}
        self.sound: set[str] = set()  # parts of texts without misread words
        self.blurred = {blurred(w) for w in vocabulary}

    def written(self, word: str) -> str | None:
        """What was written where a scanner read `word` (in lower case); None where nothing speaks for a misreading."""
        if word in self.made:
            return self.made[word]
        if len(self.made) > CACHE:
            self.made.clear()
        own = self.v.get(word, 0)
        best, count = None, max(own * (RATIO_FREQUENT if own >= self.frequent else RATIO_KNOWN), 1)
        if len(_LETTER.findall(word)) > 1:
            once = self._undo(word)
            for w in once:
                n = self.v.get(w, 0)
                if n > count and (own or n >= RATIO):
                    best, count = w, n
            if best is None and not own and len(word) > 3 and blurred(word) in self.blurred:  # two confusions
                for x in once:
                    for w in self._undo(x):
                        n = self.v.get(w, 0)
                        if n > count and n >= RATIO and w != word:
                            best, count = w, n
        self.made[word] = best
        return best

    @staticmethod
    def _undo(word: str) -> set[str]:
        """What was written if one confusion happened."""
        out = set()
        for i, c in enumerate(word):
            if c in _BY_FIRST:
                before, after = word[:i], word[i + 1 :]
                for wrong, right in _BY_FIRST[c]:
                    if len(wrong) == 1:
                        out.add(before + right + after)
                    elif word.startswith(wrong, i):
                        out.add(before + right + word[i + len(wrong) :])
        return out

    def joins(self, head: str, tail: str, sign: str) -> bool:
        """Whether a word was cut at the line end: the corpus knows it joined, or does not rather know it with its hyphen."""
        head, tail = head.lower(), tail.lower()
        last = head.rpartition("-")[2]
        whole = self.v.get(last + tail, 0)
        hyphened = self.v.get(f"{last}-{tail}", 0)
        if whole or hyphened:
            return whole > hyphened
        fixed, fixed_h = self.written(last + tail), self.written(f"{last}-{tail}")
        if fixed or fixed_h:
            return bool(fixed)
        return not (self.v.get(last, 0) and self.v.get(tail, 0) and len(last) > 2 and sign == "-")

    def misread(self, parts: set[str]) -> tuple[set[str], set[str]]:
        """Those of the parts of a text that hold misread words, and these words; parts found sound before are left out at once."""
        at, out = set(), set()
        if len(self.sound) > CACHE:
            self.sound.clear()
        for part in parts - self.sound:
            sound = True
            for t in _TOKEN.findall(part.lower()):
                bare = t
                if t[-1] == "!" and t.rstrip("!") in self.v:
                    bare = t.rstrip("!")
                if self.written(bare):
                    out.add(t)
                    sound = False
            if not sound:
                at.add(part)
            elif len(part) <= REMEMBERED:
                self.sound.add(part)
        return at, out

    def lines(self, text: str, scanned: bool) -> list[tuple[int, str]]:
        """(line number, kind) of the lines that are cut or misread; running lines are not known here."""
        if not scanned and not _LINE_BREAK.search(text):
            return []
        parts = parts_of(text)
        if not text.isascii() and unclear(text, parts):
            text = "\n".join(legible(x) for x in text.split("\n"))
            parts = parts_of(text)
        at, bad = self.misread(parts) if scanned else (set(), set())
        out: set[tuple[int, str]] = set()
        halves: dict[int, tuple[str, str]] = {}  # of the line that is cut
        for m in _LINE_BREAK.finditer(text):
            first = _FIRST.match(text, m.end())
            last = _BREAK.search(text[1 + max(text.rfind(c, 0, m.start()) for c in " \n\t\r\xa0") : m.start() + 1])
            if not first or not last:
                continue
            head, nxt, sign = last.group(1), first.group(1), text[m.start()]
            if nxt[0].isupper() or not self.joins(head, nxt, sign):
                continue
            i = text.count("\n", 0, m.start())
            out.add((i, "hyphen"))
            half = head.rpartition("-")[2]
            halves[i] = (half, nxt)
            if scanned and (right := self.written((half + nxt).lower())):
                word = (half + nxt).lower()
                k = next((j for j, (a, b) in enumerate(zip(word, right)) if a != b), len(word))
                out.add((i if k < len(half) else i + 1, "misread"))
        if bad:
            for i, line in enumerate(text.split("\n")):
                if at.isdisjoint(line.split(" ")):
                    continue
                tokens = _TOKEN.findall(line.lower())
                if i - 1 in halves and tokens and tokens[0] in halves[i - 1][1].lower():  # halves are judged joined
                    tokens = tokens[1:]
                if i in halves and tokens and halves[i][0].lower().endswith(tokens[-1]):
                    tokens = tokens[:-1]
                if not bad.isdisjoint(tokens):
                    out.add((i, "misread"))
        return sorted(out)

    def paragraphs(self, text: str, drop: set[int], scanned: bool) -> str:
        """Continuous paragraphs: running lines dropped, cut words joined, misread words put right. A word cut at the end of the page stays cut."""
        kept = [s for i, x in enumerate(text.split("\n")) if i not in drop for s in [legible(x).strip()]]
        filled = [k for k, s in enumerate(kept) if s]
        following = dict(zip(filled, filled[1:], strict=False))
        done: list[str] = []
        now: list[str] = []
        cut = False
        for k, s in enumerate(kept):
            if not s:
                if not cut and now:
                    done.append("".join(now))
                    now = []
                continue
            if now and not cut and not (canonical_dense(now[-1][-1]) and canonical_dense(s[0])):
                now.append(" ")
            cut = False
            m = _BREAK.search(s[1 + max(s.rfind(c) for c in " \t\xa0") :])
            if m and k in following and (n := _FIRST.match(kept[following[k]])):
                cut = True
                if self.joins(m.group(1), n.group(1), s[-1]) and not n.group(1)[0].isupper():
                    s = s[:-1]
            now.append(s)
        if now:
            done.append("".join(now))
        whole = "\n\n".join(done)
        return _TOKEN.sub(lambda m: self._repaired(m.group()), whole) if scanned else whole

    def _repaired(self, token: str) -> str:
        right = self.written(token.lower())
        if not right:
            return token
        return right.upper() if token.isupper() and len(token) > 2 else right.capitalize() if token[0].isupper() else right


def canonical_dense(c: str) -> bool:
    return "\u3040" <= c <= "ヿ" or "㐀" <= c <= "鿿" or c in "、。，！？"


class Asking(dict):
    """A vocabulary that remembers the words it was asked for in vain."""

    def __init__(self, words: dict[str, int]) -> None:
        super().__init__(words)
        self.asked: set[str] = set()

    def get(self, word: str, default: int = 0) -> int:  # type: ignore[override]
        got = super().get(word)
        if got is None:
            self.asked.add(word)
            return default
        return got


ROW = "doc_id string, page int, source string, text string"


def known_words(pages: DataFrame, v: Vocabulary, run: str) -> DataFrame:
    """The pages (ROW and `_drop`) with `_more`: words of `v.rest` that the reader asks for on each page, with their counts.

    Each page is read once with what is broadcast, and what it asked for in vain is joined with the rest, as are words that blur into the same
    form; only pages for which something is found are read differently. Nothing is done where the whole vocabulary is broadcast.
    """
    none = F.lit(None).cast("map<string,bigint>")
    if v.rest is None:
        return pages.withColumn("_more", none)
    sent = pages.sparkSession.sparkContext.broadcast((v.words, v.frequent))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Asking(sent.value[0])
        reader = Reader(words, sent.value[1])
        for b in batches:
            rows: list[tuple] = []
            for doc, page, source, text, drop in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                words.asked.clear()
                reader.made.clear()
                reader.sound.clear()
                getattr(reader, run)(text, source != "text") if run == "lines" else reader.paragraphs(text, set(drop or ()), source != "text")
                rows += [(doc, page, w, False) for w in words.asked]
                rows += [(doc, page, blurred(t), True) for t in set(_TOKEN.findall(text.lower()))]
            if rows:
                kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "page", "form", "is_blurred"])

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([*words, *map(blurred, words)], pa.string()), pa.array([False] * len(words) + [True] * len(words)), pa.array(words * 2, pa.string()), pa.array(n * 2, pa.int64())], names=["form", "is_blurred", "word", "n"])

    asked = pages.select("doc_id", "page", "source", "text", "_drop").mapInArrow(ask, "doc_id string, page int, form string, is_blurred boolean")
    rest = v.rest.mapInArrow(forms, "form string, is_blurred boolean, word string, n long")
    found_ = asked.join(rest, ["form", "is_blurred"]).select("doc_id", "page", "word", "n").distinct()
    more = found_.groupBy("doc_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("_more"))  # at most the words of one page
    return pages.join(more, ["doc_id", "page"], "left")


def reading(pages: DataFrame, v: Vocabulary, run: str, schema: str, read: Callable[[Reader, str, str, set[int]], list[tuple]]) -> DataFrame:
    """Rows of `schema` made of (doc_id, page) and what `read` gives for each page (ROW and `_drop`)."""
    sent = pages.sparkSession.sparkContext.broadcast((v.words, v.frequent))
    kinds = [{"int": pa.int32(), "string": pa.string()}[f.split(" ")[1]] for f in schema.split(", ")]
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, frequent = sent.value
        reader = Reader(words, frequent)
        for b in batches:
            out: list[tuple] = []
            for doc, page, source, text, drop, more in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                one = reader
                if more:
                    extra = dict(more)
                    one = Reader.__new__(Reader)
                    one.v, one.frequent, one.made, one.sound = ChainMap(extra, words), frequent, {}, set()
                    one.blurred = reader.blurred | {blurred(w) for w in extra}
                out += [(doc, page, *x) for x in read(one, text, source, set(drop or ()))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return known_words(pages, v, run).select("doc_id", "page", "source", "text", "_drop", "_more").mapInArrow(judge, schema)


def line_kinds(pages: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, page, line_no, kind) of cut and misread lines; only pages that are no text layer can be misread."""
    kept = page_counts(pages).where(F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    rows = kept.select("doc_id", "page", "source", "text", F.lit(None).cast("array<int>").alias("_drop"))
    return reading(rows, v, "lines", "doc_id string, page int, line_no int, kind string", lambda reader, text, source, _: reader.lines(text, source != "text"))


def found(pages: DataFrame) -> DataFrame:
    """Distinct (doc_id, page, line_no, kind). Null, empty and unread pages have no lines; a page without others of its job has no running lines but its number."""
    running = running_lines(pages)
    kinds = line_kinds(pages, vocabulary(pages))
    named = ("furniture", "hyphen", "misread")
    each = kinds.unionByName(running.withColumn("kind", F.lit(named[0]))).groupBy("doc_id", "page", "line_no").agg(*[F.max(F.col("kind") == k).alias(k) for k in named])
    body = F.when(F.col("hyphen") & F.col("misread"), F.array(*map(F.lit, named[1:]))).when(F.col("hyphen"), F.array(F.lit("hyphen"))).otherwise(F.array(F.lit("misread")))
    return each.select("doc_id", "page", "line_no", F.explode(F.when(F.col("furniture"), F.array(F.lit("furniture"))).otherwise(body)).alias("kind"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text): each page as continuous paragraphs of clean text."""
    drop = furniture(pages).groupBy("doc_id", "page").agg(F.collect_set("line_no").alias("_drop"))
    kept = page_counts(pages).select("doc_id", "page", "source", "text").dropDuplicates(["doc_id", "page"]).join(drop, ["doc_id", "page"], "left")
    return reading(kept, vocabulary(pages), "paragraphs", "doc_id string, page int, text string", lambda reader, text, source, lines: [(reader.paragraphs(text, lines, source != "text"),)])
