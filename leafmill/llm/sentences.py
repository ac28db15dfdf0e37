"""Sentences of documents in any of the languages, however cues and lines cut them.

A document is first read into a stream of spoken text: numbers and times of cues, tags, sound descriptions, songs and speaker labels are
left out, adverts are set apart, and each piece remembers where it stands. Every end mark of the stream, with the quotation marks that close after it,
is a candidate. A maximum-entropy classifier decides each by its neighbouring tokens, their case, length, digits and script,
and the break that follows. It is trained on reliable boundaries of a bounded sample: marks before a change of speaker, a sound, a
song, an advert or the end are boundaries; marks inside a number or a word, or before a small letter, are none, and no more are
those of tokens that are frequent before marks yet never stand before a reliable boundary.

Documents of scripts without spaces whose sentences carry no marks are cut at every space, line end and cue end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import mojibake
from leafmill.session import bounded_sample

#: Most documents to train on.
SAMPLE = 4000
WEIGHTS = 1 << 18
#: Most decisions that a worker remembers.
CACHE = 300_000

CUE, LINE, TURN = "\x1c", "\n", "\x1d"
_TIMES = re.compile(r"[\ufeff \t]*(?:\d+[ \t]+)?\d\d:\d\d:\d\d[,.]\d{3} --> ")
_UPPER = "A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻΆ-ΏΑ-ΫЁА-Я"
_NOISE = re.compile(
    r"(?P<tag><(?!\|)/?[a-zA-Z][^<>]{0,60}>|\{\\[^{}]{0,40}\})"
    r"|(?P<sound>\[[^\[\]]{1,80}\]|\([^()]{1,80}\)|\*[^*]{1,80}\*)"
    r"|(?P<song>[♪♫][^♪♫]{0,200}[♪♫]|[♪♫].*|#[^#]{2,120}#)"
    rf"|(?P<label>(?<![^\s>}}\-–—\])])[{_UPPER}][{_UPPER}'.\- ]{{1,24}}:(?=\s|$))"
    r"|(?P<dash>(?:(?<=>)|(?<=\})|^)[ \t]*[-–—](?=[ \t]?[^\s\-=])[ \t]*)"
)
#: Characters without which a line has no noise but perhaps a label.
_SIGNS = re.compile(r"[<{\[(*♪♫#\-–—:]")
#: What adverts of subtitle makers hold.
_ADVERT = re.compile(
    r"(?i)@[\w-]+\.|\b[\w-]+\.(?:example|com|org|net|tv|info)\b|^\W*-=.*=-\W*$|\bsync(?:ed|hronized)\b|\bripped\b|\bcaptions?\b|\bsubtitle[sd]?\b|\bencoded by\b|\bcorrected by\b|\b(?:translated|transcribed)\b.* by\b|\bpresents$"
)
#: A text without any of these has no advert.
_HINTS = ("@", ".example", ".com", ".org", ".net", ".tv", ".info", "-=", "sync", "ripped", "caption", "subtitle", "encoded by", "corrected by", "transl", "transcribed", "presents")
_CLOSE = r"(?:[ \u00a0\u202f]?»|[\"”“’'」』›])"
_MARK = re.compile(rf"(?P<mark>\.{{2,}}|…+|[.!?…。！？।॥;]+[.!?…]*)(?P<close>{_CLOSE}*)(?=(?P<space>[\s\x1c\x1d]*)(?P<after>[^\s\x1c\x1d]{{0,8}}))")
_OPENERS = "\"“„«「『¡¿‘‚'"
_QUOTES = frozenset("\"“„«「『")
_DENSE = re.compile(r"[\u3040-ヿ㐀-鿿ก-๛]")
_LETTER = re.compile(r"[^\W_]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-\u1fff]")
_DENSE_MARK = re.compile(r"[。！？]")
_THAI = re.compile(r"[ก-๛]")


@dataclass
class Stream:
    text: str
    starts: list[int]  # of pieces in the stream
    origins: list[int]  # of pieces in the document
    adverts: list[int]  # ends of adverts in the document

    def origin(self, at: int) -> int:
        """Place in the document of the character `at` of the stream."""
        k = bisect_right(self.starts, at) - 1
        return self.origins[k] + at - self.starts[k]


_LINES: dict[str, tuple[tuple[str, int, int], ...]] = {}


def _parts(line: str) -> tuple[tuple[str, int, int], ...]:
    """(separator before, begin, end) of the pieces of spoken text in a line; lines are remembered, as many come again."""
    got = _LINES.get(line)
    if got is None:
        if len(_LINES) > CACHE:
            _LINES.clear()
        out, at, before = [], 0, ""
        if _SIGNS.search(line):
            for m in _NOISE.finditer(line):
                if m.start() > at:
                    out.append((before, at, m.start()))
                    before = ""
                at = m.end()
                if m.lastgroup != "tag":
                    before = TURN
        stop = len(line.rstrip())
        if stop > at or before:
            out.append((before, at, max(at, stop)))
        got = _LINES[line] = tuple(out)
    return got


def _cues(text: str) -> list[list[tuple[int, str]]]:
    """The lines of each cue with their places; numbers and times left out."""
    cues: list[list[tuple[int, str]]] = [[]]
    at = 0
    for line in text.split("\n"):
        if " --> " in line and _TIMES.match(line):
            if cues[-1] and cues[-1][-1][1].strip(" \t\r\ufeff").isdigit():
                cues[-1].pop()
            cues.append([])
        elif line and not line.isspace():
            cues[-1].append((at, line))
        at += len(line) + 1
    return cues


def read(text: str) -> Stream:
    """The stream of spoken text of a document."""
    out: list[str] = []
    starts, origins, adverts = [0], [0], []
    size = 0
    low = text.lower()
    hints = sorted(m.start() for h in _HINTS if h in low for m in re.finditer(re.escape(h), low)) if len(low) == len(text) else [0]
    pending = TURN
    for lines in _cues(text):
        if not lines:
            continue
        begin, end = lines[0][0], lines[-1][0] + len(lines[-1][1])
        if hints and (len(low) != len(text) or bisect_right(hints, end) > bisect_right(hints, begin - 1)):
            body = text[begin:end]
            bare = _NOISE.sub(lambda m: "" if m.lastgroup in ("tag", "sound") else m.group(), body).strip()
            if _ADVERT.search(bare) and _LETTER.search(bare):
                stop = len(body.rstrip())
                while tail := re.search(r"(?:<(?!\|)/?[a-zA-Z][^<>\n]{0,60}>|\{\\[^{}\n]{0,40}\})$", body[:stop]):
                    stop = len(body[: tail.start()].rstrip())
                adverts.append(begin + stop)
                pending = TURN
                continue
        pending = TURN if pending == TURN else CUE
        for origin, line in lines:
            for before, a, b in _parts(line):
                pending = before or pending
                if a == b:
                    continue
                if pending:
                    out.append(pending)
                    size += 1
                starts.append(size)
                origins.append(origin + a)
                out.append(line[a:b])
                size += b - a
                pending = ""
            pending = pending or LINE
    out.append(TURN)
    return Stream("".join(out), starts, origins, adverts)


def unmarked(s: str) -> bool:
    """Whether sentences of the stream carry no marks: Thai, or dense script with hardly a mark."""
    dense = len(_DENSE.findall(s))
    letters = len(_LETTER.findall(s))
    if dense * 2 < letters or not dense:
        return False
    if len(_THAI.findall(s)) * 2 > dense:
        return True
    return len(_DENSE_MARK.findall(s)) * 5 < len(s.split())


def _script(c: str) -> str:
    if not c:
        return "end"
    if c.isdigit():
        return "digit"
    if _DENSE.match(c):
        return "dense"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    if c.isalpha():
        return "uncased"
    if c in _OPENERS:
        return "open"
    if c in ",;:":
        return "comma"
    if c in ".…":
        return "dots"
    return "other"


def candidates(s: str) -> Iterator[tuple[int, tuple]]:
    """(end in the stream, description) of each end mark: mark, closing, gap, next script, previous token."""
    last = 0
    for m in _MARK.finditer(s):
        mark, close, space, after = m.group("mark", "close", "space", "after")
        begin, end = m.start(), m.end()
        if ";" in mark and not (begin and _GREEK.match(s[begin - 1])):
            continue
        gap = "turn" if TURN in space or not after else "cue" if CUE in space else "line" if "\n" in space else "space" if space else "none"
        words = s[max(last, begin - 16) : begin].split()
        token = words[-1].lower().lstrip("\"“„«「『¡¿(-–—") if words and not s[begin - 1].isspace() else ""
        closing = ""
        if close:
            lead = s[last:begin].lstrip(" \n\x1c\x1d-–—")
            closing = "inner" if lead[:1] not in _OPENERS and any(o in lead for o in "\"“„«「『‘‚") else "whole"
        elif s[last : last + 6].lstrip(" \n\x1c\x1d-–—")[:1] in _QUOTES:
            closing = "inside"
        first = mark[0]
        if first in "。！？":
            kind = "dense"
        elif first in "।॥":
            kind = "।"
        elif mark == ".":
            kind = "."
        elif first in ".…" and "!" not in mark and "?" not in mark:
            kind = "..."
        else:
            kind = "!?"
        script = _script(after[:1])
        if script == "open":
            script = "open-" + _script(after.lstrip(_OPENERS)[:1])
        yield end, (kind, closing, gap, script, token)
        if (kind in ("dense", "।", "!?") or (kind == "." and gap != "none")) and closing != "inner":
            last = end


def joined(d: tuple) -> bool | None:
    """What holds without any doubt: False inside a number, word or sentence, True before a change of speaker; None else."""
    kind, closing, gap, script, _ = d
    inner = script.removeprefix("open-")
    if script == "comma" and gap in ("none", "space"):
        return False
    if kind == "dense":
        return not (closing == "inner" and gap in ("none",)) if gap != "turn" else True
    if gap == "none":
        if closing and script in ("dense", "uncased"):
            return closing == "whole"
        if kind in ("!?", "।") and script not in ("lower", "digit"):
            return not (closing == "inner")
        return False
    if gap == "turn" and script != "dots":
        return True
    if script == "dots" or inner == "lower" and kind != "।":
        return False
    if kind in ("...", "!?", "।") and closing != "inner" and inner in (("upper",) if kind == "..." else ("upper", "uncased", "dense")):
        return True
    if kind == "..." and inner in ("uncased", "dense", "digit") and gap in ("space", "line"):
        return False
    if closing == "inner" and inner in ("uncased", "dense") and gap in ("space", "line", "cue"):
        return False
    return None


def features(d: tuple) -> list[int]:
    kind, closing, gap, script, token = d
    size = min(len(token), 5)
    digits = "d" if token[-1:].isdigit() else "a"
    plain = gap if gap != "turn" else "line"
    names = [
        "bias", f"k{kind}{closing}", f"k{kind}s{script}", f"s{script}", f"g{plain}s{script}", f"z{kind}{size}{digits}",
        f"t{kind}{token}", f"d{chr(46) in token}{kind}",
    ]
    return [hash_(n) for n in names]


def hash_(name: str) -> int:
    h = 2166136261
    for b in name.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % WEIGHTS


def train(texts: list[str], rounds: int = 150, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of the classifier, from the reliable boundaries of the texts. Without any, marks before a break are boundaries."""
    seen: Counter[tuple] = Counter()
    for t in texts:
        s = read(mojibake.restore(t)[0]).text
        if not unmarked(s):
            seen.update(d for _, d in candidates(s))
    before: Counter[tuple] = Counter()
    final: Counter[tuple] = Counter()
    for d, n in seen.items():
        if d[1] == "inside":  # a quotation goes on, so that no reliable boundary is to be expected
            continue
        before[d[0], d[4]] += n
        if d[2] == "turn":
            final[d[0], d[4]] += n
    share = sum(final.values()) / max(sum(before.values()), 1)
    rows, labels, counts = [], [], []
    for d, n in seen.items():
        key = (d[0], d[4])
        sure = joined(d)
        # a token that should have stood before some reliable boundary by now, but hardly did
        if d[0] == "." and d[1] != "inside" and len(d[4]) <= 5 and before[key] * share >= 4 and final[key] < 0.15 * before[key] * share:
            sure = False
        if sure is not None and d[0] in (".", "...", "!?", "।"):
            rows.append(features(d))
            labels.append(sure)
            counts.append(min(n, 50))
    w = np.zeros(WEIGHTS)
    if not rows or all(labels) or not any(labels):
        w[hash_("bias")] = 2.0
        return w.astype(np.float32)
    x, y, c = np.array(rows), np.array(labels, dtype=float), np.array(counts, dtype=float)
    y_share = (c * y).sum() / c.sum()
    c = c * np.where(y > 0, 0.5 / y_share, 0.5 / (1 - y_share))  # both kinds weigh the same
    seen_by = np.bincount(x.ravel(), weights=np.repeat(c, x.shape[1]), minlength=WEIGHTS) + 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-w[x].sum(axis=1)))
        grad = np.bincount(x.ravel(), weights=np.repeat(c * (y - p), x.shape[1]), minlength=WEIGHTS)
        w += rate * (grad / seen_by * 4 - decay * w)
    return w.astype(np.float32)


class Splitter:
    """A trained classifier with the decisions made so far."""

    def __init__(self, weights: np.ndarray) -> None:
        self.w, self.made = weights, {}

    def decide(self, d: tuple) -> bool:
        got = self.made.get(d)
        if got is None:
            if len(self.made) > CACHE:
                self.made.clear()
            sure = joined(d)
            got = self.made[d] = sure if sure is not None else bool(self.w[features(d)].sum() > 0)
        return got

    def sentences(self, text: str) -> list[tuple[int, str]]:
        """(end in the document's own code points, sentence in one line) of a document; an advert is the text of its cue."""
        clean, widths = mojibake.restored_with_widths(text) if not text.isascii() else (text, None)
        stream = read(clean)
        s, out = stream.text, {}
        if unmarked(s):
            out = {stream.origin(m.end() - 1) + 1: m.group() for m in re.finditer(r"[^\s\x1c\x1d]+", s) if _LETTER.search(m.group())}
        else:
            last = 0
            for end, d in candidates(s):
                if self.decide(d) and _LETTER.search(s, last, end):
                    out[stream.origin(end - 1) + 1] = s[last:end]
                    last = end
            rest = s[last:].rstrip(" \n\r\t\x1c\x1d")
            if _LETTER.search(rest):
                out[stream.origin(last + len(rest) - 1) + 1] = rest
        for end in stream.adverts:
            begin = max(clean.rfind(gap, 0, end) + len(gap) for gap in ("\n\n", "\r\n\r\n"))
            out.setdefault(end, "\n".join(x for x in clean[max(begin, 0) : end].split("\n") if not _TIMES.match(x) and not x.strip().isdigit()))
        found = sorted((end, " ".join(_GAPS.sub(" ", x).split())) for end, x in out.items())
        if widths is not None:
            at = np.concatenate([[0], np.cumsum(widths)])
            found = [(int(at[end]), x) for end, x in found]
        return found

    def ends(self, text: str) -> list[int]:
        """Ends of the sentences of a document, in its own code points."""
        return [end for end, _ in self.sentences(text)]


_GAPS = re.compile(r"[\x1c\x1d]")


def trained(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Fitted on at most SAMPLE documents, picked by hash."""
    kept = documents.where(F.length(F.trim(text)) > 0).select("doc_id", F.col(text).alias("_text"))
    return train([r["_text"] for r in bounded_sample(kept, ["doc_id"], SAMPLE).collect()])


def ends(documents: DataFrame, keys: list[str], weights: np.ndarray, text: str = "text") -> DataFrame:
    """The keys and `end_pos` of every sentence. Null, empty and blank texts give no rows; repeated rows repeat theirs."""
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(sent.value)
        for b in batches:
            found = [splitter.ends(t) for t in b["_text"]]
            at = np.repeat(np.arange(len(b)), [len(f) for f in found])
            out = b[keys].iloc[at].reset_index(drop=True)
            yield out.assign(end_pos=np.array([e for f in found for e in f], dtype=np.int32))

    types = dict(documents.dtypes)
    kept = documents.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    return kept.mapInPandas(split, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", end_pos int")


def sentence_texts(documents: DataFrame, keys: list[str], weights: np.ndarray, text: str = "text") -> DataFrame:
    """(keys, no, end_pos, sentence): every sentence of every document in one line, `no` from 1, without tags, sounds and labels. Null, empty and blank texts give no rows."""
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(sent.value)
        for b in batches:
            got = [(k, no, end, x) for k, t in enumerate(b.column(len(keys)).to_pylist()) for no, (end, x) in enumerate(splitter.sentences(t), 1)]
            if got:
                at, no, end, x = zip(*got, strict=True)
                rows = pa.array(at, pa.int64())
                made = [pa.array(no, pa.int32()), pa.array(end, pa.int32()), pa.array([y.encode("utf-8", "replace").decode() for y in x], pa.string())]
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(rows) for i in range(len(keys))], *made], names=[*keys, "no", "end_pos", "sentence"])

    types = dict(documents.dtypes)
    kept = documents.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    return kept.mapInArrow(split, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", no int, end_pos int, sentence string")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, end_pos) of every sentence of every document; `doc_id` is unique, so that rows are distinct."""
    return ends(documents, ["doc_id"], trained(documents))
