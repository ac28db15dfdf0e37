"""Language of documents and of each stretch of mixed ones.

A multinomial naive Bayes classifier over hashed character n-grams. It is trained on a bounded sample of labelled pages; as
labels are partly wrong and pages partly mixed, the labels only start it: it then relabels the sentences of the sample by
itself and is fitted again. The log-probability matrix (buckets x languages) is broadcast; its size is fixed by parameters.

Scores of n-grams within a word add up to the score of the word, so that each distinct word is scored once per worker:
n-gram indices of all new words of a batch form one sparse batch, summed with numpy. A sentence's score is the sum
over its words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import canonical, mojibake
from leafmill.sources.tables import page_counts

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Most pages to train on.
SAMPLE = 6000
#: Least words (characters for scripts without spaces) of a full sentence.
MIN_WORDS, MIN_CHARS = 5, 6
#: Least words of it that don't begin with a capital letter.
MIN_LOWER = 3
#: Least lead, in nats, over the second language.
MARGIN = 6.0
#: Most distinct words that a worker remembers.
CACHE = 400_000

_HYPHEN = re.compile("[-\xac\xad‐][ \t\r]*\n[ \t]*")
_SENTENCE = re.compile(r"[^.!?;。！？।\n]*(?:\n(?![ \t]*\n)[^.!?;。！？।\n]*)*[.!?;。！？।]?")
_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036fऀ-ःऺ-ॏ]+[^\W\d_]*)*")
_DENSE = re.compile(r"[\u3040-ヿ㐀-鿿豈-\ufaffก-๛]")
_DENSE_RUN = re.compile(r"[\u3040-ヿ㐀-鿿豈-\ufaffก-๛]+")
_END = ".!?;。！？।"


def words_of(sentence: str) -> list[str]:
    """Words; of scripts without spaces, overlapping pairs of characters."""
    found = _WORD.findall(sentence)
    if not _DENSE.search(sentence):
        return found
    out = []
    for w in found:
        if _DENSE.search(w):
            for run in _DENSE_RUN.findall(w):
                out += [run[i : i + 2] for i in range(max(len(run) - 1, 1))]
        else:
            out.append(w)
    return out


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Spans of stretches: sentences, or blocks without an end mark."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.group().strip()]


def ngrams(word: str) -> list[int]:
    w = f"<{word.lower()}>"
    return [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in ORDERS for i in range(len(w) - n + 1)]


def batch(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse batch of words: n-gram indices one after the other, and where each word begins."""
    grams = [ngrams(w) for w in words]
    sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
    return np.concatenate([np.asarray(g, dtype=np.int64) for g in grams]), np.concatenate([[0], np.cumsum(sizes)[:-1]])


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # BUCKETS x langs, float32

    def score(self, words: list[str]) -> np.ndarray:
        flat, starts = batch(words)
        return np.add.reduceat(self.logp[flat], starts, axis=0)


class Scorer:
    """A model with the scores of the words met so far."""

    def __init__(self, model: Model) -> None:
        self.model, self.ids, self.scores = model, {}, np.zeros((0, len(model.langs)), dtype=np.float32)

    def of(self, sentences: list[list[str]]) -> np.ndarray:
        """Log-likelihoods of each sentence under each language."""
        if len(self.ids) > CACHE:
            self.ids, self.scores = {}, self.scores[:0]
        new = list({w for s in sentences for w in s if w not in self.ids})
        if new:
            for w in new:
                self.ids[w] = len(self.ids)
            self.scores = np.concatenate([self.scores, self.model.score(new)])
        out = np.zeros((len(sentences), len(self.model.langs)), dtype=np.float64)
        sizes = np.fromiter(map(len, sentences), dtype=np.int64, count=len(sentences))
        flat = np.fromiter((self.ids[w] for s in sentences for w in s), dtype=np.int64, count=int(sizes.sum()))
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            out[some] = np.add.reduceat(self.scores[flat], starts, axis=0)
        return out


def fit(langs: list[str], sentences: list[list[str]], labels: np.ndarray, smoothing: float = 0.5) -> Model:
    """Counts of n-grams by language, smoothed; a language is no likelier than another beforehand."""
    vocabulary: dict[str, int] = {}
    rows = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in s), dtype=np.int64) for s in sentences]
    k, v = len(langs), len(vocabulary)
    if not v:
        return Model(langs, np.full((BUCKETS, k), -np.log(BUCKETS), dtype=np.float32))
    sizes = np.array([len(r) for r in rows])
    flat_words = np.concatenate(rows)
    flat_labels = np.repeat(labels, sizes)
    keep = flat_labels >= 0
    per_word = np.bincount(flat_words[keep] * k + flat_labels[keep], minlength=v * k).reshape(v, k)
    flat, starts = batch(list(vocabulary))
    spans = np.diff(np.concatenate([starts, [len(flat)]]))
    counts = np.zeros((BUCKETS, k))
    for j in range(k):
        counts[:, j] = np.bincount(flat, weights=np.repeat(per_word[:, j], spans), minlength=BUCKETS)
    counts += smoothing
    return Model(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def readable(text: str) -> str:
    """The text as it was written: encoding damage undone, ordinary characters for look-alike ones, lines' hyphens closed."""
    text = mojibake.restore(text)[0]
    if canonical.at_issue(text):
        text = canonical.plain(text)
    return _HYPHEN.sub("", text)


def full(sentence: str, words: list[str]) -> bool:
    """Whether it is a sentence of running text rather than a heading, a name or a row of data: with enough words, not all capitalised."""
    if sentence.rstrip("\"'”’»」』)\n ")[-1:] not in _END:
        return False
    dense = sum(len(w) == 2 and bool(_DENSE.match(w)) for w in words)
    return dense >= MIN_CHARS or (len(words) >= MIN_WORDS and sum(w[0] == w[0].lower() for w in words) >= MIN_LOWER)


def train(sample: list[tuple[str, str]], langs: list[str], rounds: int = 3) -> Model:
    """From (text, label) pairs; labels outside `langs` only take part once the model labels them itself."""
    known = [x for x in langs if any(label == x for _, label in sample)] or langs
    index = {x: i for i, x in enumerate(known)}
    sentences, labels = [], []
    for text, label in sample:
        clean = readable(text)
        for a, b in sentences_of(clean):
            words = words_of(clean[a:b])
            if full(clean[a:b], words):
                sentences.append(words)
                labels.append(index.get(label, -1))
    given = np.array(labels, dtype=np.int64)
    model = fit(known, sentences, given) if sentences else Model(known, np.full((BUCKETS, len(known)), -np.log(BUCKETS), dtype=np.float32))
    for _ in range(rounds if sentences and len(known) > 1 else 0):
        scores = Scorer(model).of(sentences)
        order = np.sort(scores, axis=1)
        sure = order[:, -1] - order[:, -2] >= MARGIN
        model = fit(known, sentences, np.where(sure, scores.argmax(axis=1), -1))
    return model


def label_names(codes: DataFrame) -> DataFrame:
    """(name, lang): every entry of each row of the reference list, in lower case."""
    return codes.select(F.explode(F.array(*[F.lower(F.trim(c)) for c in ("lang", "iso3", "english_name")])).alias("name"), F.col("lang").alias("code")).distinct()


def named_languages(jobs: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct (doc_id, code) of the languages that the labels of a job name; the reference list is broadcast, being a list of languages."""
    base = F.lower(F.trim(F.regexp_extract("lang", r"^\s*([^-_]*)", 1)))
    return jobs.select(F.col("job_id").alias("doc_id"), base.alias("name")).join(F.broadcast(label_names(codes)), "name").select("doc_id", "code").distinct()


def training_sample(pages: DataFrame, jobs: DataFrame, codes: DataFrame, size: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `size` pages with the language their job names, picked by hash; a third of them are shared out evenly among the languages named, so that rare ones are met."""
    named = named_languages(jobs, codes).groupBy("doc_id").agg(F.min("code").alias("_label"))
    kept = page_counts(pages).where(F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    labelled = kept.select("doc_id", "page").join(named, "doc_id", "left").withColumn("_label", F.coalesce("_label", F.lit("")))  # keys only
    counts = dict(labelled.groupBy("_label").count().collect())  # a row for each language
    whole = sum(counts.values())
    if not whole:
        return []
    share = {label: min(1.0, 1.2 * max(size * 2 / 3 / whole, size / 3 / len(counts) / n)) for label, n in counts.items()}
    bound = F.create_map(*[F.lit(x) for label, x in share.items() for x in (label, x * 1_000_000)])[F.col("_label")]
    thin = labelled.distinct().withColumn("_h", F.pmod(F.xxhash64("doc_id", "page"), F.lit(1_000_000))).where(F.col("_h") < bound)
    keys = thin.withColumn("_p", F.col("_h") / bound).orderBy("_p", "doc_id", "page").limit(size).select("doc_id", "page", "_label").collect()
    picked = pages.sparkSession.createDataFrame([(r["doc_id"], r["page"], r["_label"]) for r in keys], "doc_id string, page int, _label string")
    rows = kept.select("doc_id", "page", F.col("text").alias("_text")).join(F.broadcast(picked), ["doc_id", "page"]).dropDuplicates(["doc_id", "page"])
    return [(r["_text"], r["_label"]) for r in rows.orderBy("doc_id", "page").collect()]


def stretches(df: DataFrame, keys: list[str], model: Model, text: str = "text") -> DataFrame:
    """Rows of `keys`, `seg_no`, `segment`, `lang`, `confidence` and `is_full`: every stretch of every text with its language.

    `segment` is the readable form. Null and blank texts give no rows. `confidence` is the posterior probability, and
    `lang` is null where no word is left to judge by.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        names = np.array([*sent.value.langs, None], dtype=object)
        for b in batches:
            at, no, segments, words = [], [], [], []
            for i, t in enumerate(b["_text"]):
                clean = readable(t)
                for n, (x, y) in enumerate(sentences_of(clean)):
                    at.append(i)
                    no.append(n)
                    segments.append(clean[x:y].strip())
                    words.append(words_of(clean[x:y]))
            if not at:
                continue
            scores = scorer.of(words)
            best = scores.argmax(axis=1)
            top = scores.max(axis=1, keepdims=True)
            p = 1 / np.exp(np.maximum(scores - top, -700)).sum(axis=1)
            best[[not w for w in words]] = len(names) - 1
            out = b[keys].iloc[at].reset_index(drop=True)
            yield out.assign(seg_no=np.array(no, dtype=np.int32), segment=segments, lang=names[best], confidence=p, is_full=[full(s, w) for s, w in zip(segments, words, strict=True)])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", seg_no int, segment string, lang string, confidence double, is_full boolean"
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    return rows.mapInPandas(judge, schema)


def page_languages(df: DataFrame, keys: list[str], model: Model, text: str = "text") -> DataFrame:
    """Rows of `keys` and `lang`: the languages in which a text has at least one full sentence, each once."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    sure = 1 / (1 + np.exp(-MARGIN))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        langs = np.array(sent.value.langs, dtype=object)
        for b in batches:
            at, words = [], []
            for i, t in enumerate(b["_text"]):
                clean = readable(t)
                for x, y in sentences_of(clean):
                    w = words_of(clean[x:y])
                    if full(clean[x:y].strip(), w):
                        at.append(i)
                        words.append(w)
            if not at:
                continue
            scores = scorer.of(words)
            p = 1 / np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -700)).sum(axis=1)
            pairs = sorted({(i, j) for i, j, q in zip(at, scores.argmax(axis=1).tolist(), p, strict=True) if q >= sure})
            if not pairs:
                continue
            out = b[keys].iloc[[i for i, _ in pairs]].reset_index(drop=True)
            yield out.assign(lang=langs[[j for _, j in pairs]])

    types = dict(df.dtypes)
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    return rows.mapInPandas(judge, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", lang string")


def trained(pages: DataFrame, jobs: DataFrame, codes: DataFrame) -> Model:
    langs = [r["lang"] for r in codes.select("lang").distinct().orderBy("lang").collect()]
    return train(training_sample(pages, jobs, codes), langs)


def found(pages: DataFrame, jobs: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct (doc_id, page, lang) of pages with a full sentence in a language that the label of their job does not name."""
    model = trained(pages, jobs, codes)
    got = page_languages(page_counts(pages), ["doc_id", "page"], model).distinct()
    named = named_languages(jobs, codes).withColumnsRenamed({"code": "lang"})
    return got.join(named, ["doc_id", "lang"], "left_anti").select("doc_id", "page", "lang")
