"""Encoding of a corpus with a public byte-level BPE tokenizer, by speculation and verification.

Greedy longest match proposes the tokens of each new word. A sequence of tokens is what merging gives exactly if every adjacent pair is
compatible, that is if merging the bytes of both gives the same two. Compatibility is tested for all pairs of a batch at once: along the
boundary only the right spine of the left token's merge tree and the left spine of the right one's matter, and both are walked
in the order of merge ranks with numpy. Only words with an incompatible pair are merged exactly.

The tables of a vocabulary (bounded by it) are made once on the driver and broadcast. White-space-led chunks of text are encoded
independently of each other, so that each distinct one is worked out once per worker.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every operator here.
FOLDER = "/opt/tokenizers"
#: Fixed value: how this vocabulary cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as in the pattern; the characters that only `re` takes for it are left out.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Most distinct chunks that a worker remembers.
CACHE = 300_000
FAR = np.int32(2**31 - 1)


@cache
def byte_letters() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable Latin-1 ones stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    ids: dict[bytes, int]
    longest: dict[bytes, int]  # by the first two bytes
    pairs: np.ndarray  # keys of mergeable pairs, sorted
    ranks: np.ndarray  # their ranks
    merged: np.ndarray  # the token each gives
    right: np.ndarray  # token x depth: right spine from its last byte up, then -1
    left: np.ndarray
    rank_of: np.ndarray  # rank of the merge that makes a token, -1 for a byte


@cache
def vocabulary(folder: str = FOLDER, name: str = "byte_bpe_50k") -> Vocabulary:
    model = json.load(open(f"{folder}/{name}.json", encoding="utf-8"))["model"]
    letters = byte_letters()
    vocab = model["vocab"]
    n = max(vocab.values()) + 1
    split = np.full((n, 2), -1, dtype=np.int64)
    rank_of = np.full(n, -1, dtype=np.int32)
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        t = vocab[a + b]
        if rank_of[t] < 0:
            split[t], rank_of[t] = (vocab[a], vocab[b]), rank
    made = np.flatnonzero(rank_of >= 0)
    made = made[np.argsort(rank_of[made])]
    pairs = split[made, 0] * n + split[made, 1]
    order = np.argsort(pairs)
    spines = []
    for side in (1, 0):
        chains: dict[int, list[int]] = {}
        for t in range(n):
            chains[t] = [t]
        for t in made.tolist():
            chains[t] = [*chains[int(split[t, side])], t]
        depth = max(map(len, chains.values()))
        spine = np.full((n, depth + 1), -1, dtype=np.int32)
        for t, c in chains.items():
            spine[t, : len(c)] = c
        spines.append(spine)
    ids = {bytes(letters[c] for c in text): t for text, t in vocab.items() if all(c in letters for c in text) and (rank_of[t] >= 0 or len(text) == 1)}
    longest: dict[bytes, int] = {}
    for b in ids:
        longest[b[:2]] = max(longest.get(b[:2], 1), len(b))
    return Vocabulary(ids, longest, pairs[order], rank_of[made][order], made[order].astype(np.int32), spines[0], spines[1], rank_of)


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        self.v, self.chunks, self.words, self.exact = v, {}, {}, 0
        self.cut = regex.compile(PATTERN).findall
        self.n = len(v.rank_of)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ids, longest = self.v.ids, self.v.longest
        whole = ids.get(word)
        if whole is not None:
            return [whole]
        out, at, end = [], 0, len(word)
        while at < end:
            size = min(longest.get(word[at : at + 2], 1), end - at)
            while size > 1 and word[at : at + size] not in ids:
                size -= 1
            out.append(ids[word[at : at + size]])
            at += size
        return out

    def merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) * self.n + y
        at = np.minimum(np.searchsorted(self.v.pairs, key), len(self.v.pairs) - 1)
        return np.where(self.v.pairs[at] == key, self.v.ranks[at], FAR)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b never crosses their boundary.

        At each moment the pieces at the boundary are x of a and y of b. Next happens the merge of least rank: x grows,
        y grows, or they join; of equal ranks the leftmost comes first.
        """
        v, ok = self.v, np.ones(len(a), dtype=bool)
        i, j = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = v.right[a[live], i[live]], v.left[b[live], j[live]]
            up, down = v.right[a[live], i[live] + 1], v.left[b[live], j[live] + 1]
            rx, ry = np.where(up >= 0, v.rank_of[up], FAR), np.where(down >= 0, v.rank_of[down], FAR)
            m = self.merge_rank(x, y)
            joins = (m < rx) & (m <= ry) & (m < FAR)
            ok[live[joins]] = False
            going = ~joins & ~((rx == FAR) & (ry == FAR))
            grow = rx <= ry
            i[live[going & grow]] += 1
            j[live[going & ~grow]] += 1
            live = live[going]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, in n log n steps."""
        self.exact += 1
        ids = [self.v.ids[word[k : k + 1]] for k in range(len(word))]
        nxt, prv = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        alive = [True] * len(ids)
        v, n = self.v, self.n

        def look(x: int, y: int) -> tuple[int, int] | None:
            key = x * n + y
            at = int(np.searchsorted(v.pairs, key))
            return (int(v.ranks[at]), int(v.merged[at])) if at < len(v.pairs) and v.pairs[at] == key else None

        heap = []
        for k in range(len(ids) - 1):
            if got := look(ids[k], ids[k + 1]):
                heap.append((got[0], k, ids[k], ids[k + 1], got[1]))
        heapq.heapify(heap)
        while heap:
            _, k, x, y, made = heapq.heappop(heap)
            r = nxt[k]
            if not alive[k] or r < 0 or ids[k] != x or ids[r] != y:
                continue
            ids[k], alive[r] = made, False
            nxt[k] = nxt[r]
            if nxt[r] >= 0:
                prv[nxt[r]] = k
                if got := look(made, ids[nxt[r]]):
                    heapq.heappush(heap, (got[0], k, made, ids[nxt[r]], got[1]))
            if prv[k] >= 0 and (got := look(ids[prv[k]], made)):
                heapq.heappush(heap, (got[0], prv[k], ids[prv[k]], made, got[1]))
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def learn_words(self, words: list[str]) -> None:
        """Encode new words: propose all, test all pairs at once, merge the failing ones."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposed = [self.propose(r) for r in raw]
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), dtype=np.int64, count=int(sizes.sum()))
        of = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(of[1:] == of[:-1])
        ok = np.ones(len(words), dtype=bool)
        if len(inner):
            pair = flat[inner] * self.n + flat[inner + 1]
            distinct, back = np.unique(pair, return_inverse=True)
            good = self.compatible(distinct // self.n, distinct % self.n)[back]
            ok[of[inner[~good]]] = False
        for k, w in enumerate(words):
            self.words[w] = proposed[k] if ok[k] else self.merge(raw[k])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets)."""
        if len(self.chunks) > CACHE:
            self.chunks.clear()
            self.words.clear()
        cut = [_CHUNK.findall(t) if t else [] for t in texts]
        once: list[str] = []
        new = {c for chunks in cut for c in chunks if c not in self.chunks}
        if new:
            pieces = {c: self.cut(c) for c in new}
            fresh = {w for p in pieces.values() for w in p if w not in self.words}
            if fresh:
                self.learn_words(list(fresh))
            for c, p in pieces.items():  # those with digits are mostly times, hardly met again
                if any(d in c for d in "0123456789"):
                    once.append(c)
                self.chunks[c] = self.words[p[0]] if len(p) == 1 else [t for w in p for t in self.words[w]]
        get = self.chunks.__getitem__
        out, offsets = [], [0]
        for chunks in cut:
            ids = list(chain.from_iterable(map(get, chunks)))
            out.append(ids)
            offsets.append(offsets[-1] + len(ids))
        for c in once:
            del self.chunks[c]
        return np.fromiter(chain.from_iterable(out), dtype=np.int32, count=offsets[-1]), np.array(offsets, dtype=np.int32)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(key: tuple[str, str], v: Vocabulary) -> Encoder:
    """The encoder of this worker, which keeps what it has met over tasks."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(v)
    return _ENCODERS[key]


def encoded(df: DataFrame, keys: list[str], text: str = "text", out: str = "ids", folder: str = FOLDER, name: str = "byte_bpe_50k", count_only: bool = False) -> DataFrame:
    """The keys of every row with the token ids of its text (`count_only`: with their number). Null and empty texts give an empty list.

    No special tokens are added, and their strings are ordinary text. Rows stay as they are, repeated ones too.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary(folder, name))
    kept = df.select(*keys, F.col(text).alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder((folder, name), sent.value)
        for b in batches:
            flat, offsets = encoder.encode(b.column(len(keys)).to_pylist())
            made = pa.array(np.diff(offsets).astype(np.int32)) if count_only else pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], made], names=[*keys, out])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{out}` " + ("int" if count_only else "array<int>")
    return kept.mapInArrow(encode, schema)


def document_ids(documents: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encoded(documents, ["doc_id"], folder=folder)
