"""Engines that are not part of this repository (recognisers, language models), behind one protocol, with deterministic stand-ins.

A provider is made once in each Python worker and given batches; retries stay inside it, so that a task can be repeated.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Texts of a request for embeddings; codes after which a request is tried again.
BATCH = 100
RETRY_CODES = (429, 503)


class Recogniser(Protocol):
    def read(self, images: list[bytes]) -> list[dict]: ...


class Extractor(Protocol):
    def extract(self, texts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ProviderError(RuntimeError):
    def __init__(self, message: str, code: int = 0) -> None:
        super().__init__(message)
        self.code = code


def clean_key(key: str | None) -> str:
    """A usable key; the message of a refusal never holds it."""
    k = (key or "").strip()
    if not k:
        raise ProviderError("no key")
    if not k.isascii() or any(ord(c) < 32 or ord(c) == 127 for c in k):
        raise ProviderError("the key holds characters that no key has")
    return k


def with_retries(call: Callable[[], object], attempts: int = 4, delay: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of a call, tried again after 1, 2, 4 ... delays while the service is busy."""
    for k in range(attempts):
        try:
            return call()
        except ProviderError as e:
            if e.code not in RETRY_CODES or k + 1 == attempts:
                raise
            sleep(delay * 2**k)
    raise AssertionError


class HashEmbedder:
    """Stand-in: words hashed into a unit vector."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in re.findall(r"\w+", t.casefold()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class PatternExtractor:
    """Stand-in: `A verb B.` of capitalised names gives a triple."""

    def extract(self, texts: list[str]) -> list[str]:
        import json

        out = []
        for t in texts:
            triples = [{"subject": a, "predicate": p, "object": b} for a, p, b in re.findall(r"([A-Z]\w+(?: [A-Z]\w+)*) ([a-z]+(?: [a-z]+)?) ([A-Z]\w+(?: [A-Z]\w+)*)", t)]
            inner = json.dumps({"entities": [], "triples": triples})
            out.append(json.dumps({"candidates": [{"content": {"parts": [{"text": inner}]}}]}))
        return out


def embed_all(provider: Embedder, texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Embeddings of some texts: in one request, else one by one where the service cannot take several or answers with too few; busy services are tried again."""
    try:
        got = with_retries(lambda: provider.embed(texts), sleep=sleep)
        if len(got) == len(texts) and all(len(v) for v in got):
            return got
    except ProviderError as e:
        if e.code in (401, 403, *RETRY_CODES):
            raise
    return [with_retries(lambda t=t: provider.embed([t]), sleep=sleep)[0] for t in texts]


def embedded(df: DataFrame, keys: list[str], text: str, make: Callable[[], Embedder]) -> DataFrame:
    """(keys, vec): an embedding of each text, asked for in batches; null texts count as empty."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for b in batches:
            texts = [t or "" for t in b[text]]
            vec = [v for i in range(0, len(texts), BATCH) for v in embed_all(provider, texts[i : i + BATCH])]
            yield b[keys].assign(vec=vec)

    return df.select(*keys, text).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", vec array<double>")


def asked(df: DataFrame, keys: list[str], text: str, make: Callable[[], Extractor], most_chars: int = 100_000) -> DataFrame:
    """(keys, body, error): the response for each text that is not blank; a failure is kept in its row and fails nothing else."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for b in batches:
            bodies, errors = [], []
            for t in b[text]:
                try:
                    bodies.append(with_retries(lambda t=t: provider.extract([t[:most_chars]]))[0] if t and t.strip() else None)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    bodies.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield b[keys].assign(body=bodies, error=errors)

    return df.select(*keys, text).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", body string, error string")
