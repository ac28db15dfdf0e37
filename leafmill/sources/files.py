"""Document files as pages, read by a pluggable splitter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.scalars import failure_kind

PAGES = "doc_id string, filename string, page int, text string, status string, error string"


class Splitter(Protocol):
    def pages(self, content: bytes) -> list[str]:
        """Text layer of each page; raises with `encrypted` or `corrupt` in its message."""
        ...


class PlainSplitter:
    """Stand-in: form feeds part the pages of a plain text."""

    def pages(self, content: bytes) -> list[str]:
        if content[:9] == b"%encrypt%":
            raise ValueError("encrypted")
        try:
            return content.decode("utf-8").split("\f")
        except UnicodeDecodeError as e:
            raise ValueError("corrupt: not text") from e


def files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, content, ...) of the files of a folder by name; other files are not opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def split(found: DataFrame, make: Callable[[], Splitter]) -> DataFrame:
    """One pending row for each page, numbered from 1. A file that cannot be read is one row without a page, whose error is its reason; empty content is corrupt, though Spark lists no empty files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = make()
        for b in batches:
            out = []
            for doc, name, content in zip(b["doc_id"], b["filename"], b["content"], strict=True):
                try:
                    if not content:
                        raise ValueError("corrupt: empty file")
                    out += [(doc, name, i, t, "pending", None) for i, t in enumerate(splitter.pages(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001
                    out.append((doc, name, None, None, "error", str(e)[:200]))
            yield pd.DataFrame(out, columns=["doc_id", "filename", "page", "text", "status", "error"]).astype({"page": "Int32"})

    name = F.element_at(F.split("path", "/"), -1)
    keyed = found.select(F.substring(F.sha2("path", 256), 1, 12).alias("doc_id"), F.url_decode(name).alias("filename"), "content")
    return keyed.mapInPandas(run, PAGES)


def failures(pages: DataFrame) -> DataFrame:
    """(doc_id, filename, reason) of the files that could not be read."""
    return pages.where(F.col("page").isNull()).select("doc_id", "filename", failure_kind(F.col("error")).alias("reason"))
