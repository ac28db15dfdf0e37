"""Recognition of page images by a pluggable engine, and what is done to images and lines around it.

The engine itself is not part of this repository: anything with `read(images) -> list of lists of lines` will do. It is made once in each Python
worker and given batches; a page that fails is a row with its error and fails nothing else.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Engines of this worker by name; errors that will not pass are kept as well.
_ENGINES: dict[str, object] = {}
LINE = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64())]))
READ = "doc_id string, page int, source string, status string, text string, error string, confidence double, lines array<struct<text:string,confidence:double>>"


def engine(name: str, make: Callable[[], object]) -> object:
    """The engine of a name, made at its first use in this worker. A missing dependency is remembered and raised again; other failures are tried anew."""
    got = _ENGINES.get(name)
    if isinstance(got, ImportError):
        raise got
    if got is None:
        try:
            got = make()
        except ImportError as e:
            _ENGINES[name] = e
            raise
        _ENGINES[name] = got
    return got


def recognised(images: DataFrame, name: str, make: Callable[[], object], batch: int = 16) -> DataFrame:
    """READ rows of images (doc_id, page, image): text of the lines in order, their confidences rounded to four digits, the mean of the unrounded ones.

    Null and empty images are errors; a page without lines is done with empty text, no confidence and no lines.
    """

    def one(reader: object, content: bytes | None) -> tuple:
        if not content:
            return name, "error", None, "no image", None, None
        return finished(reader.read([content])[0])

    def finished(lines: list[dict]) -> tuple:
        conf = [float(x["confidence"]) for x in lines if x.get("confidence") is not None]
        kept = [{"text": x["text"], "confidence": None if x.get("confidence") is None else round(float(x["confidence"]), 4)} for x in lines]
        return name, "done", "\n".join(x["text"] or "" for x in lines), None, sum(conf) / len(conf) if conf else None, kept or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            contents = b.column(2).to_pylist()
            for at in range(0, len(contents), batch):
                part = contents[at : at + batch]
                try:
                    reader = engine(name, make)
                except Exception as e:  # noqa: BLE001
                    rows += [(name, "error", None, f"{type(e).__name__}: {e}"[:200], None, None)] * len(part)
                    continue
                try:
                    if not all(part):
                        raise ValueError("no image")
                    rows += [finished(lines) for lines in reader.read(part)]
                except Exception:  # noqa: BLE001  the batch is read page by page, so that only the bad page fails
                    for content in part:
                        try:
                            rows.append(one(reader, content))
                        except Exception as e:  # noqa: BLE001
                            rows.append((name, "error", None, f"{type(e).__name__}: {e}"[:200], None, None))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), LINE]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["doc_id", "page", "source", "status", "text", "error", "confidence", "lines"])

    return images.select("doc_id", "page", "image").mapInArrow(run, READ)


def repaired(files: DataFrame, readable: Callable[[bytes], bool], repair: Callable[[bytes], bytes | None]) -> DataFrame:
    """(doc_id, content, outcome) of files (doc_id, content): `whole`, `repaired` after one try, or `corrupt` with the content as it was."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tried(content: bytes | None) -> tuple[bytes | None, str]:
            if content and readable(bytes(content)):
                return content, "whole"
            try:
                better = repair(bytes(content)) if content else None
            except Exception:  # noqa: BLE001
                better = None
            return (better, "repaired") if better and readable(better) else (content, "corrupt")

        for b in batches:
            got = [tried(c) for c in b["content"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(object), "content": pd.Series([g[0] for g in got], dtype=object), "outcome": pd.Series([g[1] for g in got], dtype=object)})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, content binary, outcome string")


def three_channels(image: np.ndarray) -> np.ndarray:
    """An image of one, three or four channels as three: grey is repeated, transparency is laid on white, further channels are dropped."""
    x = image if image.ndim == 3 else image[:, :, None]
    if x.shape[2] == 4:
        alpha = x[:, :, 3:].astype(np.float64) / 255
        return np.round(x[:, :, :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return np.repeat(x[:, :, :1], 3, axis=2) if x.shape[2] < 3 else x[:, :, :3]


def sauvola(grey: np.ndarray, window: int = 25, k: float = 0.2) -> np.ndarray:
    """Black and white by a threshold for each pixel, from mean and deviation of its neighbourhood (running sums, edges mirrored)."""
    pad = window // 2
    x = np.pad(grey.astype(np.float64), pad, mode="reflect" if min(grey.shape) > pad else "edge")

    def mean(v: np.ndarray) -> np.ndarray:
        s = np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2

    m = mean(x)
    deviation = np.sqrt(np.maximum(mean(x * x) - m * m, 0))
    return np.where(grey > m * (1 + k * (deviation / 128 - 1)), 255, 0).astype(np.uint8)


def clamped_skew(angle: float, ink: int) -> float:
    """A skew in degrees as it is used: angles beyond 45 belong to the other edge, at most 15 are turned, images with hardly any ink are left."""
    if ink < 10:
        return 0.0
    a = angle - 90 if angle > 45 else angle
    return float(min(15.0, max(-15.0, a)))


def capped_size(width: Column, height: Column, most: int = 2048) -> Column:
    """(width, height) of an image scaled down so that neither side is longer than `most`."""
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.round(width * share).cast("int")).alias("width"), F.greatest(F.lit(1), F.round(height * share).cast("int")).alias("height"))


def grey_array(content: bytes) -> np.ndarray:
    """A binary grey image (PGM, P5) as an array: the stand-in format of tests."""
    f = io.BytesIO(content)
    if f.readline().strip() != b"P5":
        raise ValueError("not a grey image")
    w, h = map(int, f.readline().split())
    f.readline()
    return np.frombuffer(f.read(w * h), np.uint8).reshape(h, w)
