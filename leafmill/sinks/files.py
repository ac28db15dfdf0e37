"""Exports as files of a shared folder.

The rows of a document come to one task in order and are written as they come, so that no document must fit into a value or into memory. A file
is written under the name of its attempt and renamed at its end: a task that is repeated leaves no half file, and of two attempts the last one stays.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRITTEN = "doc_id string, path string, bytes long"


def safe_name(name: str) -> str:
    """A file name without separators and control characters; never empty, at most 120 characters."""
    kept = "".join("_" if c in "/\\:*?\"<>|" or ord(c) < 32 else c for c in name).strip(". ")
    return kept[:120] or "document"


class TextFile:
    """Blocks of text after each other."""

    def __init__(self, path: str) -> None:
        self.out = open(path, "w", encoding="utf-8", errors="replace", newline="")

    def add(self, kind: str, text: str) -> None:
        self.out.write(text)

    def close(self) -> None:
        self.out.close()


class JsonFile:
    """Rows of `head` (an open object), `item` (elements of its last list) and `tail`."""

    def __init__(self, path: str) -> None:
        self.out, self.some = open(path, "w", encoding="utf-8", errors="replace"), False

    def add(self, kind: str, text: str) -> None:
        if kind == "item":
            self.out.write("," if self.some else "")
            self.some = True
        else:
            self.some = False
        self.out.write(text)

    def close(self) -> None:
        self.out.close()


#: The least parts of a word-processor file.
DOCX_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
DOCX_BODY = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'


class DocxFile:
    """Paragraphs of an outline: h1, h2, p and empty, the last in italics."""

    def __init__(self, path: str) -> None:
        self.zip = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
        for name, part in DOCX_PARTS.items():
            self.zip.writestr(name, part)
        self.out = self.zip.open("word/document.xml", "w", force_zip64=True)
        self.out.write(DOCX_BODY.encode())

    def add(self, kind: str, text: str) -> None:
        style = {"h1": '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>', "h2": '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'}.get(kind, "")
        run = "<w:rPr><w:i/></w:rPr>" if kind == "empty" else "<w:rPr><w:b/></w:rPr>" if style else ""
        self.out.write(f'<w:p>{style}<w:r>{run}<w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'.encode("utf-8", "replace"))

    def close(self) -> None:
        self.out.write(b"</w:body></w:document>")
        self.out.close()
        self.zip.close()


def write_files(rows: DataFrame, folder: str, extension: str, make: Callable[[str], object], order: list[str]) -> DataFrame:
    """(doc_id, path, bytes) of the files written from rows (doc_id, kind, text and the columns of `order`); null text counts as empty. Nothing is written before the result is asked for."""
    sorted_ = rows.where(F.col("doc_id").isNotNull()).repartition("doc_id").sortWithinPartitions("doc_id", *order).select("doc_id", "kind", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        doc, file, part, done = None, None, "", []

        def end() -> None:
            file.close()
            path = os.path.join(folder, f"{safe_name(doc)}.{extension}")
            os.replace(part, path)
            done.append((doc, path, os.path.getsize(path)))

        for b in batches:
            for d, kind, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if d != doc:
                    if file:
                        end()
                    doc, part = d, os.path.join(folder, f".{uuid.uuid4().hex}.part")
                    file = make(part)
                file.add(kind, text or "")
        if file:
            end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "path", "bytes"])

    return sorted_.mapInArrow(write, WRITTEN)


def write_text(blocks: DataFrame, folder: str, extension: str) -> DataFrame:
    """Text exports from the rows of `pages.text_blocks`."""
    return write_files(blocks.select("doc_id", F.lit("block").alias("kind"), F.concat("block", F.lit("\n")).alias("text"), "page"), folder, extension, TextFile, ["page"])


def write_docx(outline: DataFrame, folder: str) -> DataFrame:
    """Word-processor exports from the rows of `pages.outline`."""
    return write_files(outline.select("doc_id", "kind", "text", "page", "seq"), folder, "docx", DocxFile, ["page", "seq"])


def write_json(items: DataFrame, heads: DataFrame, folder: str) -> DataFrame:
    """JSON exports: the fields of each document from `heads` (doc_id, head: an object), its pages from the rows of `pages.json_rows`."""
    open_ = heads.select("doc_id", F.lit("head").alias("kind"), F.concat(F.regexp_replace("head", r"\}\s*$", ""), F.lit(',"pages":[')).alias("text"), F.lit(0).alias("at"), F.lit(0).alias("page"))
    each = items.select("doc_id", F.lit("item").alias("kind"), F.col("json").alias("text"), F.lit(1).alias("at"), "page")
    close = heads.select("doc_id", F.lit("tail").alias("kind"), F.lit("]}").alias("text"), F.lit(2).alias("at"), F.lit(0).alias("page"))
    return write_files(open_.unionByName(each).unionByName(close), folder, "json", JsonFile, ["at", "page"])


def write_graph_json(rows: DataFrame, heads: DataFrame, folder: str) -> DataFrame:
    """Graph exports from the rows of `build.json_rows`: the fields of `heads` (doc_id, head), then entities and triples."""
    part = lambda kind, text, at: heads.select("doc_id", F.lit(kind).alias("kind"), text.alias("text"), F.lit(at).alias("at"), F.lit(0).cast("long").alias("ord"))
    open_ = part("head", F.concat(F.regexp_replace("head", r"\}\s*$", ""), F.lit(',"entities":[')), 0)
    middle, close = part("head", F.lit('],"triples":['), 2), part("tail", F.lit("]}"), 4)
    each = rows.select("doc_id", F.lit("item").alias("kind"), F.col("json").alias("text"), F.when(F.col("kind") == "entity", 1).otherwise(3).alias("at"), "ord")
    return write_files(open_.unionByName(each).unionByName(middle).unionByName(close), folder, "graph.json", JsonFile, ["at", "ord"])
