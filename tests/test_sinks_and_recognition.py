"""Files written, recognition with failing pages, payloads of hostile shape, job control, graphs from pages."""

import json
import os
import sys
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from leafmill import providers
from leafmill.graph import build, search
from leafmill.operators import jobs, pages, recognition
from leafmill.sinks import files
from leafmill.sources import payloads

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see this module

PAGE = "doc_id string, page int, source string, text string, status string, error string, confidence double, lines array<struct<text:string,confidence:double>>"


def some_pages(spark):
    return spark.createDataFrame([("a/b", 2, "ocr", "two <&>\n\x0bx", "done", None, 0.5, None), ("a/b", 1, "text", "one", "done", None, None, None), ("c", 1, None, None, "error", "bad", None, None)], PAGE)


def some_jobs(spark):
    return spark.createDataFrame([("a/b", "Title.pdf", "done", 2), ("a/b", "Title.pdf", "done", 2), ("c", None, "error", 1)], "job_id string, filename string, status string, total_pages int")


def test_files_are_whole(spark, tmp_path):
    p, j = some_pages(spark), some_jobs(spark)
    text = {r["doc_id"]: r["path"] for r in files.write_text(pages.text_blocks(p, j, "txt"), f"{tmp_path}/t", "txt").collect()}
    assert set(text) == {"a/b", "c"} and open(text["a/b"]).read().index("Page 1") < open(text["a/b"]).read().index("Page 2")
    doc = {r["doc_id"]: r["path"] for r in files.write_docx(pages.outline(p, j), f"{tmp_path}/d").collect()}
    words = [t.text for t in ET.fromstring(zipfile.ZipFile(doc["a/b"]).read("word/document.xml")).iter("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t")]
    assert words[0] == "Title.pdf" and "two <&>" in words and "x" in words
    heads = j.distinct().select(F.col("job_id").alias("doc_id"), F.to_json(F.struct("filename", "job_id"), {"ignoreNullFields": "false"}).alias("head"))
    made = {r["doc_id"]: json.load(open(r["path"])) for r in files.write_json(pages.json_rows(p), heads, f"{tmp_path}/j").collect()}
    assert [x["page"] for x in made["a/b"]["pages"]] == [1, 2] and made["c"]["filename"] is None
    node, edge = small_graph(spark)
    heads = spark.createDataFrame([("d", '{"filename":"f"}')], "doc_id string, head string")
    got = json.load(open(files.write_graph_json(build.json_rows(node, edge), heads, f"{tmp_path}/g").first()["path"]))
    assert len(got["entities"]) == 3 and len(got["triples"]) == 2
    assert not [f for d in os.listdir(tmp_path) for f in os.listdir(f"{tmp_path}/{d}") if f.endswith(".part")]
    assert files.write_text(pages.text_blocks(p.limit(0), j, "txt"), f"{tmp_path}/e", "txt").count() == 0


def small_graph(spark):
    t = spark.createDataFrame([("d", 0, 1, "Weir", "feeds", "Canal"), ("d", 1, 2, "Canal", "fills", "Dock")], "doc_id string, seq long, page int, subject string, predicate string, object string")
    node = build.nodes(build.mentions(t))
    return node, build.edges(t, node)


class Reader:
    def read(self, images):
        if any(i == b"bad" for i in images):
            raise RuntimeError("cannot read")
        return [[{"text": w, "confidence": 0.91234567} for w in i.decode().split()] for i in images]


def missing():
    raise ImportError("no engine")


def test_recognition_keeps_failures_in_their_rows(spark):
    df = spark.createDataFrame([("d", 1, b"a b"), ("d", 2, b"bad"), ("d", 3, None), ("d", 4, b" ")], "doc_id string, page int, image binary")
    got = {r["page"]: r for r in recognition.recognised(df, "test-reader", Reader).collect()}
    assert got[1]["text"] == "a\nb" and got[1]["lines"][0]["confidence"] == 0.9123 and got[1]["confidence"] == pytest.approx(0.91234567)
    assert got[2]["status"] == "error" and "cannot read" in got[2]["error"] and got[3]["error"] == "no image"
    assert got[4]["status"] == "done" and got[4]["text"] == "" and got[4]["lines"] is None
    assert {r["status"] for r in recognition.recognised(df, "test-missing", missing).collect()} == {"error"}
    fixed = recognition.repaired(spark.createDataFrame([("a", b"ok"), ("b", b"xok"), ("c", b"zz"), ("d", None)], "doc_id string, content binary"), lambda c: c.startswith(b"ok"), lambda c: c[1:])
    assert {r["doc_id"]: r["outcome"] for r in fixed.collect()} == {"a": "whole", "b": "repaired", "c": "corrupt", "d": "corrupt"}


def test_images():
    rng = np.random.default_rng(0)
    grey = np.clip(200 + rng.normal(0, 4, (60, 80)), 0, 255).astype(np.uint8)
    grey[20:24, 10:60] = 60
    out = recognition.sauvola(grey)
    assert set(np.unique(out)) <= {0, 255} and (out[20:24, 12:58] == 0).all() and (out[:10] == 255).mean() > 0.95
    y, x = 30, 40  # one pixel by hand
    w = grey[y - 12 : y + 13, x - 12 : x + 13].astype(float)
    assert (out[y, x] == 255) == (grey[y, x] > w.mean() * (1 + 0.2 * (w.std() / 128 - 1)))
    assert recognition.three_channels(grey).shape == (60, 80, 3) and (recognition.three_channels(np.zeros((2, 2, 4), np.uint8)) == 255).all()
    assert recognition.clamped_skew(80, 99) == -10 and recognition.clamped_skew(-40, 99) == -15 and recognition.clamped_skew(9, 3) == 0
    assert recognition.grey_array(b"P5\n2 1\n255\n\x01\x02").tolist() == [[1, 2]]


def test_hostile_payloads_and_errors(spark):
    docs = [{"filename": "f", "pages": [{"page": 1, "source": "ocr", "confidence": True, "text": "t"}, 3, None, {"page": "x", "confidence": 0.5, "text": None}]}, "no", {"pages": 7}]
    df = spark.createDataFrame([(json.dumps(docs),), ("{}",), ("nonsense",), (None,)], "body string")
    got = sorted(((r["doc"], r["page_at"] if r["page_at"] is not None else -1, r["page"], r["confidence"], r["text"], r["filename"]) for r in payloads.export_pages(df).collect()), key=lambda r: r[:2])
    assert got == [(0, 0, "1", None, "t", "f"), (0, 1, "x", 0.5, "", "f"), (2, -1, None, None, "", "Document")]
    part = lambda text, **kw: json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}, **kw}]})
    bodies = [part("x", finishReason="MAX_TOKENS"), part(" ", finishReason="SAFETY"), part("", finishReason="STOP"), '{"promptFeedback":{"blockReason":"B"}}', "?"]
    out = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(payloads.transcription(F.col("b"))).collect()]
    assert [(r["text"], r["error"]) for r in out] == [("x", None), (None, "no text: SAFETY"), (None, "empty transcription"), (None, "blocked: B"), (None, "unreadable")]
    e = spark.createDataFrame([(429, '{"error":{"message":" slow ","status":""}}', "r"), (418, "<html>", "teapot"), (404, None, None)], "c int, b string, r string").select(payloads.http_error(F.col("c"), F.col("b"), F.col("r"))).collect()
    assert [tuple(r[0]) for r in e] == [("quota", "RESOURCE_EXHAUSTED", "slow"), ("other", "ERROR", "teapot"), ("model", "NOT_FOUND", "no detail provided")]


def test_job_control(spark):
    s = spark.sql("SELECT * FROM VALUES ('a', 'processing', timestamp'2030-01-01'), ('b', 'done', timestamp'2030-01-01'), ('c', 'done', timestamp'2030-01-01') AS t(job_id, status, last_ts)")
    c = spark.sql("SELECT * FROM VALUES ('a', 1, timestamp'2030-01-02', 'cancel'), ('b', 1, timestamp'2030-01-02', 'cancel'), ('b', 2, timestamp'2030-01-03', 'touch'), ('c', 1, timestamp'2030-01-01', 'delete'), ('c', 2, timestamp'2030-01-01', 'delete'), ('z', 1, timestamp'2030-01-01', 'cancel') AS t(job_id, seq, ts, command)")
    assert {(r["job_id"], r["status"], r["last_ts"].day) for r in jobs.controlled(s, c).collect()} == {("a", "cancelled", 2), ("b", "done", 3)}
    p = spark.sql("SELECT * FROM VALUES ('a', 1, timestamp'2030-01-01 00:01:00'), ('a', 2, timestamp'2030-01-01 00:02:00'), ('a', 3, timestamp'2030-01-01 00:03:00'), ('b', 1, timestamp'2030-01-01') AS t(job_id, page, ended)")
    at = spark.sql("SELECT * FROM VALUES ('a', timestamp'2030-01-01 00:01:30') AS t(job_id, at)")
    got = sorted((r["job_id"], r["seq"], r["type"], r["page"]) for r in jobs.runs(p, at).collect())
    assert [g[:3] for g in got] == [("a", 1, "progress"), ("a", 2, "progress"), ("a", 3, "cancelled"), ("b", 1, "progress"), ("b", 2, "done")]


class Flaky:
    def __init__(self):
        self.inner = providers.PatternExtractor()

    def extract(self, texts):
        if any("boom" in t for t in texts):
            raise providers.ProviderError("bad page")
        return self.inner.extract(texts)


def test_graph_from_pages(spark):
    p = spark.createDataFrame([("d", 1, "ocr", "Old Weir feeds Canal.", "done", None, None, None), ("d", 2, "ocr", "boom", "done", None, None, None), ("d", 3, "ocr", "Canal fills New Dock.", "done", None, None, None)], PAGE)
    node, edge, vectors, told = build.from_pages(p, Flaky, providers.HashEmbedder)
    assert {r["name"] for r in node.collect()} == {"Old Weir", "Canal", "New Dock"} and edge.count() == 2 and vectors.count() == 3
    t = told.first()
    assert (t["pages_built"], t["pages_failed"]) == (2, 1) and "bad page" in t["last_error"]
    with pytest.raises(providers.ProviderError):
        build.from_pages(p.where("page = 2"), Flaky)
    by = search.scores(node, vectors.select("node_id", "vec"), "canal", providers.HashEmbedder().embed(["Canal"])[0]).collect()
    assert {r["mode"] for r in by} == {"vector"}
    by = search.scores(node, vectors.where("node_id > 0").select("node_id", "vec"), "canal", [1.0] * 64).collect()
    assert {r["mode"] for r in by} == {"lexical"} and sum(r["sem"] for r in by) == 1.0


def test_embeddings_one_by_one():
    class Single:
        def embed(self, texts):
            if len(texts) > 1:
                raise providers.ProviderError("one at a time", 404)
            return [[float(len(texts[0]))]]

    assert providers.embed_all(Single(), ["a", "bb"]) == [[1.0], [2.0]]
