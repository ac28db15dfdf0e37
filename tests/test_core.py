"""Core operators: queries against their SQL, and single rules."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill import providers
from leafmill.functions import scalars, text, vector
from leafmill.graph import build, search
from leafmill.operators import headers, jobs, layout, pages, recommend
from leafmill.plans import oracle, queries
from leafmill.sources import payloads
from leafmill.streaming import jobs as streaming

DATA = "/root/testdata/sf0.001"
PAGE = "doc_id string, page int, source string, text string, status string, error string, confidence double, lines array<struct<text:string,confidence:double>>"


def canon(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in columns) for r in df.collect())
    r = duck.execute(oracle.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(canon(x[i]) for i in at) for x in r.fetchall())


def make_pages(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i, "ocr", t, "done", None, 0.9, None) for i, t in enumerate(texts, 1)], PAGE)


def strip(spark, texts, **kw):
    return [r["text"] for r in headers.stripped(make_pages(spark, texts), **kw).orderBy("page").collect()]


def test_headers_removed_and_dates_kept(spark):
    texts = [f"Harbour survey, vol. 2\n2031-11-1{i}\nfirst of sheet {i}\nsecond of sheet {i}\nthird {i}\n\n- {i} -" for i in range(1, 5)]
    got = strip(spark, texts)
    assert got[0] == "2031-11-11\nfirst of sheet 1\nsecond of sheet 1\nthird 1"


def test_headers_short_documents_and_no_running_lines_stay(spark):
    two = ["H\na\n\n\n\nb\nF", "H\nc\nd\nF"]
    assert strip(spark, two) == two
    other = ["\nx\n\n\n\ny\n", "z\nw", "", "q\nr"]
    assert strip(spark, other) == other


def test_headers_page_never_emptied(spark):
    got = strip(spark, ["HEAD\nFOOT", "HEAD\nFOOT", "HEAD\nFOOT", None])
    assert got[:3] == ["HEAD\nFOOT"] * 3 and got[3] == ""


@pytest.mark.parametrize(("line", "key"), [("Page 3 of 9", "page # of #"), (" 12 ", "#"), ("- 7 -", "- # -"), ("1,234.56", "1,234.56"), ("2026-01-02", "2026-01-02"), ("Chapter 3", "chapter 3"), ("A  B", "a b"), ("", "")])
def test_line_key(spark, line, key):
    assert spark.range(1).select(text.line_key(F.lit(line))).first()[0] == key


def test_best_pages_ties_nulls_and_repeats(spark):
    df = spark.createDataFrame([("d", 1, None, "", "pending", None, None, None), ("d", 1, "ocr", "t", "done", None, 0.5, [("t", 0.5)]), ("d", 1, "ocr", "t", "done", None, 0.5, [("t", 0.5)]), ("e", None, None, None, None, None, None, None)], PAGE)
    got = {(r["doc_id"], r["page"]): r["text"] for r in pages.best_pages(df).collect()}
    assert got == {("d", 1): "t", ("e", None): None}
    assert pages.best_pages(df.limit(0)).count() == 0


def realign(cleaned, lines):
    if not lines:
        return None
    out, at = [], 0
    for c in cleaned.split("\n"):
        while at < len(lines) and lines[at][0] != c:
            at += 1
        out.append(lines[at] if at < len(lines) else (c, None))
        at += at < len(lines)
    return out


@pytest.mark.parametrize(("cleaned", "lines"), [("b\nd", [("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 0.4)]), ("x\nb", [("a", 0.1), ("b", 0.2)]), ("a\na", [("a", 0.1), ("z", 0.2), ("a", 0.3)]), ("a", []), ("", [("", 0.5)])])
def test_realign(spark, cleaned, lines):
    df = spark.createDataFrame([(cleaned, lines)], "c string, l array<struct<text:string,confidence:double>>")
    got = df.select(pages.realigned(F.col("c"), F.col("l")).alias("r")).first()[0]
    assert (None if got is None else [tuple(x) for x in got]) == realign(cleaned, lines)


def test_search_counts_and_segments(spark):
    df = make_pages(spark, ["aAaA\nxaa", None, "", "aa" * 1000])
    assert {r["page"]: r["matches"] for r in pages.search(df, "aa").collect()} == {1: 3, 4: 1000}
    assert pages.search(df, "  ").count() == 0
    got = spark.range(1).select(text.matched_segments(F.lit("one Two one"), "TWO").alias("s")).first()[0]
    assert [(x["text"], x["is_match"]) for x in got] == [("one ", False), ("Two", True), (" one", False)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.route(F.lit(True), F.lit(False), F.lit(True), F.lit("k"), F.lit(True))) == "text"
    assert one(scalars.route(F.lit(True), F.lit(True), F.lit(True), F.lit(" "), F.lit(True))) == "handwriting"
    assert one(scalars.route(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.lit(None).cast("boolean"))) == "ocr"
    assert one(scalars.heading_tag(F.lit("ocr"), F.lit(float("nan")))) == " — OCR" and one(scalars.heading_tag(F.lit("ocr"), F.lit(0.125))) == " — OCR (12%)"
    assert one(scalars.page_limit(F.lit("x"))) is None and one(scalars.page_limit(F.lit("-4"))) == 0 and one(scalars.page_limit(F.lit(" 7 "))) == 7
    assert one(scalars.script_model(F.lit("Hindi"))) == "hi" and one(scalars.script_model(F.lit(None).cast("string"))) == "en"
    assert one(scalars.first_filled(F.lit(" "), F.lit("a"))) == "a"
    assert one(scalars.page_tag(F.array(F.lit(1), F.lit(2)))) == "p.1, 2" and one(scalars.http_failure(F.lit(503))) == "server"
    assert one(text.xml_safe(F.lit("a\x00b\tc"))) == "ab\tc" and one(text.tidy(F.lit("\n\na\n\n\n\nb\n"))) == "a\n\nb"
    assert one(text.unfenced(F.lit("```json\n{\"a\": \"`x`\"}\n```"))) == '{"a": "`x`"}'


def test_vectors(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(vector.normalised(arr(3, 4))) == [0.6, 0.8] and one(vector.normalised(arr(0, 0))) == [0.0, 0.0]
    assert one(vector.cosine01(arr(1, 0), arr(-2, 0))) == 0.0 and one(vector.cosine01(arr(1, 0), arr(1, 0, 0))) is None and one(vector.cosine01(arr(1, 0), arr(0, 0))) is None


def test_reading_order_anchor(spark):
    boxes = spark.createDataFrame([("p", 0.0, 5.0, 10.0, "b", 1.0), ("p", 5.0, 1.0, 10.0, "a", 1.0), ("p", 10.0, 0.0, 10.0, "c", 1.0), ("p", None, 0.0, 1.0, "lost", 1.0)], "page string, y double, x double, h double, text string, confidence double")
    got = [(r["row_no"], r["text"]) for r in layout.reading_order(boxes, ["page"]).orderBy("pos").collect()]
    assert got == [(0, "a"), (0, "b"), (1, "c")]  # c is within reach of a, not of the first of the row


def test_block_text(spark):
    kind = "array<struct<type:int,bbox:array<double>,lines:array<struct<spans:array<struct<text:string>>>>>>"
    blocks = [(0, [0.0, 9.0, 1.0, 1.0], [([("se",), ("cond",)],)]), (1, [0.0, 0.0, 1.0, 1.0], [([("image",)],)]), (0, [0.0, 1.0, 1.0, 1.0], [([("first",)],), ([("line",)],)]), (0, [0.0, 5.0], [])]
    df = spark.createDataFrame([(blocks,)], f"b {kind}")
    assert df.select(layout.block_text(F.col("b"))).first()[0] == "first\nline\n\nsecond"


def test_agreement_counts_other_settings_only(spark):
    lines = spark.createDataFrame([(1, "a", "one two", 0.9), (1, "b", "one", 0.9), (1, "c", "zzz qqq", 0.9), (1, "d", "low", 0.1)], "page_id int, config string, text string, confidence double")
    got = {r["config"]: r["agree"] for r in recommend.agreement(lines).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 0.0}
    assert {r["config"]: r["score"] for r in recommend.scored(lines).collect()}["d"] < 0.3


TRIPLES = "doc_id string, seq long, page int, subject string, predicate string, object string"


def small_graph(spark, rows):
    t = spark.createDataFrame(rows, TRIPLES)
    node = build.nodes(build.mentions(t))
    return node, build.edges(t, node)


def test_graph_registration(spark):
    node, edge = small_graph(spark, [("d", 0, 1, " Ann  B ", "is", "ann b"), ("d", 1, 2, "X", "p", "ANN B"), ("d", 1, 2, "X", "p", "ANN B"), ("d", 2, None, "X", "p", "Ann B"), ("d", 3, 1, "", "p", "Y"), ("d", 4, 1, None, "p", None)])
    got = {r["name"]: (r["node_id"], r["degree"], r["pages"]) for r in build.with_degree(node, edge).collect()}
    assert got == {"Ann  B": (0, 2, [1, 2]), "X": (1, 2, [2]), "Y": (2, 0, [1])}  # a self-reference makes a node, no edge; equal facts both count


def test_graph_search(spark):
    facts = [("d", 0, 4, "Lighthouse", "guards", "Reef"), ("d", 1, 6, "Pilot", "avoids", "Reef"), ("d", 2, 9, "Pilot", "sails", "Cutter"), ("d", 3, 9, "Cutter", "carries", "Salt"), ("d", 4, 1, "Mill", "grinds", "Rye")]
    node, edge = small_graph(spark, facts)
    got = {r["name"]: r for r in search.answers(node, edge, search.lexical_scores(node, "lighthouse")).collect()}
    assert {n: r["hops"] for n, r in got.items()} == {"Lighthouse": 0, "Reef": 1, "Pilot": 2}
    assert got["Pilot"]["chain"] == [0, 1] and got["Pilot"]["path_pages"] == [4, 6]
    assert "Cutter" in {r["name"] for r in search.answers(node, edge, search.lexical_scores(node, "lighthouse"), hops=3).collect()}
    assert search.answers(node, edge, search.lexical_scores(node, "")).count() == 0
    assert {r["name"] for r in search.answers(node, edge, search.lexical_scores(node, "lighthouse"), hops=0).collect()} == {"Lighthouse"}


def bfs(seeds, edges, hops):
    near = {}
    for seq, a, b in edges:
        near.setdefault(a, []).append((b, seq))
        near.setdefault(b, []).append((a, seq))
    met = {s: (0, s, []) for s in seeds}
    queue = list(met)
    for u in queue:
        dist, src, chain = met[u]
        if dist < hops:
            for v, seq in near.get(u, []):
                if v not in met:
                    met[v] = (dist + 1, src, [*chain, seq])
                    queue.append(v)
    return met


def test_paths_equal_breadth_first_search(spark):
    import random

    rng = random.Random(3)
    edges = [(i, rng.randrange(12), rng.randrange(12)) for i in range(25)]
    edges = [e for e in edges if e[1] != e[2]]
    edge = spark.createDataFrame([("d", s, 1, a, b, "p", str(a), str(b)) for s, a, b in edges], "doc_id string, seq long, page int, subject_id int, object_id int, predicate string, subject string, object string")
    seeds = [3, 7]
    seed = spark.createDataFrame([("d", s, 1.0, r) for r, s in enumerate(seeds, 1)], "doc_id string, node_id int, sem double, rank int")
    got = {r["node_id"]: (r["dist"], r["src"], list(r["chain"])) for r in search.paths(seed, edge, 3).collect()}
    assert got == bfs(seeds, edges, 3)


def test_payloads(spark):
    import json

    def body(t):
        return json.dumps({"candidates": [{"content": {"parts": [{"text": t}, {"text": None}]}}]})

    inner = [json.dumps({"entities": [{"name": " A ", "type": "org"}, {"name": ""}, 3], "triples": [{"subject": "s", "predicate": "p", "object": "o"}, {"subject": "s"}]}), json.dumps([{"subject": "s", "predicate": "p", "object": "o"}]), "```json\n{}\n```", "junk", ""]
    df = spark.createDataFrame([(i, body(t)) for i, t in enumerate(inner)] + [(9, "{"), (10, None), (11, '{"promptFeedback": {"blockReason": "X"}}')], "i int, body string")
    got = {r["i"]: ([tuple(e) for e in r["entities"]], [tuple(t) for t in r["triples"]]) for r in payloads.extracted(df).collect()}
    assert got[0] == ([("A", "ORG")], [("s", "p", "o")]) and got[1] == ([], [("s", "p", "o")])
    assert all(got[i] == ([], []) for i in (2, 3, 4, 9, 10, 11))
    status = {r[0]: r[1] for r in df.select("i", payloads.response_status(F.col("body"))).collect()}
    assert status[0] == "ok" and status[11] == "blocked: X" and status[9] == "unreadable"
    listing = spark.createDataFrame([(json.dumps({"models": [{"name": "models/a", "supportedGenerationMethods": ["generateContent"]}, {"name": "b"}, {"name": "models/e", "supportedGenerationMethods": ["embedContent"]}]}),)], "body string")
    assert {r[0] for r in payloads.models(listing).collect()} == {"a", "b"} and {r[0] for r in payloads.models(listing, purpose="embed").collect()} == {"e"}
    assert payloads.pick_model(["x", "e"], ["e", "f"]) == "e" and payloads.pick_model([], ["text-embedding", "a"]) == "text-embedding" and payloads.pick_model([], [], default="z") == "z"
    vec = spark.createDataFrame([('{"embeddings": [{"values": [1, 2]}, {"values": [3]}]}',), ('{"embedding": {"values": [1]}}',), ("{}",)], "b string").select(payloads.embeddings(F.col("b")).alias("v"))
    assert [r["v"] for r in vec.collect()] == [[[1.0, 2.0], [3.0]], [[1.0]], None]


def test_providers(spark):
    calls = []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise providers.ProviderError("busy", 429)
        return "ok"

    waits = []
    assert providers.with_retries(busy, sleep=waits.append) == "ok" and waits == [1.5, 3.0]
    with pytest.raises(providers.ProviderError) as e:
        providers.clean_key("secret\nkey")
    assert "secret" not in str(e.value)
    df = spark.createDataFrame([(1, "Ann Lee studies at Big School"), (2, None), (3, "")], "i int, t string")
    vec = {r["i"]: r["vec"] for r in providers.embedded(df, ["i"], "t", providers.HashEmbedder).collect()}
    assert abs(sum(x * x for x in vec[1]) - 1) < 1e-9 and not any(vec[2])
    asked = providers.asked(df, ["i"], "t", providers.PatternExtractor)
    got = {r["i"]: [tuple(t) for t in r["triples"]] for r in payloads.extracted(asked).collect()}
    assert got == {1: [("Ann Lee", "studies at", "Big School")], 2: [], 3: []}


EVENTS = "job_id string, seq long, ts timestamp, type string, page int, payload string"


def test_job_state_and_eviction(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2031, 3, 1, h)
    ev = spark.createDataFrame([("a", 2, t(2), "done", None, None), ("a", 1, t(1), "progress", 1, '{"processed": 1, "total": 2}'), ("a", 1, t(1), "progress", 1, '{"processed": 1, "total": 2}'), ("b", 1, t(3), "progress", 1, "{bad"), ("c", 1, t(3), "error", None, None)], EVENTS)
    got = {r["job_id"]: (r["status"], r["processed"], r["total"], r["percent"]) for r in jobs.state(ev).collect()}
    assert got == {"a": ("done", 1, 2, 50), "b": ("processing", 0, 0, 0), "c": ("error", 0, 0, 0)}
    out = {r["job_id"]: r["reason"] for r in jobs.evicted(jobs.state(ev), "2031-03-01 04:00:01", 7200, keep=0).collect()}
    assert out == {"a": "ttl", "c": "lru"}
    frames = [r["frame"] for r in jobs.sse_frames(ev.where("job_id = 'a'")).orderBy("seq").collect()]
    assert len(frames) == 2 and frames[0].startswith("data: {") and frames[0].endswith("\n\n")


def test_streamed_state_equals_batch(spark, tmp_path):
    import datetime as dt

    rows = [("a", 1, dt.datetime(2031, 3, 1, 1), "progress", 1, None), ("a", 2, dt.datetime(2031, 3, 1, 2), "done", None, None), ("b", 1, dt.datetime(2031, 3, 1, 1), "progress", 3, None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    q = streaming.running_state(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["job_id"], r["status"], r["processed"]) for r in spark.table("states").collect()} == {("a", "done", 1), ("b", "processing", 3)}


def test_files_to_pages(spark, tmp_path):
    from leafmill.sources import files

    (tmp_path / "a.pdf").write_text("one\ftwo")
    (tmp_path / "b b.PDF").write_bytes(b"%encrypt%")
    (tmp_path / "c.pdf").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "d.txt").write_text("not asked for")
    made = files.split(files.files(spark, str(tmp_path)), files.PlainSplitter)
    got = sorted((r["filename"], r["page"] or 0, r["status"]) for r in made.collect())
    assert got == [("a.pdf", 1, "pending"), ("a.pdf", 2, "pending"), ("b b.PDF", 0, "error"), ("c.pdf", 0, "error")]
    assert {r["filename"]: r["reason"] for r in files.failures(made).collect()} == {"b b.PDF": "encrypted", "c.pdf": "corrupt"}


def test_threaded_lines_of_equal_text(spark):
    df = spark.createDataFrame([("x\na", [0, 2], [("x", 0.1), ("a", 0.2), ("a", 0.3)]), ("a", [0, 1], [("", 0.1), ("a", 0.2)])], "c string, k array<int>, l array<struct<text:string,confidence:double>>")
    got = [[x["confidence"] for x in r["t"]] for r in df.select(pages.threaded(F.col("l"), F.col("k"), F.col("c")).alias("t")).collect()]
    assert got == [[0.1, 0.3], [0.2]]  # by number, not the first of equal text; by text after trimming


def test_fallback_and_telemetry(spark):
    assert recommend.fallback(spark, "why").first()["mode"] == "max" and "clearly" in recommend.rationale("decisive", 0.1, binarize=True)
    asked = spark.createDataFrame([("d", 1, None), ("d", 2, "bad"), ("d", 3, "worse")], "doc_id string, page int, error string")
    assert tuple(build.telemetry(asked).first()) == ("d", 1, 2, "worse")
    p = make_pages(spark, ["a", " ", "b", "c"])
    assert [r["page"] for r in build.usable_pages(p, 2).orderBy("page").collect()] == [1, 3] and build.usable_pages(p).count() == 3
