"""Flattening of nested records against a brute-force reader, and its edge cases."""

import json
import random

import pytest

from leafmill.operators import nested

SCHEMA = "dump_id long, body string, value string, extra int"


def rows(spark, bodies):
    return spark.createDataFrame([(i, b, "x", 1) for i, b in enumerate(bodies, 1)], SCHEMA)


def brute(bodies):
    def parsed(v):
        while isinstance(v, str) and v.strip()[:1] in ("[", "{", '"'):
            try:
                v = json.loads(v)
            except ValueError:
                break
        return v

    def elements(v):
        v = parsed(v)
        if v is None:
            return
        if isinstance(v, list):
            yield from ((i, None, x) for i, x in enumerate(v, 1))
        elif isinstance(v, dict) and v and all(k.strip().isdigit() for k in v):
            yield from ((None, int(k), x) for k, x in v.items())
        else:
            yield 1, None, v

    out = set()
    for dump, body in enumerate(bodies, 1):
        try:
            root = json.loads(body) if body else None
        except ValueError:
            continue
        for _, _, job in elements(root):
            job = parsed(job)
            if not isinstance(job, dict):
                continue
            job = job.get("payload", {}).get("job") or job.get("job") or job
            for at, key, page in elements(job.get("pages")):
                page = parsed(page)
                if not isinstance(page, dict):
                    continue
                inner = page.get("result") or page
                number = page.get("page", inner.get("page"))
                number = int(number) if number is not None else key if key is not None else at
                lines = inner.get("lines")
                if lines is None and inner.get("blocks"):
                    lines = [x for b in inner["blocks"] for x in b.get("lines") or []]
                for lat, lkey, line in elements(lines):
                    if line is not None:
                        out.add((dump, number, lkey if lkey is not None else lat))
    return out


def random_body(rng):
    def line():
        return rng.choice([None, "text", {"text": "a", "confidence": 0.5}, {"text": "b", "alternatives": [{"text": "c"}]}, {"text": None}])

    def lines():
        made = [line() for _ in range(rng.randrange(4))]
        return rng.choice([made, None, {str(i * 2 + 1): x for i, x in enumerate(made)} or None, {"text": "only"}])

    def page(i):
        p = {"source": "ocr"}
        if rng.random() < 0.4:
            p["blocks"] = [{"type": 0, "lines": [line() for _ in range(2)]}, {"type": 0, "lines": []}, {"type": 0, "lines": [line()]}]
            p["lines"] = None
        else:
            p["lines"] = lines()
        if rng.random() < 0.2:
            p = {"result": p}
        if rng.random() < 0.7:
            p["page"] = rng.choice([i, str(i)])
        return p

    made = [page(i) for i in range(1, rng.randrange(2, 5))]
    pages = rng.choice([made, {str(i): p for i, p in enumerate(made, 3)}, made[0], json.dumps(made), None])
    job = {"job_id": "j", "pages": pages}
    body = rng.choice([job, {"job": job}, {"payload": {"job": job}}, [job], json.dumps(job)])
    return json.dumps(body)


def test_against_brute_force(spark):
    rng = random.Random(5)
    bodies = [random_body(rng) for _ in range(150)]
    got = [tuple(r) for r in nested.found_lines(rows(spark, bodies)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(bodies)


def test_edge_cases(spark):
    bodies = [None, "", "{", "3", "[]", "{}", '{"pages": []}', '{"pages": [null, {"lines": ["x"]}]}', '{"pages": [{"lines": []}]}', "null", '"text"']
    assert {tuple(r) for r in nested.found_lines(rows(spark, bodies)).collect()} == {(8, 2, 1)}
    assert nested.found_lines(rows(spark, []).limit(0)).count() == 0


def test_repeated_rows_and_long_body(spark):
    body = json.dumps({"pages": [{"page": 7, "lines": ["w" * 200_000, "x"]}]})
    df = spark.createDataFrame([(1, body), (1, body)], "dump_id long, body string")
    assert sorted(tuple(r) for r in nested.found_lines(df).collect()) == [(1, 7, 1), (1, 7, 2)]


def test_merged_schema_and_keys(spark):
    bodies = [json.dumps({"job_id": "a", "total": 3, "pages": [{"page": "1", "ok": True, "lines": [{"text": "t", "confidence": 1}, {"text": "u", "confidence": 0.5}]}]}), json.dumps({"job_id": "b", "total": 2.5, "pages": [{"page": 2}]})]
    made = nested.flatten_dumps(rows(spark, bodies))
    types = dict(made["job"].dtypes)
    assert types["job_id"] == "string" and types["total"] == "double"
    assert dict(made["page"].dtypes)["page"] == "string" and dict(made["line"].dtypes)["confidence"] == "double"
    jobs = {r["job_key"] for r in made["job"].collect()}
    pages = {r["page_key"]: r["parent_key"] for r in made["page"].collect()}
    assert set(pages.values()) <= jobs
    assert {r["parent_key"] for r in made["line"].collect()} <= set(pages)


def test_every_array_is_a_table_and_keys_are_unique(spark):
    page = {"page": 1, "lines": [{"text": "a", "alternatives": ["x", {"text": "y"}], "box": [[1, 2], [3, 4]]}, "plain [1]"], "blocks": [{"type": 1}]}
    bodies = [json.dumps({"payload": {"job": {"job_id": "j", "pages": [page]}}, "meta": {"tags": ["p", "q"], "version": 2}}), json.dumps({"job_id": "k", "graph": {"nodes": [{"name": "n", "pages": [1, 2]}]}, "pages": [page, page]})]
    df = spark.createDataFrame([(i % 2, b) for i, b in enumerate([*bodies, *bodies, bodies[0].replace("plain", "other")])], "dump_id long, body string")
    made = {n: t.collect() for n, t in nested.flatten_dumps(df).items()}
    assert {n: len(r) for n, r in made.items()} == {"job": 3, "page": 4, "line": 8, "pages_lines_alternatives": 8, "pages_lines_box": 8, "pages_lines_box_item": 16, "pages_blocks": 4, "meta_tags": 4, "graph_nodes": 1, "graph_nodes_pages": 2}
    for n, r in made.items():
        keys = [x[f"{n}_key"] for x in r]
        assert len(keys) == len(set(keys))
    of = {"page": "job", "line": "page", "pages_lines_alternatives": "line", "pages_lines_box_item": "pages_lines_box", "graph_nodes_pages": "graph_nodes", "meta_tags": "job"}
    for child, parent in of.items():
        assert {x["parent_key"] for x in made[child]} <= {x[f"{parent}_key"] for x in made[parent]}
    assert {x["meta_version"] for x in made["job"]} == {2, None} and {x["text"] for x in made["line"]} == {"a", "plain [1]", "other [1]"}
    assert sorted(x["value"] for x in made["pages_lines_box_item"] if x["parent_key"].startswith("1/")) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_maps_clashing_names_and_broken_texts(spark, monkeypatch):
    wide = {f"k{i}": {"n": i} for i in range(nested.MAX_FIELDS + 5)}
    bodies = ['{"a": "\\ud800x", "job_key": 1, "Dump_Id": 2, "ordinal": 3, "a b`c": 4}', json.dumps({"wide": wide}), '{"a": NaN}', "[" * 100_000, '{"big": 99999999999999999999}']
    made = nested.flatten_dumps(rows(spark, bodies))
    entries = made["wide"].collect()
    assert len(entries) == len(wide) and {(r["entry"], r["n"]) for r in entries} == {(k, v["n"]) for k, v in wide.items()}
    job = {r["dump_id"]: r for r in made["job"].collect()}
    assert sorted(job) == [1, 2, 5] and job[1]["a"] == "\ufffdx" and job[1]["_job_key"] == 1 and job[1]["_Dump_Id"] == 2 and job[1]["_ordinal"] == 3 and job[1]["a b`c"] == 4
    assert job[5]["big"] == "99999999999999999999"


def test_null_ids_and_other_columns(spark):
    df = spark.createDataFrame([(None, '{"pages": [1]}', 1), (None, '{"pages": [2, 3]}', 2)], "dump_id long, body string, _root int")
    got = nested.flatten_dumps(df)["page"].collect()
    assert len({r["page_key"] for r in got}) == 3 and {r["value"] for r in got} == {1, 2, 3}
