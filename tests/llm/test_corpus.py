"""Token ids against the public library, and the mix of sources."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("leafmill.llm")

from leafmill.llm import mixing, tokens  # noqa: E402

if not os.path.exists(f"{tokens.FOLDER}/byte_bpe_50k.json"):
    pytest.skip("no vocabulary files", allow_module_level=True)

from tokenizers import Tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.vocabulary())


def ids(encoder, texts):
    flat, at = encoder.encode(texts)
    return [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


def test_hard_texts(library, encoder):
    texts = ["", " ", "\n\n a", "a" * 5000, "ab" * 300, "<|endoftext|> x", "1\r\n00:00:01,000 --> 00:00:02,000\r\n", "don't we'll", "日本語" * 40, "ภาษาไทย" * 30, "\x1c\x1d a\x85b\xa0c\u3000d", "e\u0301\u200d", "😀" * 20, "A" * 100_000]
    assert ids(encoder, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert ids(encoder, [None, ""]) == [[], []]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    encoder, library = tokens.Encoder(tokens.vocabulary()), Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    text = text.encode("utf-8", "ignore").decode()
    assert ids(encoder, [text])[0] == library.encode(text, add_special_tokens=False).ids


def test_compatibility_of_pairs(encoder):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50_000, 3000), rng.integers(0, 50_000, 3000)
    byte_of = {t: w for w, t in encoder.v.ids.items()}
    want = [encoder.merge(byte_of[int(x)] + byte_of[int(y)]) == [x, y] for x, y in zip(a, b, strict=True)]
    assert encoder.compatible(a, b).tolist() == want


def test_table(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, ids string")
    assert sorted((r["doc_id"], list(r["ids"])) for r in tokens.document_ids(df).collect()) == [(1, [64, 275]), (2, []), (3, []), (3, [])]
    assert tokens.document_ids(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation(n):
    assert sorted(mixing.permute(np.arange(n), n, 9).tolist()) == list(range(n))
    if n > 100:
        assert mixing.permute(np.arange(n), n, 9).tolist() != mixing.permute(np.arange(n), n, 10).tolist()


def corpus(spark):
    rng = random.Random(0)
    words = ["tree", " water", " level", " basin", "\n"]
    rows = [(i, s, "".join(rng.choices(words, k=rng.randrange(1, 300)))) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 40 + [None] * 5)]
    docs = spark.createDataFrame([*rows, (900, "a", None), (901, "a", "")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 4), ("c", 0.15, 3), ("missing", 0.2, 9), ("zero", 0.0, 9)], "source string, weight double, max_repeats int")
    return docs, targets


def test_mix(spark):
    docs, targets = corpus(spark)
    made = mixing.mix(docs, targets, size=32, lane_tokens=4000, shard_slots=64).cache()
    rows = made.collect()
    assert len({(r["shard"], r["position"]) for r in rows}) == len(rows)
    cap = {"a": 1, "b": 4, "c": 3}
    used = {}
    for r in rows:
        used[r["source"], r["block"]] = used.get((r["source"], r["block"]), 0) + 1
        assert sum(p["length"] for p in r["pieces"]) == r["n_tokens"] <= 32
    assert all(n <= cap[s] for (s, _), n in used.items())
    report = {r["source"]: r for r in mixing.shares(made, targets).collect()}
    for s in "abc":
        assert abs(report[s]["share"] - report[s]["target_share"]) < 0.06
    assert report["missing"]["tokens"] == 0 and report["missing"]["target_share"] is None
    assert abs(sum(report[s]["share"] for s in "abc") - 1) < 1e-9
    again = mixing.mix(docs.repartition(7), targets, size=32, lane_tokens=4000, shard_slots=64)
    assert {(r["shard"], r["position"], r["source"], r["block"]) for r in again.collect()} == {(r["shard"], r["position"], r["source"], r["block"]) for r in rows}
    total = mixing.materialised(made, docs).selectExpr("sum(size(ids))").first()[0]
    assert total == sum(r["n_tokens"] for r in rows)
    made.unpersist()


def test_blocks_hold_every_token_once(spark):
    docs, targets = corpus(spark)
    counts = mixing.token_counts(docs, targets, tokens.FOLDER)
    want = {r["doc_id"]: r["n_tokens"] for r in counts.collect()}
    seen = {}
    for r in mixing.blocks_of(counts, 32, 4000).collect():
        for p in r["pieces"]:
            seen.setdefault(p["doc_id"], []).append((p["first"], p["length"]))
    assert set(seen) == set(want)
    for doc, parts in seen.items():
        at = 0
        for first, length in sorted(parts):
            assert first == at
            at += length
        assert at == want[doc]


def test_empty_mix(spark):
    docs, targets = corpus(spark)
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    assert mixing.mix(docs, targets, size=32, total_tokens=320, shard_slots=4).count() == 10


def test_slots_beyond_a_capacity_move():
    from leafmill.llm import mixing

    got = mixing.moves([10, 5, 30], [8, 9, 20])
    taken = {s: set(range(min(n, c))) for s, (n, c) in enumerate(zip([10, 5, 30], [18, 9, 20]))}
    assert mixing.moves([1, 2], [3, 2]) == [] and sum(e - b for _, b, e, _, _ in got) == 4  # what has room
    got = mixing.moves([10, 5, 22], [8, 9, 30])
    assert got == [(0, 8, 10, 2, 22)] and taken


def test_sentences_have_their_texts(spark):
    from leafmill.llm import sentences

    text = "1\n00:00:01,000 --> 00:00:02,000\n<i>We left at\n\n2\n00:00:03,000 --> 00:00:04,000\nnine.</i> [door] Then it rained.\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text)], "doc_id long, text string")
    weights = sentences.train([text] * 5)
    got = sorted((r["no"], r["end_pos"], r["sentence"]) for r in sentences.sentence_texts(df, ["doc_id"], weights).distinct().collect())
    assert [g[2] for g in got] == ["We left at nine.", "Then it rained."] and [text[: g[1]][-1] for g in got] == [".", "."]
