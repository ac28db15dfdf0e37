"""Encoding repair, canonical form, scanned pages and sentences: round trips, fixtures and edge cases."""

import random
import unicodedata
from collections import Counter

import pytest

pytest.importorskip("leafmill.llm")

from leafmill.llm import canonical, mojibake, scans, sentences  # noqa: E402

PAGE = "doc_id string, page int, source string, text string, status string, error string, confidence double, lines array<struct<text:string,confidence:double>>"
TEXTS = ["caf\xe9 – “A\xc7\xc3O” from S\xe3o Orvel", "Während der größeren Brücke", "niezbędną księgowość wciąż", "L’équipe prépare la déclaration", "Лаборатория хранит материал", "Η επιτροπή περιγράφει τα σχέδια", "पहली तिमाही में कार्यालय", "委員会は請求書を確認しました。", "委员会和去年一样确认了下游的水位。"]


def damage(text, codec):
    t = mojibake.table(codec)
    return "".join(chr(b) if b < 128 else t[b] for b in text.encode())


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("codec", ["cp1252", "cp1251", "cp1250", "mac_roman"])
def test_round_trip(text, codec):
    assert mojibake.restore_line(damage(text, codec))[0] == text


@pytest.mark.parametrize("text", TEXTS)
def test_twice_and_intact(text):
    assert mojibake.restore_line(damage(damage(text, "cp1252"), "cp1252"))[0] == text
    assert mojibake.restore_line(text) == (text, 0, True)


def test_single_byte_and_wide_and_lost():
    assert mojibake.restore_line("Лаборатория хранит материал".encode("cp1251").decode("latin-1"))[0] == "Лаборатория хранит материал"
    assert mojibake.restore_line("Η επιτροπή περιγράφει τα αρχικά σχέδια".encode("cp1253").decode("cp1252", "replace"))[1] > 0
    t = mojibake.table("cp1252")
    wide = "".join(chr(b) if b < 128 else t[b] for b in TEXTS[7].encode("shift_jis"))
    assert mojibake.restore_line(wide)[0] == TEXTS[7]
    assert mojibake.restore_line("Stra��e") == ("Stra��e", 1, False)


@pytest.mark.parametrize("text", ["registres du MOYEN ÂGE", "COR\xc2\xa0y", "“COR\xc2”", "Пётр и Сёмга", "sta\xac", "5 £", ""])
def test_no_false_alarm(text):
    assert mojibake.restore(text)[1] == 0


def test_widths():
    text = "a\n" + damage("café – ça", "cp1252") + "\nb"
    fixed, widths = mojibake.restored_with_widths(text)
    assert fixed == "a\ncafé – ça\nb" and sum(widths) == len(text) and len(widths) == len(fixed)


def test_mojibake_found(spark):
    rows = [("d", 1, "ocr", "caf" + damage("é", "cp1252"), "done"), ("d", 1, "ocr", "caf" + damage("é", "cp1252"), "done"), ("d", 2, "ocr", "fine é", "done"), ("d", 3, None, None, "done"), ("d", 4, None, "Ã©", "error"), ("d", 5, None, "x" * 300_000 + "Ã©", "done")]
    df = spark.createDataFrame(rows, "doc_id string, page int, source string, text string, status string")
    assert {tuple(r) for r in mojibake.found_pages(df).collect()} == {("d", 1), ("d", 5)}
    assert mojibake.found_pages(df.limit(0)).count() == 0


def disguised(rng, word):
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in word)
    if kind == 1:
        return unicodedata.normalize("NFD", word + "é")
    if kind == 2:
        return word[:1] + "\u200d" + word[1:]
    if kind == 3:
        return word + "\u2009" + word
    return word.replace("e", "е") + "zе"


def test_capitals_of_another_table_in_every_word():
    damaged = "дождливое большое число произвел".encode("koi8_r").decode("cp1251")
    assert damaged.isupper() and mojibake.suspicious(damaged)
    assert mojibake.restore(f"Plain line\n{damaged}") == ("Plain line\nдождливое большое число произвел", 1, True)


def test_canonical():
    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choice("abceho") for _ in range(6)) + "w"
        odd = disguised(rng, word)
        assert canonical.at_issue(odd) and canonical.look_alikes(odd) > 0, odd
        plain = canonical.plain(odd)
        assert canonical.look_alikes(plain) == 0 and canonical.plain(plain) == plain
    assert canonical.canonical("Ｓtraße\u00a0 ﬁn") == "strasse fin"
    for fine in ["café “A” – 3 ½", "каких-либо", "λόγος", "हर केंद्र", "「走れ！」、，", "", "a b\nc"]:
        assert canonical.look_alikes(fine) == 0 and canonical.plain(fine) == fine
    assert canonical.plain("thе") == "the" and canonical.plain("лecа") == "леса"


def test_characters_beyond_latin_blocks():
    for odd, right in (("m²", "m2"), ("H₂O", "H2O"), ("\ufedf\ufe8e", "\u0644\u0627"), ("\uf900", "\u8c48"), ("㈱", "(株)"), ("㎏", "kg"), ("\u1112\u1161\u11ab", "\ud55c"), ("\u0627\u0653", "\u0622")):
        assert canonical.at_issue(odd) and canonical.look_alikes(odd) > 0 and canonical.plain(odd) == right, odd
        assert canonical.look_alikes(right) == 0


def test_canonical_found(spark):
    pages = spark.createDataFrame([("d", 1, "ocr", "a\u00a0b", "done"), ("d", 1, "ocr", "a\u00a0b", "done"), ("d", 2, "ocr", "Ã© a\u00a0b", "done"), ("d", 3, "ocr", None, "done"), ("d", 4, "ocr", "plain é", "done")], "doc_id string, page int, source string, text string, status string")
    triples = spark.createDataFrame([("d", 7, "thе", "p", None), ("d", 8, None, None, None), ("d", 9, "a", "b", "c")], "doc_id string, seq long, subject string, predicate string, object string")
    assert {tuple(r) for r in canonical.found(pages, triples).collect()} == {("page", "d", 1), ("triple", "d", 7)}
    got = [r["c"] for r in canonical.with_canonical(pages, "text", "c").orderBy("page").collect()]
    assert got == ["a b", "a b", canonical.canonical("Ã© a b"), None, "plain é"]


VOCABULARY = {"the": 900, "water": 300, "levels": 300, "in": 900, "lower": 300, "basin": 300, "instruments": 200, "well-known": 100, "well": 100, "known": 100, "manner": 200, "requires": 200, "department": 200}


def test_confusions_and_breaks():
    r = scans.Reader(VOCABULARY)
    assert r.written("watcr") == "water" and r.written("rnanner") == "manner" and r.written("l0wer") == "lower" and r.written("wafcr") == "water"
    assert r.written("water") is None and r.written("selpelbor") is None and r.written("b1") is None
    text = "The watcr levels in the well-\nknown basin and instru-\nments of the lower\n\nHelsor requires dcpart-\nment 1,250"
    assert set(r.lines(text, True)) == {(0, "misread"), (1, "hyphen"), (4, "hyphen"), (4, "misread")}
    assert set(r.lines(text, False)) == {(1, "hyphen"), (4, "hyphen")}
    assert r.paragraphs("HEAD\n" + text, {0}, True) == "The water levels in the well-known basin and instruments of the lower\n\nHelsor requires department 1,250"
    assert r.lines("", True) == [] and r.paragraphs("", set(), True) == ""


def test_furniture(spark):
    rows = [("d", p, "ocr", f"HALB Works\nthe body line {w} goes on\nand on {w} with more\nagain {w} at last\nTotal: {p * 7}.5\nPage {p} of 5", "done") for p, w in enumerate(["one", "two", "three", "four", "five"], 1)]
    rows[2] = ("d", 3, "text", rows[2][3].replace("HALB Works", "HA1B Works"), "done")
    rows += [rows[0], ("e", 1, "ocr", "Only page\nwith text", "done"), ("e", 2, None, None, "error"), (None, 1, None, "x", "done")]
    df = spark.createDataFrame(rows, "doc_id string, page int, source string, text string, status string")
    got = {(r["page"], r["line_no"]) for r in scans.furniture(df).where("doc_id = 'd'").collect()}
    assert got == {(p, i) for p in range(1, 6) for i in (0, 5)}
    assert scans.furniture(df).where("doc_id = 'e'").count() == 0
    assert scans.found(df.limit(0)).count() == 0


CUES = """1
00:00:01,000 --> 00:00:02,000
<i>Mr. Orvel lives at No.</i>

2
00:00:03,000 --> 00:00:04,000
4. (sighs) He shouted "Run!" and
left...

3
00:00:05,000 --> 00:00:06,000
Get captions at nulvor-subs.example today

4
00:00:07,000 --> 00:00:08,000
- "We are full! Come back."
- ORVEL: It weighs 71.5 kilos, etc. or more?
♪ a song. ♪"""


def weights():
    filler = []
    for i in range(40):
        filler.append(f"1\n00:00:01,000 --> 00:00:02,000\n- Mr. Nelvor{i} came home.\n- Mrs. Halbor{i} saw No. {i} there.\n- I know the key.\n- Is it late?\n")
    return sentences.train(filler)


def cut(text, w):
    ends = sentences.Splitter(w).ends(text)
    return [text[:e].rsplit("\n", 1)[-1][-12:].strip() for e in ends]


def test_sentences():
    w = weights()
    assert cut(CUES, w) == ["4.", "left...", "xample today", "We are full!", "Come back.\"", "tc. or more?"]
    crlf = CUES.replace("\n", "\r\n")
    assert len(sentences.Splitter(w).ends(crlf)) == 6
    thai = "1\n00:00:01,000 --> 00:00:02,000\nฉันรู้แค่นี้ วิ่งเร็ว\nคุณทำอะไรลงไป"
    assert len(sentences.Splitter(w).ends(thai)) == 3
    assert sentences.Splitter(w).ends("") == [] and sentences.Splitter(w).ends("1\n00:00:01,000 --> 00:00:02,000\n(door)") == []
    japanese = "1\n00:00:01,000 --> 00:00:02,000\n彼は「走れ！」と叫んだ。「満員です。後で来て。」"
    assert [japanese[:e][-2:] for e in sentences.Splitter(w).ends(japanese)] == ["だ。", "す。", "。」"]


def test_sentence_ends_of_damaged_text():
    w = weights()
    plain = "1\n00:00:01,000 --> 00:00:02,000\nC’est élevé. Où es-tu ?"
    bad = "\n".join(damage(x, "cp1252") for x in plain.split("\n"))
    assert [len(damage(plain[:e].rsplit("\n", 1)[-1], "cp1252")) for e in sentences.Splitter(w).ends(plain)] == [len(bad[:e].rsplit("\n", 1)[-1]) for e in sentences.Splitter(w).ends(bad)]


def test_sentences_table(spark):
    df = spark.createDataFrame([(1, CUES), (2, None), (3, ""), (4, "  \n"), (5, "no cues here! At all")], "doc_id long, text string")
    got = sentences.ends(df, ["doc_id"], weights()).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 6, 5: 2}
    assert sentences.found(df.limit(0)).count() == 0


def test_null_keys_and_empty_batches(spark):
    text = "The committee records the water levels in the lower basin."
    rows = [("d", 1, "ocr", text, "done"), (None, 2, None, text, "done"), ("d", None, "ocr", text, "done"), ("d", 3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, page int, source string, text string, status string").repartition(6)
    assert scans.found(df).count() == 0
    assert {(r["doc_id"], r["page"]) for r in scans.clean_pages(df).collect()} == {("d", 1), (None, 2), ("d", None)}
    assert mojibake.found_pages(df).count() == 0


def test_whole_tables_are_registered(spark, tmp_path):
    from leafmill.llm import queries

    jobs = "job_id string, lang string"
    tables = {
        "page_results": spark.createDataFrame([("d", 1, "Ｗide text", "done"), ("d", 2, "plain", "done"), ("d", 3, "caf\u00c3\u00a9 here", "done")], "doc_id string, page int, text string, status string"),
        "kg_triples": spark.createDataFrame([("d", 7, "Ａ", "is", None)] * 2, "doc_id string, seq long, subject string, predicate string, object string"),
        "jobs": spark.createDataFrame([("d", "en")], jobs),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    made = queries.queries()
    assert {"p1_stretches", "p2_restored", "p5_canonical"} <= made.keys()
    assert [(r["page"], r["restored"]) for r in made["p2_restored"](spark, str(tmp_path)).collect()] == [(3, "café here")]
    got = {(r["place"], r["num"], r["field"]): r["canonical"] for r in made["p5_canonical"](spark, str(tmp_path)).collect()}
    assert got[("page", 1, "text")] == "wide text" and got[("triple", 7, "subject")] == "a" and got[("triple", 7, "object")] is None and len(got) == 6


def test_words_beyond_the_broadcast_count(spark):
    from leafmill.llm import scans

    line = "the harbour committee reports several com-\nplete volumes of measured water levels and hydrology"
    bad = line.replace("hydrology", "hydroiogy").replace("several", "scveral")
    rows = [("d", i, "ocr", line, "done", None, None, None) for i in range(8)] + [("d", 90, "ocr", bad, "done", None, None, None), ("d", 91, "text", "complete", "done", None, None, None)]
    rows += [("d", 100 + i, "text", "complete volumes", "done", None, None, None) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id string, page int, source string, text string, status string, error string, confidence double, lines array<struct<text:string,confidence:double>>")
    whole, part = scans.vocabulary(df), scans.vocabulary(df, 3)
    assert whole.rest is None and part.rest is not None and len(part.words) <= 3
    want = {tuple(r) for r in scans.line_kinds(df, whole).collect()}
    assert ("d", 90, 1, "misread") in want and {tuple(r) for r in scans.line_kinds(df, part).collect()} == want


def test_words_are_judged_once_and_lines_are_moved_once(spark, monkeypatch):
    sought = []
    monkeypatch.setattr(scans, "_TOKEN", type("Counting", (), {"findall": staticmethod(lambda text, real=scans._TOKEN: sought.append(text) or real.findall(text))}))
    r = scans.Reader(VOCABULARY)
    page = "The water levels in the\nlower basin"
    assert r.lines(page, True) == [] and sought
    sought.clear()
    assert r.lines(page, True) == [] and not sought
    monkeypatch.undo()
    df = spark.createDataFrame([("d", 1, "ocr", page, "done")], "doc_id string, page int, source string, text string, status string")
    plan = scans.found(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3 and plan.count("levenshtein(key") == 1


def test_parts_of_a_text_say_what_the_whole_says(spark):
    texts = [
        "ΟΔΟΣ ΟΔΟΣ\nΣ ὈΔΥΣΣΕΎΣ well-known", "ДПУФБЧМСЕФ ВПМШЫПЕ ЮЙУМП", "ДПУФ\nБЧМС", "АБВГ,ДЕЖЗ", "Ã© dcpart-\nment\tl0wer the!!\r\nwatcr", "wide　ｔext watcr\x85rnanner", "語" * 60 + "watcr", "w" * 50 + " " + "è" * 50, "", " \n ", "thе water", "plain é",
    ]
    r = scans.Reader(VOCABULARY)
    for _ in range(2):  # remembered or not
        for t in texts:
            assert scans.unclear(t, scans.parts_of(t)) == (mojibake.suspicious(t) or canonical.at_issue(t)), t
            assert [scans.legible(x) for x in t.split("\n")] == [canonical.plain(y) if canonical.at_issue(y) else y for x in t.split("\n") for y in [mojibake.restore_line(x)[0] if mojibake.suspicious(x) else x]]
            want = {w for w in scans._TOKEN.findall(t.lower()) if r.written(w.rstrip("!") if w.rstrip("!") in VOCABULARY else w)}
            at, got = r.misread(scans.parts_of(t))
            assert got == want and {w for p in at for w in scans._TOKEN.findall(p.lower())} >= want
    assert r.misread(scans.parts_of(texts[4]))[1] == {"watcr", "l0wer"}
    df = spark.createDataFrame([("d", i, None, t, "done") for i, t in enumerate(texts * 6)], "doc_id string, page int, source string, text string, status string")
    c = Counter()
    for t in texts * 6:
        for w in scans._WORD.findall(t.lower()) if t.strip() else ():
            c.update([w, *(w.split("-") if "-" in w else ())])
    assert scans.vocabulary(df).words == {w: n for w, n in c.items() if n >= scans.LEAST_COUNT}


def test_running_lines_of_repeated_pages_and_many_numbers(spark):
    rows = [("d", p, "ocr", f"Ledger 12/03/1921 p. {p} no {p + 7}\nbody {w} of it\n{w} again and more\na complete {w} on\nthe {w} end com-\nplete {w} watcr\nRiver {'Beard' if p == 3 else 'Board'}", "done") for p, w in enumerate(["one", "two", "three", "four", "five"], 1)]
    rows += [rows[1], ("e", -70, "ocr", "Head\nx\n-70", "done"), ("e", -71, "text", "Head\ny\n5", "done")]
    df = spark.createDataFrame(rows, "doc_id string, page int, source string, text string, status string")
    got = sorted((r["doc_id"], r["page"], r["line_no"]) for r in scans.furniture(df).collect())
    assert got == sorted([("d", p, i) for p in range(1, 6) for i in (0, 6)] + [("e", -70, 0), ("e", -71, 0)])
    found = [tuple(r) for r in scans.found(df).collect()]
    assert len(found) == len(set(found)) and not [x for x in found if x[2] in (0, 6) and x[3] != "furniture"]
    assert {x[1] for x in found if x[2:] == (4, "hyphen")} == set(range(1, 6))
