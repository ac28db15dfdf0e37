"""Language identification: held-out accuracy, mixed pages, labels."""

import pytest

pytest.importorskip("leafmill.llm")

from leafmill.llm import langid  # noqa: E402

TEXTS = {
    "en": ["The committee records the water levels in the lower basin.", "Because the smaller harbour remains closed, the archive office requires the original drawings.", "This laboratory examines several boxes of printed maps."],
    "de": ["Die Kommission beschreibt die ursprünglichen Zeichnungen nach der Vereinbarung.", "Das Archiv prüft die Wasserstände im unteren Becken vor dem Ende der Saison.", "Unser Lager benötigt mehrere Kisten mit gedruckten Karten."],
    "fr": ["Le comité vérifie un nombre élevé de factures manquantes.", "La deuxième équipe examine les niveaux d'eau du bassin inférieur.", "Notre dépôt prépare le résumé mensuel des températures."],
    "ru": ["Комиссия сравнивает письменное заявление подрядчика с большим трудом.", "Лаборатория хранит материал для строительства моста в обычных условиях."],
    "zh": ["委员会和去年一样确认了下游的水位。我们的仓库没有提到许多丢失的发票。"],
    "ja": ["委員会はなくなった請求書を確認しました。研究所は下流の水位を記録しています。"],
}
PAGE = "doc_id string, page int, source string, text string, status string, error string, confidence double, lines array<struct<text:string,confidence:double>>"


def sample():
    wrong = [("\n".join(TEXTS["en"]), "de")]
    return [("\n".join(v), k) for k, v in TEXTS.items() for _ in range(6)] + wrong


def model():
    return langid.train(sample(), ["de", "en", "fr", "ja", "ru", "th", "zh"])


def lang_of(m, text):
    clean = langid.readable(text)
    spans = langid.sentences_of(clean)
    scores = langid.Scorer(m).of([langid.words_of(clean[a:b]) for a, b in spans])
    return [m.langs[i] for i in scores.argmax(axis=1)]


def test_held_out_and_mixed():
    m = model()
    assert lang_of(m, "The archive office describes the original maps of the lower harbour.") == ["en"]
    assert lang_of(m, "Das Archiv beschreibt die Karten im unteren Becken.") == ["de"]
    assert lang_of(m, "The committee records the levels.\nLe comité examine les niveaux.") == ["en", "fr"]
    assert lang_of(m, "Le comitÃ© vÃ©rifie les niveaux d'eau de la dÃ©claration.") == ["fr"]


def test_full_sentences():
    assert not langid.full("Bekelvin Works, Ltd.", langid.words_of("Bekelvin Works, Ltd."))
    assert not langid.full("the water levels in the lower basin", langid.words_of("the water levels in the lower basin"))
    assert langid.full("The water levels in the lower basin.", langid.words_of("The water levels in the lower basin."))


def tables(spark, texts, lang="EN_gb"):
    pages = spark.createDataFrame([("d", i, "ocr", t, "done", None, None, None) for i, t in enumerate(texts)], PAGE)
    jobs = spark.createDataFrame([("d", lang, 1), ("d", lang, 1)], "job_id string, lang string, code int")
    codes = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French")], "lang string, iso3 string, english_name string")
    return pages, jobs, codes


@pytest.mark.parametrize("label", ["EN_gb", "english", " eng ", "en-GB"])
def test_labels_and_cases(spark, label):
    pages, jobs, codes = tables(spark, ["\n".join(TEXTS["en"]), "", None, "\n".join(TEXTS["en"]) + "\n\n" + TEXTS["de"][0], "\n".join(TEXTS["en"])], label)
    got = langid.page_languages(pages.where("text is not null"), ["doc_id", "page"], model()).distinct()
    named = langid.named_languages(jobs, codes).withColumnsRenamed({"code": "lang"})
    assert {(r["page"], r["lang"]) for r in got.join(named, ["doc_id", "lang"], "left_anti").collect()} == {(3, "de")}


def test_stretches_and_empty_tables(spark):
    pages, jobs, codes = tables(spark, ["\n".join(TEXTS["de"]), " ", "12 34"])
    rows = langid.stretches(pages, ["doc_id", "page"], model()).collect()
    assert {r["lang"] for r in rows if r["page"] == 0} == {"de"} and all(0 <= r["confidence"] <= 1 for r in rows)
    assert {r["lang"] for r in rows if r["page"] == 2} == {None}
    assert langid.found(pages.limit(0), jobs.limit(0), codes).count() == 0
