"""Settings, labels and limits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import strip

#: Fixed values.
LOW_CONFIDENCE = 0.85
CONFIDENT = 0.80


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin("true", "1", "yes"), F.lit(False))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def page_limit(text: Column) -> Column:
    """Number of pages asked for: null for none or nonsense, at least 0; 0 stands for all."""
    number = strip(text)
    return F.when(number.rlike(r"^[+-]?[0-9]{1,9}$"), F.greatest(F.lit(0), number.cast("int")))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.btrim(t), F.lit("")) for t in texts])


def model_name(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.btrim(text), "^models/", ""), F.lit("")), F.lit(default))


def is_pdf(filename: Column, mime: Column | None = None) -> Column:
    named = F.coalesce(filename.rlike(r"(?i)\.pdf$"), F.lit(False))
    return named if mime is None else named | F.coalesce(mime == "application/pdf", F.lit(False))


def base_name(filename: Column, documents: Column) -> Column:
    """Name of an export: that of the only document without `.pdf`, else `extraction`."""
    return F.when(documents == 1, F.coalesce(F.nullif(F.regexp_replace(filename, r"(?i)\.pdf$", ""), F.lit("")), F.lit("extraction"))).otherwise("extraction")


def script_model(lang: Column) -> Column:
    """Handwriting model of a language: Devanagari ones have their own, all others the English one."""
    key = F.lower(F.btrim(F.coalesce(lang, F.lit(""))))
    return F.when(key.isin("hi", "hin", "hindi", "mr", "marathi", "sa"), "hi").when(key.isin("ne", "nep", "nepali", "devanagari"), "ne").otherwise("en")


def route(has_text: Column, force_ocr: Column, online: Column, key: Column, handwriting: Column) -> Column:
    """How a page is read: its text layer unless recognition is forced, else online with a key, else as handwriting, else by OCR."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    keyed = yes(F.btrim(key) != "")
    return F.when(yes(has_text) & ~yes(force_ocr), "text").when(yes(online) & keyed, "online").when(yes(handwriting), "handwriting").otherwise("ocr")


def badge(status: Column, source: Column, confidence: Column) -> Column:
    percent = F.concat(F.lit("OCR · "), F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))
    return (
        F.when(status == "error", "Error").when(source == "text", "Text layer").when(source == "handwriting", "Handwriting").when(source == "online", "Online")
        .when(source == "ocr", F.when(confidence.isNotNull(), percent).otherwise("OCR"))
    )


def heading_tag(source: Column, confidence: Column) -> Column:
    finite = confidence.isNotNull() & ~F.isnan(confidence) & (F.abs(confidence) < F.lit(float("inf")))
    percent = F.concat(F.lit(" — OCR ("), F.bround(confidence * 100).cast("long").cast("string"), F.lit("%)"))
    return F.when(source == "ocr", F.when(finite, percent).otherwise(" — OCR")).when(source == "text", " — Text layer").otherwise("")


def display_text(status: Column, error: Column, text: Column, edited: Column | None = None) -> Column:
    shown = F.when(status == "error", F.concat(F.lit("Error: "), F.coalesce(F.nullif(error, F.lit("")), F.lit("could not read this page")))).otherwise(F.coalesce(text, F.lit("")))
    return shown if edited is None else F.coalesce(edited, shown)


def failure_kind(detail: Column) -> Column:
    d = F.lower(F.coalesce(detail, F.lit("")))
    return F.when(d.rlike("encrypt|password|needs_pass"), "encrypted").when(d.rlike("corrupt|cannot open|damaged"), "corrupt").otherwise("other")


def http_failure(code: Column) -> Column:
    return F.when(code.isin(401, 403), "key").when(code == 429, "quota").when(code == 400, "request").when(code == 404, "model").when(code >= 500, "server").otherwise("other")


def page_tag(pages: Column) -> Column:
    return F.concat(F.lit("p."), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "))
