"""Answers of remote services, read defensively: broken elements are dropped one by one, never the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import strip, unfenced


def response_text(body: Column) -> Column:
    """Text of the first candidate of a response, its parts after each other; null where there is no candidate."""
    v = F.try_parse_json(body)
    parts = F.try_variant_get(v, "$.candidates[0].content.parts", "array<variant>")
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    return F.when(F.try_variant_get(v, "$.candidates[0]", "variant").isNotNull(), F.coalesce(text, F.lit("")))


def response_status(body: Column) -> Column:
    """`ok`, `blocked: REASON`, `no candidates` or `unreadable`."""
    v = F.try_parse_json(body)
    reason = F.try_variant_get(v, "$.promptFeedback.blockReason", "string")
    return F.when(v.isNull(), "unreadable").when(F.try_variant_get(v, "$.candidates[0]", "variant").isNotNull(), "ok").when(reason.isNotNull(), F.concat(F.lit("blocked: "), reason)).otherwise("no candidates")


def transcription(body: Column) -> Column:
    """(text, error) of a recognition response: partial text counts; blank text is an error that names why the service stopped, if it says so."""
    v = F.try_parse_json(body)
    reason = F.try_variant_get(v, "$.candidates[0].finishReason", "string")
    text, state = response_text(body), response_status(body)
    blank = F.coalesce(strip(text) == "", F.lit(True))
    why = F.when(state != "ok", state).when(blank & reason.isNotNull() & (reason != "STOP"), F.concat(F.lit("no text: "), reason)).when(blank, "empty transcription")
    return F.struct(F.when(why.isNull(), text).alias("text"), why.alias("error"))


#: States of a service by code, where its answer names none.
STATES = {401: "PERMISSION_DENIED", 403: "PERMISSION_DENIED", 429: "RESOURCE_EXHAUSTED", 400: "INVALID_ARGUMENT", 404: "NOT_FOUND", 500: "UNAVAILABLE", 503: "UNAVAILABLE", 504: "UNAVAILABLE"}


def http_error(code: Column, body: Column, reason: Column) -> Column:
    """(kind, state, detail) of a failed request: what the body of the answer says, else the reason of the status line. Bodies that are no JSON say nothing."""
    from leafmill.functions.scalars import http_failure

    v = F.try_parse_json(body)
    said = lambda name: F.nullif(strip(F.try_variant_get(v, f"$.error.{name}", "string")), F.lit(""))
    usual = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.struct(http_failure(code).alias("kind"), F.coalesce(said("status"), F.try_element_at(usual, code.cast("int")), F.lit("ERROR")).alias("state"), F.coalesce(said("message"), F.nullif(reason, F.lit("")), F.lit("no detail provided")).alias("detail"))


def export_pages(posted: DataFrame, body: str = "body") -> DataFrame:
    """(doc, filename, page_at, page, source, confidence, text) of a posted export, whatever its shape: a body that is no list gives no row, elements that
    are no objects are skipped, pages that are no list are none (a row with null `page_at` remains for the title)."""
    v = F.try_parse_json(F.col(body))
    docs = posted.select(F.posexplode(F.try_variant_get(v, "$", "array<variant>")).alias("doc", "_d")).where(F.schema_of_variant("_d").startswith("OBJECT"))
    pages = F.filter(F.coalesce(F.try_variant_get("_d", "$.pages", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.schema_of_variant(p).startswith("OBJECT"))
    get = lambda name, kind: F.try_variant_get("_p", f"$.{name}", kind)
    number = F.schema_of_variant(F.try_variant_get("_p", "$.confidence", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    each = docs.select("doc", F.coalesce(F.nullif(F.try_variant_get("_d", "$.filename", "string"), F.lit("")), F.lit("Document")).alias("filename"), F.posexplode_outer(pages).alias("page_at", "_p"))
    return each.select("doc", "filename", "page_at", get("page", "string").alias("page"), get("source", "string").alias("source"), F.when(number, get("confidence", "double")).alias("confidence"), F.coalesce(get("text", "string"), F.lit("")).alias("text"))


def _field(v: Column, name: str) -> Column:
    return strip(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))


def extracted(responses: DataFrame, body: str = "body") -> DataFrame:
    """The rows with `entities` (name, type) and `triples` (subject, predicate, object) of a response: a JSON object, maybe fenced, or a bare array of triples.

    Names and parts are trimmed; elements without a name, or without one of the three parts, and elements that are no objects are dropped. Unreadable text gives empty lists.
    """
    v = F.try_parse_json(unfenced(response_text(F.col(body))))
    bare = F.try_variant_get(v, "$", "array<variant>")
    none = F.array().cast("array<variant>")
    ent = F.coalesce(F.try_variant_get(v, "$.entities", "array<variant>"), none)
    tri = F.coalesce(F.try_variant_get(v, "$.triples", "array<variant>"), bare, none)
    typed = lambda e: F.coalesce(F.nullif(F.upper(_field(e, "type")), F.lit("")), F.lit("OTHER"))
    entities = F.filter(F.transform(ent, lambda e: F.struct(_field(e, "name").alias("name"), typed(e).alias("type"))), lambda e: e["name"] != "")
    triples = F.filter(F.transform(tri, lambda t: F.struct(*[_field(t, n).alias(n) for n in ("subject", "predicate", "object")])), lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["object"] != ""))
    return responses.withColumns({"entities": F.coalesce(entities, F.array().cast("array<struct<name:string,type:string>>")), "triples": F.coalesce(triples, F.array().cast("array<struct<subject:string,predicate:string,object:string>>"))})


def embeddings(body: Column) -> Column:
    """Vectors of an embedding response, in its order; null where it holds none."""
    v = F.try_parse_json(body)
    many = F.transform(F.try_variant_get(v, "$.embeddings", "array<variant>"), lambda e: F.try_variant_get(e, "$.values", "array<double>"))
    one = F.array(F.try_variant_get(v, "$.embedding.values", "array<double>"))
    return F.coalesce(many, F.when(F.get(one, F.lit(0)).isNotNull(), one))


def usable_embeddings(vectors: Column, expected: Column) -> Column:
    """Whether there are as many vectors as asked for, none of them empty."""
    return F.coalesce((F.size(vectors) == expected) & F.forall(vectors, lambda x: F.size(x) > 0), F.lit(False))


def models(responses: DataFrame, body: str = "body", purpose: str = "generate") -> DataFrame:
    """(name) of the models of a list response. For generating, models without a list of methods count; for embedding they don't."""
    v = F.try_parse_json(F.col(body))
    each = responses.select(F.explode(F.try_variant_get(v, "$.models", "array<variant>")).alias("m"))
    methods = F.try_variant_get("m", "$.supportedGenerationMethods", "array<string>")
    if purpose == "generate":
        keep = methods.isNull() | F.array_contains(methods, "generateContent")
    else:
        keep = F.arrays_overlap(methods, F.array(F.lit("batchEmbedContents"), F.lit("embedContent")))
    name = F.regexp_replace(F.try_variant_get("m", "$.name", "string"), "^models/", "")
    return each.where(F.coalesce(keep, F.lit(False))).select(name.alias("name")).where(F.coalesce(F.col("name"), F.lit("")) != "")


def pick_model(preferred: list[str], available: list[str], explicit: str = "", default: str = "") -> str:
    """The asked model, else the first preferred one there is, else the first with "embedding" in its name, else the first, else the default."""
    names = sorted(available)
    if explicit.strip():
        return explicit.strip().removeprefix("models/")
    return next((m for m in preferred if m in names), None) or next((m for m in names if "embedding" in m), None) or (names[0] if names else default)


def request_json(text: Column, system: str = "") -> Column:
    """Body of a request for one text; never holds a key."""
    parts = F.array(F.struct(F.concat(F.lit(system), text).alias("text")))
    return F.to_json(F.struct(F.array(F.struct(parts.alias("parts"))).alias("contents")))
