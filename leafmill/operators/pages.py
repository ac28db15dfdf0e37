"""Pages, their lines and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.scalars import CONFIDENT, LOW_CONFIDENCE, badge, display_text, heading_tag, route
from leafmill.functions.text import has_text_layer, is_blank, match_count, strip, xml_safe


def latest(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`; whole rows are compared after it, so that ties have one outcome. Combined map-side."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[F.col(c) for c in rest if c != "lines"])).alias("_last")).select(*keys, "_last.*")


def best_pages(pages: DataFrame) -> DataFrame:
    """One row for each page: a finished attempt before a failed one before a pending one, the most text of equal ones. Repeated and late rows don't matter."""
    rank = F.when(F.col("status") == "done", 2).when(F.col("status") == "error", 1).otherwise(0)
    return latest(pages, ["doc_id", "page"], [rank, F.coalesce(F.length("text"), F.lit(-1))])


def with_text(pages: DataFrame) -> DataFrame:
    """Finished pages that are not blank."""
    return pages.where((F.col("status") == "done") & ~is_blank(F.col("text")))


def routed(pages: DataFrame, jobs: DataFrame, key: str = "") -> DataFrame:
    """(doc_id, page, has_text, route). Options of a job written twice count once; a page without a job goes by the defaults."""
    options = jobs.groupBy(F.col("job_id").alias("doc_id")).agg(*[F.max(c).alias(c) for c in ("force_ocr", "online", "handwriting")])
    layer = F.when(F.col("source") == "text", has_text_layer(F.col("text"))).otherwise(False)
    joined = pages.select("doc_id", "page", layer.alias("has_text")).join(options, "doc_id", "left")
    return joined.select("doc_id", "page", "has_text", route(F.col("has_text"), F.col("force_ocr"), F.col("online"), F.lit(key), F.col("handwriting")).alias("route"))


def branches(pages: DataFrame, readers: dict[str, object], schema: str) -> DataFrame:
    """Pages read by the reader of their route: each route is filtered before its reader, as a CASE does not keep costly functions from running."""
    parts = [pages.where(F.col("route") == name).mapInPandas(reader, schema) for name, reader in readers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def confidences(pages: DataFrame) -> DataFrame:
    """(doc_id, page, mean_confidence, n_lines, n_low, n_confident, mass): by the lines of each page; null or no lines give a null mean."""
    conf = F.transform("lines", lambda x: x["confidence"])
    kept = F.filter(conf, lambda c: c.isNotNull())
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, c: a + c) / F.size(kept))
    mass = F.aggregate(F.filter("lines", lambda x: x["confidence"] >= CONFIDENT), F.lit(0), lambda a, x: a + F.length(strip(F.coalesce(x["text"], F.lit("")))))
    return pages.select(
        "doc_id", "page", mean.alias("mean_confidence"), F.coalesce(F.array_size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(F.filter(kept, lambda c: c < LOW_CONFIDENCE)), F.lit(0)).alias("n_low"),
        F.coalesce(F.size(F.filter(kept, lambda c: c >= CONFIDENT)), F.lit(0)).alias("n_confident"), F.coalesce(mass, F.lit(0)).alias("mass"),
    )


def labelled(pages: DataFrame) -> DataFrame:
    """(doc_id, page, badge, shown, low): label and shown text of each page, and whether it is to be checked."""
    low = (F.col("status") == "done") & F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(False))
    return pages.select("doc_id", "page", badge(F.col("status"), F.col("source"), F.col("confidence")).alias("badge"), display_text(F.col("status"), F.col("error"), F.col("text")).alias("shown"), F.coalesce(low, F.lit(False)).alias("low"))


def search(pages: DataFrame, query: str) -> DataFrame:
    """(doc_id, page, matches) of pages that hold the query."""
    return pages.select("doc_id", "page", match_count(F.col("text"), query).alias("matches")).where(F.col("matches") > 0)


def realigned(cleaned: Column, lines: Column) -> Column:
    """Lines of a cleaned text with their confidences: both sequences are walked in step; a line that is not met again
    uses up the originals, so that it and all later ones have none. Null or no originals give null."""
    rows = F.split(F.coalesce(cleaned, F.lit("")), "\n", -1)
    kind = "array<struct<text:string,confidence:double>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, line: Column) -> Column:
        rest = F.slice(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), a["at"] + 1, F.size(lines))
        k = F.array_position(rest, line)
        hit = F.get(lines, (a["at"] + k - 1).cast("int"))
        new = F.when(k > 0, F.struct(hit["text"].alias("text"), hit["confidence"].cast("double").alias("confidence"))).otherwise(F.struct(line.alias("text"), F.lit(None).cast("double").alias("confidence")))
        return F.struct(F.when(k > 0, a["at"] + k.cast("int")).otherwise(F.size(lines)).alias("at"), F.concat(a["out"], F.array(new)).cast(kind).alias("out"))

    return F.when(F.size(lines) > 0, F.aggregate(rows, start, step, lambda a: a["out"]))


def text_blocks(pages: DataFrame, jobs: DataFrame, style: str) -> DataFrame:
    """(doc_id, page, block): a document's export as blocks in page order, page 0 being its title; a writer sorts by page and
    puts the blocks after each other, so that no document must fit into one value.

    style: `txt`, `md` or `copy`.
    """
    name = jobs.groupBy(F.col("job_id").alias("doc_id")).agg(F.max("filename").alias("filename"))
    shown = display_text(F.col("status"), F.col("error"), F.col("text"))
    number = F.col("page").cast("string")
    if style == "md":
        title = F.concat(F.lit("# "), F.coalesce("filename", F.lit("")), F.lit("\n"))
        body = F.concat(F.lit("## Page "), number, F.lit("\n\n"), F.coalesce(F.nullif(shown, F.lit("")), F.lit("_(no text)_")), F.lit("\n"))
    else:
        title = F.concat(F.lit("===== "), F.coalesce("filename", F.lit("")), F.lit(" =====\n" if style == "txt" else " ====="))
        body = F.concat(F.lit("--- Page "), number, F.lit(" ---\n"), shown, F.lit("\n" if style == "txt" else ""))
    titles = pages.select("doc_id").distinct().join(name, "doc_id", "left").select("doc_id", F.lit(0).alias("page"), title.alias("block"))
    return titles.unionByName(pages.select("doc_id", "page", body.alias("block")))


def json_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, page, json): each page as it stands in the JSON export, without its lines."""
    return pages.select("doc_id", "page", F.to_json(F.struct("page", "source", "status", "confidence", "text"), {"ignoreNullFields": "false"}).alias("json"))


def json_documents(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """(doc_id, json): the JSON export of each document in one row: its file name, state and pages in order, without lines. For documents that do not fit into a value there is `json_rows`."""
    of = jobs.groupBy(F.col("job_id").alias("doc_id")).agg(F.max("filename").alias("filename"), F.max("status").alias("status"), F.max("total_pages").alias("total_pages"))
    each = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "source", "status", "confidence", "text"))).alias("pages"))
    body = F.struct("filename", F.col("doc_id").alias("job_id"), "status", "total_pages", "pages")
    return each.join(of, "doc_id", "left").select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def search_totals(pages: DataFrame, query: str) -> DataFrame:
    """(doc_id, matches, pages): matches of a query in each document, and the pages that hold it."""
    return search(pages, query).groupBy("doc_id").agg(F.sum("matches").alias("matches"), F.count("*").alias("pages"))


def outline(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """(doc_id, page, seq, kind, text): headings and paragraphs of the word-processor export."""
    name = jobs.groupBy(F.col("job_id").alias("doc_id")).agg(F.max("filename").alias("filename"))
    head = pages.select("doc_id").distinct().join(name, "doc_id", "left").select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("seq"), F.lit("h1").alias("kind"), xml_safe(F.coalesce(F.nullif("filename", F.lit("")), F.lit("Document"))).alias("text"))
    second = pages.select("doc_id", "page", F.lit(0).alias("seq"), F.lit("h2").alias("kind"), F.concat(F.lit("Page "), F.col("page").cast("string"), heading_tag(F.col("source"), F.col("confidence"))).alias("text"))
    safe = pages.select("doc_id", "page", xml_safe(F.col("text")).alias("_t"))
    lines = safe.where(~is_blank(F.col("_t"))).select("doc_id", "page", F.posexplode(F.split("_t", "\n", -1)).alias("seq", "text")).select("doc_id", "page", (F.col("seq") + 1).alias("seq"), F.lit("p").alias("kind"), "text")
    empty = safe.where(is_blank(F.col("_t"))).select("doc_id", "page", F.lit(1).alias("seq"), F.lit("empty").alias("kind"), F.lit("(no text on this page)").alias("text"))
    return head.unionByName(second).unionByName(lines).unionByName(empty)


def threaded(lines: Column, kept: Column, cleaned: Column) -> Column:
    """Lines of a cleaned page by the numbers of the lines kept; where their texts are not those of the cleaned page, as after trimming, by `realigned`."""
    picked = F.transform(F.filter(kept, lambda i: i < F.size(lines)), lambda i: F.get(lines, i))
    texts = F.transform(picked, lambda x: F.coalesce(x["text"], F.lit("")))
    same = texts == F.split(F.coalesce(cleaned, F.lit("")), "\n", -1)
    return F.when(F.size(lines) > 0, F.when(same, F.transform(picked, lambda x: F.struct(x["text"].alias("text"), x["confidence"].cast("double").alias("confidence")))).otherwise(realigned(cleaned, lines)))
