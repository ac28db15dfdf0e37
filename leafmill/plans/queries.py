"""Queries of the core by name; each takes (spark, folder) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import providers
from leafmill.functions import scalars, text
from leafmill.functions.vector import cosine01
from leafmill.graph import build, search
from leafmill.operators import headers, jobs, layout, nested, pages, recommend
from leafmill.session import materialised
from leafmill.sources import payloads
from leafmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: What the search queries look for.
PHRASE, GRAPH_QUERY = "committee", "Hydrology Institute of Printing"
NOW = "2031-03-05 00:00:00"


def _joined(c: str, by: str = ",") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), by)


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages.best_pages(table(spark, folder, "page_results"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.found_lines(table(spark, folder, "job_dumps"))


def _dump_table(spark: SparkSession, folder: str, name: str, usual: dict[str, str]) -> DataFrame:
    """A flat table of the dumps with the columns of its merged schema; usual ones that no record has are null, and have the same type always."""
    made = nested.flatten_dumps(table(spark, folder, "job_dumps"), (name,))
    df = made.get(name)
    if df is None:
        schema = ", ".join(f"`{c}` {t}" for c, t in ({"dump_id": "long", f"{name}_key": "string", "parent_key": "string", "ordinal": "int"} | usual).items())
        return spark.createDataFrame([], schema)
    return df.select(*[c for c in df.columns if c not in usual], *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in usual.items()])


def p3_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return _dump_table(spark, folder, "job", {"error": "string", "filename": "string", "job_id": "string", "meta_version": "long", "processed_pages": "long", "status": "string", "total_pages": "long"})


def p3_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _dump_table(spark, folder, "page", {"confidence": "string", "error": "string", "page": "string", "source": "string", "status": "string", "text": "string"})


def p3_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _dump_table(spark, folder, "line", {"page_no": "int", "confidence": "double", "text": "string"})


def p3_alternatives(spark: SparkSession, folder: str) -> DataFrame:
    return _dump_table(spark, folder, "pages_lines_alternatives", {"page_no": "int", "line_no": "int", "confidence": "double", "text": "string"})


def q_best_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("doc_id", "page", "source", "text", "status", "error", "confidence")


def q_text_layer(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("doc_id", "page", text.alnum_count(F.col("text")).alias("letters"), text.has_text_layer(F.col("text")).alias("has_text"))


def q_page_route(spark: SparkSession, folder: str) -> DataFrame:
    return pages.routed(_pages(spark, folder), table(spark, folder, "jobs"), key="given")


def q_header_keys(spark: SparkSession, folder: str) -> DataFrame:
    p = _pages(spark, folder)
    return headers.running_keys(headers.banded(p), p, 0.5)


def q_strip_headers(spark: SparkSession, folder: str) -> DataFrame:
    return headers.stripped(_pages(spark, folder)).select("doc_id", "page", "text", _joined("kept").alias("kept"))


def q_strip_headers_low(spark: SparkSession, folder: str) -> DataFrame:
    return headers.stripped(_pages(spark, folder), min_frac=0.3).select("doc_id", "page", "text", _joined("kept").alias("kept"))


def q_line_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return pages.confidences(_pages(spark, folder)).withColumn("mean_confidence", F.round("mean_confidence", 6))


def q_page_labels(spark: SparkSession, folder: str) -> DataFrame:
    return pages.labelled(_pages(spark, folder))


def q_search(spark: SparkSession, folder: str) -> DataFrame:
    return pages.search(_pages(spark, folder), PHRASE)


def q_export_txt(spark: SparkSession, folder: str) -> DataFrame:
    return pages.text_blocks(_pages(spark, folder), table(spark, folder, "jobs"), "txt")


def q_export_md(spark: SparkSession, folder: str) -> DataFrame:
    return pages.text_blocks(_pages(spark, folder), table(spark, folder, "jobs"), "md")


def q_export_copy(spark: SparkSession, folder: str) -> DataFrame:
    return pages.text_blocks(_pages(spark, folder), table(spark, folder, "jobs"), "copy")


def q_export_json(spark: SparkSession, folder: str) -> DataFrame:
    return pages.json_rows(_pages(spark, folder))


def q_export_documents(spark: SparkSession, folder: str) -> DataFrame:
    return pages.json_documents(_pages(spark, folder), table(spark, folder, "jobs"))


def q_search_total(spark: SparkSession, folder: str) -> DataFrame:
    return pages.search_totals(_pages(spark, folder), PHRASE)


def q_outline(spark: SparkSession, folder: str) -> DataFrame:
    return pages.outline(_pages(spark, folder), table(spark, folder, "jobs"))


def q_realign(spark: SparkSession, folder: str) -> DataFrame:
    p = _pages(spark, folder)
    cleaned = headers.stripped(p, min_frac=0.3).select("doc_id", "page", F.col("text").alias("cleaned"))
    joined = p.select("doc_id", "page", "lines").join(cleaned, ["doc_id", "page"])
    return joined.select("doc_id", "page", F.transform(pages.realigned(F.col("cleaned"), F.col("lines")), lambda x: x["confidence"]).alias("confidences"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in: rows of `lineitem` as boxes of pages, as no table holds boxes of its own."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 7 % 400).cast("double").alias("y"), (F.col("l_suppkey") * 13 % 101).cast("double").alias("x"),
        (F.lit(4) + F.col("l_linenumber") % 5 * 6).cast("double").alias("h"), F.concat_ws("-", "l_linestatus", F.col("l_linenumber").cast("string")).alias("text"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
    )


def q_reading_order(spark: SparkSession, folder: str) -> DataFrame:
    return layout.reading_order(_boxes(spark, folder), ["page"]).select("page", "row_no", "pos", "text")


def q_reading_order_handwriting(spark: SparkSession, folder: str) -> DataFrame:
    centred = _boxes(spark, folder).withColumn("y", F.col("y") + F.col("h") / 2)
    return layout.reading_order(centred, ["page"], floor=8.0).select("page", "row_no", "pos", "text")


def _sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in: lines of an order as what one of four settings read of a page."""
    li, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    config = F.element_at(F.array(*[F.lit(g[0]) for g in recommend.GRID]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.floor(F.col("l_orderkey") / 8).alias("page_id"), config.alias("config"), F.col("p_name").alias("text"), (F.lit(1.0) - F.col("l_discount") * 4).alias("confidence"))


def q_settings_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = recommend.scored(_sweep(spark, folder))
    return s.select("page_id", "config", F.round("mean_conf", 6).alias("mean_conf"), "n_conf", "mass", F.round("agree", 6).alias("agree"), F.round("score", 6).alias("score"))


def q_settings_choice(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.evidence(recommend.scored(_sweep(spark, folder)), "max_gray")


def q_suggest(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.suggested(recommend.evidence(recommend.scored(_sweep(spark, folder)), "max_gray"))


def q_born_digital(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.born_digital(_pages(spark, folder).select("doc_id", "page", text.has_text_layer(F.when(F.col("source") == "text", F.col("text"))).alias("has_text")))


def q_sampled_pages(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.sampled(_pages(spark, folder).select("doc_id", "page", text.has_text_layer(F.when(F.col("source") == "text", F.col("text"))).alias("has_text")))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    triples = table(spark, folder, "kg_triples")
    node = build.nodes(build.mentions(triples))
    return node, build.edges(triples, node)


def q_graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    node, edge = _graph(spark, folder)
    return build.with_degree(node, edge).select("doc_id", "node_id", "name", "type", _joined("pages").alias("pages"), "degree")


def q_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder)[1]


def q_graph_texts(spark: SparkSession, folder: str) -> DataFrame:
    return build.node_texts(*_graph(spark, folder))


def q_graph_json(spark: SparkSession, folder: str) -> DataFrame:
    return build.json_rows(*_graph(spark, folder))


def q_graph_strongest(spark: SparkSession, folder: str) -> DataFrame:
    top, kept = build.strongest(*_graph(spark, folder))
    shown = kept.groupBy("doc_id").agg(F.count("*").alias("edges"))
    return top.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.min("degree").alias("least_degree"), F.sum("node_id").alias("ids")).join(shown, "doc_id", "left").fillna(0, ["edges"])


def q_graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    return build.summary(*_graph(spark, folder))


def q_graph_documents(spark: SparkSession, folder: str) -> DataFrame:
    return build.documents(*_graph(spark, folder), table(spark, folder, "jobs"))


def q_graph_build(spark: SparkSession, folder: str) -> DataFrame:
    """Graphs built by the stand-in extractor from the texts of pages."""
    node, edge, _, _ = build.from_pages(_pages(spark, folder), providers.PatternExtractor)
    return build.with_degree(node, edge).select("doc_id", "node_id", "name", "type", "degree")


def q_graph_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds in the graphs as stored: by vectors where all nodes have one, else by words."""
    v = table(spark, folder, "kg_vectors")
    first = v.where(F.col("vec").isNotNull()).agg(F.min_by("vec", F.struct("node_id", F.transform("vec", lambda x: -x)))).first()[0]
    node = table(spark, folder, "kg_nodes").select("doc_id", "node_id", "name").distinct()
    scored_ = search.scores(node, v, GRAPH_QUERY, first).withColumn("sem", F.round("sem", 6))
    return search.seeds(scored_).select("doc_id", "mode", "node_id", "sem", "rank")


def _stored_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges written once, as a search reads them level after level."""
    node, edge = _graph(spark, folder)
    node = materialised(node)
    return node, materialised(build.edges(table(spark, folder, "kg_triples"), node))


def q_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    node, edge = _stored_graph(spark, folder)
    got = search.answers(node, edge, search.lexical_scores(node, GRAPH_QUERY))
    return got.select("doc_id", "rank", "name", "type", "score", "similarity", "hops", _joined("pages").alias("pages"), _joined("chain").alias("chain"), _joined("path_pages").alias("path_pages"), _joined("facts").alias("facts"))


def q_graph_search_support(spark: SparkSession, folder: str) -> DataFrame:
    node, edge = _stored_graph(spark, folder)
    return search.supporting(search.answers(node, edge, search.lexical_scores(node, GRAPH_QUERY)), edge)


def q_vector_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 nodes most like the first one with a vector: a top-k report."""
    v = table(spark, folder, "kg_vectors").where(F.col("vec").isNotNull()).groupBy("node_id").agg(F.max("vec").alias("vec"))
    first = v.agg(F.min_by("vec", "node_id").alias("q"))
    scored_ = v.crossJoin(F.broadcast(first)).select("node_id", F.round(cosine01(F.col("vec"), F.col("q")), 6).alias("sem"))
    return scored_.where(F.col("sem") > 0).orderBy(F.desc("sem"), "node_id").limit(50)


def q_job_state(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.state(table(spark, folder, "job_events"))


def q_job_pages(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.latest_page_events(table(spark, folder, "job_events"))


def q_job_frames(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.sse_frames(table(spark, folder, "job_events"))


def q_jobs_evicted(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.evicted(jobs.state(table(spark, folder, "job_events")), NOW, ttl_seconds=48 * 3600)


def q_payload_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Triples put into responses of a service, among broken elements, and read again."""
    t = table(spark, folder, "kg_triples").dropDuplicates(["doc_id", "seq"])
    inner = F.concat(F.lit("```json\n[1, \"x\", {\"subject\": \"only\"}, "), F.to_json(F.struct("subject", "predicate", "object")), F.lit("]\n```"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(inner.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    return payloads.extracted(t.select("doc_id", "seq", body.alias("body"))).select("doc_id", "seq", F.explode("triples").alias("t")).select("doc_id", "seq", "t.subject", "t.predicate", "t.object")


def q_filenames(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "jobs").distinct()
    name = F.col("filename")
    return j.select("job_id", scalars.is_pdf(name).alias("is_pdf"), scalars.base_name(name, F.lit(1)).alias("base"), scalars.script_model(F.col("lang")).alias("model"), scalars.failure_kind(F.col("error")).alias("failure"), text.shortened(name, 12).alias("short"), scalars.clamp(F.col("total_pages"), 36, 600).alias("clamped"), scalars.truthy(F.col("preprocess").cast("string")).alias("truthy"), scalars.model_name(F.col("online_model"), "none").alias("online_model")).distinct()


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p3_found, p3_jobs, p3_pages, p3_lines, p3_alternatives, q_best_pages, q_text_layer, q_page_route, q_header_keys, q_strip_headers, q_strip_headers_low, q_line_confidence, q_page_labels, q_search,
            q_export_txt, q_export_md, q_export_copy, q_export_json, q_export_documents, q_search_total, q_outline, q_realign, q_reading_order, q_reading_order_handwriting, q_settings_scores, q_settings_choice, q_suggest, q_sampled_pages, q_born_digital,
            q_graph_nodes, q_graph_edges, q_graph_texts, q_graph_json, q_graph_documents, q_graph_build, q_graph_seeds, q_graph_strongest, q_graph_summary, q_graph_search, q_graph_search_support, q_vector_seeds,
            q_job_state, q_job_pages, q_job_frames, q_jobs_evicted, q_payload_triples, q_filenames,
        )
    }
