"""Queries of this subpackage by name; each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm import canonical, langid, mixing, mojibake, names, neighbours, scans, sentences, tokens
from leafmill.sources.tables import page_counts, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.found(*(table(spark, folder, t) for t in ("page_results", "jobs", "lang_codes")))


def p1_stretches(spark: SparkSession, folder: str) -> DataFrame:
    pages, jobs, codes = (table(spark, folder, t) for t in ("page_results", "jobs", "lang_codes"))
    return langid.stretches(page_counts(pages), ["doc_id", "page"], langid.trained(pages, jobs, codes))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.found_pages(table(spark, folder, "page_results"))


def p2_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.restored(page_counts(table(spark, folder, "page_results")), ["doc_id", "page"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.found(table(spark, folder, "page_results"))


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    return scans.clean_pages(table(spark, folder, "page_results"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.found(table(spark, folder, "page_results"), table(spark, folder, "kg_triples"))


def p5_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each text of a page (`field` is text) and each field of a triple, with its canonical form."""
    pages = page_counts(table(spark, folder, "page_results")).select(F.lit("page").alias("place"), "doc_id", F.col("page").cast("long").alias("num"), F.lit("text").alias("field"), F.col("text").alias("value"))
    triples = table(spark, folder, "kg_triples").select("doc_id", "seq", "subject", "predicate", "object").distinct()
    fields = triples.select("doc_id", F.col("seq").cast("long").alias("num"), F.explode(F.create_map(*[x for c in ("subject", "predicate", "object") for x in (F.lit(c), F.col(c))])).alias("field", "value"))
    return canonical.with_canonical(pages.unionByName(fields.select(F.lit("triple").alias("place"), "doc_id", "num", "field", "value")), "value", "canonical")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.found(table(spark, folder, "kg_vectors"))


def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """(node, rank, other, cosine): the five most similar vectors of each, of cosine 0.88 and more."""
    best = neighbours.most_similar(table(spark, folder, "kg_vectors"), 5, 0.88)
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "other"))
    return best.select("node", rank.alias("rank"), "other", F.round("cosine", 6).alias("cosine"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.found(table(spark, folder, "kg_nodes"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.document_ids(table(spark, folder, "documents"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The mix as token ids, ready to be written."""
    documents = table(spark, folder, "documents")
    return mixing.materialised(p9_mix(spark, folder), documents)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.found(table(spark, folder, "documents"))


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return sentences.sentence_texts(documents, ["doc_id"], sentences.trained(documents))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_stretches, p2_found, p2_restored, p4_found, p4_text, p5_found, p5_canonical, p6_found, p6_neighbours, p7_found, p8_ids, p9_mix, p9_ids, p9_shares, p10_found, p10_sentences)}


def oracle_sql() -> dict[str, str]:
    return {}
