"""Hybrid search in the graphs of all documents: scored seeds, paths from them, and explained answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import word_set
from leafmill.functions.vector import cosine01, jaccard
from leafmill.graph.build import adjacency, incident
from leafmill.session import checkpoint

#: Weights of likeness and of nearness, and what a step takes from nearness.
W_LIKE, W_NEAR, DECAY = 0.6, 0.4, 0.55


def lexical_scores(node: DataFrame, query: str) -> DataFrame:
    """(doc_id, node_id, sem): overlap of the words of names with those of the query."""
    q = word_set(F.lit(query or ""))
    return node.select("doc_id", "node_id", jaccard(word_set(F.col("name")), q).alias("sem"))


def vector_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(doc_id, node_id, sem): cosine with the query vector, in [0, 1]; nodes of another length score null and take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("doc_id", "node_id", cosine01(F.col("vec"), q).alias("sem")).where(F.col("sem").isNotNull())


def scores(node: DataFrame, vectors: DataFrame, text: str, query: list[float] | None) -> DataFrame:
    """(doc_id, node_id, sem, mode): by vectors in documents of which every node has one of the query's length, else by words. `vectors`: (node_id, vec)."""
    q = [float(x) for x in query or []]
    usable = any(q)
    once = vectors.where(F.col("vec").isNotNull()).groupBy("node_id").agg(F.max("vec").alias("vec"))
    both = node.join(once, "node_id", "left").withColumn("_ok", F.coalesce(F.size("vec") == len(q), F.lit(False)) & F.lit(usable))
    whole = F.min("_ok").over(Window.partitionBy("doc_id"))
    by_words = jaccard(word_set(F.col("name")), word_set(F.lit(text or "")))
    sem = F.when(whole, cosine01(F.col("vec"), F.array(*[F.lit(x) for x in q]))).otherwise(by_words) if usable else by_words
    return both.select("doc_id", "node_id", sem.alias("sem"), F.when(whole, "vector").otherwise("lexical").alias("mode"))


def seeds(scores: DataFrame, top_k: int = 6) -> DataFrame:
    """(doc_id, node_id, sem, rank): the best nodes of each document that score above 0; ties by id."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("sem"), "node_id"))
    return scores.where(F.col("sem") > 0).withColumn("rank", rank).where(F.col("rank") <= max(1, top_k))


def paths(seed: DataFrame, edge: DataFrame, hops: int = 2) -> DataFrame:
    """(doc_id, node_id, dist, src, pos, chain): nodes within `hops` of a seed, with the edges that lead there.

    Of all ways to a node of equal length the one of the earlier found parent counts, and of its edges the earlier. A level is a join of the
    frontier with the edges, without the nodes met before; each level's lineage is cut.
    """
    near = adjacency(edge)
    level = seed.select("doc_id", "node_id", F.lit(0).alias("dist"), F.col("node_id").alias("src"), F.col("rank").cast("long").alias("pos"), F.array().cast("array<bigint>").alias("chain"))
    met = level
    for dist in range(1, max(0, hops) + 1):
        steps = level.join(near, ["doc_id", "node_id"]).select("doc_id", F.col("other_id").alias("node_id"), F.struct("pos", "seq").alias("_way"), "src", F.concat("chain", F.array(F.col("seq").cast("long"))).alias("chain"))
        fresh = steps.join(met.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
        best = fresh.groupBy("doc_id", "node_id").agg(F.min_by(F.struct("_way", "src", "chain"), "_way").alias("_b")).select("doc_id", "node_id", "_b.*")
        pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("_way")) + F.lit(dist * 1_000_000_000_000)
        level = checkpoint(best.withColumn("pos", pos).select("doc_id", "node_id", F.lit(dist).alias("dist"), "src", "pos", "chain"))
        met = met.unionByName(level)
    return met


def answers(node: DataFrame, edge: DataFrame, scores: DataFrame, top_k: int = 6, hops: int = 2, max_results: int = 10) -> DataFrame:
    """(doc_id, rank, node_id, name, type, score, similarity, hops, pages, chain, path_pages, facts): the best answers of each document.

    `chain` and `facts` are the `seq` of triples: the path from the seed, and the first edges of the node. An empty query or graph, or one in
    which nothing scores above 0, gives no rows. Ties go by distance, then by the order of discovery.
    """
    start = seeds(scores, top_k)
    reach = paths(start, edge, hops).join(scores, ["doc_id", "node_id"], "left").fillna(0.0, ["sem"])
    source = start.select("doc_id", F.col("node_id").alias("src"), F.col("sem").alias("_src"))
    score = F.lit(W_LIKE) * F.col("sem") + F.lit(W_NEAR) * F.col("_src") * F.pow(F.lit(DECAY), F.col("dist"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "dist", "pos"))
    top = reach.join(source, ["doc_id", "src"]).withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= max(1, max_results))
    on_path = top.select("doc_id", "node_id", F.explode("chain").alias("seq")).join(edge.select("doc_id", "seq", "page"), ["doc_id", "seq"])
    pages = on_path.groupBy("doc_id", "node_id").agg(F.sort_array(F.collect_set("page")).alias("path_pages"))
    facts = incident(edge, 6).withColumnRenamed("seqs", "facts")
    out = top.join(node, ["doc_id", "node_id"]).join(pages, ["doc_id", "node_id"], "left").join(facts, ["doc_id", "node_id"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("doc_id", "rank", "node_id", "name", "type", F.round("score", 4).alias("score"), F.round("sem", 4).alias("similarity"), F.col("dist").alias("hops"), "pages", "chain", none("path_pages", "array<int>"), none("facts", "array<bigint>"))


def supporting(answer: DataFrame, edge: DataFrame) -> DataFrame:
    """(doc_id, seq, subject, predicate, object, page): the triples that answers rest on, each once."""
    used = answer.select("doc_id", F.explode(F.array_union("chain", "facts")).alias("seq")).distinct()
    return used.join(edge, ["doc_id", "seq"]).select("doc_id", "seq", "subject", "predicate", "object", "page")

