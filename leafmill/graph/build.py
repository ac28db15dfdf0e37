"""Knowledge graphs of all documents at once: nodes, edges, degrees and exports. Ids count from 0 within a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import node_key, strip
from leafmill.providers import Embedder, Extractor


def mentions(triples: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, key, name, type, page): every mention of a name in the order of reading; of a triple the subject comes before the object.

    Ends of triples that give no edge are mentions all the same. `entities` (doc_id, seq, page, name, type) come before the triples.
    """
    ends = F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("subject").alias("name")), F.struct(F.lit(1).alias("role"), F.col("object").alias("name"))))
    out = triples.dropDuplicates(["doc_id", "seq"]).select("doc_id", "seq", "page", ends.alias("e")).select("doc_id", F.struct(F.lit(1).alias("kind"), "seq", F.col("e.role").alias("role")).alias("pos"), F.col("e.name").alias("name"), F.lit("OTHER").alias("type"), "page")
    if entities is not None:
        first = entities.select("doc_id", F.struct(F.lit(0).alias("kind"), "seq", F.lit(0).alias("role")).alias("pos"), "name", F.coalesce(F.nullif("type", F.lit("")), F.lit("OTHER")).alias("type"), "page")
        out = first.unionByName(out)
    return out.withColumn("key", node_key(F.col("name"))).where(F.col("key") != "")


def nodes(mentioned: DataFrame) -> DataFrame:
    """(doc_id, node_id, key, name, type, pages): one node for each key; the first mention gives its name and place, the first known type its type.

    Mentions are combined map-side; ids are numbered within a document, by its first mentions.
    """
    grouped = mentioned.groupBy("doc_id", "key").agg(
        F.min("pos").alias("_first"),
        F.min_by(strip(F.col("name")), "pos").alias("name"),
        F.coalesce(F.min_by("type", F.when(F.col("type") != "OTHER", F.col("pos"))), F.lit("OTHER")).alias("type"),
        F.sort_array(F.collect_set("page")).alias("pages"),
    )
    order = Window.partitionBy("doc_id").orderBy("_first")
    return grouped.withColumn("node_id", F.row_number().over(order) - 1).select("doc_id", "node_id", "key", "name", "type", "pages")


def edges(triples: DataFrame, node: DataFrame) -> DataFrame:
    """(doc_id, seq, page, subject_id, object_id, predicate, subject, object): triples between two different nodes; equal facts of different `seq` stay."""
    once = triples.dropDuplicates(["doc_id", "seq"]).select("doc_id", "seq", "page", strip(F.coalesce("predicate", F.lit(""))).alias("predicate"), node_key(F.col("subject")).alias("_s"), node_key(F.col("object")).alias("_o"))
    one = node.select("doc_id", F.col("key").alias("_s"), F.col("node_id").alias("subject_id"), F.col("name").alias("subject"))
    two = node.select("doc_id", F.col("key").alias("_o"), F.col("node_id").alias("object_id"), F.col("name").alias("object"))
    return once.where((F.col("_s") != "") & (F.col("_o") != "") & (F.col("_s") != F.col("_o"))).join(one, ["doc_id", "_s"]).join(two, ["doc_id", "_o"]).select("doc_id", "seq", "page", "subject_id", "object_id", "predicate", "subject", "object")


def adjacency(edge: DataFrame) -> DataFrame:
    """(doc_id, node_id, other_id, seq): both directions of each edge."""
    there = edge.select("doc_id", F.col("subject_id").alias("node_id"), F.col("object_id").alias("other_id"), "seq")
    return there.unionByName(edge.select("doc_id", F.col("object_id").alias("node_id"), F.col("subject_id").alias("other_id"), "seq"))


def with_degree(node: DataFrame, edge: DataFrame) -> DataFrame:
    """The nodes with the number of edges at each."""
    degree = adjacency(edge).groupBy("doc_id", "node_id").agg(F.count("*").cast("int").alias("degree"))
    return node.join(degree, ["doc_id", "node_id"], "left").fillna(0, ["degree"])


def incident(edge: DataFrame, most: int) -> DataFrame:
    """(doc_id, node_id, seqs): the first `most` edges of each node; a top-k of each group, so that hubs are never gathered."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("seq"))
    first = adjacency(edge).withColumn("_r", rank).where(F.col("_r") <= most)
    return first.groupBy("doc_id", "node_id").agg(F.sort_array(F.collect_list("seq")).alias("seqs"))


def node_texts(node: DataFrame, edge: DataFrame, facts: int = 3) -> DataFrame:
    """(doc_id, node_id, text): what is embedded for a node, its name, type and first facts."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("seq"))
    first = adjacency(edge).withColumn("_r", rank).where(F.col("_r") <= facts)
    told = first.join(edge, ["doc_id", "seq"]).groupBy("doc_id", "node_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.concat_ws(" ", "subject", "predicate", "object").alias("t")))).alias("_f"))
    text = F.concat_ws(". ", F.format_string("%s (%s)", "name", "type"), F.nullif(F.array_join(F.transform("_f", lambda x: x["t"]), ". "), F.lit("")))
    return node.join(told, ["doc_id", "node_id"], "left").select("doc_id", "node_id", text.alias("text"))


def strongest(node: DataFrame, edge: DataFrame, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """The `most` nodes of highest degree of each document (ties by id) and the edges between them."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("degree"), "node_id"))
    top = with_degree(node, edge).withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")
    ids = top.select("doc_id", F.col("node_id").alias("subject_id"))
    kept = edge.join(ids, ["doc_id", "subject_id"], "left_semi").join(ids.withColumnRenamed("subject_id", "object_id"), ["doc_id", "object_id"], "left_semi")
    return top, kept


def summary(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(doc_id, num_nodes, num_edges)."""
    n = node.groupBy("doc_id").agg(F.count("*").alias("num_nodes"))
    return n.join(edge.groupBy("doc_id").agg(F.count("*").alias("num_edges")), "doc_id", "left").fillna(0, ["num_edges"])


def json_rows(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(doc_id, kind, ord, json): a graph's export as rows, `entity` by id and `triple` by seq; a writer puts them between brackets."""
    full = with_degree(node, edge)
    entity = full.select("doc_id", F.lit("entity").alias("kind"), F.col("node_id").cast("long").alias("ord"), F.to_json(F.struct("name", "type", "pages", "degree")).alias("json"))
    triple = edge.select("doc_id", F.lit("triple").alias("kind"), F.col("seq").alias("ord"), F.to_json(F.struct("subject", "predicate", "object", "page"), {"ignoreNullFields": "false"}).alias("json"))
    return entity.unionByName(triple)


def documents(node: DataFrame, edge: DataFrame, jobs: DataFrame, embed_model: str = "none") -> DataFrame:
    """(doc_id, filename, num_nodes, num_edges, embed_model, entities, triples): the graph export of each document in one row, as its JSON file holds it.
    For documents that do not fit into a value there is `json_rows`."""
    rows = json_rows(node, edge)
    parts = rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"]), ","), F.lit("]")).alias("j"))
    one = parts.groupBy("doc_id").agg(*[f for kind, n, j in (("entity", "num_nodes", "entities"), ("triple", "num_edges", "triples")) for f in (F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(n), F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("j"))), F.lit("[]")).alias(j))])
    names = jobs.groupBy(F.col("job_id").alias("doc_id")).agg(F.max("filename").alias("filename"))
    return one.join(names, "doc_id", "left").select("doc_id", "filename", "num_nodes", "num_edges", F.lit(embed_model).alias("embed_model"), "entities", "triples")


def from_pages(pages: DataFrame, make: Callable[[], Extractor], embedder: Callable[[], Embedder] | None = None, most: int = 0) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """(nodes, edges, vectors, telemetry): graphs built from the texts of pages by an extractor, a page's entities before its triples, pages in order.

    A page whose extraction fails is left out and counted; if all pages of all documents fail, the last error is raised. Responses are written
    once, so that nothing is asked twice.
    """
    from leafmill import providers
    from leafmill.session import materialised
    from leafmill.sources import payloads

    asked = materialised(providers.asked(usable_pages(pages, most), ["doc_id", "page"], "text", make))
    told = telemetry(asked)
    if (bad := asked.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.max("error").alias("e")).first())["ok"] == 0 and bad["e"]:
        raise providers.ProviderError(bad["e"])
    got = payloads.extracted(asked.where(F.col("error").isNull() & F.col("body").isNotNull()))
    seq = lambda i: F.col("page").cast("long") * 1_000_000 + i
    entities = got.select("doc_id", "page", F.posexplode("entities").alias("_i", "e")).select("doc_id", seq(F.col("_i")).alias("seq"), "page", "e.name", "e.type")
    triples = got.select("doc_id", "page", F.posexplode("triples").alias("_i", "t")).select("doc_id", seq(F.col("_i")).alias("seq"), "page", "t.*")
    node = materialised(nodes(mentions(triples, entities)))
    edge = materialised(edges(triples, node))
    vectors = providers.embedded(node_texts(node, edge), ["doc_id", "node_id"], "text", embedder) if embedder else None
    return node, edge, vectors, told


def telemetry(asked: DataFrame) -> DataFrame:
    """(doc_id, pages_built, pages_failed, last_error) of extraction responses (doc_id, page, error)."""
    bad = F.col("error").isNotNull()
    return asked.groupBy("doc_id").agg(F.count_if(~bad).alias("pages_built"), F.count_if(bad).alias("pages_failed"), F.max_by("error", F.when(bad, F.col("page"))).alias("last_error"))


def usable_pages(pages: DataFrame, most: int = 0) -> DataFrame:
    """Finished pages with text, of each document the first `most` in page order; 0 stands for all."""
    from leafmill.operators.pages import with_text

    kept = with_text(pages)
    if most <= 0:
        return kept
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("_r") <= most).drop("_r")
