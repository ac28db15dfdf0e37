"""Choice of recognition settings from a sweep over sampled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.scalars import CONFIDENT
from leafmill.functions.text import plain_words

#: The settings tried, the first being the default; weights of the signals; margins of the decision.
GRID = (("max_gray", "max", True, False, True), ("max_gray_raw", "max", False, False, False), ("max_binarize", "max", True, True, False), ("fast_gray", "fast", True, False, False))
WEIGHTS = {"conf": 0.30, "coverage": 0.30, "mass": 0.20, "agree": 0.20}
DECISIVE, MARGINAL = 0.08, 0.03


def grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *g) for i, g in enumerate(GRID)], "ord int, config string, mode string, preprocess boolean, binarize boolean, baseline boolean")


def sweep(pages: DataFrame) -> DataFrame:
    """Each sampled page with each setting; the grid has four rows."""
    return pages.crossJoin(F.broadcast(grid(pages.sparkSession)))


def sampled(pages: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, page): the first `most` pages of each document without a text layer, sought among its first 4 * most + 1 pages. Needs doc_id, page, has_text."""
    order = Window.partitionBy("doc_id").orderBy("page")
    seen = pages.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= 4 * most + 1)
    before = F.sum((~F.col("has_text")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return seen.withColumn("_b", F.coalesce(before, F.lit(0))).where((F.col("_b") < most) & ~F.col("has_text")).select("doc_id", "page")


def page_stats(lines: DataFrame) -> DataFrame:
    """(page_id, config, mean_conf, n_conf, mass): what each setting read of each page, from its lines (page_id, config, text, confidence)."""
    sure = F.col("confidence") >= CONFIDENT
    return lines.groupBy("page_id", "config").agg(F.avg("confidence").alias("mean_conf"), F.count_if(sure).alias("n_conf"), F.coalesce(F.sum(F.when(sure, F.length(F.trim("text")))), F.lit(0)).alias("mass"))


def agreement(lines: DataFrame) -> DataFrame:
    """(page_id, config, agree): the share of a setting's confident words that another setting read as well."""
    words = lines.where(F.col("confidence") >= CONFIDENT).select("page_id", "config", F.explode(plain_words(F.col("text"))).alias("word")).distinct()
    shared = F.count("*").over(Window.partitionBy("page_id", "word")) >= 2
    return words.withColumn("_s", shared).groupBy("page_id", "config").agg((F.count_if("_s") / F.count("*")).alias("agree"))


def scored(lines: DataFrame) -> DataFrame:
    """(page_id, config, mean_conf, n_conf, mass, agree, score): signals, each but agreement by the best of the page, and their weighted sum."""
    stats = page_stats(lines).join(agreement(lines), ["page_id", "config"], "left").fillna(0.0, ["agree"])
    page = Window.partitionBy("page_id")
    by_best = lambda c: F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), F.nullif(F.max(F.coalesce(F.col(c), F.lit(0.0))).over(page), F.lit(0.0))), F.lit(0.0))
    score = WEIGHTS["conf"] * by_best("mean_conf") + WEIGHTS["coverage"] * by_best("n_conf") + WEIGHTS["mass"] * by_best("mass") + WEIGHTS["agree"] * F.col("agree")
    return stats.withColumn("score", score)


def evidence(scores: DataFrame, baseline: str) -> DataFrame:
    """(config, composite, mean_conf, confident_lines, decision, recommended): averages over the pages and the choice. Of equal composites the first of the grid counts.

    One row for each setting: the last window is over these few.
    """
    each = scores.groupBy("config").agg(F.avg("score").alias("_c"), F.round(F.avg("mean_conf"), 3).alias("mean_conf"), F.round(F.avg("n_conf"), 1).alias("confident_lines"))
    whole = Window.partitionBy(F.lit(1))
    base = F.max(F.when(F.col("config") == baseline, F.col("_c"))).over(whole)
    best = F.max(F.when(F.col("config") != baseline, F.struct(F.col("_c").alias("c"), (-F.array_position(F.array(*[F.lit(g[0]) for g in GRID]), F.col("config"))).alias("o"), F.col("config").alias("n")))).over(whole)
    got = each.withColumns({"_base": base, "_best": best}).withColumn("_m", F.col("_best.c") - F.col("_base"))
    decision = F.when(F.col("_m") >= DECISIVE, "decisive").when(F.col("_m") >= MARGINAL, "marginal").otherwise("inconclusive")
    winner = F.when(F.col("_m") >= MARGINAL, F.col("_best.n")).otherwise(F.lit(baseline))
    return got.select("config", F.round("_c", 3).alias("composite"), "mean_conf", "confident_lines", decision.alias("decision"), (F.col("config") == winner).alias("recommended"))


def suggested(choice: DataFrame, lang: str = "en") -> DataFrame:
    """(decision, mode, lang, preprocess, binarize, margin, rationale, evidence): what `evidence` recommends, with the settings tried in order of their composites."""
    order = F.array(*[F.lit(g[0]) for g in GRID])
    place = F.array_position(order, F.col("config"))
    tried = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("composite")).alias("c"), place.alias("o"), "config", "composite"))), lambda x: F.concat_ws("=", x["config"], F.round(x["composite"], 3).cast("string")))
    row = choice.agg(
        F.max("decision").alias("decision"), F.max(F.when(F.col("recommended"), F.col("config"))).alias("_w"), F.array_join(tried, " ").alias("evidence"),
        F.max(F.when(F.col("recommended"), F.col("composite"))).alias("_top"), F.max(F.when(F.col("config") == GRID[0][0], F.col("composite"))).alias("_base"),
    )
    of = lambda k: F.element_at(F.array(*[F.lit(g[k]) for g in GRID]), F.array_position(order, F.col("_w")).cast("int"))
    got = row.where(F.col("_w").isNotNull()).select("decision", of(1).alias("mode"), F.lit(lang).alias("lang"), of(2).alias("preprocess"), of(3).alias("binarize"), F.round(F.col("_top") - F.col("_base"), 3).alias("margin"), "evidence")
    knobs = F.concat_ws(", ", F.when(F.col("binarize"), "binarisation on"), F.when(~F.col("preprocess"), "preprocessing off"), F.when(F.col("mode") == "fast", "faster mode"))
    strength = F.when(F.col("decision") == "decisive", "clearly").otherwise("slightly")
    said = F.concat(F.lit("On the sampled pages, "), F.coalesce(F.nullif(knobs, F.lit("")), F.lit("the default settings")), F.lit(" "), strength, F.lit(" outscored the default. Verify against the original."))
    none = F.lit("No other settings clearly beat the default on the sampled pages; the default is recommended.")
    return got.withColumn("rationale", F.when(F.col("decision") == "inconclusive", none).otherwise(said))


def rationale(decision: str, margin: float, mode: str = "max", preprocess: bool = True, binarize: bool = False) -> str:
    """Why settings are recommended, in a sentence."""
    if decision == "inconclusive":
        return "No other settings clearly beat the default on the sampled pages; the default is recommended."
    knobs = [k for k, on in (("binarisation on", binarize), ("preprocessing off", not preprocess), ("faster mode", mode == "fast")) if on]
    strength = "clearly" if decision == "decisive" else "slightly"
    return f"On the sampled pages, {', '.join(knobs) or 'the default settings'} {strength} outscored the default (by {margin:.2f}). Verify against the original."


def fallback(spark: SparkSession, reason: str, lang: str = "en") -> DataFrame:
    """The recommendation where nothing could be tried: the default settings and the reason."""
    default = GRID[0]
    return spark.createDataFrame([("inconclusive", reason, default[1], lang, default[2], default[3], False)], "decision string, rationale string, mode string, lang string, preprocess boolean, binarize boolean, handwriting boolean")


def born_digital(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, text_pages, needs_ocr): documents of which every page has a text layer need no recognition. Needs doc_id, page, has_text."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("has_text").alias("text_pages")).withColumn("needs_ocr", F.col("text_pages") < F.col("pages"))
