"""Running headers and footers of a document, found by lines that come again in the same band of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import line_key, strip, tidy


def edge_lines(text: Column, band: int = 3) -> Column:
    """(i, line, band, key) of the first and last `band` lines of a page that are not blank. The bands never meet: at most half of the lines are in either."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    filled = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda s: strip(s["line"]) != "")
    made = lambda side: lambda s: F.struct(s["i"].alias("i"), s["line"].alias("line"), F.lit(side).alias("band"), line_key(s["line"]).alias("key"))

    def cut(all_: Column) -> Column:
        b = F.least(F.lit(band), F.floor(F.size(all_) / 2)).cast("int")
        return F.concat(F.transform(F.slice(all_, 1, b), made("top")), F.transform(F.slice(all_, F.size(all_) - b + 1, b), made("bottom")))

    return F.get(F.transform(F.array(filled), cut), F.lit(0))


def banded(pages: DataFrame, band: int = 3) -> DataFrame:
    """(doc_id, page, i, line, band, key): the edge lines of each page; a page without any is one row of nulls. Only these leave the page."""
    return pages.select("doc_id", "page", F.explode_outer(edge_lines(F.col("text"), band)).alias("e")).select("doc_id", "page", "e.*")


def running_keys(lines: DataFrame, pages: DataFrame, min_frac: float = 0.7, min_pages: int = 3) -> DataFrame:
    """(doc_id, band, key, pages): keys on at least `min_frac` of the pages of a document (all pages count, also failed and empty ones), and on two at least.

    Counts of pages are combined map-side; documents of fewer than `min_pages` pages have none.
    """
    size = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("_all"))
    seen = lines.where(F.col("band").isNotNull() & (F.col("key") != "")).groupBy("doc_id", "band", "key").agg(F.count_distinct("page").alias("pages"))
    enough = F.greatest(F.lit(2), F.ceil(F.lit(min_frac) * F.col("_all")))
    return seen.join(size, "doc_id").where((F.col("_all") >= min_pages) & (F.col("pages") >= enough)).select("doc_id", "band", "key", "pages")


def stripped(pages: DataFrame, band: int = 3, min_frac: float = 0.7, min_pages: int = 3) -> DataFrame:
    """(doc_id, page, text, kept): pages without running lines, and the numbers of the lines kept.

    Documents without running lines come back byte for byte. A page of nothing but running lines keeps them all. Texts stay where they are:
    only edge lines are matched, and the numbers of running ones come back to their page.
    """
    lines = banded(pages, band)
    keys = running_keys(lines, pages, min_frac, min_pages)
    marked = lines.join(keys.select("doc_id", "band", "key", F.lit(True).alias("_run")), ["doc_id", "band", "key"], "left")
    drop = marked.groupBy("doc_id", "page").agg(F.collect_set(F.when(F.col("_run"), F.col("i"))).alias("_drop"))  # at most the two bands
    flags = drop.join(keys.select("doc_id").distinct(), "doc_id", "left_semi")
    joined = pages.select("doc_id", "page", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_l")).join(flags, ["doc_id", "page"], "left")
    rest = F.filter("_l", lambda x, i: ~F.array_contains("_drop", i))
    left, some = F.exists(rest, lambda x: strip(x) != ""), F.exists("_l", lambda x: strip(x) != "")
    touched, keep_all = F.col("_drop").isNotNull(), some & ~left
    whole = F.array_join("_l", "\n")
    text = F.when(~touched, whole).when(keep_all, F.btrim(whole, F.lit("\n"))).otherwise(tidy(F.array_join(rest, "\n")))
    numbers = F.sequence(F.lit(0), F.size("_l") - 1)
    kept = F.when(~touched | keep_all, numbers).otherwise(F.filter(numbers, lambda i: ~F.array_contains("_drop", i)))
    return joined.select("doc_id", "page", text.alias("text"), kept.alias("kept"))
