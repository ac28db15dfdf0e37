"""Reading order of recognised boxes and of text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_numbers(items: Column, tolerance: Column) -> Column:
    """Row of each of the items (sorted structs with `y`): a row begins where an item is further than the tolerance from the first of the row before."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, x: Column) -> Column:
        new = a["anchor"].isNull() | (F.abs(x["y"] - a["anchor"]) > tolerance)
        row = a["row"] + new.cast("int")
        return F.struct(F.when(new, x["y"]).otherwise(a["anchor"]).alias("anchor"), row.alias("row"), F.concat(a["rows"], F.array(row)).alias("rows"))

    return F.aggregate(items, start, step, lambda a: a["rows"])


def reading_order(boxes: DataFrame, keys: list[str], floor: float = 6.0, share: float = 0.6) -> DataFrame:
    """(keys, row_no, pos, text, confidence): boxes (keys, y, x, h, text, confidence) as lines, top to bottom and left to right.

    The tolerance is a share of the median height of the boxes that have one (12 without any), but at least `floor`: 6 with the top edges of
    printed text, 8 with the centres of handwriting. Boxes of a page are gathered in one row, whose size a page bounds; boxes without a place are left out.
    """
    placed = boxes.where(F.col("y").isNotNull() & F.col("x").isNotNull())
    median = F.coalesce(F.percentile(F.when(F.col("h") > 0, F.col("h")), F.lit(0.5)), F.lit(12.0))
    page = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "text", "confidence"))).alias("_b"), F.greatest(median * share, F.lit(floor)).alias("_t"))
    rows = page.withColumn("_r", row_numbers(F.col("_b"), F.col("_t")))
    item = F.zip_with("_r", "_b", lambda r, b: F.struct(r.alias("row_no"), b["x"].alias("x"), b["y"].alias("y"), b["text"].alias("text"), b["confidence"].alias("confidence")))
    return rows.select(*keys, F.posexplode(F.sort_array(item)).alias("pos", "_i")).select(*keys, "_i.row_no", "pos", "_i.text", "_i.confidence")


def box_geometry(box: Column) -> tuple[Column, Column, Column]:
    """(y, x, h) of a quadrilateral of [x, y] points: its top, its left and its height."""
    ys, xs = F.transform(box, lambda p: p[1].cast("double")), F.transform(box, lambda p: p[0].cast("double"))
    return F.array_min(ys), F.array_min(xs), F.array_max(ys) - F.array_min(ys)


def crop_size(box: Column) -> tuple[Column, Column]:
    """(width, height) of a quadrilateral: the longer of its opposite edges, 1 at least."""
    edge = lambda a, b: F.hypot(F.get(box, F.lit(a))[0] - F.get(box, F.lit(b))[0], F.get(box, F.lit(a))[1] - F.get(box, F.lit(b))[1])
    return F.greatest(edge(0, 1), edge(3, 2), F.lit(1.0)), F.greatest(edge(0, 3), edge(1, 2), F.lit(1.0))


def block_text(blocks: Column) -> Column:
    """Text of the blocks (type, bbox, lines[spans[text]]) of a page: text blocks from top to bottom and left to right, equal ones as they come."""
    placed = F.transform(blocks, lambda b, i: F.struct(F.coalesce(F.get(b["bbox"], F.lit(1)), F.lit(0.0)).alias("y"), F.coalesce(F.get(b["bbox"], F.lit(0)), F.lit(0.0)).alias("x"), i.alias("i"), b["type"].alias("type"), b["lines"].alias("lines")))
    texts = F.filter(placed, lambda b: (F.coalesce(b["type"], F.lit(0)) == 0) & (F.size(b["lines"]) > 0))
    line = lambda l: F.array_join(F.transform(l["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), "")  # noqa: E731, E741
    keyed = F.array_sort(F.transform(texts, lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), b["i"].alias("i"), F.btrim(F.array_join(F.transform(b["lines"], line), "\n"), F.lit("\n")).alias("t"))))
    return F.array_join(F.filter(F.transform(keyed, lambda b: b["t"]), lambda t: F.btrim(t) != ""), "\n\n")
