"""Tables of a folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; columns and filters used later are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_counts(pages: DataFrame) -> DataFrame:
    """Rows of pages that count: status `done` and non-blank text. Repeated rows are kept; callers drop them
    after the row-wise work, when rows are small."""
    return pages.where((F.col("status") == "done") & F.col("text").rlike(r"\S"))
