"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names. Where none is named, a local session (tests) gets a folder of its own; on a cluster that is an
    error, as a folder of one machine would be lost with it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="leafmill-ckpt-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that lost executors cost no recomputation from the source."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame) -> DataFrame:
    """As `checkpoint`, as a compressed columnar table in the same folder: for wide rows of which later steps read some columns."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, keys: list[str], size: int, rows: int | None = None) -> DataFrame:
    """At most `size` rows, picked by a hash of their keys. Rows are first thinned by their number (counted if not given), so that what each task hands on is bounded as well."""
    from pyspark.sql import functions as F

    h = F.xxhash64(*keys)
    share = min(1.0, 1.5 * size / max(df.count() if rows is None else rows, 1))
    thin = df.withColumn("_h", h).where(F.pmod("_h", F.lit(1_000_000)) < F.lit(max(1, int(share * 1_000_000))))
    return thin.orderBy("_h", *keys).limit(size).drop("_h")
