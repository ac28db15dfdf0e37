"""State of jobs from their events, and what a registry keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TERMINAL = ("done", "error", "cancelled")


def state(events: DataFrame) -> DataFrame:
    """(job_id, status, processed, total, percent, first_ts, last_ts): where each job stands after all of its events, in whatever order they arrived.

    Repeated events count once, as only extremes and the last event by `seq` matter.
    """
    read = lambda name: F.expr(f"try_cast(get_json_object(payload, '$.{name}') AS INT)")
    known = F.when(F.col("type").isin(*TERMINAL), F.col("type")).when(F.col("type") == "progress", "processing")
    got = events.groupBy("job_id").agg(
        F.coalesce(F.max_by(known, F.when(known.isNotNull(), F.struct("seq", "ts"))), F.lit("pending")).alias("status"),
        F.coalesce(F.max(F.when(F.col("type") == "progress", read("processed"))), F.lit(0)).alias("processed"),
        F.coalesce(F.max(read("total")), F.lit(0)).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    percent = F.when(F.col("total") > 0, F.least(F.lit(100), F.floor(F.lit(100.0) * F.col("processed") / F.col("total") + 0.5).cast("int"))).otherwise(0)
    return got.withColumn("percent", percent)


def latest_page_events(events: DataFrame) -> DataFrame:
    """(job_id, page, seq, type): the last event of each page of each job."""
    return events.where(F.col("page").isNotNull()).groupBy("job_id", "page").agg(F.max("seq").alias("seq"), F.max_by("type", F.struct("seq", "type")).alias("type"))


def evicted(jobs: DataFrame, now: str, ttl_seconds: int = 7200, keep: int = 50) -> DataFrame:
    """(job_id, reason) of the finished jobs (job_id, status, last_ts) that a registry drops: those unused for longer than the time to live, and of the
    others all beyond the `keep` used last. A global top-k: only the rank bound is gathered, as `keep` rows of each task."""
    done = jobs.where(F.col("status").isin(*TERMINAL))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_ts")
    old = done.where(age > ttl_seconds * 1_000_000)
    fresh = done.where(age <= ttl_seconds * 1_000_000)
    kept = fresh.orderBy(F.desc("last_ts"), F.desc("job_id")).limit(keep).select("job_id")
    return old.select("job_id", F.lit("ttl").alias("reason")).unionByName(fresh.join(kept, "job_id", "left_anti").select("job_id", F.lit("lru").alias("reason")))


def replay(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """(job_id, page, seq, type): a snapshot of page events and those that came after, each page once with its last event."""
    return latest_page_events(snapshot.select("job_id", "page", "seq", "type").unionByName(live.select("job_id", "page", "seq", "type")))


def sse_frames(events: DataFrame) -> DataFrame:
    """(job_id, seq, frame): events as server-sent frames, up to the first terminal one of each job."""
    end = F.min(F.when(F.col("type").isin(*TERMINAL), F.col("seq"))).over(Window.partitionBy("job_id"))
    once = events.dropDuplicates(["job_id", "seq"]).withColumn("_end", end).where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    body = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","page":'), F.coalesce(F.col("page").cast("string"), F.lit("null")), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
    return once.select("job_id", "seq", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("frame"))


def controlled(states: DataFrame, commands: DataFrame) -> DataFrame:
    """The states (job_id, status, last_ts) after commands (job_id, seq, ts, command): `delete` removes a job, `cancel` ends one that has not ended,
    `touch` counts as use. Commands for unknown jobs and repeated ones change nothing; all are folded at once, so that their order of arrival does not matter."""
    folded = commands.groupBy("job_id").agg(
        F.max(F.col("command") == "delete").alias("_delete"), F.min(F.when(F.col("command") == "cancel", F.col("ts"))).alias("_cancel"),
        F.max(F.when(F.col("command").isin("touch", "cancel"), F.col("ts"))).alias("_used"),
    )
    got = states.join(folded, "job_id", "left").where(~F.coalesce("_delete", F.lit(False)))
    ended = F.col("status").isin(*TERMINAL)
    return got.withColumn("status", F.when(F.col("_cancel").isNotNull() & ~ended, "cancelled").otherwise(F.col("status"))).withColumn("last_ts", F.greatest("last_ts", "_used")).drop("_delete", "_cancel", "_used")


def runs(pages: DataFrame, cancels: DataFrame) -> DataFrame:
    """(job_id, seq, type, page, processed, total): the events of running jobs over their pages in order: `progress` for each page, then `done`, or
    `cancelled` before the first page that would begin after the cancel. `pages`: (job_id, page, ended); `cancels`: (job_id, at)."""
    order = Window.partitionBy("job_id").orderBy("page")
    total = F.count("*").over(Window.partitionBy("job_id"))
    began = F.lag("ended").over(order)
    stop = cancels.groupBy("job_id").agg(F.min("at").alias("_at"))
    each = pages.select("job_id", "page", "ended", F.row_number().over(order).alias("processed"), total.alias("total"), began.alias("_began")).join(stop, "job_id", "left")
    run = each.where(F.col("_at").isNull() | F.coalesce(F.col("_began") < F.col("_at"), F.lit(True)))
    progress = run.select("job_id", F.col("processed").alias("seq"), F.lit("progress").alias("type"), "page", "processed", "total")
    last = progress.groupBy("job_id").agg(F.max("processed").alias("processed"), F.max("total").alias("total"))
    end = F.when(F.col("processed") < F.col("total"), "cancelled").otherwise("done")
    return progress.unionByName(last.select("job_id", (F.col("processed") + 1).alias("seq"), end.alias("type"), F.lit(None).cast("int").alias("page"), "processed", "total"))
