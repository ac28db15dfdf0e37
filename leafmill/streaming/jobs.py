"""Job state and eviction as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.operators.jobs import TERMINAL


def running_state(events: DataFrame) -> DataFrame:
    """Update-mode stream of (job_id, status, processed): the state of each job after each micro-batch. Repeated and late events change nothing that a later one has set."""

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, status, processed = state.get if state.exists else (-1, "pending", 0)
        for b in batches:
            for r in b.itertuples():
                kind = r.type if r.type in TERMINAL else "processing" if r.type == "progress" else None
                if kind and r.seq > seq:
                    seq, status = int(r.seq), kind
                if r.type == "progress" and r.page is not None and r.page == r.page:
                    processed = max(processed, int(r.page))
        state.update((seq, status, processed))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "processed": [processed]})

    kept = events.select("job_id", "seq", "type", "page")
    return kept.groupBy("job_id").applyInPandasWithState(merge, "job_id string, status string, processed int", "seq long, status string, processed int", "update", GroupStateTimeout.NoTimeout)


def expiring(events: DataFrame, ttl_seconds: int = 7200) -> DataFrame:
    """Append-mode stream of (job_id, last_ts) of the jobs that were not touched for the time to live, in event time; the watermark must be set on `ts`."""

    def touch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_us": [last]})
            return
        last = state.get[0] if state.exists else 0
        for b in batches:
            if len(b):
                last = max(last, int(b["us"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    kept = events.select("job_id", "ts", F.unix_micros("ts").alias("us"))
    return kept.groupBy("job_id").applyInPandasWithState(touch, "job_id string, last_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_pages(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """For `foreachBatch`: stored pages (job_id, page, seq, type) with the events of a batch merged in, the last event of each page winning."""
    from leafmill.operators.jobs import replay

    return replay(stored, batch)
