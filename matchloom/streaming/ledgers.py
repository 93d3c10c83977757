"""Structured Streaming over the ledgers and intake."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.lineage import cut
from ..operators import usage


def usage_windows(ledger: DataFrame, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """The usage metrics by tenant, workflow and tumbling window; rows later than the watermark are dropped."""
    rows = ledger.withWatermark("started_at", lateness).groupBy(F.window("started_at", width), "org_id", "workflow").agg(*usage.metrics(ledger.columns))
    return rows.withColumn("window_start", F.col("window.start")).drop("window")


def stale_starts(starts: DataFrame, ends: DataFrame, minutes: int = 15) -> DataFrame:
    """starts(event_id, org_id, started_at) without an end(event_id, completed_at) in time, once the watermark has passed."""
    s = starts.withWatermark("started_at", "1 minute").select("event_id", "org_id", "started_at")
    e = ends.withWatermark("completed_at", "1 minute").select(F.col("event_id").alias("end_id"), "completed_at")
    inside = (F.col("event_id") == F.col("end_id")) & (F.col("completed_at") >= F.col("started_at")) & (F.col("completed_at") <= F.col("started_at") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return s.join(e, inside, "left_outer").filter("end_id is null").select("event_id", "org_id", "started_at")


def new_documents(documents: DataFrame, lateness: str = "7 days") -> DataFrame:
    """documents(org_id, sha256, seen_at) whose content the tenant hasn't sent within the lateness."""
    return documents.withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["org_id", "sha256"])


def against_registry(registry: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that also drops what the stored registry has."""

    def run(batch: DataFrame, epoch: int) -> None:
        write(batch.join(registry().select("org_id", "sha256").distinct(), ["org_id", "sha256"], "left_anti"), epoch)

    return run


def changed_in_stream(snapshots: DataFrame) -> DataFrame:
    """T4: org_id, candidate_id, before, after of candidates whose hash differs from the last one seen.

    snapshots(org_id, candidate_id, version, hash) streams candidates that may have
    changed; a null hash says that the candidate left.  The state of a candidate is
    its last version and hash, so a micro-batch touches those candidates alone that
    came in.  Of several versions in a batch the newest counts, older ones than the
    state's are ignored, and ties keep the smallest hash.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (-1, None)
        rows = [(int(v), None if pd.isna(h) else h) for f in frames for v, h in zip(f["version"], f["hash"], strict=True)]
        version, new = min(rows, key=lambda r: (-r[0], r[1] is None, r[1] or ""))
        if version > held[0]:
            state.update((version, new))
            if new != held[1]:
                yield pd.DataFrame({"org_id": [key[0]], "candidate_id": [key[1]], "before": [held[1]], "after": [new]})

    return snapshots.groupBy("org_id", "candidate_id").applyInPandasWithState(run, "org_id int, candidate_id long, before string, after string", "version long, hash string", "append", GroupStateTimeout.NoTimeout)


def refresh_shortlists(rebuild: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """T4: a foreachBatch function over `changed_in_stream`: tenants with a changed candidate get their shortlists rebuilt, others keep theirs."""

    def run(batch: DataFrame, epoch: int) -> None:
        write(rebuild(cut(batch.select("org_id").distinct())), epoch)  # the batch is read once, however often its tenants are used

    return run


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """T5: activity sessions by user; a session ends after ``gap`` without an event."""
    rows = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
