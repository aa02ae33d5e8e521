"""Findings as a stream: identities that appear, stay, vanish and come back, with state kept for each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def lifecycle_stream(observations: DataFrame) -> DataFrame:
    """finding_key, seq, status of a stream of (finding_key, seq, active): NEW, EXISTING, REOPENED, RESOLVED.

    State holds the last seq and whether the identity was active. It is never timed out, because a finding that comes back
    after any time must be told from a new one. Rows of one identity within a micro-batch are taken in order of seq; a
    seq at or before the last one is late and leaves state and output alone.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, active = state.get if state.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for seq, now in zip(rows["seq"], rows["active"]):
            if last is not None and seq <= last:
                continue
            if now:
                out.append((key[0], int(seq), "NEW" if last is None else "EXISTING" if active else "REOPENED"))
            elif active:
                out.append((key[0], int(seq), "RESOLVED"))
            last, active = int(seq), bool(now)
        if last is not None:
            state.update((last, active))
        yield pd.DataFrame(out, columns=["finding_key", "seq", "status"])

    keyed = observations.where("finding_key is not null and seq is not null").select("finding_key", F.col("seq").cast("long").alias("seq"), F.coalesce("active", F.lit(False)).alias("active"))
    return keyed.groupBy("finding_key").applyInPandasWithState(
        advance, "finding_key string, seq long, status string", "last long, active boolean", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n of a stream of (ts, event_type) in tumbling windows; rows later than the watermark are dropped."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
