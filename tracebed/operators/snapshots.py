"""What changed between full snapshots: each key's row of presence, read with lag and lead over snapshot indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebed.functions.text import blank_free, present, utc_time


def snapshot_changes(rows: DataFrame, snapshot: Column, key: Column, recency: Column, compared: list[Column]) -> DataFrame:
    """Added, removed and changed keys of every snapshot against the one delivered before it.

    ``compared`` are string columns already normalised; a row's state is the md5 of their joined values. Within a
    snapshot the row with the greatest ``recency`` counts, among equals the one with the greatest state hash, so
    repeated rows count once and ties have one answer. Rows without key or snapshot belong to nothing and are left
    out; an empty table gives no rows. Returns snapshot_no, finding_key, change_kind.

    Numbers that were never delivered leave no gap: indices are dense over delivered snapshots. The first
    aggregation combines on the map side, so a key with a third of all rows reaches the window as one row per
    snapshot.
    """
    state = F.md5(F.concat_ws("\x1f", *compared))
    slim = rows.select(snapshot.alias("snap"), key.alias("key"), F.struct(recency.alias("at"), state.alias("state")).alias("v")).where(
        "snap is not null and key is not null"
    )
    current = slim.groupBy("key", "snap").agg(F.max("v")["state"].alias("state"))
    delivered = rows.select(snapshot.alias("snap")).where("snap is not null").distinct()
    # one row per delivered snapshot: the single-task window holds a handful of numbers
    every = Window.orderBy("snap")
    order = delivered.select("snap", F.row_number().over(every).alias("idx"), F.lead("snap").over(every).alias("next_snap"))
    by_key = Window.partitionBy("key").orderBy("idx")
    seen = current.join(order, "snap").select(
        "key",
        "snap",
        "idx",
        "next_snap",
        "state",
        F.lag("idx").over(by_key).alias("before"),
        F.lag("state").over(by_key).alias("state_before"),
        F.lead("idx").over(by_key).alias("after"),
    )
    here = (
        F.when(F.col("idx") == 1, None)
        .when(F.col("before").isNull() | (F.col("before") < F.col("idx") - 1), "added")
        .when(F.col("state") != F.col("state_before"), "changed")
    )
    gone = F.when(F.col("next_snap").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("idx") + 1)), "removed")
    events = F.filter(
        F.array(F.struct(F.col("snap").alias("no"), here.alias("kind")), F.struct(F.col("next_snap").alias("no"), gone.alias("kind"))),
        lambda e: e["kind"].isNotNull(),
    )
    return seen.select("key", F.explode(events).alias("e")).select(
        F.col("e.no").alias("snapshot_no"), F.col("key").alias("finding_key"), F.col("e.kind").alias("change_kind")
    )


def finding_changes(findings: DataFrame) -> DataFrame:
    """Changes of the findings index; identity is semantic_fingerprint, or fingerprint where that is missing."""
    return snapshot_changes(
        findings,
        snapshot=F.col("snapshot_no"),
        key=F.coalesce(present(F.col("semantic_fingerprint")), present(F.col("fingerprint"))),
        recency=utc_time(F.col("last_seen")),
        compared=[
            blank_free(F.col("fingerprint")),
            blank_free(F.col("rule_id")),
            blank_free(F.col("file")),
            F.lower(blank_free(F.col("severity"))),
            F.coalesce(F.col("active").cast("string"), F.lit("")),
        ],
    )
