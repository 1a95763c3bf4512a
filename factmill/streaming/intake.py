"""Continuous intake: arriving file states are merged into the fact store batch by batch.

An extension of the incremental store: Structured Streaming reads the arriving
rows, ``foreachBatch`` keeps the latest state of each file and refreshes the
store. The stream's checkpoint and the store's versions make a batch that is
replayed after a failure a no-op.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.io import materialize, temporary_tables
from factmill.operators.incremental import STATE, StateTarget
from factmill.sources.factstore import refresh


KEY = ["project_id", "relative_path"]


def latest_states(rows: DataFrame) -> DataFrame:
    """Of every file the row with the greatest modified_ms, then ingested_at; repeats count once."""
    rest = [c for c in rows.columns if c not in ("project_id", "relative_path")]
    best = rows.groupBy("project_id", "relative_path").agg(F.max_by(F.struct(*rest), F.struct("modified_ms", "ingested_at")).alias("r"))
    return best.select("project_id", "relative_path", "r.*")


def start_intake(spark: SparkSession, arriving: DataFrame, state_path: str, store_path: str, checkpoint: str, features: dict[str, bool], kind: str = "sha256+mtime"):
    """A streaming query that keeps the files table at ``state_path`` and the fact store at ``store_path`` up to date."""

    def batch(rows: DataFrame, _: int) -> None:
        with temporary_tables(spark):
            files = StateTarget(spark, state_path, KEY, STATE)
            before = files.current()
            come = materialize(latest_states(rows), "come")
            if before is not None:
                # what is older than the row known already changes nothing; a replayed batch is all of that
                known = files.read(before).select(*KEY, F.struct("modified_ms", "ingested_at").alias("__known"))
                newer = F.col("__known").isNull() | (F.struct("modified_ms", "ingested_at") > F.col("__known"))
                come = materialize(come.join(known, KEY, "left").where(newer).drop("__known"), "newer")
            if before is None or not come.isEmpty():
                before = files.publish(come, before, come.select(*KEY))
                files.vacuum()
            refresh(spark, store_path, files.read(before), features, kind)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrival_counts(arriving: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """(start, project_id, files): files arriving per window and project; rows later than the watermark are left out by Spark."""
    counted = arriving.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window), "project_id").agg(F.count("*").alias("files"))
    return counted.select(F.col("window.start").alias("start"), "project_id", "files")
