"""Jobs and live events as streams: routing, bounded retry, latest state, liveness.

Every transformation works on a stream and on a table alike. A stream runs with a checkpoint, so a batch
may be repeated after a failure; sinks are therefore idempotent: a batch replaces its own partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JOB = "type string, project_id string, settings string, retry_count int, max_retries int, created_at string"
# Handlers by type of job.
HANDLERS = {"ai_image": "image", "ai_image_regenerate": "image", "paint_options": "options", "paint_selection": "selection", "upload_preview": "preview"}
TERMINAL = ("completed", "failed", "deleted")


def read_jobs(spark: SparkSession, folder: str, per_trigger: int = 20) -> DataFrame:
    """Jobs as JSON files; at most this many files are admitted at a time, the rest wait."""
    return spark.readStream.schema(JOB).option("maxFilesPerTrigger", per_trigger).json(folder)


def route(jobs: DataFrame) -> DataFrame:
    handler = F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in HANDLERS.items()), F.lit("legacy"))
    return jobs.withColumn("handler", handler)


def admitted(jobs: DataFrame, waiting: int, limit: int = 20) -> DataFrame:
    """Jobs that fit in a queue of this length, oldest first."""
    return jobs.orderBy("created_at", "project_id").limit(max(0, limit - waiting))


def after_failure(failed: DataFrame, retryable: Column) -> DataFrame:
    """Failed jobs with their next step: retry with a higher count, or dead."""
    again = retryable & (F.col("retry_count") < F.col("max_retries"))
    return failed.withColumn("outcome", F.when(again, "retry").otherwise("dead")).withColumn("retry_count", F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")))


def progress(event_value: Column, event_progress: Column) -> Column:
    return F.least(F.greatest(F.coalesce(event_value, event_progress, F.lit(0)), F.lit(0)), F.lit(100))


def latest_state(events: DataFrame) -> DataFrame:
    """Newest event of each project by seq; on a stream in complete or update mode."""
    return events.groupBy("project_id").agg(F.max_by(F.struct("seq", "type", "value"), "seq").alias("s")).select("project_id", "s.seq", "s.type", "s.value")


def stale(beats: DataFrame, now: Column, seconds: int = 90) -> DataFrame:
    """Keys whose last sign of life is older than this."""
    return beats.groupBy("project_id").agg(F.max("ts").alias("last")).where(F.col("last") < now - F.expr(f"INTERVAL {seconds} SECONDS"))


def write_batches(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream batch by batch; a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reduced(events: DataFrame) -> DataFrame:
    """State of each project as a fold over its events, in order of seq within a batch; late events of a lower seq are ignored."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, status, n = state.get if state.exists else (-1, "", 0)
        for rows in batches:
            for r in rows.sort_values("seq").itertuples(index=False):
                if r.seq > seq:
                    seq, n = int(r.seq), n + 1
                    status = status if status in TERMINAL else r.type
        state.update((seq, status, n))
        yield pd.DataFrame({"project_id": [key[0]], "seq": [seq], "status": [status], "n_events": [n]})

    shape = "project_id long, seq long, status string, n_events long"
    return events.groupBy("project_id").applyInPandasWithState(step, shape, "seq long, status string, n_events long", "update", GroupStateTimeout.NoTimeout)
