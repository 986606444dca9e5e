"""Progress of jobs as streams of completion events (job_id, segment, at timestamp, total)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_progress(events: DataFrame) -> DataFrame:
    """(job_id, processed, total, progress) so far; for an update or complete sink. Counts only grow, so progress never falls.

    Every event counts; where segments may be repeated, `progress_of_segments` counts each once.
    """
    done = events.groupBy("job_id").agg(F.count("*").alias("processed"), F.max("total").alias("total"))
    return done.withColumn("progress", F.when(F.col("total") == 0, 100.0).otherwise(F.col("processed") / F.col("total") * 100))


def progress_of_segments(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The same with each segment of a job counted once: a retried task's second event is dropped.

    Segments are kept in mind until the event time has passed their first event by `late`, so that their number is bounded.
    """
    return running_progress(events.withWatermark("at", late).dropDuplicatesWithinWatermark(["job_id", "segment"]))


def progress_by_window(events: DataFrame, width: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(job_id, start, processed) by event time; events later than `late` are let go."""
    timed = events.withWatermark("at", late)
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return timed.groupBy("job_id", window.alias("w")).agg(F.count("*").alias("processed")).select("job_id", F.col("w.start").alias("start"), "processed")
