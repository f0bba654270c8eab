"""Progress and cancellation of running queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession):
    """Jobs started inside carry a tag; the value cancels them, from any thread. A failed or cancelled query raises, and
    leaves no partial result."""
    tag = f"run-{uuid.uuid4().hex[:12]}"
    spark.addTag(tag)
    try:
        yield lambda: spark.interruptTag(tag)
    finally:
        spark.removeTag(tag)


def progress(spark: SparkSession, tell: Callable[[int], None]) -> int:
    """The share of tasks of active stages that are done, in percent, at most 95 while anything runs."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    total = sum(s.numTasks for s in stages)
    share = min(95, round(95 * sum(s.numCompletedTasks for s in stages) / total)) if total else 100
    tell(share)
    return share
