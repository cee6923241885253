"""Running queries that can be watched and stopped."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from pointloom.errors import Cancelled

T = TypeVar("T")


class Job:
    """A tag for Spark work: cancel() stops what runs under it, progress() counts its tasks."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.cancelled = spark, f"pointloom-{uuid.uuid4().hex}", threading.Event()

    def check(self) -> None:
        if self.cancelled.is_set():
            raise Cancelled("the job was cancelled")

    def cancel(self) -> None:
        self.cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def progress(self) -> tuple[int, int]:
        """Tasks that ended, and all so far."""
        status = self.spark.sparkContext.statusTracker()
        done = total = 0
        for s in status.getActiveStageIds():
            if (info := status.getStageInfo(s)) is not None:
                done, total = done + info.numCompletedTasks, total + info.numTasks
        return done, total

    def run(self, work: Callable[[], T]) -> T:
        """Runs work under the tag; a failure after cancel() is a Cancelled."""
        self.check()
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            return work()
        except Exception as e:
            if self.cancelled.is_set():
                raise Cancelled("the job was cancelled") from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def rows(self, df: DataFrame) -> Iterator:
        """Rows as partitions come in: parts of a view before all of it."""
        for row in self.run(lambda: df.toLocalIterator(prefetchPartitions=True)):
            self.check()
            yield row
