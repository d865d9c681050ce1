"""Work that can be watched and stopped: all Spark jobs of a piece of work are in the group of its tag."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Job:
    """fn(spark) in a thread of its own. `status` is running, done, cancelled or error; `error` has what was raised.

    Tables that fn commits as a whole (sources.cache) are as before if it is stopped."""

    def __init__(self, spark: SparkSession, tag: str, fn: Callable[[SparkSession], object]):
        self.spark, self.tag, self.fn = spark, tag, fn
        self.status, self.result, self.error = "running", None, None
        self._stop = threading.Event()
        self._thread = InheritableThread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        self.spark.sparkContext.setJobGroup(self.tag, self.tag, True)
        try:
            self.result = self.fn(self.spark)
            self.status = "cancelled" if self._stop.is_set() else "done"
        except Exception as e:  # noqa: BLE001  told to whoever waits
            self.error = e
            self.status = "cancelled" if self._stop.is_set() else "error"

    def cancel(self) -> None:
        """Stops the running Spark jobs of the tag, and those that fn would start next."""
        self._stop.set()
        while self._thread.is_alive():
            self.spark.sparkContext.cancelJobGroup(self.tag)
            self._thread.join(0.2)

    def wait(self, seconds: float | None = None) -> str:
        self._thread.join(seconds)
        return self.status

    def progress(self) -> tuple[int, int, int]:
        """Spark jobs begun, and tasks done and known so far, of this tag."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(self.tag)
        infos = [i for j in jobs if (i := tracker.getJobInfo(j))]
        stages = [s for i in infos for k in i.stageIds if (s := tracker.getStageInfo(k))]
        return len(jobs), sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
