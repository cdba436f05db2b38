"""Stopping long builds and telling how far they are."""

from __future__ import annotations

import signal
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

from massif.errors import Cancelled


class StopSignal:
    """A request to stop, set by hand or by SIGINT and SIGTERM while installed() is entered. A second signal ends at once."""

    def __init__(self) -> None:
        self._event = threading.Event()

    def request(self) -> None:
        self._event.set()

    @property
    def requested(self) -> bool:
        return self._event.is_set()

    def check(self) -> None:
        """Raise where a build may stop: what it has finished stays in its attempt and is used again."""
        if self.requested:
            raise Cancelled("stopped on request")

    @contextmanager
    def installed(self):
        kinds = (signal.SIGINT, signal.SIGTERM)
        before = {}

        def handle(number, frame):
            for k, h in before.items():
                signal.signal(k, h)
            self.request()

        for k in kinds:
            before[k] = signal.signal(k, handle)
        try:
            yield self
        finally:
            for k, h in before.items():
                signal.signal(k, h)


def progress(spark: SparkSession) -> dict[str, int]:
    """Tasks done, running and in all of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    found = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
    return {"done": sum(s.numCompletedTasks for s in found), "running": sum(s.numActiveTasks for s in found), "all": sum(s.numTasks for s in found)}
