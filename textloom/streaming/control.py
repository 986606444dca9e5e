"""Pause, resume and cancel of jobs: flags on the driver, and Spark's own tags for what already runs."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


class Cancelled(Exception):
    pass


class JobControl:
    """Flags by job. A pause takes effect between batches; a cancel also ends the Spark jobs that carry the job's tag."""

    def __init__(self) -> None:
        self._slots: dict[int, tuple[threading.Event, threading.Event]] = {}

    def register(self, job: int) -> None:
        go = threading.Event()
        go.set()
        self._slots[job] = (go, threading.Event())

    def known(self, job: int) -> bool:
        return job in self._slots

    def dispose(self, job: int) -> None:
        self._slots.pop(job, None)

    def pause(self, job: int) -> bool:
        if job not in self._slots:
            return False
        self._slots[job][0].clear()
        return True

    def resume(self, job: int) -> bool:
        if job not in self._slots:
            return False
        self._slots[job][0].set()
        return True

    def cancel(self, job: int, spark: SparkSession | None = None) -> bool:
        if job not in self._slots:
            return False
        go, stop = self._slots[job]
        stop.set()
        go.set()
        if spark is not None:
            spark.interruptTag(f"textloom-job-{job}")
        return True

    def state(self, job: int) -> str:
        go, stop = self._slots[job]
        return "cancelled" if stop.is_set() else "processing" if go.is_set() else "paused"

    def wait(self, job: int) -> None:
        """Wait while the job is paused; raise once it is cancelled."""
        go, stop = self._slots[job]
        go.wait()
        if stop.is_set():
            raise Cancelled("Translation cancelled")

    def batches(self, job: int, parts: Iterable[DataFrame], act: Callable[[DataFrame], None]) -> Iterator[int]:
        """Run an action on one part after the other, yielding each part's number; pauses and cancels take effect between."""
        for number, part in enumerate(parts):
            self.wait(job)
            spark = part.sparkSession
            spark.addTag(f"textloom-job-{job}")
            try:
                act(part)
            finally:
                spark.removeTag(f"textloom-job-{job}")
            yield number
