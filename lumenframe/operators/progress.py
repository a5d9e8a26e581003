"""Work on Spark that can be watched and cancelled: each run is a job group of its own."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The run was cancelled before it ended."""


@dataclass(frozen=True)
class Progress:
    """Jobs begun, their stages, and the tasks of these: done, running, in all (of the stages that began)."""

    jobs: int
    stages: int
    done: int
    active: int
    tasks: int

    @property
    def share(self) -> float:
        return self.done / self.tasks if self.tasks else 0.0


class Run:
    """A function of no arguments, running beside the caller; every Spark job that it starts belongs to the run."""

    def __init__(self, spark: SparkSession, work: Callable, name: str = "run"):
        self.spark, self.name, self.group = spark, name, f"{name}-{uuid.uuid4().hex}"
        self._value, self._error, self._stop, self._ended = None, None, threading.Event(), threading.Event()

        def run() -> None:
            spark.sparkContext.setJobGroup(self.group, name, interruptOnCancel=True)
            try:
                self._value = work()
            except BaseException as error:  # noqa: BLE001  told to whoever asks for the result
                self._error = error
            finally:
                self._ended.set()

        self._thread = InheritableThread(target=run, daemon=True)
        self._thread.start()

    @property
    def ended(self) -> bool:
        return self._ended.is_set()

    def progress(self) -> Progress:
        tracker = self.spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(self.group)
        infos = [tracker.getJobInfo(j) for j in jobs]
        stages = [s for s in (tracker.getStageInfo(k) for i in infos if i for k in i.stageIds) if s]
        return Progress(len(jobs), len(stages), sum(s.numCompletedTasks for s in stages), sum(s.numActiveTasks for s in stages), sum(s.numTasks for s in stages))

    def cancel(self, timeout: float = 60.0) -> bool:
        """End the run's jobs, and those that it starts until it gives up. Whether it ended; results of others aren't touched."""
        self._stop.set()
        until = time.monotonic() + timeout
        while not self._ended.is_set() and time.monotonic() < until:
            self.spark.sparkContext.cancelJobGroup(self.group)
            self._ended.wait(0.1)
        return self._ended.is_set()

    def result(self, timeout: float | None = None):
        """What the function returned; its error; Cancelled, if it ended because of cancel()."""
        if not self._ended.wait(timeout):
            raise TimeoutError(f"{self.name} still runs")
        if self._error is not None:
            if self._stop.is_set():
                raise Cancelled(self.name) from self._error
            raise self._error
        return self._value
