"""Independent chains of Spark jobs side by side, from driver threads.

A model fit is a chain of small jobs that leaves most of a cluster idle; several
fits (folds, algorithms, sweep steps) can share it.  Each call runs in a thread
with a job group of its own, in the scheduler pool of that name (with
``spark.scheduler.mode=FAIR`` the pools share the cores; with FIFO they still fill
each other's gaps), so a call that is no longer wanted can be cancelled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Overlapped:
    """Calls that run up to ``workers`` at a time; results are read by place."""

    def __init__(self, spark: SparkSession, calls: Sequence[Callable[[], object]], workers: int):
        self.spark, self.calls = spark, list(calls)
        self.groups = [f"overlap-{uuid.uuid4().hex}" for _ in self.calls]
        self._pool = ThreadPoolExecutor(max(1, workers))
        self._futures: dict[int, Future] = {}
        self.cancelled: list[int] = []

    def start(self, place: int) -> None:
        """Begin a call, if it has not begun."""
        if place < len(self.calls) and place not in self._futures:
            self._futures[place] = self._pool.submit(self._run, place)

    def _run(self, place: int):
        out: dict = {}

        def body() -> None:
            sc = self.spark.sparkContext
            sc.setJobGroup(self.groups[place], self.groups[place], interruptOnCancel=True)
            sc.setLocalProperty("spark.scheduler.pool", self.groups[place])
            try:
                out["value"] = self.calls[place]()
            except Exception as e:  # noqa: BLE001 - raised again where the result is read
                out["error"] = e

        if place in self.cancelled:
            return out
        thread = InheritableThread(target=body)  # a JVM thread of its own, so that the job group is its own
        thread.start()
        thread.join()
        return out

    def result(self, place: int):
        """The call's value; what it raised is raised here."""
        self.start(place)
        out = self._futures[place].result()
        if "error" in out:
            raise out["error"]
        return out["value"]

    def cancel(self, place: int) -> None:
        """Stop a call that has begun and is not wanted, and its jobs."""
        future = self._futures.get(place)
        if future is None or future.done():
            return
        self.cancelled.append(place)
        if not future.cancel():
            # A job may be submitted just now: cancel until the call has ended.
            while not future.done():
                self.spark.sparkContext.cancelJobGroup(self.groups[place])
                try:
                    future.result(timeout=0.2)
                except TimeoutError:
                    pass

    def close(self) -> None:
        for place in list(self._futures):
            self.cancel(place)
        self._pool.shutdown(wait=True)

    def __enter__(self) -> "Overlapped":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def overlapped(spark: SparkSession, calls: Sequence[Callable[[], object]], workers: int) -> list:
    """Each call's value or the exception it raised, in order."""
    if workers <= 1:
        out = []
        for call in calls:
            try:
                out.append(call())
            except Exception as e:  # noqa: BLE001 - handed to the caller
                out.append(e)
        return out
    with Overlapped(spark, calls, workers) as running:
        for place in range(len(calls)):
            running.start(place)
        out = []
        for place in range(len(calls)):
            try:
                out.append(running.result(place))
            except Exception as e:  # noqa: BLE001 - handed to the caller
                out.append(e)
        return out
