"""Progress of a scan on a terminal: what Spark's tracker says, now and then."""

from __future__ import annotations

import threading
from typing import TextIO

from pyspark.sql import SparkSession


class Progress:
    """While it is entered, a line of ``out`` shows how many tasks of the running stages are done."""

    def __init__(self, spark: SparkSession, out: TextIO, every: float = 0.5):
        self.tracker, self.out, self.every, self.shown = spark.sparkContext.statusTracker(), out, every, 0
        self.over, self.thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    def line(self) -> str:
        """The state of the running stages in a few words; empty between jobs."""
        stages = [s for i in self.tracker.getActiveStageIds() if (s := self.tracker.getStageInfo(i))]
        return f"{len(stages)} stage(s), {sum(s.numCompletedTasks for s in stages)} of {sum(s.numTasks for s in stages)} tasks" if stages else ""

    def _show(self, text: str) -> None:
        self.out.write("\r" + text.ljust(self.shown) + ("" if text else "\r"))
        self.out.flush()
        self.shown = len(text)

    def _run(self) -> None:
        while not self.over.wait(self.every):
            self._show(self.line())

    def __enter__(self) -> Progress:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        if self.shown:
            self._show("")
