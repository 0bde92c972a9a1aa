"""Progress of a run: tasks of a batch, documents of a stream."""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: documents between two messages
EVERY = 10_000


@contextmanager
def tasks(spark: SparkSession, what: str, seconds: float = 5.0, out: TextIO | None = None) -> Iterator[None]:
    """While the body runs, say every few seconds how many tasks of the active stages are done."""
    tracker, done = spark.sparkContext.statusTracker(), threading.Event()
    to = out or sys.stderr

    def watch() -> None:
        before = ""
        while not done.wait(seconds):
            stages = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s)) is not None]
            now = ", ".join(f"{i.numCompletedTasks:,} of {i.numTasks:,} tasks" for i in stages)
            if now and now != before:
                print(f"{what}: {now}", file=to)
            before = now

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


class DocumentProgress(StreamingQueryListener):
    """Says how many documents a stream has read, whenever another ``every`` are passed.

    The stream observes them under ``name`` (see ``streaming.tokenize``).
    """

    def __init__(self, every: int = EVERY, name: str = "documents", out: TextIO | None = None):
        super().__init__()
        self.every, self.name, self.out, self.seen = every, name, out, 0

    def add(self, documents: int) -> None:
        before, self.seen = self.seen, self.seen + documents
        if before // self.every != self.seen // self.every:
            print(f"{self.seen:,} documents", file=self.out or sys.stderr)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.add(row["documents"])

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
