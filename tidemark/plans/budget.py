"""Work that ends when its time is over."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STOPPED = "stopped: the time limit was reached"


class TimeLimitReached(RuntimeError):
    def __init__(self):
        super().__init__(STOPPED)


@contextmanager
def time_box(spark: SparkSession, deadline: float | None) -> Iterator[None]:
    """Jobs that this thread starts inside are cancelled at ``deadline`` (of ``time.monotonic``).

    They carry a tag of their own, so other threads' jobs go on.  A job that starts after the deadline
    is cancelled as well.  What the cancelled work raises becomes ``TimeLimitReached``.
    """
    if deadline is None:
        yield
        return
    context, tag, over = spark.sparkContext, f"budget-{uuid.uuid4().hex}", threading.Event()
    late = threading.Event()

    def watch() -> None:
        over.wait(max(0.0, deadline - time.monotonic()))
        while not over.is_set():
            late.set()
            context.cancelJobsWithTag(tag)
            over.wait(0.2)

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeLimitReached() from e
        raise
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(tag)
