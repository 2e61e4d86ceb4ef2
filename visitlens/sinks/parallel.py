"""Independent writes at the same time: one leaves cores idle where tables are small."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target


def together(*writes: Callable[[], object]) -> None:
    """Run all writes and wait for them; the first error is raised when all have ended."""
    with ThreadPoolExecutor(len(writes)) as pool:
        runs = [pool.submit(inheritable_thread_target(write)) for write in writes]
    for run in runs:
        run.result()
