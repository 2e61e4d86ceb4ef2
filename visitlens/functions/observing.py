"""Metrics that Spark observes while it writes."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation


def observed(observation: Observation) -> dict[str, object]:
    """The metrics of a write that has ended. There are none where Spark found out on the way
    that no row would come, and dropped the observed part of the plan."""
    try:
        return observation.get
    except Py4JJavaError:
        return {}
