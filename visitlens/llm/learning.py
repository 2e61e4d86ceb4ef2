"""Small models that are fitted on bounded samples, and how the samples are drawn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id's text divides by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def lowest(rows: DataFrame, total: int, wanted: int) -> list:
    """Of ``total`` rows with a ``doc_id``, the ``wanted`` with the lowest hashes of it.

    Rows are cut by a threshold on the hash before they are collected, so what reaches the
    driver follows ``wanted``, not the number of rows or partitions. The threshold is raised
    until enough rows pass it. Ids should not repeat.
    """
    space, share = 1 << 64, 1.2 * wanted + 50
    hashed = rows.withColumn("_order", F.xxhash64("doc_id"))
    while True:
        cut = min(space, int(space * share / max(total, 1))) - (space >> 1)
        drawn = hashed.where(F.col("_order") < cut).collect() if cut < space >> 1 else hashed.collect()
        if len(drawn) >= min(wanted, total) or cut == space >> 1:
            return sorted(drawn, key=lambda r: (r["_order"], r["doc_id"]))[:wanted]
        share *= 2


def bounded_sample(labels: DataFrame, label: str, per_class: int) -> list[tuple[int, int]]:
    """At most ``per_class`` ids of each class with label 0 or 1, those of the lowest hashes."""
    found = []
    for value in (0, 1):
        rows = labels.where((F.col(label) == value) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        drawn = lowest(rows, rows.count(), per_class)
        found += [(r["doc_id"], value) for r in drawn]
    return found


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray,
    l2: float,
    swapped: np.ndarray | None = None,
    swap_penalty: float = 0.0,
    steps: int = 400,
    rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Adam; ``y`` may be soft.

    ``swapped`` holds, for some rows, the difference between their features and those of
    their counterfactual; the squared change of the score over it is penalised.
    """
    n, m = x.shape
    w, b = np.zeros(m), 0.0
    share = weight / max(weight.sum(), 1e-12)
    moment, square = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        error = share * (sigmoid(x @ w + b) - y) if n else np.zeros(0)
        gradient = np.append(x.T @ error + l2 * w, error.sum())
        if swapped is not None and len(swapped):
            gradient[:m] += 2 * swap_penalty * swapped.T @ (swapped @ w) / len(swapped)
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        move *= min(1.0, 2 * (1 - t / (steps + 1)))
        w, b = w - move[:m], b - move[m]
    return w, float(b)
