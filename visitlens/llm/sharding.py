"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are never cut. Sizes are summed per group by Spark and counted in
size classes (exact below 4,096 bytes, steps of 1/512 above), a table whose length does not
grow with the rows. The bins are filled from that table, largest class first: a group enters
the bin with the tightest remaining capacity that still holds it, found in a balanced
search tree. Members of a class are alike, so they are placed many at a time with the same
outcome as one by one. Spark then deals the groups of a class to the bins by rank.

Defined cases: a null text has no bytes; empty and null texts are one group, since their
bytes are equal. A group larger than an even share gets a shard alone, and the other shards
share the rest evenly. Rows that repeat an id are rows of their own. Fewer groups than
shards leave shards empty; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import ranked, stored, whole_text

EXACT_BELOW = 4096
ROW_BYTES = 8


class CapacityTree:
    """A treap of ``(remaining, bin)``; ``take(size)`` removes the tightest bin that fits."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.rng = random.Random(1)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, remaining: float, number: int) -> None:
        left, right = self._split(self.root, (remaining, number))
        node = [(remaining, number), self.rng.random(), None, None]
        self.root = self._merge(self._merge(left, node), right)

    def take(self, size: float) -> tuple[float, int] | None:
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._split(right, (key[0], key[1] + 1))
        self.root = self._merge(left, rest)
        return key


def best_fit_decreasing(
    classes: list[tuple[float, int]], capacity: float
) -> tuple[list[list[tuple[int, int]]], list[float]]:
    """Place ``count`` groups of each ``(size, count)``, given from large to small.

    Returns, per class, the ``(bin, count)`` in which its groups lie, and the fill of each
    bin. A group above the capacity gets a bin of its own.
    """
    tree, fills, placed = CapacityTree(), [], []
    for size, count in classes:
        runs: list[tuple[int, int]] = []
        while count:
            spot = tree.take(size)
            remaining, number = spot if spot else (max(capacity, size), len(fills))
            if spot is None:
                fills.append(0.0)
            fit = min(count, int(remaining // size)) if size else count
            fills[number] += fit * size
            runs.append((number, fit))
            count -= fit
            tree.add(remaining - fit * size, number)
        placed.append(runs)
    return placed, fills


def into_shards(
    classes: list[tuple[float, int]], shards: int
) -> tuple[list[list[tuple[int, int]]], list[float]]:
    """The smallest capacity for which best fit needs at most ``shards`` bins.

    Groups above an even share of what is left are set aside first, a bin each.
    """
    classes, alone, left = list(classes), [], shards
    rest = sum(s * n for s, n in classes)
    for i, (size, count) in enumerate(classes):
        fit = 0
        while fit < count and left > 1 and size > rest / left:
            fit, left, rest = fit + 1, left - 1, rest - size
        if fit:
            alone.append((i, fit))
        if fit < count:
            break
    open_classes = list(classes)
    for i, fit in alone:
        open_classes[i] = (classes[i][0], classes[i][1] - fit)
    low, high = rest / left, 2 * rest / left + 1
    while len(best_fit_decreasing(open_classes, high)[1]) > left:
        high *= 2
    for _ in range(40):
        middle = (low + high) / 2
        if len(best_fit_decreasing(open_classes, middle)[1]) <= left:
            high = middle
        else:
            low = middle
        if high - low < 1:
            break
    placed, fills = best_fit_decreasing(open_classes, high)
    fills += [0.0] * (left - len(fills))
    for i, fit in alone:
        for _ in range(fit):
            placed[i].append((len(fills), 1))
            fills.append(classes[i][0])
    return placed, fills


def size_class(size):
    """The upper end of a size's class; classes grow with the logarithm of the largest size."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)) - 9, F.lit(0))).cast("long")
    return F.when(size < EXACT_BELOW, size).otherwise(F.ceil(size / step) * step).cast("long")


def shard_documents(
    docs: DataFrame, shards: int | None = 24, capacity: int | None = None
) -> DataFrame:
    """``doc_id, size, text_crc32, group_rows, shard, slot``.

    Give ``shards`` for that many shards of near equal bytes, or ``capacity`` for as few
    shards of that many bytes as best fit finds.
    """
    spark = docs.sparkSession
    text = whole_text()
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.md5(F.encode(text, "UTF-8")).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("group_rows")
    )
    groups = stored(groups.withColumn("class", size_class(F.col("bytes"))), "shard-groups")
    counted = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.max("bytes").alias("most"))
    found = sorted(counted.collect(), key=lambda r: -r["class"])
    if capacity is None:
        placed, _ = into_shards([(r["b"] / r["n"], r["n"]) for r in found], shards)
    else:
        # By the largest of a class: whichever members a shard gets, they fit.
        placed, _ = best_fit_decreasing([(float(r["most"]), r["n"]) for r in found], capacity)
    allotted = []
    for r, runs in zip(found, placed, strict=True):
        start = 0
        for number, count in runs:
            allotted.append((r["class"], start, start + count, number))
            start += count
    allotted = spark.createDataFrame(allotted, "class long, low long, high long, shard int")
    numbered = ranked(groups, ["class"], ["key"], sum(r["n"] for r in found))
    # At most one row a class and one more a bin and class it shares: bounded, so broadcast.
    sharded = numbered.join(F.broadcast(allotted), "class").where("rank >= low AND rank < high")
    sharded = sharded.select("key", "group_rows", "shard")
    dealt = stored(rows.join(sharded, "key"), "shard-dealt")
    slots = ranked(dealt, ["shard"], ["doc_id"], dealt.count(), "slot")
    return slots.select("doc_id", "size", "text_crc32", "group_rows", "shard", "slot")
