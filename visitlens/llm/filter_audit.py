"""Interaction audit of quality filters: what each filter removes under every order.

Five filters, named by letters, fail a document or not; none depends on another. One pass
over the texts computes four of them, a hash and a digest per document. The fifth, "equal to
the text of a smaller id", goes by a counting Bloom prepass:

1. *Sketches.* Every task counts its text hashes in sparse Bloom counters, cut into segments
   of the hash range. The number of segments follows the number of documents, so a segment
   stays small however large the corpus. Counters of a segment are added up; those that
   reach two are kept as bits.
2. *Probe.* Every task's distinct hashes meet the bits of their segment. A text with a counter
   below two is guaranteed unique; the rest are possible repeats.
3. *Exact ids.* Only texts of possible repeats are shuffled, whole, and give the smallest id
   of equal texts, which joins the documents by digest, salted.

Flags then become a mask of failed filters, counted per part and mask. Counts are additive
over masks, so all orders and steps follow from at most 32 rows of a part.

Where the hashes of possible repeats are few (``BROADCAST_HASHES``) they are broadcast and
other texts never leave their scan; beyond that the texts meet them in a shuffled join.

Defined cases: a null text is empty, and equals empty texts. A null language is the part of
the empty text. Rows that repeat an id are documents of their own; none of them is smaller
than another. A null id is never smaller than another, no id is smaller than it, and it has
no label. A document is good or toxic if any label row of its id says so. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import UPPER, stored, whole_text

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
# What separates words, and what counts as a symbol.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#$%&*|]"

SEGMENT_TEXTS = 1 << 17
COUNTERS = 1 << 21  # in a segment: 16 a text
PROBES = 4  # counters of a text
FLUSH = 1 << 20  # hashes that a task holds before it writes sketches
SALTS = 16
BROADCAST_HASHES = 2_000_000  # 16 MB of hashes


def failed_alone(text: Column) -> Column:
    """Mask of the filters A to D that a text fails."""
    words = F.filter(F.split(text, BLANK), lambda word: word != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    chars = F.length(text)
    capitals = chars - F.length(F.translate(text, UPPER, ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * chars, text.rlike(SYMBOL)]
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)), F.lit(0))


def _by_segment(hashes: np.ndarray, segments: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of each segment that has any. The segment is taken from the upper half."""
    at = ((hashes >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    hashes, at = hashes[order], at[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    for part in np.split(np.arange(len(at)), cuts):
        if len(part):
            yield int(at[part[0]]), hashes[part]


def _places(hashes: np.ndarray) -> np.ndarray:
    """The counters of every hash, one row each, by double hashing of the whole hash."""
    h = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    first, step = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    rows = [(first + np.uint64(i) * step) % np.uint64(COUNTERS) for i in range(PROBES)]
    return np.stack(rows, axis=1).astype(np.uint32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hashes of a task, some ``FLUSH`` at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64))
        n += batch.num_rows
        if n >= FLUSH:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _packed(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
    )


def sketches(hashes: DataFrame, segments: int) -> DataFrame:
    """``segment, places, counts``: counters that are not 0, 2 standing for any more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            rows = []
            for segment, own in _by_segment(held, segments):
                texts, n = np.unique(own, return_counts=True)
                at = _places(texts)
                # A text counts once in a counter, however often its probes hit it.
                at.sort(axis=1)
                fresh = np.ones(at.shape, bool)
                fresh[:, 1:] = at[:, 1:] != at[:, :-1]
                weight = np.repeat(np.minimum(n, 2), PROBES).reshape(at.shape)[fresh]
                place, back = np.unique(at[fresh], return_inverse=True)
                total = np.minimum(np.bincount(back, weight), 2).astype(np.uint8)
                rows.append((segment, place.astype("<u4").tobytes(), total.tobytes()))
            yield _packed(rows, ["segment", "places", "counts"], [pa.int64(), pa.binary(), pa.binary()])

    return hashes.mapInArrow(count, "segment long, places binary, counts binary")


def merged(parts: DataFrame) -> DataFrame:
    """``segment, repeated``: one bit a counter, set where the sum over all tasks is two or more."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS, np.uint8)
        for places, counts in zip(group["places"], group["counts"], strict=True):
            at = np.frombuffer(places, "<u4")
            total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
        bits = np.packbits(total >= 2).tobytes()
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "repeated": [bits]})

    return parts.groupBy("segment").applyInPandas(add, "segment long, repeated binary")


def possible_repeats(hashes: DataFrame, segments: int) -> DataFrame:
    """``hash``, distinct: of texts that no counter clears. Every repeated text is among them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            rows = [(s, np.unique(own).astype("<u8").tobytes()) for s, own in _by_segment(held, segments)]
            yield _packed(rows, ["segment", "hashes"], [pa.int64(), pa.binary()])

    def probe(asked: pd.DataFrame, sketch: pd.DataFrame) -> pd.DataFrame:
        bits = np.frombuffer(sketch["repeated"].iloc[0], np.uint8)
        found = [np.zeros(0, np.uint64)]
        for packed in asked["hashes"]:
            own = np.frombuffer(packed, "<u8")
            at = _places(own)
            found.append(own[((bits[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1)])
        return pd.DataFrame({"hash": np.unique(np.concatenate(found)).view(np.int64)})

    asked = hashes.mapInArrow(deal, "segment long, hashes binary").groupBy("segment")
    bits = merged(sketches(hashes, segments)).groupBy("segment")
    return asked.cogroup(bits).applyInPandas(probe, "hash long")


def smallest_ids(
    docs: DataFrame, possible: DataFrame, broadcast_hashes: int = BROADCAST_HASHES
) -> DataFrame:
    """``digest, first``: the smallest id of every text that several rows have.

    ``possible`` is stored. Its size decides how texts meet it; rows are the same either way.
    """
    few = possible.count() <= broadcast_hashes
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    met = rows.join(F.broadcast(possible) if few else possible, "hash", "left_semi")
    equal = met.groupBy("text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    repeated = equal.where("n > 1 AND first IS NOT NULL")
    return repeated.select(F.sha2("text", 256).alias("digest"), "first")


def masks(docs: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``doc_id, part, mask`` per document: bit i is set where it fails filter i."""
    text = whole_text()
    narrow = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            failed_alone(text).alias("mask"),
            F.xxhash64(text).alias("hash"),
            F.sha2(text, 256).alias("digest"),
        ),
        "audit-narrow",
    )
    segments = max(1, -(-narrow.count() // SEGMENT_TEXTS))
    possible = stored(possible_repeats(narrow.select("hash"), segments), "audit-possible")
    firsts = stored(smallest_ids(docs, possible, broadcast_hashes), "audit-firsts")

    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = firsts.select("digest", "first", every_salt)
    dealt = narrow.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    repeat = F.when(F.col("doc_id") > F.col("first"), F.lit(REPEAT)).otherwise(F.lit(0))
    met = dealt.join(salted, ["digest", "salt"], "left")
    return met.select("doc_id", "part", F.col("mask").bitwiseOR(repeat).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents, and how many of them a label calls so."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    known = failed.join(told.where("good + toxic > 0"), "doc_id", "left")
    return known.groupBy("part", "mask").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )


def interactions(counts: DataFrame) -> DataFrame:
    """Counts per part, order and step, zeros included.

    ``shapley`` of a filter adds up what it removes over all orders: a document that fails
    k filters is removed by each of them in one order of k.
    """
    steps = [
        (order, i + 1, 1 << FILTERS.index(name), sum(1 << FILTERS.index(c) for c in order[:i]))
        for order in map("".join, permutations(FILTERS))
        for i, name in enumerate(order)
    ]
    orders = len(steps) // len(FILTERS)
    table = F.array(
        *[
            F.struct(*[F.lit(v).alias(k) for k, v in zip(("filter_order", "step", "own", "before"), s, strict=True)])
            for s in steps
        ]
    )
    row = counts.select("*", F.explode(table).alias("s")).select("*", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0))).cast("long")

    share = F.expr(f"n * ({orders} div nullif(bit_count(mask), 0))")
    return row.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(removed).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(stored(mask_counts(masks(docs), labels), "audit-masks"))
