"""Packing documents into sequences by cutting-stock column generation.

Documents are tokenised, closed by an end id and cut at multiples of the sequence length;
what is left of each is a piece shorter than a sequence. Pieces are counted by length in
classes of ``STEP`` tokens, a histogram whose size the sequence length fixes. A linear
program over patterns (how many pieces of each class share a sequence) is solved by column
generation: a knapsack by dynamic programming prices new patterns from the dual values.
Pattern counts are rounded down, the few pieces left over are packed first-fit decreasing,
and Spark hands the pieces of each class, in ranked order, to the patterns.

Defined cases: a null text is empty and consists of the end id. Rows that repeat an id are
rows of their own; null ids are kept. An empty table gives an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.llm.common import ranked, slices, stored, whole_text
from visitlens.llm.pretokens import BEYOND_LATIN, splitter

SEQUENCE = 2048
END_ID = 1
STEP = 8
#: Columns that are generated at most. It bounds the driver's work, not the pieces: beyond
#: it, packing goes on with the patterns found, and may pad more.
MOST_COLUMNS = 2_000
#: The program is left when its value is proven to be within this share of the least.
GAP = 0.002
BATCH_BYTES = 4 << 20
CACHED_WORDS = 400_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def ordered_ranks(model_text: str) -> dict[bytes, int] | None:
    """The byte strings of a byte-level BPE file with their ids, if every merge makes a token
    of a higher id than the merge before it: then merging by rank is merging by id."""
    model = json.loads(model_text)["model"]
    vocab = model["vocab"]
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocab[token] for token in made]
    if any(a >= b for a, b in itertools.pairwise(ids)):
        return None
    # Byte-level BPE shows printable bytes as themselves and the others from U+0100 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    tokens = [*byte_of, *made]
    return {bytes(byte_of[c] for c in token): vocab[token] for token in tokens}


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: documents cut at whole sequences.

    A task encodes the new words of a batch and keeps a bounded table of known ones. Where
    the file's merges stand in the order of their ids, words go through the faster merge
    loop of tiktoken, with the ids of this file. Texts beyond Latin-1, and those that hold an
    added token of the file, go through the tokenizer whole, which finds such tokens in text.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        model_text = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((model_text, ordered_ranks(model_text)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model_text, ranks = shared.value
        tokenizer = Tokenizer.from_str(model_text)
        special = [re.escape(t["content"]) for t in json.loads(model_text).get("added_tokens", [])]
        whole = re.compile("|".join([BEYOND_LATIN.pattern, *special]))
        if ranks:
            fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        split, known = splitter(pattern), {}
        end = np.array([end_id], "<u4").tobytes()

        def ids_of(texts: list[str]) -> list[bytes]:
            found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]

        def word_ids(words: list[str]) -> list[bytes]:
            if not ranks:
                return ids_of(words)
            return [array("I", fast.encode_ordinary(w)).tobytes() for w in words]

        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            words = [None if whole.search(t) else split(t) for t in texts]
            met = set().union(*filter(None, words))
            if len(known) + len(met) > CACHED_WORDS:
                known.clear()
            new = list(met.difference(known))
            known.update(zip(new, word_ids(new), strict=True))
            out = [[] for _ in range(5)]
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), texts, words, strict=True):
                ids = ids_of([text])[0] if found is None else b"".join(map(known.__getitem__, found))
                ids += end
                n = len(ids) // 4
                for start in range(0, n, sequence):
                    part = ids[4 * start : 4 * (start + sequence)]
                    for column, value in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(cut, PIECE)


def best_pattern(values: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of most value that fits, by dynamic programming."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(widths)
    widths_up, values_up = widths[order], values[order]
    for room in range(1, capacity + 1):
        fit = int(np.searchsorted(widths_up, room, side="right"))
        best[room] = best[room - 1]
        if fit:
            gains = values_up[:fit] + best[room - widths_up[:fit]]
            top = int(np.argmax(gains))
            if gains[top] > best[room] + 1e-12:
                best[room], choice[room] = gains[top], top
    pattern = np.zeros(len(widths), np.int64)
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            item = order[choice[room]]
            pattern[item] += 1
            room -= widths[item]
    return float(best[capacity]), pattern


def column_generation(widths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole-numbered ``(pattern, times)`` that use up the demand exactly.

    The linear program is solved by the revised simplex method, its basis starting with one
    pattern per class. After ``MOST_COLUMNS`` columns the basis reached is used as it is.
    """
    m = len(widths)
    if not m:
        return []
    basis = np.diag((capacity // widths).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    # Ties between classes of equal demand could make the basis go round in circles.
    demanded = demand + np.random.default_rng(1).uniform(0.0, 0.01, m)
    amount = demanded / np.diag(basis)
    for step in range(MOST_COLUMNS):
        duals = np.maximum(inverse.sum(axis=0), 0.0)
        value, pattern = best_pattern(duals, widths, capacity)
        if value <= 1 + GAP:
            break
        direction = inverse @ pattern
        rows = np.flatnonzero(direction > 1e-9)
        out = rows[np.argmin(amount[rows] / direction[rows])]
        times = max(0.0, amount[out] / direction[out])
        amount = np.maximum(amount - times * direction, 0.0)
        amount[out] = times
        basis[:, out] = pattern
        inverse[out] /= direction[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(direction[others], inverse[out])
        if step % 100 == 99:
            # A Newton step takes out rounding errors; einsum stays on this one thread.
            error = 2 * np.eye(m) - np.einsum("ij,jk->ik", basis, inverse)
            inverse = np.einsum("ij,jk->ik", inverse, error)
            amount = np.maximum(inverse @ demanded, 0.0)
    left, chosen = demand.astype(np.int64).copy(), []
    for j in np.argsort(-amount):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        times = int(min(amount[j], (left[used] // pattern[used]).min()))
        if times > 0:
            chosen.append((pattern, times))
            left -= times * pattern
    for j in np.argsort(-(amount % 1)):  # once more where the rounded-off part is large
        pattern = np.rint(basis[:, j]).astype(np.int64)
        if (left >= pattern).all():
            chosen.append((pattern, 1))
            left -= pattern
    return chosen + first_fit(widths, left, capacity)


def first_fit(widths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for what rounding left over: the largest piece that fits, again and again."""
    left, chosen, order = left.copy(), [], np.argsort(-widths)
    while left.any():
        pattern, room = np.zeros(len(widths), np.int64), capacity
        for i in order:
            n = min(left[i], room // widths[i])
            pattern[i], room = n, room - n * widths[i]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= times * pattern
        chosen.append((pattern, times))
    return chosen


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, sequence: int = SEQUENCE, end_id: int = END_ID, step: int = STEP) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``; the pieces of a sequence leave no gap."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer_path, pattern, sequence, end_id)
    cut = stored(cut.withColumn("class", F.ceil(F.col("length") / step).cast("int")), "pack-pieces")
    counts = {r["class"]: r["count"] for r in cut.groupBy("class").count().collect()}
    widths = np.array(sorted(counts), np.int64)
    demand = np.array([counts[w] for w in widths.tolist()], np.int64)
    capacity = sequence // step
    allotted, base, used = [], 0, np.zeros(len(widths), np.int64)
    for pattern_row, times in column_generation(widths, demand, capacity):
        for i in np.flatnonzero(pattern_row).tolist():
            per = int(pattern_row[i])
            low = int(used[i])
            used[i] += per * times
            allotted.append((int(widths[i]), low, int(used[i]), per, base))
        base += times
    schema = "class int, low long, high long, per long, base long"
    # A pattern has few classes and there are about as many patterns as classes: bounded.
    places = F.broadcast(spark.createDataFrame(allotted, schema))
    numbered = ranked(cut, ["class"], ["doc_id", "start"], int(demand.sum()))
    placed = numbered.join(places, "class").where("rank >= low AND rank < high").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank",
        (F.col("base") + F.expr("(rank - low) div per")).alias("sequence_id"),
    )
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    offset = F.sum("length").over(before) - F.col("length")
    return placed.withColumn("offset", offset).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
