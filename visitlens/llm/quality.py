"""A quality classifier by co-training on two views of a document.

One view is what the text is like (shares of symbols, repeats, line and word lengths), the
other is the page's metadata (language, source, declared length). A classifier of each view
is fitted on a bounded sample of labelled rows. In each of several rounds both score every
document that is not held out, and each hands the ``HANDED`` pseudo-labels of a class that it
is surest of to the other. Documents with equal text features count once, so copies of one
text are handed over once. A histogram of the scores gives the score from which labels are
handed over before any row is collected, so what reaches the driver follows ``HANDED`` alone.
Each view is then calibrated on labelled rows that it was not fitted on, and a small
regression over the two calibrated scores gives the score of every document.

Defined cases: a null or empty text has all features 0; null metadata is a value of its own.
Rows that repeat an id are rows of their own; null ids count as held out. Rows with null
labels are not learnt from; with no labels, or of one class only, scores are that class's
share, or 1. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import stored, whole_text
from visitlens.llm.learning import bounded_sample, fit_logistic, held_out, lowest, sigmoid

#: Bound of the labelled sample, for each class.
PER_CLASS = 8_000
ROUNDS = 4
#: Pseudo-labels that a view hands over in a round, for each class: a step of the method, not a
#: bound on the documents it chooses from, which are all.
HANDED = 500
CONFIDENT = 0.97
#: Steps of the histogram of scores, as log odds up to ``TOP_ODDS``.
STEP, TOP_ODDS = 1 / 64, 40.0
L2 = 1e-4
LANG_SLOTS, SOURCE_SLOTS = 16, 64

LETTERS = re.compile(r"[^\W\d_]+")
WORDY = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
BLANK = b" \t\n\r\x0b\x0c"
TEXT_FEATURES = 14
POOLED = "doc_id long, lang string, source string, n_chars long, features array<double>"


def text_features(text: str) -> list[float]:
    """Shares and means between 0 and about 10, over the whole text."""
    data = text.encode()
    words = data.lower().split()
    if not words:
        return [0.0] * TEXT_FEATURES
    n, size = len(words), len(data)
    symbols = len(data.translate(None, WORDY + BLANK))
    marks = sum(map(data.count, (b".", b",", b"'", b"?", b"-", b"\""))) / size
    upper = 1 - len(data.translate(None, bytes(range(65, 91)))) / size
    digits = 1 - len(data.translate(None, b"0123456789")) / size
    distinct = len(set(words)) / n
    repeats = sum(map(bytes.__eq__, words, itertools.islice(words, 1, None))) / n
    pairs = list(zip(words, itertools.islice(words, 2, None), strict=False))
    lines = [line for line in data.split(b"\n") if line.strip()]
    same_lines = 1 - len(set(lines)) / max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        10 * symbols / size,
        10 * marks,
        upper,
        10 * digits,
        distinct * min(1.0, n / 200),
        repeats,
        1 - len(set(pairs)) / max(1, len(pairs)),
        same_lines,
        float(np.log1p(n)) / 5,
        float(np.log1p(size / max(1, len(lines)))) / 5,
        float(lengths.mean()) / 5,
        float((lengths == 1).mean()),
        float((lengths > 20).mean()),
        10 * (data.count(b"|") + data.count(b"{") + data.count(b"<")) / size,
    ]


def slot(value: str | None, slots: int) -> int:
    return zlib.crc32(("?" if value is None else f"={value}").encode()) % slots


def views(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The matrices of both views."""
    n = len(rows)
    text = np.array(rows["features"].tolist(), float).reshape(n, TEXT_FEATURES)
    text = np.hstack([text, np.minimum(text, 10) ** 2])
    meta = np.zeros((n, LANG_SLOTS + SOURCE_SLOTS + 3))
    for i, (lang, source) in enumerate(zip(rows["lang"], rows["source"], strict=True)):
        meta[i, slot(lang, LANG_SLOTS)] = 1
        meta[i, LANG_SLOTS + slot(source, SOURCE_SLOTS)] = 1
    chars = np.log1p(np.maximum(rows["n_chars"].fillna(0).to_numpy(float), 0)) / 5
    meta[:, -3], meta[:, -2], meta[:, -1] = chars, chars**2, rows["n_chars"].isna()
    return text, meta


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang, source, n_chars, features``: one pass over all texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [text_features(t) for t in batch.column("text").to_pylist()]
            others = [batch.column(c) for c in ("doc_id", "held_out", "lang", "source", "n_chars")]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(cells, pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "lang", "source", "n_chars", "features"],
            )

    rows = docs.select(
        "doc_id", held_out().alias("held_out"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"),
        whole_text().alias("text"),
    )
    schema = "doc_id long, held_out boolean, lang string, source string, n_chars long, features array<double>"
    return rows.mapInArrow(measure, schema)


class Model:
    """Weights of both views, their calibration and their combination."""

    def __init__(self, parts: list[tuple[np.ndarray, float]], scale: list, mix: tuple[np.ndarray, float]) -> None:
        self.parts, self.scale, self.mix = parts, scale, mix

    def score(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both."""
        logits = []
        for x, (w, b), (slope, shift) in zip(views(rows), self.parts, self.scale, strict=True):
            logits.append(slope * (x @ w + b) + shift)
        z = np.stack(logits, axis=1)
        return sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(z @ self.mix[0] + self.mix[1])


def sure_of(rows: pd.DataFrame, parts: list[tuple[np.ndarray, float]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each view and class, the places in ``rows`` of confident scores, and their steps."""
    least = np.log(CONFIDENT / (1 - CONFIDENT))
    for v, (x, (w, b)) in enumerate(zip(views(rows), parts, strict=True)):
        odds = x @ w + b
        for value, signed in ((1, odds), (0, -odds)):
            at = np.flatnonzero(signed >= least)
            yield v, value, at, (np.minimum(signed[at], TOP_ODDS) / STEP).astype(np.int64)


def hand_over(pool: DataFrame, parts: list[tuple[np.ndarray, float]], given: list[set[int]]) -> pd.DataFrame:
    """``view, value`` and the columns of ``pool`` of the documents that a view hands over.

    ``given`` holds, for each view, the ids that it has handed over before.
    """

    def confident(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for v, value, at, step in sure_of(batch, parts):
                new = np.array([i not in given[v] for i in ids[at]], bool)
                if new.any():
                    yield batch.iloc[at[new]].assign(view=v, value=value, step=step[new])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in confident(batches):
            yield rows.groupby(["view", "value", "step"]).size().rename("n").reset_index()

    steps = pool.mapInPandas(counted, "view int, value int, step long, n long")
    steps = steps.groupBy("view", "value", "step").agg(F.sum("n").alias("n")).toPandas()
    # The whole steps that fit are handed over whole; of the next one, the lowest hashes.
    whole, last = F.lit(False), []
    for (v, value), own in steps.groupby(["view", "value"]):
        own = own.sort_values("step", ascending=False)
        fit = own[own["n"].cumsum() <= HANDED]
        here = (F.col("view") == int(v)) & (F.col("value") == int(value))
        if len(fit):
            whole = whole | (here & (F.col("step") >= int(fit["step"].min())))
        if len(fit) < len(own):
            edge = own.iloc[len(fit)]
            last.append((here & (F.col("step") == int(edge["step"])), int(edge["n"]), HANDED - int(fit["n"].sum())))
    if not len(steps):
        return pd.DataFrame()
    rows = pool.mapInPandas(confident, f"{POOLED}, view int, value int, step long")
    picked = [r.asDict() for r in rows.where(whole).collect()]
    for at, n, wanted in last:
        if wanted:
            picked += [r.asDict() for r in lowest(rows.where(at), n, wanted)]
    return pd.DataFrame(picked).sort_values(["view", "value", "doc_id"], ignore_index=True)


def co_train(labelled: pd.DataFrame, pool: DataFrame, weight_of: dict[int, float]) -> Model:
    """Fit both views in rounds, then calibrate and combine them on a fifth kept apart."""
    labelled = labelled.sort_values("doc_id", ignore_index=True)
    y = labelled["quality"].to_numpy(float)
    weight = np.array([weight_of[int(v)] for v in y])
    apart = np.array([zlib.crc32(f"calibrate {i}".encode()) % 5 == 0 for i in labelled["doc_id"]])
    if not len(y) or y.min() == y.max() or not apart.any() or apart.all():
        share = np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6)
        sizes = [v.shape[1] for v in views(labelled)]
        return Model([(np.zeros(k), 0.0) for k in sizes], [(1.0, 0.0)] * 2, (np.zeros(2), float(np.log(share / (1 - share)))))
    own = views(labelled)
    x, target, share = [v[~apart] for v in own], [y[~apart]] * 2, [weight[~apart]] * 2
    given: list[set[int]] = [set(), set()]
    for step in range(ROUNDS + 1):
        parts = [fit_logistic(x[v], target[v], share[v], L2) for v in (0, 1)]
        if step == ROUNDS:
            break
        handed = hand_over(pool, parts, given)
        if not len(handed):
            break
        matrices = views(handed)
        for v in (0, 1):  # what this view is sure of goes to the other
            rows, other = (handed["view"] == v).to_numpy(), 1 - v
            given[v].update(handed["doc_id"][rows].tolist())
            x[other] = np.vstack([x[other], matrices[other][rows]])
            target[other] = np.concatenate([target[other], handed["value"][rows].to_numpy(float)])
            share[other] = np.concatenate([share[other], np.full(rows.sum(), weight.min())])
    scale, z = [], []
    for v in (0, 1):
        raw = (own[v][apart] @ parts[v][0] + parts[v][1])[:, None]
        slope, shift = fit_logistic(raw, y[apart], weight[apart], 1e-3)
        scale.append((float(slope[0]), shift))
        z.append(raw[:, 0] * slope[0] + shift)
    return Model(parts, scale, fit_logistic(np.stack(z, axis=1), y[apart], weight[apart], 1e-3))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, text_score, meta_score, score, keep`` for every document."""
    spark = docs.sparkSession
    rows = stored(features(docs), "quality-features")
    usable = labels.where(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    totals = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    drawn = bounded_sample(usable, "quality", PER_CLASS)
    ids = F.broadcast(spark.createDataFrame(drawn, "doc_id long, quality int"))
    labelled = rows.join(ids, "doc_id").toPandas()
    once = rows.where(~F.col("held_out")).groupBy("features").agg(
        F.min(F.struct("doc_id", "lang", "source", "n_chars")).alias("first")
    )
    pool = stored(once.select("first.*", "features"), "quality-pool")
    counts = labelled["quality"].value_counts()
    model = co_train(labelled, pool, {v: totals[v] / counts[v] for v in counts.index})

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text, meta, both = model.score(batch)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"],
                    "text_score": text, "meta_score": meta, "score": both, "keep": both >= 0.5,
                }
            )

    return rows.mapInPandas(
        apply, "doc_id long, held_out boolean, text_score double, meta_score double, score double, keep boolean"
    )
