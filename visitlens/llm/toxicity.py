"""A toxicity classifier that is regularised by counterfactuals.

A logistic regression over the presence of words is fitted on a bounded sample of labelled
rows. In every sampled text that names a group of people, the group terms are swapped for
others of their kind, and a change of the score between the two texts is penalised. So a
neutral mention of a group does not raise the score. The model then scores every whole text.

Defined cases: a null or empty text scores by the intercept. Rows that repeat an id are
scored alike where texts are; a null id counts as held out. Rows with null labels are not
learnt from; with only one class of labels the score is that class's share, with none 0. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import stored, whole_text
from visitlens.llm.learning import bounded_sample, fit_logistic, held_out, sigmoid

#: At most so many labelled rows of each class are learnt from.
PER_CLASS = 4_000
VOCABULARY = 1_000
LEAST_DOCS = 4
MARGIN = 6.0
SWAP_PENALTY = 20.0
L2 = 1e-4

# Group terms by kind, in the four languages; terms of a line are swapped.
GROUP_TERMS = (
    "women men girls boys femmes hommes mujeres hombres frauen männer",
    "woman man girl boy femme homme mujer hombre frau mann",
    "gay lesbian straight bisexual transgender queer homosexual heterosexual",
    "muslim christian jewish hindu buddhist catholic atheist",
    "muslims christians jews hindus buddhists catholics atheists musulmans chrétiens juifs",
    "musulmanes cristianos judíos muslime christen juden",
    "black white asian latino hispanic african european arab",
    "immigrants refugees foreigners migrants citizens immigrés étrangers inmigrantes ausländer",
    "americans mexicans germans french spaniards africans asians arabs russians chinese",
    "old young elderly teenagers disabled blind deaf",
)
KINDS = [line.split() for line in GROUP_TERMS]
KIND_OF = {term: kind for kind in KINDS for term in kind}
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swapped_words(words: set[str]) -> set[str]:
    """The words with every group term replaced by another of its kind, chosen by a hash."""
    out = set()
    for word in words:
        kind = KIND_OF.get(word)
        if kind:
            step = 1 + zlib.crc32(word.encode()) % (len(kind) - 1)
            word = kind[(kind.index(word) + step) % len(kind)]
        out.add(word)
    return out


class Model:
    def __init__(self, weights: dict[str, float], intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def score(self, text: str) -> float:
        known = self.weights.keys() & words_of(text)
        # Added in a fixed order, so that equal texts have equal scores on any machine.
        return float(sigmoid(self.intercept + sum(self.weights[w] for w in sorted(known))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled rows of each class that are not held out."""
    spark = docs.sparkSession
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    drawn = bounded_sample(usable, "toxic", per_class)
    if not drawn:
        return Model({}, -40.0)
    # Bounded by two classes of ``per_class`` ids.
    ids = F.broadcast(spark.createDataFrame(drawn, "doc_id long, toxic int"))
    sample = docs.select("doc_id", whole_text().alias("text")).join(ids, "doc_id")

    def with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(cells, pa.list_(pa.string()))],
                names=["doc_id", "toxic", "words"],
            )

    sample = sample.mapInArrow(with_words, "doc_id long, toxic int, words array<string>")
    seen = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("k")
    )
    n1 = sum(label for _, label in drawn)
    n0 = len(drawn) - n1
    seen = stored(seen.where(F.col("n") >= LEAST_DOCS), "toxicity-words")
    # Twice the log-likelihood ratio against the overall share; by chance the largest of v
    # words reaches about 2 log v.
    p, n, k = n1 / len(drawn), F.col("n"), F.col("k")
    ratio = F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    if n0:
        ratio += F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)
    least = 2 * np.log(seen.count() + 1) + MARGIN
    top = seen.where(2 * ratio >= least).orderBy(F.desc(ratio), "word").limit(VOCABULARY)
    vocabulary = sorted({r["word"] for r in top.select("word").collect()} | set(KIND_OF))
    wanted = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    place = {word: i for i, word in enumerate(vocabulary)}
    rows = sample.select("toxic", wanted.alias("words")).collect()
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    changes = []
    for i, row in enumerate(rows):
        words = set(row["words"])
        x[i, [place[w] for w in words]] = 1
        other = swapped_words(words)
        if other != words:
            change = np.zeros(len(vocabulary), np.float32)
            change[[place[w] for w in words]] += 1
            change[[place[w] for w in other]] -= 1
            changes.append(change)
    y = np.array([row["toxic"] for row in rows], float)
    # Classes are drawn apart; weights give back their true shares.
    drawn_of = {v: max(1.0, float((y == v).sum())) for v in (0, 1)}
    weight = np.array([totals[int(v)] / drawn_of[int(v)] for v in y], float)
    w, b = fit_logistic(x, y, weight, L2, np.array(changes, np.float32) if changes else None, SWAP_PENALTY)
    return Model(dict(zip(vocabulary, w.tolist(), strict=True)), b)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text"))
    rows = rows.mapInArrow(apply, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([model.score(t or "") < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
