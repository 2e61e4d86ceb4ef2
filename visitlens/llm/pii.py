"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay; looser ones give further candidates.
Labelers vote on every candidate: patterns on its shape, gazetteers on its parts, and words
near it on its context. How often each pattern of votes occurs is counted over the whole
corpus, a table that the labelers bound. Expectation-maximisation estimates from it how
reliable each labeler is and how likely each pattern is to be personal data; a span
classifier is trained on these beliefs and decides which further candidates are spans.

Defined cases: a null or empty text has no spans. Rows that repeat an id or a text are rows
of their own; null ids are kept. Candidates that overlap a base span or an accepted one
before them are left out. A corpus without candidates trains nothing and adds nothing. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from visitlens.llm.common import stored
from visitlens.llm.learning import fit_logistic, sigmoid

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "masked_email", "secret", "national_phone", "id_number", "long_number")

AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MASKED = re.compile(r" ?[\[(]at[\])] ?[\w-]+(?: ?(?:[\[(]dot[\])]|\.) ?[\w-]+)+")
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Za-z]{32,64}(?![0-9A-Za-z])")
NATIONAL = re.compile(r"(?<![0-9+(.)-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
ID_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]")

# The gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov int info biz io co us uk de fr es eu ch at it nl".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "90", "91")
KEY_NAMES = re.compile(r"(?:token|secret|password|passwd|api.?key|access.?key|pwd)\W{0,6}$", re.I)
NEAR = re.compile(r"(?:mail|contact|write|call|phone|tel|mobile|fax|card|visa|pay|account|address|server|host|token|secret|password|key|ssn|id)\W", re.I)
AGAINST = re.compile(r"(?:version|license|licence|isbn|issn|doi|page|fig|chapter|section|order|http|www|commit|sha\d*|md5)\W", re.I)
LABELERS = ("pattern", "shape", "gazetteer", "key_name", "near", "against", "edges")
Candidate = tuple[int, int, int, bool, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each domain after an @, with all the local part before it that no match has used."""
    used = 0
    for m in AT_DOMAIN.finditer(text):
        start = m.start()
        while start > used and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            used = m.end()
            yield start, used


def masked_emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``emails``, with the @ and perhaps the dots spelt in brackets."""
    used = 0
    for m in MASKED.finditer(text):
        start = m.start()
        while start > used and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        if start < m.start():
            used = m.end()
            yield start, used


def spans(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """``kind, start, end, base`` of all candidates."""
    if "@" in text:
        for a, b in emails(text):
            yield 0, a, b, True
    if "(at)" in text or "[at]" in text:
        for a, b in masked_emails(text):
            yield 4, a, b, False
    for m in SECRET.finditer(text):
        if not m[0].isdigit() and not m[0].isalpha():
            yield 5, m.start(), m.end(), False
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield 1, m.start(), m.end(), True
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            good = 14 <= len(digits) <= 19 and luhn(digits)
            if good or 12 <= len(digits) <= 19:
                yield (2 if good else 8), m.start(), m.end(), good
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield 3, m.start(), m.end(), True
    for m in NATIONAL.finditer(text):
        yield 6, m.start(), m.end(), False
    for m in ID_NUMBER.finditer(text):
        yield 7, m.start(), m.end(), False


def vote(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """What each labeler says: 1 for, -1 against, 0 nothing."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = NOT_DIGIT.sub("", span)
    shape, gazetteer = 0, 0
    if kind in (0, 4):
        shape = 1 if len(span) <= 80 else -1
        gazetteer = 1 if re.split(r"\W+", span)[-1].lower() in TOP_DOMAINS else -1
    elif kind == 1:
        first = int(digits[:3] or 0) if span.find(".") == 3 else int(span[: span.find(".")][-3:])
        shape = 1 if 7 <= len(span) <= 15 else -1
        gazetteer = -1 if first in (0, 127, 255) else 1
    elif kind in (2, 8):
        shape = 1 if len(digits) in (15, 16) and luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind in (3, 6):
        shape = 1 if 10 <= len(digits) <= 13 else -1
        gazetteer = 1 if kind == 3 and digits.startswith(COUNTRY_CODES) else 0
    elif kind == 5:
        share = len(digits) / len(span)
        shape = 1 if 0.15 <= share <= 0.85 and len(set(span)) >= 8 else -1
    elif kind == 7:
        shape = -1 if span[:3] in ("000", "666") or span[0] == "9" else 1
    key_name = 1 if kind == 5 and KEY_NAMES.search(before) else 0
    near = 1 if NEAR.search(before) else 0
    against = -1 if AGAINST.search(before) else 0
    around = text[start - 1 : start] + text[end : end + 1]
    edges = -1 if any(c.isalnum() for c in around) else 1
    return [1 if base else 0, shape, gazetteer, key_name, near, against, edges]


def packed(votes: list[int]) -> int:
    code = 0
    for v in votes:
        code = 3 * code + v + 1
    return code


def unpacked(code: int) -> list[int]:
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return votes[::-1]


def candidates(text: str) -> list[Candidate]:
    """``kind, start, end, base, votes, size class`` in order of start, then kind."""
    found = []
    for kind, start, end, base in spans(text):
        size = min(4, (end - start) // 12)
        found.append((kind, start, end, base, packed(vote(text, kind, start, end, base)), size))
    return sorted(found, key=lambda c: (c[1], c[0], c[2]))


CANDIDATES = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,size:int>>"
FOUND = pa.list_(
    pa.struct(
        [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("size", pa.int32())]
    )
)


def labelled(docs: DataFrame, keep: Sequence[str] = ("doc_id",), name: str = "found") -> DataFrame:
    """The columns ``keep`` of every document, and in ``name`` its candidates with their votes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "base", "votes", "size")
        for batch in batches:
            cells = [
                [dict(zip(names, c, strict=True)) for c in candidates(t or "")]
                for t in batch.column("text").to_pylist()
            ]
            kept = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cells, FOUND)], names=[*keep, name])

    schema = StructType([docs.schema[k] for k in keep]).add(name, DataType.fromDDL(CANDIDATES))
    needed = [*keep] if "text" in keep else [*keep, "text"]
    return docs.select(*(F.col(f"`{c}`") for c in needed)).mapInArrow(look, schema)


class Model:
    """Decides on a candidate by its kind, votes and size class."""

    def __init__(self, weights: np.ndarray | None, intercept: float, reliability: np.ndarray | None) -> None:
        self.weights, self.intercept, self.reliability = weights, intercept, reliability
        self.known: dict[tuple[int, int, int], bool] = {}

    def accepts(self, kind: int, votes: int, size: int) -> bool:
        if self.weights is None:
            return False
        key = (kind, votes, size)
        if key not in self.known:
            self.known[key] = bool(row_of(*key) @ self.weights + self.intercept >= 0)
        return self.known[key]

    def chosen(self, found: list) -> list[tuple[int, int, int, bool]]:
        """All base spans, and the accepted others that overlap none before them."""
        base = [(c[1], c[2]) for c in found if c[3]]
        out, i, reached = [], 0, 0
        for kind, start, end, is_base, votes, size in found:
            if is_base:
                out.append((kind, start, end, True))
                continue
            while i < len(base) and base[i][1] <= start:
                i += 1
            clear = start >= reached and all(b >= end or e <= start for b, e in base[i : i + 4])
            if clear and self.accepts(kind, votes, size):
                out.append((kind, start, end, False))
                reached = end
        return out


def row_of(kind: int, votes: int, size: int) -> np.ndarray:
    row = np.zeros(len(KINDS) + 2 * len(LABELERS) + 5)
    row[kind] = 1
    for i, v in enumerate(unpacked(votes)):
        row[len(KINDS) + 2 * i] = v > 0
        row[len(KINDS) + 2 * i + 1] = v < 0
    row[len(KINDS) + 2 * len(LABELERS) + size] = 1
    return row


def estimate(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: beliefs per row, and P(vote | personal or not) per labeler.

    It starts from the majority of votes; priors are held per kind. A labeler that says
    nothing gives no evidence.
    """
    n, m = votes.shape
    belief = np.clip(0.5 + votes.sum(axis=1) / (2 * m), 0.05, 0.95)
    table = np.ones((m, 2, 3))
    for _ in range(rounds):
        for y, share in ((1, belief), (0, 1 - belief)):
            cast = ((votes != 0) * (share * counts)[:, None]).sum(axis=0)
            for v in (-1, 1):
                hit = ((votes == v) * (share * counts)[:, None]).sum(axis=0)
                table[:, y, v + 1] = (hit + 1) / (cast + 2)
        prior = np.full(len(KINDS), 0.5)
        for k in np.unique(kinds):
            own = kinds == k
            prior[k] = ((belief * counts)[own].sum() + 1) / (counts[own].sum() + 2)
        logit = np.log(prior[kinds] / (1 - prior[kinds]))
        for i in range(m):
            logit += np.log(table[i, 1, votes[:, i] + 1] / table[i, 0, votes[:, i] + 1])
        new = np.clip(sigmoid(logit), 1e-6, 1 - 1e-6)
        done, belief = np.abs(new - belief).max() < 1e-6, new
        if done:
            break
    return belief, table


def fit(found: DataFrame, name: str = "found") -> Model:
    """Train on the counts of kinds, votes and size classes over the whole corpus."""
    one = found.select(F.explode(name).alias("c")).select("c.kind", "c.votes", "c.size")
    rows = one.groupBy("kind", "votes", "size").count().collect()
    if not rows:
        return Model(None, 0.0, None)
    rows.sort(key=lambda r: (r["kind"], r["votes"], r["size"]))
    votes = np.array([unpacked(r["votes"]) for r in rows])
    kinds = np.array([r["kind"] for r in rows])
    counts = np.array([r["count"] for r in rows], float)
    belief, table = estimate(votes, kinds, counts)
    x = np.array([row_of(r["kind"], r["votes"], r["size"]) for r in rows])
    weights, intercept = fit_logistic(x, belief, np.sqrt(counts), 1e-4, steps=800)
    return Model(weights, intercept, table)


def listed(chosen: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in sorted(chosen, key=lambda c: (c[1], c[0])))


def detected(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans`` for every document."""
    found = stored(labelled(docs), "pii-candidates")
    model = fit(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for cell in batch.column("found").to_pylist():
                chosen = model.chosen([tuple(c.values()) for c in cell])
                base = [c for c in chosen if c[3]]
                for k in range(4):
                    out[k].append(sum(c[0] == k for c in base))
                out[4].append(listed(base))
                out[5].append(listed(chosen))
            columns = [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(c, pa.string()) for c in out[4:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_spans", "spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return found.mapInArrow(decide, f"doc_id long, {counts}, base_spans string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets.

    Overlapping base spans are covered together, under the kind of the first. The length
    column ``n_chars`` follows the new text. Candidates are found once and stored beside the
    text; the second pass only decides on them.
    """
    name = "found"
    while name in docs.columns:
        name = f"_{name}"
    given = docs.columns
    found = stored(labelled(docs, given, name), "pii-candidates")
    model = fit(found, name)

    def cover(text: str, cell: list[dict]) -> str:
        parts, at = [], 0
        for kind, start, end, _ in model.chosen([tuple(c.values()) for c in cell]):
            if start >= at:
                parts += [text[at:start], f"<{KINDS[kind]}>"]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            cells = batch.column(name).to_pylist()
            texts = [
                None if t is None else cover(t, c)
                for t, c in zip(batch.column(i).to_pylist(), cells, strict=True)
            ]
            columns = [batch.column(c) for c in given]
            columns[given.index("text")] = pa.array(texts, batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, names=given)

    out = found.mapInArrow(rewrite, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)
