"""Repair of damaged conversations by depth-first branch and bound.

Rows are kept, given another role, deleted, or preceded by an inserted empty turn, so that
role initials read ``(s?(ua)+)?``. Of all repairs the cheapest is taken, and of these the one
whose edit initials (K, R, D, I) are least in ASCII order.

*Search* (``repair``). A node is (rows consumed, grammar state). An explicit stack goes through
prefixes of edits in the order of their initials. A prefix is given up if its cost plus the
lower bound of the rows after it exceeds the incumbent, if it ties with the incumbent's cost
and is not less, or if its node's dominance table knows a prefix no worse. The bound adds up
the unavoidable costs of rows and what disjoint pairs of rows that cannot stand side by side
cost beyond that. The search ends when the stack is empty: the incumbent is then optimal.

*Distribution.* Rows are sorted and dealt by ranges of (conversation, turn), so a conversation
that holds a third of all rows is spread over tasks. A conversation inside one range is
repaired there. Of one that crosses ranges, each range is solved from every state to every
state, the best chain of those is taken, and only its edits (some bytes a row) come together;
its texts pass through one task in order, as the hash of a text has to, without being held.
Long runs of rows are solved in stretches of ``STRETCH`` rows that are chained the same way,
which keeps the search linear in the length of a conversation.

Defined cases: nulls of any column are one space, so a null text is blank and a null role
stands for no grammar role; null ids are one conversation. Rows go by turn, nulls first, rows
of one turn by role and text; equal rows are duplicates of each other. A conversation all of
whose rows are dropped, or of which all are deleted, has an empty repair. An empty table gives
an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import stored

# Costs of edits, and the grammar of role initials as state, initial -> state.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = {"su", "ua", "au"}
EMITS = ("u", "u", "a", "u")  # the initial of an inserted or rerolled row, by state
ENDS = (0, 3)
STATES = range(4)
NAMES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
KEPT, GONE, CUT = 0, 1, 2  # a row may stay, has to go, or stays at a price
ORDER = ["conv_id", "turn", "role", "text"]

STRETCH = 32
Best = tuple[int, str]


class Row(NamedTuple):
    """What the search sees of a row. Rows that have to go may stand for several in a run."""

    code: int
    initial: str
    copies: int = 1


# Search


def suffix_bounds(rows: list[Row]) -> list[int]:
    """A lower bound of the cost of the rows from each on, and 0 at the end.

    Rows have their unavoidable costs. Two neighbours among the rows that may stay, whose
    initials cannot follow each other, cost 3 more (rerole, insert), or 1 more where one of
    them is truncated and is deleted instead. Disjoint pairs add up.
    """
    bounds = [0] * (len(rows) + 1)
    stay: list[tuple[Row, int]] = []  # rows that may stay, from the last, and pair bounds
    base = 0
    for i in range(len(rows) - 1, -1, -1):
        row = rows[i]
        base += (0, DELETE * row.copies, TRUNCATED)[row.code]
        if row.code != GONE:
            pairs = stay[-1][1] if stay else 0
            if stay and row.initial + stay[-1][0].initial not in LEGAL:
                extra = DELETE - TRUNCATED if CUT in (row.code, stay[-1][0].code) else REROLE
                pairs = max(pairs, extra + (stay[-2][1] if len(stay) > 1 else 0))
            stay.append((row, pairs))
        bounds[i] = base + (stay[-1][1] if stay else 0)
    return bounds


def first_guess(rows: list[Row], state: int, ends: set[int]) -> int | None:
    """The cost of keeping what can be kept and rerolling the rest, if it comes to an end."""
    cost = 0
    for row in rows:
        if row.code == GONE:
            cost += DELETE * row.copies
            continue
        keep = (state, row.initial) in NEXT
        cost += (0 if keep else REROLE) + (TRUNCATED if row.code == CUT else 0)
        state = NEXT[state, row.initial if keep else EMITS[state]]
    for _ in STATES:
        if state in ends:
            return cost
        state, cost = NEXT[state, EMITS[state]], cost + INSERT
    return None


def repair(rows: list[Row], start: int, ends: Iterable[int]) -> Best | None:
    """The least ``(cost, audit)`` from a grammar state to one of ``ends``; None if there is none."""
    n, ends = len(rows), set(ends)
    bounds = suffix_bounds(rows)
    guess = first_guess(rows, start, ends)
    # The guess has a cost but no audit: it stands after all audits of its cost.
    incumbent: Best | None = None if guess is None else (guess, "~")
    known: dict[tuple[int, int], Best] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if incumbent is not None:
            least = cost + bounds[i]
            if least > incumbent[0] or (least == incumbent[0] and audit >= incumbent[1][: len(audit) + 1]):
                continue
        if (i, state) in known and known[i, state] <= (cost, audit):
            continue
        known[i, state] = (cost, audit)
        if i == n and state in ends and (incumbent is None or (cost, audit) < incumbent):
            incumbent = (cost, audit)
        # Children are pushed from the last initial to the first.
        target = EMITS[state]
        if i < n:
            row = rows[i]
            if row.code != GONE:
                price = TRUNCATED if row.code == CUT else 0
                if row.initial != target:
                    stack.append((i + 1, NEXT[state, target], cost + REROLE + price, audit + "R"))
                if (state, row.initial) in NEXT:
                    stack.append((i + 1, NEXT[state, row.initial], cost + price, audit + "K"))
        stack.append((i, NEXT[state, target], cost + INSERT, audit + "I"))
        # An insertion before a deleted row is never less than one after it.
        if i < n and not audit.endswith("I"):
            stack.append((i + 1, state, cost + DELETE * rows[i].copies, audit + "D" * rows[i].copies))
    return incumbent


Chain = dict[tuple[int, int], Best]


def chained(left: Chain, right: Chain) -> Chain:
    """The best way from each state to each state through two stretches."""
    out: Chain = {}
    for (a, b), (cost, audit) in left.items():
        for (c, d), (more, rest) in right.items():
            if b == c and ((a, d) not in out or (cost + more, audit + rest) < out[a, d]):
                out[a, d] = (cost + more, audit + rest)
    return out


def every_way(rows: list[Row]) -> Chain:
    """The best repair from each state to each state, of a stretch."""
    found = {(a, b): repair(rows, a, [b]) for a in STATES for b in STATES if b > 1 or a <= b}
    return {ends: best for ends, best in found.items() if best is not None}


def through(rows: list[Row]) -> Chain:
    """As ``every_way``, for any number of rows."""
    ways: Chain = {(a, a): (0, "") for a in STATES}
    for i in range(0, max(1, len(rows)), STRETCH):
        ways = chained(ways, every_way(rows[i : i + STRETCH]))
    return ways


def best_repair(rows: list[Row]) -> Best:
    """The best repair of a whole conversation."""
    if len(rows) <= STRETCH:
        return repair(rows, 0, ENDS)
    ways = through(rows)
    return min(ways[0, e] for e in ENDS if (0, e) in ways)


def repaired_lines(rows: Iterable[tuple[str, str, int]], audit: str, state: int = 0) -> Iterator[str]:
    """``role:text`` of what a repair leaves of (role, text, copies) rows, from a state on."""
    each = ((role, text) for role, text, copies in rows for _ in range(copies))
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(each)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else EMITS[state]
        yield f"{role if edit == 'K' else NAMES[initial]}:{text}"
        state = NEXT[state, initial]


# Faults


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the damage of the contract, nulls of role
    and text as one space."""
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    fate = (F.crc32(key) % 20).cast("int")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.when(fate == 3, 2).when(fate == 0, 0).otherwise(1).alias("copies"),
    ).where("copies > 0")


def fault(text: str) -> int | None:
    """0 for none, 2 for a truncated text, None for a blank one."""
    end = text.rstrip(BLANKS)
    return None if not end else KEPT if end[-1] in STOPS else CUT


def mark(role: str, text: str) -> bytes:
    """Stands for a role and a text."""
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


@dataclass
class Tally:
    """Counts over the rows of a conversation, or of a range of it, in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None
    rows: list[Row] = field(default_factory=list)

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        """Equal rows come at once: all but the first are duplicates, unless they are blank."""
        initial, kind = role[:1], fault(text)
        fresh = kind is not None and not seen
        self.blank += copies if kind is None else 0
        self.duplicate += 0 if kind is None else copies - fresh
        self.truncated += fresh and kind == CUT
        self.illegal += copies - 1 + (self.last is not None and self.last + initial not in LEGAL)
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first = initial if self.first is None else self.first
        self.last = initial
        if fresh:
            self.rows.append(Row(kind, initial))
        if copies > fresh:
            self.rows.append(Row(GONE, initial, copies - fresh))

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


# Distribution

REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
REPORTED = [c.split()[0] for c in REPORT.split(", ")]
OPEN = ["conv_id", "range", "place", "turn", "role", "text", "copies"]
RANGED = f"conv_id long, whole boolean, {REPORT}, range int, place long, turn long, role string, text string, copies long"
SOLVED = (
    "conv_id long, range int, blank long, duplicate long, truncated long, illegal long, turns long, "
    "low long, high long, first string, last string, enter array<int>, leave array<int>, "
    "costs array<long>, audits array<string>"
)
JOINED = (
    "conv_id long, range int, state int, edits string, gaps long, blank long, duplicate long, "
    "truncated long, illegal long, cost long, audit string"
)
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}
BATCH = 5_000


def _packed(rows: list[tuple], ddl: str) -> pa.Table:
    names, types = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, ARROW[t]) for n, c, t in zip(names, columns, types, strict=True)})


def _report(rows: list[tuple]) -> tuple:
    """What ``REPORT`` names, of (turn, role, text, copies) rows of a whole conversation."""
    tally, marks = Tally(), set()
    for turn, role, text, copies in rows:
        own = mark(role, text)
        tally.add(turn, role, text, copies, own in marks)
        marks.add(own)
    cost, audit = best_repair(tally.rows)
    lines = "\n".join(repaired_lines((row[1:] for row in rows), audit))
    digest = hashlib.sha256(lines.encode()).hexdigest()
    return tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, digest


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair the conversations that begin and end in a range; pass on the rows of its first
    and its last one, which other ranges may share. Only one conversation's rows are held."""
    none = (None,) * len(REPORTED)
    out: list[tuple] = []
    held: list[tuple] = []
    current, first, place, part = None, True, 0, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("range", *ORDER, "copies")]
        for part, conv, *row in zip(*columns, strict=True):
            if current is None or current[0] != conv:
                if not first:
                    out.append((current[0], True, *_report(held), None, None, None, None, None, None))
                first = current is None
                current, held, place = (conv,), [], 0
            if first:
                out.append((conv, False, *none, part, place, *row))
            else:
                held.append(tuple(row))
            place += 1
            if len(out) >= BATCH:
                yield from _packed(out, RANGED).to_batches()
                out = []
    out += [(current[0], False, *none, part, i, *row) for i, row in enumerate(held)]
    yield from _packed(out, RANGED).to_batches()


def _solved(group: pa.Table) -> pa.Table:
    """One range of a conversation: its counts, and its best repair from state to state."""
    tally = Tally()
    rows = group.sort_by("place").to_pylist()
    for row in rows:
        tally.add(row["turn"], row["role"], row["text"], row["copies"], row["seen"])
    ways = through(tally.rows)
    found = (
        rows[0]["conv_id"], rows[0]["range"], tally.blank, tally.duplicate, tally.truncated, tally.illegal,
        tally.turns, tally.low, tally.high, tally.first, tally.last,
        [a for a, _ in ways], [b for _, b in ways], [c for c, _ in ways.values()], [t for _, t in ways.values()],
    )
    return _packed([found], SOLVED)


def _joined(group: pa.Table) -> pa.Table:
    """Chain the ranges of a conversation; one row per range with its edits, the conversation's
    counts on each and its audit on the first."""
    ranges = group.sort_by("range").to_pylist()
    # Per state: cost, edits, and the way there as (way before, (state before, edits)).
    reached: dict[int, tuple[int, str, tuple]] = {0: (0, "", ())}
    low = high = last = None
    turns = illegal = 0
    for r in ranges:
        ahead: dict[int, tuple[int, str, tuple]] = {}
        for a, b, cost, audit in zip(r["enter"], r["leave"], r["costs"], r["audits"], strict=True):
            if a in reached:
                had, edits, way = reached[a]
                if b not in ahead or (had + cost, edits + audit) < ahead[b][:2]:
                    ahead[b] = (had + cost, edits + audit, (way, (a, audit)))
        reached = ahead
        illegal += r["illegal"] + (last is not None and last + r["first"] not in LEGAL)
        last = r["last"]
        if r["low"] is not None:
            turns += r["turns"] - (r["low"] == high)
            low, high = r["low"] if low is None else low, r["high"]
    cost, audit, way = min(reached[e] for e in ENDS if e in reached)
    steps = []
    while way:
        way, step = way
        steps.append(step)
    gaps = 0 if low is None else high - low + 1 - turns
    counts = [sum(r[c] for r in ranges) for c in ("blank", "duplicate", "truncated")]
    out = [
        (r["conv_id"], r["range"], state, edits, gaps, *counts, illegal, cost, None if i else audit)
        for i, (r, (state, edits)) in enumerate(zip(ranges, reversed(steps), strict=True))
    ]
    return _packed(out, JOINED)


def _lines(group: pa.Table) -> pa.Table:
    """The repaired text of one range of a conversation; null if no row is left."""
    rows = group.sort_by("place").to_pylist()
    each = ((row["role"], row["text"], row["copies"]) for row in rows)
    lines = list(repaired_lines(each, rows[0]["edits"], rows[0]["state"]))
    text = "\n".join(lines).encode() if lines else None
    return _packed([(rows[0]["conv_id"], rows[0]["range"], text)], "conv_id long, range int, lines binary")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of texts that arrive in order, range by range; none is held."""
    current, digest, begun = None, hashlib.sha256(), False
    ddl = "conv_id long, repaired_sha256 string"
    for batch in batches:
        for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines"), strict=True):
            if current is None or current[0] != conv:
                if current is not None:
                    yield from _packed([(current[0], digest.hexdigest())], ddl).to_batches()
                current, digest, begun = (conv,), hashlib.sha256(), False
            if lines.is_valid:
                digest.update(b"\n" if begun else b"")
                digest.update(lines.as_py())
                begun = True
    if current is not None:
        yield from _packed([(current[0], digest.hexdigest())], ddl).to_batches()


def _met(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns in which nulls are equal."""
    other = right.select([F.col(c).alias(f"_{c}" if c in names else c) for c in right.columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    return left.join(other, same, how).drop(*[f"_{c}" for c in names])


def _crossing(rows: DataFrame) -> DataFrame:
    """Repair the conversations whose rows other ranges may share: a few of every range."""
    sign = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    signed = rows.withColumn("sign", sign)
    firsts = signed.groupBy("conv_id", "sign").agg(F.min(F.struct("range", "place")).alias("first"))
    met = _met(signed, firsts, ["conv_id", "sign"]).withColumn("seen", F.struct("range", "place") > F.col("first"))
    solved = met.drop("first", "sign").groupBy("conv_id", "range").applyInArrow(_solved, SOLVED)
    joined = stored(solved.groupBy("conv_id").applyInArrow(_joined, JOINED), "repair-edits")

    edited = _met(rows, joined.select("conv_id", "range", "state", "edits"), ["conv_id", "range"])
    lines = edited.groupBy("conv_id", "range").applyInArrow(_lines, "conv_id long, range int, lines binary")
    in_order = lines.repartition("conv_id").sortWithinPartitions("conv_id", "range")
    digests = in_order.select("conv_id", "lines").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    whole = joined.where("audit IS NOT NULL").drop("range", "state", "edits")
    return _met(whole, digests, ["conv_id"]).select("conv_id", *REPORTED)


def repaired(conversations: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id`` and what ``REPORT`` names."""
    # Rows equal in all columns are counted first: they cannot be dealt to several ranges.
    rows = damaged(conversations).groupBy(*ORDER).agg(F.sum("copies").cast("long").alias("copies"))
    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ranged = dealt.select(F.spark_partition_id().alias("range"), *ORDER, "copies")
    done = stored(ranged.mapInArrow(_ranges, RANGED), "repair-ranges")

    whole = done.where("whole").select("conv_id", *REPORTED)
    known = stored(whole.unionByName(_crossing(done.where("NOT whole").select(OPEN))), "repair-known")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return _met(every, known, ["conv_id"], "left").select(
        "conv_id", *[F.coalesce(c, F.lit(zero.get(c, 0))).alias(c) for c in REPORTED]
    )
