"""Conversation repair, the positional index and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from visitlens.llm import conversation_repair as repair
from visitlens.llm import filter_audit, positional_index
from visitlens.llm.conversation_repair import CUT, EMITS, GONE, NEXT, Row

CONVERSATIONS = "conv_id long, turn long, role string, text string, cost long, rows long, range int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, d long, h long, word string, hash long"


# Conversation repair


def plain_best(rows):
    """The least (cost, audit) by dynamic programming over all rows."""

    def inserted(best):
        out = dict(best)
        for _ in range(4):
            for state, (cost, audit) in list(out.items()):
                to, value = NEXT[state, EMITS[state]], (cost + 3, audit + "I")
                out[to] = min(out.get(to, value), value)
        return out

    best = {0: (0, "")}
    for row in rows:
        ahead = {}
        for state, (cost, audit) in inserted(best).items():
            moves = [(state, 4 * row.copies, "D" * row.copies)]
            if row.code != GONE:
                price = 3 if row.code == CUT else 0
                moves.append((NEXT[state, EMITS[state]], 3 + price, "R"))
                if (state, row.initial) in NEXT:
                    moves.append((NEXT[state, row.initial], price, "K"))
            for to, more, edit in moves:
                value = (cost + more, audit + edit)
                ahead[to] = min(ahead.get(to, value), value)
        best = ahead
    best = inserted(best)
    return min(best[end] for end in (0, 3) if end in best)


def some_rows(draw, n):
    codes = [draw.choice([0, 0, 0, 1, 2]) for _ in range(n)]
    return [Row(c, draw.choice(["s", "u", "a", "x", ""]), draw.choice([1, 1, 4]) if c == GONE else 1) for c in codes]


@pytest.mark.parametrize("stretch", [1, 2, 3, 32])
def test_search_finds_the_least_repair(monkeypatch, stretch):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    draw = random.Random(stretch)
    for _ in range(400):
        rows = some_rows(draw, draw.randrange(12))
        assert repair.best_repair(rows) == plain_best(rows)


def test_search_is_linear_in_the_length():
    rows = some_rows(random.Random(5), 3_000)
    assert repair.best_repair(rows) == plain_best(rows)


def test_bound_never_exceeds_the_cost_of_a_suffix():
    draw = random.Random(6)
    for _ in range(300):
        rows = some_rows(draw, draw.randrange(9))
        bounds = repair.suffix_bounds(rows)
        for i, start in itertools.product(range(len(rows) + 1), range(4)):
            ways = [repair.repair(rows[i:], start, [end]) for end in range(4)]
            assert bounds[i] <= min(w[0] for w in ways if w is not None)


def plain_reports(rows):
    """What the contract asks for, conversation by conversation."""
    out, groups = {}, {}
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = groups.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, searched = set(), [], []
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated"
            kind = "none" if kind == "truncated" and body[-1] in ".!?" else kind
            seen.add((role, text))
            faults.append(kind)
            searched.append(Row({"none": 0, "truncated": CUT}.get(kind, GONE), role[:1]))
        cost, audit = plain_best(searched)
        lines, at, state = [], iter(own), 0
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(at)
            if edit == "K":
                lines.append(f"{role}:{text}")
                state = NEXT[state, role[0]]
            elif edit != "D":
                lines.append(("assistant:" if EMITS[state] == "a" else "user:") + text)
                state = NEXT[state, EMITS[state]]
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (
            gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest,
        )
    return out


def conversation_rows():
    draw = random.Random(11)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Ende? ", "é…", "漢字。", None, "x" * 200_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [None, -3, 0, 1, 2, 3, 4, 5, 2**60]:
        for turn in range(draw.randrange(1, 9)):
            roles_now = roles if draw.random() < 0.3 else roles[:3]
            rows.append((conv, draw.choice([turn, turn, turn, None, 2**55 + turn]), draw.choice(roles_now), draw.choice(texts)))
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 5}.") for t in range(600)]
    rows += [(8, 1, "user", "again and again.")] * 300
    return [(*r, 1, 2, 3) for r in rows]


def reports(frame):
    return {r["conv_id"]: tuple(r[c] for c in repair.REPORTED) for r in repair.repaired(frame).collect()}


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_conversations_over_many_ranges(spark, coalesced):
    rows = conversation_rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert reports(spark.createDataFrame(rows, CONVERSATIONS)) == plain_reports(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations_all_dropped_and_empty_table(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = reports(spark.createDataFrame([(dropped, 0, "user", "Hi.", 1, 2, 3)], CONVERSATIONS))
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert reports(spark.createDataFrame([], CONVERSATIONS)) == {}


# Positional index

PHRASE = [f"w{i} Über{i} {i}" for i in range(12)]
ITEM = " ".join(PHRASE)
ITEMS = [
    (1, ITEM, "x"),
    (2, "only THREE words!", "x"),
    (2, "the the the the the the the the the the the the", "x"),
    (None, "no id here at all", "x"),
    (4, None, "x"),
    (5, " ,;. ", "x"),
    (6, "rare", "x"),
    (1, ITEM, "x"),
]
TEXTS = [
    None,
    "",
    "?!",
    ITEM,
    ITEM.upper().replace("Ü", "ü"),
    "before " + " ".join(PHRASE[:4]) + " after",
    " ".join(PHRASE[:3]) + " no",
    "only--three\nwords; the " + "the " * 9 + "rare",
    "the " * 9,
    "the " * 500 + "No id here at all " * 3,
    "filler " * 30_000 + ITEM + " filler " + ITEM,
    ITEM,
]


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_hits(text):
    words, hit, items = plain_words(text), set(), set()
    for item, text_of_item, _ in ITEMS:
        own = plain_words(text_of_item)
        width = min(len(own), 10)
        windows = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} if own else set()
        for i in range(len(words) - width + 1):
            if tuple(words[i : i + width]) in windows:
                hit |= set(range(i, i + width))
                items.add("" if item is None else str(item))
    return len(words), len(hit), len(items), sorted(items), bool(hit)


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, "w", 3) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_contaminated_documents(spark):
    # Ids repeat with equal and with other texts, and one is null.
    texts = TEXTS + [ITEM, ITEM, "the other text", ITEM]
    ids = [*range(len(TEXTS)), 3, 50, 50, None]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string, pos string")
    got = positional_index.contaminated(documents(spark, texts, ids), benchmark).collect()
    want = [(i, *plain_hits(t)) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_contamination_without_rows(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string, pos string")
    none = positional_index.contaminated(documents(spark, []), benchmark)
    assert none.count() == 0
    clean = positional_index.contaminated(documents(spark, TEXTS), benchmark.limit(0)).collect()
    assert [r["contaminated"] for r in clean] == [False] * len(TEXTS)


def test_lists_of_other_terms_are_joined_beyond_the_broadcast_threshold(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        benchmark = spark.createDataFrame(ITEMS, "item_id long, text string, pos string")
        got = positional_index.contaminated(documents(spark, TEXTS), benchmark).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *plain_hits(t))) for i, t in enumerate(TEXTS))


def test_near_matches(spark):
    texts = ["alpha x beta y gamma", "gamma beta alpha", "alpha " + "x " * 30 + "beta gamma", "alpha beta"]
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame([(1, "Alpha, beta: gamma"), (2, "alpha missing")], "item_id long, text string")
    index = positional_index.postings(docs)
    got = positional_index.near(index, benchmark, terms=3, within=5)
    assert sorted((r["d"], r["item"], r["pos"]) for r in got.collect()) == [(0, "1", 0), (1, "1", 0)]


def test_index_uses_no_python(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string, pos string")
    plan = positional_index.contaminated(documents(spark, TEXTS), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Filter audit


def plain_mask(rows, i):
    doc_id, text = rows[i][0], rows[i][1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        re.search("[#$%&*|]", text) is not None,
        doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows),
    ]
    return {name for name, fail in zip("ABCDE", fails, strict=True) if fail}


def plain_audit(rows, labels):
    out = {}
    facts = []
    for i, row in enumerate(rows):
        own = [x for x in labels if x[0] is not None and x[0] == row[0]]
        facts.append((row[2] or "", plain_mask(rows, i), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    removed_of = {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, own in enumerate(order, 1):
                before = set(order[: step - 1])
                hit = [f for f in mine if own in f[1] and not f[1] & before]
                removed_of[part, own] = removed_of.get((part, own), 0) + len(hit)
                out[part, order, step] = [
                    sum(not f[1] & (before | {own}) for f in mine), len(hit),
                    sum(own in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {own} for f in mine),
                    sum(f[2] for f in hit), sum(f[3] for f in hit),
                ]
    return {k: (*v, removed_of[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    draw = random.Random(3)
    long_text = " ".join(f"word{i}" for i in range(260))
    texts = [None, "", "a b", "A" * 50, long_text, long_text + " #", "same " * 300, long_text.upper(), "é" * 99, "x" * 300_000]
    ids = [None, *range(40), 3, 3]
    rows = [(i, draw.choice(texts), draw.choice(["en", "de", None, ""])) for i in ids]
    return rows + [(100 + i, "copied text", "en") for i in range(60)]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 160, 3)] + [(3, 0, 0), (3, 1, None), (None, 1, 1)]
COUNTED = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, rows, labels=LABELS):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, mask int, n long")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumnRenamed("x", "part")
    got = filter_audit.audit(docs.repartition(5), told).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTED) for r in got}


def test_audit_of_all_orders(spark):
    rows = audit_rows()
    assert audited(spark, rows) == plain_audit(rows, LABELS)


def test_audit_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SEGMENT_TEXTS", 7)
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, mask int")
    want = {(r[0], r[2] or "", sum(1 << "ABCDE".index(c) for c in plain_mask(rows, i))) for i, r in enumerate(rows)}
    for most in (0, 1000):
        got = filter_audit.masks(docs.repartition(5), broadcast_hashes=most).collect()
        assert len(got) == len(rows) and set(map(tuple, got)) == want


def test_sketches_clear_only_unique_texts(spark):
    rows = [(i, i % 400) for i in range(420)]  # 20 hashes come twice
    hashes = spark.createDataFrame(rows, "doc_id long, hash long").repartition(6).select("hash")
    found = {r["hash"] for r in filter_audit.possible_repeats(hashes, 3).collect()}
    assert set(range(20)) <= found and len(found) < 40


def test_audit_of_empty_tables(spark):
    assert audited(spark, []) == {}
    rows = audit_rows()[:5]
    assert audited(spark, rows, []) == plain_audit(rows, [])


# Pipeline


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_of_an_empty_table(spark, tmp_path, labelled):
    import corpus_pipeline

    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 1, 0), (2, 0, 1)] if labelled else []
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    told.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# Jaccard join of large groups


def plain_components(texts, n=4, num=85, den=100):
    sets = []
    for text in texts:
        words = text.lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))})
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_large_group_in_many_tiles(spark, monkeypatch, most):
    """A group of many sets in small tiles, its ids broadcast and shuffled."""
    from visitlens.llm import shingle_join

    monkeypatch.setattr(shingle_join, "TILE", 8)
    monkeypatch.setattr(shingle_join, "BROADCAST_SETS", most)
    draw = random.Random(9)
    texts = []
    for size in (40, 150, 400):
        base = [f"w{size}x{i}" for i in range(size)]
        for _ in range(40):
            words = list(base)
            for _ in range(draw.randrange(1 + size // 30)):
                words[draw.randrange(size)] = f"new{draw.random()}"
            texts.append(" ".join(words[: draw.randrange(size * 9 // 10, size + 1)]))
    docs = documents(spark, texts).repartition(7)
    got = sorted(map(tuple, shingle_join.linked(docs).collect()))
    assert got == plain_components(texts)
