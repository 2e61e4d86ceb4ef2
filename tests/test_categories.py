import random
from collections import Counter

from tests.rows import action, actions, values
from visitlens.operators import categories, sessions


def _random_actions(rng):
    rows = []
    for i in range(1500):
        session = "hot" if i % 3 == 0 else f"s{rng.randrange(60)}"
        ids = ",".join(str(rng.randrange(15)) for _ in range(rng.randrange(1, 4)))
        kind = rng.choice(
            [
                {"click_category_id": rng.randrange(15)},
                {"order_category_ids": ids},
                {"pay_category_ids": ids},
                {"search_keyword": "kw"},
            ]
        )
        rows.append(action(session, i, **kind))
    return rows


def test_top_categories_and_their_sessions_match_plain_python(spark):
    rows = _random_actions(random.Random(11))
    acts = actions(spark, *rows)
    chosen = sessions.aggregate_sessions(acts).where("session_id <> 's1'")
    counts = categories.category_counts_by_session(acts, chosen)

    totals, clicks = Counter(), Counter()
    for row in rows:
        if row["session_id"] == "s1":
            continue
        if row.get("click_category_id") is not None:
            totals[row["click_category_id"], "click"] += 1
            clicks[row["click_category_id"], row["session_id"]] += 1
        for kind in ("order", "pay"):
            for c in (row.get(f"{kind}_category_ids") or "").split(","):
                if c:
                    totals[int(c), kind] += 1
    ranked = sorted(
        range(15), key=lambda c: (-totals[c, "click"], -totals[c, "order"], -totals[c, "pay"], c)
    )[:10]
    expected = sorted((5, c, *(totals[c, k] for k in ("click", "order", "pay"))) for c in ranked)
    assert values(categories.top10_category(counts, 5)) == expected

    best = []
    for c in ranked:
        members = sorted((-n, s) for (cat, s), n in clicks.items() if cat == c)[:10]
        best += [(5, c, s, -n) for n, s in members]
    assert values(categories.top10_category_session(counts, 5)) == sorted(best)


def test_fewer_than_ten_categories_and_untouched_rows(spark):
    acts = actions(
        spark,
        action("a", 1, order_category_ids="3,3,4"),
        action("a", 2),
        action("b", 3, pay_category_ids="4", click_category_id=None),
    )
    counts = categories.category_counts_by_session(acts, sessions.aggregate_sessions(acts))
    assert values(categories.top10_category(counts, None)) == [(None, 3, 0, 2, 0), (None, 4, 0, 1, 1)]
    assert categories.top10_category_session(counts, None).count() == 0
