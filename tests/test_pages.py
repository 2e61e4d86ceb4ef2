import random
from collections import defaultdict

import pytest

from tests.rows import action, actions, values
from visitlens.operators import pages


def _expected(rows, flow):
    by_session = defaultdict(list)
    for r in rows:
        clock = r["action_time"].split(" ")
        h, m, s = (int(x) for x in clock[1].split(":"))
        by_session[r["session_id"]].append((clock[0], h * 3600 + m * 60 + s, r["page_id"]))
    views = sum(1 for r in rows if r["page_id"] == flow[0])
    moves = [0] * (len(flow) - 1)
    for visits in by_session.values():
        order = [p for _, _, p in sorted(visits)]
        for a, b in zip(order, order[1:]):
            for i, step in enumerate(zip(flow, flow[1:])):
                moves[i] += (a, b) == step
    return (views, *moves)


@pytest.mark.parametrize("flow", [(1, 2), (1, 2, 3), (2, 2, 1, 2), (9, 8, 7)])
def test_moves_match_plain_python(spark, flow):
    """A hot session of many hours, sessions of one action, many equal times."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        session = "hot" if i % 3 == 0 else f"s{rng.randrange(300)}"
        seconds = rng.choice([0, 3599, 3600, 7200, rng.randrange(86400)])
        rows.append(
            action(session, seconds, rng.randrange(1, 5), day=f"2024-01-0{rng.randrange(1, 4)}")
        )
    got = pages.flow_moves(actions(spark, *rows), flow).collect()[0]
    assert tuple(got) == _expected(rows, flow)


def test_rates_and_zero_denominators(spark):
    rows = actions(
        spark,
        *[action("a", i, p) for i, p in enumerate([1, 2, 3, 1, 2])],
        *[action("b", i, p) for i, p in enumerate([1, 3, 2, 3])],
    )
    got = pages.page_convert_rates(rows, (1, 2, 3, 4, 5))
    assert values(got) == [
        (1, 1, 2, 2, 3, 0.67),
        (2, 2, 3, 2, 2, 1.0),
        (3, 3, 4, 0, 2, 0.0),
        (4, 4, 5, 0, 0, 0.0),
    ]
    text = pages.page_split_convert_rate(rows, (1, 2, 3, 4, 5), 9)
    assert values(text) == [(9, "1_2=0.67|2_3=1.0|3_4=0.0|4_5=0.0")]


def test_no_action_gives_zero_rates(spark):
    got = pages.page_convert_rates(actions(spark), (1, 2))
    assert values(got) == [(1, 1, 2, 0, 0, 0.0)]


def test_flow_needs_two_pages(spark):
    with pytest.raises(ValueError):
        pages.flow_moves(actions(spark), (1,))
