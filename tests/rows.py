"""Small input tables for tests."""

from visitlens import schemas

_NAMES = [c.strip().split(" ")[0] for c in schemas.USER_VISIT_ACTION.split(",")]


def actions(spark, *rows):
    """Actions from dicts; columns not given are NULL, the date follows the time."""
    full = []
    for row in rows:
        row = {"date": (row.get("action_time") or "")[:10] or None} | row
        full.append(tuple(row.get(name) for name in _NAMES))
    return spark.createDataFrame(full, schemas.USER_VISIT_ACTION)


def action(session_id, seconds, page_id=0, day="2024-01-01", user_id=1, **more):
    """One action so many seconds after midnight."""
    clock = f"{seconds // 3600}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    return {
        "session_id": session_id,
        "user_id": user_id,
        "page_id": page_id,
        "action_time": f"{day} {clock}",
    } | more


def users(spark, *rows):
    """Users from (id, age, professional, city, sex)."""
    full = [(u, f"user{u}", f"name{u}", age, job, city, sex) for u, age, job, city, sex in rows]
    return spark.createDataFrame(full, schemas.USER_INFO)


def values(df, *columns):
    """Rows as sorted tuples of the given columns (all if none)."""
    picked = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in picked.collect())
