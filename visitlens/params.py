"""Task parameters: which actions and which sessions an analysis looks at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys of the task's JSON parameters.
START_DATE = "startDate"
END_DATE = "endDate"
START_AGE = "startAge"
END_AGE = "endAge"
PROFESSIONALS = "professionals"
CITIES = "cities"
SEX = "sex"
KEYWORDS = "keywords"
CATEGORY_IDS = "categoryIds"
TARGET_PAGE_FLOW = "targetPageFlow"


@dataclass(frozen=True)
class SessionTask:
    """Typed parameters. ``None`` or an empty tuple means "not restricted"."""

    task_id: int | None = None
    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    sex: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    category_ids: tuple[int, ...] = ()
    page_flow: tuple[int, ...] = ()


def _first_value(params: Column, key: str) -> Column:
    """Element 0 of the array under ``key``; NULL for a missing key, empty array or ''."""
    return F.nullif(F.try_element_at(F.try_element_at(params, F.lit(key)), F.lit(1)), F.lit(""))


def task_parameters(tasks: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per task with its parameters as typed columns; lists stay comma separated.

    ``mode`` is Spark's JSON mode: broken JSON gives NULL parameters, or stops the query. So
    does an age that is no number.
    """
    def number(value: Column) -> Column:
        return value.cast("int") if mode == "FAILFAST" else value.try_cast("int")

    params = F.from_json("task_param", "map<string,array<string>>", {"mode": mode})
    parsed = tasks.select("task_id", params.alias("p"))
    p = F.col("p")
    return parsed.select(
        "task_id",
        _first_value(p, START_DATE).alias("start_date"),
        _first_value(p, END_DATE).alias("end_date"),
        number(_first_value(p, START_AGE)).alias("start_age"),
        number(_first_value(p, END_AGE)).alias("end_age"),
        _first_value(p, PROFESSIONALS).alias("professionals"),
        _first_value(p, CITIES).alias("cities"),
        _first_value(p, SEX).alias("sex"),
        _first_value(p, KEYWORDS).alias("keywords"),
        _first_value(p, CATEGORY_IDS).alias("category_ids"),
        _first_value(p, TARGET_PAGE_FLOW).alias("page_flow"),
    )


def load_task(tasks: DataFrame, task_id: int) -> SessionTask:
    """The task with this id. The filter on the key reaches the scan; one row comes back.

    Broken JSON is an error: without its parameters the task would run unfiltered.
    """
    found = tasks.where(F.col("task_id") == task_id)
    rows = task_parameters(found, "FAILFAST").limit(2).collect()
    if not rows:
        raise LookupError(f"no task with id {task_id}")
    if len(rows) > 1:
        raise LookupError(f"task id {task_id} is not unique")
    row = rows[0]
    return SessionTask(
        task_id=task_id,
        start_date=row.start_date,
        end_date=row.end_date,
        start_age=row.start_age,
        end_age=row.end_age,
        professionals=_words(row.professionals),
        cities=_words(row.cities),
        sex=_words(row.sex),
        keywords=_words(row.keywords),
        category_ids=tuple(int(v) for v in _words(row.category_ids)),
        page_flow=tuple(int(v) for v in _words(row.page_flow)),
    )


def _words(text: str | None) -> tuple[str, ...]:
    return tuple(w for w in (text or "").split(",") if w)
