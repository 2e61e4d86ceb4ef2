import json

import pytest

from visitlens import schemas
from visitlens.params import SessionTask, load_task


def _tasks(spark, **params):
    rows = [(i, "t", None, None, None, None, None, json.dumps(p)) for i, p in params.values()]
    return spark.createDataFrame(rows, schemas.TASK)


def test_first_element_of_each_array_counts(spark):
    given = {
        "startDate": ["2024-01-01", "2025-01-01"],
        "endDate": ["2024-01-31"],
        "startAge": ["10"],
        "endAge": [50],
        "professionals": ["a,b", "c"],
        "cities": [],
        "sex": [""],
        "keywords": ["kw1,kw2"],
        "categoryIds": ["3,14"],
        "targetPageFlow": ["1,2,3"],
    }
    tasks = _tasks(spark, one=(1, given), two=(2, {}))
    assert load_task(tasks, 1) == SessionTask(
        task_id=1,
        start_date="2024-01-01",
        end_date="2024-01-31",
        start_age=10,
        end_age=50,
        professionals=("a", "b"),
        keywords=("kw1", "kw2"),
        category_ids=(3, 14),
        page_flow=(1, 2, 3),
    )
    assert load_task(tasks, 2) == SessionTask(task_id=2)


def test_unknown_or_repeated_task_is_an_error(spark):
    tasks = _tasks(spark, one=(1, {}), again=(1, {}))
    with pytest.raises(LookupError):
        load_task(tasks, 5)
    with pytest.raises(LookupError):
        load_task(tasks, 1)


def test_broken_parameters_are_an_error(spark):
    row = (3, "t", None, None, None, None, None, '{"sex":["male"')
    with pytest.raises(Exception, match="MALFORMED"):
        load_task(spark.createDataFrame([row], schemas.TASK), 3)
