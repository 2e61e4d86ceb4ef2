from tests.rows import values
from visitlens.operators import upserts

SCHEMA = "date string, province string, n bigint"
KEY = ["date", "province"]


def _tables(spark):
    stored = spark.createDataFrame([("d1", "A", 1), ("d1", "A_B", 2), ("d2", "A", 3)], SCHEMA)
    batch = spark.createDataFrame([("d1", "A_B", 10), ("d3", "A", 20)], SCHEMA)
    return stored, batch


def test_split_by_stored_key(spark):
    stored, batch = _tables(spark)
    assert values(upserts.rows_with_stored_key(batch, stored, KEY)) == [("d1", "A_B", 10)]
    assert values(upserts.rows_with_new_key(batch, stored, KEY)) == [("d3", "A", 20)]


def test_replace_and_add(spark):
    stored, batch = _tables(spark)
    assert values(upserts.upsert_replace(stored, batch, KEY, ["n"])) == [
        ("d1", "A", 1),
        ("d1", "A_B", 10),
        ("d2", "A", 3),
        ("d3", "A", 20),
    ]
    assert values(upserts.upsert_add(stored, batch, KEY, "n")) == [
        ("d1", "A", 1),
        ("d1", "A_B", 12),
        ("d2", "A", 3),
        ("d3", "A", 20),
    ]


def test_replace_groups_drops_rows_the_batch_no_longer_has(spark):
    schema = "date string, province string, ad_id bigint, n bigint"
    stored = spark.createDataFrame(
        [("d1", "A_B", 1, 5), ("d1", "A_B", 2, 4), ("d1", "A", 3, 3)], schema
    )
    batch = spark.createDataFrame([("d1", "A_B", 7, 9)], schema)
    assert values(upserts.replace_groups(stored, batch, KEY)) == [
        ("d1", "A", 3, 3),
        ("d1", "A_B", 7, 9),
    ]
