import pytest

from tests.rows import values
from visitlens import schemas
from visitlens.plans.scratch import shared_folder
from visitlens.sinks import batches, files
from visitlens.sources.jdbc import partition_options


def _stat(spark, *rows):
    return spark.createDataFrame(rows, schemas.AD_STAT)


def test_append_keeps_earlier_rows_and_text_dates(spark, tmp_path):
    path = str(tmp_path / "t")
    row = ("2024-01-01", "P", "C", 1, 5)
    files.append_rows(_stat(spark, row), path, ["date"])
    files.append_rows(_stat(spark, row), path, ["date"])
    got = files.read_table(spark, path, schemas.AD_STAT)
    assert values(got, "date", "province", "city", "ad_id", "click_count") == [row, row]


def test_overwrite_groups_leaves_other_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    group = ["date", "province"]
    columns = ["date", "province", "ad_id", "click_count"]
    first = [("d1", "A_B", 1, 5), ("d1", "A_B", 2, 4), ("d1", "A", 3, 3), ("d2", "A/B =", 1, 1)]
    second = [("d1", "A_B", 7, 9)]
    for rows in (first, second, second):
        df = spark.createDataFrame(rows, schemas.AD_PROVINCE_TOP3)
        files.overwrite_groups(df, path, group)
    got = files.read_table(spark, path, schemas.AD_PROVINCE_TOP3)
    assert values(got, *columns) == [("d1", "A", 3, 3), ("d1", "A_B", 7, 9), ("d2", "A/B =", 1, 1)]


def test_replaced_group_can_become_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    columns = ["date", "province", "ad_id", "click_count"]

    def write(rows, dates):
        touched = spark.createDataFrame([(d,) for d in dates], "date string")
        rows = spark.createDataFrame(rows, schemas.AD_PROVINCE_TOP3)
        files.replace_groups(rows, touched, path, ["date"])

    write([("d1", "A", 1, 5), ("d2", "A", 2, 4)], ["d1", "d2"])
    write([], ["d1"])
    assert values(files.read_replaced(spark, path, schemas.AD_PROVINCE_TOP3)) == [("d2", "A", 2, 4)]
    write([("d1", "B", 3, 1)], ["d1", "d1"])
    got = files.read_replaced(spark, path, schemas.AD_PROVINCE_TOP3)
    assert values(got, *columns) == [("d1", "B", 3, 1), ("d2", "A", 2, 4)]


KEY = ("date", "province", "city", "ad_id")


def _table(path, merge, by=("date",), every=5):
    return batches.StateTable(path, schemas.AD_STAT, KEY, "click_count", merge, by, every)


@pytest.mark.parametrize("by", [(), ("date",)])
def test_batches_are_idempotent_and_merge_on_read(spark, tmp_path, by):
    a, b, c = (("2024-01-01", "P", "C", ad) for ad in (1, 2, 3))
    first, second = _stat(spark, (*a, 5), (*b, 1)), _stat(spark, (*a, 7), (*c, 2))
    wanted = {"latest": [(*a, 7), (*b, 1), (*c, 2)], "sum": [(*a, 12), (*b, 1), (*c, 2)]}
    for merge, rows in wanted.items():
        table = _table(str(tmp_path / merge), merge, by)
        table.write(first, 0)
        for _ in range(2):  # the second batch is replayed
            table.write(second, 1)
        columns = [*KEY, "click_count"]
        assert values(table.read(spark, 1), *columns) == rows
        assert values(table.read(spark, 0), *columns) == [(*a, 5), (*b, 1)]
        assert table.read(spark, -1).count() == 0


@pytest.mark.parametrize(("merge", "total"), [("sum", 465), ("latest", 30)])
def test_snapshots_bound_the_folders_that_a_reader_opens(spark, tmp_path, merge, total):
    table = _table(str(tmp_path / "t"), merge)
    a = ("2024-01-01", "P", "C", 1)
    for batch_id in range(30):
        table.write(_stat(spark, (*a, batch_id + 1)), batch_id)
        table.snapshot(spark, batch_id)
        assert len(table.deltas(batch_id, table.base(batch_id))) <= table.every
    assert values(table.read(spark, 29), *KEY, "click_count") == [(*a, total)]
    assert len(table.read(spark, 29).inputFiles()) == 5


def test_merging_leaves_untouched_dates_alone(spark, tmp_path):
    """40 batches on the newest date; the folders of the two older dates are never rewritten."""
    table = _table(str(tmp_path / "t"), "sum", every=10)
    old = [(f"2024-01-0{day}", "P", "C", 1, 7) for day in (1, 2)]
    new = ("2024-01-03", "P", "C", 1, 1)
    for batch_id in range(41):
        table.write(_stat(spark, *(old if batch_id == 0 else [new])), batch_id)
        table.snapshot(spark, batch_id)
    based = {b: sorted(p.name for p in (tmp_path / f"t/kind=base/batch={b}").glob("date=*")) for b in (10, 20, 30, 40)}
    assert based == {
        10: ["date=2024-01-01", "date=2024-01-02", "date=2024-01-03"],
        20: ["date=2024-01-03"], 30: ["date=2024-01-03"], 40: ["date=2024-01-03"],
    }
    held = {b: sorted(dates) for b, dates in table.manifest(spark, 40).items()}
    assert held == {10: ["2024-01-01", "2024-01-02"], 40: ["2024-01-03"]}
    for batch_id, total in ((40, 40), (35, 35), (10, 10)):
        got = values(table.read(spark, batch_id), "date", "click_count")
        assert got == [("2024-01-01", 7), ("2024-01-02", 7), ("2024-01-03", total)]


def test_replaced_dates_come_from_their_last_batch(spark, tmp_path):
    key = ("date", "province", "ad_id")
    table = batches.StateTable(str(tmp_path / "t"), schemas.AD_PROVINCE_TOP3, key, "click_count", "replace", ("date",), 2)
    writes = [[("d1", "A", 1, 5), ("d2", "A", 2, 4)], [("d1", "B", 3, 1)], [("d3", "B", 3, 1)], [("d2", "C", 9, 9)]]
    wanted = [
        [("d1", "A", 1, 5), ("d2", "A", 2, 4)],
        [("d1", "B", 3, 1), ("d2", "A", 2, 4)],
        [("d1", "B", 3, 1), ("d2", "A", 2, 4), ("d3", "B", 3, 1)],
        [("d1", "B", 3, 1), ("d2", "C", 9, 9), ("d3", "B", 3, 1)],
    ]
    for batch_id, rows in enumerate(writes):
        table.write(spark.createDataFrame(rows, schemas.AD_PROVINCE_TOP3), batch_id)
        table.snapshot(spark, batch_id)
    for batch_id, rows in enumerate(wanted):
        assert values(table.read(spark, batch_id)) == rows


def test_reader_sees_one_version_of_a_replaced_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    columns = ["date", "province", "ad_id", "click_count"]

    def write(rows):
        frame = spark.createDataFrame(rows, schemas.AD_PROVINCE_TOP3)
        files.replace_groups(frame, frame, path, ["date"])

    def seen():
        return values(files.read_replaced(spark, path, schemas.AD_PROVINCE_TOP3), *columns)

    assert seen() == []
    first, second = [("d1", "A", 1, 5), ("d2", "A", 2, 4)], [("d1", "B", 3, 1), ("d2", "B", 3, 1)]
    write(first)
    held = files.read_replaced(spark, path, schemas.AD_PROVINCE_TOP3)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(files, "_publish", lost)
        with pytest.raises(OSError, match="lost"):
            write(second)
    assert seen() == first  # written, but not published
    write(second[:1])
    assert seen() == [("d1", "B", 3, 1), ("d2", "A", 2, 4)]
    assert values(held, *columns) == first  # a reader keeps the version it has opened
    write(second[1:])
    write([("d3", "C", 1, 1)])
    files.drop_old_versions(spark, path)
    assert seen() == [("d1", "B", 3, 1), ("d2", "B", 3, 1), ("d3", "C", 1, 1)]
    assert sorted(p.name for p in (tmp_path / "t/data").iterdir()) == [f"version={v}" for v in (2, 3, 4)]


def test_null_groups_are_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "g bigint, v bigint"
    for rows in ([(None, 1), (1, 2)], [(None, 3)]):
        frame = spark.createDataFrame(rows, schema)
        files.replace_groups(frame, frame, path, ["g"])
    got = files.read_replaced(spark, path, schema).collect()
    assert {(r.g, r.v) for r in got} == {(None, 3), (1, 2)}


def test_shared_folder_follows_the_session_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(base) and first != second


def test_jdbc_split_options():
    assert partition_options("task_id", 0, 100, 4) == {
        "partitionColumn": "task_id",
        "lowerBound": "0",
        "upperBound": "100",
        "numPartitions": "4",
    }
    with pytest.raises(ValueError):
        partition_options("task_id", 5, 5, 4)
