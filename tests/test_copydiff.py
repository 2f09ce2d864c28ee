from datetime import datetime

from fixtures import COPIES, cell

from changeweave.operators.copydiff import copy_differences, row_differences


def copies(spark, rows):
    data = [(i, side, table, list(cells), [v if isinstance(v, dict) else cell(v) for v in cells.values()], datetime(2024, 1, 1)) for i, (side, table, cells) in enumerate(rows)]
    return spark.createDataFrame(data, COPIES)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_equal_in_other_spellings(spark):
    stamp = lambda t: cell(t, stamp=True)
    rows = [
        ("primary", "public.products", {"id": 1, "price": 12.5, "active": True, "at": stamp("2024-01-01T00:00:00Z"), "name": "a", "note": None}),
        ("replica", "products", {"active": "t", "id": "1", "price": "12.500", "at": stamp("2024-01-01 01:00:00+01"), "name": "a"}),
    ]
    assert found(copy_differences(copies(spark, rows))) == []


def test_cells_and_rows_that_differ(spark):
    rows = [
        ("primary", "users", {"id": 1, "name": "", "age": 3}), ("replica", "users", {"id": 1, "name": None, "age": 4}), ("primary", "users", {"id": 2, "name": "x"}), ("primary", "users", {"id": 2, "name": "x"}),
        ("replica", "public.user_roles", {"user_id": 5, "org_id": 7, "role_name": "admin"}), ("primary", "users", {"id": 3, "name": "a "}), ("replica", "users", {"id": 3, "name": "a"}), (None, "users", {"id": 9}), ("primary", "users", {"name": "no key"}),
    ]
    assert found(copy_differences(copies(spark, rows))) == [
        ("user_roles", "7|5", "", "missing_in_primary"), ("users", "1", "age", "value"), ("users", "1", "name", "value"), ("users", "2", "", "missing_in_replica"), ("users", "3", "name", "value"),
    ]


def test_empty(spark):
    assert found(copy_differences(copies(spark, []))) == []


def test_one_row_repeated_often(spark):
    rows = [("primary", "users", {"id": 1, "name": "x"})] * 500 + [("replica", "users", {"id": 1, "name": "y"})]
    assert found(copy_differences(copies(spark, rows), bucket_bytes=10)) == [("users", "1", "name", "value")]


def test_row_differences(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "w", None)], "id int, name string, n int")
    b = spark.createDataFrame([(1, "x", 5), (2, "z", 1), (4, None, 7)], "id int, name string, n int")
    got = sorted(map(tuple, row_differences(a, b, "id", ["name", "n"]).collect()), key=str)
    assert got == [(1, "n", None, "5"), (2, "name", "y", "z"), (3, "n", None, None), (3, "name", "w", None), (4, "n", None, "7"), (4, "name", None, None)]
    assert row_differences(a.limit(0), b.limit(0), "id", ["n"]).count() == 0
