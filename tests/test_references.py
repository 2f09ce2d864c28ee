from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from changeweave.operators.references import canonical_uuid, orphan_counts, orphan_references
from changeweave.plans.data_quality import SQL

O = "id string, owner_id string, name string, billing_address string, created_at timestamp, updated_at timestamp, loaded_at timestamp"
U = "id string, organization_id string, name string, email string, password string, created_at timestamp, updated_at timestamp, loaded_at timestamp"
S = "id string, organization_id string, plan_id string, monthly_per_user_price double, created_at timestamp, updated_at timestamp, loaded_at timestamp"
C = "id string, organization_id string, number string, exp_month int, exp_year int, cvv string, created_at timestamp, updated_at timestamp, loaded_at timestamp"
R = "table_name string, record_id string, removed_at timestamp"


def uuid(n):
    return f"00000000-0000-0000-0000-{n:012d}"


def day(n):
    return datetime(2024, 1, n)


def test_uuid_spellings(spark):
    texts = [uuid(1), uuid(1).replace("-", ""), "{" + uuid(1) + "}", f" {uuid(1).upper()} ", "0000-00000000-0000-0000-0000-00000001", "", "  ", None, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_uuid(F.col("t")).alias("u"))
    assert [r.u for r in df.collect()] == [uuid(1)] * 5 + [None] * 3 + ["x"]


def test_reasons(spark):
    orgs = [(uuid(1), uuid(100), "a", "", day(1), day(1), day(1)), (uuid(2), None, "b", "", day(1), day(1), day(9)), (uuid(3), "", "c", "", day(1), day(1), day(1))]
    users = [
        (uuid(100), uuid(1), "", "", "", day(2), day(2), day(2)), (uuid(101), uuid(2), "", "", "", day(2), day(2), day(3)), (uuid(102), uuid(3), "", "", "", day(2), day(2), day(3)), (uuid(103), uuid(77), "", "", "", day(2), day(2), day(3)),
        (uuid(104), uuid(77), "", "", "", day(2), day(2), day(3)), (uuid(104), uuid(1), "", "", "", day(2), day(3), day(3)), (uuid(105), uuid(77), "", "", "", day(2), day(2), day(3)), (uuid(106), None, "", "", "", None, day(2), day(3)),
    ]
    removals = [("organizations", "{" + uuid(3) + "}", day(5)), ("users", uuid(105), day(2)), ("users", uuid(103), day(1))]
    tables = {"organizations": spark.createDataFrame(orgs, O), "users": spark.createDataFrame(users, U), "subscriptions": spark.createDataFrame([], S), "credit_cards": spark.createDataFrame([], C)}
    found = orphan_references(tables, spark.createDataFrame(removals, R))
    # The organization was loaded on the day before its owner.
    assert sorted(tuple(r) for r in found.collect()) == [
        ("organizations", uuid(1), "owner_id", "2024-01", "late"), ("users", uuid(101), "organization_id", "2024-01", "late"), ("users", uuid(102), "organization_id", "2024-01", "deleted"), ("users", uuid(103), "organization_id", "2024-01", "missing"),
    ]
    assert sum(r.orphans for r in orphan_counts(found).collect()) == 4


def test_references_without_load_time(spark):
    """All references to a removed and to a missing parent have no loaded_at."""
    orgs = [(uuid(3), None, "c", "", day(1), day(1), day(1)), (uuid(4), None, "d", "", day(1), day(1), day(9))]
    users = [(uuid(100 + n), uuid(n), "", "", "", day(2), day(2), None) for n in (3, 4, 77)]
    tables = {"organizations": spark.createDataFrame(orgs, O), "users": spark.createDataFrame(users, U), "subscriptions": spark.createDataFrame([], S), "credit_cards": spark.createDataFrame([], C)}
    found = orphan_references(tables, spark.createDataFrame([("organizations", uuid(3), day(5))], R))
    assert sorted((r.record_id, r.reason) for r in found.collect()) == [(uuid(103), "deleted"), (uuid(177), "missing")]


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    names = ("organizations", "users", "subscriptions", "credit_cards", "removals")
    con = duckdb.connect()
    for n in names:
        con.execute(f"create view {n} as select * from '{folder}/{n}.parquet'")
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    got = sorted(tuple(r) for r in orphan_references(t, t["removals"]).collect())
    assert got == sorted((a, b, c, d, e) for a, b, c, d, e in con.execute(SQL["p4_found"]).fetchall())
