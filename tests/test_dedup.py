import brute
from fixtures import LOG, change, dicts, log
from pyspark.sql import functions as F

from changeweave.operators.dedup import RANK, delivered_once, newly_delivered, rank_copies, stored_once, surplus_deliveries
from changeweave.streaming import streams


def test_spellings_of_a_position_are_one(spark):
    rows = [change(1, "0/1A", "insert", at=3), change(2, "0/1a", "insert", at=1), change(3, "0/0000001a", "insert", at=1), change(4, "0/1A", "insert", row_no=1), change(5, "0/1A", "insert", stream="t")]
    assert sorted(r[0] for r in surplus_deliveries(log(spark, rows)).collect()) == [1, 3]
    assert sorted(r["delivery_id"] for r in delivered_once(log(spark, rows)).collect()) == [2, 4, 5]


def test_one_identifier_with_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("key"), (F.col("id") % 7).alias("at"))
    ranked = rank_copies(df, ["key"], ["at", "id"])
    assert ranked.count() == 3000
    kept = ranked.where(F.col(RANK) == 1)
    assert kept.count() == 2001
    assert kept.where("key = -1").first()["id"] == 0


def test_null_identifiers_stay_and_columns_may_clash(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 1, "a"), ("k", 1, "b"), ("k", 1, "b")], "key string, at int, count string")
    out = rank_copies(df, ["key"], ["at"])
    assert out.where(F.col(RANK) == 1).count() == 3
    assert set(out.columns) == {"key", "at", "count", RANK}


def test_empty(spark):
    assert surplus_deliveries(spark.createDataFrame([], LOG)).count() == 0


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/change_log.parquet")
    assert {r[0] for r in surplus_deliveries(df).collect()} == brute.surplus(dicts(df))


def test_new_against_stored(spark):
    schema = "key string, at int, note string"
    stored = spark.createDataFrame([("a", 5, "old"), ("b", 5, "old"), ("c", 5, "old"), (None, 1, "old")], schema)
    new = spark.createDataFrame([("a", 5, "late copy"), ("b", 3, "earlier"), ("b", 4, "copy"), ("d", 1, "new"), ("d", 1, "new"), (None, 1, "new")], schema)
    won = newly_delivered(new, stored, ["key"], ["at"])
    assert sorted(map(tuple, won.collect()), key=str) == [("b", 3, "earlier"), ("d", 1, "new"), (None, 1, "new")]
    kept = stored_once(stored.unionByName(won), ["key"], ["at"])
    assert sorted((r.key, r.at) for r in kept.where("key is not null").collect()) == [("a", 5), ("b", 3), ("c", 5), ("d", 1)]
    assert kept.where("key is null").count() == 2
    assert newly_delivered(new.limit(0), stored, ["key"], ["at"]).count() == 0
    assert newly_delivered(new, None, ["key"], ["at"]).count() == newly_delivered(new, stored.limit(0), ["key"], ["at"]).count() == 4


def test_stream_keeps_one_copy_however_late(spark, tmp_path):
    """Copies days apart in different batches; a batch that is written twice changes nothing."""
    schema = "key string, at timestamp"
    for n, rows in enumerate([[("a", "2024-01-05"), ("b", "2024-01-05")], [("a", "2024-03-01"), ("c", "2024-03-01")], [("b", "2024-01-01"), ("c", "2024-03-01")]]):
        spark.createDataFrame(rows, "key string, at string").select("key", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    run = lambda: streams.store_once(streams.stream_table(spark, str(tmp_path / "in/*"), spark.read.schema(schema).parquet(str(tmp_path / "in/0")).schema, 1), str(tmp_path / "store"), str(tmp_path / "cp"), ["key"], ["at"]).awaitTermination()
    run()
    run()
    kept = streams.read_once(spark, str(tmp_path / "store"), ["key"], ["at"])
    assert sorted((r.key, str(r.at)[:10]) for r in kept.collect()) == [("a", "2024-01-05"), ("b", "2024-01-01"), ("c", "2024-03-01")]
