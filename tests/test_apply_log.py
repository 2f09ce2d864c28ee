import random

import brute
from fixtures import LOG, change, dicts, log

from changeweave.operators.apply_log import current_cells


def got(spark, rows):
    found = current_cells(log(spark, rows)).collect()
    assert len(found) == len({tuple(r)[:4] for r in found})
    return {tuple(r)[:4]: r[4] for r in found}


def test_partial_updates_and_second_life(spark):
    rows = [
        change(1, "0/1", "insert", {"id": "a", "x": 1}), change(2, "0/2", "update", {"x": 2}, {"id": "a"}), change(3, "0/3", "insert", {"id": "a", "y": 1}), change(4, "0/4", "delete", {}, {"id": "a"}),
        change(5, "0/5", "update", {"x": 3}, {"id": "a"}), change(6, "0/6", "insert", {"id": "a", "z": 1}), change(7, "0/7", "Update", {"z": 1}, {"id": "a"}), change(8, "0/8", "update", {"z": 1}), change(9, "0/6", "insert", {"id": "a", "z": 1}, at=5),
    ]
    assert got(spark, rows) == {("s", "public.tasks", "a", "id"): 6, ("s", "public.tasks", "a", "z"): 6}


def test_moves(spark):
    rows = [
        change(1, "0/1", "insert", {"id": "a", "x": 1}), change(2, "0/2", "insert", {"id": "b", "x": 1}), change(3, "0/3", "update", {"id": "b", "x": 2}, {"id": "a"}), change(4, "0/4", "update", {"id": "c", "x": 2}, {"id": "a"}),
        change(5, "0/5", "update", {"id": "a"}, {"id": "b"}), change(6, "0/6", "update", {"y": 1}, {"id": "c"}), change(7, "0/7", "update", {"id": "d"}, {"id": "c"}), change(8, "0/8", "update", {"id": "z"}, {"id": "q"}),
    ]
    wanted = {("s", "public.tasks", k, c): v for k, c, v in [("d", "id", 7), ("d", "x", 4), ("d", "y", 6), ("a", "id", 5), ("a", "x", 2)]}
    assert got(spark, rows) == wanted


def test_long_chains_of_moves(spark):
    """One key that is moved from and to 4000 times, some of them in vain, each hanging on the one before."""
    rng = random.Random(11)
    rows = [change(1, "0/1", "insert", {"id": "hot", "x": 1}), change(2, "0/2", "insert", {"id": "k1", "x": 1})]
    for n in range(3, 4003):
        one, two = ("hot", f"k{rng.randrange(4)}")[:: rng.choice((1, -1))]
        rows.append(change(n, f"0/{n:X}", "update", {"id": two, "y": n}, {"id": one}))
    df = log(spark, rows)
    assert got(spark, rows) == brute.replay(dicts(df))


def test_random_logs_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for n in range(1, 900):
        kind = rng.choice(["insert"] * 3 + ["update"] * 5 + ["delete"] + ["merge"])
        k, stream = rng.choice("abcdef"), rng.choice("st")
        cells = {c: rng.randrange(9) for c in rng.sample("xyz", rng.randrange(0, 3))}
        old = None if kind == "insert" or rng.random() < 0.05 else {"id": k}
        if kind == "insert" or kind == "update" and rng.random() < 0.35:
            cells = {"id": k if kind == "insert" else rng.choice("abcdef"), **cells}
        rows.append(change(n, f"0/{rng.randrange(1, 800):X}", kind, cells, old, stream=stream, row_no=rng.randrange(2), at=rng.randrange(60)))
    df = log(spark, rows)
    assert got(spark, rows) == brute.replay(dicts(df))


def test_nulls_and_empty(spark):
    assert current_cells(spark.createDataFrame([], LOG)).count() == 0
    rows = [change(1, None, "insert", {"id": "a"}), change(2, "0/1", None, {"id": "a"}), change(3, "0/2", "insert", {"id": None, "x": 1}), change(4, "0/3", "insert", {"id": "a"}, table=None), change(5, "0/4", "insert", {"x": 1})]
    assert got(spark, rows) == {}


def test_real_log(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/change_log.parquet")
    assert {tuple(r)[:4]: r[4] for r in current_cells(df).collect()} == brute.replay(dicts(df))
