"""Applying a stream of inserts, updates and deletes: the rows as they stand at the end.

The log is read as append-only files with sequence numbers.  Inserts and
deletes stand apart; an insert is dropped by an anti-join if a later delete
names its key, the first one left is the row's birth, and updates after it set
columns.  Nothing is replayed in order, so nothing has to be gathered by key:
each step is a join or a map-side combining maximum.

Updates that change the key are deletes of one key and inserts of another, but
only if the old key is live and the new one is not.  That is settled first, for
the few keys such updates touch: in rounds while they settle most of the moves,
then, what hangs on long chains, in one pass in order.

Lists of columns are few and long, so events carry their number and meet the
lists again at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import joined_key, with_key_parts
from ..functions.position import score
from ..model import plain_text
from ..storage import written
from .dedup import surplus_deliveries

_ID = ["stream_id", "dml_table"]
_KEY = [*_ID, "row_key"]
#: Lists of columns that are sent to every executor; more of them are joined by a shuffle.
BROADCAST_LISTS = 100_000
_ROWS = 2147483648


def _sequence(at: Column, row_no: Column) -> Column:
    """One number that orders changes by score, then row; exact, and of a type that hash aggregation can hold."""
    return (at.cast("decimal(20,0)") * F.lit(_ROWS).cast("decimal(10,0)") + row_no.cast("decimal(10,0)")).cast("decimal(32,0)")


def accepted_events(changes: DataFrame) -> DataFrame:
    """Each change once, without those that are refused: stream_id, dml_table, row_key, new_key, score, seq, list_no and kind.

    kind is insert, update, delete or, of an update that moves its row to
    another key (``new_key``), move; ``list_no`` is the hash of the list of
    columns.  Refused are kinds other than insert, update and delete in lower
    case, differing numbers of names and values (of columns or old keys),
    updates and deletes without old keys, and changes whose position is
    unreadable or whose key cannot be read (a key column missing or NULL).
    Of a name listed twice the first holds.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    kind = F.col("dml_kind")
    fits = kind.isin("insert", "update", "delete") & (size("column_names") == size("column_values")) & (size("old_key_names") == size("old_key_values")) & ((kind == "insert") | (size("old_key_names") > 0))
    # The surplus is found on slim rows; a refused copy stands for its change like any other.
    slim = changes.where(fits).where("stream_id is not null and row_no is not null and dml_table is not null").select("delivery_id", *_ID, "change_position", "row_no", "dml_kind", "column_names", "column_values", "old_key_names", "old_key_values")
    keyed = with_key_parts(slim, plain_text, {"own": ("column_names", "column_values"), "old": ("old_key_names", "old_key_values")})
    # An update moves its row to the key that it lists; parts that it does not list stay.
    new = F.zip_with("key_own", "key_old", lambda own, old: F.coalesce(own, old))
    lists_part = F.size(F.array_compact("key_own")) > 0
    event = keyed.select(
        "delivery_id", *_ID, score(F.col("change_position")).alias("score"), "row_no", kind.alias("kind"),
        joined_key(F.when(kind == "insert", F.col("key_own")).otherwise(F.col("key_old"))).alias("row_key"),
        F.when((kind == "update") & lists_part, joined_key(new)).alias("new_key"),
        F.xxhash64("column_names").alias("list_no"),
    ).where("score is not null and row_key is not null")
    once = event.join(surplus_deliveries(changes), "delivery_id", "left_anti")
    moves = F.col("new_key") != F.col("row_key")
    return once.select(*_KEY, F.when(moves, F.col("new_key")).alias("new_key"), "score", _sequence(F.col("score"), F.col("row_no")).alias("seq"), "list_no", F.when(moves, "move").otherwise(F.col("kind")).alias("kind"))


def column_lists(changes: DataFrame) -> DataFrame:
    """list_no and names of every distinct list of columns.  Two lists with one number would be an error."""
    lists = written(changes.select("column_names").where("column_names is not null").distinct().select(F.xxhash64("column_names").alias("list_no"), F.array_distinct("column_names").alias("names")), "lists")
    n, numbers = lists.agg(F.count("*"), F.countDistinct("list_no")).first()
    if n != numbers:
        raise ValueError("two lists of columns have the same number")
    return F.broadcast(lists) if n <= BROADCAST_LISTS else lists


def _settled_moves(touches: DataFrame) -> DataFrame:
    """The touches, with ``works`` for the moves that succeed.

    ``touches`` has, for each key that a move touches, its inserts, deletes
    and the moves from (``out``) and to (``in``) it.  A move is settled once
    the state of both keys before it is known; each round settles at least the
    first open move of every stream, in practice all whose earlier moves are
    settled.  Rounds go on while each leaves at most half of the open moves;
    the rest hang on long chains (a key that is moved from and to very often)
    and are settled in order.
    """
    order = Window.partitionBy(*_KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    is_move = F.col("kind").isin("in", "out")
    now = touches.withColumn("works", F.lit(None).cast("boolean"))
    open_moves = None
    while True:
        effect = (
            F.when(F.col("kind") == "insert", "live").when(F.col("kind") == "delete", "dead")
            .when(is_move & F.col("works").isNull(), "open")
            .when(is_move & F.col("works"), F.when(F.col("kind") == "in", "live").otherwise("dead"))
        )
        seen = now.withColumn("before", F.coalesce(F.last(effect, ignorenulls=True).over(order), F.lit("dead")))
        sides = seen.where(is_move & F.col("works").isNull()).groupBy(*_ID, "seq").agg(F.max(F.when(F.col("kind") == "out", F.col("before"))).alias("source"), F.max(F.when(F.col("kind") == "in", F.col("before"))).alias("target"))
        verdict = F.when((F.col("source") == "dead") | (F.col("target") == "live"), False).when((F.col("source") == "live") & (F.col("target") == "dead"), True)
        decided = sides.select(*_ID, "seq", verdict.alias("verdict")).where("verdict is not null")
        now = written(now.join(decided, [*_ID, "seq"], "left").withColumn("works", F.coalesce("works", F.when(is_move, F.col("verdict")))).drop("verdict"), "moves")
        left = now.where(is_move & F.col("works").isNull()).count()
        if not left:
            return now
        if open_moves is not None and left * 2 > open_moves:
            return written(_settled_in_order(now), "moves")
        open_moves = left


def _settled_in_order(touches: DataFrame) -> DataFrame:
    """The touches with every open move settled, by one pass over each table's touches of the keys that open moves touch.

    Rows come sorted, so of a table only the live ones of those keys are held.
    """
    is_open = F.col("kind").isin("in", "out") & F.col("works").isNull()
    keys = touches.where(is_open).select(*_KEY).distinct()
    rest = touches.join(keys, _KEY, "left_semi").repartition(*_ID).sortWithinPartitions(*_ID, "seq")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at, verdict, live = None, None, False, set()
        for batch in batches:
            works = []
            columns = [batch.column(c).to_pylist() for c in (*_ID, "seq", "row_key", "kind", "other", "works")]
            for stream, name, seq, key, kind, other, done in zip(*columns):
                if (stream, name) != table:
                    table, at, live = (stream, name), None, set()
                if done is None and kind in ("in", "out"):
                    # The two sides of a move stand together and are settled at the first.
                    if seq != at:
                        source, target = (key, other) if kind == "out" else (other, key)
                        at, verdict = seq, source in live and target not in live
                    done = verdict
                works.append(done)
                if kind == "insert" or kind == "in" and done:
                    live.add(key)
                elif kind == "delete" or kind == "out" and done:
                    live.discard(key)
            yield batch.set_column(batch.schema.get_field_index("works"), "works", pa.array(works, pa.bool_()))

    return touches.join(keys, _KEY, "left_anti").unionByName(rest.mapInArrow(settle, rest.schema))


def _moved_cells(events: DataFrame, moves: DataFrame, touched: DataFrame, lists: DataFrame) -> DataFrame:
    """Cells of the live rows whose key some move touches."""
    there = events.join(touched, _KEY, "left_semi")
    what = ["seq", "score", "list_no"]
    plain = there.where("kind in ('insert', 'delete')").select(*_KEY, *what, "kind", F.lit(None).cast("string").alias("other"))
    out = moves.select(*_KEY, *what, F.lit("out").alias("kind"), F.col("new_key").alias("other"))
    into = moves.select(*_ID, F.col("new_key").alias("row_key"), *what, F.lit("in").alias("kind"), F.col("row_key").alias("other"))
    settled = _settled_moves(plain.unionByName(out).unionByName(into))
    updates = there.where("kind = 'update'").select(*_KEY, *what, "kind", F.lit(None).cast("string").alias("other"), F.lit(None).cast("boolean").alias("works"))
    order = Window.partitionBy(*_KEY).orderBy("seq")
    effect = F.when(F.col("kind") == "insert", "live").when(F.col("kind") == "delete", "dead").when(F.col("works") & (F.col("kind") == "in"), "live").when(F.col("works") & (F.col("kind") == "out"), "dead")
    seen = settled.unionByName(updates).withColumn("effect", effect).withColumn("before", F.coalesce(F.last("effect", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit("dead")))
    born = (F.col("effect") == "live") & (F.col("before") == "dead")
    lives = seen.withColumn("birth", F.last(F.when(born, F.col("seq")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # What belongs to a life: its birth, updates while live, and its end.
    inside = lives.where(born | ((F.col("kind") == "update") & (F.col("before") == "live")) | ((F.col("effect") == "dead") & (F.col("before") == "live")))
    inside = written(inside.select(*_KEY, "birth", *what, "kind", "other"), "lives")
    ends = inside.where("kind in ('delete', 'out')").select(*_KEY, "birth", F.when(F.col("kind") == "out", F.col("other")).alias("next_key"), F.when(F.col("kind") == "out", F.col("seq")).alias("next_birth"), F.lit(True).alias("ended"))
    chain = inside.where("kind in ('insert', 'in')").select(*_KEY, "birth").join(ends, [*_KEY, "birth"], "left").select(*_KEY, "birth", "next_key", "next_birth", (F.col("ended").isNull()).alias("alive"), F.col("row_key").alias("last_key"))
    # Follow the moves to the last life of each row, twice as far every round.
    chain = written(chain, "chain")
    while not chain.where("next_key is not null").isEmpty():
        step = chain.select(*_ID, F.col("row_key").alias("next_key"), F.col("birth").alias("next_birth"), F.col("next_key").alias("far_key"), F.col("next_birth").alias("far_birth"), F.col("alive").alias("far_alive"), F.col("last_key").alias("far_last"))
        goes_on = F.col("next_key").isNotNull()
        chain = written(
            chain.join(step, [*_ID, "next_key", "next_birth"], "left").select(
                *_KEY, "birth", F.col("far_key").alias("next_key"), F.col("far_birth").alias("next_birth"),
                F.when(goes_on, F.coalesce("far_alive", F.lit(False))).otherwise(F.col("alive")).alias("alive"), F.when(goes_on, F.col("far_last")).otherwise(F.col("last_key")).alias("last_key"),
            ),
            "chain",
        )
    last = chain.where("alive").select(*_KEY, "birth", "last_key")
    setting = inside.where("kind in ('insert', 'in', 'update')").join(last, [*_KEY, "birth"])
    return _spread(setting.select(*_ID, F.col("last_key").alias("row_key"), "list_no", "score"), lists)


def _spread(setting: DataFrame, lists: DataFrame) -> DataFrame:
    """The last score at which each column of each row is set."""
    cells = setting.join(lists, "list_no").select(*_KEY, F.explode("names").alias("column_name"), "score").where("column_name is not null")
    return cells.groupBy(*_KEY, "column_name").agg(F.max("score").alias("set_score"))


def current_cells(changes: DataFrame) -> DataFrame:
    """stream_id, dml_table, row_key, column_name, set_score of every column of every live row.

    Defined cases: an empty log has no rows; copies of a change count once; a
    row whose insert lists no columns beside the key has the key columns; an
    update of a row that is not live does nothing.
    """
    lists = column_lists(changes)
    events = written(accepted_events(changes), "events", by="kind")
    inserts, deletes, updates, moves = (events.where(F.col("kind") == k) for k in ("insert", "delete", "update", "move"))
    touched = moves.select(*_KEY).unionByName(moves.select(*_ID, F.col("new_key").alias("row_key"))).distinct()
    # Inserts against later deletes of the same key; the first left is the birth.
    last_delete = deletes.groupBy(*_KEY).agg(F.max("seq").alias("deleted"))
    births = inserts.join(last_delete, (_same(inserts, last_delete)) & (F.col("deleted") > F.col("seq")), "left_anti")
    births = births.groupBy(*_KEY).agg(F.min("seq").alias("born"), F.min("score").alias("score"), F.min_by("list_no", "seq").alias("list_no"))
    some_move = not moves.isEmpty()
    if some_move:
        births = births.join(touched, _KEY, "left_anti")
    # Of updates that list the same columns only the last can count, so a key has at most as many as there are lists.
    latest = updates.groupBy(*_KEY, "list_no").agg(F.max("seq").alias("seq"), F.max("score").alias("score"))
    by_key = latest.groupBy(*_KEY).agg(F.collect_list(F.struct("seq", "score", "list_no")).alias("later"))
    none = F.array().cast("array<struct<seq:decimal(32,0),score:bigint,list_no:bigint>>")
    sets = F.concat(F.array(F.struct(F.col("born").alias("seq"), "score", "list_no")), F.coalesce("later", none))
    setting = births.join(by_key, _KEY, "left").select(*_KEY, "born", F.explode(sets).alias("set")).where("set.seq >= born").select(*_KEY, "set.list_no", "set.score")
    cells = _spread(setting, lists)
    return cells.unionByName(_moved_cells(events, moves, touched, lists)) if some_move else cells


def _same(left: DataFrame, right: DataFrame) -> Column:
    made = F.lit(True)
    for c in _KEY:
        made = made & (left[c] == right[c])
    return made
