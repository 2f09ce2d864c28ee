"""Messages delivered more than once: keep exactly one copy of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.position import score

RANK = "__copy_rank"
#: Ranked groups are cut into this many parts before one winner of each part is ranked again.
SALTS = 32


def rank_copies(rows: DataFrame, identity: Sequence[str], first: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Add ``__copy_rank``: 1 for the copy that stays, more for the surplus.

    Identifiers are split by their frequency, which is aggregated with
    map-side combination.  Rows of identifiers that occur once pass directly;
    only repeated groups are ranked by ``first``, in ``salts`` parts each, and
    then the parts' winners among themselves, so that no task sorts more than
    a part of one group even where a single identifier holds a third of all
    rows.  Both results are united.

    Defined cases: rows in whose identifier any column is NULL cannot be
    identified and all stay (rank 1); among rows equal in ``first`` too one
    stays, no matter which; an empty input gives an empty output.  Further
    columns, whatever their names, pass through.
    """
    identity, first = list(identity), list(first)
    known = rows.where(_all_set(identity))
    repeated = known.groupBy(*identity).count().where("count > 1").select(*identity, F.lit(True).alias("__repeated"))
    marked = known.join(repeated, identity, "left").select(*[F.col(f"`{c}`") for c in rows.columns], "__repeated")
    single = marked.where("__repeated is null").drop("__repeated").withColumn(RANK, F.lit(1))
    unknown = rows.where(~_all_set(identity)).withColumn(RANK, F.lit(1))
    return single.unionByName(_ranked(marked.where("__repeated").drop("__repeated"), identity, first, salts)).unionByName(unknown)


def surplus_copies(rows: DataFrame, identity: Sequence[str], first: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Only the surplus of ``rank_copies``: singletons are dropped before anything is ranked."""
    identity, first = list(identity), list(first)
    known = rows.where(_all_set(identity))
    repeated = known.groupBy(*identity).count().where("count > 1").select(*identity)
    return _ranked(known.join(repeated, identity, "left_semi"), identity, first, salts).where(F.col(RANK) > 1).drop(RANK)


def _all_set(columns: Sequence[str]) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & F.col(c).isNotNull()
    return found


def _ranked(rows: DataFrame, identity: list[str], first: list[str], salts: int) -> DataFrame:
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*first), F.lit(salts))).repartition(*identity, "__salt")
    part = Window.partitionBy(*identity, "__salt").orderBy(*first)
    # Losers within a part are surplus at once; they sort behind every winner.
    ranked = salted.withColumn("__part_rank", F.row_number().over(part))
    losers = ranked.where("__part_rank > 1").withColumn(RANK, F.lit(salts) + F.col("__part_rank"))
    winners = ranked.where("__part_rank = 1").withColumn(RANK, F.row_number().over(Window.partitionBy(*identity).orderBy(*first)))
    return winners.unionByName(losers).drop("__salt", "__part_rank")


def newly_delivered(new: DataFrame, stored: DataFrame | None, identity: Sequence[str], first: Sequence[str]) -> DataFrame:
    """The rows of ``new`` that are to be stored: of every identifier the copy that stays, if it comes before what is stored.

    New and stored copies are ranked together, split by frequency as in
    ``rank_copies``.  Of the stored side only the columns of ``identity`` and
    ``first`` are read, and only identifiers that the new rows have go on.  A
    stored copy that a new one comes before stays where it is; ``stored_once``
    leaves it out.  Storing the result after every batch and reading with
    ``stored_once`` gives the same rows whatever the batches and their order.

    Defined cases: rows with a NULL in their identifier are all stored; without
    new rows nothing is; ``stored`` may be None or empty.
    """
    identity, first = list(identity), list(first)
    here = new.withColumn("__new", F.lit(True))
    if stored is not None:
        ids = new.where(_all_set(identity)).select(*identity).distinct()
        rivals = stored.select(*dict.fromkeys([*identity, *first])).join(ids, identity, "left_semi").withColumn("__new", F.lit(False))
        here = here.unionByName(rivals, allowMissingColumns=True)
    # Of a new and a stored copy that are equal in ``first`` the stored one stays.
    return rank_copies(here, identity, [*first, "__new"]).where(F.col(RANK) == 1).where("__new").drop(RANK, "__new")


def stored_once(stored: DataFrame, identity: Sequence[str], first: Sequence[str]) -> DataFrame:
    """What batches of ``newly_delivered`` stored, each identifier once."""
    return rank_copies(stored, identity, first).where(F.col(RANK) == 1).drop(RANK)


#: What makes two deliveries copies (beside the score of the position), and which of them stays.
DELIVERY, EARLIEST = ("stream_id", "score", "row_no"), ("received_at", "delivery_id")


def delivered_once(changes: DataFrame) -> DataFrame:
    """The change log with one copy of every change of every stream, plus ``score``.

    Two deliveries are copies if stream, score of the position and row number
    agree; the one received first stays, then the one with the least
    delivery_id.  Deliveries whose position is unreadable stay all.
    """
    scored = changes.withColumn("score", score(F.col("change_position")))
    return rank_copies(scored, DELIVERY, EARLIEST).where(F.col(RANK) == 1).drop(RANK)


def surplus_deliveries(changes: DataFrame) -> DataFrame:
    """delivery_id of every delivery that repeats an earlier one."""
    slim = changes.select("delivery_id", "stream_id", score(F.col("change_position")).alias("score"), "row_no", "received_at")
    return surplus_copies(slim, DELIVERY, EARLIEST).select("delivery_id")
