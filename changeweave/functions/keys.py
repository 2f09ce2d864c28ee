"""Keys of rows whose columns travel as parallel arrays of names and cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Key columns of tables whose key is not ``id``.
KEYS = {"user_roles": ("org_id", "user_id")}


def plain_table(name: Column) -> Column:
    """A table's name without the schema ``public``."""
    return F.regexp_replace(name, r"^public\.", "")


def with_key_parts(rows: DataFrame, text_of: Callable[[Column], Column], lists: dict[str, tuple[str, str]], table: str = "dml_table", keys: dict[str, tuple[str, ...]] = KEYS) -> DataFrame:
    """Add an array ``key_<name>`` for each of the ``lists`` (columns with names and values): the texts of the row's key columns.

    A part is NULL if its column is not listed or its cell is NULL; of a name
    listed twice the first counts.  Places, cells and texts are columns of
    their own, one projection after the other, so that each is computed once.
    """
    width = max(1, *[len(k) for k in keys.values()])

    def at_part(i: int, default) -> Column:
        made = F.lit(default)
        for name, columns in keys.items():
            made = F.when(F.col(table).isin(name, f"public.{name}"), F.lit(columns[i] if i < len(columns) else None)).otherwise(made)
        return made

    parts = range(width)
    kept = [F.col(f"`{c}`") for c in rows.columns]
    names = rows.select(*kept, *[at_part(i, "id" if i == 0 else None).alias(f"__part_{i}") for i in parts])
    places = names.select("*", *[F.array_position(n, F.col(f"__part_{i}")).alias(f"__place_{k}_{i}") for k, (n, _) in lists.items() for i in parts])
    cells = places.select("*", *[F.when(F.col(f"__place_{k}_{i}") > 0, F.get(v, F.col(f"__place_{k}_{i}").cast("int") - 1)).alias(f"__cell_{k}_{i}") for k, (_, v) in lists.items() for i in parts])
    texts = cells.select(*kept, *[f"__part_{i}" for i in parts], *[text_of(F.col(f"__cell_{k}_{i}")).alias(f"__text_{k}_{i}") for k in lists for i in parts])
    wanted = F.size(F.array_compact(F.array(*[F.col(f"__part_{i}") for i in parts])))
    return texts.select(*kept, *[F.slice(F.array(*[F.col(f"__text_{k}_{i}") for i in parts]), F.lit(1), wanted).alias(f"key_{k}") for k in lists])


def joined_key(parts: Column) -> Column:
    """The key as one text, its parts joined by a bar; NULL if a part is NULL."""
    return F.when(F.size(F.array_compact(parts)) == F.size(parts), F.array_join(parts, "|"))
