"""All queries outside of the subpackage for texts."""

from __future__ import annotations

from . import data_quality, replication

_PARTS = [data_quality, replication]
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in _PARTS for k, v in part.SQL.items()}
