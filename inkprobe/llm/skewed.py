"""Joining rows to the one row of their group when a group may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, weight: str, slots: int = SLOTS) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row a ``key``, holding ``weight`` of the rows).

    A group is hot when it holds at least 1/slots of all weight; by counting, at
    most ``slots`` are, and these few rows are broadcast, so hot rows stay where
    they are. Only the others shuffle. Both tables are read twice and should be stored.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    hot = groups.filter(F.col(weight) * slots >= F.lit(total))
    settled = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    rest = others.join(groups.filter(F.col(weight) * slots < F.lit(total)), key)
    return settled.unionByName(rest.select(*settled.columns))
