"""Routing rows to tasks: the engine's own exchange is Spark's shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.errors import SqlError


#: Rows that are sent to every task at most.
BROADCAST = 1_000_000


def exchange(df: DataFrame, rule: str, consumers: int = 1, key: str | None = None) -> DataFrame:
    """gather (one task), round_robin, hash (on ``key``, so equal keys meet) or broadcast (a hint for the next join, if there
    are at most BROADCAST rows; beyond, that join shuffles)."""
    if rule == "gather":
        return df.coalesce(1)
    if rule == "round_robin":
        return df.repartition(consumers)
    if rule == "hash":
        if key is None:
            raise SqlError("hash routing needs a key")
        return df.repartition(consumers, key)
    if rule == "broadcast":
        return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df
    raise SqlError(f"unknown routing rule {rule}")
