"""Connected components of an edge table by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) bigint to (node, root): root is the least node of its component. Nodes without an edge are absent.

    Each round hangs neighbours on the least node nearby; the minimum is taken with partial aggregation, so a hub costs
    one row a task. Lineage is cut in each round by a table in the shared folder. Nulls and self-loops are left out;
    an empty table gives an empty table.
    """
    now = materialise(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every neighbour above u hangs on the least node around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lower neighbours hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = materialise(small.select("e.lo", "e.hi").where("lo <> hi").distinct())
        was, mark = mark, _mark(now)
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    return r[0], r[1]
