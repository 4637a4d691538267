"""Connected components of a graph given as edges, by alternating star contraction in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import materialize


#: Keys of over total / HOT_SHARE rows (and over HOT_LEAST) meet their value by broadcast: there can be HOT_SHARE of them at most.
HOT_SHARE, HOT_LEAST = 1000, 1000


def with_value(rows: DataFrame, key: str, values: DataFrame, total: int) -> DataFrame:
    """`rows` with the value of their key from `values` (key, n, value), where n is how many rows have the key, of `total` in all.

    Rows of a key that very many have aren't shuffled; the others meet their value in one shuffle.
    """
    hot = max(HOT_LEAST, total // HOT_SHARE)
    common = F.broadcast(values.filter(F.col("n") > hot).select(F.col("key").alias("hot_key"), F.struct("value").alias("hot")))
    first = rows.join(common, F.col(key) == F.col("hot_key"), "left")
    done = first.filter(F.col("hot").isNotNull()).select(*rows.columns, F.col("hot")["value"].alias("value"))
    rest = first.filter(F.col("hot").isNull()).join(values.filter(F.col("n") <= hot).drop("n"), F.col(key) == F.col("key")).select(*rows.columns, "value")
    return done.unionByName(rest)


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link every larger (or else every smaller) neighbour of u, and u itself, to the smallest node u knows."""
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        ways = ways.filter("u > v")
    least = ways.groupBy(F.col("u").alias("key")).agg(F.least(F.min("v"), F.first("u")).alias("value"), F.count("*").alias("n"))  # combined before the shuffle
    near = with_value(ways, "u", least, total)
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("value").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("value").alias("v")).unionByName(near.select("u", F.col("value").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of an edge (u, v) with the smallest node it is connected to. Nulls have no edges.

    Rounds go on until nothing changes: about the logarithm of the longest path. Each half is written to the shared
    folder, so that lineage stays short and a lost executor costs one of them at most.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
        if not seen["n"]:
            break
        now = materialize(_star(materialize(_star(now, True, 2 * seen["n"]), "stars"), False, 2 * seen["n"]), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
