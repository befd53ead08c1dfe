"""Connected components of a large, sparse graph, by contraction.

In each round every node hooks on to the neighbour (or itself) with the
smallest random rank of that round; chains of hooks are shortened twice; the
edges are rewritten to the nodes hooked on to, and edges inside one node
vanish.  Each round leaves a fraction of the nodes, so the number of rounds
grows with the logarithm of the largest component.  The rounds' maps are then
joined back, the smallest first.  Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def follow(rows: DataFrame, key: str, to: DataFrame) -> DataFrame:
    """``rows`` with column ``key`` replaced by ``to``'s ``root`` of that node,
    where it has one.  ``to`` has one row per node.  Many rows may share a key:
    both sides reach the join straight from a shuffle, so adaptive execution
    splits the rows of such a key over several tasks."""
    joined = rows.join(to.select(F.col("node").alias(key), F.col("root").alias("_root")), key, "left")
    return joined.select(*[F.coalesce("_root", key).alias(key) if c == key else c for c in rows.columns])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node in ``edges`` (long columns ``a``, ``b``):
    nodes share a root exactly if edges connect them."""
    spark = edges.sparkSession
    edges = table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .distinct(), "edges")
    maps = []
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("r"), F.col(c).alias("to"))  # noqa: B023, E731
        hooks = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(
            F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["to"].alias("root"))
        hooks = table(hooks, f"hooks-{k}")
        for _ in range(2):
            hooks = follow(hooks, "root", hooks)
        hooks = table(hooks, f"roots-{k}")
        maps.append(hooks)
        edges = follow(follow(edges, "a", hooks), "b", hooks).where("a <> b")
        edges = table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges-{k}")
    else:
        raise RuntimeError(f"{max_rounds} rounds did not contract the graph")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    done = maps.pop()
    while maps:
        done = table(follow(maps.pop(), "root", done), "roots").select("node", "root")
    return done
