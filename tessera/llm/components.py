"""Connected components by alternating large-star and small-star.

Every round is two grouped minima and two joins over edges; no node's neighbours are ever gathered. A node with very many
neighbours is a hot join key, which adaptive execution splits; its minimum is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut_lineage

EDGES_PER_TASK = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for each node of an edge; edges are undirected, loops are ignored.

    Repeated edges do no harm; no edges give no rows; edges with a null end are ignored.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, was = cut_lineage(e), None
    tasks = max(8, e.count() // EDGES_PER_TASK)  # the same number of edges a task at every size
    e = e.coalesce(tasks)
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))")).first()
        if now == was or not now[0]:
            break
        was = now
        # Large star: what is greater than x moves to the least of x and its neighbours.
        least = e.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        least = least.unionAll(e.select(F.col("v").alias("x"), F.col("v").alias("m")).distinct()).groupBy("x").agg(F.min("m").alias("m"))
        large = e.join(least, e.v == least.x).select("u", F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        # Small star: a node and its smaller neighbours move to the least of these.
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        moved = large.join(least, large.u == least.x).select("u", "v", "m").coalesce(tasks)
        e = cut_lineage(moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(moved.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
