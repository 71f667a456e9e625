"""Connected components of an edge table by alternating star contraction.

Every round joins edges with each vertex's smallest neighbour: the large star
links a vertex's larger neighbours to that minimum, the small star its smaller
ones.  The rounds stop when the edges no longer change; their number grows with
the logarithm of the components' size.  Edges are checkpointed every round, so
lineage stays short, and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


#: Edges above so many get their minima stored, so that both sides of a join are dealt anew and a hot vertex can be split.
MANY = 1_000_000
#: Edges up to so many make one partition, as adaptive execution would, so that a round needs no shuffle.
TINY = 1_000


def _star(edges: DataFrame, many: bool = False) -> DataFrame:
    """One large star and one small star over edges ``(a, b)`` with ``a < b``."""
    kept = checkpointed if many else lambda x: x
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m")))
    # an edge's larger end goes to the smallest neighbour of its smaller end
    large = edges.join(least, edges["a"] == least["v"]).select(F.col("m").alias("a"), "b").where("a < b").distinct()
    large = kept(large)
    lower = kept(large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "v"))
    small = large.join(lower, large["b"] == lower["v"])
    return small.select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("a").alias("y")), F.struct(F.col("m").alias("x"), F.col("b").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a < b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every vertex of ``edges(a, b)`` that isn't its component's least."""
    now = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        if not mark[0]:
            break
        now = checkpointed(_star(now.coalesce(1) if mark[0] <= TINY else now, mark[0] > MANY))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
