"""Connected components over an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import store


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root), root the least node reachable; only nodes that have an edge.

    Each round halves distances, so chains of any length end in a logarithmic number of rounds. Minima are
    aggregated before the shuffle and joined back, so a node with very many neighbours is no single task's
    work. Every round's edges are a written table. No edges, or only null or looped ones: no rows.
    """
    e = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).unionAll(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("n").agg(F.least(F.min("x"), F.first("n")).alias("m"))
        large = both.where("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = store(small, "edges")
        before, mark = mark, _mark(e)
        if before == mark:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
