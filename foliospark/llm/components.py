"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, cut, matched, sized


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, comp (the least node that it reaches), for the nodes of the edges.

    Every star keeps each component connected and moves its edges towards its least node; edges only meet group minima, so no
    task ever holds a component. Each round is cut into the checkpoint folder. Self loops and repeated edges are harmless.
    """

    def large(e: DataFrame, n: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return sized(both.join(matched(least, 2 * n, ROWS), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), 2 * n).distinct()

    def small(e: DataFrame, n: int) -> DataFrame:
        down = sized(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b"), n)
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(matched(least, n, ROWS), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return sized(out.where("a <> b"), 2 * n).distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        return r["n"], r["s"]

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = mark(now)
    while seen[0]:
        now = cut(small(large(now, seen[0]), seen[0]), seen[0])
        if (new := mark(now)) == seen:
            break
        seen = new
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
