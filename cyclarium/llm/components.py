"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclarium.llm._common import cut, drop_cut, hot_join, scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour, or to itself."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return hot_join(near.where("v > u"), least, ["u"], "v", "inner").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = hot_join(down, least, ["u"], "v", "inner").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes in ``edges`` (a, b): the smallest id that can be reached.

    Each round is cut to the shared folder. Minima are summed up before they
    are shuffled, and a hub's edges are dealt into parts for the join. Self-loops,
    repeated edges and edges with a null end are ignored.
    """
    with scratch():
        return cut(_components(edges), outside=True)


def _components(edges: DataFrame) -> DataFrame:
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        done = cut(_small_star(_large_star(edges)).distinct())
        drop_cut(edges)
        now = done.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = done
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
