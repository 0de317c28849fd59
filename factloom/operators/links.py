"""Connected components of large graphs by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.commits import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component for edges(a, b): the smallest node that a node is joined to; nodes without an edge to another are their own.

    In turn, each node passes its larger neighbours on to the smallest one it knows, then the smaller ones, until
    nothing changes: in some log n rounds the graph is one of stars, without any hub's edges in one task beyond
    what an aggregation and a join need.  Nulls are no nodes.
    """
    given = edges.select("a", "b").where("a is not null and b is not null")
    nodes = given.select(F.col("a").alias("node")).unionByName(given.select(F.col("b").alias("node"))).distinct()
    # (u, v) with u > v
    now = written(given.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = print_of(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = print_of(now)
        if after == before:
            return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = after
    raise RuntimeError(f"no end after {most_rounds} rounds")
