"""Connected components of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paraweft.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Label every node of ``links (a, b)`` with the smallest node it is connected to.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    step rewires every node to the smallest of its neighbours, so the links
    shrink to stars in a number of steps that grows with the logarithm of the
    longest path. A step is grouped minima joined back to the links; a node with
    very many links is pre-aggregated and its join can be split. Each step's
    links are written to the shared folder; nothing goes to the driver but a count.

    Null ends and self links are ignored. Returns ``(node, root)``; empty for no links.
    """
    edges = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    step, before = 0, None
    while True:
        # large star: the larger neighbours of each node go to the smallest one around it
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every link now leads from a larger node to a smaller one; small star: join those below a node
        large = scratch.write(large.distinct(), f"{name}-{step}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.write(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{step}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step}-large", *([f"{name}-{step - 1}"] if step else []))
        if now == before:
            break
        step, before = step + 1, now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
