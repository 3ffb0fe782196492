"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import drop, keep


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that an edge touches; root is the component's smallest node.

    edges: two columns of one ordered type; loops, repeats, nulls and either direction are fine.
    Each step is a grouped minimum (combined before the shuffle, so a hub costs no task more
    than others) and an equi-join that adaptive execution may split. Each step's edges are
    written to the shared folder; the loop ends when a step changes nothing. Only two numbers
    for each step reach the driver.
    """
    now, path = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_m.select("u", F.col("m").alias("v"))).distinct()
        after, after_path = keep(small, "edges")
        after_mark = _mark(after)
        drop(edges.sparkSession, path)
        now, path, same, mark = after, after_path, after_mark == mark, after_mark
        if same:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free digest of the edges."""
    n, s = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return n, int(s or 0)
