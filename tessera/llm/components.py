"""Connected components by alternating stars, on edges alone, with lineage cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, save


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is tied to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u (larger) and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge between different nodes: root is the smallest node reachable.

    Rows with equal ends, nulls or repeats don't matter. Each round writes its edges to the shared folder;
    the number of rounds is logarithmic in the longest path.
    """
    spark = edges.sparkSession
    start = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    now, path = save(start, "cc", tidy=True)
    mark = None
    while True:
        new, new_path = save(_small_star(_large_star(now).distinct()).distinct(), "cc")
        drop(spark, path)
        now, path = new, new_path
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(seen)
