"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.storage import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): every node of an edge, and the smallest node that it reaches.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until no
    edge changes; each round is written to the shared folder.  Hubs never gather
    in a task: minima are aggregates, and joins on them may be split.
    """
    undirected = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = scratch.keep(undirected, "edges")
    size, mark = _mark(current)
    while size:
        # Large star: neighbours above a node link to its smallest neighbour.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below a node, and it, link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.keep(small, "edges")
        now, sign = _mark(nxt)
        scratch.drop(current)
        current = nxt
        if (now, sign) == (size, mark):
            break
        size, mark = now, sign
    roots = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple[int, object]:
    n, sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, sign
