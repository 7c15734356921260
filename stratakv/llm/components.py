"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import discard, written

def _large(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself); and those smallest ones.

    These are written before links meet them: of two plain inputs Spark broadcasts the smaller if its size allows
    it, and splits a node that many links share otherwise.
    """
    sym = e.union(e.select("v", "u")).toDF("u", "v")
    low = written(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), low


def _small(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour.

    After a large step a node has few smaller neighbours.
    """
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low).toDF("u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in the two columns of edges.

    Self-links add nothing but their id; repeated links count once. Each round is written to the shared
    folder; rounds stop when the links no longer change, which is when all of them end in a root.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = written(e, "links")
    state = None
    while True:
        before, (more, low) = e, _large(e)
        e = written(_small(more), "links")
        discard(before, low)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    roots = e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def joined(stars: DataFrame, links: DataFrame) -> DataFrame:
    """id, component after more links (two columns) between ids: only the roots that they touch are linked again."""
    a, b = links.columns
    of = stars.select("id", "component")
    at = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    for c in ("u", "v"):
        at = at.join(of.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    roots = written(components(at.select("u", "v")).select(F.col("id").alias("component"), F.col("component").alias("to")), "roots")
    known = stars.join(roots, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    new = roots.select(F.col("component").alias("id"), F.col("to").alias("component")).join(stars.select("id"), "id", "left_anti")
    return known.union(new)
