"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import cut, drop


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every linked id: root is the least id of its component.

    Large-star and small-star steps alternate until no link changes. A step is an aggregate and a join; the aggregate's
    rows are dealt anew before the join, so that its partitions can be split where one id has very many links.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, before = cut(e, "links"), None
    while True:
        old, e = e, cut(_small_star(_large_star(e)), "links")
        drop(old)  # each round reads the one before it alone
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Each neighbour above u is linked to u's least neighbour (or u)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least.repartition(F.col("m"), F.col("u")), "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each lower neighbour of u, and u, are linked to u's least neighbour."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    out = e.join(least.repartition(F.col("m"), F.col("u")), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
