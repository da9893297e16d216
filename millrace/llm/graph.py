"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tables

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(vertex, label) for every vertex of the links (a, b): ``label`` is the smallest vertex that it reaches.

    Each round hangs the larger neighbours of a vertex under its smallest neighbour and then, in the trees made so, all
    smaller neighbours too, until nothing changes: a few rounds even for long chains. The links of a round are written to
    the shared folder. A vertex with very many links is met by aggregates combined before the shuffle and by joins that
    split skewed keys. Nulls and loops are left out.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = tables.keep(links.distinct(), "links")
    for _ in range(MOST_ROUNDS):
        if _settled(links):
            break
        links = tables.keep(_hang_smaller(_hang_larger(links)), "links")
    else:
        raise RuntimeError("components did not settle")
    leaves = links.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
    return leaves.unionByName(leaves.select(F.col("label").alias("vertex"), "label").distinct())


def _settled(links: DataFrame) -> bool:
    """Whether every vertex hangs on one other, and on none that hangs itself."""
    rows, vertices = links.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
    if rows != vertices:
        return False
    return links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def _hang_larger(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a vertex is linked with the smallest one around that vertex."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(smallest.withColumn("m", F.least("u", "m")), "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _hang_smaller(links: DataFrame) -> DataFrame:
    """A vertex and all its smaller neighbours are linked with the smallest of these."""
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(smallest.withColumnRenamed("m", "v")).distinct()
