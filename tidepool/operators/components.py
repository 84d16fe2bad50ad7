"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.plans.lineage import cut, release

#: A node of many links is spread over this many keys when its links meet its label.
SALTS = 16


def salted_join(many: DataFrame, one: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows to the single row of their key; a key's rows are dealt out by ``spread``."""
    left = many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours linked to the smallest of its neighbours and itself."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return salted_join(both.filter("v > u"), least, ["u"], "v").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours linked to the smallest of these; after a large star, a node has few."""
    few = links.distinct()
    least = few.groupBy("hi").agg(F.min("lo").alias("m"))
    others = few.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return others.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def tidy(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links as distinct (hi, lo), without those of a node to itself or to nothing."""
    return links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: every node is linked once, to a node that is linked to none."""
    nodes = links.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
    roots = links.select(F.col("lo").alias("hi")).distinct()
    return not nodes.join(roots.withColumn("root", F.lit(True)), "hi", "left").filter("n > 1 OR root").take(1)


def components(links: DataFrame, a: str = "a", b: str = "b", most_steps: int = 60) -> DataFrame:
    """(node, component) of every node that has a link to another; a component is its smallest node.

    Null ends and links of a node to itself count for nothing.  The number of
    steps grows with the logarithm of the largest component.
    """
    # The links may be costly to make, and each step reads them several times.
    given = cut(tidy(links, a, b))
    current = cut(small_star(large_star(given)))
    release(given)
    for _ in range(most_steps):
        if _settled(current):
            break
        before, current = current, cut(small_star(large_star(current)))
        release(before)
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(current.select("lo", "lo").distinct())
