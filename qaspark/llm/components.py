"""Connected components of links between 64-bit nodes, by alternating star contractions.

Every round is two equi-joins over the links that are left and is written to the shared folder, so lineage stays short; the
table of the round before is then removed. Minima combine before the shuffle; the links of a hub are joined with its minimum
in a form that adaptive execution splits, and never collected. The number of rounds grows with the logarithm
of the longest path, not with the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.operators.lookups import null_safe_join
from qaspark.session import materialize, release


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return null_safe_join(both.filter("b > a"), low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    others = null_safe_join(links, low, ["a"]).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; root is the smallest node of its component.

    ``links`` has columns a and b (bigint), in any order, repeats and loops allowed.
    """
    state = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == seen:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, before = mark, state
        state = materialize(_small_star(_large_star(before)), "links")
        release(before)
