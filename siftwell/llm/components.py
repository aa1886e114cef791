"""Connected components by alternating large-star and small-star steps, as joins and grouped minima.

No neighbourhood is ever gathered into one group: each step takes a node's smallest neighbour with a partially
aggregated minimum and joins it back, so a node with a third of all links costs no more than its links do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

STARS = 2  # rounds between two checkpoints


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node id that can be reached.

    links holds pairs of non-null integer ids in any direction, repeats and self-links included; an empty input gives an empty result.
    """
    pairs = cut(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct()
    )
    state = _mark(pairs)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        for _ in range(STARS):
            pairs = _small_star(_large_star(pairs))
        pairs = cut(pairs)
        before, state = state, _mark(pairs)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(pairs.select("v", "v").distinct())


def _mark(pairs: DataFrame) -> tuple:
    """Count and order-free checksum: equal marks on both sides of a round mean that nothing changed."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each star step names its input twice and no more: a plan holds the whole tree of its steps, and a third or fourth mention makes it grow as a power with every step."""
    both = pairs.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node's link to its least neighbour stays, its other neighbours are linked to that one. pairs are distinct."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
