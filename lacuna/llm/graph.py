"""Connected components of a table of links, by alternating large and small stars.

Each round is a few group-bys and joins on the links left; edges end up as stars around the smallest
id of their component. Rounds are written to the shared folder, so lineage stays short and a lost
executor costs one round. Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.wordblock import forget, keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link; self-links and repeats are harmless."""
    edges = keep(links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct())
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        old, edges = edges, keep(_small_star(_large_star(edges)))
        forget(old)
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    out = stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out._kept_at = edges._kept_at  # for ``forget``
    return out
