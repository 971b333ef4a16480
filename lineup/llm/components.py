"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: every neighbour is hung onto the smallest one.

    ``edges`` has ``u > v``. The large step moves the larger neighbours of a
    node, the small step the node and its smaller ones. Minima come from a
    combining aggregation and a join, so no neighbour list is built.
    """
    near = edges.select("u", "v") if small else edges.select("u", "v").union(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if small:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """``node, component``: the smallest node that links reach, for every linked node.

    Large and small star steps alternate until the table stops changing, each
    round written to the shared folder. Null ends and loops are ignored.
    """
    edges = store(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v")).distinct()
        state = mark
        edges = store(_stars(_stars(edges, small=False), small=True), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
