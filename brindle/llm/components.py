"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

SALTS = 64


def _settled(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _stars(sym: DataFrame, keep_if) -> DataFrame:
    """For each u the least of u and its neighbours v becomes the neighbour of the v for which keep_if holds.

    The neighbours of u are dealt into SALTS parts, so that no task holds all of a hub's.
    """
    salted = sym.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    parts = parts.select("u", "salt", F.least(F.min("m").over(Window.partitionBy("u")), F.col("u")).alias("m"))
    moved = salted.join(parts, ["u", "salt"]).where(keep_if).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(parts.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, scratch: str | None = None) -> DataFrame:
    """(u long, v long) links -> (node, component), component being its smallest node.

    Alternates large-star and small-star steps, O(log^2 n) rounds; nodes without a link to another
    node do not appear. Self links, repeated links and either direction are allowed; nulls are dropped;
    no links: no rows. Aggregates are combined before shuffles, and each round is written to the
    shared folder (below scratch, if given), so lineage stays short and nothing is collected.
    """
    e = keep(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), scratch)
    before = _settled(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "v > u")
        small = _stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "true")
        e = keep(small, scratch)
        after = _settled(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
