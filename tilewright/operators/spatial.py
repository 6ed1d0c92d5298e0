"""Joins by place: points go to the cells of a grid, and only neighbouring cells meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Each row once for each of the nine cells around it."""
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_s", F.explode(steps)).withColumn("_cx", cell(F.col(x), size) + F.col("_s.i")).withColumn("_cy", cell(F.col(y), size) + F.col("_s.j")).drop("_s")


def within(a: DataFrame, b: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """a_id, b_id, d of all pairs of one group that are at most tolerance apart. a, b: group, id, x, y."""
    left = a.select(*group, F.col("id").alias("a_id"), F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    left = left.withColumn("_cx", cell(F.col("_ax"), tolerance)).withColumn("_cy", cell(F.col("_ay"), tolerance))
    right = _around(b.select(*group, F.col("id").alias("b_id"), F.col("x").alias("_bx"), F.col("y").alias("_by")), "_bx", "_by", tolerance)
    dx, dy = F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")
    return left.join(right, [*group, "_cx", "_cy"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= tolerance).select(*group, "a_id", "b_id", "d")


def mutual_nearest(a: DataFrame, b: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """Pairs of which each is the other's nearest; the lower id wins among equals."""
    near = within(a, b, group, tolerance)
    by_a = Window.partitionBy(*group, "a_id").orderBy("d", "b_id")
    by_b = Window.partitionBy(*group, "b_id").orderBy("d", "a_id")
    ranked = near.withColumn("_a", F.row_number().over(by_a)).withColumn("_b", F.row_number().over(by_b))
    return ranked.where("_a = 1 and _b = 1").drop("_a", "_b")


def box_pairs(nodes: DataFrame, group: list[str], reach: float) -> DataFrame:
    """i < j of one group whose places differ by less than reach in both axes. nodes: group, id, x, y."""
    left = nodes.select(*group, F.col("id").alias("i"), F.col("x").alias("_ax"), F.col("y").alias("_ay")).withColumn("_cx", cell(F.col("_ax"), reach)).withColumn("_cy", cell(F.col("_ay"), reach))
    right = _around(nodes.select(*group, F.col("id").alias("j"), F.col("x").alias("_bx"), F.col("y").alias("_by")), "_bx", "_by", reach)
    met = left.join(right, [*group, "_cx", "_cy"]).where("i < j").where(F.abs(F.col("_ax") - F.col("_bx")) < reach).where(F.abs(F.col("_ay") - F.col("_by")) < reach)
    return met.select(*group, "i", "j", (F.col("_bx") - F.col("_ax")).alias("dx"), (F.col("_by") - F.col("_ay")).alias("dy"))


def nearest_other(nodes: DataFrame, group: list[str], start: float, store, rounds: int = 24) -> DataFrame:
    """id, d: distance to the nearest other point of the group, by a search that doubles its reach for those left over.

    A neighbour is final only if it is within the reach, as the cells around a point hold all points that near. Groups
    of one point have none and are left out. store(df) writes what a round found and reads it back, so that the next
    round's plan does not hold this one's.
    """
    sizes = nodes.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    every = store(nodes.join(sizes, group, "left_semi"))
    left, found, reach = every, None, start
    for _ in range(rounds):
        near = store(within(left, every, group, reach).where("a_id <> b_id").groupBy(*group, F.col("a_id").alias("id")).agg(F.min("d").alias("d")))
        found = near if found is None else found.unionByName(near)
        left = store(left.join(near, [*group, "id"], "left_anti"))
        reach *= 2
        if left.limit(1).count() == 0:
            return found
    raise RuntimeError(f"no neighbour within {reach:g} for some points")
