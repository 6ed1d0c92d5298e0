"""Keyed-table operations: lookups of checked size, first rows, upserts, positional pairs, name templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a looked-up side is sent to every task.
SMALL = 200_000


def lookup(big: DataFrame, dim: DataFrame, on, how: str = "inner", limit: int = SMALL) -> DataFrame:
    """A join that broadcasts dim only if it has at most limit rows; beyond, Spark shuffles both sides."""
    return big.join(F.broadcast(dim) if dim.limit(limit + 1).count() <= limit else dim, on, how)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; order must end in something unique."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_write(df: DataFrame, keys: list[str], seq: str, **more: Column) -> DataFrame:
    """One row per key: the one that was written last, and more aggregates of the key's rows under their names. An
    aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"), *[v.alias(k) for k, v in more.items()]).select(*keys, "_r.*", *more)


def unseen(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key has not been written yet."""
    return new.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old that it does not replace; columns that one side lacks are NULL."""
    return new.unionByName(unseen(old, new, keys), allowMissingColumns=True)


def backfill(have: DataFrame, keys_on_disk: DataFrame, keys: list[str], compute) -> DataFrame:
    """have, and compute(rows missing from it); columns that compute does not know are NULL."""
    return have.unionByName(compute(unseen(keys_on_disk, have, keys)), allowMissingColumns=True)


def in_all(df: DataFrame, key: str, member: str, members: int) -> DataFrame:
    """Keys that every one of so many members has: one aggregate, whatever their number."""
    return df.groupBy(key).agg(F.count_distinct(member).alias("_n")).where(F.col("_n") == members).select(key)


def side_status(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, status: both, left_only, right_only."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both").alias("status"))


def zip_by_rank(a: DataFrame, b: DataFrame, group: str, order_a: str, order_b: str) -> DataFrame:
    """Pairs the i-th of a with the i-th of b within a group; which sides are longer shows as NULLs."""
    ra = a.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(order_a)))
    rb = b.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(order_b)))
    return ra.join(rb, [group, "i"], "full_outer")


def resolve(df: DataFrame, names: list[Column], dim: DataFrame, dim_key: str, value: str, out: str) -> DataFrame:
    """The value of the first of several names that dim knows; NULL if it knows none."""
    for i, name in enumerate(names):
        side = dim.select(F.col(dim_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        df = df.join(side, name == F.col(f"_k{i}"), "left")
    got = F.coalesce(*[F.col(f"_v{i}") for i in range(len(names))]).alias(out)
    return df.select("*", got).drop(*[f"_{p}{i}" for p in "kv" for i in range(len(names))])


def pooled_moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, std from sums, so that parts of any size can be added up."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    mean = F.col("_s") / F.col("n")
    return s.select(*by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(1e-12))).alias("std"))
