"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same ratio r of copies, so floor(r) copies are sure and one more is taken with
probability r - floor(r). Documents with a fractional probability meet, the largest with the next smaller ones; mass,
counted in words, moves between them in a random direction until the largest has a probability of 0 or 1. Each step keeps
everyone's expected copies and the words of those that met, so a run of documents leaves at most one fractional document,
and that a small one. Runs are cut by a hash of doc_id, so a source that holds most of the rows is spread over many
tasks; what they leave meets in a tree of fixed fan-in, and the one document that each source has left at the root is
rounded by its probability. A source's taken words hence differ from its target by less than the size of one document,
as a rule of one of its smallest.

Defined results: a null text or one without words has size 0 and takes 0 words (its copies are still decided); null is a
source of its own, last in order; an empty table gives an empty result; repeated rows are separate units with copies of
their own; a very long text is a unit like any other, and what its rounding moves is made up for by smaller ones where
there are enough. `mix` passes all columns through, whatever their names, and keeps rows apart by id, source and text;
`decide` ignores columns that it isn't told of.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import WORD, cut, small_join

WEIGHTS = (5, 2, 1)
#: Documents of one run, runs that meet in a node of the tree, and copies at most.
RUN, FAN_IN, MOST = 4096, 32, 3.0
#: Rows of a run that a task holds at once; a run is longer only where thousands of rows are equal.
CHUNK = 1 << 17


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares by weight of all sizes, capped at most times the source's size.

    Reaching the caps one after the other is the same as filling all sources to one level per unit of weight: sources
    are met in the order of the level at which they are full, and the first that the rest can't fill sets the level.
    One row per source comes in, however many rows each has.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    full = sums.withColumn("weight", w).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    left = full.select(
        "*",
        F.sum("source_size").over(every).cast("double").alias("total"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
        F.row_number().over(order).alias("nth"),
    ).withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    level = F.min(F.when(F.col("at") > F.col("level"), F.struct("nth", "level"))).over(every)["level"]
    return left.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _meet(rows: list, draws: Iterator[float], done: list) -> list | None:
    """Pivotal steps among the rows; the decided ones are put in done, the one that stays fractional is given back.

    A row: [.., size, p]. The two largest move words between them until one of them is decided. Where the largest is over
    twice the next one's size, many small ones would be decided before it, and it would be left over; so it is decided at
    once, by its own probability, and the words that this adds or takes are moved to as many of the next ones as have
    room for either outcome, each in proportion to its room. Probabilities stay within 0 and 1, all expectations are
    kept, and what is left over in the end is small.
    """
    rest = []
    for x in rows:
        if 0.0 < x[-1] < 1.0 and not x[-2]:
            x[-1] = float(next(draws) < x[-1])  # without words: nothing to make up for
        (rest if 0.0 < x[-1] < 1.0 else done).append(x)
    rest.sort(key=lambda x: -x[-2])  # stable: equal sizes keep their order
    words = [x[-2] for x in rest]
    room = sum(s * (1 - x[-1]) for s, x in zip(words, rest))  # words that the rows from `at` on can still take
    stock = sum(s * x[-1] for s, x in zip(words, rest))  # and give
    at, n = 0, len(rest)

    def settled(x: list) -> bool:
        if x[-1] < 1e-9 or x[-1] > 1 - 1e-9:
            x[-1] = float(round(x[-1]))
        return not 0.0 < x[-1] < 1.0

    while at < n:
        a, s = rest[at], words[at]
        p = a[-1]
        room, stock = room - s * (1 - p), stock - s * p  # of those behind a
        if settled(a):
            done.append(a)
            at += 1
            continue
        if at == n - 1:
            return a
        if 2 * words[at + 1] < s and room * (1 - 1e-9) > p * s and stock * (1 - 1e-9) > (1 - p) * s:
            up, down, end = 0.0, 0.0, at + 1
            while end < n and (up < p * s or down < (1 - p) * s):
                up, down, end = up + (1 - rest[end][-1]) * words[end], down + rest[end][-1] * words[end], end + 1
            a[-1] = float(next(draws) < p)
            move = (p - a[-1]) * s
            for x in rest[at + 1 : end]:
                x[-1] = min(max(x[-1] + (move / up * (1 - x[-1]) if move > 0 else move / down * x[-1]), 0.0), 1.0)
            room, stock = room - move, stock + move
            done.append(a)
            at += 1
            continue
        b, t = rest[at + 1], words[at + 1]
        q = b[-1]
        room, stock = room - t * (1 - q), stock - t * q
        more, less = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        move = more if next(draws) * (more + less) < less else -less
        a[-1], b[-1] = p + move / s, q - move / t
        out, on, size = (a, b, t) if settled(a) and not settled(b) else (b, a, s)
        out[-1] = float(round(out[-1]))
        done.append(out)
        at += 1
        rest[at], words[at] = on, size
        room, stock = room + size * (1 - on[-1]), stock + size * on[-1]
    return None


def _round(spark_rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """Rounds each run of equal (source, node): rows come sorted by source, node and falling size. A run is held as a
    whole, or CHUNK rows of it at a time where equal rows make it longer; what is left over goes on with the next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, draws = None, [], None

        def close(final: bool) -> list:
            done: list = []
            left = _meet(held, draws, done)
            held.clear()
            if left is not None and not final:
                held.append(left)
            elif left is not None:
                if last:
                    left[-1] = float(next(draws) < left[-1])
                done.append(left)
            return done

        for frame in frames:
            done: list = []
            for (source, node), part in frame.groupby(["source", "node"], sort=False, dropna=False):
                source = None if pd.isna(source) else source
                if at != (source, node):
                    if at is not None:
                        done += close(True)
                    at = source, node
                    rng = np.random.default_rng([seed, level, zlib.crc32(repr(source).encode()), int(node) & 0xFFFFFFFF])
                    draws = iter(rng.random, None)
                held += [[*x[:2], *x[3:8], x[2], x[8]] for x in part.itertuples(index=False, name=None)]
                if len(held) >= CHUNK:
                    done += close(False)
            yield pd.DataFrame([[*x[:2], x[-2], *x[2:-2], x[-1]] for x in done], columns=frame.columns)
        if at is not None:
            yield pd.DataFrame([[*x[:2], x[-2], *x[2:-2], x[-1]] for x in close(True)], columns=frame.columns)

    rows = spark_rows.repartition("source", "node").sortWithinPartitions(F.col("source").asc_nulls_last(), "node", F.desc("size"), "key", "mark")
    return rows.mapInPandas(run, rows.schema)


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: float = MOST, seed: int = 11) -> DataFrame:
    """key, mark, source, size, source_size, target, copies, for every row. mark: a hash of the row's text."""
    sized = cut(
        docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("mark")),
        "mix-sizes",
    )
    goals = cut(targets(sized, weights, most), "mix-targets")
    runs = max(1, -(-sized.count() // RUN))
    rows = small_join(sized, goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("ratio", F.when(F.abs(ratio - F.rint(ratio)) < 1e-9, F.rint(ratio)).otherwise(ratio)).select(
        "key", "source", "size", "source_size", "target", F.pmod(F.xxhash64("key", "mark"), F.lit(runs)).alias("node"), "mark", F.floor("ratio").cast("long").alias("sure"), (F.col("ratio") - F.floor("ratio")).alias("p")
    )
    decided, level = [], 0
    while True:
        out = cut(_round(rows, seed, level, runs == 1), f"mix-level{level}")
        decided.append(out if runs == 1 else out.where("p = 0 or p = 1"))
        if runs == 1:
            break
        rows, runs, level = out.where("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / FAN_IN)), -(-runs // FAN_IN), level + 1
    every = decided[0]
    for more in decided[1:]:
        every = every.unionByName(more)
    return every.select("key", "mark", "source", "size", "source_size", "target", (F.col("sure") + F.col("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents themselves, with all their columns, each as often as the mix takes it.

    A row is known by its key, source and text. Of rows that share all three, the first in the order of their other
    columns takes the larger number of copies, so reruns agree.
    """
    taken = decide(docs, key, text, source, **how).select("key", "mark", "source", "copies")
    by = ["key", "mark", "source"]
    twice = taken.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    # the documents travel as one struct, so no name of theirs can meet one of ours
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(source).cast("string").alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    nth = F.lit(1)
    if twice:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.to_json("row")))
        taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("copies"))))
    else:
        taken = taken.withColumn("nth", F.lit(1))
    rows, right = rows.withColumn("nth", nth).alias("l"), taken.where("copies > 0").hint("merge").alias("r")
    on = F.col("l.key").eqNullSafe(F.col("r.key")) & (F.col("l.mark") == F.col("r.mark")) & F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.nth") == F.col("r.nth"))
    # both sides are dealt by key at every size: neither has a bound, so neither is sent to all tasks
    return rows.join(right, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
