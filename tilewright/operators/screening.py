"""Region screening: tile grids, ranks per structure, picks with a least distance between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def starts(length: Column, tile: Column, step: Column, last: str = "drop") -> Column:
    """Where the windows of an axis begin.

    last: drop (whole steps only), clamp (one more window that ends at the edge), exclusive (the window that would end
    at the edge is left out as well).
    """
    none = F.array().cast("array<long>")
    stop = length - tile - (1 if last == "exclusive" else 0)
    base = F.when(stop >= 0, F.sequence(F.lit(0).cast("long"), stop.cast("long"), step.cast("long"))).otherwise(none)
    return F.when(length >= tile, F.array_distinct(F.concat(base, F.array((length - tile).cast("long"))))).otherwise(none) if last == "clamp" else base


def grid(df: DataFrame, height: str, width: str, tile: Column, step: Column, last: str = "drop") -> DataFrame:
    return df.withColumn("y", F.explode(starts(F.col(height), tile, step, last))).withColumn("x", F.explode(starts(F.col(width), tile, step, last)))


def ranked(df: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    """The k best of each group; the smaller key wins among equals."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows per pick that a group sends to its task at first; only groups that run out of them send all.
PER_PICK = 64


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + more


def far_apart(df: DataFrame, by: str, k: int, separation: float, store=lambda rows: rows) -> DataFrame:
    """Greedy picks per group: the next best that is at least separation from all before it, k at most.

    df: by, key, score, x, y. Picks come in the order of scores, so the k * PER_PICK best rows of a group give all of
    them unless they hold fewer than k far apart; then the group, and only such a group, is done over all its rows.
    store(rows) may write rows and read them back, so that scores and first picks are computed once.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["score", "key"], ascending=[False, True], kind="stable")
        xy = rows[["x", "y"]].to_numpy()
        out: list[int] = []
        for at in range(len(xy)):
            if not out or (((xy[out] - xy[at]) ** 2).sum(1) >= separation * separation).all():
                out.append(at)
                if len(out) == k:
                    break
        got = rows.iloc[out].copy()
        got["rank"], got["found"] = range(1, len(got) + 1), len(got)
        return got

    rows = store(df.select(by, "key", "score", "x", "y"))
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "key"))).where(F.col("_r") <= k * PER_PICK).drop("_r")
    schema = _schema(rows, "rank long, found long")
    first = store(best.groupBy(by).applyInPandas(pick, schema))
    large = rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > k * PER_PICK).select(by)
    short = first.where(F.col("found") < k).select(by).distinct().join(large, by, "left_semi")
    again = rows.join(short, by, "left_semi").groupBy(by).applyInPandas(pick, schema)
    return first.join(short, by, "left_anti").unionByName(again).drop("found")


def round_robin(df: DataFrame, n: int, floor: float, separation: float, structures: list[str], store=lambda rows: rows) -> DataFrame:
    """A second tier: structures take turns with their best tile left, none under the floor or too near one taken.

    The turns depend on one another, so one task plays them, over the best rows of each structure. If a structure runs
    out of its share while it has more, the game is played again with larger shares.
    """

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["structure", "score", "key"], ascending=[True, False, True], kind="stable")
        queues = {s: list(g.itertuples(index=False)) for s, g in rows.groupby("structure", sort=False)}
        more = {s: bool(g["_more"].any()) for s, g in rows.groupby("structure", sort=False)}
        at, taken, dry = dict.fromkeys(queues, 0), [], False
        while len(taken) < n and any(at[s] < len(queues[s]) for s in structures if s in queues):
            for s in structures:
                queue = queues.get(s, [])
                while at.get(s, 0) < len(queue):
                    row = queue[at[s]]
                    at[s] += 1
                    if all(row.key != t.key and (row.x - t.x) ** 2 + (row.y - t.y) ** 2 >= separation * separation for t in taken):
                        taken.append(row)
                        break
                dry = dry or (more.get(s, False) and at[s] >= len(queue))
                if len(taken) == n:
                    break
        out = pd.DataFrame([(t.structure, t.key, t.score, t.x, t.y) for t in taken], columns=["structure", "key", "score", "x", "y"])
        out["turn"], out["dry"] = range(1, len(out) + 1), dry
        yield out

    rows = store(df.where(F.col("score") >= floor).select("structure", "key", "score", "x", "y"))
    ranked_rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("structure").orderBy(F.desc("score"), "key")))
    share = n * PER_PICK
    while True:
        some = ranked_rows.where(F.col("_r") <= share + 1).withColumn("_more", F.col("_r") > share).drop("_r")
        out = store(some.coalesce(1).mapInPandas(play, _schema(rows, "turn long, dry boolean")))
        if not out.where("dry").limit(1).count():
            return out.drop("dry")
        share *= 8


def shortlist(scores: DataFrame, key: str, structures: list[str], top: int) -> DataFrame:
    """Equal quotas per structure, first occurrence kept, filled up with the best of all, cut to top. scores: wide."""
    quota = max(1, top // len(structures))
    long = scores.unpivot([key], structures, "structure", "score")
    order = F.expr("case structure " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(structures)) + " end")
    first = ranked(long, ["structure"], "score", key, quota).withColumn("_o", order).groupBy(key).agg(F.min(F.struct("_o", "rank")).alias("_s"))
    rest = scores.select(key, (F.greatest(*structures) if len(structures) > 1 else F.col(structures[0])).alias("_best"))
    both = rest.join(first, key, "left")
    w = Window.orderBy(F.col("_s").isNull(), "_s._o", "_s.rank", F.desc("_best"), key)
    few = both.orderBy(F.col("_s").isNull(), "_s._o", "_s.rank", F.desc("_best"), key).limit(top)  # before the one-task window
    return few.select(key, F.col("_s").isNotNull().alias("by_quota"), F.row_number().over(w).alias("place"))


def even_picks(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows evenly spaced over each group's order: positions round(i (n - 1) / (k - 1)), half to even, repeats once."""
    w = Window.partitionBy(*by)
    at = df.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))).cast("long")))
    return at.where(F.array_contains(wanted, F.col("_at").cast("long"))).withColumnRenamed("_at", "at").drop("_n")


def turns(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """n rows, groups taking turns: all first rows, then all second rows, in the order of the groups' names."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", by).limit(n)


def serpentine(frac: Column, lines: int, per_line: Column, reverse_odd: bool = True) -> tuple[Column, Column]:
    """line and field (0-based) of a position 0..1 along a scan that turns around at the end of each line."""
    line = F.least(F.greatest(F.floor(frac * lines), F.lit(0)), F.lit(lines - 1))
    rest = F.least(F.greatest(frac * lines - line, F.lit(0.0)), F.lit(1.0))
    field = F.least(F.floor(rest * per_line), per_line - 1)
    return line.cast("long"), (F.when(F.lit(reverse_odd) & (line % 2 == 1), per_line - 1 - field).otherwise(field)).cast("long")
