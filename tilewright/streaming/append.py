"""Tables that grow while they are being read: resumable appends, windows with late data, a replay buffer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from tilewright.operators.tables import unseen


def append_new(spark: SparkSession, new: DataFrame, out: str, keys: list[str]) -> int:
    """Appends the rows of new whose key out does not have yet; returns how many. A second run appends none."""
    try:
        done = spark.read.parquet(out).select(*keys)
    except Exception as e:  # the first run
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    rows = new.dropDuplicates(keys)
    rows = (rows if done is None else unseen(rows, done, keys)).persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(out)
        return n
    finally:
        rows.unpersist()


def overwrite_sources(df: DataFrame, out: str, by: str = "source") -> None:
    """Replaces the partitions of the sources in df and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(out)


def resume(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Takes whatever files are new in source, appends what out lacks, and ends; run it again to go on.

    A batch that was cut off is played again, and its rows that had been written are recognised by their keys.
    """

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, batch, out, keys)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str, by: list[str], value: str, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and key; events later than `late` behind the newest are left out. Batch or stream."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def _swap(buffer: list, item, size: int, draw: int) -> tuple[list, object]:
    """A full buffer gives back an old item for half of the new ones, and the new one itself for the rest."""
    if len(buffer) < size:
        return [*buffer, item], item
    if draw % 2:
        at = draw // 2 % size
        return [*buffer[:at], item, *buffer[at + 1 :]], buffer[at]
    return buffer, item


def replay(events: DataFrame, by: str, item: str, size: int = 50) -> DataFrame:
    """by, item, given: a buffer per key that swaps half of what comes for something older. Works on streams; the draw
    is a hash of key and item, so a replayed batch gives the same."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = list(state.get[0]) if state.exists else []
        for frame in frames:
            out = []
            for value, draw in zip(frame[item], frame["_draw"]):
                buffer, given = _swap(buffer, int(value), size, int(draw))
                out.append((key[0], int(value), given))
            yield pd.DataFrame(out, columns=[by, item, "given"])
        state.update((buffer,))

    kind = dict(events.dtypes)[by]
    drawn = events.select(by, F.col(item).cast("long").alias(item), F.pmod(F.xxhash64(by, item), F.lit(1 << 30)).alias("_draw"))
    return drawn.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, {item} long, given long", "buffer array<long>", "append", GroupStateTimeout.NoTimeout)
