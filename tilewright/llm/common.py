"""What the operators share: cut lineage, Arrow passes, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a Python worker turns over at once.
PIECE = 1024

_own_dir: list[str] = []


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds the texts of a few rows only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own only where that is unset and all
    tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tilewright-"))
    return f"file://{_own_dir[0]}"


def cut(df: DataFrame, name: str, codec: str | None = None, rows: int = 0, block: int = 0) -> DataFrame:
    """The rows of df, written once as a table in the shared folder and read back. codec: Parquet's, if not the session's;
    rows: of a file at most, if not 0; block: bytes of a row group, if not Parquet's own.

    The plan above starts from files, so a lost executor costs no more than the tasks that ran on it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", rows)
    (writer.option("parquet.block.size", block) if block else writer).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table that cut() wrote and that nobody reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).getParent() for f in df.inputFiles()}:
        folder.getFileSystem(conf).delete(folder, True)


def arrow_pass(df: DataFrame, columns: list, work: Callable[[pa.RecordBatch], dict], schema: str, rows: int = PIECE) -> DataFrame:
    """One narrow pass: work turns each Arrow batch of the columns, of so many rows at most, into the columns of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows):
            yield pa.RecordBatch.from_pydict(work(batch))

    return df.select(*columns).mapInArrow(run, schema)


def count_at_most(df: DataFrame, limit: int) -> bool:
    """Whether df has limit rows or fewer, without counting beyond."""
    return df.limit(limit + 1).count() <= limit


def small_join(big: DataFrame, small: DataFrame, on, how: str = "left", limit: int = 100_000) -> DataFrame:
    """A join whose small side is broadcast only if it is counted to have at most limit rows; else Spark's own choice."""
    return big.join(F.broadcast(small) if count_at_most(small, limit) else small, on, how)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: list[float], ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Intercept and slopes of a logistic regression on the columns of x, drawn to start; damped Newton steps.

    Targets are smoothed by one case of either class, and a step is halved until the penalised likelihood doesn't fall, so
    the fit can't diverge however well x parts the classes. y: 0 or 1; w: weights of the rows.
    """
    n1, n0 = float(w[y > 0].sum()), float(w[y <= 0].sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    X, at = np.column_stack([np.ones(len(y)), x]), np.array(start, np.float64)

    def loss(beta: np.ndarray) -> float:
        z = X @ beta
        return float((w * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * ridge * ((beta - at) ** 2).sum())

    beta, now = at.copy(), loss(at)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -500, 500)))
        grad = X.T @ (w * (target - p)) - ridge * (beta - at)
        if np.abs(grad).max() < 1e-8:
            break
        step = np.linalg.solve((X * (w * p * (1 - p))[:, None]).T @ X + ridge * np.eye(len(at)), grad)
        while (new := loss(beta + step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        beta, now = beta + step, min(new, now)
    return beta


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8; null: none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
