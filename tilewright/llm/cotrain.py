"""Quality by co-training: a classifier of text content and one of page metadata teach each other.

The text view knows a document by its words (as they are written, hashed) and by shares of symbols, capitals, repeats and the like; the
metadata view knows only what comes with the text: source, language and stated length. Both are naive Bayes models, so
what they learn from any number of documents is a table of counts. In each round a narrow pass over the stored features
adds, for either view, the labelled documents and those unlabelled ones of which the *other* view is confident; the passes
cover all documents. Labelled documents that are held out of the counts (one in five, by id) then calibrate each view by a
logistic regression of its own, and a third one combines the two calibrated log-odds; all three work on a table of counts
of rounded log-odds, whatever the number of labels.

Defined results: a null or empty text has no words and bin 0 throughout; null metadata is a value of its own; labels that
are null or of documents that aren't there are ignored, an id that is labelled twice counts as bad if one label says so;
without labels of both classes every document scores the share of good labels (1 with none); repeated rows give equal
rows; a very long text counts as a whole, its words by their mean; an empty table an empty result; `keep_good` passes all
columns through whatever their names, `judge` ignores them. Ids may be of any type.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_pass, cut, logistic, pieces, words_of
from tilewright.llm.rules import MEASURES, measure

#: A view is confident at that many units of log-odds beyond what the shares of the classes say.
BINS, ROUNDS, CONFIDENT, PSEUDO_WEIGHT = 16, 3, 4.0, 0.25
#: Buckets of hashed words, the count that each starts from, and the weight of the mean word against one other feature.
BUCKETS, SMOOTH, WORDS = 4096, 2.0, 10.0
#: Log-odds are counted in steps of STEP up to +-REACH for the calibration.
STEP, REACH = 0.5, 12.0
TEXT = ("symbols", "letters", "capitals", "repeats", "variety", "word_length", "commas", "stops", "exclaims", "digits")
META = ("source", "lang", "n_chars")
N_TEXT, N_ALL = len(TEXT), len(TEXT) + len(META)
SIDE = int(2 * REACH / STEP) + 1


def _bin(part: float, whole: float, scale: float) -> int:
    """0 for nothing; 1 to 15 by the square root of the share, so small shares are told apart."""
    return 0 if part <= 0 or whole <= 0 else 1 + min(14, int(14 * min(1.0, scale * part / whole) ** 0.5))


def text_bins(text: str | None, m: dict) -> list[int]:
    t, chars, words = text or "", m["word_chars"], m["n_words"]
    digits = sum(map(t.count, "0123456789"))
    return [
        _bin(m["n_symbols"], chars, 4), _bin(chars - m["n_letters"], chars, 3), _bin(m["n_upper"], chars, 1), _bin(m["n_repeat_words"], words, 1), _bin(m["n_distinct"], min(words, 400), 1),
        min(15, round(chars / words)) if words else 0, _bin(t.count(","), words, 4), _bin(t.count("."), words, 4), _bin(t.count("!"), words, 2), _bin(digits, chars, 4),
    ]


def buckets(text: str | None) -> np.ndarray:
    """The buckets of a text's distinct words, in ascending order."""
    words = set(words_of(text))
    return np.unique(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(BUCKETS)).astype("<u2")


def meta_bins(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    name = lambda x: 0 if x is None else 1 + zlib.crc32(x.encode("utf-8", "replace")) % 15
    return [name(source), name(lang), 0 if n_chars is None else 1 + min(14, int(max(0, n_chars)).bit_length())]


def _features(texts: list, sources: list, langs: list, sizes: list) -> tuple[list[bytes], list[bytes]]:
    """For each document a byte for each feature of TEXT and META, and its words' buckets as 16-bit numbers."""
    bins, words = [], []
    for t, s, g, n in zip(texts, sources, langs, sizes):
        bins.append(bytes(text_bins(t, dict(zip(MEASURES, measure(t)))) + meta_bins(s, g, n)))
        words.append(buckets(t).tobytes())
    return bins, words


def _columns(docs: DataFrame, text: str, source: str, lang: str, n_chars: str) -> list:
    return [F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(n_chars).cast("long").alias("n_chars")]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """id, bins, words (both binary) of every row."""

    def work(batch: pa.RecordBatch) -> dict:
        bins, words = _features(*(batch[i].to_pylist() for i in range(1, 5)))
        return {"id": batch[0], "bins": pa.array(bins, pa.binary()), "words": pa.array(words, pa.binary())}

    kind = dict(docs.select(F.col(key).alias("id")).dtypes)["id"]
    return arrow_pass(docs, [F.col(key).alias("id"), *_columns(docs, text, source, lang, n_chars)], work, f"id {kind}, bins binary, words binary")


class Rows:
    """The features of some documents: x (rows, N_ALL), and the words' buckets one after the other with their rows."""

    def __init__(self, bins: list[bytes], words: list[bytes]):
        self.n = len(bins)
        self.x = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, N_ALL).astype(np.int64)
        self.size = np.fromiter(map(len, words), np.int64, self.n) // 2
        self.word, self.of = np.frombuffer(b"".join(words), "<u2").astype(np.int64), np.repeat(np.arange(self.n), self.size)


def counted(rows: Rows, y: np.ndarray, w: np.ndarray, view: int) -> np.ndarray:
    """The counts that rows of class y (0, 1) and weight w add to a view (0: text, 1: metadata); one flat table for both."""
    out = np.zeros(N_ALL * BINS * 2 + BUCKETS * 2)
    for f in range(N_TEXT) if view == 0 else range(N_TEXT, N_ALL):
        out += np.bincount((f * BINS + rows.x[:, f]) * 2 + y, w, len(out))
    if view == 0:
        out += np.bincount(N_ALL * BINS * 2 + rows.word * 2 + y[rows.of], w[rows.of], len(out))
    return out


class Views:
    """Two naive Bayes models from counts."""

    def __init__(self, counts: np.ndarray):
        bins, words = counts[: N_ALL * BINS * 2].reshape(N_ALL, BINS, 2), counts[N_ALL * BINS * 2 :].reshape(BUCKETS, 2)
        of = lambda c: np.log(c[..., 1] / c[..., 1].sum(-1, keepdims=True)) - np.log(c[..., 0] / c[..., 0].sum(-1, keepdims=True))
        self.odds, self.words = of(bins + 0.5), of(words + SMOOTH)
        total = bins.sum(1)
        self.prior = np.log((total[[0, N_TEXT], 1] + 1) / (total[[0, N_TEXT], 0] + 1))

    def log_odds(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of good against bad: by the text's shares, by its words, by the metadata; none with the shares of the classes."""
        each = self.odds[np.arange(N_ALL)[None, :], rows.x]
        words = WORDS * np.bincount(rows.of, self.words[rows.word], rows.n) / np.maximum(rows.size, 1)
        return each[:, :N_TEXT].sum(1), words, each[:, N_TEXT:].sum(1)


class Model:
    def __init__(self, views: Views | None, lines: tuple, share: float):
        """lines: of the text view, of the metadata view, and of both together."""
        self.views, self.lines, self.share = views, lines, share

    def calibrated(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, c = (np.clip(x, -REACH, REACH) for x in (a, b, c))
        text, meta, both = self.lines
        t, m = text[0] + text[1] * a + text[2] * b, meta[0] + meta[1] * c
        return t, m, both[0] + both[1] * t + both[2] * m

    def score(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probability of good, and the calibrated log-odds of either view."""
        if self.views is None:
            return np.full(rows.n, self.share), np.zeros(rows.n), np.zeros(rows.n)
        t, m, z = self.calibrated(*self.views.log_odds(rows))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), t, m


def _rows(batch: pa.RecordBatch) -> Rows:
    return Rows(batch[0].to_pylist(), batch[1].to_pylist())


def _sums(table: DataFrame, size: int, add) -> np.ndarray:
    """Sums of what add(rows, y) gives (an array of size numbers), over all rows; a task sends one row per number."""

    def run(batches):
        total = np.zeros(size)
        for batch in pieces(batches):
            total += add(_rows(batch), batch[2].fill_null(-1).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.float64())})

    out = np.zeros(size)
    for r in table.select("bins", "words", "y").mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def taught(rows: Rows, y: np.ndarray, views: Views | None) -> np.ndarray:
    """One round's counts: labelled rows (y 0, 1) for both views, and for each view the rows of which the other is sure."""
    known = (y >= 0).astype(np.float64)
    good = np.maximum(y, 0)
    out = counted(rows, good, known, 0) + counted(rows, good, known, 1)
    if views is not None:
        a, b, c = views.log_odds(rows)
        for odds, view in ((c, 0), (a + b, 1)):
            sure = PSEUDO_WEIGHT * ((y < 0) & (np.abs(odds) >= CONFIDENT))
            if sure.any():
                out += counted(rows, (odds > 0).astype(np.int64), sure, view)
    return out


def cells(rows: Rows, y: np.ndarray, views: Views) -> np.ndarray:
    """Counts of rows by their three rounded log-odds and class."""
    at = np.zeros(rows.n, np.int64)
    for odds in views.log_odds(rows):
        at = at * SIDE + np.rint((np.clip(odds, -REACH, REACH) + REACH) / STEP).astype(np.int64)
    return np.bincount(at * 2 + y, minlength=SIDE**3 * 2).astype(np.float64)


def lines_of(n: np.ndarray) -> tuple:
    """The three regressions from counts by cell and class; no slope is negative."""
    at, y = np.divmod(np.flatnonzero(n), 2)
    w, odds = n[n > 0], [at // SIDE**k % SIDE * STEP - REACH for k in (2, 1, 0)]

    def fit(columns: list, start: list[float]) -> list[float]:
        line = logistic(np.column_stack(columns), y, w, start)
        return [float(line[0]), *(max(0.0, float(v)) for v in line[1:])]

    text, meta = fit(odds[:2], [0.0, 0.5, 0.1]), fit(odds[2:], [0.0, 0.2])
    t, m = text[0] + text[1] * odds[0] + text[2] * odds[1], meta[0] + meta[1] * odds[2]
    return text, meta, fit([t, m], [0.0, 1.0, 0.2])


def fit(table: DataFrame, rounds: int = ROUNDS) -> Model:
    """table: bins, words, y (1 good, 0 bad, null unknown), held; stored."""
    learn = table.where("not held or y is null")  # only labelled rows are held out
    share = learn.select(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad")).first()
    if not share["good"] or not share["bad"]:
        return Model(None, (), 1.0 if not share["bad"] else 0.0)
    views = None
    for _ in range(rounds + 1):  # the first from the labels alone
        views = Views(_sums(learn, N_ALL * BINS * 2 + BUCKETS * 2, lambda rows, y, v=views: taught(rows, y, v)))
    n = _sums(table.where("held and y is not null"), SIDE**3 * 2, lambda rows, y: cells(rows, y, views))
    lines = lines_of(n) if n.any() else ([0.0, 0.5, 0.1], [0.0, 0.2], [0.0, 1.0, 0.2])
    return Model(views, lines, share["good"] / (share["good"] + share["bad"]))


def labelled(table: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Adds y and held: one in five ids is held out, by its crc32. table: id and more."""
    own = labels.select(F.col(key).alias("of"), F.col(label).alias("label")).where("of is not null and label is not null").groupBy("of").agg(F.min(F.when(F.col("label") > 0, 1).otherwise(0)).cast("long").alias("y"))
    return table.join(own, F.col("id") == F.col("of"), "left").drop("of").withColumn("held", F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted (1: good), text_odds, meta_odds (calibrated) of every row."""
    table = cut(labelled(features(docs, key, text), labels, key), "cotrain-features")
    model = fit(table)

    def work(batch: pa.RecordBatch) -> dict:
        p, a, b = model.score(Rows(batch[1].to_pylist(), batch[2].to_pylist()))
        return {"id": batch[0], "score": pa.array(p), "text_odds": pa.array(a), "meta_odds": pa.array(b)}

    out = arrow_pass(table, ["id", "bins", "words"], work, f"id {dict(table.dtypes)['id']}, score double, text_odds double, meta_odds double")
    return out.select(F.col("id").alias(key), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "text_odds", "meta_odds")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", at: float = 0.5) -> DataFrame:
    """The rows that score at or over at, with all their columns. They are scored from their texts anew, in a narrow pass."""
    model = fit(cut(labelled(features(docs, key, text), labels, key), "cotrain-features"))
    places = [docs.columns.index(c) for c in (text, "source", "lang", "n_chars")]

    def run(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(model.score(Rows(*_features(*(batch[i].to_pylist() for i in places))))[0] >= at))

    return docs.mapInArrow(run, docs.schema)
