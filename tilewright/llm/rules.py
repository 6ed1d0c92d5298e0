"""Quality rules combined by weak supervision.

Each rule votes good or bad on a document, or abstains. A one-coin-per-vote model with a class prior (good documents and
bad ones give each rule's votes with probabilities of their own) is fitted by expectation-maximisation. As documents with
equal votes are alike, the fit runs on the counts of vote patterns, at most three to the power of the number of rules,
whatever the number of documents. A document is kept if the posterior probability of good is at least `KEEP_AT`.

Defined results: a null or empty text has no words and fails the base rules; repeated rows give equal rows; an empty table
an empty result; where no rule ever votes bad, all posteriors are near one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_pass, cut

SYMBOLS = "#*$%&|<>"
KEEP_AT, PRIOR, ROUNDS = 0.5, 0.9, 50
#: Rules as (name, good if, bad if) over the measures; neither: it abstains. Percentages are of words or characters.
RULES = (
    ("length", "n_words >= 40", "n_words < 15"),
    ("symbols", "n_symbols * 50 <= n_words", "n_symbols * 4 >= n_words"),
    ("lines", "n_dup_lines = 0", "n_dup_lines * 4 >= n_lines and n_dup_lines >= 2"),
    ("repeats", "n_repeat_words * 50 <= n_words", "n_repeat_words * 5 >= n_words"),
    ("word_length", "word_chars between n_words * 3 and n_words * 9", "word_chars < n_words * 2 or word_chars > n_words * 14"),
    ("capitals", "n_upper * 10 <= word_chars", "n_upper * 2 >= word_chars"),
    ("letters", "n_letters * 100 >= word_chars * 90", "n_letters * 100 < word_chars * 75"),
    ("symbol_share", "n_symbols * 300 <= word_chars", "n_symbols * 25 >= word_chars"),
    ("variety", "n_distinct * 100 >= least(n_words, 400) * 25", "n_distinct * 100 < least(n_words, 400) * 10"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct")
_SPACES, _OTHERS = " \t\n\x0b\x0c\r", "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER = bytes(range(65, 91))
WINDOW = 5
#: Words of a block in which distinct ones are counted, as the variety rule has it, so a text's length doesn't matter.
BLOCK = 400


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more in the text, the first one included."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.uint64, n)
    if len(ids) == n:
        return 0
    size = n - window + 1
    with np.errstate(over="ignore"):
        mixed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = np.zeros(size, np.uint64)
        for k in range(window):
            key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + size]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    for k in range(window):  # equal keys must be equal windows; else the windows themselves are counted
        if (code[order[1:][same] + k] != code[order[:-1][same] + k]).any():
            return _repeat_words_plain(words, window)
    again = np.zeros(size, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int(np.count_nonzero(np.cumsum(covered[:n])))


def _repeat_words_plain(words: list[bytes], window: int) -> int:
    seen: dict[tuple, int] = {}
    windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    return len({j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + window)})


def least_distinct(words: list[bytes], block: int = BLOCK) -> int:
    """Distinct words of the poorest block of a whole text: consecutive ones, and the last words; fewer: all of them."""
    n = len(words)
    return min((len(set(words[i : i + block])) for i in [*range(0, n - block, block), max(0, n - block)]), default=0)


def capitals(text: str) -> int:
    """Characters that have a small form of their own; none where that has another length."""
    if text.isascii():
        raw = text.encode()
        return len(raw) - len(raw.translate(None, _UPPER))
    low = text.lower()
    if len(low) != len(text):
        return 0
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, low))
    return int(np.count_nonzero(a != b))


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of a whole text, in the order of MEASURES."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_chars = len(text) - sum(map(text.count, _SPACES))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    symbols = sum(map(text.count, SYMBOLS))
    letters = n_chars - sum(map(text.count, _OTHERS))
    return len(words), n_chars, symbols, dup, repeat_words(words), lines, capitals(text), letters, least_distinct(words)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        rows = np.array([measure(t) for t in batch[1].to_pylist()], np.int64)
        return {key: batch[0]} | {name: pa.array(rows[:, i]) for i, name in enumerate(MEASURES)}

    return arrow_pass(docs, [key, text], work, f"{key} {dict(docs.dtypes)[key]}, " + ", ".join(f"{m} long" for m in MEASURES))


def votes(measured: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds pattern: for each rule 2 (good), 1 (bad) or 0, as one string of digits."""
    each = [F.when(F.expr(bad), F.lit("1")).when(F.expr(good), F.lit("2")).otherwise(F.lit("0")) for _, good, bad in rules]
    return measured.withColumn("pattern", F.concat(*each))


def expectation_maximisation(patterns: dict[str, int], n_rules: int, rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[dict[str, float], np.ndarray]:
    """The posterior probability of good for each pattern, and per class (bad, good) and rule the chances of 0, 1 and 2.

    It starts from the majority of the votes, and every chance has a pseudo-count in favour of rules that are right, so
    the classes can't change places.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((2, n_rules, 3))
    v = np.array([list(map(int, p)) for p in names])
    w = np.array([patterns[p] for p in names], np.float64)
    bad, good = (v == 1).sum(1), (v == 2).sum(1)
    post = np.clip((good + 2 * prior) / (good + 2 * bad + 2), 0.02, 0.98)
    mild = max(1.0, 0.01 * w.sum())
    hot = np.eye(3)[v]  # pattern, rule, vote
    pseudo = np.array([[1.0, 2.0, 1.0], [1.0, 0.2, 3.0]])
    chance = np.zeros((2, n_rules, 3))
    for _ in range(rounds):
        share = np.stack([1 - post, post])
        count = np.einsum("cp,p,prv->crv", share, w, hot) + mild * 0.2 * pseudo[:, None, :]
        chance = count / count.sum(2, keepdims=True)
        size = (share * w).sum(1) + mild * np.array([1 - prior, prior])
        log = np.log(size / size.sum())[:, None] + np.einsum("prv,crv->cp", hot, np.log(chance))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(names, post.tolist())), chance


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple = RULES, keep_at: float = KEEP_AT) -> DataFrame:
    """key, the measures, base_failed, quality (posterior), kept of every row."""
    voted = cut(votes(measures(docs, key, text), rules), "rule-votes")
    found = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** rules at most
    post, _ = expectation_maximisation(found, len(rules))
    spark = docs.sparkSession
    table = spark.createDataFrame([(p, float(q)) for p, q in post.items()], "pattern string, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.join(F.broadcast(table), "pattern")  # a row per pattern
    return out.select(key, *MEASURES, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= keep_at)).alias("kept"))
