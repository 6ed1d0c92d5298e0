"""Weak supervision and co-training."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import cotrain as C
from tilewright.llm import rules as R

DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality string, kept string"
CLASH = ", id int, y int, held int, bins int, words int, of int, label int, _id int"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0b\x1cÉ", max_size=80))
def test_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    m = dict(zip(R.MEASURES, R.measure(text)))
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)))
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    assert m["n_repeat_words"] == len({j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)})


def test_variety_covers_the_whole_text(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    start, few = [word() for _ in range(800)], [word() for _ in range(12)]
    salad = lambda n: rng.choice(few, n).tolist()
    texts = [start, start + salad(900), start[:450] + salad(410), start[:300], start + ["a"] * 20, []]
    got = [R.measure(" ".join(t))[R.MEASURES.index("n_distinct")] for t in texts]
    slow = [min(len(set(t[i : i + 400])) for i in [*range(0, max(1, len(t) - 399), 400), max(0, len(t) - 400)]) for t in texts]
    assert got == slow and got[0] == 400 and got[1] == got[2] == 12 and got[3] == 300 and got[4] == 381 and got[5] == 0
    df = spark.createDataFrame([(i, " ".join(t), "en", "s", 1, "", "") for i, t in enumerate(texts[:3])], DOCS)
    assert [r.pattern[-1] for r in R.votes(R.measures(df)).orderBy("doc_id").collect()] == ["2", "1", "1"]


def test_em_finds_the_rules_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    right, speaks = np.array([0.95, 0.9, 0.7, 0.55]), np.array([0.9, 0.5, 1.0, 1.0])
    v = np.where(rng.random((20_000, 4)) < right, good[:, None], ~good[:, None]) + 1
    v = np.where(rng.random((20_000, 4)) < speaks, v, 0)
    patterns = Counter("".join(map(str, r)) for r in v.tolist())
    post, chance = R.expectation_maximisation(patterns, 4)
    got = np.array([post["".join(map(str, r))] >= 0.5 for r in v.tolist()])
    assert (got == good).mean() > 0.93
    assert abs(chance[1, :2, 2] / chance[1, :2, 1:].sum(1) - right[:2]).max() < 0.06
    assert R.expectation_maximisation({}, 4)[0] == {}


def slow_em(patterns, n, rounds):
    """The same model document by document."""
    docs = [list(map(int, p)) for p, k in sorted(patterns.items()) for _ in range(k)]
    post = [min(max((r.count(2) + 2 * R.PRIOR) / (r.count(2) + 2 * r.count(1) + 2), 0.02), 0.98) for r in docs]
    mild = max(1.0, 0.01 * len(docs))
    for _ in range(rounds):
        chance, size = [], []
        for c, pseudo, own in ((0, (1.0, 2.0, 1.0), 1 - R.PRIOR), (1, (1.0, 0.2, 3.0), R.PRIOR)):
            share = [p if c else 1 - p for p in post]
            size.append(sum(share) + mild * own)
            rows = []
            for r in range(n):
                k = [mild * 0.2 * pseudo[v] + sum(s for s, d in zip(share, docs) if d[r] == v) for v in range(3)]
                rows.append([x / sum(k) for x in k])
            chance.append(rows)
        like = [[size[c] * np.prod([chance[c][r][d[r]] for r in range(n)]) for c in (0, 1)] for d in docs]
        post = [b / (a + b) for a, b in like]
    return {"".join(map(str, d)): p for d, p in zip(docs, post)}


def test_em_on_counts_equals_documents():
    patterns = {"222": 30, "221": 6, "111": 8, "011": 3, "202": 4}
    fast, slow = R.expectation_maximisation(patterns, 3, rounds=7)[0], slow_em(patterns, 3, 7)
    assert all(abs(fast[p] - slow[p]) < 1e-6 for p in patterns)


def sample(spark, n=600):
    rng = np.random.default_rng(4)
    word = lambda: "".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9)))))
    rows = []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(60, 160)))]
        text = " ".join(w + " |" for w in words) if i % 6 == 0 else ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "."
        rows.append((i, text, "en", f"s{i % 4}", len(text), "q", "k"))
    return spark.createDataFrame(rows, DOCS)


def test_rules_on_documents(spark):
    got = {r.doc_id: r for r in R.judge(sample(spark)).collect()}
    assert len(got) == 600 and all(r.kept == (i % 6 != 0) for i, r in got.items())


def test_cotraining_on_documents(spark):
    docs = sample(spark)
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(0, 600, 3)] + [(None, 1), (4, None), (10**9, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in C.judge(docs, labels).collect()}
    assert np.mean([got[i] == (i % 6 != 0) for i in range(600)]) > 0.98
    kept = C.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, p in got.items() if p}


class Plain:
    """Co-training document by document, with dictionaries of counts."""

    def __init__(self, docs, labels, rounds=C.ROUNDS):
        self.rows = {r.doc_id: (C.text_bins(r.text, dict(zip(R.MEASURES, R.measure(r.text)))), C.buckets(r.text).tolist(), C.meta_bins(r.source, r.lang, r.n_chars)) for r in docs.collect()}
        held = {i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0}
        known = {i: y for i, y in labels.items() if i not in held and i in self.rows}
        free = [i for i in self.rows if i not in labels]
        votes = ([], [])
        for _ in range(rounds + 1):
            each = [(i, y, 1.0) for i, y in known.items()]
            self.text, self.meta = self.table([(*e, 0) for e in each + votes[0]]), self.table([(*e, 1) for e in each + votes[1]])
            odds = {i: self.odds(i) for i in free}
            votes = [(i, int(o[2] > 0), C.PSEUDO_WEIGHT) for i, o in odds.items() if abs(o[2]) >= C.CONFIDENT], [(i, int(o[0] + o[1] > 0), C.PSEUDO_WEIGHT) for i, o in odds.items() if abs(o[0] + o[1]) >= C.CONFIDENT]
        self.taught = len(votes[0]), len(votes[1])
        near = lambda v: round((min(max(v, -C.REACH), C.REACH) + C.REACH) / C.STEP) * C.STEP - C.REACH
        cal = [(*map(near, self.odds(i)), labels[i]) for i in sorted(held) if i in self.rows]
        y, w = np.array([r[3] for r in cal]), np.ones(len(cal))
        positive = lambda line: [line[0], *np.maximum(line[1:], 0)]
        t = positive(C.logistic(np.array([r[:2] for r in cal]), y, w, [0.0, 0.5, 0.1]))
        m = positive(C.logistic(np.array([[r[2]] for r in cal]), y, w, [0.0, 0.2]))
        self.lines = t, m, positive(C.logistic(np.array([[t[0] + t[1] * r[0] + t[2] * r[1], m[0] + m[1] * r[2]] for r in cal]), y, w, [0.0, 1.0, 0.2]))

    def table(self, rows):
        feature, word = [[[0.5] * 2 for _ in range(C.BINS)] for _ in range(C.N_ALL)], [[C.SMOOTH] * 2 for _ in range(C.BUCKETS)]
        for i, y, w, view in rows:
            bins, words, meta = self.rows[i]
            for f, b in enumerate(meta if view else bins):
                feature[f][b][y] += w
            for k in [] if view else words:
                word[k][y] += w
        return feature, word

    def odds(self, i):
        bins, words, meta = self.rows[i]
        of = lambda rows, k: math.log(rows[k][1] / sum(r[1] for r in rows)) - math.log(rows[k][0] / sum(r[0] for r in rows))
        if not hasattr(self, "sums") or self.sums[0] is not self.text:
            word = self.text[1]
            total = [sum(r[y] for r in word) for y in (0, 1)]
            self.sums = self.text, [math.log(r[1] / total[1]) - math.log(r[0] / total[0]) for r in word]
        mean = sum(self.sums[1][k] for k in words) / max(1, len(words))
        return sum(of(self.text[0][f], b) for f, b in enumerate(bins)), C.WORDS * mean, sum(of(self.meta[0][f], b) for f, b in enumerate(meta))

    def score(self, i):
        a, b, c = (min(max(v, -C.REACH), C.REACH) for v in self.odds(i))
        t, m, both = self.lines
        z = both[0] + both[1] * (t[0] + t[1] * a + t[2] * b) + both[2] * (m[0] + m[1] * c)
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_cotraining_equals_a_plain_version(spark):
    rng = np.random.default_rng(9)
    rows = []
    for r in sample(spark, 300).collect():
        # half of the documents come from a source that tells their quality, so the metadata teaches the text as well
        bad = r.doc_id % 6 == 0
        rows.append((r.doc_id, r.text, "xx" if bad else "en", ("bad" if bad else "fine") if r.doc_id % 4 else "any", int(rng.integers(1, 9000)), "q", "k"))
    docs = spark.createDataFrame(rows, DOCS)
    labels = {i: int(i % 6 != 0) for i in range(0, 300, 2)}
    plain = Plain(docs, labels)
    assert min(plain.taught) > 20  # both views teach
    got = {r.doc_id: r.score for r in C.judge(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    assert all(abs(got[i] - plain.score(i)) < 1e-6 for i in range(300))


def test_only_labelled_rows_are_held_out(spark):
    docs = sample(spark, 200)
    table = C.labelled(C.features(docs), spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(100)], "doc_id long, quality int"))
    left = {r.id for r in table.where("not held or y is null").collect()}
    assert left == {i for i in range(200) if i >= 100 or zlib.crc32(str(i).encode()) % 5}


def test_given_tables(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r.predicted for r in C.judge(spark.read.parquet(f"{d}/documents.parquet"), labels.select("doc_id", "quality")).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, "", ""), (2, "", "en", "s", 0, "", ""), (None, "word " * 40_000, "en", "s", 5, "", ""), (3, "a b", "en", "s", 3, "", ""), (3, "a b", "en", "s", 3, "", "")]
    df = spark.createDataFrame([(*r, *range(8)) for r in rows], DOCS + CLASH)
    assert R.judge(df).count() == 5 and {r.base_failed for r in R.judge(df).collect() if r.doc_id in (1, 2, 3)} == {True}
    for labels in ([], [(1, 1)], [(1, 0)], [(1, 0), (3, 1)], [(1, 0), (3, 1), (2, 1), (2, 0)]):
        lab = spark.createDataFrame(labels, "doc_id long, quality int")
        assert C.judge(df, lab).count() == 5 and C.judge(df.limit(0), lab).count() == 0
        assert C.keep_good(df, lab).columns == df.columns and C.keep_good(df.limit(0), lab).count() == 0
    assert R.judge(df.limit(0)).count() == 0
