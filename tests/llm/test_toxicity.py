import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tilewright.llm import queries
from tilewright.llm import toxicity as T

DOCS = "doc_id long, text string, score string, y int, _id int, id string, held int, `vote` int, t int, n int"
REST = ("s", 1, 2, "i", 3, 4, 5, 6)


def dense(index):
    """Every example as a full vector of unit length, in the order of the raw rows."""
    _, _, offsets, terms, counts, gain = index.raw
    out = np.zeros((index.n, len(gain)))
    for i in range(index.n):
        s = slice(offsets[i], offsets[i + 1])
        out[i, terms[s]] = counts[s] * gain[terms[s]]
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


@pytest.mark.parametrize("seed,v,n", [(0, 40, 700), (1, 40, 700), (2, 900, 700), (3, 6, 700), (4, 40, 9), (5, 5000, 300)])
def test_neighbours_equal_a_full_scan(seed, v, n):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, v + 1)

    def one():
        t = np.sort(rng.choice(v, min(v, int(rng.integers(1, 30))), replace=False, p=p / p.sum()))
        return t, rng.integers(1, 5, len(t)).astype(float)

    rows = [one() for _ in range(n)]
    rows[: n // 5] = [rows[0]] * (n // 5)  # repeated rows: ties
    index = T.Index([1000 - i for i in range(n)], np.arange(n) % 2, np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])]), np.concatenate([t for t, _ in rows]), np.concatenate([c for _, c in rows]), rng.random(v) * 4 + 0.1)
    full, ids = dense(index), np.array(index.raw[0])
    queries_ = [one() for _ in range(150)] + [rows[0], (np.zeros(0, np.int64), np.zeros(0))]
    for (t, c), (near, cosine) in zip(queries_, index.nearest(queries_, 15)):
        q = np.zeros(v)
        q[t] = c * index.gain[t]
        every = full @ (q / max(math.sqrt((q * q).sum()), 1e-300))
        want = np.lexsort((ids, -np.round(every, 12)))[:15]
        want = want[every[want] > 1e-12]
        assert [index.ids[i] for i in near] == ids[want].tolist()
        assert np.allclose(cosine, every[want], atol=1e-9)


def test_words_and_terms():
    assert T.words_of("Ab1c_d É-x") == ["ab", "c", "d", "é", "x"] == T.words_of("Ab1c_d É-x—") and T.words_of(None) == []
    texts = ["a bcdef bcdefg " * 3, "ÀÉ ŒUVRE œuvre", "", None, "bcdefzz zz"]
    names = sorted({x for t in texts[:2] for w in T.words_of(t) for x in T.term_names(w)})
    terms = T.Terms({x: i for i, x in enumerate(names)})
    for _ in range(2):  # the second time from the memo
        for t, (at, n) in zip(texts, terms.vectors(texts)):
            want = Counter(x for w in T.words_of(t) for x in T.term_names(w) if x in terms.vocabulary)
            assert dict(zip([names[i] for i in at], n)) == want and at.tolist() == sorted(at)


@pytest.mark.parametrize("gap", [0.0, 1.0, 50.0])
def test_calibration_does_not_diverge(gap):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.1).astype(float)
    x = np.where(y > 0, gap, -gap) + (rng.standard_normal(400) if gap < 50 else 0)
    a, b = T.logistic(x[:, None], y, np.ones(400), [0.0, 1.0])
    loss = lambda a, b: np.logaddexp(0, a + b * x).sum() - (np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)) * (a + b * x)).sum() + 0.5 * (a * a + (b - 1) ** 2)
    grid = min((loss(a + i, b + j), abs(i) + abs(j)) for i in np.linspace(-1, 1, 21) for j in np.linspace(-0.5, 0.5, 21))
    assert 0 <= b < 3 and abs(a) < 6 and grid[1] < 1e-9


def corpus(spark, n=400):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(300)]
    text = lambda bad: " ".join([*rng.choice(vocabulary, 60), *(["nastyword", "uglyword"] if bad else [])])
    return [(i, text(i % 5 == 0), *REST) for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(corpus(spark), DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300)] + [(None, 1), (5, None), (10**9, 1), (7, 0), (7, 0)], "doc_id long, toxic int")
    return docs, T.fit(docs, labels)


def test_held_out_documents(model):
    docs, m = model
    got = {r.doc_id: r.score for r in T.score(docs, m).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(300, 400))
    kept = T.keep_clean(docs, m)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 5] and kept.columns == docs.columns


def test_whole_score_by_a_plain_version(model):
    """Vocabulary, document frequencies, ties, weights, votes and calibration, all anew from the texts."""
    docs, m = model
    rows = docs.collect()
    bag = [Counter(x for w in T.words_of(r.text) for x in T.term_names(w)) for r in rows]
    index, of = m.sent.value.index, {r.doc_id: b for r, b in zip(rows, bag)}
    known = index.raw[0]
    held = [i for i in range(300) if i not in set(known)]
    assert 30 < len(held) < 90
    pos, neg, df = Counter(), Counter(), Counter()
    for b in bag:
        df.update(b.keys())
    for i in known:
        (neg if i % 5 else pos).update(of[i].keys())
    n1, n0 = sum(i % 5 == 0 for i in known), sum(i % 5 > 0 for i in known)
    weight = {}
    for t in {*pos, *neg}:
        chi2 = (n0 + n1) * (pos[t] * (n0 - neg[t]) - neg[t] * (n1 - pos[t])) ** 2 / max(1e-300, (pos[t] + neg[t]) * (n0 + n1 - pos[t] - neg[t]) * n0 * n1)
        weight[t] = (math.log(401 / (df[t] + 1)) + 1) * (T.FLOOR + max(0.0, 1 - T.CHI2 / max(chi2, 1e-9)))
    assert set(weight) == set(m.sent.value.vocabulary)

    def unit(b):
        w = {t: n * weight[t] for t, n in b.items() if t in weight}
        z = math.sqrt(sum(x * x for x in w.values())) or 1
        return {t: x / z for t, x in w.items()}

    examples, per = {i: unit(of[i]) for i in known}, (1.0, (60 / 60) / (240 / 240))

    def vote(b):
        q = unit(b)
        best = sorted(((-round(sum(x * e.get(t, 0) for t, x in q.items()), 12), i) for i, e in examples.items()))[: T.K]
        w = [(-c / (1.05 + c) * per[i % 5 == 0], i % 5 == 0) for c, i in best if c < -1e-12]
        return min(max((sum(x for x, y in w if y) + T.PRIOR_VOTE * 0.2) / (sum(x for x, _ in w) + T.PRIOR_VOTE), 1e-4), 1 - 1e-4)

    odds = lambda v: math.log(v / (1 - v))
    line = T.logistic(np.array([[odds(vote(of[i]))] for i in held]), np.array([float(i % 5 == 0) for i in held]), np.ones(len(held)), [0.0, 1.0])
    assert np.allclose(line, m.line, atol=1e-6)
    got = {r.doc_id: r.score for r in T.score(docs, m).collect()}
    for i in range(300, 400):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(line[0] + line[1] * odds(vote(of[i]))))), abs=1e-6)


def test_evidence(model, spark):
    docs, m = model
    r = T.score(docs.where("doc_id = 305"), m).first()
    assert len(r.neighbours) == len(r.cosines) == T.K and all(i % 5 == 0 for i in r.neighbours[:5])


def test_odd_rows(model, spark):
    _, m = model
    rows = [(1, None), (2, ""), (3, "12 34"), (None, "nastyword uglyword"), (4, "nastyword " * 50_000), (4, "nastyword " * 50_000), (6, "x" * 300_000)]
    df = spark.createDataFrame([(*r, *REST) for r in rows], DOCS)
    got = T.score(df, m).collect()
    assert len(got) == 7 and got[0].score == got[1].score == got[2].score == got[6].score < 0.5 and got[3].score > 0.5 and got[4].score == got[5].score
    assert T.score(df.limit(0), m).count() == 0 and T.keep_clean(df, m).columns == df.columns and T.keep_clean(df.limit(0), m).count() == 0


def test_ids_of_text(spark):
    docs = spark.createDataFrame([(f"d{i}", t, *r) for i, t, *r in corpus(spark, 100)], DOCS.replace("doc_id long", "doc_id string"))
    m = T.fit(docs, spark.createDataFrame([(f"d{i}", int(i % 5 == 0)) for i in range(80)], "doc_id string, toxic int"))
    r = T.score(docs.where("doc_id = 'd95'"), m).first()
    assert r.neighbours and set(r.neighbours) <= {f"d{i}" for i in range(80)}


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(9, 1)]])
def test_labels_of_one_class(spark, labels):
    docs = spark.createDataFrame([(1, "a b", *REST), (2, "c d", *REST)], DOCS)
    labels_ = spark.createDataFrame(labels, "doc_id long, toxic int")
    m = T.fit(docs, labels_)
    assert len({round(r.score, 6) for r in T.score(docs, m).collect()}) == 1
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels_)).count() == 0


def test_held_out_rows_of_the_given_tables(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(labels[i], r.score) for i, r in got.items() if r.held_out and i in labels]
    clean, toxic = [s for y, s in held if not y], [s for y, s in held if y]
    assert np.mean(clean) < 0.2 < 0.5 < np.mean(toxic) and len({round(s, 6) for _, s in held}) > 20


def test_a_task_holds_no_more_than_it_needs():
    """Words without a term are not remembered, and an index that was sent drops what it was built from."""
    import pickle

    terms = T.Terms({"known": 0, "known*": 1})
    assert [v[0].tolist() for v in terms.vectors(["known other known", "knownish", None])] == [[0, 1], [1], []]
    assert set(terms.memo) == {"known", "knownish"}
    index = pickle.loads(pickle.dumps(T.Index([3, 4], [0, 1], [0, 2, 3], [0, 1, 1], [2, 1, 4], np.ones(2))))
    (near, cosine), = index.nearest([(np.array([1]), np.array([1.0]))], 2)
    assert [index.ids[i] for i in near] == [4, 3] and cosine.tolist() == [1.0, round(1 / 5**0.5, 12)]
    assert index.raw is None and index.counts.dtype == np.uint16


@pytest.mark.parametrize("seed", range(3))
def test_postings_of_four_bytes_lose_no_neighbour(seed):
    """Weights are rounded up to 16 bits for the search alone: however small, they count, and cosines are exact."""
    rng = np.random.default_rng(seed)
    v, n = 400, 300
    some = [np.sort(rng.choice(v, 12, replace=False)) for _ in range(n)]
    index = T.Index(list(range(n)), np.arange(n) % 2, 12 * np.arange(n + 1), np.concatenate(some), rng.integers(1, 4, 12 * n), 10.0 ** -rng.uniform(0, 5, v))
    full = dense(index)
    ask = [(t, np.ones(len(t))) for t in some[:40] + [np.array([i]) for i in range(60)]]
    for (t, c), (near, cosine) in zip(ask, index.nearest(ask, 15)):
        q = np.zeros(v)
        q[t] = c * index.gain[t]
        every = full @ (q / np.sqrt((q * q).sum()))
        want = np.lexsort((np.arange(n), -np.round(every, 12)))[:15]
        want = want[every[want] > 1e-12]
        assert [index.ids[i] for i in near] == want.tolist() and np.allclose(cosine, every[want], rtol=0, atol=2e-12)
    assert index.posts.itemsize == 4


def test_words_looked_up_at_once_count_as_by_the_memo():
    """Words of 1 to 20 letters, of Latin-1 and not, alone and at the ends of texts; only what is long or foreign is memoised."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghéßÿ")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(1, 21))))
    known = [word() for _ in range(3000)] + ["abcdefghabcdefgh", "abcdefghabcdefgha", "œuvre", "καλημέρα"]
    names = sorted({x for w in known for x in T.term_names(w)})
    vocabulary = {x: i for i, x in enumerate(names)}
    text = lambda: " ".join([*rng.choice(known[:3000], 20), *(word() for _ in range(20))])
    odd = [None, "", " ", "a", "É", "12 34", "abcdefghabcdefgh", "abcdefghabcdefghab abcdefghabcdefgha", "œuvre abc καλημέρα", "abcdeœ", "abcde*", "ABCDE-Fgh1ab" * 3, "a" * 70_000, "abc " * 70_000]
    texts = [text() for _ in range(200)] + odd + [text()]
    plain, packed = T.Terms(vocabulary), T.Packed(vocabulary)
    for some in (texts, odd, texts[::-1], [None], [], ["œ"]):
        assert all(np.array_equal(x, y) for x, y in zip(plain.count(some), packed.count(some), strict=True))
    assert packed.memo and all(len(w) > 16 for w in packed.memo if w not in T.words_of(" ".join(odd[8:10])))
    assert T.Packed({}).count(["a b", None])[0].size == 0


def test_scoring_asks_the_memo_for_long_words_only(model):
    """The pass over all documents looks its words up in arrays: asking a dictionary for each took most of its time."""
    import pickle

    docs, m = model
    mine = pickle.loads(pickle.dumps(m.sent.value))
    got = mine.judge([r.text for r in docs.orderBy("doc_id").limit(50).collect()] + ["nastyword" * 3])
    assert all(len(near) == T.K for _, near, _ in got[:50]) and set(mine.terms.memo) == {"nastyword" * 3}


@pytest.mark.parametrize("count,size", [(3, 4), (70_000, 8)])
def test_postings_hold_counts(count, size):
    """So their sums need no rounding and no second look at an example's rare terms; counts beyond 16 bits fit, too."""
    n = 40
    index = T.Index(list(range(n)), np.arange(n) % 2, 2 * np.arange(n + 1), np.stack([np.zeros(n, int), 1 + np.arange(n)], 1).ravel(), np.tile([1, count], n), np.ones(n + 1))
    (near, cosine), = index.nearest([(np.array([0, 8]), np.array([2.0, 1.0]))], 2)
    long = math.sqrt(1 + count**2) * math.sqrt(5)
    assert [index.ids[i] for i in near] == [7, 0] and np.allclose(cosine, [(2 + count) / long, 2 / long], rtol=0, atol=2e-12)
    assert index.posts.itemsize == size and (index.posts & ((1 << index.shift) - 1)).tolist() == [count] * n and len(index.counts) == n
