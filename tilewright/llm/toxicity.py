"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their first five letters; all terms of the labelled examples are indexed, none is left out.
Document frequencies are counted over all documents. A term's weight is tf times idf times its tie to the label among the
examples (1 - `CHI2` / chi-squared, at least 0) plus `FLOOR`, so words that say nothing about the label count little, but
count, in vectors and norms alike. (Plain tf-idf ranks held-out documents clearly worse; the README has figures.)

Examples lie in blocks, alike ones together. Terms that many examples have are stored as dense rows of each block with
their largest weight, the others as postings. The bound of a block is the best of its examples by the postings alone plus
what the dense terms can add at most. Blocks are scored in the order of their bounds until no bound reaches the k-th best
cosine, and the best are scored once more in double precision: the neighbours are those of a full scan. Their
distance-weighted votes, with the base rate as a small vote of its own, are calibrated on one in five examples, which
neither the index nor the ties to the label have seen.

The examples are a bounded sample (`MOST_TOXIC`, `MOST_CLEAN`, by a hash of the id); what travels to every task is their
terms. Everything else covers all rows.

Defined results: a null or empty text, or one that shares no term with the examples, has no neighbours and scores the
calibrated base rate; labels that are null, or of documents that aren't there, are ignored; an id that is labelled twice
counts as toxic if one label says so, and of documents that share an id the smallest text is the example; with no labels,
or with one class only, all scores are the base rate (0 with no labels); ties between neighbours go to the smaller id;
repeated rows give equal rows; a very long text is one bag of words like any other; an empty table gives an empty result;
other columns pass through `keep_clean` whatever their names, and `score` ignores them. Ids may be of any type.
"""

from __future__ import annotations

import ctypes
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import cut, logistic, pieces

MOST_TOXIC, MOST_CLEAN = 4000, 8000
#: Neighbours, examples of a block, weight of the base rate among votes, and one in so many examples for calibration.
K, BLOCK, PRIOR_VOTE, HELD = 15, 64, 0.25, 5
#: What ties a term to the label: chi-squared at which a tie begins to count, and the weight of terms without any.
CHI2, FLOOR = 20.0, 0.02
#: Terms that at least one in so many examples have are dense, the most frequent ones at most; blocks scored at first.
DENSE_SHARE, DENSE_MOST, FIRST = 16, 2048, 4
#: Directions onto which examples are projected to tell which are alike.
SKETCH = 64
#: Texts scored together, terms whose counts travel together, words that the memo keeps, postings of a short run.
TOGETHER, SLICE, MEMO, FEW = 256, 4096, 250_000, 128
#: Beyond what single precision can be wrong by.
MARGIN = 2e-5
_WORD = re.compile(r"[^\W\d_]+")


#: Of a word, letters that make a term of their own; words of the examples count by both.
START = 5


def term_names(word: str) -> tuple[str, ...]:
    """A word's terms: itself, and its first letters."""
    return (word, f"{word[:START]}*") if len(word) >= START else (word,)


#: For texts of Latin-1: letters in lower case, all else white space.
_PLAIN = bytes(ord(c.lower()) if _WORD.fullmatch(c := chr(i)) else 32 for i in range(256))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(_PLAIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


#: The first n of 8 bytes, and the mark that ends a term of first letters, in its place.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STAR = np.uint64(ord("*") << 8 * START)


class Memo(dict):
    """Of words that were met, one number for a word's two terms: 0 if it has neither, which is not kept."""

    def __init__(self, vocabulary: dict[str, int]):
        self.of, self.size = vocabulary.get, len(vocabulary) + 1

    def __missing__(self, word: str) -> int:
        got = (self.of(word, -1) + 1) * self.size + (self.of(word[:START] + "*", -1) + 1 if len(word) >= START else 0)
        if got and len(word) <= 40:
            self[word] = got
        return got


class Terms:
    """Counts of a vocabulary's terms in whole texts."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.size, self.memo = vocabulary, len(vocabulary) + 1, Memo(vocabulary)

    def found(self, texts: list[str | None]) -> np.ndarray:
        """Each place of a term: its text's number times `size`, and the term's number from 1; in no order."""
        words = [words_of(t) for t in texts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        return self._both(np.repeat(np.arange(len(texts)) * self.size, size), np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat)))

    def _both(self, text: np.ndarray, both: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(both)
        text, (whole, start) = text[some], np.divmod(both[some], self.size)
        return np.concatenate([(text + whole)[whole > 0], (text + start)[start > 0]])

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts one after the other: terms in ascending order, their counts, and where each text's begin."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        keys, n = np.unique(self.found(texts), return_counts=True)
        return keys % self.size - 1, n.astype(np.float64), np.searchsorted(keys, np.arange(len(texts) + 1) * self.size)

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms in ascending order and their counts, of each text."""
        t, n, begin = self.count(texts)
        return [(t[a:b], n[a:b]) for a, b in zip(begin.tolist(), begin[1:].tolist())]


class Packed(Terms):
    """The same counts for many texts: words of Latin-1 of at most 16 letters are two numbers of 8 bytes each, their letters,
    and all of several texts are looked up at once, by all their letters, in a hash table of arrays. Other words take the
    memo. The table is built where it is first used."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__(vocabulary)
        self.key: np.ndarray | None = None

    def __reduce__(self):
        return Packed, (self.vocabulary,)

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a ^ b * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def build(self) -> None:
        key, value, terms = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int32)], iter(self.vocabulary.items())
        while some := [(t.encode("latin-1", "ignore"), t, i) for t, i in islice(terms, 1 << 15)]:
            some = [(b, i + 1) for b, t, i in some if 0 < len(b) == len(t) <= 16]
            key.append(np.array([b for b, _ in some], "S16").view("<u8").reshape(-1, 2))
            value.append(np.array([i for _, i in some], np.int32))
        key, value = np.concatenate(key), np.concatenate(value)
        self.bits = max(4, len(key).bit_length() + 1)  # half full at most
        self.key, self.value = np.zeros((1 << self.bits, 2), np.uint64), np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(key))
        at = self._place(key[:, 0], key[:, 1])
        while len(left):  # each goes to the first free place from its own on
            free = self.value[at] == 0
            self.value[at[free]] = value[left[free]]  # of several one stays
            own = self.value[at] == value[left]
            self.key[at[own]] = key[left[own]]
            left, at = left[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers from 1 of the terms with these letters, 0 for others."""
        at, out, left = self._place(a, b), np.zeros(len(a), np.int64), np.arange(len(a))
        while len(left):
            there, value = self.key.take(at, 0), self.value.take(at)
            same = (there[:, 0] == a) & (there[:, 1] == b)
            out[left[same]] = value[same]
            on = np.flatnonzero(~same & (value > 0))
            left, a, b, at = left[on], a[on], b[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def found(self, texts: list[str | None]) -> np.ndarray:
        if self.key is None:
            self.build()
        plain, other = [], [None] * len(texts)
        for i, t in enumerate(texts):
            try:
                plain.append((t or "").encode("latin-1").translate(_PLAIN))
            except UnicodeEncodeError:
                plain.append(b"")
                other[i] = t
        out = [super().found(other)] if any(other) else []
        raw = b" ".join([b"", *plain, b" " * 16])
        letter = np.frombuffer(raw, np.uint8) != 32
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        begin, size = edge[::2], edge[1::2] - edge[::2]
        of = np.searchsorted(begin, np.cumsum([1, *(len(p) + 1 for p in plain)]))
        text = np.repeat(np.arange(len(texts)) * self.size, np.diff(of))
        eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))  # the 8 bytes from each byte on
        first = eight[begin]
        a, b = first & _MASK.take(size, mode="clip"), np.zeros(len(begin), np.uint64)
        long = np.flatnonzero(size > 8)
        b[long] = eight[begin[long] + 8] & _MASK.take(size[long] - 8, mode="clip")
        whole = self._find(a, b)
        whole[size > 16] = 0
        started = np.flatnonzero((size >= START) & (size <= 16))
        start = self._find(first[started] & _MASK[START] | _STAR, np.zeros(len(started), np.uint64))
        out += [(text + whole)[whole > 0], (text[started] + start)[start > 0]]
        long = np.flatnonzero(size > 16)
        if len(long):
            words = [raw[x : x + n].decode("latin-1") for x, n in zip(begin[long].tolist(), size[long].tolist())]
            out.append(self._both(text[long], np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))))
        return np.concatenate(out)


def _bisect(x: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows in which alike ones share a block: halves along the direction of the largest spread."""
    order, parts = np.arange(len(x)), [(0, len(x))]
    while parts:
        a, b = parts.pop()
        if b - a <= block:
            continue
        own = x[order[a:b]]
        own = own - own.mean(0)
        v = own[int(np.argmax((own * own).sum(1)))]
        for _ in range(4):
            v = own.T @ (own @ v)
            size = float(np.sqrt((v * v).sum()))
            if not size:
                break
            v = v / size
        order[a:b] = order[a:b][np.argsort(own @ v, kind="stable")]
        middle = a + max(1, (b - a) // block // 2) * block
        parts += [(a, middle), (middle, b)]
    return order


def released() -> None:
    """Gives freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):
        pass


class Index:
    """The examples by block. It is built where it is first used, from the examples' terms alone."""

    def __init__(self, ids: list, labels: np.ndarray, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, gain: np.ndarray):
        """Example i has terms[offsets[i] : offsets[i + 1]] (ascending), counts alike; gain: idf times tie, per term."""
        self.raw = ids, np.asarray(labels, np.float64), np.asarray(offsets, np.int64), np.asarray(terms, np.int32), np.asarray(counts, np.int32), np.asarray(gain, np.float64)
        self.n, self.built, self.sent = len(ids), False, False

    def __getstate__(self):
        return {"raw": self.raw, "n": self.n, "built": False, "sent": True}

    def build(self) -> None:
        if self.built:
            return
        ids, labels, offsets, terms, counts, gain = self.raw
        if self.sent:  # a task needs what it was built from no more
            self.raw = None
        n, size = self.n, np.diff(offsets)
        weight, norm = np.empty(len(terms), np.float32), np.empty(n)
        for a in range(0, n, 512):
            own, part = slice(offsets[a], offsets[min(a + 512, n)]), slice(a, min(a + 512, n))
            who, w = np.repeat(np.arange(len(size[part])), size[part]), counts[own] * gain[terms[own]]
            norm[part] = np.sqrt(np.bincount(who, w * w, len(size[part])))
            norm[part][norm[part] == 0] = 1.0
            weight[own] = w / norm[part][who]
        df = np.bincount(terms, minlength=len(gain))
        often = np.argsort(-df, kind="stable")[:DENSE_MOST]
        often = np.sort(often[df[often] * DENSE_SHARE >= max(n, 1)])
        self.dense = np.full(len(gain), -1, np.int32)
        self.dense[often] = np.arange(len(often))
        random = np.random.default_rng(1).standard_normal((len(often), SKETCH)).astype(np.float32)

        def dense(a: int, b: int) -> np.ndarray:
            """The dense terms' weights of examples a to b."""
            full, own = np.zeros((b - a, len(often)), np.float32), slice(offsets[a], offsets[b])
            column = self.dense[terms[own]]
            full[np.repeat(np.arange(b - a), size[a:b])[column >= 0], column[column >= 0]] = weight[own][column >= 0]
            return full

        sketch = np.concatenate([dense(a, min(a + 512, n)) @ random for a in range(0, n, 512)])
        order = _bisect(sketch, BLOCK)  # distances between rows are about those between their projections
        # by block: ids, labels, and each example's own terms
        self.ids, self.labels, self.norm = [ids[i] for i in order], labels[order], norm[order]
        own = [slice(offsets[i], offsets[i + 1]) for i in order.tolist()]
        size = size[order]
        # an example's place, and how often it has the term, in one number: a term's postings are one run
        small = counts.max(initial=0) <= 0xFFFF and n <= 1 << 16
        kind, self.shift = (np.uint32, 16) if small else (np.int64, 32)
        counts = counts.astype(np.uint16 if small else np.int32)
        counts, weight, terms = (np.concatenate([some[x] for x in own]) for some in (counts, weight, terms))
        offsets = np.concatenate([[0], np.cumsum(size)])
        self.blocks = max(1, -(-n // BLOCK))
        self.rows = np.zeros((self.blocks, len(often), BLOCK), np.float32)  # block, dense term, example
        for i, a in enumerate(range(0, n, BLOCK)):
            self.rows[i, :, : min(BLOCK, n - a)] = dense(a, min(a + BLOCK, n)).T
        self.top = np.ascontiguousarray(self.rows.max(2).T)
        del weight
        rare = np.flatnonzero(self.dense[terms] < 0).astype(np.int32)
        rare = rare[np.argsort(terms[rare], kind="stable")]
        self.posts = (np.searchsorted(offsets, rare, "right") - 1).astype(kind)
        self.posts <<= kind(self.shift)
        self.posts |= counts[rare]
        self.start = np.searchsorted(terms[rare], np.arange(len(gain) + 1))
        # the dense ones once more with their counts, for sums in double precision; those of postings are that anyway
        some = np.flatnonzero(self.dense[terms] >= 0)
        self.columns, self.counts = self.dense[terms[some]].astype(np.uint16), counts[some]
        self.begin = np.searchsorted(some, offsets)
        self.long = np.ones(self.blocks * BLOCK)  # lengths, of the blocks' empty places too
        self.long[:n] = self.norm
        self.gain, self.built = gain, True
        rank = sorted(range(n), key=lambda i: (str(type(self.ids[i])), self.ids[i]))
        self.rank = np.empty(n, np.int64)
        self.rank[rank] = np.arange(n)
        del dense, terms, counts
        released()

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (terms, counts): positions and cosines of the k nearest with a cosine over 0, best first."""
        self.build()
        out = []
        for at in range(0, len(vectors), TOGETHER):
            out += self._nearest(vectors[at : at + TOGETHER], k)
        return out

    def _nearest(self, vectors: list, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        m, wide = len(vectors), self.blocks * BLOCK
        query, score = np.zeros((m, self.rows.shape[1]), np.float32), np.zeros((m, wide))
        exactly = np.zeros(query.shape)  # of dense terms, what to multiply counts with
        length = [len(t) for t, _ in vectors]
        row, t = np.repeat(np.arange(m), length), np.concatenate([t for t, _ in vectors])
        w = np.concatenate([n for _, n in vectors]) * self.gain[t]
        norm = np.sqrt(np.bincount(row, w * w, m))
        norm[norm == 0] = 1.0
        w /= norm[row]
        place = self.dense[t]
        some, rare = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        query[row[some], place[some]] = w[some]
        w *= self.gain[t]
        exactly[row[some], place[some]] = w[some]
        size = self.start[t[rare] + 1] - self.start[t[rare]]
        # by query, first the terms of few postings: theirs are gathered, the long runs copied
        part = (2 * row[rare] + (size > FEW)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        rare, size, part = rare[order], size[order], part[order]
        begin, share = self.start[t[rare]], w[rare]
        parts = np.searchsorted(part, np.arange(2 * m + 1)).tolist()
        for i in range(m):
            x, y, z = parts[2 * i : 2 * i + 3]
            if x == z:
                continue
            both = list(map(self.posts.__getitem__, map(slice, begin[y:z].tolist(), (begin[y:z] + size[y:z]).tolist())))
            if x < y:
                end = np.cumsum(size[x:y])
                both.insert(0, self.posts[np.arange(end[-1]) + np.repeat(begin[x:y] + size[x:y] - end, size[x:y])])
            both = np.concatenate(both)
            each = np.repeat(share[x:z], size[x:z])
            each *= both & ((1 << self.shift) - 1)
            np.divide(np.bincount(both >> self.shift, each, wide), self.long, score[i])
        by_block = score.reshape(m, self.blocks, BLOCK)
        bound = by_block.max(2) + query @ self.top + MARGIN
        done = np.zeros((m, self.blocks), bool)
        exact = np.zeros((m, wide), np.float32)
        k = min(k, self.n)

        def fill(need: np.ndarray) -> None:
            for b in np.flatnonzero(need.any(0)).tolist():
                rows = np.flatnonzero(need[:, b])
                exact[rows, b * BLOCK : (b + 1) * BLOCK] = by_block[rows, b] + query[rows] @ self.rows[b]
            done[need] = True

        top = np.argsort(-bound, 1, kind="stable")[:, :FIRST]
        first = np.zeros_like(done)
        np.put_along_axis(first, top, True, 1)
        fill(first)
        some = np.take_along_axis(exact.reshape(m, self.blocks, BLOCK), top[:, :, None], 1).reshape(m, -1)
        least = np.partition(some, some.shape[1] - min(k, some.shape[1]), 1)[:, some.shape[1] - min(k, some.shape[1])]
        fill((bound >= np.maximum(least - MARGIN, MARGIN)[:, None]) & ~done)
        out = []
        for x, l, rough, q in zip(exact, least.tolist(), score, exactly):
            near = np.flatnonzero(x >= max(l - 2 * MARGIN, 1e-12))
            if len(near) > k:  # the k-th best of all is at least that of the first blocks
                own = x[near]
                near = near[own >= np.partition(own, len(own) - k)[len(own) - k] - 2 * MARGIN]
            out.append(self._exactly(q, rough[near], near, k))
        return out

    def _exactly(self, query: np.ndarray, cosine: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines with some examples in double precision, of which the postings' part is there; the best k, of equal ones
        the smaller ids."""
        begin, size = self.begin[near], self.begin[near + 1] - self.begin[near]
        some = np.flatnonzero(size)
        if len(some):
            own = list(map(slice, begin.tolist(), (begin + size).tolist()))
            weight = query.take(np.concatenate(list(map(self.columns.__getitem__, own))), mode="clip")  # nothing is out of bounds, so nothing need be checked
            weight *= np.concatenate(list(map(self.counts.__getitem__, own)))
            cosine[some] += np.add.reduceat(weight, (np.cumsum(size) - size)[some]) / self.norm[near[some]]
        order = np.lexsort((self.rank[near], -np.round(cosine, 12)))[:k]
        order = order[cosine[order] > 1e-12]
        return near[order], np.round(cosine[order], 12)


class Model:
    def __init__(self, vocabulary: dict[str, int], index: Index, weight: tuple[float, float], base: float):
        """weight: of a clean and of a toxic example, for the parts of each class that the sample holds."""
        self.vocabulary, self.index, self.weight, self.base = vocabulary, index, weight, base
        self.line = (0.0, 1.0)
        self.terms: Terms | None = None

    def __getstate__(self):
        return self.__dict__ | {"terms": None}

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """The share of toxic neighbours, the near ones counting more, and the base rate with a small vote of its own."""
        y = self.index.labels[near] if len(near) else np.zeros(0)
        w = cosine / (1.05 - np.minimum(cosine, 1.0)) * np.where(y > 0, self.weight[1], self.weight[0])
        v = (float((w * y).sum()) + PRIOR_VOTE * self.base) / (float(w.sum()) + PRIOR_VOTE)
        return min(max(v, 1e-4), 1 - 1e-4)

    def calibrated(self, vote: float, line: tuple[float, float]) -> float:
        return 1 / (1 + math.exp(-min(max(line[0] + line[1] * math.log(vote / (1 - vote)), -30), 30)))

    def judge(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each text the vote before calibration, and positions and cosines of its neighbours."""
        if not self.index.n:
            return [(min(max(self.base, 1e-4), 1 - 1e-4), np.zeros(0, np.int64), np.zeros(0)) for _ in texts]
        if self.terms is None:
            self.terms = Packed(self.vocabulary)
        out = []
        for at in range(0, len(texts), TOGETHER):
            found = self.index.nearest(self.terms.vectors(texts[at : at + TOGETHER]))
            out += [(self.vote(near, cosine), near, cosine) for near, cosine in found]
        return out

    def scores(self, votes: list[float], line: tuple[float, float]) -> list[float]:
        return [self.calibrated(v, line) if self.index.n else self.base for v in votes]


class Fitted:
    """A model that is on its way to every task, and the line that calibrates it."""

    def __init__(self, sent, line: tuple[float, float]):
        self.sent, self.line = sent, line


def _narrow(df: DataFrame, columns: list, work, schema: str) -> DataFrame:
    """work gets the slices of all batches of a partition and gives batches."""
    return df.select(*columns).mapInArrow(lambda batches: work(pieces(batches)), schema)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = Counter(), Counter()
    for batch in batches:
        for y, t in zip(batch[0].to_pylist(), batch[1].to_pylist()):
            both[y].update(set(chain.from_iterable(map(term_names, set(words_of(t))))))
    names = list({**both[0], **both[1]})
    for at in range(0, len(names), 1 << 16):
        some = names[at : at + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"term": some, "pos": pa.array([both[1][x] for x in some], pa.int64()), "neg": pa.array([both[0][x] for x in some], pa.int64())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that come sorted by slice, the sums of the counts; one slice is held at a time."""
    at, held = None, None

    def give():
        return pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "n": pa.array([held.tobytes()], pa.binary())})

    for batch in batches:
        for s, raw in zip(batch[0].to_pylist(), batch[1].to_pylist()):
            if s != at:
                if at is not None:
                    yield give()
                at, held = s, np.zeros(len(raw) // 8, np.int64)
            held += np.frombuffer(raw, np.int64)
    if at is not None:
        yield give()


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int], text: str = "text") -> tuple[int, np.ndarray]:
    """Rows of docs, and of how many each term is a part. A task sends one number per term, whatever its number of rows."""
    size = len(vocabulary) + 1
    sent = docs.sparkSession.sparkContext.broadcast(Packed(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = sent.value, np.zeros(-(-size // SLICE) * SLICE, np.int64)
        for batch in batches:
            n[size - 1] += batch.num_rows
            for part in pieces([batch], TOGETHER):
                np.add.at(n, terms.count(part[0].to_pylist())[0], 1)
        for s, part in enumerate(n.reshape(-1, SLICE)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "n": pa.array([part.tobytes()], pa.binary())})

    parts = _narrow(docs, [F.col(text).alias("text")], count, "slice int, n binary")
    total = np.zeros(-(-size // SLICE) * SLICE, np.int64)
    for r in parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(_added, "slice int, n binary").collect():  # 8 bytes a term
        total[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["n"], np.int64)
    sent.destroy()
    return int(total[size - 1]), total[: size - 1]


def _sample(there: DataFrame) -> DataFrame:
    """At most so many of each class, the first by a hash of the id. there: id, y."""
    part = lambda y, n: there.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    return part(1, MOST_TOXIC).unionByName(part(0, MOST_CLEAN))


def ties(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """FLOOR, and beyond it what a term's chi-squared against the label says: 0 up to CHI2, towards 1 above."""
    n = float(n0 + n1)
    spread = (pos + neg) * (n - pos - neg) * n0 * n1
    chi2 = n * (pos * (n0 - neg) - neg * (n1 - pos)) ** 2 / np.where(spread > 0, spread, 1.0)
    return FLOOR + np.maximum(0.0, 1 - CHI2 / np.maximum(chi2, 1e-9))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Fitted:
    """labels: rows of (key, label) to learn from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    one = labels.select(F.col(key).alias("id"), F.col(label).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    there = cut(one.join(rows.select("id"), "id", "left_semi"), "tox-labels")
    whole = {r["y"]: r["n"] for r in there.groupBy("y").agg(F.count("*").alias("n")).collect()}
    neg, pos = whole.get(0, 0), whole.get(1, 0)
    base = pos / max(1, pos + neg)
    own = F.broadcast(_sample(there))  # MOST_TOXIC + MOST_CLEAN rows at most
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(HELD)) == 0
    examples = cut(rows.join(own, "id").groupBy("id", "y").agg(F.min("text").alias("text")).withColumn("held", held), "tox-examples")
    sizes = {(r["y"], r["held"]): r["n"] for r in examples.groupBy("y", "held").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get((0, False), 0), sizes.get((1, False), 0)
    known = examples.where("not held")
    if not n0 or not n1:
        empty = Index([], np.zeros(0), np.zeros(1), np.zeros(0), np.zeros(0), np.zeros(0))
        return Fitted(spark.sparkContext.broadcast(Model({}, empty, (1.0, 1.0), base)), (0.0, 1.0))
    found = _narrow(known, ["y", "text"], _frequencies, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).orderBy("term").toArrow()
    vocabulary = dict(zip(found["term"].to_pylist(), range(found.num_rows)))
    n, df = document_frequencies(rows, vocabulary)
    gain = (np.log((n + 1) / (df + 1)) + 1) * ties(found["pos"].to_numpy().astype(np.float64), found["neg"].to_numpy().astype(np.float64), n1, n0)
    del found
    sent = spark.sparkContext.broadcast(Packed(vocabulary))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sent.value.vectors(batch[2].to_pylist())
            raw = lambda i: pa.array([g[i].astype(np.int32).tobytes() for g in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], raw(0), raw(1)], ["id", "y", "t", "n"])

    kind = dict(rows.dtypes)["id"]
    got = _narrow(known, ["id", "y", "text"], vectors, f"id {kind}, y int, t binary, n binary").orderBy("id").toArrow()
    sent.destroy()
    terms, counts = (np.concatenate([np.frombuffer(b.as_buffer(), np.int32) for b in got[c]]) for c in ("t", "n"))
    sizes_of = np.array([len(b.as_buffer()) // 4 for b in got["t"]], np.int64)
    index = Index(got["id"].to_pylist(), got["y"].to_numpy(), np.concatenate([[0], np.cumsum(sizes_of)]), terms, counts, gain)
    took = {y: sum(v for (a, _), v in sizes.items() if a == y) for y in (0, 1)}
    share = neg / took[0], pos / took[1]
    weight = share[0] / max(share), share[1] / max(share)
    model = spark.sparkContext.broadcast(Model(vocabulary, index, weight, base))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"y": batch[0], "vote": pa.array([v for v, *_ in model.value.judge(batch[1].to_pylist())], pa.float64())})

    cast = _narrow(examples.where("held"), ["y", "text"], votes, "y int, vote double").orderBy("vote", "y").collect()  # one in HELD examples
    v, y = np.array([r["vote"] for r in cast]), np.array([r["y"] for r in cast], np.float64)
    line = logistic(np.log(v / (1 - v))[:, None], y, np.where(y > 0, weight[1], weight[0]), [0.0, 1.0])
    return Fitted(model, (float(line[0]), float(line[1])))


def score(docs: DataFrame, fitted: Fitted, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, neighbours (ids of the nearest examples), cosines."""
    sent, line, kind = fitted.sent, fitted.line, dict(docs.select(F.col(key)).dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = m.judge(batch[1].to_pylist())
            ids = [[m.index.ids[i] for i in near.tolist()] for _, near, _ in got]
            arrays = [batch[0], pa.array(m.scores([v for v, *_ in got], line), pa.float64()), pa.array(ids, pa.list_(batch[0].type)), pa.array([c.tolist() for *_, c in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [key, "score", "neighbours", "cosines"])

    return _narrow(docs, [F.col(key), F.col(text).alias("text")], work, f"`{key}` {kind}, score double, neighbours array<{kind}>, cosines array<double>")


def keep_clean(docs: DataFrame, fitted: Fitted, text: str = "text", at: float = 0.5) -> DataFrame:
    """The rows whose score is under at, with all their columns; a narrow pass."""
    sent, line, place = fitted.sent, fitted.line, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in pieces(batches):
            scores = m.scores([v for v, *_ in m.judge(batch[place].to_pylist())], line)
            yield batch.filter(pa.array([s < at for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
