import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import repair as R
from tilewright.llm.queries import BYTE_BPE, byte_pattern, tokenizer_file


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 3000), st.sampled_from([1, 2, 20, 50_000]), st.integers(2, 6))
def test_round_trip(seed, n, ids, least):
    rng = np.random.default_rng(seed)
    x = (rng.zipf(1.3, n) % ids).astype(np.uint32)
    first, rules, seq = R.compress(x, least)
    assert (R.expand(seq, first, rules) == x).all() and len(seq) <= len(x)
    # no pair is left that occurs least times without overlap, and no rule is for a pair that occurred less often
    left, at = Counter(), 0
    for key, run in groupby(zip(seq.tolist(), seq[1:].tolist())):
        left[key] += (len(list(run)) + (key[0] == key[1])) // (1 + (key[0] == key[1]))
    assert max(left.values(), default=0) < least
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)
    wide = [len(R.expand(np.array([first + k]), first, rules)) for k in range(len(rules))]
    assert R.lengths(first, rules).tolist() == wide


def test_repeats_get_shorter():
    x = np.tile(np.arange(50, dtype=np.uint32), 400)
    first, rules, seq = R.compress(x)
    assert len(seq) < len(x) / 100 and (R.expand(seq, first, rules) == x).all()


def test_random_access():
    rng = np.random.default_rng(1)
    docs = [(rng.zipf(1.4, int(n)) % 300).astype(np.uint32) for n in rng.integers(1, 400, 60)]
    s = R.Shard(R.write_shard(docs))
    assert all((s.document(k) == d).all() for k, d in enumerate(docs))
    assert (s.all() == np.concatenate(docs)).all()
    with pytest.raises(ValueError, match="shard"):
        R.Shard(b"something else")


@pytest.mark.parametrize("first", [50, 1 << 20])
def test_nonterminals_are_opened_once(monkeypatch, first):
    """However often each occurs in a long sequence; a table of all ids is not made where it would be larger."""
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 50, int(n)) for n in rng.integers(1, 30, 60)]
    ids = np.concatenate([words[i] for i in rng.integers(0, 60, 5000)]).astype(np.uint32)
    ids[0] = first - 1
    start, rules, seq = R.compress(ids)
    asked, opened = [], R._opened
    monkeypatch.setattr(R, "_opened", lambda seq, *rest: asked.append(len(seq)) or opened(seq, *rest))
    assert start == first and len(seq) > 4 * len(rules) > 0
    for width in (None, R.lengths(start, rules)):
        assert (R.expand(seq, start, rules, width) == ids).all()
    assert set(asked) == {len(rules) if first == 50 else len(seq)}
    assert len(R.expand(seq[:0], start, rules)) == 0 and (R.expand(ids, first, rules[:0]) == ids).all()


TEXTS = ["", "a", " Hello  world\n\n x", "it's I'LL", "<|endoftext|> x <|endoftext|>", "日本語 é 🎉", "\x1c a\x85b", " \t \n", "1234 ½", "x" * 3000, " word" * 50_000, "a   b    ", "\u00a0 \u00a0a"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(BYTE_BPE))


def test_pieces_equal_the_library(library):
    own = R.Pieces(tokenizer_file(BYTE_BPE), byte_pattern())
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(TEXTS)] == [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2100), max_size=40), max_size=4))
def test_any_text_equals_the_library(library, texts):
    own = R._open.get("t") or R._open.setdefault("t", R.Pieces(tokenizer_file(BYTE_BPE), byte_pattern()))
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_full_memo(library, monkeypatch):
    monkeypatch.setattr(R, "MEMO", 2)
    own = R.Pieces(tokenizer_file(BYTE_BPE), byte_pattern())
    for t in (["one two three"], ["four five six", "one"], ["seven two"]):
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(t)] == [e.ids for e in library.encode_batch(t, add_special_tokens=False)]


def test_pieces_are_met_once_and_end_with_the_id(library, monkeypatch):
    """Keys of all lengths, more characters than there are bytes, contractions, and texts that go to the library whole."""
    own, asked = R.Pieces(tokenizer_file(BYTE_BPE), byte_pattern()), []
    assert own.own and own.bare
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda new: asked.extend(new) or learn(new))
    texts = [" ".join("a" * k for k in range(1, 40)), "".join(map(chr, range(0xC0, 0x250))), "!'s 's'll've  \n'tx\n don't'", "日本 <|endoftext|>", "", " \n "] * 2
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for end, tail in ((2, [2]), (None, []), (7, [7])):
        ids, ends = own.flat(texts, end)
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [w + tail for w in want]
        assert len(own.flat([], end)[0]) == 0
    assert len(asked) == len(set(asked)) and {"a" * 1, " " + "a" * 15, " " + "a" * 16, "'ll"} <= set(asked)
    assert own.codes > R.NO_CODE and " " + "a" * 16 in own.rare and " " + "a" * 15 not in own.rare
    for t in texts:
        assert R.cuts(np.frombuffer((t + "\0").encode("utf-16-le"), "<u2"), own.kinds).tolist()[:-1] == [m.start() for m in own.find(t)] or own.other(t)
    own.own = own.bare = False
    own.__dict__.update({k: v for k, v in R.Pieces(tokenizer_file(BYTE_BPE), byte_pattern()).__dict__.items() if k in ("slots", "low", "high", "begin", "count", "ids", "entries", "used", "rare")})
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == want


def test_the_memo_outlives_a_task(spark, monkeypatch):
    """What Spark sends to a worker finds the worker's own memo, not a copy of it."""
    import pyarrow as pa
    from pyspark import TaskContext, cloudpickle

    df, sent = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, *rest, f=type(df).mapInArrow, **more: sent.append(cloudpickle.dumps(run)) or f(self, run, *rest, **more))
    R.store(df, tokenizer_file(BYTE_BPE), byte_pattern())
    monkeypatch.setattr(R, "_open", {})
    monkeypatch.setattr(TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    known = []
    for _ in range(2):
        batch = pa.RecordBatch.from_pydict({"key": [1], "text": ["some words"]})
        assert [b.num_rows for b in cloudpickle.loads(sent[0])(iter([batch]))] == [1]
        known.append([(id(t), t.entries) for t in R._open.values()])
    assert len(known[0]) == 1 and known[0] == known[1] and known[0][0][1] == 3


def test_files(spark, library):
    rows = [(i * 3 % 101, f"text {i} " * (i % 9), "x", 1) for i in range(101)] + [(7, "text", "x", 1), (8, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob string, n int").repartition(5)
    shards = R.store(df, tokenizer_file(BYTE_BPE), byte_pattern(), shard=200)
    assert shards.count() >= 5
    got = sorted(R.read(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    at = 0
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        want = {zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for t in texts[r.doc_id]}
        assert r.start == at and r.ids_crc32 in want
        at += r.n_tokens
    empty = R.store(df.limit(0), tokenizer_file(BYTE_BPE), byte_pattern())
    assert R.read(empty).count() == 0
