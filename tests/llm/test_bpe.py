"""The transducer against the plain merge loop, and against the library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tilewright.llm import bpe
from tilewright.llm.queries import WORD_BPE, tokenizer_file


def random_merges(seed: int, letters: int, rules: int) -> bpe.Merges:
    rng, known, out, pairs = random.Random(seed), list(range(letters)), [], set()
    for _ in range(rules):
        pair = rng.choice(known), rng.choice(known)
        if pair not in pairs:
            pairs.add(pair)
            out.append((*pair, 1000 + len(out)))
            known.append(out[-1][2])
    return bpe.Merges(out)


def plain(symbols: list[int], merges: bpe.Merges) -> list[int]:
    """One merge at a time: the lowest rank, the leftmost place."""
    s = list(symbols)
    while True:
        at = [(merges.rank[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in merges.rank]
        if not at:
            return s
        _, i = min(at)
        s[i : i + 2] = [merges.rank[s[i], s[i + 1]][1]]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3), st.integers(1, 12), st.integers(0, 400))
def test_streaming_equals_the_whole(seed, letters, rules, n):
    m = random_merges(seed, letters, rules)
    rng = random.Random(seed + 1)
    text = [rng.randrange(letters) for _ in range(n)]
    want = plain(text, m)
    assert m.merge(text[:]) == want
    assert list(bpe.transduce(iter(text), m, window=1)) == want


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = tokenizer_file(WORD_BPE)
    return bpe.Tokenizer(path), Tokenizer.from_file(path)


TEXTS = ["", " ", "a", "It's I'LL 're 'd", "<|endoftext|>hi<|startoftext|>", "ΑΣ ΣΑΣ ΌΣΟΣ", "a\U0003d000", "\ua7dc\U00016ea3x", "İstanbul ǅ", "é ä", "x\x1cy\x85w q​", "日本語 한국어", "🎉 👨‍👩‍👧", "A" * 5000, "thequick" * 900, "12 345 ½", "﻿abc", "\x00\x01", "word " * 30_000]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_equals_the_library(both, text):
    own, library = both
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    back = own.decoder()
    assert "".join(back.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + back.finish() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(both, text):
    own, library = both
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_restored_words(both):
    own, _ = both
    back = bpe.byte_decoder(own)
    assert back.feed(own.encode("Größe des é")) + back.finish() == "größe des é "


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "Hello", 7), (3, "Hello", 7)], "doc_id long, text string, n_tokens int")
    got = bpe.digests(df, tokenizer_file(WORD_BPE)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in got}
    assert len(got) == 4 and by[1].ids_sha256 == by[2].ids_sha256 == by[1].decoded_sha256 == empty and by[1].n_tokens == 0
    ids = bpe.encode(df.where("doc_id = 3"), tokenizer_file(WORD_BPE)).first()
    assert hashlib.sha256(" ".join(map(str, ids.ids)).encode()).hexdigest() == by[3].ids_sha256 and ids.decoded == "hello</w>"
    assert bpe.digests(df.limit(0), tokenizer_file(WORD_BPE)).count() == 0


def test_every_character_equals_the_library(both):
    own, library = both
    some = [f"a{chr(c)}b :{chr(c)}" for c in range(0x80, 0x110000, 1) if not 0xD800 <= c <= 0xDFFF and (c < 0x3000 or c % 37 == 0 or any(a - 2 <= c <= a + 1 or b - 1 <= c <= b + 2 for a, b in bpe.NEWER))]
    for text, e in zip(some, library.encode_batch(some, add_special_tokens=False)):
        assert own.encode(text) == e.ids, repr(text)


def test_every_word_goes_through_the_transducer(monkeypatch):
    """Short and long words alike; ids of a long text come block by block and are those of the whole."""
    tok, seen = bpe.Tokenizer(tokenizer_file(WORD_BPE)), []
    real = bpe.transduce
    monkeypatch.setattr(bpe, "transduce", lambda *a: seen.append(1) or real(*a))
    text = "a bc " + "abcdefgh" * 2000 + " end"
    assert tok.encode(text) == Tokenizer.from_file(tokenizer_file(WORD_BPE)).encode(text, add_special_tokens=False).ids
    assert len(seen) == 4
    long = "some words here, again and again; " * 9000
    blocks = list(tok.blocks(long))
    assert len(blocks) > 3 and max(map(len, blocks)) < bpe.CHUNK
    assert [i for b in blocks for i in b] == Tokenizer.from_file(tokenizer_file(WORD_BPE)).encode(long, add_special_tokens=False).ids
