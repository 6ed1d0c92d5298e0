"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

A merge list fixes how far to the right of a token one has to look before no later text can change it (`lookahead`).
The encoder holds that many symbols, and one window of them, whatever the length of the text. The decoder is a state
machine from ids to text that holds at most the bytes of one unfinished character.

Defined results: a null text counts as empty; an empty text has no ids, and decodes to the empty text; a very long text is
encoded and decoded a chunk at a time; repeated rows give equal rows; an empty table gives an empty result; columns other
than the named ones are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from unicodedata import is_normalized, normalize

from tilewright.llm.common import arrow_pass

#: Symbols that a window of the transducer has beyond the lookahead.
WINDOW = 256
#: Symbols up to which merges are done one at a time.
SHORT = 48
#: Characters that the text stream hands on at a time; words that the memo keeps, and misses after which it starts anew.
CHUNK, MEMO, STALE = 1 << 16, 300_000, 3_000_000


#: Code points that newer character tables call letters or numbers, and the library's does not.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2,
    0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7,
    0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Capitals that Python's tables do not know yet, as first and last of a run and the distance to small ones.
CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -0xA567), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -0xA641), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
_SMALL = {c: c + step for a, b, step in CAPITALS for c in range(a, b + 1)}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


#: Finds a character at or over the first of those above.
_late = re.compile("[\u0558-\U0010FFFF]").search


def _latin(text: str) -> bool:
    """Whether all characters are under U+0100: such a text is composed, and its letters are no news."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Merges:
    """A merge list over integer symbols: (left, right) -> (rank, merged)."""

    def __init__(self, rules: Iterable[tuple[int, int, int]], length: dict[int, int] | None = None):
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.length = dict(length or {})
        for k, (a, b, c) in enumerate(rules):
            self.rank.setdefault((a, b), (k, c))
            self.parts.setdefault(c, (a, b))
            self.length.setdefault(c, self.length.get(a, 1) + self.length.get(b, 1))
        self.order, self.made = {p: k for p, (k, _) in self.rank.items()}, {k: c for k, c in self.rank.values()}
        self.lookahead, self.longest = self._lookahead(), max([1, *self.length.values()])

    def _right_edge(self, symbol: int) -> Iterator[int]:
        """The symbol and whatever ends where it ends while it is being built."""
        while True:
            yield symbol
            if symbol not in self.parts:
                return
            symbol = self.parts[symbol][1]

    def _lookahead(self) -> int:
        """Symbols to the right of a token's end that can still undo it.

        A rule that built the token's right edge is undone only by a rule of higher rank that takes that edge as its
        left part; such a rule in turn depends on what follows its right part. Rules depend only on earlier rules, so one
        walk in rank order finds the longest chain.
        """
        reach: dict[int, int] = {}
        for (a, b), (_, _) in sorted(self.rank.items(), key=lambda x: x[1][0]):
            after = max((reach.get(s, 0) for s in self._right_edge(b)), default=0)
            reach[a] = max(reach.get(a, 0), self.length.get(b, 1) + after)
        return max((max(reach.get(s, 0) for s in self._right_edge(t)) for t in {*self.parts, *reach}), default=0)

    def merge(self, symbols: list[int]) -> list[int]:
        """All merges of the symbols: lowest rank first, leftmost first."""
        if len(symbols) <= SHORT:
            return self._merge_short(symbols)
        rank, none = self.rank, (1 << 60, -1)
        while len(symbols) > 1:
            found = [rank.get(p, none) for p in zip(symbols, symbols[1:])]
            best = min(found)
            if best is none or best[1] < 0:
                break
            out, i, n = [], 0, len(symbols)
            while i < n:
                if i < n - 1 and found[i] == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols


    def _merge_short(self, symbols: list[int]) -> list[int]:
        """One merge at a time, of which only the two neighbours are looked up anew."""
        get, none = self.order.get, 1 << 60
        found = [get(p, none) for p in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            symbols[i : i + 2] = [self.made[best]]
            del found[i]
            if i:
                found[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(found):
                found[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols


def transduce(symbols: Iterable[int], merges: Merges, window: int = WINDOW) -> Iterator[int]:
    """The ids of a stream of symbols, each as soon as it is stable; holds window + lookahead symbols and one token."""
    held: list[int] = []
    ahead, size = merges.lookahead, window + merges.lookahead
    most = merges.longest
    for s in symbols:
        held.append(s)
        if len(held) >= size + most:
            at = 0
            for t in merges.merge(held[:]):
                end = at + merges.length.get(t, 1)
                if end > len(held) - ahead:
                    break
                yield t
                at = end
            held = held[at:]
    yield from merges.merge(held)


class Tokenizer:
    """A byte-level BPE with word ends, as described by a tokenizer file: added tokens, NFC, white space, lower case."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {v: k for k, v in {**vocab, **self.added}.items()}
        signs = byte_symbols()
        self.inner = [vocab[s] for s in signs]
        self.last = [vocab[s + self.suffix] for s in signs]
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        self.merges = Merges((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern)
        newer = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
        self.unusual = regex.compile(f"[{newer}{''.join(map(chr, _SMALL))}]")
        for kind in (r"[^\s\p{L}\p{N}]", r"[\p{L}]", r"[\p{N}]"):  # for texts with such characters: they are neither
            pattern = pattern.replace(kind, f"[{kind}{'||' if '^' in kind else '--'}[{newer}]]")
        self.careful = regex.compile(pattern, regex.V1)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.memo: dict[str, tuple[int, ...]] = {}
        self.missed = 0
        every = range(max(self.names) + 1)
        self.signs, self.pieces = [str(i) for i in every], [self.names.get(i, "").encode() for i in every]

    def _ids(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        ids = tuple(transduce(chain(map(self.inner.__getitem__, raw[:-1]), (self.last[raw[-1]],)), self.merges))
        if len(self.memo) < MEMO:  # the first words are the frequent ones
            if len(word) <= 64:
                self.memo[word] = ids
        else:
            self.missed += 1
            if self.missed > STALE:
                self.memo.clear()
                self.missed = 0
        return ids

    def _chunks(self, text: str) -> Iterator[str]:
        """Cuts at white space, which no word, merge or composition crosses; a longer word stays whole."""
        at = 0
        while len(text) - at > CHUNK:
            cut = next((i for i in range(at + CHUNK, len(text)) if text[i] == " " or text[i] == "\n"), len(text))
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def _plain(self, text: str) -> Iterator[list[int]]:
        memo, ids = self.memo, self._ids
        for part in self._chunks(text):
            out: list[int] = []
            words = self.words
            if not part.isascii() and not _latin(part):
                if not is_normalized("NFC", part):
                    part = normalize("NFC", part)
                part = part.replace("Σ", "σ")  # letters are lowered one by one, without regard to a word's end
                if _late(part) and self.unusual.search(part):
                    part, words = part.translate(_SMALL), self.careful
            for word in words.findall(part.lower()):
                out += memo.get(word) or ids(word)
            yield out

    def blocks(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text as they come, those of about CHUNK characters at a time."""
        if not text:
            return
        at = 0
        if self.split is not None and "<" in text:
            for m in self.split.finditer(text):
                yield from self._plain(text[at : m.start()])
                yield [self.added[m[0]]]
                at = m.end()
        yield from self._plain(text[at:] if at else text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def decoder(self) -> Decoder:
        return Decoder(self.pieces, b" ")


class Decoder:
    """Ids to text, some at a time: its state is whether a token came before, and the bytes of an unfinished character."""

    def __init__(self, pieces: list[bytes], between: bytes = b""):
        self.pieces, self.between = pieces, between
        self.reset()

    def reset(self) -> None:
        self.begun, self.state = False, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = self.between.join(map(self.pieces.__getitem__, ids))
        if self.begun:
            raw = self.between + raw
        self.begun = True
        return self.state.decode(raw)

    def finish(self) -> str:
        rest = self.state.decode(b"", True)
        self.reset()
        return rest


def byte_decoder(tokenizer: Tokenizer) -> Decoder:
    """Restores the words themselves: bytes for signs, a space for each word end."""
    of, n = {s: bytes([b]) for b, s in enumerate(byte_symbols())}, len(tokenizer.suffix)
    pieces = []
    for i in range(max(tokenizer.names) + 1):
        name = tokenizer.names.get(i, "")
        if name in tokenizer.added:
            pieces.append(name.encode())
        elif n and name.endswith(tokenizer.suffix):
            pieces.append(b"".join(of[c] for c in name[:-n]) + b" ")
        else:
            pieces.append(b"".join(of[c] for c in name))
    return Decoder(pieces)


_open: dict[str, Tokenizer] = {}


def open_tokenizer(path: str) -> Tokenizer:
    """One per Python worker; the memo lives as long."""
    if path not in _open:
        _open[path] = Tokenizer(path)
    return _open[path]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", block: int = 4096) -> DataFrame:
    """key, ids, decoded: the ids of each whole text, and what the decoder makes of them, block ids at a time."""

    def work(batch: pa.RecordBatch) -> dict:
        tok = open_tokenizer(path)
        ids = [tok.encode(t) for t in batch[1].to_pylist()]
        back = tok.decoder()
        texts = ["".join(back.feed(x[i : i + block]) for i in range(0, len(x), block)) + back.finish() for x in ids]
        return {key: batch[0], "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": texts}

    return arrow_pass(df, [key, text], work, f"{key} {dict(df.dtypes)[key]}, ids array<int>, decoded string")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: as encode(), but ids are decoded and digested as they come, so that a
    task holds the ids of about CHUNK characters, however long a text is."""

    def work(batch: pa.RecordBatch) -> dict:
        tok = open_tokenizer(path)
        back, sign = tok.decoder(), tok.signs
        n, ids_sha, text_sha = [], [], []
        for t in batch[1].to_pylist():
            size, ids_of, text_of = 0, hashlib.sha256(), hashlib.sha256()
            for ids in tok.blocks(t):
                if ids:
                    ids_of.update((" " if size else "").encode() + " ".join(map(sign.__getitem__, ids)).encode())
                    text_of.update(back.feed(ids).encode())
                    size += len(ids)
            text_of.update(back.finish().encode())
            n.append(size)
            ids_sha.append(ids_of.hexdigest())
            text_sha.append(text_of.hexdigest())
        return {key: batch[0], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return arrow_pass(df, [key, text], work, f"{key} {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
