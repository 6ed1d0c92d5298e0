"""Token-ID output compressed by Re-Pair grammars, one per shard.

A shard is a run of documents in ascending order of their ids. Its ids form one sequence, in which pairs that occur often
are replaced by nonterminals, round after round, until no pair occurs `LEAST` times. A round is a few vector operations:
pairs are ranked by frequency, and where two overlap, the more frequent one is replaced. A shard keeps its rules, the
length that each nonterminal expands to and the documents' places, so any document is read without expanding the others.

Defined results: a null or empty text has only the end id; equal ids keep the order of their texts' hashes; repeated rows
are kept, each with a place of its own; rows with a null id come first; a very long text is one document of one shard; an
empty table gives no shards and no rows; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_pass, cut, pieces, small_join

MAGIC = b"TWRP1\0\0\0"
#: Ids of a shard at which it is closed, least occurrences of a pair, and characters of a part of the documents.
SHARD, LEAST, PART = 1 << 20, 24, 1 << 24
END, MEMO = 2, 400_000
#: Documents that are encoded at once.
ROWS = 128
#: The characters of a piece that its key holds, and what one in 8 bits is if there is no number left for it.
WIDE, NO_CODE = 16, 254
#: The letters and numbers among the characters that texts are cut up at here (up to U+024F).
LETTERS, NUMBERS = r"A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r"0-9\u00B2\u00B3\u00B9\u00BC-\u00BE"

#: The ASCII characters of texts that are cut up here.
_PLAIN = b"\t\n\r" + bytes(range(0x20, 0x7F))


def _pairs(seq: np.ndarray, known: int, least: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places, in order, where a pair begins that occurs least times or more, and the rank of each pair: 1 for the
    rarest. Equal ids in a row are paired from the first one on, so occurrences of one pair never overlap.

    live: places whose pair can occur so often. A round only makes pairs rarer, but for those with a
    nonterminal that it put in.
    """
    n, bits = len(seq) - 1, int(known - 1).bit_length()
    equal = np.flatnonzero(seq[:-1] == seq[1:])
    if len(equal):
        live[equal] = True  # what was inside of a row of equal ids may now begin one
        start = np.flatnonzero(np.concatenate([[True], np.diff(equal) != 1]))
        inside = np.arange(len(equal)) - np.repeat(start, np.diff(np.append(start, len(equal))))
        live[equal[inside % 2 == 1]] = False  # the pair before begins with the same id
    width = int(n).bit_length()
    packed, dense = 2 * bits + width <= 64, np.count_nonzero(live) > n >> 2
    use = np.flatnonzero(live) if not (packed and dense) else np.arange(n, dtype=np.uint64)
    if dense:  # few are left out, so runs of memory are faster than places
        code = seq.astype(np.uint64)
        code = (code[:-1] << np.uint64(bits)) | code[1:]
        if not packed:
            code = code[live]
    else:
        code = seq[use].astype(np.uint64) << np.uint64(bits) | seq[use + 1]
    if packed:  # code and place in one number, so one sort of numbers does
        code <<= np.uint64(width)
        code |= use.astype(np.uint64, copy=False)
        both = code[live] if dense else code
        both.sort()
        code = both >> np.uint64(width)
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
    edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    times = np.diff(np.append(edge, len(code)))
    often = times >= least
    those = np.repeat(often, times)
    at = (both[those] & np.uint64((1 << width) - 1)).astype(np.int64) if packed else use[order[those]]
    times = times[often]
    ranks = np.empty(len(times), np.int32)
    ranks[np.argsort(times, kind="stable")] = np.arange(1, len(times) + 1)
    rank = np.repeat(ranks, times)
    if len(at) > n >> 4:
        full = np.zeros(n, np.int32)
        full[at] = rank
        at = np.flatnonzero(full > 0)
        return at, full[at]
    order = np.argsort(at)
    return at[order], rank[order]


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray]:
    """first nonterminal, rules (n, 2), sequence. Nonterminal k stands for the pair of rule k.

    In a round every pair that occurs least times is ranked by its frequency, and an occurrence is replaced where its
    pair ranks higher than the pairs that overlap it. The most frequent pair is thus replaced wherever it occurs, so each
    round makes a rule, and the rounds end when no pair occurs least times.
    """
    seq = ids.astype(np.uint32)
    first = int(seq.max(initial=0)) + 1
    symbols: dict[tuple[int, int], int] = {}  # a pair that comes up again gets the nonterminal that it had
    live = np.ones(max(0, len(seq) - 1), bool)
    while len(seq) >= 2 * least:
        often, rank = _pairs(seq, first + len(symbols), least, live)
        if not len(often):
            break
        near, up = np.diff(often) == 1, np.diff(rank)
        best = np.ones(len(often), bool)
        best[1:] &= ~near | (up > 0)
        best[:-1] &= ~near | (up < 0)
        at, pair = often[best], rank[best]
        times = np.bincount(pair)
        number = np.cumsum(times >= least) - 1  # pairs that are replaced too seldom wait for a later round
        kept = times[pair] >= least
        at, pair = at[kept], number[pair[kept]]
        new = np.empty((int(number[-1]) + 1, 2), np.uint32)
        new[pair, 0], new[pair, 1] = seq[at], seq[at + 1]
        known = first + len(symbols)
        for rule in map(tuple, new.tolist()):
            symbols.setdefault(rule, first + len(symbols))
        put = np.fromiter((symbols[rule] for rule in map(tuple, new.tolist())), np.uint32, len(new))
        seq[at] = put[pair]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        if len(often) > len(seq) >> 4:
            live = np.zeros(len(seq), bool)
            live[often] = True
            live = live[keep]
        else:
            often = often[keep[often]]
            live = np.zeros(len(seq) - len(at), bool)
            live[often - np.searchsorted(at, often)] = True
        seq, live = seq[keep], live[:-1]
        place = at - np.arange(len(at))  # of the nonterminals that this round put in
        if (put < known).any():  # some are older, and their other places count, too
            touched = np.zeros(first + len(symbols), bool)
            touched[put] = True
            place = np.flatnonzero(touched[seq])
        live[place[place < len(live)]] = True
        live[place[place > 0] - 1] = True
    rules = np.array(list(symbols), np.uint32).reshape(-1, 2)
    return first, rules, seq


def _opened(seq: np.ndarray, first: int, rules: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for: all nonterminals of a depth are opened at once."""
    seq = seq.astype(np.uint32)
    while len(seq) and int(seq.max()) >= first:
        opened = seq >= first
        width = 1 + opened.astype(np.int64)
        place = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        out[place[~opened]] = seq[~opened]
        pairs = rules[seq[opened] - first]
        out[place[opened]], out[place[opened] + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq


def expand(seq: np.ndarray, first: int, rules: np.ndarray, width: np.ndarray | None = None) -> np.ndarray:
    """The ids that the symbols stand for. Of a long sequence each nonterminal is opened once, and its ids are put wherever
    it occurs. width: the ids of each nonterminal, if they are known."""
    if len(seq) < 4 * len(rules) or first > max(1 << 17, len(seq)):
        return _opened(seq, first, rules)
    width = (lengths(first, rules) if width is None else width).astype(np.int64)
    ids = np.concatenate([np.arange(first, dtype=np.uint32), _opened(np.arange(first, first + len(rules)), first, rules)])
    width = np.concatenate([np.ones(first, np.int64), width])
    start = np.cumsum(width) - width
    size = width[seq]
    place = np.repeat(start[seq] - (np.cumsum(size) - size), size)
    place += np.arange(len(place))
    return ids[place]


def lengths(first: int, rules: np.ndarray) -> np.ndarray:
    """Ids that each nonterminal expands to; a rule refers to earlier ones only."""
    out = np.ones(len(rules), np.uint32)
    a, b = rules[:, 0].astype(np.int64), rules[:, 1].astype(np.int64)
    while True:
        more = np.where(a >= first, out[np.maximum(a - first, 0)], 1) + np.where(b >= first, out[np.maximum(b - first, 0)], 1) if len(rules) else out
        if (more == out).all():
            return out.astype(np.uint32)
        out = more


def _pack(x: np.ndarray) -> bytes:
    wide = int(x.max(initial=0)) > 0xFFFF
    return struct.pack("<IB3x", len(x), 4 if wide else 2) + x.astype("<u4" if wide else "<u2").tobytes()


def _unpack(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width = struct.unpack_from("<IB", raw, at)
    return np.frombuffer(raw, f"<u{width}", n, at + 8), at + 8 + n * width


def write_shard(documents: list[np.ndarray]) -> bytes:
    """The file of a shard: rules, expansion lengths, sequence, ids of each document."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    first, rules, seq = compress(ids)
    sizes = np.array([len(d) for d in documents], np.uint32)
    return MAGIC + struct.pack("<II", first, len(rules)) + b"".join(map(_pack, (rules.reshape(-1), lengths(first, rules), seq, sizes)))


class Shard:
    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a shard of ids")
        self.first, n = struct.unpack_from("<II", raw, 8)
        rules, at = _unpack(raw, 16)
        self.rules = rules.reshape(n, 2)
        self.width, at = _unpack(raw, at)
        self.seq, at = _unpack(raw, at)
        self.sizes, at = _unpack(raw, at)
        self.ends = np.cumsum(self.sizes, dtype=np.int64)
        open_ = self.seq >= self.first
        size = np.ones(len(self.seq), np.int64)
        size[open_] = self.width[self.seq[open_].astype(np.int64) - self.first]
        self.places = np.cumsum(size)

    def all(self) -> np.ndarray:
        return expand(self.seq, self.first, self.rules, self.width)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document: only the symbols that reach into it are expanded."""
        a, b = int(self.ends[k]) - int(self.sizes[k]), int(self.ends[k])
        i, j = int(np.searchsorted(self.places, a, "right")), int(np.searchsorted(self.places, b, "left")) + 1
        begin = int(self.places[i - 1]) if i else 0
        return expand(self.seq[i:j], self.first, self.rules)[a - begin : b - begin]


#: Kinds of characters: none of those that texts are cut up at here, letters, numbers, others, white space.
NONE, LETTER, NUMBER, OTHER, SPACE = range(5)
#: The pattern that cuts() follows.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Odd factors of the hash of a key, and what is left of a word of eight characters of which some are valid.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_VALID = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _kinds(odd) -> np.ndarray:
    """The kind of each code point below 65,536; odd: finds the characters that texts are not cut up at here."""
    kinds = np.zeros(1 << 16, np.uint8)
    for point in range(1, 0x20AD):
        c = chr(point)
        if not odd(c):
            kinds[point] = LETTER if re.match(f"[{LETTERS}]", c) else NUMBER if re.match(f"[{NUMBERS}]", c) else SPACE if c.isspace() else OTHER
    return kinds


def cuts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The places where the pieces of GPT2 begin in texts that each end with a zero, which is a piece, too."""
    kind = kinds[points]
    begins = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    white, end, blank = kind == SPACE, kind == NONE, points == 32
    begins[1:] &= ~blank[:-1] | white[1:]  # a space belongs to the piece behind it,
    begins[:-1] |= white[:-1] & ~(white | end)[1:]  # as the last of some white space is cut off from the rest
    begins |= end
    begins[1:] |= end[:-1]
    quote = np.flatnonzero(begins & (points == 39))
    if len(quote):
        after = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = after[quote + 1], after[quote + 1].astype(np.uint32) << 16 | after[quote + 2]
        short = quote[np.isin(one, [ord(c) for c in "stmd"])]
        long_ = quote[np.isin(two, [ord(c) << 16 | ord(d) for c, d in ("re", "ve", "ll")])]
        begins[short + 1] = begins[long_ + 1] = False
        begins[short + 2] = begins[long_ + 3] = True
    return np.flatnonzero(begins)


class Pieces:
    """Ids by the tokenizers library, which meets each piece of text once while the memo holds it.

    The pattern cuts texts of the letters below as the library's own pre-tokenizer does, and no merge crosses a cut;
    texts with other characters, or with the strings of special tokens, go to the library whole. The memo is a hash table
    in arrays, in which all pieces of some texts are looked up at once: a key is the piece itself, of a byte a character;
    pieces of more than WIDE characters, or of characters that have no byte, are in a dictionary.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # pieces can go to the library's model, as nothing else changes them but the alphabet of bytes
        self.bare = self.library.normalizer is None and repr(self.library.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = dict(zip([*printed, *sorted({*range(256)} - {*printed})], map(chr, [*printed, *range(256, 324)])))
        self.own = pattern == GPT2
        for kind, own in ((r"[^\s\p{L}\p{N}]", f"[^\\s{LETTERS}{NUMBERS}]"), (r"\p{L}", f"[{LETTERS}]"), (r"\p{N}", f"[{NUMBERS}]")):
            pattern = pattern.replace(kind, own)
        self.find = re.compile(pattern).finditer
        self.odd = re.compile(r"[^\t\n\r\x20-\x7E\u00A0-\u024F\u2010-\u201F\u2026\u20AC]").search
        self.kinds = _kinds(self.odd)
        self.code, self.codes = np.zeros(1 << 16, np.uint8), 1  # the byte of each character; the next one
        self.code[0] = 255
        self.bits = max(4, (2 * MEMO - 1).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.low, self.high = np.zeros((2, 1024), np.uint64)  # keys of the entries; entry 0 is what ends a text
        self.begin, self.count = np.zeros((2, 1024), np.int64)  # their ids among all
        self.ids = np.zeros(4096, np.uint32)
        self.entries, self.used = 1, 1
        self.rare: dict[str, int] = {}

    def other(self, text: str) -> bool:
        """Whether a text is one for the library as a whole."""
        if "<|" in text:
            return True
        return bool(text.encode().translate(None, _PLAIN)) if text.isascii() else self.odd(text) is not None

    def _learn(self, new: list[str]) -> list[list[int]]:
        """The ids of pieces."""
        if self.bare:
            tokenize, letters = self.library.model.tokenize, self.letters
            spelt = "\0".join(new).encode().decode("latin-1").translate(letters).split(letters[0])
            return [[t.id for t in tokenize(p)] for p in spelt]
        return [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * _MIX[0] + (high ^ high >> np.uint64(29)) * _MIX[1]
        return ((mixed ^ mixed >> np.uint64(32)) * _MIX[2] >> np.uint64(64 - self.bits)).astype(np.int64)

    def _found(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entries of keys; 0: there is none."""
        slot = self._slot(low, high)
        out = self.slots[slot]
        left = np.flatnonzero((out > 0) & ((self.low[out] != low) | (self.high[out] != high)))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            entry = out[left] = self.slots[slot[left]]
            left = left[(entry > 0) & ((self.low[entry] != low[left]) | (self.high[entry] != high[left]))]
        return out

    def _keep(self, entry: np.ndarray) -> None:
        """Puts new entries into free slots."""
        slot = self._slot(self.low[entry], self.high[entry])
        while len(entry):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _add(self, new: list[str], low: np.ndarray, high: np.ndarray) -> None:
        """Entries from self.entries on for pieces with their keys, of which the memo keeps as many as it has room for. A
        low key of 0: the piece has none."""
        got = self._learn(new)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        end, used = self.entries + len(new), self.used + int(sizes.sum())
        for name, need in (("low", end), ("high", end), ("begin", end), ("count", end), ("ids", used)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old) // 2), old.dtype)]))
        rows = slice(self.entries, end)
        self.low[rows], self.high[rows], self.count[rows] = low, high, sizes
        self.begin[rows] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : used] = np.fromiter(itertools.chain.from_iterable(got), np.uint32, used - self.used)
        room = min(len(new), max(0, MEMO - self.entries))  # the first words are the frequent ones; those that come later are not kept
        kept = np.arange(self.entries, self.entries + room)
        self._keep(kept[low[:room] > 0])
        self.rare.update((new[k], self.entries + k) for k in np.flatnonzero(low[:room] == 0).tolist())
        self.entries, self.used = self.entries + room, self.used + int(sizes[:room].sum())

    def _places(self, text: str, points: np.ndarray) -> np.ndarray:
        """Where the pieces of texts begin that each end with a zero."""
        if self.own:
            return cuts(points, self.kinds)
        at, out = 0, []
        for some in text.split("\0")[:-1]:
            out += [at + m.start() for m in self.find(some)]
            at += len(some) + 1
            out.append(at - 1)
        return np.array(out, np.int64)

    def flat(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and where those of each text end."""
        whole = [self.other(t) for t in texts]
        text = "".join([("" if w else t) + "\0" for t, w in zip(texts, whole)])
        points = np.frombuffer(text.encode("utf-16-le"), "<u2")
        code = self.code[points]
        if not code.all():
            for c in np.unique(points[code == 0]).tolist():
                self.code[c], self.codes = min(self.codes, NO_CODE), self.codes + 1
            code = self.code[points]
        at = self._places(text, points)
        size = np.diff(at, append=len(points))
        padded = np.concatenate([code, np.zeros(WIDE, np.uint8)])
        words = np.ndarray(len(code) + 8, "<u8", padded, strides=(1,))
        low, high = words[at] & _VALID[np.minimum(size, 8)], words[at + 8] & _VALID[np.clip(size - 8, 0, 8)]
        entry = self._found(low, high)
        keyless = size > WIDE
        if self.codes > NO_CODE:
            keyless |= np.logical_or.reduceat(code == NO_CODE, at)
        last = np.flatnonzero(points[at] == 0)
        entry[keyless] = 0
        low[keyless] = high[keyless] = 0
        lacking = entry == 0
        lacking[last] = False
        lacking = np.flatnonzero(lacking)
        if len(lacking):
            names = [text[a:b] for a, b in zip(at[lacking].tolist(), (at[lacking] + size[lacking]).tolist())]
            first = {p: k for k, p in zip(range(len(names) - 1, -1, -1), reversed(names)) if p not in self.rare}
            new, rows = list(first), lacking[list(first.values())]
            number = dict(zip(new, range(self.entries, self.entries + len(new))))
            entry[lacking] = [self.rare[p] if p not in number else number[p] for p in names]
            if new:
                self._add(new, low[rows], high[rows])
        entry[last] = 0
        self.ids[0], self.count[0] = end or 0, end is not None
        count = self.count[entry]
        ends = np.cumsum(count)
        place = np.repeat(self.begin[entry] - (ends - count), count)
        place += np.arange(len(place))
        ids, ends = self.ids[place], ends[last]
        if not any(whole):
            return ids, ends
        left = iter(self.library.encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False))
        tail = self.ids[: int(end is not None)].copy()
        rows = [np.concatenate([np.array(next(left).ids, np.uint32), tail]) if w else ids[a:b] for w, a, b in zip(whole, [0, *ends.tolist()], ends.tolist())]
        return np.concatenate(rows), np.cumsum([len(r) for r in rows])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        ids, ends = self.flat(texts)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]


_open: dict[str, Pieces] = {}


def opened(path: str, pattern: str) -> Pieces:
    """The one of this process, whose memo outlives a task: tasks get a copy of any variable that they name themselves."""
    return _open.get(path) or _open.setdefault(path, Pieces(path, pattern))


def store(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", end: int = END, shard: int = SHARD) -> DataFrame:
    """part, shard, keys, first, last, n, blob: the shards in order of (part, shard), one row each, already written."""

    def run(batches):
        from pyspark import TaskContext

        tok = opened(path, pattern)

        part, number, keys, held, n = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "keys": pa.array([keys], pa.list_(pa.int64())), "n": pa.array([n], pa.int64()), "blob": pa.array([write_shard(held)], pa.binary())})

        for batch in pieces(batches, ROWS):
            ids, ends = tok.flat([t or "" for t in batch[1].to_pylist()], end)
            for k, a, b in zip(batch[0].to_pylist(), [0, *ends.tolist()], ends.tolist()):
                keys.append(k)
                held.append(ids[a:b])
                n += b - a
                if n >= shard:
                    yield close()
                    number, keys, held, n = number + 1, [], [], 0
        if held:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = -(-(rows.select(F.sum(F.length("text"))).first()[0] or 0) // PART)
    ordered = rows.repartitionByRange(max(1, parts), "key").sortWithinPartitions("key", F.xxhash64("text"))
    return cut(ordered.mapInArrow(run, "part int, shard int, keys array<long>, n long, blob binary"), "id-shards")


def read(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from the stored files."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = shards.select("part", "shard", "n")
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("_p"), before(Window.orderBy("part")).alias("base"))  # a row per part
    own = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("inside"))
    begins = own.join(totals, F.col("part") == F.col("_p")).select(F.col("part").alias("_p"), F.col("shard").alias("_s"), (F.col("base") + F.col("inside")).alias("begin"))
    # the few numbers of the shards travel to the blobs, not the other way round, as long as they are few
    placed = small_join(shards.select("part", "shard", "keys", "blob"), cut(begins, "id-begins"), (F.col("part") == F.col("_p")) & (F.col("shard") == F.col("_s")), "inner")

    def work(batch: pa.RecordBatch) -> dict:
        keys, start, n, crc = [], [], [], []
        for begin, names, blob in zip(*(batch[i].to_pylist() for i in range(3))):
            s = Shard(blob)
            ids, ends = s.all().astype("<u4"), s.ends.tolist()
            for k, a, b in zip(names, [0, *ends], ends):
                keys.append(k)
                start.append(begin + a)
                n.append(b - a)
                crc.append(zlib.crc32(ids[a:b]))
        i64 = lambda x: pa.array(x, pa.int64())
        return {key: i64(keys), "start": i64(start), "n_tokens": i64(n), "ids_crc32": i64(crc)}

    return arrow_pass(placed, ["begin", "keys", "blob"], work, f"{key} long, start long, n_tokens long, ids_crc32 long")
