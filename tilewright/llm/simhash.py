"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is cut into so few segments that, within the radius asked for, one segment differs by at most one bit. Each
segment is indexed once for every bit of it, with that bit struck out; two segments that differ by at most one bit share
such a key. The keys are joined by sorting: each run of equal keys is held together, and its members are linked if the
whole fingerprints agree in all but the radius. Only links that connect a run are made (one fewer than its members at
most), so a group of copies costs its size, not its square. Components come from alternating star contraction.

Copies with edits (`keep_one`) differ in about 15 % of the bits, so their fingerprints are wider: `SEGMENTS` segments over
the distinct five-word shingles. Two copies mostly differ, if at all, in bits that few shingles decide, so a segment is
indexed with each of its `WEAK` least certain bits struck out, not with every bit. Whoever shares a key and differs in few
enough bits is a candidate; the components of the candidates are compared by the exact Jaccard similarity of their shingles.

Equal fingerprints are one node from the start, named by their smallest id, so exact copies never meet in a run.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked like any other (to
`keep_one` they are copies of one another); repeated rows get the same component; rows with a null id get a component only
from the others of their fingerprint (null if there are none), while `keep_one` goes by rows, not by ids: texts that
differ are told apart under one id or none; a very long text has one fingerprint like any other; an empty table gives an
empty result; `keep_one` passes all columns through whatever their names, the others ignore them. Ids are integers for
`contract` and of any type for `keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_pass, cut, pieces

SEED = 42
#: Name of the column of `components`.
NODES = "component"
#: Of the wide fingerprint: bits of a segment, segments, bits struck out of a segment (one at a time), 64-bit words.
WIDTH, SEGMENTS, WEAK, LANES = 18, 56, 4, 16
#: Its words that travel with each key, and how many of their bits may differ. At a similarity of 0.8 a bit differs with a
#: probability of 0.15, so 38 of these 256 do, with a deviation of 5.7.
CHECK, FAR = 4, 60
#: Members of a run from which it is split further before they are compared.
LONG = 256
#: Bytes of a shingle's hash, by which sets are compared.
GRAM = 6
#: Members of a run up to which all are compared with all, side by side with those of the other runs.
SHORT = 256
#: Pairs that a task holds at once to leave out those that follow from others.
HELD_PAIRS = 1 << 19


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles of the text with A-Z in lower case; fewer words: all of them as one; no words: none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    whole, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [whole[a:b] for a, b in zip(starts, ends[width - 1 :])]


def hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, [SEED] * len(parts)), np.uint64, len(parts))


def spread(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits of each hash: lane 0 is the hash itself, others mix it anew."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray, step: int = 1 << 15) -> int:
    """The 64 bits that are set in over half of the hashes; none: zero."""
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), step):
        count += np.unpackbits(h[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority(hashes(shingles(text, width)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def contract_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """key, keys (two segments of 32 bits), check (the fingerprint itself) of every row."""

    def work(batch: pa.RecordBatch) -> dict:
        prints = np.array([fingerprint(t, width) for t in batch[1].to_pylist()], np.uint64)
        low, high = (prints & np.uint64(0xFFFFFFFF)).astype(np.int64), (prints >> np.uint64(32)).astype(np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(prints) + 1, 2), pa.int32()), pa.array(np.stack([low, high], 1).reshape(-1)))
        return {key: batch[0], "keys": keys, "check": pa.array([int(p).to_bytes(8, "big") for p in prints], pa.binary())}

    return arrow_pass(docs, [key, text], work, f"{key} {dict(docs.dtypes)[key]}, keys array<long>, check binary")


def grams_of(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct word shingles of a whole text as sorted hashes of GRAM bytes."""
    return np.unique(hashes(shingles(text, width)) >> np.uint64(64 - 8 * GRAM))


def margins(h: np.ndarray, step: int = 255 * 8) -> np.ndarray:
    """Of each of 64 * LANES bits, the hashes that have it set less those that haven't. The majority is where it is over 0."""
    count = np.zeros(64 * LANES, np.int64)
    for i in range(0, len(h), step):
        some = np.stack([spread(h[i : i + step], lane) for lane in range(1, LANES + 1)], 1)
        bits = np.unpackbits(some.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            count += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return 2 * count - len(h)


def wide_print(grams: np.ndarray) -> tuple[bytes, bytes]:
    """The fingerprint of some shingles, and the places of each segment's least certain bits. No shingles: neither."""
    if not len(grams):
        return b"", b""
    m = margins(grams)
    sure = np.abs(2 * m - 1)[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)
    return np.packbits(m > 0, bitorder="little").tobytes(), np.argsort(sure, 1, kind="stable")[:, :WEAK].astype(np.uint8).tobytes()


def deletion_keys(prints: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """SEGMENTS * WEAK keys of each fingerprint: a segment's number, the place struck out, and the other bits."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, : SEGMENTS * WIDTH].reshape(-1, SEGMENTS, WIDTH)
    value = (bits.astype(np.int32) << np.arange(WIDTH, dtype=np.int32)).sum(2, dtype=np.int32)
    place = weak.reshape(-1, SEGMENTS, WEAK).astype(np.int32)
    segment = np.arange(SEGMENTS, dtype=np.int32)[None, :, None]
    return ((segment << 5 | place) << WIDTH | value[:, :, None] & ~(np.int32(1) << place)).reshape(len(bits), -1)


def copy_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """id, mark (a hash of the text), node (64 bits of a digest of the distinct shingles), print and weak (as wide_print
    gives them) of every row."""

    def work(batch: pa.RecordBatch) -> dict:
        node, prints = [], []
        for t in batch[2].to_pylist():
            g = grams_of(t, width)
            prints.append(wide_print(g))
            node.append(_signed(xxhash.xxh3_64_intdigest(g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM].tobytes(), SEED)))
        return {"id": batch[0], "mark": batch[1], "node": pa.array(node, pa.int64()), "print": pa.array([p for p, _ in prints], pa.binary()), "weak": pa.array([w for _, w in prints], pa.binary())}

    kind = dict(docs.select(F.col(key).alias("id")).dtypes)["id"]
    return arrow_pass(docs, [F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")], work, f"id {kind}, mark long, node long, print binary, weak binary")


def variants(nodes: DataFrame) -> DataFrame:
    """slot, node, check: a row for each segment and each bit of it that is struck out. nodes: node, keys, check."""
    bits = F.sequence(F.lit(0), F.lit(31))
    own = nodes.select("node", "check", F.posexplode("keys").alias("segment", "value"))
    return own.select("node", "check", "segment", "value", F.explode(bits).alias("bit")).select(
        (F.shiftleft((F.col("segment") * 32 + F.col("bit")).cast("long"), 32).bitwiseOR(F.col("value").bitwiseAND(F.expr("~shiftleft(1L, bit)")))).alias("slot"), "node", "check"
    )


def _long_forest(nodes: np.ndarray, prints: np.ndarray, radius: int) -> set[tuple[int, int]]:
    """As _forest, for a run of many: prints within the radius agree in one of radius + 1 parts of the bits in which the
    run's members differ at all, so each part's equal values are runs of their own, and only those are compared."""
    bits = np.unpackbits(np.ascontiguousarray(prints.astype(">u8")).view(np.uint8), axis=1)
    vary = np.flatnonzero(bits.min(0) != bits.max(0))
    out: set[tuple[int, int]] = set()
    if len(vary) <= radius:  # all are within it
        return {(int(nodes.min()), int(x)) for x in nodes if x != nodes.min()}
    for own_bits in np.array_split(vary, radius + 1):
        _, part = np.unique(np.packbits(bits[:, own_bits], axis=1), axis=0, return_inverse=True)
        part = part.reshape(-1)
        order = np.argsort(part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(own) > 1:
                out.update(_forest(nodes[own], prints[own], radius))
    return out


def _forest(nodes: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect a run: whoever is reached leaves the rest that later members are compared with."""
    order = np.argsort(nodes, kind="stable")
    nodes, prints = nodes[order], prints[order]
    rest, out = np.arange(len(nodes)), []
    while len(rest) > 1:
        root, front, rest = nodes[rest[0]], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(prints[rest] ^ prints[front.pop()]).sum(1) <= radius
            if near.any():
                got = rest[near]
                out += [(int(root), int(x)) for x in nodes[got] if x != root]
                front += got.tolist()
                rest = rest[~near]
    return out


def _alike(sets: list[np.ndarray], one: np.ndarray, at: float) -> np.ndarray:
    """Which of the sets (sorted, not empty) have a Jaccard similarity of at or more with one."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros(len(sets), bool)
    some = np.flatnonzero((np.minimum(sizes, len(one)) >= at * np.maximum(sizes, len(one)) - 1e-9))
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        both = np.add.reduceat((one[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
        out[some] = both >= at * (sizes[some] + len(one) - both) - 1e-9
    return out


def _copies(nodes: list[int], sets: list[np.ndarray], at: float) -> list[tuple[int, int]]:
    """As _forest, by the exact Jaccard similarity of the sets."""
    own = dict(zip(nodes, sets))
    nodes = sorted(own)
    rest, out = nodes, []
    while len(rest) > 1:
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and rest:
            near = _alike([own[x] for x in rest], own[front.pop()], at)
            if near.any():
                got = [x for x, n in zip(rest, near) if n]
                out += [(root, x) for x in got]
                front += got
                rest = [x for x, n in zip(rest, near) if not n]
    return out


def _unite(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes one group of the groups of a[i] and b[i] for each i. of: of each member one of its group that comes no later,
    by which the group's first is reached."""
    a, b = _first(of, a), _first(of, b)
    while (differ := a != b).any():
        np.minimum.at(of, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        a, b = _first(of, a), _first(of, b)


def _first(of: np.ndarray, x: np.ndarray) -> np.ndarray:
    while ((up := of[x]) != x).any():
        x = up
    return x


def _stars(pairs: np.ndarray) -> np.ndarray:
    """Rows (a, b): the smallest node of each component of the pairs with each of its others."""
    nodes, place = np.unique(pairs, return_inverse=True)
    place, of = place.reshape(-1, 2), np.arange(len(nodes))
    for at in range(0, len(place), 1 << 12):  # what is known to be of one group is passed over
        some = _first(of, place[at : at + (1 << 12)])
        some = some[some[:, 0] != some[:, 1]]
        _unite(of, some[:, 0], some[:, 1])
        of[place[at : at + (1 << 12)]] = _first(of, place[at : at + (1 << 12)])
    of = _first(of, of)
    return np.stack([nodes[of], nodes], 1)[of != np.arange(len(nodes))]


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of pairs (a, b) as few with the same closure, as far as a task can tell that holds HELD_PAIRS at once."""
    held, n = [], 0

    def give(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    for batch in batches:
        held.append(np.stack([batch[0].to_numpy(), batch[1].to_numpy()], 1))
        n += len(held[-1])
        if n >= HELD_PAIRS:
            held = [_stars(np.concatenate(held))]
            n = len(held[0])
            if 2 * n >= HELD_PAIRS:
                yield give(held[0])
                held, n = [], 0
    if n:
        yield give(_stars(np.concatenate(held)))


def _near(slot: np.ndarray, node: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Rows (a, b), a < b: of each run, links whose closure is that of all pairs of it whose checks differ in FAR bits or
    fewer. Each group of a run gives its smallest node with each of the others, so one link fewer than it has members."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(slot)) + 1, [len(slot)]])
    size = np.diff(edge)
    out = [np.array(_forest(node[a : a + n], check[a : a + n], FAR), np.int64).reshape(-1, 2) for a, n in zip(edge[:-1][size > SHORT].tolist(), size[size > SHORT].tolist())]
    rest = np.repeat(np.where(size > SHORT, 0, edge[1:]), size) - np.arange(len(slot))  # members from here to the end of the run
    of, lag, at = np.arange(len(slot)), 1, np.flatnonzero(rest > 1)
    while len(at):
        apart = at[of[at] != of[at + lag]]
        near = apart[np.bitwise_count(check[apart] ^ check[apart + lag]).sum(1) <= FAR]
        _unite(of, near, near + lag)
        of[near], of[near + lag] = _first(of, near), _first(of, near + lag)
        lag += 1
        at = at[rest[at] > lag]
    of = _first(of, of)
    low = node.astype(np.int64)
    np.minimum.at(low, of, node)
    out.append(np.stack([low[of], node], 1))
    pairs = np.concatenate(out)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b (a < b): pairs whose closure is that of all pairs of nodes that share a key and whose checks differ in FAR bits
    or fewer, about one fewer than each group has nodes. nodes: node, print, weak."""
    words = [f"c{i}" for i in range(CHECK)]

    def deal(batch: pa.RecordBatch) -> dict:
        prints = np.frombuffer(b"".join(batch[1].to_pylist()), "<u8").reshape(-1, LANES)
        keys = deletion_keys(prints, np.frombuffer(b"".join(batch[2].to_pylist()), np.uint8))
        again = lambda x: np.repeat(x, keys.shape[1])
        return {"slot": keys.reshape(-1), "node": again(batch[0].to_numpy()), **{w: again(prints[:, i].astype(np.int64)) for i, w in enumerate(words)}}

    def found(whole: list) -> pa.RecordBatch:
        pairs = _near(*(np.concatenate(x) for x in zip(*whole)))
        return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # the rows of the last slot so far
        for batch in batches:
            if not batch.num_rows:
                continue
            now = batch[0].to_numpy(), batch[1].to_numpy(), np.stack([batch[2 + i].to_numpy() for i in range(CHECK)], 1).astype(np.uint64)
            start = int(np.searchsorted(now[0], now[0][-1]))
            if start or (kept and kept[-1][0][-1] != now[0][0]):  # the slots before the last one are complete
                yield found([*kept, tuple(x[:start] for x in now)])
                kept = []
            kept.append(tuple(x[start:] for x in now))
        if kept:
            yield found(kept)

    dealt = arrow_pass(nodes.where("length(print) > 0"), ["node", "print", "weak"], deal, "slot int, node long, " + ", ".join(f"{w} long" for w in words))
    pairs = cut(dealt.repartition("slot").sortWithinPartitions("slot").mapInArrow(lambda x: forests(run(x)), "a long, b long").distinct(), "simhash-pairs")
    # runs overlap, so a group's links differ from task to task: most of them follow from others
    return pairs.coalesce(-(-pairs.count() // HELD_PAIRS) or 1).mapInArrow(forests, "a long, b long").distinct()


def copy_groups(rows: DataFrame, nodes: DataFrame, width: int, at: float) -> DataFrame:
    """node, component (its smallest node) of the nodes that have copies. A component of candidates is compared by one
    task, by the exact Jaccard similarity of the shingles. rows: id, mark, text; nodes: node, first, print, weak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, held = None, {}

        def find() -> pa.RecordBatch:
            links = _copies(list(held), list(held.values()), at) if len(held) > 1 else []
            return pa.RecordBatch.from_pydict({"node": pa.array([x for _, x in links], pa.int64()), NODES: pa.array([x for x, _ in links], pa.int64())})

        for batch in pieces(batches):
            for c, n, t in zip(*(batch[i].to_pylist() for i in range(3))):
                if c != cluster:
                    if len(held) > 1:
                        yield find()
                    cluster, held = c, {}
                if n not in held:
                    held[n] = grams_of(t, width)
        yield find()

    stars = components(candidates(nodes)).select(F.col("node").alias("_n"), F.col(NODES).alias("cluster"))
    clusters = stars.union(stars.select("cluster", "cluster").distinct())  # with the smallest node of each
    # exact copies have the same shingles: the text of one row of each node is fetched
    want = nodes.select("node", "first").join(clusters.hint("merge"), F.col("node") == F.col("_n")).select(F.col("first.id").alias("_id"), F.col("first.mark").alias("_mark"), "node", "cluster")
    texts = rows.join(want.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("cluster", "node", "text")
    return texts.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, f"node long, {NODES} long")


def links(nodes: DataFrame, radius: int, sparse: bool = False) -> DataFrame:
    """a, b (a < b): pairs whose closure is that of all pairs of fingerprints within the radius, run by run.

    sparse: long fingerprints are fetched only for nodes that share a key with others, instead of travelling with each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # the rows of the last slot so far

        def find(slot, node, check) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(slot)) + 1
            first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(slot)]])
            many = last - first > 1
            seen: set[tuple[int, int]] = set()
            for a, b in zip(first[many].tolist(), last[many].tolist()):
                if b - a == 2:
                    if node[a] != node[a + 1] and int(np.bitwise_count(check[a] ^ check[a + 1]).sum()) <= radius:
                        seen.add((int(min(node[a], node[a + 1])), int(max(node[a], node[a + 1]))))
                else:
                    seen.update((_forest if b - a <= LONG else _long_forest)(node[a:b], check[a:b], radius))
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in seen], pa.int64()), "b": pa.array([x for _, x in seen], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.frombuffer(b"".join(batch[2].to_pylist()), ">u8").astype(np.uint64).reshape(batch.num_rows, -1)
            now = batch[0].to_numpy(), batch[1].to_numpy(), flat
            start = int(np.searchsorted(now[0], now[0][-1]))
            if start or (kept and kept[-1][0][-1] != now[0][0]):  # the slots before the last one are complete
                whole = [*kept, tuple(x[:start] for x in now)]
                yield find(*(np.concatenate(x) for x in zip(*whole)))
                kept = []
            kept.append(tuple(x[start:] for x in now))
        if kept:
            yield find(*(np.concatenate(x) for x in zip(*kept)))

    if not sparse:
        return variants(nodes).select("slot", "node", "check").repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "a long, b long").distinct()
    met = cut(variants(nodes).select("slot", "node").repartition("slot").sortWithinPartitions("slot").mapInArrow(_several, "slot long, node long"), "simhash-met")
    known = nodes.select(F.col("node").alias("_n"), "check").hint("merge")
    return met.join(known, F.col("node") == F.col("_n")).select("slot", "node", "check").repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "a long, b long").distinct()


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (slot, node), the rows whose slot others have too. A row waits only for the first of the next batch."""
    kept: tuple | None = None  # the last row so far, and whether the one before it has its slot
    for batch in batches:
        slot, node = batch[0].to_numpy(), batch[1].to_numpy()
        before = False
        if kept is not None:
            slot, node, before = np.append(kept[0], slot), np.append(kept[1], node), kept[2]
        same = slot[1:] == slot[:-1]
        keep = np.append(before, same)
        keep[:-1] |= same
        kept = slot[-1], node[-1], bool(same[-1]) if len(same) else before
        if keep[:-1].any():
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slot[:-1][keep[:-1]]), "node": pa.array(node[:-1][keep[:-1]])})
    if kept is not None and kept[2]:
        yield pa.RecordBatch.from_pydict({"slot": pa.array([kept[0]], pa.int64()), "node": pa.array([kept[1]], pa.int64())})


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of the pairs (a < b), by alternating large and small stars."""
    edges = cut(pairs, "stars")
    last = None
    for _ in range(most_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("c")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("m"))
        met = large.join(low, F.col("b") == F.col("c"))
        small = met.select(F.col("m").alias("a"), F.col("a").alias("b")).union(met.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        edges = cut(small, "stars")
        state = edges.select(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components aren't complete after {most_rounds} rounds")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias(NODES))


def grouped(prints: DataFrame, radius: int, key: str = "doc_id", sparse: bool = False) -> DataFrame:
    """key, check, component_id of every row of prints (key, keys, check), which is a stored table."""
    nodes = cut(prints.groupBy("check", "keys").agg(F.min(key).alias("node")), "simhash-nodes")
    found = components(links(nodes.where("node is not null"), radius, sparse))
    named = nodes.join(found, "node", "left").select(F.col("check").alias("_check"), F.col("keys").alias("_keys"), F.coalesce(NODES, "node").alias("component_id"))
    return prints.join(named, (F.col("check") == F.col("_check")) & (F.col("keys") == F.col("_keys"))).select(key, "check", "component_id")


def contract(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """key, fingerprint (16 hexadecimal digits), component_id: fingerprints link at radius or fewer differing bits."""
    prints = cut(contract_fingerprints(docs, key, text, width), "simhash-prints")
    return grouped(prints, radius, key).select(key, F.lower(F.hex("check")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, at: float = 0.8) -> DataFrame:
    """One row of each group of copies, with all its columns: the one with the smallest id (null last), of equal ids the
    one with the smaller hash of its text, of rows that repeat both the first in the order of their other columns.

    Copies have a Jaccard similarity of at or more over their distinct word shingles, or are linked by such. Candidates
    share a deletion-variant key of their fingerprints: of pairs at 0.8 all but about 0.1 % do.
    """
    prints = cut(copy_fingerprints(docs, key, text, width), "simhash-prints")
    own = F.struct(F.isnull("id").alias("none"), "id", "mark")
    nodes = cut(prints.groupBy("node").agg(F.min(own).alias("first"), F.first("print").alias("print"), F.first("weak").alias("weak")), "simhash-nodes")
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    found = copy_groups(texts, nodes, width, at).withColumnRenamed("node", "_n").hint("merge")
    named = nodes.select("node", "first").join(found, F.col("node") == F.col("_n"), "left").select("first", F.coalesce(NODES, "node").alias(NODES))
    first = cut(named.groupBy(NODES).agg(F.min("first").alias("first")).select("first.id", "first.mark"), "simhash-first")
    twice = cut(prints.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("id", "mark"), "simhash-twice")
    # the documents travel as one struct, so no name of theirs can meet one of ours
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def kept(rows: DataFrame, right: DataFrame, how: str) -> DataFrame:
        a, b = rows.alias("l"), right.hint("merge").alias("r")
        return a.join(b, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.mark") == F.col("r.mark")), how)

    # the kept ids grow with the input, so they are dealt by key at every size and never sent to all tasks
    out = kept(rows, first, "left_semi")
    if twice.limit(1).count():
        again = kept(out, twice, "left_semi").groupBy("id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = kept(out, twice, "left_anti").select("row").union(again.select("row"))
    return out.select("row.*")
