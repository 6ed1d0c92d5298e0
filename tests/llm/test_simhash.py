import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import simhash as S

DOCS = "doc_id long, text string, component_id int, check string"


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBcÄé \t\n\x0b\x85 ", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == S.fingerprint("A b\tc")


def slow_components(prints, radius):
    group = {i: i for i in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_a_full_scan(spark, seed):
    rng = np.random.default_rng(seed)
    prints = {}
    for k in range(30):  # chains of near fingerprints, and one dense group
        x = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 8)) if k else 120):
            prints[len(prints)] = x
            y = x
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                y ^= 1 << int(b)
            x = y if k else (x if rng.random() < 0.9 else y)
    rows = [(i, [p & 0xFFFFFFFF, p >> 32], bytearray(p.to_bytes(8, "big"))) for i, p in prints.items()]
    df = spark.createDataFrame(rows, "doc_id long, keys array<long>, check binary")
    got = {r.doc_id: r.component_id for r in S.grouped(df, 3).collect()}
    assert got == slow_components(prints, 3)


def test_links_of_a_large_run_are_few(spark):
    p = np.arange(600, dtype=np.uint64)[:, None] & np.uint64(7)
    assert len(S._forest(np.arange(600), p, 3)) == 599


def test_a_long_run_is_split_without_loss():
    rng = np.random.default_rng(4)
    for spread in (2, 9, 33):
        at = rng.choice(64, spread, replace=False)
        p = sum(rng.integers(0, 2, (500, spread)).astype(np.uint64)[:, i] << np.uint64(b) for i, b in enumerate(at))
        pairs = S._long_forest(np.arange(500), p[:, None], 3)
        group = {i: i for i in range(500)}
        for a, b in pairs:
            assert (int(p[a]) ^ int(p[b])).bit_count() <= 3 or spread <= 9
            x, y = sorted((group[a], group[b]))
            group = {i: x if g == y else g for i, g in group.items()}
        assert group == slow_components({i: int(x) for i, x in enumerate(p)}, 3)


def test_odd_rows(spark):
    rows = [(1, None, 0, "x"), (2, "", 0, "x"), (3, " \n", 0, "x"), (4, "one", 0, "x"), (4, "one", 0, "x"), (None, "One", 0, "x"), (None, "alone here", 0, "x"), (9, "w " * 50_000, 0, "x")]
    got = S.contract(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (None, None), (9, 9)}
    assert {r.fingerprint == "0" * 16 for r in got if r.doc_id in (1, 2, 3)} == {True}
    assert S.contract(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(map(chr, rng.integers(97, 123, int(rng.integers(4, 10)))))
    base = [word() for _ in range(300)]
    other = [word() for _ in range(300)]
    edited = base[:]
    edited[100], edited[200] = "changed", "another"
    half = base[:150] + other[:150]
    rows = [(1, base), (2, base), (3, edited), (4, other), (5, half), (6, other), (6, other)]
    df = spark.createDataFrame([(i, " ".join(w), 0, "x") for i, w in rows], DOCS)
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == [1, 4, 5]
    assert S.keep_one(df).columns == df.columns
    twice = spark.createDataFrame([(7, "a b c", 0, "x"), (7, "a b c", 0, "x")], DOCS)
    assert S.keep_one(twice).count() == 1
    assert S.keep_one(df.limit(0)).count() == 0


def test_keep_one_goes_by_rows(spark):
    """Null ids, equal ids with unequal texts, repeated rows, empty texts, and names that the stage might use itself."""
    names = "doc_id long, text string, _id int, _first int, component int, node int, _n int, id string, mark int, row string, none int, first int"
    rest = (1, 2, 3, 4, 5, "i", 6, "r", 7, 8)
    rows = [(None, "one text of its own here"), (None, "quite another text without id"), (5, "first under five a b c"), (5, "second under five d e f"), (7, "one text of its own here"), (8, ""), (9, None), (9, None), (3, "long " * 40_000)]
    df = spark.createDataFrame([(*r, *rest) for r in rows] + [(5, "first under five a b c", 0, *rest[1:])], names)
    got = sorted(((r.doc_id, r.text and r.text[:5], r._id) for r in S.keep_one(df).collect()), key=str)
    assert got == sorted([(7, "one t", 1), (None, "quite", 1), (5, "first", 0), (5, "secon", 1), (8, "", 1), (3, "long ", 1)], key=str)
    assert S.keep_one(df).columns == df.columns and S.keep_one(df.limit(0)).count() == 0
    assert sorted(map(tuple, S.keep_one(df.repartition(3)).collect()), key=str) == sorted(map(tuple, S.keep_one(df).collect()), key=str)
    texts = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "u v w")], "doc_id string, text string")
    assert sorted(r.doc_id for r in S.keep_one(texts).collect()) == ["a", "c"]


def edited_texts(rng, n=60):
    """Texts of 60 to 400 short or long words, and each with a passage appended, dropped or words swapped."""
    word = lambda most: "".join(map(chr, rng.integers(97, 123, int(rng.integers(2, most)))))
    texts = {}
    for i in range(n):
        size, most = int(rng.integers(60, 400)), 5 if i % 4 == 0 else 11
        base = [word(most) for _ in range(size)]
        part = int(size * rng.uniform(0.05, 0.24))
        swapped = base[:]
        for at in rng.choice(size, max(1, size // 60), replace=False):
            swapped[at] = word(most)
        for k, w in enumerate((base, base + [word(most) for _ in range(part)], base[: size - part], swapped)):
            texts[4 * i + k] = " ".join(w)
    return texts


def test_copies_equal_a_full_scan(spark):
    texts = edited_texts(np.random.default_rng(11))
    sets = {i: set(S.shingles(t, 5)) for i, t in texts.items()}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    want = {i for i, g in group.items() if i == g}
    assert len(want) < 140  # most edits are copies, and some are too far
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in texts.items()], DOCS)
    assert {r.doc_id for r in S.keep_one(df).collect()} == want


def test_copies_are_found_by_deletion_variants(spark):
    """Fingerprints are bitwise majorities; a key is a segment without one of its least certain bits; pairs that share one
    are candidates if their checks are near, as in a full scan; nearly all pairs at 0.8 share one."""
    rng = np.random.default_rng(12)
    keys, prints, near, n = {}, {}, 0, 400
    for i in range(n):
        size = int(rng.choice([9, 40, 200]))
        base = rng.integers(0, 1 << 48, size, np.uint64)
        more = rng.integers(0, 1 << 48, size, np.uint64)
        same = -(-8 * size // 9)  # of either, so that the similarity is 0.8
        for k, grams in enumerate((base, np.concatenate([base, more[: size // 4]]) if i % 2 else np.concatenate([base[:same], more[same:]]))):
            sums = [sum(1 if int(S.spread(grams[j : j + 1], lane + 1)[0]) >> b & 1 else -1 for j in range(len(grams))) for lane in range(S.LANES) for b in range(64)] if i < 8 else S.margins(grams).tolist()
            assert S.margins(grams).tolist() == sums
            whole, weak = S.wide_print(grams)
            bits = [s > 0 for s in sums]
            assert [int.from_bytes(whole, "little") >> b & 1 for b in range(64 * S.LANES)] == bits
            want = set()
            for s in range(S.SEGMENTS):
                at = range(s * S.WIDTH, (s + 1) * S.WIDTH)
                for out in sorted(at, key=lambda b: (abs(2 * sums[b] - 1), b))[: S.WEAK]:
                    want.add((s, out - at[0], sum(bits[b] << b - at[0] for b in at if b != out)))
            got = S.deletion_keys(np.frombuffer(whole, "<u8").reshape(1, -1), np.frombuffer(weak, np.uint8))[0].tolist()
            assert sorted((x >> S.WIDTH + 5, x >> S.WIDTH & 31, x & (1 << S.WIDTH) - 1) for x in got) == sorted(want)
            keys[2 * i + k], prints[2 * i + k] = set(got), (whole, weak)
        near += bool(keys[2 * i] & keys[2 * i + 1])
    assert near >= 0.99 * n
    check = {i: int.from_bytes(p[: 8 * S.CHECK], "little") for i, (p, _) in prints.items()}
    want = {(a, b) for a in keys for b in keys if a < b and keys[a] & keys[b] and (check[a] ^ check[b]).bit_count() <= S.FAR}
    df = spark.createDataFrame([(i, bytearray(p), bytearray(w)) for i, (p, w) in prints.items()] + [(-1, bytearray(), bytearray())], "node long, print binary, weak binary")
    assert {(r.a, r.b) for r in S.candidates(df).collect()} == want and len(want) >= 0.99 * n


def test_a_run_beyond_the_short_ones_is_one_group():
    rng = np.random.default_rng(6)
    own = rng.integers(0, 1 << 63, (3, S.CHECK)).astype(np.uint64)
    check = own[np.arange(3 * S.SHORT) % 3]
    pairs = S._near(np.concatenate([np.zeros(len(check)), [1, 1, 1]]).astype(np.int32), np.arange(len(check) + 3), np.concatenate([check, own[[0, 1, 0]]]))
    group = {i: i for i in range(len(check) + 3)}
    for a, b in pairs.tolist():
        x, y = sorted((group[a], group[b]))
        group = {i: x if g == y else g for i, g in group.items()}
    assert [group[i] for i in range(len(check))] == [i % 3 for i in range(len(check))]
    assert len(pairs) == len(check) - 3 + 1 and [len(check), len(check) + 2] in pairs.tolist()


@pytest.mark.parametrize("seed", range(4))
def test_links_of_a_short_run_are_a_forest(seed):
    """As many links as a group of the run has members but one, all of them with its smallest; the closure of all pairs."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (6, S.CHECK)).astype(np.uint64)
    check = base[rng.integers(0, 6, 150)]
    for i in range(len(check)):  # chains, too: some pairs of a group are farther apart than FAR
        for bit in rng.integers(0, 64 * S.CHECK, int(rng.integers(0, 50))):
            check[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    slot, node = np.sort(rng.integers(0, 4, len(check))).astype(np.int32), rng.permutation(len(check))
    group = {int(x): int(x) for x in node}
    for i in range(len(check)):
        for j in range(i):
            if slot[i] == slot[j] and np.bitwise_count(check[i] ^ check[j]).sum() <= S.FAR:
                x, y = sorted((group[int(node[i])], group[int(node[j])]))
                group = {k: x if g == y else g for k, g in group.items()}
    pairs = S._near(slot, node, check)
    assert {(int(a), int(b)) for a, b in pairs} == {(g, k) for k, g in group.items() if g != k}
    whole = S._near(np.zeros(S.SHORT, np.int32), np.arange(S.SHORT), np.repeat(base[:1], S.SHORT, 0))
    assert len(whole) == S.SHORT - 1  # it was 32,640


def test_links_that_follow_from_others_are_left_out(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    pairs = np.sort(rng.integers(0, 1 << 40, 300)[rng.integers(0, 300, (4000, 2))], 1)
    pairs = pairs[(pairs[:, 0] != pairs[:, 1]) & (pairs[:, 0] % 3 == pairs[:, 1] % 3)]
    batches = [pa.RecordBatch.from_pydict({"a": pa.array(x[:, 0]), "b": pa.array(x[:, 1])}) for x in np.array_split(pairs, 9)]
    nodes = np.unique(pairs)
    for most in (1 << 19, 700, 10):  # the last gives every batch on as a forest of its own
        monkeypatch.setattr(S, "HELD_PAIRS", most)
        got = [(a, b) for x in S.forests(iter(batches)) for a, b in zip(x[0].to_pylist(), x[1].to_pylist())]
        assert len(got) == len(nodes) - 3 if most > 10 else len(got) <= 9 * (len(nodes) - 3)
        group = {int(x): int(x) for x in nodes}
        for a, b in got:
            x, y = sorted((group[a], group[b]))
            group = {k: x if g == y else g for k, g in group.items()}
        assert group == {int(x): int(nodes[nodes % 3 == x % 3].min()) for x in nodes}
    assert not list(S.forests(iter(())))


def test_several():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(200):
        slot = np.sort(rng.integers(0, 12, int(rng.integers(0, 20))))
        cuts = [0, *sorted(rng.integers(0, len(slot) + 1, 3).tolist()), len(slot)]
        batches = [pa.RecordBatch.from_pydict({"slot": pa.array(slot[a:b], pa.int64()), "node": pa.array(np.arange(a, b), pa.int64())}) for a, b in zip(cuts, cuts[1:]) if a < b]
        got = [n for b in S._several(iter(batches)) for n in b[1].to_pylist()]
        assert got == [i for i, s in enumerate(slot) if (slot == s).sum() > 1]


def test_sparse_links_give_the_same_groups(spark):
    rng = np.random.default_rng(8)
    base = [int(rng.integers(0, 1 << 63)) for _ in range(12)]
    prints = {i: base[i % 12] ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 2).tolist())) for i in range(90)}
    rows = [(i, [p & 0xFFFFFFFF, p >> 32], bytearray(p.to_bytes(8, "big"))) for i, p in prints.items()]
    df = spark.createDataFrame(rows, "doc_id long, keys array<long>, check binary")
    group = lambda sparse: {r.doc_id: r.component_id for r in S.grouped(df, 3, sparse=sparse).collect()}
    assert group(True) == group(False) == slow_components(prints, 3)
