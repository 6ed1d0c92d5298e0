"""Cases whose answers can be worked out by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.functions import color, stats, text
from tilewright.operators import raster, screening, solve, spatial, tables
from tilewright.plans.spatial import stored


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first()[0]


def test_concordance(spark):
    x, y = F.col("x"), F.col("y")
    same = frame(spark, [(float(i), float(i)) for i in range(10)], "x double, y double")
    assert one(same.agg(stats.concordance(x, y))) == pytest.approx(10 / 9)
    assert one(same.agg(stats.concordance(x, y, textbook=True))) == pytest.approx(1)
    few = frame(spark, [(1.0, 2.0), (3.0, 4.0), (None, 1.0), (2.0, None), (1.0, None), (5.0, None)], "x double, y double")
    assert one(few.agg(stats.concordance(x, y))) is None
    assert one(few.agg(stats.relative_bias(x, y))) == pytest.approx(0.5)


def test_pearson_of_a_flat_column(spark):
    flat = frame(spark, [(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert one(flat.agg(stats.pearson(F.col("x"), F.col("y")))) is None
    assert one(flat.agg(stats.pearson(F.col("x"), F.col("y"), zero=True))) == 0


@pytest.mark.parametrize(("cells", "want"), [((5, 0, 0, 0), None), ((1, 1, 1, 1), 0.0), ((2, 0, 0, 2), 1.0)])
def test_kappa(spark, cells, want):
    rows = [p for n, p in zip(cells, ((True, True), (True, False), (False, True), (False, False))) for _ in range(n)]
    got = one(frame(spark, rows, "a boolean, b boolean").agg(stats.kappa(F.col("a"), F.col("b"))))
    assert got is None if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(("n", "known"), [(9, False), (10, True)])
def test_size_ratio_needs_ten(spark, n, known):
    got = one(frame(spark, [(float(i + 1),) for i in range(n)], "x double").agg(stats.size_ratio(F.col("x"))))
    assert (got == pytest.approx(np.percentile(range(1, 11), 90) / np.percentile(range(1, 11), 10))) if known else got is None


@pytest.mark.parametrize(("rows", "want"), [([(None, None)], (1, 0)), ([(0.4, 0.5)], (1, 0.1)), ([(0.0, 1.0), (1.0, 3.0)], (2, 1))])
def test_axis_fit(spark, rows, want):
    got = frame(spark, rows, "x double, y double").agg(*stats.axis_fit(F.col("x"), F.col("y"))).first()
    assert tuple(got) == pytest.approx(want)


def test_wrap_add(spark):
    assert one(spark.range(1).select(color.wrap_add(F.lit(250), F.lit(10)))) == 4


def test_stains_return_to_the_colour(spark):
    rgb = [F.lit(v) for v in (180.0, 90.0, 140.0)]
    back = spark.range(1).select(*color.unstain(*color.stains(*rgb))).first()
    assert max(abs(a - b) for a, b in zip(back, (180, 90, 140))) < 3


@pytest.mark.parametrize(("p", "q", "want"), [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644)])
def test_difference_2000_of_published_pairs(spark, p, q, want):
    assert one(spark.range(1).select(color.difference_2000(tuple(map(F.lit, p)), tuple(map(F.lit, q))))) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(("n", "tile", "step", "last", "want"), [(10, 4, 3, "clamp", [0, 3, 6]), (11, 4, 3, "clamp", [0, 3, 6, 7]), (10, 5, 5, "exclusive", [0]), (10, 5, 5, "drop", [0, 5]), (3, 4, 1, "drop", []), (3, 4, 1, "clamp", [])])
def test_starts(spark, n, tile, step, last, want):
    assert sorted(one(spark.range(1).select(screening.starts(F.lit(n), F.lit(tile), F.lit(step), last)))) == want


def test_far_apart(spark):
    df = frame(spark, [("s", i, v, float(x), 0.0) for i, (v, x) in enumerate(((9.0, 0), (8.0, 1), (7.0, 5)))], "g string, key int, score double, x double, y double")
    assert sorted(r.x for r in screening.far_apart(df, "g", 2, 2.0).collect()) == [0, 5]


def test_round_robin_takes_turns(spark):
    df = frame(spark, [("a", 1, 9.0, 0.0, 0.0), ("a", 2, 8.0, 9.0, 0.0), ("b", 1, 7.0, 0.0, 0.0), ("b", 3, 1.0, 50.0, 0.0), ("b", 4, 6.0, 30.0, 0.0)], "structure string, key int, score double, x double, y double")
    got = screening.round_robin(df, 5, 2.0, 2.0, ["a", "b"]).orderBy("turn").collect()
    assert [(r.structure, r.key) for r in got] == [("a", 1), ("b", 4), ("a", 2)]


def test_mutual_nearest_gives_a_crowd_one_pair(spark):
    a = frame(spark, [(0, 1, 0.0, 0.0), (0, 2, 0.4, 0.0)], "g int, id int, x double, y double")
    b = frame(spark, [(0, 7, 0.1, 0.0)], "g int, id int, x double, y double")
    assert [(r.a_id, r.b_id) for r in spatial.mutual_nearest(a, b, ["g"], 1.0).collect()] == [(1, 7)]


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10_000))
def test_mutual_nearest_equals_a_full_scan(spark, seed):
    rng = np.random.default_rng(seed)
    p, q = rng.integers(0, 60, (40, 2)).astype(float), rng.integers(0, 60, (35, 2)).astype(float)
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    want = {(i, j) for i in range(40) for j in range(35) if d[i].argmin() == j and d[:, j].argmin() == i and d[i, j] <= 8}
    make = lambda m: frame(spark, [(0, i, *map(float, r)) for i, r in enumerate(m)], "g int, id int, x double, y double")
    assert {(r.a_id, r.b_id) for r in spatial.mutual_nearest(make(p), make(q), ["g"], 8.0).collect()} == want


def test_nearest_other_searches_as_far_as_needed(spark):
    df = frame(spark, [(0, 1, 0.0, 0.0), (0, 2, 3.0, 4.0), (0, 3, 900.0, 0.0), (1, 1, 0.0, 0.0)], "g int, id int, x double, y double")
    got = {(r.g, r.id): r.d for r in spatial.nearest_other(df, ["g"], 1.0, stored).collect()}
    assert got == {(0, 1): 5.0, (0, 2): 5.0, (0, 3): pytest.approx(math.hypot(897, 4))}


def test_positions_are_recovered(spark):
    links = frame(spark, [("c", 0, 1, 10.0, 1.0, 1.0), ("c", 1, 2, -3.0, 5.0, 2.0), ("c", 0, 2, 7.0, 6.0, 1.0)], "g string, i long, j long, dy double, dx double, weight double")
    got = {r.node: (r.y, r.x) for r in solve.positions(links, "g").collect()}
    assert got == {0: pytest.approx((0, 0)), 1: pytest.approx((10, 1)), 2: pytest.approx((7, 6))}


def test_gains_undo_a_known_level(spark):
    links = frame(spark, [(0, 0, 1, math.log(2.0), 1.0)], "g int, i long, j long, log_ratio double, weight double")
    got = {r.node: r.gain for r in solve.gains(links, "g", ridge=1e-6).collect()}
    assert got[0] / got[1] == pytest.approx(2, rel=1e-3) and got[0] * got[1] == pytest.approx(1)


def test_growth_takes_the_best_link_first(spark):
    edges = frame(spark, [(0, 1, 2, True, 0.9), (0, 1, 3, False, 0.99), (0, 2, 3, True, 0.5), (0, 8, 9, True, 0.9)], "g int, i long, j long, good boolean, ncc double")
    got = [(r.node, r.via) for r in solve.grow(edges, "g").orderBy("step").collect()]
    assert got == [(1, -1), (2, 1), (3, 2)]


def test_components(spark):
    e = frame(spark, [(0, 1), (2, 3)], "a long, b long")
    n = frame(spark, [(i,) for i in range(5)], "id long")
    got = {r.id: r.component for r in solve.components(e, n, stored).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_ownership_tie_goes_to_the_lower_tile(spark):
    p = frame(spark, [(0, 2, 1.0), (0, 1, 1.0)], "x int, t int, d double")
    assert one(raster.owners(p, ["x"], "t", F.col("d")).select("owner")) == 1


def test_blend_of_a_constant(spark):
    p = frame(spark, [(x, t, 7.0) for x in range(4) for t in (0, 1)], "x int, t int, v double")
    assert {r.value for r in raster.blend(p, ["x"], "v", raster.ramp(F.col("x"), F.lit(4), 2)).collect()} == {7.0}


def test_label_against_a_flood_fill():
    rng = np.random.default_rng(3)
    for _ in range(20):
        m = rng.random((9, 11)) < 0.55
        lab, seen, k = raster.label(m), np.zeros(m.shape, int), 0
        for y, x in np.argwhere(m):
            if not seen[y, x]:
                k += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < 9 and 0 <= b < 11 and m[a, b] and not seen[a, b]:
                        seen[a, b] = k
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        assert (lab == seen).all()


def test_kernels():
    rng = np.random.default_rng(0)
    a = rng.random((32, 32)) * 255
    assert raster.ssim(a, a) == pytest.approx(1)
    assert raster.ssim(a, rng.random((32, 32)) * 255) < 0.3
    assert raster.period_score(np.tile(rng.random((8, 8)), (4, 4)), 8) == pytest.approx(1)
    b = np.roll(a, (3, -2), (0, 1))
    dy, dx, ncc = raster.best_shift(a, b)
    assert (abs(dy), abs(dx)) == (3, 2) and ncc > 0.95
    bad = np.zeros((5, 6), bool)
    bad[2, 3] = True
    y, x, h, w = raster.clean_rectangle(bad)
    assert h * w == 15 and not bad[y : y + h, x : x + w].any()


@pytest.mark.parametrize("seed", range(30))
def test_clean_rectangle_equals_all_placements(seed):
    rng = np.random.default_rng(seed)
    bad, tissue, tile = rng.random((9, 11)) < rng.uniform(0, 0.2), rng.random((9, 11)) < 0.5, int(rng.integers(1, 4))
    every = [
        (-ny * nx, abs(ny - nx), ny, -int(tissue[y : y + ny * tile, x : x + nx * tile].sum()), y, x, nx)
        for ny in range(1, 9 // tile + 1) for nx in range(1, 11 // tile + 1) for y in range(9 - ny * tile + 1) for x in range(11 - nx * tile + 1)
        if not bad[y : y + ny * tile, x : x + nx * tile].any()
    ]
    want = (lambda b: (b[4], b[5], b[2], b[6]))(min(every)) if every else (0, 0, 0, 0)
    assert raster.clean_rectangle(bad, tile, tissue) == want


@pytest.mark.parametrize("anchor,prior", [(1.0, 0.0), (10.0, 0.0), (0.0, 0.02)])
def test_placement_equals_least_squares(anchor, prior):
    from tilewright.operators import solve

    rng = np.random.default_rng(3)
    n, m = 40, 90
    i, j = np.arange(m) % (n - 1), np.arange(m) % (n - 1) + 1
    i[n:] = rng.integers(0, n, m - n)
    keep = i != j
    i, j = i[keep], j[keep]
    shift, w = rng.normal(0, 100, len(i)), rng.uniform(0.5, 2, len(i))
    rows = [w[k] * (np.eye(n)[j[k]] - np.eye(n)[i[k]]) for k in range(len(i))] + [anchor * np.eye(n)[0]] + list(prior * np.eye(n))
    want = np.linalg.lstsq(np.array(rows), np.concatenate([w * shift, np.zeros(n + 1)]), rcond=None)[0]
    assert np.allclose(solve._anchored(n, i, j, shift, w, anchor, prior), want, atol=1e-6)


def test_names(spark):
    fov, x, y = text.placed_name(F.col("v"))
    got = frame(spark, [("a_x12_y7",), ("zz",)], "v string").select(fov, x, y).collect()
    assert [tuple(r) for r in got] == [("a", 12, 7), (None, None, None)]


def test_correspondence(spark):
    lines = frame(spark, [("1、2：p q.tif、r.tif（x）",), ("3：no match",), ("header",)], "value string")
    got = sorted((r.n, r.status, list(r.files)) for r in text.correspondence(lines).collect())
    assert got == [(1, "linked", ["p q.tif", "r.tif"]), (2, "linked", ["p q.tif", "r.tif"]), (3, "unmatched", [])]
    assert [r.value for r in text.not_understood(lines).collect()] == ["header"]


def test_reply(spark):
    r = frame(spark, [(1, "1. solid: 3\njunk\nmitoses: x\nadipose: 2/4"), (2, "")], "id int, reply string")
    got = {x.id: (x.solid, x.mitoses, x.adipose, x.n_parsed) for x in text.scored_reply(r, "id", "reply", ["solid", "mitoses", "adipose"]).collect()}
    assert got == {1: (3, 0, 0, 1), 2: (0, 0, 0, 0)}


def test_missing_numbers(spark):
    df = frame(spark, [("",), ("nan",), ("1.5",), (None,), ("x",), (" 2 ",)], "v string")
    assert [r[0] for r in df.select(text.number_or_null("v")).collect()] == [None, None, 1.5, None, None, 2.0]


def test_html_escape(spark):
    import html

    v = "<a href=\"x\">'&'</a>"
    assert one(spark.range(1).select(text.html_escape(F.lit(v)))) == html.escape(v)


def test_turns_and_even_picks(spark):
    df = frame(spark, [(g, i) for g, n in (("A", 4), ("B", 1), ("C", 2)) for i in range(1, n + 1)], "g string, i int")
    assert [(r.g, r.i) for r in screening.turns(df, "g", [F.col("i")], 5).collect()] == [("A", 1), ("B", 1), ("C", 1), ("A", 2), ("C", 2)]
    assert sorted(r.i for r in screening.even_picks(df.where("g = 'A'"), ["g"], [F.col("i")], 3).collect()) == [1, 3, 4]


def test_last_write_of_large_ids(spark, tmp_path):
    """From a million on, the last id need not have the largest n: each is an aggregate of its own, as in the SQL."""
    from tilewright import catalog

    ids = [39, 79, 200_000_000, 5_000_001, 1_000_039, 999_960]
    frame(spark, [(i, k % 2, "F", "1-URGENT", 1.0) for k, i in enumerate(ids)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    frame(spark, [(0, "BUILDING"), (1, "MACHINERY")], "c_custkey long, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.core: (r.id, r.n) for r in catalog.queries()["last_write"](spark, str(tmp_path)).collect()}
    assert got == {0: (200_000_000, 39), 1: (79, 39)}


def test_tables(spark):
    old = frame(spark, [(1, "a"), (2, "b")], "k int, v string")
    new = frame(spark, [(2, "c", 5)], "k int, v string, w int")
    assert sorted((r.k, r.v, r.w) for r in tables.upsert(old, new, ["k"]).collect()) == [(1, "a", None), (2, "c", 5)]
    seq = frame(spark, [(1, "x", 1), (1, "y", 2)], "k int, v string, s int")
    assert [tuple(r) for r in tables.last_write(seq, ["k"], "s").select("k", "v").collect()] == [(1, "y")]
    assert [tuple(r) for r in tables.first_rows(seq, ["k"], [F.col("s")]).select("k", "v").collect()] == [(1, "x")]
    a, b = frame(spark, [(1,), (2,)], "k int"), frame(spark, [(2,), (3,)], "k int")
    assert {(r.k, r.status) for r in tables.side_status(a, b, "k").collect()} == {(1, "left_only"), (2, "both"), (3, "right_only")}


def slow_picks(rows, k, separation):
    out = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if len(out) < k and all((r[3] - o[3]) ** 2 + (r[4] - o[4]) ** 2 >= separation**2 for o in out):
            out.append(r)
    return [r[1] for r in out]


def test_far_apart_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(screening, "PER_PICK", 2)  # so that some groups run out of their share
    rng = np.random.default_rng(0)
    rows = [("a" if i % 3 else "b", i, float(rng.integers(0, 50)), float(rng.integers(0, 9)), float(rng.integers(0, 9))) for i in range(150)]
    got = screening.far_apart(frame(spark, rows, "g string, key int, score double, x double, y double"), "g", 5, 4.0).orderBy("g", "rank").collect()
    for g in "ab":
        assert [r.key for r in got if r.g == g] == slow_picks([r for r in rows if r[0] == g], 5, 4.0)


def test_round_robin_plays_again_with_larger_shares(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], i, float(rng.random() * 9), float(rng.integers(0, 12)), 0.0) for i in range(200)]
    df = frame(spark, rows, "structure string, key int, score double, x double, y double")
    play = lambda: [(r.structure, r.key) for r in screening.round_robin(df, 6, 0.0, 2.0, ["a", "b"]).orderBy("turn").collect()]
    want = play()
    monkeypatch.setattr(screening, "PER_PICK", 1)
    assert play() == want and len(want) >= 4


def test_hull_simplex_and_scales():
    square = np.argwhere(np.ones((4, 5)))
    assert raster.hull_area(square) == 20
    ell = np.array([p for p in square.tolist() if p[0] == 0 or p[1] == 0])
    assert raster.hull_area(ell) == pytest.approx(20 - 0.5 * 3 * 4)
    best, error = raster.simplex(lambda t: (t[0] - 3) ** 2 + (t[1] + 1) ** 2 + 0.5 * t[0] * t[1], [0.0, 0.0])
    assert error == pytest.approx(min((a - 3) ** 2 + (b + 1) ** 2 + 0.5 * a * b for a in np.linspace(2, 5, 301) for b in np.linspace(-3, 0, 301)), abs=1e-3)
    rng = np.random.default_rng(0)
    a = rng.random((64, 64)) * 255
    assert raster.ms_ssim(a, a) == pytest.approx(1) and raster.ms_ssim(a, np.clip(a + rng.normal(0, 40, a.shape), 0, 255)) < 0.98
