"""Kernels on rasters: pixel tables where a window or an aggregate can say it, tiles as arrays where not."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions import color
from tilewright.operators import raster, tables
from tilewright.plans.agreement import R
from tilewright.plans.registry import query
from tilewright.plans.views import PIXELS, pixels

#: Tiles of 20 pixels every 12: shifted copies of an image that overlap.
OVER = f"{PIXELS}, placed as (select img, y, x, v, u, ty, tx, y - ty as oy, x - tx as ox, ((ty//12)*2 + tx//12)::bigint as tile from pixels, (values (0), (12)) a(ty), (values (0), (12)) b(tx) where y >= ty and y < ty + 20 and x >= tx and x < tx + 20)"


def placed(spark, d):
    """Each pixel once for each tile that shows it."""
    c = lambda a, p: F.filter(F.array(F.lit(0), F.lit(12)), lambda t: (F.col(p) >= t) & (F.col(p) < t + 20))
    p = pixels(spark, d).withColumn("ty", F.explode(c("ty", "y"))).withColumn("tx", F.explode(c("tx", "x")))
    return p.withColumn("oy", F.col("y") - F.col("ty")).withColumn("ox", F.col("x") - F.col("tx")).withColumn("tile", (F.col("ty") / 12 * 2 + F.col("tx") / 12).cast("long"))


RAMP = "(least(1.0::double, (least(oy, 19-oy)+1)/8.0::double)+0.001::double)*(least(1.0::double, (least(ox, 19-ox)+1)/8.0::double)+0.001::double)"


@query(f"with {OVER} select img, y, x, round(case when count(*) = 1 then max(v + tile) else sum((v + tile)*{RAMP})/greatest(sum({RAMP}), 1e-9) end, 6) as value, count(*) as n_tiles from placed group by 1, 2, 3")
def overlap_blend(spark, d):
    """Where tiles overlap, a mean that favours the tile a pixel lies deeper in; elsewhere the pixel itself."""
    p = placed(spark, d).withColumn("w", F.col("v") + F.col("tile"))
    weight = raster.ramp(F.col("oy"), F.lit(20), 8) * raster.ramp(F.col("ox"), F.lit(20), 8)
    return raster.blend(p, ["img", "y", "x"], "w", weight).withColumn("value", F.round("value", 6))


@query(f"with {OVER}, o as (select img, y, x, arg_min(tile, (greatest(abs(oy-9.5::double), abs(ox-9.5::double)), tile)) as owner from placed group by 1, 2, 3) select img, y, x, owner, coalesce(owner <> lag(owner) over (partition by img, y order by x), false) or coalesce(owner <> lag(owner) over (partition by img, x order by y), false) as seam from o")
def ownership(spark, d):
    """The tile that owns a pixel, and whether a seam runs left of it or above."""
    distance = F.greatest(F.abs(F.col("oy") - 9.5), F.abs(F.col("ox") - 9.5))
    o = raster.owners(placed(spark, d), ["img", "y", "x"], "tile", distance)
    change = lambda part, order: F.coalesce(F.col("owner") != F.lag("owner").over(Window.partitionBy("img", part).orderBy(order)), F.lit(False))
    return o.withColumn("seam", change("y", "x") | change("x", "y"))


@query(f"with {OVER} select img, y, x, max(v) as top, arg_max(u, tile) as last from placed group by 1, 2, 3")
def merged_masks(spark, d):
    """Overlapping masks merged by the largest value, or by the last writer."""
    return placed(spark, d).groupBy("img", "y", "x").agg(F.max("v").alias("top"), F.max_by("u", "tile").alias("last"))


@query(f"with {PIXELS}, r as (select *, sum(v) over (partition by img, y order by x) as s from pixels) select img, y, x, sum(s) over (partition by img, x order by y) as area_sum from r")
def integral_image(spark, d):
    return raster.integral(pixels(spark, d).select("img", "y", "x", "v"), "img", "v").select("img", "y", "x", "area_sum")


@query(f"with {PIXELS} select img, y//5 as cy, x//5 as cx, round(avg(v), 6) as mean, count(*) as n from pixels group by 1, 2, 3")
def coarse_grid(spark, d):
    return raster.coarse(pixels(spark, d), "img", "v", 5).withColumn("mean", F.round("mean", 6))


@query(f"with {PIXELS}, s as (select img, abs(v - lag(v) over (partition by img, y order by x)) as step, (x - 4) % 8 = 0 as seam from pixels) select img, round(avg(step) filter (where seam), 6) as seam_step, round(avg(step) filter (where not seam), 6) as other_step, round(avg(step) filter (where seam)/avg(step) filter (where not seam), 6) as ratio from s where step is not null group by 1")
def seam_ratio(spark, d):
    s = raster.seam_ratio(pixels(spark, d), "img", "v", 8, 4)
    return s.select("img", *[R(F.col(c), c) for c in ("seam_step", "other_step", "ratio")])


@query(f"with {PIXELS}, m as (select img, avg(pow(v-u, 2)) as mse, max(v)-min(v) as span from pixels group by 1) select img, round(mse, 6) as mse, round(sqrt(mse), 6) as rmse, round(sqrt(mse)/nullif(span, 0), 6) as nrmse, round(case when mse > 0 then 10*log10(65025/mse) end, 6) as psnr from m")
def pixel_errors(spark, d):
    e = raster.errors(pixels(spark, d), "img", "v", "u")
    return e.select("img", *[R(F.col(c), c) for c in ("mse", "rmse", "nrmse", "psnr")])


@query(f"""with {PIXELS}, l as (select img, lag(v) over r + lead(v) over r + lag(v) over c + lead(v) over c - 4*v as lap from pixels window r as (partition by img, y order by x), c as (partition by img, x order by y))
 select img, round(var_pop(lap), 4) as focus, count(lap) as n from l where lap is not null group by 1""")
def focus_score(spark, d):
    f = raster.laplacian_focus(pixels(spark, d), "img", "v")
    return f.select("img", R(F.col("focus"), "focus", 4), "n")


def _logs(c):
    return f"(ln(greatest({c}/255.0::double, 1e-6))/-13.815510557964274::double)"


_INV = color._inverse(color.STAINS)
HED = {n: "greatest(" + " + ".join(f"{_logs(c)}*({_INV[k][j]!r}::double)" for k, c in enumerate("rgb")) + ", 0)" for j, n in enumerate("hed")}


@query(f"with {PIXELS} select img, round(avg({HED['h']}), 6) as h, round(avg({HED['e']}), 6) as e, round(avg(r - b), 6) as rb_gap, round(avg({HED['h']})/nullif(avg({HED['e']}), 0), 6) as he_ratio, round(100.0::double*count(*) filter (where g > r and g > b)/count(*), 6) as green_pct from pixels group by 1")
def stain_means(spark, d):
    """Stain amounts, their ratio, the red-blue gap and the part of green pixels per image."""
    h, e, _ = color.stains(F.col("r"), F.col("g"), F.col("b"))
    green = (F.col("g") > F.col("r")) & (F.col("g") > F.col("b"))
    return pixels(spark, d).groupBy("img").agg(R(F.avg(h), "h"), R(F.avg(e), "e"), R(F.avg(F.col("r") - F.col("b")), "rb_gap"), R(F.try_divide(F.avg(h), F.avg(e)), "he_ratio"), R(100.0 * F.count_if(green) / F.count("*"), "green_pct"))


@query(f"""with {PIXELS}, s as (select img, y, x, {HED['h']} as h from pixels), m as (select img, avg(h) as mu, stddev_pop(h) as sd from s group by 1), ref as (select avg(h) as mr, stddev_pop(h) as sr from s where img = 0)
 select s.img, y, x, round(h + 0.8::double*((h-mu)*sr/(sd+1e-9) + mr - h), 6) as matched from s join m using (img), ref where s.img > 0""")
def stain_matched(spark, d):
    """Haematoxylin of every image given the first image's mean and spread, at a strength of 0.8."""
    s = pixels(spark, d).select("img", "y", "x", color.stains(F.col("r"), F.col("g"), F.col("b"))[0].alias("h"))
    m = s.groupBy("img").agg(F.avg("h").alias("mu"), F.stddev_pop("h").alias("sd"))
    ref = s.where("img = 0").agg(F.avg("h").alias("mr"), F.stddev_pop("h").alias("sr"))
    got = s.where("img > 0").join(m, "img").join(F.broadcast(ref))  # one row
    h = F.col("h")
    return got.select("img", "y", "x", R(h + 0.8 * ((h - F.col("mu")) * F.col("sr") / (F.col("sd") + 1e-9) + F.col("mr") - h), "matched"))


def _lab_sql(r, g, b):
    lin = lambda c: f"(case when {c}/255.0::double <= 0.04045::double then {c}/255.0::double/12.92::double else pow(({c}/255.0::double+0.055::double)/1.055::double, 2.4::double) end)"
    f = lambda t: f"(case when {t} > 0.008856451679035631::double then pow({t}, 1.0::double/3) else {t}/0.12841854934601665::double + 0.13793103448275862::double end)"
    xyz = [f(f"(({p}::double*{lin(r)} + {q}::double*{lin(g)} + {s}::double*{lin(b)})/{w}::double)") for p, q, s, w in ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))]
    return f"(116*{xyz[1]} - 16)", f"(500*({xyz[0]} - {xyz[1]}))", f"(200*({xyz[1]} - {xyz[2]}))"


_LAB = _lab_sql("r", "g", "b")


@query(f"""with {PIXELS}, l as (select img, {_LAB[0]} as l, {_LAB[1]} as a, {_LAB[2]} as b, case when v < 85 then 'nucleus' when v < 170 then 'dense' else 'pale' end as part from pixels), m as (select img, part, avg(l) as l, avg(a) as a, avg(b) as b, count(*) as px from l group by 1, 2)
 select m.img, m.part, m.px, round(m.l, 6) as l, round(m.a, 6) as a, round(m.b, 6) as b, round(sqrt(pow(m.l-r.l,2)+pow(m.a-r.a,2)+pow(m.b-r.b,2)), 6) as de76 from m join m r on r.img = 0 and r.part = m.part""")
def compartment_lab(spark, d):
    """Mean Lab colour of three compartments per image, and how far each is from the first image's."""
    v = F.col("v")
    part = F.when(v < 85, "nucleus").when(v < 170, "dense").otherwise("pale")
    l, a, b = color.lab(F.col("r"), F.col("g"), F.col("b"))
    m = pixels(spark, d).select("img", part.alias("part"), l.alias("l"), a.alias("a"), b.alias("b")).groupBy("img", "part").agg(F.avg("l").alias("l"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.count("*").alias("px"))
    r = m.where("img = 0").select("part", *[F.col(c).alias("r" + c) for c in "lab"])
    de = color.difference_76(tuple(F.col(c) for c in "lab"), tuple(F.col("r" + c) for c in "lab"))
    return tables.lookup(m, r, "part").select("img", "part", "px", *[R(F.col(c), c) for c in "lab"], R(de, "de76"))


@query(f"with {PIXELS} select img, y, x, cast((v::bigint + u::bigint) % 256 as bigint) as wrapped, least(v + u, 255) as clipped from pixels")
def boosted(spark, d):
    """8-bit sums that run over, beside those that stop at the top."""
    return pixels(spark, d).select("img", "y", "x", color.wrap_add(F.col("v").cast("long"), F.col("u").cast("long")).alias("wrapped"), F.least(F.col("v") + F.col("u"), F.lit(255.0)).alias("clipped"))


@query(f"with {PIXELS}, t as (select quantile_cont(v, 0.35) as lo, quantile_cont(v, 0.75) as hi from pixels) select img, case when v <= lo then 'nucleus' when v <= hi then 'dense' else 'pale' end as part, count(*) as px, round(avg(u), 6) as mean_u from pixels, t group by 1, 2")
def pooled_compartments(spark, d):
    """Compartments by percentiles of all images together."""
    p = pixels(spark, d).select("img", "v", "u")
    t = p.agg(F.percentile("v", F.array(F.lit(0.35), F.lit(0.75))).alias("t"))
    v = F.col("v")
    part = F.when(v <= F.col("t")[0], "nucleus").when(v <= F.col("t")[1], "dense").otherwise("pale")
    return p.join(F.broadcast(t)).groupBy("img", part.alias("part")).agg(F.count("*").alias("px"), R(F.avg("u"), "mean_u"))


@query(f"with {OVER}, s as (select img, tile, y, x, v/median(v) over (partition by img, tile) as n, y-ty as oy2, x-tx as ox2 from placed) select oy2 as oy, ox2 as ox, round(median(n), 6) as field, count(*) as n from s group by 1, 2 having count(*) >= 2")
def flat_field(spark, d):
    """Median of all tiles at each place of the frame, after each tile's own level is divided out."""
    p = placed(spark, d)
    level = p.groupBy("img", "tile").agg(F.median("v").alias("m"))
    n = p.join(level, ["img", "tile"]).groupBy("oy", "ox").agg(R(F.median(F.col("v") / F.col("m")), "field"), F.count("*").alias("n"))
    return n.where("n >= 2")


@query(f"with {PIXELS} select img, min(y) as top, max(y) as bottom, min(x) as left_, max(x) as right_, count(*) as px from pixels where v < 120 and u > 30 group by 1")
def tissue_box(spark, d):
    return pixels(spark, d).where("v < 120 and u > 30").groupBy("img").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x").alias("left_"), F.max("x").alias("right_"), F.count("*").alias("px"))


@query(f"with {PIXELS}, o as (select floor(u/50)::bigint as inst, img, y, x from pixels where u >= 50) select img, inst, count(*) as area_px, round(avg(y), 6) as cy, round(avg(x), 6) as cx, max(y)-min(y)+1 as h, max(x)-min(x)+1 as w from o group by 1, 2")
def instance_shapes(spark, d):
    """Area, centroid and box of each labelled object; label 0 is background."""
    o = pixels(spark, d).where("u >= 50").select("img", F.floor(F.col("u") / 50).alias("inst"), "y", "x")
    return o.groupBy("img", "inst").agg(F.count("*").alias("area_px"), R(F.avg("y"), "cy"), R(F.avg("x"), "cx"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"))


#: The same images in SQL: every pixel of 32 x 32, 0 where an image lacks it.
FULL = f"""{PIXELS}, imgs as (select distinct img from pixels), whole as (select i.img, a.y, b.x, coalesce(p.v, 0) as v, coalesce(p.u, 0) as u
 from imgs i cross join range(0, 32) a(y) cross join range(0, 32) b(x) left join pixels p on p.img = i.img and p.y = a.y and p.x = b.x)"""


def whole_tiles(spark, d, *values):
    """All images as arrays of 32 x 32; pixels that an image lacks are 0."""
    own = pixels(spark, d).groupBy("img").agg(F.collect_list(F.struct((F.col("y") * 32 + F.col("x")).alias("i"), *values)).alias("p"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(1023).cast("long"))
    holes = F.transform(F.array_except(every, F.col("p.i")), lambda i: F.struct(i.alias("i"), *[F.lit(0.0).alias(v) for v in values]))
    full = own.select("img", F.array_sort(F.concat("p", holes)).alias("p"))
    return full.select("img", F.lit(32).alias("h"), F.lit(32).alias("w"), *[F.col(f"p.{v}").alias(v) for v in values])


@query()
def structural_similarity(spark, d):
    return raster.tile_ssim(whole_tiles(spark, d, "v", "u"), "img", "v", "u").withColumn("ssim", F.round("ssim", 6))


@query(f"""with recursive {FULL}, n as (select img, y*32 + x as id, y, x from whole where v >= 180), e as (select a.img, a.id as a, b.id as b from n a join n b on a.img = b.img and abs(a.y - b.y) + abs(a.x - b.x) = 1),
 reach(img, id, r) as (select img, id, id from n union select e.img, e.b, reach.r from reach join e on e.img = reach.img and e.a = reach.id), c as (select img, id, min(r) as c from reach group by 1, 2),
 g as (select img, c, count(*) as area, avg(y) as cy, avg(x) as cx from c join n using (img, id) group by 1, 2), k as (select *, row_number() over (partition by img order by c) as blob from g) select img, blob, area, cy, cx from k where area >= 6""")
def artifact_blobs(spark, d):
    """Connected bright parts of at least six pixels."""
    return raster.tile_blobs(whole_tiles(spark, d, "v"), "img", "v", 180.0, 6)


@query(f"""with {FULL}, m as (select img, avg(v) as m from whole group by 1), z as (select img, y, x, v - m as z from whole join m using (img)),
 s as (select a.img, sum(a.z*a.z) as a0, sum(a.z*b.z) as ay, sum(a.z*c.z) as ax from z a join z b on b.img = a.img and b.y = (a.y + 8) % 32 and b.x = a.x join z c on c.img = a.img and c.y = a.y and c.x = (a.x + 8) % 32 group by 1)
 select img, round(case when a0 > 1e-9 then (ay + ax)/(2*a0) else 0 end, 6) as score from s""")
def period_artifact(spark, d):
    return raster.tile_period(whole_tiles(spark, d, "v"), "img", "v", 8).withColumn("score", F.round("score", 6))


@query(f"""with {FULL}, s as (select a.img, a.y - b.y as dy, a.x - b.x as dx, count(*) as n, sum(a.v) as sa, sum(b.u) as sb, sum(a.v*b.u) as ab, sum(a.v*a.v) as aa, sum(b.u*b.u) as bb from whole a join whole b on a.img = b.img group by 1, 2, 3 having count(*) >= 256),
 r as (select img, dy, dx, (ab - sa*sb/n)/sqrt(greatest((aa - sa*sa/n)*(bb - sb*sb/n), 1e-9)) as ncc from s) select img, dy, dx, round(ncc, 6) as ncc from r qualify row_number() over (partition by img order by round(ncc, 9) desc, (dy + 64) % 64, (dx + 64) % 64) = 1""")
def best_shift(spark, d):
    return raster.tile_shift(whole_tiles(spark, d, "v", "u"), "img", "v", "u").withColumn("ncc", F.round("ncc", 6))


@query(f"""with {FULL}, b as (select img, y, x, (u < 20)::int as bad, (v < 120)::int as tis from whole), r as (select img, y, x, sum(bad) over w as rb, sum(tis) over w as rt from b window w as (partition by img, y order by x)),
 s as (select img, y + 1 as y, x + 1 as x, sum(rb) over w as sb, sum(rt) over w as st from r window w as (partition by img, x order by y) union all select img, 0, x, 0, 0 from imgs, range(0, 33) g(x) union all select img, y, 0, 0, 0 from imgs, range(1, 33) g(y)),
 c as (select img, ny, nx, y, x from imgs, range(1, 9) a(ny), range(1, 9) e(nx), range(0, 32) f(y), range(0, 32) g(x) where y <= 32 - 4*ny and x <= 32 - 4*nx),
 q as (select c.*, d.sb - e.sb - f.sb + g.sb as bad, d.st - e.st - f.st + g.st as tis from c join s d on d.img = c.img and d.y = c.y + 4*ny and d.x = c.x + 4*nx join s e on e.img = c.img and e.y = c.y and e.x = c.x + 4*nx
  join s f on f.img = c.img and f.y = c.y + 4*ny and f.x = c.x join s g on g.img = c.img and g.y = c.y and g.x = c.x),
 k as (select *, row_number() over (partition by img order by ny*nx desc, abs(ny - nx), ny, tis desc, y, x) as n from q where bad = 0)
 select imgs.img, coalesce(y, 0) as y, coalesce(x, 0) as x, coalesce(ny, 0) as ny, coalesce(nx, 0) as nx from imgs left join k on k.img = imgs.img and k.n = 1""")
def clean_rectangle(spark, d):
    """The largest border-free rectangle of whole tiles of four pixels, with the most tissue among equals."""
    return raster.tile_rectangle(whole_tiles(spark, d, "u", "v"), "img", "u", 20.0, "v", 120.0, 4)
