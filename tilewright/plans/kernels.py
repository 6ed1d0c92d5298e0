"""More of the image and placement kernels as pixel tables, and the small queries around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions import stats
from tilewright.operators import raster
from tilewright.plans.agreement import R
from tilewright.plans.rasters import FULL, OVER, placed, whole_tiles
from tilewright.plans.registry import query
from tilewright.plans.views import INSTANCES, MANIFEST, PIXELS, TILES, instances, manifest, pixels, table, tiles


@query(f"with {PIXELS} select img, y, x, round(255*pow(v/255, 0.7::double), 6) as gamma_, round(least(greatest((v-128)*1.4::double+128, 0), 255), 6) as contrast, 255-v as inverted, round(0.299::double*r+0.587::double*g+0.114::double*b, 6) as gray, g as green, case when r < 10 and g < 40 and b < 40 then 255 else r end as no_black from pixels")
def point_operations(spark, d):
    """Gamma, contrast, inversion, gray, one channel, black to white: one projection."""
    v, r, g, b = (F.col(c) for c in "vrgb")
    return pixels(spark, d).select(
        "img", "y", "x", R(255 * F.pow(v / 255, F.lit(0.7)), "gamma_"), R(F.least(F.greatest((v - 128) * 1.4 + 128, F.lit(0.0)), F.lit(255.0)), "contrast"), (255 - v).alias("inverted"),
        R(0.299 * r + 0.587 * g + 0.114 * b, "gray"), g.alias("green"), F.when((r < 10) & (g < 40) & (b < 40), 255.0).otherwise(r).alias("no_black"),
    )


@query(f"with {PIXELS} select img, y, x, ((v::bigint + 60) % 256)::double as legacy, least(v + 60, 255) as flat, least(greatest(v + (u - 128)*0.5::double, 0), 255) as signed, least(v*(1 + 0.8::double*(u/255)), 255) as profile from pixels where u > 100")
def nuclei_enhancement(spark, d):
    """Four ways to raise pixels under a mask: running over, flat, signed by depth, by a profile."""
    v, u = F.col("v"), F.col("u")
    top = F.lit(255.0)
    return pixels(spark, d).where("u > 100").select("img", "y", "x", ((v.cast("long") + 60) % 256).cast("double").alias("legacy"), F.least(v + 60, top).alias("flat"), F.least(F.greatest(v + (u - 128) * 0.5, F.lit(0.0)), top).alias("signed"), F.least(v * (1 + F.lit(0.8) * (u / 255)), top).alias("profile"))


@query(f"""with {PIXELS}, h as (select img, v::bigint as k, count(*) as n from pixels group by 1, 2), c as (select img, k, sum(n) over w as n0, sum(n*k) over w as s0, sum(n) over (partition by img) as nt, sum(n*k) over (partition by img) as st from h window w as (partition by img order by k)),
 o as (select img, k, n0::double*(nt-n0)*pow(s0::double/n0 - (st-s0)::double/nullif(nt-n0, 0), 2)/(nt::double*nt) as between_ from c where nt > n0) select img, arg_min(k, (-round(between_, 6), k)) as threshold, round(max(between_), 4) as between_ from o group by 1""")
def otsu_threshold(spark, d):
    """The level that separates two classes best: cumulative sums over each image's histogram."""
    h = pixels(spark, d).groupBy("img", F.col("v").cast("long").alias("k")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("img").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("img")
    c = h.select("img", "k", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("k")).over(w).alias("s0"), F.sum("n").over(every).alias("nt"), F.sum(F.col("n") * F.col("k")).over(every).alias("st")).where("nt > n0")
    n0, n1 = F.col("n0").cast("double"), (F.col("nt") - F.col("n0")).cast("double")
    between = n0 * n1 * F.pow(F.col("s0") / n0 - (F.col("st") - F.col("s0")) / n1, 2) / F.pow(F.col("nt").cast("double"), 2)
    o = c.select("img", "k", between.alias("b"))
    return o.groupBy("img").agg(F.min_by("k", F.struct(-F.round("b", 6), F.col("k"))).alias("threshold"), R(F.max("b"), "between_", 4))


@query(f"with {PIXELS}, m as (select img, median(v) as level from pixels group by 1) select img, count(*) as px, round(avg(v), 6) as mean, round(least(greatest((max(y)-min(y)+1)::double/(max(x)-min(x)+1), 0), 10), 6) as aspect from pixels join m using (img) where v < level group by 1")
def below_median(spark, d):
    """What lies under an image's median: its size, level and aspect (clipped to 0..10)."""
    m = pixels(spark, d).groupBy("img").agg(F.median("v").alias("level"))
    p = pixels(spark, d).join(m, "img").where("v < level")
    aspect = (F.max("y") - F.min("y") + 1) / (F.max("x") - F.min("x") + 1)
    return p.groupBy("img").agg(F.count("*").alias("px"), R(F.avg("v"), "mean"), R(F.least(F.greatest(aspect, F.lit(0.0)), F.lit(10.0)), "aspect"))


@query(f"with {PIXELS}, c as (select quantile_cont(u, 0.9) as level from pixels) select img, count(*) filter (where u >= level) as purple, round(count(*) filter (where u >= level)::double/count(*), 6) as part from pixels, c group by 1")
def calibrated_level(spark, d):
    """A level taken from all images together and then applied to each as it is."""
    p = pixels(spark, d)
    level = p.agg(F.percentile("u", 0.9).alias("level"))
    hit = F.col("u") >= F.col("level")
    return p.join(F.broadcast(level)).groupBy("img").agg(F.count_if(hit).alias("purple"), R(F.avg(hit.cast("double")), "part"))


@query(f"with {PIXELS} select img, y, x, round(case when v < 85 then 0.7::double*r + 0.3::double*b when v < 170 then 0.4::double*r + 0.6::double*b else b end, 6) as blended from pixels")
def compartment_blend(spark, d):
    """Two renderings mixed by compartment."""
    v, r, b = F.col("v"), F.col("r"), F.col("b")
    return pixels(spark, d).select("img", "y", "x", R(F.when(v < 85, 0.7 * r + 0.3 * b).when(v < 170, 0.4 * r + 0.6 * b).otherwise(b), "blended"))


@query(f"with {PIXELS}, s as (select img, v - avg(v) over w as hv, u - avg(u) over w as hu from pixels window w as (partition by img, y order by x rows between 3 preceding and 3 following)) select img, round(corr(hv, hu), 6) as ncc from s group by 1")
def highpass_ncc(spark, d):
    """Correlation of two channels after each row's running mean is taken off."""
    w = Window.partitionBy("img", "y").orderBy("x").rowsBetween(-3, 3)
    s = pixels(spark, d).select("img", (F.col("v") - F.avg("v").over(w)).alias("hv"), (F.col("u") - F.avg("u").over(w)).alias("hu"))
    return s.groupBy("img").agg(R(stats.pearson(F.col("hv"), F.col("hu")), "ncc"))


@query(f"""with {OVER}, b as (select img, tile, case when ox < 8 then 'left' else 'right' end as side, avg(v) as m from placed where ox < 8 or ox >= 12 group by 1, 2, 3)
 select a.img, a.tile as i, b.tile as j, round(b.m - a.m, 6) as offset_, round(ln(b.m/a.m), 6) as log_ratio from b a join b on a.img = b.img and a.tile + 1 = b.tile and a.tile % 2 = 0 and a.side = 'right' and b.side = 'left'""")
def border_offsets(spark, d):
    """How much brighter a tile is than its neighbour where both show the same strip."""
    p = placed(spark, d).where("ox < 8 or ox >= 12")
    b = p.groupBy("img", "tile", F.when(F.col("ox") < 8, "left").otherwise("right").alias("side")).agg(F.avg("v").alias("m"))
    left = b.where("side = 'left'").select("img", F.col("tile").alias("j"), F.col("m").alias("mj"))
    right = b.where("side = 'right' and tile % 2 = 0").select("img", F.col("tile").alias("i"), F.col("m").alias("mi"), (F.col("tile") + 1).alias("j"))
    return right.join(left, ["img", "j"]).select("img", "i", "j", R(F.col("mj") - F.col("mi"), "offset_"), R(F.ln(F.col("mj") / F.col("mi")), "log_ratio"))


@query(f"with {TILES}, l as (select a.vec_id as i, b.vec_id as j, (b.y - a.y + (a.vec_id % 7)*20 - 60)::double/256 as dy, (b.x - a.x + (b.vec_id % 5)*30 - 60)::double/256 as dx from tiles a join tiles b on b.vec_id in (a.vec_id + 1, a.vec_id + 25)) select case when abs(dy) <= 0.15 and abs(abs(dx) - 1) <= 0.3 then 'h' when abs(dx) <= 0.15 and abs(abs(dy) - 1) <= 0.3 then 'v' else 'none' end as kind, count(*) as n from l group by 1")
def link_kinds(spark, d):
    """Links as horizontal, vertical or neither, within tolerances of a tile's size."""
    t = tiles(spark, d).select("vec_id", "y", "x")
    want = t.select(F.col("vec_id").alias("i"), F.col("y").alias("ay"), F.col("x").alias("ax"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 25)).alias("j"))
    l = want.join(t.withColumnRenamed("vec_id", "j"), "j")
    dy = (F.col("y") - F.col("ay") + (F.col("i") % 7) * 20 - 60) / 256
    dx = (F.col("x") - F.col("ax") + (F.col("j") % 5) * 30 - 60) / 256
    kind = F.when((F.abs(dy) <= 0.15) & (F.abs(F.abs(dx) - 1) <= 0.3), "h").when((F.abs(dx) <= 0.15) & (F.abs(F.abs(dy) - 1) <= 0.3), "v").otherwise("none")
    return l.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"with {PIXELS}, m as (select img, median(v) as m from pixels group by 1), t as (select median(m) as goal from m) select p.img, round(any_value(least(greatest(goal/m, 0.5), 2)), 6) as gain, count(*) filter (where v*least(greatest(goal/m, 0.5), 2) > 255) as clipped, round(avg(least(v*least(greatest(goal/m, 0.5), 2), 255)), 6) as mean from pixels p join m on p.img = m.img, t group by 1")
def levelled_tiles(spark, d):
    """Each image brought to the median of all medians, with its gain bounded and what is clipped counted."""
    m = pixels(spark, d).groupBy("img").agg(F.median("v").alias("m"))
    goal = m.agg(F.median("m").alias("goal"))
    g = m.join(F.broadcast(goal)).select("img", F.least(F.greatest(F.col("goal") / F.col("m"), F.lit(0.5)), F.lit(2.0)).alias("gain"))
    v = F.col("v") * F.col("gain")
    return pixels(spark, d).join(g, "img").groupBy("img").agg(R(F.first("gain"), "gain"), F.count_if(v > 255).alias("clipped"), R(F.avg(F.least(v, F.lit(255.0))), "mean"))


@query("with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) - 1 as k from part) select p_brand, p_partkey, k // 25 as sheet, (k % 25) // 5 as col_, k % 5 as row_, ((k % 25) // 5)*512 as x, (k % 5)*512 as y from r")
def fixed_grid(spark, d):
    """Tiles in the order of their names, placed column by column on sheets of 5 x 5."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    r = table(spark, d, "part").select("p_brand", "p_partkey", (F.row_number().over(w) - 1).cast("long").alias("k"))
    c, y = F.floor(F.col("k") % 25 / 5), F.col("k") % 5
    return r.select("p_brand", "p_partkey", F.floor(F.col("k") / 25).alias("sheet"), c.alias("col_"), y.alias("row_"), (c * 512).alias("x"), (y * 512).alias("y"))


@query("with e as (select a.c_custkey as id, 200 + a.c_custkey % 90 as pw, 0.5::double as pmpp, 300 + a.c_custkey % 70 as hw, 0.25::double as hmpp from customer a) select id, round(least(pw*pmpp, hw*hmpp), 6) as extent_um, round(least(pw*pmpp, hw*hmpp)/pmpp, 6) as patch_px, round(least(pw*pmpp, hw*hmpp)/hmpp, 6) as he_px from e")
def common_extent(spark, d):
    """The physical extent that two images of different scales share, in the pixels of each."""
    k = F.col("c_custkey")
    p, h = (200 + k % 90) * F.lit(0.5), (300 + k % 70) * F.lit(0.25)
    extent = F.least(p, h)
    return table(spark, d, "customer").select(k.alias("id"), R(extent, "extent_um"), R(extent / 0.5, "patch_px"), R(extent / 0.25, "he_px"))


@query(f"with {INSTANCES} select source, count(distinct region_id) as regions, source in ('ref', 'var_a', 'var_x') as asked from instances group by 1")
def variants_present(spark, d):
    """Which sources there are, and which of them were asked for."""
    return instances(spark, d, types=False).groupBy("source").agg(F.count_distinct("region_id").alias("regions")).withColumn("asked", F.col("source").isin("ref", "var_a", "var_x"))


@query(f"with {MANIFEST}, s as (select core, id, n, price, row_number() over (partition by core order by price desc, id) as k from manifest) select core, id, case when k = 1 then 'parent' when n < 5 then 'crop' when n < 12 then 'pick' else 'other' end as role from s")
def file_roles(spark, d):
    """The largest of a core is its parent; the others get their role by what they are."""
    w = Window.partitionBy("core").orderBy(F.desc("price"), "id")
    k = F.row_number().over(w)
    return manifest(spark, d).select("core", "id", F.when(k == 1, "parent").when(F.col("n") < 5, "crop").when(F.col("n") < 12, "pick").otherwise("other").alias("role"))


@query(f"with {INSTANCES} select source || ': mean=' || printf('%.3f', avg(area_px)) || ', std=' || printf('%.3f', stddev_pop(area_px)) as line from instances group by source")
def report_lines(spark, d):
    """One line of a text report per source."""
    i = instances(spark, d, types=False).groupBy("source").agg(F.avg("area_px").alias("m"), F.stddev_pop("area_px").alias("s"))
    return i.select(F.format_string("%s: mean=%.3f, std=%.3f", "source", "m", "s").alias("line"))


@query(f"with {PIXELS}, f as (select img, y, x, v, row_number() over (partition by img order by v desc, y, x) as k from pixels) select img, y, x, v from f where k <= 12")
def salient_pixels(spark, d):
    w = Window.partitionBy("img").orderBy(F.desc("v"), "y", "x")
    return pixels(spark, d).select("img", "y", "x", "v", F.row_number().over(w).alias("k")).where("k <= 12").drop("k")


@query(f"with {PIXELS} select img, y//2 as y, x//2 as x, avg(v) as v from pixels group by 1, 2, 3")
def half_size(spark, d):
    """Each two by two pixels as their mean."""
    return raster.coarse(pixels(spark, d), "img", "v", 2).select("img", F.col("cy").alias("y"), F.col("cx").alias("x"), F.col("mean").alias("v"))


def _near(source: str, how: str) -> str:
    return f"(select a.img, a.y, a.x, {how}(b.b) as b from {source} a join {source} b on a.img = b.img and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by 1, 2, 3)"


@query(f"""with {FULL}, m as (select img, y, x, (v >= 128)::bigint as b from whole), d as {_near("m", "max")}, e as {_near("d", "min")}, w as {_near("e", "max")}
 select m.img, sum(m.b)::bigint as before, sum(e.b)::bigint as closed, sum(w.b)::bigint as widened from m join e using (img, y, x) join w using (img, y, x) group by 1""")
def mask_after_closing(spark, d):
    """Covered pixels of a mask before and after it is closed and widened by one pixel."""
    return raster.tile_closing(whole_tiles(spark, d, "v"), "img", "v", 128.0, 1)


@query(f"""with {FULL}, t as (select img, y - 10 as ty, x - 10 as tx, u - avg(u) over (partition by img) as s from whole where y between 10 and 21 and x between 10 and 21),
 p as (select w.img, w.y - t.ty as y, w.x - t.tx as x, sum(w.v*t.s) as vs, sum(w.v) as v, sum(w.v*w.v) as vv, sum(t.s*t.s) as ss from whole w join t on t.img = w.img where w.y - t.ty between 0 and 20 and w.x - t.tx between 0 and 20 group by 1, 2, 3),
 r as (select img, y, x, round(vs/sqrt(greatest((vv - v*v/144)*ss, 1e-12)), 9) as ncc from p) select img, y, x, round(ncc, 6) as ncc from r qualify row_number() over (partition by img order by ncc desc, y, x) = 1""")
def template_places(spark, d):
    """Where the middle of one channel fits best in the other."""
    return raster.tile_template(whole_tiles(spark, d, "v", "u"), "img", "v", "u", 12).withColumn("ncc", F.round("ncc", 6))


@query(f"""with {FULL}, b as (select a.img, a.y, a.x, avg(w.v) - any_value(a.v) as depth from whole a cross join range(-5, 6) i(i) cross join range(-5, 6) j(j) join whole w on w.img = a.img and w.y = greatest(least(a.y + i.i, 31), 0) and w.x = greatest(least(a.x + j.j, 31), 0) group by 1, 2, 3)
 select img, round(coalesce(quantile_cont(depth, 0.75) filter (where depth > 0), 0), 6) as depth, count(*) filter (where depth > 0) as n from b group by 1""")
def hole_depths(spark, d):
    """How much darker than their surroundings the darkest parts are: the 75th percentile of the difference."""
    return raster.tile_holes(whole_tiles(spark, d, "v"), "img", "v", 5).withColumn("depth", F.round("depth", 6))


@query()
def blurred_stain(spark, d):
    """A channel scaled only where a softened mask is, and by as much as the mask says."""
    return raster.tile_masked_scale(whole_tiles(spark, d, "v", "u"), "img", "v", "u", 100.0, 1.3, 2.0).withColumn("mean", F.round("mean", 6))


@query()
def local_contrast(spark, d):
    """Contrast-limited equalisation by tiles of eight pixels."""
    return raster.tile_equalised(whole_tiles(spark, d, "v"), "img", "v", 8, 4.0).select("img", R(F.col("mean"), "mean"), R(F.col("std"), "std"))


@query(f"""with {PIXELS}, m as (select img, floor(u/50)::bigint as inst, count(*) as n, var_pop(y) as vy, var_pop(x) as vx, covar_pop(y, x) as c from pixels where u >= 50 group by 1, 2 having count(*) >= 5),
 e as (select *, (vy+vx)/2 + sqrt(pow((vy-vx)/2, 2) + c*c) as l1, (vy+vx)/2 - sqrt(pow((vy-vx)/2, 2) + c*c) as l2 from m) select img, inst, n, round(4*sqrt(l1), 6) as major, round(4*sqrt(greatest(l2, 0)), 6) as minor_, round(sqrt(greatest(1 - l2/l1, 0)), 5) as eccentricity, round(2*sqrt(n/pi()), 6) as eqdiam from e where l1 > 0""")
def instance_ellipses(spark, d):
    """Axes and eccentricity of the ellipse with an object's second moments, and the diameter of a disc of its area."""
    o = pixels(spark, d).where("u >= 50").select("img", F.floor(F.col("u") / 50).alias("inst"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    m = o.groupBy("img", "inst").agg(F.count("*").alias("n"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("c")).where("n >= 5")
    half, root = (F.col("vy") + F.col("vx")) / 2, F.sqrt(F.pow((F.col("vy") - F.col("vx")) / 2, 2) + F.col("c") * F.col("c"))
    e = m.withColumn("l1", half + root).withColumn("l2", half - root).where("l1 > 0")
    zero = F.lit(0.0)
    return e.select("img", "inst", "n", R(4 * F.sqrt("l1"), "major"), R(4 * F.sqrt(F.greatest("l2", zero)), "minor_"), R(F.sqrt(F.greatest(1 - F.col("l2") / F.col("l1"), zero)), "eccentricity", 5), R(2 * F.sqrt(F.col("n") / F.pi()), "eqdiam"))


@query()
def multi_scale_similarity(spark, d):
    return raster.tile_ms_ssim(whole_tiles(spark, d, "v", "u"), "img", "v", "u").withColumn("ms_ssim", F.round("ms_ssim", 6))


@query()
def blob_solidity(spark, d):
    """How much of its convex hull each bright part fills."""
    return raster.tile_hulls(whole_tiles(spark, d, "v"), "img", "v", 150.0, 5).withColumn("solidity", F.round("solidity", 6))


@query()
def fitted_levels(spark, d):
    """Gain and shift that bring one channel nearest to another, by a simplex search per image."""
    f = raster.tile_fit(whole_tiles(spark, d, "v", "u"), "img", "v", "u")
    return f.select("img", *[R(F.col(c), c, 3) for c in ("gain", "shift", "error")])
