"""Joins by place, name and rank, and the graphs and solutions made of links."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions import text
from tilewright.operators import solve, spatial, tables
from tilewright.plans.agreement import R
from tilewright.plans.registry import query
from tilewright.plans.views import INSTANCES, MANIFEST, TILES, instances, manifest, table, tiles

_own: list[str] = []


def shared(spark) -> str:
    """A new path in the folder that the session's spark.checkpoint.dir names. Only where that is unset and all tasks run in
    this process, the folder is one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named and not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tilewright-"))
    return f"{(named or _own[0]).rstrip('/')}/stored-{uuid.uuid4().hex}"


def stored(df):
    """df written once to the shared folder, and read back."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Two detections of the same objects: the reference's, and a variant's. A region is so many orders, so regions grow in
#: number with the data, not in what each of them holds.
PER_REGION = 1024
POINTS = f"""{INSTANCES}, pts as (select source, l_orderkey // {PER_REGION} as region_id, l_orderkey*100 + l_linenumber*10 + l_suppkey % 10 as id, min(cx) as x, min(cy) as y from instances group by 1, 2, 3)"""


def points(spark, d, source):
    i = instances(spark, d, types=False).where(F.col("source") == source).withColumn("region_id", F.floor(F.col("l_orderkey") / PER_REGION))
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10
    return i.groupBy("region_id", key.alias("id")).agg(F.min("cx").alias("x"), F.min("cy").alias("y"))


MUTUAL = f"""{POINTS}, near as (select a.region_id, a.id as a_id, b.id as b_id, sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2)) as d from pts a join pts b on a.region_id = b.region_id and a.source = 'ref' and b.source = 'var_a' and abs(a.x-b.x) <= 20 and abs(a.y-b.y) <= 20),
 r as (select *, row_number() over (partition by region_id, a_id order by d, b_id) as ra, row_number() over (partition by region_id, b_id order by d, a_id) as rb from near where d <= 20), pairs as (select region_id, a_id, b_id, d from r where ra = 1 and rb = 1)"""


@query(f"with {MUTUAL} select region_id, a_id, b_id, round(d, 6) as d from pairs")
def mutual_pairs(spark, d):
    """Objects of two detections that are each other's nearest, within a tolerance."""
    m = spatial.mutual_nearest(points(spark, d, "ref"), points(spark, d, "var_a"), ["region_id"], 20.0)
    return m.select("region_id", "a_id", "b_id", R(F.col("d"), "d"))


@query(f"with {MUTUAL}, t as (select (a_id // 10) % 3 as ta, (b_id // 10) % 3 as tb, count(*) as n from pairs group by 1, 2) select ta, tb, n, round(n::double/sum(n) over (partition by ta), 6) as share from t where ta > 0 and tb > 0".replace("sum(n) over (partition by ta)", "sum(n) over (partition by ta)"))
def confusion(spark, d):
    """Types of matched objects against each other, both typed, as shares of the reference's type."""
    m = spatial.mutual_nearest(points(spark, d, "ref"), points(spark, d, "var_a"), ["region_id"], 20.0)
    kind = lambda c: F.floor(F.col(c) / 10) % 3
    t = m.select(kind("a_id").alias("ta"), kind("b_id").alias("tb")).where("ta > 0 and tb > 0").groupBy("ta", "tb").agg(F.count("*").alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("ta")), 6))


@query(f"with {POINTS} select a.region_id, a.id as i, b.id as j, round(b.x-a.x, 6) as dx, round(b.y-a.y, 6) as dy from pts a join pts b on a.region_id = b.region_id and a.source = 'ref' and b.source = 'ref' and a.id < b.id and abs(a.x-b.x) < 12 and abs(a.y-b.y) < 12")
def candidate_links(spark, d):
    """Pairs of nodes near enough in both axes to overlap."""
    return spatial.box_pairs(points(spark, d, "ref"), ["region_id"], 12.0).select("region_id", "i", "j", R(F.col("dx"), "dx"), R(F.col("dy"), "dy"))


@query(f"with {POINTS}, n as (select a.region_id, a.id, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) as d from pts a join pts b on a.region_id = b.region_id and a.source = 'ref' and b.source = 'ref' and a.id <> b.id group by 1, 2) select region_id, count(*) as n, round(median(d), 6) as median_nn from n group by 1")
def nearest_neighbour_distance(spark, d):
    n = spatial.nearest_other(points(spark, d, "ref"), ["region_id"], 32.0, stored)
    return n.groupBy("region_id").agg(F.count("*").alias("n"), R(F.median("d"), "median_nn"))


@query("select a.n_nationkey as a, b.n_nationkey as b, abs(a.n_regionkey - b.n_regionkey) as gap from nation a join nation b on a.n_nationkey < b.n_nationkey")
def all_slide_pairs(spark, d):
    """Every two of a few slides: from one array of them, a fixed dimension of some dozens."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    every = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["n_nationkey"] > a["n_nationkey"]), lambda b: F.struct(a["n_nationkey"].alias("a"), b["n_nationkey"].alias("b"), F.abs(a["n_regionkey"] - b["n_regionkey"]).alias("gap")))))
    return every.select(F.explode(pairs).alias("p")).select("p.*")


@query(f"with {TILES}, m as (select p_partkey // 25 as cy, p_partkey % 25 as cx, p_size > 20 as inside from part) select count(*) as tiles, count(*) filter (where inside) as covered, round(count(*) filter (where inside)*pow(256*0.484::double/1000, 2), 6) as cover_mm2 from tiles join m on cy = (y + 128) // 256 and cx = (x + 128) // 256")
def mask_coverage(spark, d):
    """Tiles whose centre lies in a mask: an equality join on the mask's cell."""
    k = F.col("p_partkey")
    mask = table(spark, d, "part").select(F.floor(k / 25).alias("cy"), (k % 25).alias("cx"), (F.col("p_size") > 20).alias("inside"))
    t = tiles(spark, d).select(F.floor((F.col("y") + 128) / 256).alias("cy"), F.floor((F.col("x") + 128) / 256).alias("cx"))
    return t.join(mask, ["cy", "cx"]).agg(F.count("*").alias("tiles"), F.count_if(F.col("inside")).alias("covered"), R(F.count_if(F.col("inside")) * F.pow(F.lit(256 * 0.484 / 1000), 2), "cover_mm2"))


@query("with s as (select s_suppkey, s_name, 'Supplier#' || lpad((s_suppkey*3)::varchar, 9, '0') as alt from supplier), dim as (select s_name as k, s_acctbal as v from supplier where s_suppkey % 3 = 0) select s.s_suppkey, round(coalesce(a.v, b.v), 2) as value, case when a.v is not null then 'exact' when b.v is not null then 'rewritten' else 'none' end as how from s left join dim a on a.k = s.s_name left join dim b on b.k = s.alt")
def template_resolution(spark, d):
    """A tile's template by its own name, else by the rewritten one."""
    s = table(spark, d, "supplier")
    dim = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("k"), F.col("s_acctbal").alias("v"))
    alt = F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0"))
    one = tables.resolve(s.select("s_suppkey", "s_name", alt.alias("alt")), [F.col("s_name")], dim, "k", "v", "exact")
    got = tables.resolve(one, [F.col("s_name"), F.col("alt")], dim, "k", "v", "value")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("value").isNotNull(), "rewritten").otherwise("none")
    return got.select("s_suppkey", F.round("value", 2).alias("value"), how.alias("how"))


@query("with a as (select s_nationkey as g, s_name, row_number() over (partition by s_nationkey order by s_name) as i from supplier), b as (select c_nationkey as g, c_name, row_number() over (partition by c_nationkey order by c_name) as i from customer) select g, i, s_name, c_name from a full join b using (g, i)")
def positional_pairs(spark, d):
    """The i-th of one listing with the i-th of another; where one is longer, the other side is NULL."""
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), "s_name")
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), "c_name")
    return tables.zip_by_rank(a, b, "g", "s_name", "c_name").select("g", F.col("i").cast("long").alias("i"), "s_name", "c_name")


@query("with n as (select c_custkey, c_name || case when c_custkey % 2 = 0 then '_AF.tif' else '_HE_reg.tif' end as f, 'c' || (c_custkey // 2) as core from customer) select a.core, a.c_custkey as af, b.c_custkey as he from n a join n b on a.core = b.core and ends_with(a.f, '_AF.tif') and ends_with(b.f, '_HE_reg.tif')")
def suffix_pairs(spark, d):
    """Files that differ only in their suffix."""
    k = F.col("c_custkey")
    n = table(spark, d, "customer").select(k, F.concat(F.lit("c"), F.floor(k / 2), F.when(k % 2 == 0, "_AF.tif").otherwise("_HE_reg.tif")).alias("f"))
    a = n.where(F.endswith("f", F.lit("_AF.tif"))).select(F.replace("f", F.lit("_AF.tif"), F.lit("")).alias("core"), k.alias("af"))
    b = n.where(F.endswith("f", F.lit("_HE_reg.tif"))).select(F.replace("f", F.lit("_HE_reg.tif"), F.lit("")).alias("core"), k.alias("he"))
    return a.join(b, "core")


@query(f"with {MANIFEST} select m.id, m.sample, s.s_name, n.n_name from manifest m left join supplier s on s.s_suppkey = m.id % 130 left join nation n on n.n_nationkey = s.s_nationkey")
def manifest_chain(spark, d):
    """A manifest with what two further tables know of it; unknown is NULL."""
    m = manifest(spark, d).select("id", "sample")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    out = tables.lookup(m, s, F.col("id") % 130 == F.col("s_suppkey"), "left")
    return tables.lookup(out, n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("id", "sample", "s_name", "n_name")


@query("with f as (select p_partkey, (p_partkey % 12) || case when p_partkey % 3 = 0 then 'A' when p_partkey % 3 = 1 then 'B' else 'C' end as well, p_size as tile, p_partkey // 96 as plate from part) select plate, well, tile, p_partkey, row_number() over (partition by plate order by regexp_extract(well, '^(\\d+)', 1)::int, right(well, 1), tile, p_partkey) as pos from f")
def natural_order(spark, d):
    """Wells of each plate in the order a person would give them: 2B before 10A."""
    k = F.col("p_partkey")
    f = table(spark, d, "part").select(F.floor(k / 96).alias("plate"), F.concat((k % 12).cast("string"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C")).alias("well"), F.col("p_size").alias("tile"), "p_partkey")
    return f.select("plate", "well", "tile", "p_partkey", F.row_number().over(Window.partitionBy("plate").orderBy(*text.well_order(F.col("well")), "tile", "p_partkey")).cast("long").alias("pos"))


@query(f"with {MANIFEST} select core, arg_max(id, (stage = 'URGENT', round(price, 2), -id)) as best from manifest group by 1")
def lexicographic_best(spark, d):
    """The greatest by a flag, then a rounded value, then the smaller id."""
    return manifest(spark, d).groupBy("core").agg(F.max_by("id", F.struct(F.col("stage") == "URGENT", F.round("price", 2), -F.col("id"))).alias("best"))


@query(f"with {MANIFEST} select distinct core from manifest where sample = 'BUILDING' except select core from manifest where n > 30 union (select core from manifest where n = 39 intersect select core from manifest where sample <> 'BUILDING')")
def key_sets(spark, d):
    """Difference, intersection and union of key sets."""
    m = manifest(spark, d)
    k = lambda c: m.where(c).select("core")
    return k("sample = 'BUILDING'").subtract(k("n > 30")).union(k("n = 39").intersect(k("sample <> 'BUILDING'"))).distinct()


EDGES = "edges as (select distinct o_custkey as a, o_custkey + 1 + o_orderkey % 7 as b from orders)"


@query(f"""with recursive {EDGES}, e2 as (select a, b from edges union select b, a from edges), n as (select distinct a as id from e2), reach(id, r) as (select id, id from n union select e2.b, reach.r from reach join e2 on e2.a = reach.id)
 select component, count(*) as size from (select id, min(r) as component from reach group by 1) group by 1""")
def linked_groups(spark, d):
    """Connected components of the links, by their lowest node."""
    o = table(spark, d, "orders")
    e = o.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 7).alias("b")).distinct()
    nodes = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    return solve.components(e, nodes, stored).groupBy("component").agg(F.count("*").alias("size"))


def overlap_links(spark, d):
    """Links between neighbouring tiles of each row, with a known displacement and a small error."""
    t = tiles(spark, d).select(F.floor(F.col("y") / 512).alias("deck"), F.col("vec_id").alias("i"), "y", "x")
    o = t.select("deck", F.col("i").alias("j"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    near = t.join(o, "deck").where("i < j").where(F.abs(F.col("y2") - F.col("y")) + F.abs(F.col("x2") - F.col("x")) == 256)
    off = ((F.col("i") * 7 + F.col("j") * 3) % 5 - 2).cast("double")
    return near.select("deck", "i", "j", (F.col("y2") - F.col("y") + off).alias("dy"), (F.col("x2") - F.col("x") - off).alias("dx"), (1 + F.col("i") % 3).cast("double").alias("weight"))


@query()
def tile_positions(spark, d):
    """Least-squares places of each deck's tiles, its first tile at the origin."""
    return solve.positions(overlap_links(spark, d), "deck", anchor=10.0).select("deck", "node", R(F.col("y"), "y", 4), R(F.col("x"), "x", 4))


@query()
def tile_gains(spark, d):
    """Brightness factors that make neighbours agree, with a mean log of zero."""
    l = overlap_links(spark, d).select("deck", "i", "j", (F.col("dy") / 1000).alias("log_ratio"), "weight")
    return solve.gains(l, "deck").select("deck", "node", R(F.col("gain"), "gain"))


@query()
def placement_growth(spark, d):
    """The order in which tiles are placed when the best link to what is placed always comes next."""
    l = overlap_links(spark, d).select("deck", "i", "j", (F.col("weight") > 1).alias("good"), (1 / (1 + F.abs(F.col("dy")))).alias("ncc"))
    return solve.grow(l, "deck")
