"""The evaluation's tables as views over the driver's: each as a DataFrame and, under the same name, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.tables import lookup

#: What stands for the reference source, and all sources.
REF, SOURCES = "ref", ("ref", "var_a", "var_n")
REGIONS = 60


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def source_of(flag: str):
    return F.when(F.col(flag) == "R", "ref").when(F.col(flag) == "A", "var_a").otherwise("var_n")


def instances(spark: SparkSession, d: str, types: bool = True) -> DataFrame:
    """One row per object. Only the columns that a query names reach the scan."""
    li = table(spark, d, "lineitem").select(
        source_of("l_returnflag").alias("source"), (F.col("l_orderkey") % REGIONS).alias("region_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity") * 4 + F.col("l_discount") * 100).alias("area_px"), (1 - F.col("l_discount") * 5).alias("prob"),
        ((F.col("l_partkey") * 37) % 1000 + F.col("l_tax") * 10).alias("cx"), ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 17) % 1000).cast("double").alias("cy"),
    )
    if not types:
        return li
    part = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("type_name"))
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


INSTANCES = """instances as (select case l_returnflag when 'R' then 'ref' when 'A' then 'var_a' else 'var_n' end as source,
 l_orderkey % 60 as region_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity*4 + l_discount*100 as area_px, 1 - l_discount*5 as prob,
 cast((l_partkey*37) % 1000 as double) + l_tax*10 as cx, cast((l_suppkey*53 + l_linenumber*17) % 1000 as double) as cy, p_type as type_name
 from lineitem join part on l_partkey = p_partkey)"""


def areas(spark: SparkSession, d: str) -> DataFrame:
    """Image size per (source, region); region 7 of var_n has none."""
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "ref").when(F.col("o_orderstatus") == "O", "var_a").otherwise("var_n").alias("source"), (F.col("o_orderkey") % REGIONS).alias("region_id"), "o_custkey")
    size = o.groupBy("source", "region_id").agg((F.max("o_custkey") % 100 + 500).alias("out_w"), (F.min("o_custkey") % 100 + 400).alias("out_h"))
    return size.where("not (source = 'var_n' and region_id = 7)").withColumn("area_mm2", F.col("out_w") * F.col("out_h") * F.lit(0.0625) / 1e6)


AREAS = """areas as (select *, cast(out_w*out_h as double)*0.0625::double/1e6::double as area_mm2 from (select case o_orderstatus when 'F' then 'ref' when 'O' then 'var_a' else 'var_n' end as source,
 o_orderkey % 60 as region_id, max(o_custkey) % 100 + 500 as out_w, min(o_custkey) % 100 + 400 as out_h from orders group by 1, 2) where not (source = 'var_n' and region_id = 7))"""


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """The tile index: 25 tiles in a row."""
    v = F.col("vec_id")
    t = table(spark, d, "embeddings").select("vec_id", (F.floor(v / 25) * 256).cast("long").alias("y"), ((v % 25) * 256).cast("long").alias("x"), F.lit(256).cast("long").alias("size"), (((v * 37) % 100).cast("double") / 100).alias("tissue"))
    return t.withColumn("tile_id", F.concat(F.lit("y"), F.col("y"), F.lit("_x"), F.col("x")))


TILES = """tiles as (select vec_id, (vec_id // 25)*256 as y, (vec_id % 25)*256 as x, 256::bigint as size, cast((vec_id*37) % 100 as double)/100 as tissue,
 'y' || (vec_id // 25)*256 || '_x' || (vec_id % 25)*256 as tile_id from embeddings)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, structure, score: each tile's vector against the first vector of each label (a handful of labels)."""
    e = table(spark, d, "embeddings")
    proto = e.groupBy(F.col("label").alias("structure")).agg(F.min_by("embedding", "vec_id").alias("_p"))
    met = e.select("vec_id", "embedding").join(F.broadcast(proto) if proto.limit(1001).count() <= 1000 else proto)
    dot = F.aggregate(F.zip_with("embedding", "_p", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return met.select("vec_id", "structure", F.round(dot, 6).alias("score"))


SCORES = """scores as (select e.vec_id, p.structure, round(list_sum(list_transform(list_zip(e.embedding, p.p), lambda z: z[1]::double * z[2]::double)), 6) as score
 from embeddings e, (select label as structure, arg_min(embedding, vec_id) as p from embeddings group by 1) p)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Images of 32 x 32 pixels, 1024 parts each; the last may be partial."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.floor(k / 1024).cast("long").alias("img"), F.floor(k / 32 % 32).cast("long").alias("y"), (k % 32).alias("x"),
        (F.col("p_retailprice").cast("long") * 7 % 256).cast("double").alias("v"), (F.col("p_size") * 5 % 256).cast("double").alias("u"),
        (F.col("p_size") * 11 % 256).cast("double").alias("r"), (F.col("p_retailprice").cast("long") % 256).cast("double").alias("g"), (k * 13 % 256).cast("double").alias("b"),
    )


PIXELS = """pixels as (select p_partkey // 1024 as img, (p_partkey // 32) % 32 as y, p_partkey % 32 as x, cast(trunc(p_retailprice)::bigint*7 % 256 as double) as v,
 cast(p_size*5 % 256 as double) as u, cast(p_size*11 % 256 as double) as r, cast(trunc(p_retailprice)::bigint % 256 as double) as g, cast(p_partkey*13 % 256 as double) as b from part)"""


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Regions of an evaluation: id, sample, n, stage; links null where the sample has no scan, [] where nothing matched."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("sample"))
    k = F.col("o_orderkey")
    files = F.transform(F.sequence(F.lit(1).cast("long"), k % 3 + 1), lambda i: F.concat(F.lit("f"), k % 97, F.lit("_"), i))
    links = F.when(F.col("sample") == "BUILDING", F.lit(None).cast("array<string>")).when(F.col("sample") == "MACHINERY", F.array().cast("array<string>")).otherwise(files)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(k.alias("id"), "sample", (k % 40).alias("n"), F.substring("o_orderpriority", 3, 20).alias("stage"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("core"), links.alias("links"))


MANIFEST = """manifest as (select o_orderkey as id, c_mktsegment as sample, o_orderkey % 40 as n, substr(o_orderpriority, 3) as stage, o_totalprice as price, o_custkey as core,
 case c_mktsegment when 'BUILDING' then null when 'MACHINERY' then []::varchar[] else list_transform(range(1, o_orderkey % 3 + 2), lambda i: 'f' || (o_orderkey % 97) || '_' || i) end as links
 from orders join customer on o_custkey = c_custkey)"""

__all__ = ["AREAS", "INSTANCES", "MANIFEST", "PIXELS", "REF", "REGIONS", "SCORES", "SOURCES", "TILES", "areas", "instances", "lookup", "manifest", "pixels", "scores", "table", "tiles"]
