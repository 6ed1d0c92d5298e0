"""File sources and sinks, and streams over files: each query writes its files from the tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.plans.registry import query
from tilewright.plans.spatial import shared
from tilewright.plans.views import table
from tilewright.sources import files
from tilewright.streaming import append


@query("select s_suppkey, s_name, round(s_acctbal, 1) as s_acctbal, null::varchar as note from supplier")
def marked_csv(spark, d):
    """A CSV with a byte order mark and fixed columns, written rounded and read by a schema that asks for one more."""
    path = shared(spark)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("\ufeffs_suppkey"), "s_name", "s_acctbal", "s_nationkey")
    files.write_csv(s, path, ["\ufeffs_suppkey", "s_name", "s_acctbal"], {"s_acctbal": 1})
    return files.csv(spark, path, "s_suppkey int, s_name string, s_acctbal double, note string")


@query("select p_partkey::double as p_partkey, p_name, case when p_size % 5 = 0 then null else p_size::double end as p_size from part")
def numeric_csv(spark, d):
    """A CSV without a schema: what isn't named as text is a number, and what isn't a number is NULL."""
    path = shared(spark)
    size = F.when(F.col("p_size") % 5 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    files.write_csv(table(spark, d, "part").select("p_partkey", "p_name", size.alias("p_size")), path, ["p_partkey", "p_name", "p_size"])
    return files.csv(spark, path, None, ("p_name",))


@query("select n_regionkey::varchar as folder, 1::bigint as files from nation group by 1")
def listed_files(spark, d):
    """Files below a folder as rows: how many each sub-folder holds."""
    path = shared(spark)
    table(spark, d, "nation").select("n_regionkey", "n_name").repartition(1).write.partitionBy("n_regionkey").option("header", True).csv(path)
    f = files.listing(spark, path, "*.csv")
    return f.groupBy(F.regexp_extract("path", r"n_regionkey=([0-9]+)/", 1).alias("folder")).agg(F.count("*").alias("files"))


@query("select 'tile ' || s_suppkey as name, s_suppkey * 1.5::double as y, -s_nationkey::double as x from supplier where s_suppkey % 7 > 0")
def layout_lines(spark, d):
    """Places from a layout file; comments, blank lines and lines without a place are skipped."""
    path = shared(spark)
    k = F.col("s_suppkey")
    line = F.when(k % 7 > 0, F.concat(F.lit("tile "), k, F.lit("\ty="), k * F.lit(1.5), F.lit(" x="), -F.col("s_nationkey"))).when(k % 2 == 0, F.lit("# y=1 x=1")).otherwise(F.lit("  "))
    table(spark, d, "supplier").select(line.alias("value")).write.text(path)
    return files.layout(spark, path)


@query("select o_orderstatus as source, count(*) as n, sum(case when o_orderstatus = 'F' then 2 else 1 end)::bigint as version from orders where o_orderstatus <> 'F' or o_orderkey % 2 = 0 group by 1")
def overwritten_sources(spark, d):
    """One source's rows are replaced in a table partitioned by source; the others stay."""
    path = shared(spark)
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), "o_orderkey")
    append.overwrite_sources(o.withColumn("version", F.lit(1)), path)
    append.overwrite_sources(o.where("source = 'F' and o_orderkey % 2 = 0").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("version").alias("version"))


@query("select distinct user_id from events")
def streamed_appends(spark, d):
    """A stream over a growing folder that appends each user once, run twice with new files in between."""
    source, out, state = (shared(spark) for _ in range(3))
    e = table(spark, d, "events").select("event_id", "user_id")
    schema = ", ".join(f"{c} {t}" for c, t in e.dtypes)
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        append.resume(spark, source, schema, out, state, ["user_id"]).awaitTermination()
    return spark.read.parquet(out).select("user_id")
