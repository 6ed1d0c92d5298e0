"""Per-region agreement of sources with the reference, and the summaries around it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions import stats
from tilewright.operators import tables
from tilewright.plans.registry import query
from tilewright.plans.views import AREAS, INSTANCES, MANIFEST, REF, SOURCES, TILES, areas, instances, manifest, table, tiles

R = lambda c, name, n=6: F.round(c, n).alias(name)
CCC = "case when count(*) filter (where x is not null and y is not null) >= 5 then 2*covar_samp(y, x)/(var_pop(case when y is not null then x end)+var_pop(case when x is not null then y end)+pow(avg(case when y is not null then x end)-avg(case when x is not null then y end),2)) end"


def regions(spark, d):
    """count, density, size ratio and coefficient of variation of each source's regions."""
    per = instances(spark, d, types=False).groupBy("source", "region_id").agg(F.count("*").alias("n"), stats.size_ratio(F.col("area_px")).alias("size_ratio"), stats.variation(F.col("area_px")).alias("size_cv"), F.median("area_px").alias("area_median"))
    return per.join(areas(spark, d), ["source", "region_id"], "left").withColumn("density", F.col("n") / F.col("area_mm2"))


REGION_SQL = f"""{INSTANCES}, {AREAS}, regions as (select i.*, n/area_mm2 as density, out_w, out_h, area_mm2 from (select source, region_id, count(*) as n,
 case when count(area_px) >= 10 then quantile_cont(area_px, 0.9)/greatest(quantile_cont(area_px, 0.1), 1e-6) end as size_ratio,
 stddev_pop(area_px)/greatest(avg(area_px), 1e-9) as size_cv, median(area_px) as area_median from instances group by 1, 2) i left join areas using (source, region_id))"""


def paired(spark, d, measure):
    """Each source's regions beside the reference's: source, region_id, x (reference), y."""
    r = regions(spark, d).select("source", "region_id", F.col(measure).alias("v"))
    ref = r.where(F.col("source") == REF).select("region_id", F.col("v").alias("x"))
    return r.where(F.col("source") != REF).withColumnRenamed("v", "y").join(ref, "region_id")


@query(f"""with {REGION_SQL}, p as (select a.source, m.measure, case m.measure when 'density' then r.density else r.size_ratio end as x, case m.measure when 'density' then a.density else a.size_ratio end as y
 from regions a join regions r on a.region_id = r.region_id and r.source = 'ref' cross join (values ('density'), ('size_ratio')) m(measure) where a.source <> 'ref')
 select source, measure, count(*) as regions, round({CCC}, 6) as ccc, round(corr(y, x), 6) as r, round(avg(y-x)/greatest(abs(avg(case when y is not null then x end)), 1e-9), 6) as bias from p group by 1, 2""")
def agreement_by_source(spark, d):
    """Concordance, correlation and bias of each source against the reference, per measure."""
    r = regions(spark, d).select("source", "region_id", F.col("density"), F.col("size_ratio")).unpivot(["source", "region_id"], ["density", "size_ratio"], "measure", "v")
    ref = r.where(F.col("source") == REF).select("region_id", "measure", F.col("v").alias("x"))
    p = r.where(F.col("source") != REF).withColumnRenamed("v", "y").join(ref, ["region_id", "measure"])
    x, y = F.col("x"), F.col("y")
    return p.groupBy("source", "measure").agg(F.count("*").alias("regions"), R(stats.concordance(x, y), "ccc"), R(stats.pearson(x, y), "r"), R(stats.relative_bias(x, y), "bias"))


@query(f"with {INSTANCES} select source, region_id, type_name, count(*) as n from instances group by grouping sets ((source, region_id), (source, region_id, type_name))")
def instance_counts(spark, d):
    """Counts per region and per region and type, in one pass."""
    return instances(spark, d).groupingSets([["source", "region_id"], ["source", "region_id", "type_name"]], "source", "region_id", "type_name").agg(F.count("*").alias("n"))


@query(f"with {REGION_SQL} select source, region_id, n, round(density, 6) as density, round(size_ratio, 6) as size_ratio, round(size_cv, 6) as size_cv, round(area_median, 6) as area_median from regions")
def region_table(spark, d):
    return regions(spark, d).select("source", "region_id", "n", R(F.col("density"), "density"), R(F.col("size_ratio"), "size_ratio"), R(F.col("size_cv"), "size_cv"), R(F.col("area_median"), "area_median"))


@query(f"with {INSTANCES} select source, region_id, count(*) filter (where prob >= 0.7) as kept, count(*) filter (where prob < 0.7) as dropped, round(avg(prob), 6) as mean_prob, round(quantile_cont(prob, 0.5), 6) as median_prob from instances group by 1, 2")
def confidence_filter(spark, d):
    """Unsure objects leave the counts but stay in the distribution of probabilities."""
    p = F.col("prob")
    return instances(spark, d, types=False).groupBy("source", "region_id").agg(F.count_if(p >= 0.7).alias("kept"), F.count_if(p < 0.7).alias("dropped"), R(F.avg(p), "mean_prob"), R(F.median(p), "median_prob"))


@query(f"""with {INSTANCES}, c as (select source, region_id, type_name, count(*) as n from instances group by 1, 2, 3), typed as (select *, lower(type_name) <> 'economy' as typed from c),
 per as (select source, region_id, sum(case when not typed then n else 0 end)::double/sum(n) as untyped from typed group by 1, 2)
 select t.source, t.type_name, round(sum(n)::double/any_value(tot), 6) as pooled_share, round(any_value(u.untyped), 6) as mean_untyped from typed t
 join (select source, sum(n) as tot from typed where typed group by 1) using (source) join (select source, avg(untyped) as untyped from per group by 1) u on u.source = t.source where typed group by 1, 2""")
def type_mix(spark, d):
    """Pooled shares of the types (a ratio of sums), beside the mean of the regions' untyped shares (a mean of ratios)."""
    c = instances(spark, d).groupBy("source", "region_id", "type_name").agg(F.count("*").alias("n")).withColumn("typed", F.lower("type_name") != "economy")
    per = c.groupBy("source", "region_id").agg((F.sum(F.when(~F.col("typed"), F.col("n")).otherwise(0)) / F.sum("n")).alias("untyped")).groupBy("source").agg(F.avg("untyped").alias("mean_untyped"))
    typed = c.where("typed").groupBy("source", "type_name").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("source"))
    return typed.select("source", "type_name", share.alias("s")).join(per, "source").select("source", "type_name", R(F.col("s"), "pooled_share"), R(F.col("mean_untyped"), "mean_untyped"))


@query(f"with {INSTANCES} select source, region_id, round(count(*) filter (where lower(type_name) in ('promo', 'small'))::double / nullif(count(*) filter (where lower(type_name) <> 'economy'), 0), 6) as epithelial, round(count(*) filter (where type_name = 'PROMO')::double / nullif(count(*) filter (where lower(type_name) <> 'economy'), 0), 6) as neoplastic from instances group by 1, 2")
def class_fractions(spark, d):
    """Two classes merged into one, by names of any case; one class by its exact name; both among the typed."""
    t = F.col("type_name")
    typed = F.lower(t) != "economy"
    return instances(spark, d).groupBy("source", "region_id").agg(R(stats.share(F.lower(t).isin("promo", "small"), typed), "epithelial"), R(stats.share(t == "PROMO", typed), "neoplastic"))


@query(f"""with {INSTANCES}, g as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, region_id, prob >= 0.75 as a, area_px >= 100 as b from instances), k as (select region_id, count(*)::double as n, count(*) filter (where a and b)::double as yy,
 count(*) filter (where a and not b)::double as yn, count(*) filter (where not a and b)::double as ny, count(*) filter (where not a and not b)::double as nn from g group by 1)
 select region_id, round(case when n > 0 and ((yy+yn)*(yy+ny)+(nn+yn)*(nn+ny))/(n*n) < 1 then ((yy+nn)/n - ((yy+yn)*(yy+ny)+(nn+yn)*(nn+ny))/(n*n))/(1-((yy+yn)*(yy+ny)+(nn+yn)*(nn+ny))/(n*n)) end, 6) as kappa from k""")
def kappa_by_region(spark, d):
    g = instances(spark, d, types=False).select("region_id", (F.col("prob") >= 0.75).alias("a"), (F.col("area_px") >= 100).alias("b"))
    return g.groupBy("region_id").agg(R(stats.kappa(F.col("a"), F.col("b")), "kappa"))


@query(f"with {INSTANCES} select region_id from (select distinct source, region_id from instances where area_px > 196) group by 1 having count(*) = 3")
def common_regions(spark, d):
    """Regions that every source has, in one aggregate."""
    return tables.in_all(instances(spark, d, types=False).where("area_px > 196"), "region_id", "source", len(SOURCES))


@query(f"with {INSTANCES}, h as (select distinct source, region_id from instances where area_px > 199.5) select s.source, (select count(*) from h where source = 'ref') - count(r.region_id) as missing, count(h.region_id) as present from (values ('ref'), ('var_a'), ('var_n'), ('var_x')) s(source) left join h on h.source = s.source left join (select region_id from h where source = 'ref') r on r.region_id = h.region_id group by 1")
def missing_output(spark, d):
    """How many of the reference's regions each expected source lacks; a source without any rows keeps its line."""
    have = instances(spark, d, types=False).where("area_px > 199.5").select("source", "region_id").distinct()
    ref = have.where(F.col("source") == REF).select(F.col("region_id").alias("rid"))
    names = spark.createDataFrame([(s,) for s in (*SOURCES, "var_x")], "source string")
    got = have.join(ref, F.col("region_id") == F.col("rid"), "left").groupBy("source").agg(F.count("*").alias("present"), F.count("rid").alias("_in_ref"))
    total = ref.agg(F.count("*").alias("_total"))
    return tables.lookup(names, got, "source", "left").join(F.broadcast(total)).select("source", (F.col("_total") - F.coalesce("_in_ref", F.lit(0))).alias("missing"), F.coalesce("present", F.lit(0)).alias("present"))


@query(f"with {INSTANCES} select type_name, count(*) as n, round(avg(area_px), 6) as mean_area, round(avg(prob), 6) as mean_prob, round(stddev_pop(area_px), 6) as std_area from instances group by 1")
def means_by_type(spark, d):
    return instances(spark, d).groupBy("type_name").agg(F.count("*").alias("n"), R(F.avg("area_px"), "mean_area"), R(F.avg("prob"), "mean_prob"), R(F.stddev_pop("area_px"), "std_area"))


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(f"with {INSTANCES} select source, " + ", ".join(f"round(count(*) filter (where type_name = '{t}')::double/count(*), 6) as {t.lower()}" for t in TYPES) + " from instances group by 1")
def version_type_share(spark, d):
    """A row per source, a column per type; types without rows are 0."""
    wide = instances(spark, d).groupBy("source").pivot("type_name", list(TYPES)).agg(F.count(F.lit(1))).na.fill(0)
    whole = sum((F.col(t) for t in TYPES), F.lit(0))
    return wide.select("source", *[R(F.col(t) / whole, t.lower()) for t in TYPES])


@query(f"with {INSTANCES}, t as (select source, region_id, type_name, avg(area_px) as m, count(*) as n from instances group by 1, 2, 3) select source, type_name, round(avg(m) filter (where n > 10), 6) as pooled, count(*) filter (where n > 10) as tiles from t group by 1, 2")
def two_level_means(spark, d):
    """Means over regions of the regions' means; a region votes only with more than ten objects."""
    t = instances(spark, d).groupBy("source", "region_id", "type_name").agg(F.avg("area_px").alias("m"), F.count("*").alias("n"))
    return t.groupBy("source", "type_name").agg(R(F.avg(F.when(F.col("n") > 10, F.col("m"))), "pooled"), F.count_if(F.col("n") > 10).alias("tiles"))


@query(f"with {INSTANCES} select source, " + ", ".join(f"round(quantile_cont(area_px, {q / 100}), 6) as p{q:02d}" for q in (5, 25, 50, 75, 95)) + " from instances group by 1")
def quantile_summary(spark, d):
    p = instances(spark, d, types=False).groupBy("source").agg(F.percentile("area_px", F.array(*[F.lit(q / 100) for q in (5, 25, 50, 75, 95)])).alias("p"))
    return p.select("source", *[R(F.col("p")[i], f"p{q:02d}") for i, q in enumerate((5, 25, 50, 75, 95))])


@query(f"with {INSTANCES} select source, count(area_px) as n, round(sum(area_px)/count(area_px), 6) as mean, round(sqrt(greatest(sum(area_px*area_px)/count(area_px)-pow(sum(area_px)/count(area_px),2), 1e-12)), 4) as std from instances group by 1")
def pooled_moments(spark, d):
    return tables.pooled_moments(instances(spark, d, types=False), ["source"], "area_px").select("source", "n", R(F.col("mean"), "mean"), R(F.col("std"), "std", 4))


@query(f"with {INSTANCES}, w as (select region_id, l_suppkey, median(cx) - 500 as dy, median(cy) - 500 as dx from instances group by 1, 2) select region_id, round(sqrt(pow(median(dy),2)+pow(median(dx),2)), 6) as shift, count(*) filter (where sqrt(dy*dy+dx*dx) > 100) as over_100, count(*) filter (where sqrt(dy*dy+dx*dx) > 200) as over_200 from w group by 1 order by shift desc, region_id limit 15")
def core_shift(spark, d):
    """The fifteen regions with the largest median shift of their wells."""
    w = instances(spark, d, types=False).groupBy("region_id", "l_suppkey").agg((F.median("cx") - 500).alias("dy"), (F.median("cy") - 500).alias("dx"))
    far = F.hypot("dy", "dx")
    got = w.groupBy("region_id").agg(R(F.hypot(F.median("dy"), F.median("dx")), "shift"), F.count_if(far > 100).alias("over_100"), F.count_if(far > 200).alias("over_200"))
    return got.orderBy(F.desc("shift"), "region_id").limit(15)


@query("select n as per_core, count(*) as cores from (select o_custkey, count(*) as n from orders group by 1) group by 1")
def histogram_of_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("per_core")).groupBy("per_core").agg(F.count("*").alias("cores"))


@query(f"with {INSTANCES} select source, count(distinct region_id) as tiles, count(*) filter (where prob < 0.6) as hits, round(sum(case when prob < 0.6 then area_px else 0 end)/sum(area_px), 6) as part, max(area_px) as largest from instances group by rollup(source)")
def artifact_rollup(spark, d):
    """Per source, and a line for all."""
    low = F.col("prob") < 0.6
    return instances(spark, d, types=False).rollup("source").agg(F.count_distinct("region_id").alias("tiles"), F.count_if(low).alias("hits"), R(F.sum(F.when(low, F.col("area_px")).otherwise(0.0)) / F.sum("area_px"), "part"), F.max("area_px").alias("largest"))


@query(f"with {TILES}, p as (select quantile_cont(tissue, 0.4) as t from tiles) select y, count(*) as tiles, round(avg(case when tissue >= t then 1.0 else 0.0 end), 6) as keep_rate from tiles, p group by 1")
def keep_rate(spark, d):
    """Tiles at or over the 40th percentile of all, as a rate per row of tiles."""
    t = tiles(spark, d)
    level = t.agg(F.percentile("tissue", 0.4).alias("level"))
    return t.join(F.broadcast(level)).groupBy("y").agg(F.count("*").alias("tiles"), R(F.avg((F.col("tissue") >= F.col("level")).cast("double")), "keep_rate"))


REASON_SQL = "case when tissue < 0.2 then 'empty' when x = 0 then 'edge' when y % 512 = 0 then 'thin' else 'kept' end"


@query(f"with {TILES} select {REASON_SQL} as reason, count(*) as n from tiles group by 1")
def reject_reasons(spark, d):
    """Which rule rejected a tile; the first that fits is the reason."""
    reason = F.when(F.col("tissue") < 0.2, "empty").when(F.col("x") == 0, "edge").when(F.col("y") % 512 == 0, "thin").otherwise("kept")
    return tiles(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""with {REGION_SQL}, m as (select source, median(density) as density, median(size_ratio) as size_ratio, median(size_cv) as size_cv, median(area_median) as area from regions group by 1), u as (unpivot m on density, size_ratio, size_cv, area into name k value v)
 select u.source, round(avg(abs(u.v/nullif(r.v, 0)-1)), 6) as distance from u join u r on r.k = u.k and r.source = 'ref' where u.source <> 'ref' group by 1""")
def distance_to_reference(spark, d):
    """Mean relative gap of four medians; a reference of 0 leaves its measure out."""
    m = regions(spark, d).groupBy("source").agg(F.median("density").alias("density"), F.median("size_ratio").alias("size_ratio"), F.median("size_cv").alias("size_cv"), F.median("area_median").alias("area"))
    u = m.unpivot(["source"], ["density", "size_ratio", "size_cv", "area"], "k", "v")
    ref = u.where(F.col("source") == REF).select("k", F.col("v").alias("ref"))
    return tables.lookup(u.where(F.col("source") != REF), ref, "k").groupBy("source").agg(R(F.avg(F.abs(F.try_divide("v", "ref") - 1)), "distance"))


@query(f"with {REGION_SQL}, s as (select region_id, avg(density) as t, stddev_pop(density) as s from regions group by 1) select source, round(avg(abs(density - t)/(s + 1e-9)), 6) as error from regions join s using (region_id) group by 1")
def normalised_error(spark, d):
    r = regions(spark, d).select("source", "region_id", "density")
    s = r.groupBy("region_id").agg(F.avg("density").alias("t"), F.stddev_pop("density").alias("s"))
    return r.join(s, "region_id").groupBy("source").agg(R(F.avg(F.abs(F.col("density") - F.col("t")) / (F.col("s") + 1e-9)), "error"))


@query(f"with {TILES} select x, arg_min(vec_id, (-(tissue*size), vec_id)) as representative, max(tissue*size) as strength from tiles group by 1")
def representative_tile(spark, d):
    """The strongest tile of each column; the first among equals."""
    s = F.col("tissue") * F.col("size")
    return tiles(spark, d).groupBy("x").agg(F.max_by("vec_id", F.struct(s, -F.col("vec_id"))).alias("representative"), F.max(s).alias("strength"))


@query(f"with {TILES}, c as (select 'y' as axis, y as v from tiles union select 'x', x from tiles), l as (select v - lag(v) over (partition by axis order by v) as s from c) select min(s) as stride from l where s > 0")
def min_stride(spark, d):
    """The smallest positive gap between coordinates of either axis."""
    t = tiles(spark, d)
    c = t.select(F.lit("y").alias("axis"), F.col("y").alias("v")).union(t.select(F.lit("x"), F.col("x"))).distinct()
    return c.select((F.col("v") - F.lag("v").over(Window.partitionBy("axis").orderBy("v"))).alias("s")).where("s > 0").agg(F.min("s").alias("stride"))


@query(f"with {REGION_SQL}, p as (select a.source, a.density as v, r.density as he from regions a join regions r on r.region_id = a.region_id and r.source = 'ref' where a.source <> 'ref') select source, round(median(v), 4) as median_v, round(median(case when he > 0 then v/he end), 6) as median_ratio, count(*) filter (where v < 1e-4) as zeros, count(*) filter (where v is null) as absent from p group by 1")
def ratio_sweep(spark, d):
    p = paired(spark, d, "density")
    v, he = F.col("y"), F.col("x")
    return p.groupBy("source").agg(R(F.median(v), "median_v", 4), R(F.median(F.when(he > 0, v / he)), "median_ratio"), F.count_if(v < 1e-4).alias("zeros"), F.count_if(v.isNull()).alias("absent"))


@query(f"with {MANIFEST} select core, string_agg(distinct stage, ' ' order by stage) as stages, count(distinct sample) as samples from manifest group by 1")
def stages_of_core(spark, d):
    """Sorted distinct names joined by a space."""
    return manifest(spark, d).groupBy("core").agg(F.array_join(F.array_sort(F.collect_set("stage")), " ").alias("stages"), F.count_distinct("sample").alias("samples"))


@query(f"with {REGION_SQL} select a.source, a.region_id, round(a.density - r.density, 4) as density_gap, round(a.size_ratio - r.size_ratio, 6) as ratio_gap from regions a left join regions r on r.region_id = a.region_id and r.source = 'ref' where a.source <> 'ref'")
def signed_gaps(spark, d):
    """Differences from the reference; missing on either side is NULL."""
    r = regions(spark, d).select("source", "region_id", "density", "size_ratio")
    ref = r.where(F.col("source") == REF).select("region_id", F.col("density").alias("rd"), F.col("size_ratio").alias("rs"))
    return r.where(F.col("source") != REF).join(ref, "region_id", "left").select("source", "region_id", R(F.col("density") - F.col("rd"), "density_gap", 4), R(F.col("size_ratio") - F.col("rs"), "ratio_gap"))


@query(f"with {AREAS} select count(distinct out_w*10000+out_h) as sizes, min(out_w) as min_w, max(out_w) as max_w, array_to_string(list_sort(list(distinct out_h)), ' ') as heights, round(min(out_w)*0.25::double, 6) as min_um from areas")
def manifest_summary(spark, d):
    a = areas(spark, d)
    return a.agg(F.count_distinct(F.col("out_w") * 10000 + F.col("out_h")).alias("sizes"), F.min("out_w").alias("min_w"), F.max("out_w").alias("max_w"), F.array_join(F.array_sort(F.collect_set("out_h")), " ").alias("heights"), R(F.min("out_w") * F.lit(0.25).cast("double"), "min_um"))


@query(f"with {AREAS} select source, sum(((out_w-64)//32+1)*((out_h-64)//32+1))::bigint as windows from areas group by 1")
def expected_windows(spark, d):
    per = lambda c: F.floor((F.col(c) - 64) / 32) + 1
    return areas(spark, d).groupBy("source").agg(F.sum(per("out_w") * per("out_h")).alias("windows"))


@query(f"with {MANIFEST} select count(*) filter (where stage = 'URGENT') as urgent, count(*) filter (where len(links) > 1) as several, count(*) filter (where links is not null) as linked, count(*) filter (where links is not null and len(links) = 0) as no_match from manifest")
def candidate_counts(spark, d):
    n = F.array_size("links")
    return manifest(spark, d).agg(F.count_if(F.col("stage") == "URGENT").alias("urgent"), F.count_if(n > 1).alias("several"), F.count_if(F.col("links").isNotNull()).alias("linked"), F.count_if(n == 0).alias("no_match"))


@query("with c as (select p_brand, p_size, count(*) as n from part group by 1, 2) select p_brand, arg_min(p_size, (-n, p_size)) as mode, max(n) as n from c group by 1")
def mode_by_group(spark, d):
    """The most frequent value; the smallest among equals."""
    c = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return c.groupBy("p_brand").agg(F.min_by("p_size", F.struct(-F.col("n"), F.col("p_size"))).alias("mode"), F.max("n").alias("n"))


@query(f"with {INSTANCES}, h as (select source, region_id, abs(hash_bucket) % 20 as rep, area_px from (select *, l_partkey + l_suppkey*7 + l_linenumber*13 as hash_bucket from instances)), m as (select source, rep, avg(area_px) filter (where region_id % 2 = 0) as a, avg(area_px) filter (where region_id % 2 = 1) as b, count(*) as n from h group by 1, 2 having count(*) >= 8) select source, count(*) as reps, round(avg(abs(a-b)), 6) as mean_gap, round(quantile_cont(abs(a-b), 0.95), 6) as p95_gap from m group by 1")
def split_half_floor(spark, d):
    """How far two disjoint halves of one source differ, over twenty deals of its objects."""
    rep = F.abs(F.col("l_partkey") + F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 20
    half = lambda k: F.avg(F.when(F.col("region_id") % 2 == k, F.col("area_px")))
    m = instances(spark, d, types=False).groupBy("source", rep.alias("rep")).agg(half(0).alias("a"), half(1).alias("b"), F.count("*").alias("n")).where("n >= 8")
    gap = F.abs(F.col("a") - F.col("b"))
    return m.groupBy("source").agg(F.count("*").alias("reps"), R(F.avg(gap), "mean_gap"), R(F.percentile(gap, 0.95), "p95_gap"))


@query(f"with {INSTANCES} select label, count(*) as n, count(distinct region_id) as cores from (select 'all' as label, * from instances union all select 'sure', * from instances where prob >= 0.7 union all select 'large', * from instances where area_px >= 100 union all select 'both', * from instances where prob >= 0.7 and area_px >= 100) group by 1")
def stratified_counts(spark, d):
    """Rows and distinct cores under each filter and under both, from one scan."""
    i = instances(spark, d, types=False)
    names = F.filter(F.array(F.lit("all"), F.when(F.col("prob") >= 0.7, "sure"), F.when(F.col("area_px") >= 100, "large"), F.when((F.col("prob") >= 0.7) & (F.col("area_px") >= 100), "both")), lambda v: v.isNotNull())
    return i.select("region_id", F.explode(names).alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("region_id").alias("cores"))


@query(f"with {INSTANCES} select region_id, source, count(*) as n from instances where source = 'var_a' group by 1, 2 union all select region_id, 'merged', count(*) from instances where source <> 'var_a' group by 1")
def merged_counters(spark, d):
    """Counts of two sources added up, beside a third's."""
    name = F.when(F.col("source") == "var_a", "var_a").otherwise("merged")
    return instances(spark, d, types=False).groupBy("region_id", name.alias("source")).agg(F.count("*").alias("n"))
