"""Names, lines, replies, hashes and keys: the text side of the evaluation, and tables that grow in parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions import text
from tilewright.operators import tables
from tilewright.plans.agreement import R
from tilewright.plans.registry import query
from tilewright.plans.views import MANIFEST, SCORES, manifest, scores, table


@query("select c_custkey, lower(trim(c_mktsegment)) as segment, c_name[1:8] as head, split_part(c_name, '#', 2) as tail, replace(c_name, 'Customer', 'well') as renamed, starts_with(c_name, 'Customer') as named, lpad((c_custkey % 100)::varchar, 2, '0') || '-' || lpad((c_custkey % 7)::varchar, 4, '0') as id from customer")
def string_functions(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.lower(F.trim("c_mktsegment")).alias("segment"), F.substring(c, 1, 8).alias("head"), F.split_part(c, F.lit("#"), F.lit(2)).alias("tail"), F.replace(c, F.lit("Customer"), F.lit("well")).alias("renamed"), F.startswith(c, F.lit("Customer")).alias("named"), F.format_string("%02d-%04d", F.col("c_custkey") % 100, F.col("c_custkey") % 7).alias("id"))


NAMES = "names as (select p_partkey, case when p_partkey % 5 = 0 then 'zz' || p_partkey else 'slide_' || (p_partkey % 9) || '_x' || (p_partkey % 640) || '_y' || (p_size*3) end as f from part)"


@query(f"with {NAMES} select fov, count(*) as n, max(x) as max_x, max(y) as max_y, count(*) filter (where fov is null) as skipped from (select f, case when regexp_matches(f, '^(.*)_x(\\d+)_y(\\d+)$') then regexp_extract(f, '^(.*)_x(\\d+)_y(\\d+)$', 1) end as fov, case when regexp_matches(f, '^(.*)_x(\\d+)_y(\\d+)$') then regexp_extract(f, '^(.*)_x(\\d+)_y(\\d+)$', 2)::int else -1 end as x, case when regexp_matches(f, '^(.*)_x(\\d+)_y(\\d+)$') then regexp_extract(f, '^(.*)_x(\\d+)_y(\\d+)$', 3)::int else -1 end as y from names) group by 1")
def parsed_file_names(spark, d):
    """Field and place from file names; those of another form are counted, not read."""
    k = F.col("p_partkey")
    f = table(spark, d, "part").select(F.when(k % 5 == 0, F.concat(F.lit("zz"), k)).otherwise(F.concat(F.lit("slide_"), k % 9, F.lit("_x"), k % 640, F.lit("_y"), F.col("p_size") * 3)).alias("f"))
    fov, x, y = text.placed_name(F.col("f"))
    return f.select(fov.alias("fov"), F.coalesce(x, F.lit(-1)).alias("x"), F.coalesce(y, F.lit(-1)).alias("y")).groupBy("fov").agg(F.count("*").alias("n"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count_if(F.col("fov").isNull()).alias("skipped"))


@query("with n as (select p_partkey, 'T' || lpad((p_partkey % 30)::varchar, 3, '0') || '.tif' as f, p_size % 4 as well from part) select well, count(*) as n, min(t) as first_t, max(t) as last_t from (select well, case when well = 1 then regexp_extract(f, 'T(\\d{3})\\.tif$', 1)::int + 1 when well = 2 then 7 else regexp_extract(f, 'T(\\d{3})\\.tif$', 1)::int end as t from n) group by 1")
def well_tiles(spark, d):
    """Tile numbers from names, with two wells whose numbering is off."""
    k = F.col("p_partkey")
    n = table(spark, d, "part").select(F.format_string("T%03d.tif", k % 30).alias("f"), (F.col("p_size") % 4).alias("well"))
    t = F.regexp_extract("f", r"T(\d{3})\.tif$", 1).cast("int")
    return n.select("well", F.when(F.col("well") == 1, t + 1).when(F.col("well") == 2, 7).otherwise(t).alias("t")).groupBy("well").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("with s as (select p_brand as slide, (400 + p_size % 5 * 10) || 'nm' as wl, p_partkey from part), c as (select slide, wl, count(*) as n, min(p_partkey) as first from s group by 1, 2), b as (select slide, arg_min(wl, (-n, first)) as wl from c group by 1) select s.slide, s.wl, count(*) as n, min(p_partkey) as first from s join b on s.slide = b.slide and s.wl = b.wl group by 1, 2")
def dominant_series(spark, d):
    """Per slide only the wavelength with the most files; the one seen first among equals."""
    s = table(spark, d, "part").select(F.col("p_brand").alias("slide"), F.concat((400 + F.col("p_size") % 5 * 10).cast("string"), F.lit("nm")).alias("wl"), "p_partkey")
    c = s.groupBy("slide", "wl").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    w = Window.partitionBy("slide").orderBy(F.desc("n"), "first")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("slide", "wl", "n", "first")


REPLY = "'1. solid: ' || (n_nationkey % 5) || chr(10) || 'junk' || chr(10) || '- mitoses: x' || chr(10) || 'adipose: 2/4' || chr(10) || '**stroma**: ' || (n_nationkey % 3) || '.5 of 4'"


@query("select n_nationkey as id, (n_nationkey % 5)::double as solid, 0::double as mitoses, 0::double as adipose, (n_nationkey % 3 + 0.5)::double as stroma, 2::bigint as n_parsed from nation")
def scored_replies(spark, d):
    """`key: score` lines of a free reply: what is no number is skipped, what is missing is 0."""
    k = F.col("n_nationkey")
    r = table(spark, d, "nation").select(k.alias("id"), F.concat(F.lit("1. solid: "), k % 5, F.lit("\njunk\n- mitoses: x\nadipose: 2/4\n**stroma**: "), k % 3, F.lit(".5 of 4")).alias("reply"))
    return text.scored_reply(r, "id", "reply", ["solid", "mitoses", "adipose", "stroma"])


@query("select n_nationkey as k, n, status, files from (select n_nationkey, unnest(case when n_nationkey % 3 = 0 then [n_nationkey + 1, n_nationkey + 2] else [n_nationkey] end)::int as n, case when n_nationkey % 3 = 1 then 'unmatched' else 'linked' end as status, case when n_nationkey % 3 = 1 then '' else 'p ' || n_nationkey || '.tif|r.tif' end as files from nation)")
def correspondence_lines(spark, d):
    """Hand-written lines `1、2：a.tif、b.tif（note）`: each number gets all the line's files."""
    k = F.col("n_nationkey")
    line = F.when(k % 3 == 0, F.concat((k + 1).cast("string"), F.lit("、"), (k + 2).cast("string"), F.lit("：p "), k, F.lit(".tif、r.tif（note）"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("：no match"))).otherwise(F.concat(k.cast("string"), F.lit(":p "), k, F.lit(".tif,r.tif，r.tif")))
    lines = table(spark, d, "nation").select(k, line.alias("value"))
    out = text.correspondence(lines.select("value"))
    owner = F.when(F.col("status") == "unmatched", F.col("n")).otherwise(F.coalesce(F.regexp_extract(F.array_join("files", "|"), r"p (\d+)", 1).cast("int"), F.col("n")))
    return out.select(owner.alias("k"), "n", "status", F.array_join("files", "|").alias("files"))


@query("select key, value from (select 'um_per_px' as key, '0.484' as value union all select 'W', '13371' union all select 'note', 'a=b')")
def key_value_lines(spark, d):
    lines = spark.createDataFrame([("um_per_px=0.484",), (" W = 13371",), ("no sign here",), ("=blank key",), ("note=a=b",)], "value string")
    return text.key_values(lines)


@query("select n_nationkey as epoch, round(0.5::double/(1+n_nationkey), 3) as g_a, round(avg(round(0.5::double/(1+n_nationkey), 3)) over (order by n_nationkey rows 9 preceding), 6) as last_ten from nation")
def loss_log(spark, d):
    """A series read from log lines, and its mean over the last ten epochs."""
    k = F.col("n_nationkey")
    line = F.concat(F.lit("(epoch: "), k, F.lit(", iters: 400) D_A: 0.123 G_A: "), F.format_string("%.3f", F.round(0.5 / (1 + k), 3)), F.lit(" cycle_A: 1.5"))
    t = table(spark, d, "nation").select(line.alias("line"))
    s = t.select(F.regexp_extract("line", r"epoch: (\d+)", 1).cast("int").alias("epoch"), F.regexp_extract("line", r"\bG_A: ([0-9.]+)", 1).cast("double").alias("g_a"))
    return s.select("epoch", "g_a", R(F.avg("g_a").over(Window.orderBy("epoch").rowsBetween(-9, 0)), "last_ten"))


@query("select n_nationkey, round(sqrt(n_nationkey), 6) as root, round(sqrt(n_nationkey*n_nationkey + 16), 6) as hyp, round(exp(-n_nationkey/10.0::double), 6) as e, round(ln(n_nationkey + 1), 6) as l, n_nationkey // 4 as q, ceil(n_nationkey/4.0::double)::bigint as c, round_even(n_nationkey/2.0::double, 0) as half_even, least(greatest(n_nationkey, 3), 20) as clipped, pow(2, ceil(log2(n_nationkey + 1)))::bigint as power, round(1/(1+exp((12-n_nationkey)/3.0::double)), 6) as soft, round(n_nationkey*9525*0.484::double/914400, 9) as um from nation")
def math_functions(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k, R(F.sqrt(k), "root"), R(F.hypot(k.cast("double"), F.lit(4.0)), "hyp"), R(F.exp(-k / 10.0), "e"), R(F.ln(k + 1), "l"), F.floor(k / 4).cast("int").alias("q"), F.ceil(k / 4.0).alias("c"), F.rint(k / 2.0).alias("half_even"), F.least(F.greatest(k, F.lit(3)), F.lit(20)).alias("clipped"), F.pow(F.lit(2.0), F.ceil(F.log2(k + 1))).cast("long").alias("power"), R(1 / (1 + F.exp((12 - k) / 3.0)), "soft"), R(k * 9525 * 0.484 / 914400, "um", 9))


KNOTS = ((0.0, 0.0), (4.0, 1.0), (9.0, 1.5), (15.0, 4.0), (24.0, 4.5))


@query("select n_nationkey, round(case when n_nationkey <= 4 then n_nationkey/4.0::double when n_nationkey <= 9 then 1 + (n_nationkey-4)*0.1::double when n_nationkey <= 15 then 1.5::double + (n_nationkey-9)*2.5::double/6 else 4 + (n_nationkey-15)*0.5::double/9 end, 6) as y from nation")
def piecewise_profile(spark, d):
    """Linear interpolation between knots."""
    k = F.col("n_nationkey")
    y = F.lit(KNOTS[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(KNOTS, KNOTS[1:]))):
        y = F.when(k <= x1, y0 + (k - x0) * (y1 - y0) / (x1 - x0)).otherwise(y)
    return table(spark, d, "nation").select(k, R(y, "y"))


@query("select vec_id, list_position(embedding, list_max(embedding))::bigint - 1 as argmax, list_position(embedding, list_min(embedding))::bigint - 1 as argmin, len(list_filter(embedding, lambda v: v > 0))::bigint as positive, round(list_sum(list_transform(embedding, lambda v: v::double)), 5) as total from embeddings")
def array_functions(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", (F.array_position(e, F.array_max(e)) - 1).alias("argmax"), (F.array_position(e, F.array_min(e)) - 1).alias("argmin"), F.size(F.filter(e, lambda v: v > 0)).cast("long").alias("positive"), R(F.aggregate(e, F.lit(0.0), lambda a, v: a + v.cast("double")), "total", 5))


@query(f"with {SCORES} select vec_id, structure, score from scores")
def cosine_scores(spark, d):
    return scores(spark, d)


@query("select s_suppkey, md5(s_name) as md5, to_base64(s_name::blob) as b64, replace(replace('<b>' || s_name || ' & \"co\"</b>', '&', '&amp;'), '<', '&lt;') is not null as escaped from supplier")
def hashes_and_codes(spark, d):
    c = F.col("s_name")
    whole = F.concat(F.lit("<b>"), c, F.lit(' & "co"</b>'))
    return table(spark, d, "supplier").select("s_suppkey", F.md5(c.cast("binary")).alias("md5"), F.base64(c.cast("binary")).alias("b64"), (text.html_escape(whole) != whole).alias("escaped"))


@query("select doc_id, min(doc_id) over w as class_id, count(*) over w as class_size from documents window w as (partition by length(text), md5(text))")
def content_matches(spark, d):
    """Equal contents, by size and hash: each document with the smallest id of its class, and the class's size."""
    t = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("h"))
    c = t.groupBy(F.col("n").alias("_n"), F.col("h").alias("_h")).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return t.join(c, F.col("n").eqNullSafe(F.col("_n")) & F.col("h").eqNullSafe(F.col("_h"))).select("doc_id", "class_id", "class_size")


@query("select event_id % 4 as batch, count(*) as rows_in, count(*) filter (where first_batch = event_id % 4) as appended from (select *, min(event_id % 4) over (partition by user_id) as first_batch from events) group by 1")
def resumed_appends(spark, d):
    """Batches that add only the users that no batch before had."""
    e = table(spark, d, "events").select((F.col("event_id") % 4).alias("batch"), "user_id")
    first = e.groupBy("user_id").agg(F.min("batch").alias("first"))
    return e.join(first, "user_id").groupBy("batch").agg(F.count("*").alias("rows_in"), F.count_if(F.col("batch") == F.col("first")).alias("appended"))


@query("select s_suppkey, s_name, case when s_suppkey % 4 = 0 then 0 else s_acctbal end as s_acctbal, case when s_suppkey % 4 = 0 then 'new' end as note from supplier")
def upserted(spark, d):
    """New rows replace old ones of their key; a column the old ones lack is NULL for them."""
    s = table(spark, d, "supplier")
    new = s.where("s_suppkey % 4 = 0").select("s_suppkey", "s_name", F.lit(0.0).alias("s_acctbal"), F.lit("new").alias("note"))
    return tables.upsert(s.select("s_suppkey", "s_name", "s_acctbal"), new, ["s_suppkey"])


@query("select s_suppkey, case when s_suppkey % 3 > 0 then s_acctbal end as have, case when s_suppkey % 3 = 0 then s_nationkey*2 else -1 end as computed from supplier")
def backfilled(spark, d):
    """Keys on disk that the table lacks are computed; the rest stays."""
    s = table(spark, d, "supplier")
    have = s.where("s_suppkey % 3 > 0").select("s_suppkey", F.col("s_acctbal").alias("have"))
    made = tables.backfill(have, s.select("s_suppkey", "s_nationkey"), ["s_suppkey"], lambda m: m.select("s_suppkey", (F.col("s_nationkey") * 2).alias("computed")))
    return made.select("s_suppkey", "have", F.coalesce("computed", F.lit(-1)).alias("computed"))


@query("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def hourly_events(spark, d):
    """Tumbling hours; the streaming form is in tilewright.streaming."""
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), R(F.sum("value"), "total", 4))


@query("select (json_extract_string(props, '$.k')::int) % 10 as k, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def json_properties(spark, d):
    return table(spark, d, "events").groupBy((F.get_json_object("props", "$.k").cast("int") % 10).alias("k")).agg(F.count("*").alias("n"), R(F.avg("value"), "mean"))


@query(f"with {MANIFEST} select sample, n, case when n < 10 then 'move' when stage = 'LOW' then 'move' else 'stay' end as action, count(*) as files from manifest group by 1, 2, 3")
def relocation_plan(spark, d):
    """Which files a rule would move; nothing is moved."""
    action = F.when((F.col("n") < 10) | (F.col("stage") == "LOW"), "move").otherwise("stay")
    return manifest(spark, d).groupBy("sample", "n", action.alias("action")).agg(F.count("*").alias("files"))


@query("with s as (select (select count(*) from customer) as a, (select count(*) from supplier) as b) select i, i % a as a, (i*7 + 3) % b as b from (select unnest(range(0, greatest(a, b))) as i, a, b from s)")
def unpaired_samples(spark, d):
    """As many pairs as the longer listing has; the shorter one starts over."""
    a, b = table(spark, d, "customer").agg(F.count("*").alias("na")), table(spark, d, "supplier").agg(F.count("*").alias("nb"))
    n = a.join(F.broadcast(b))  # one row each
    return n.select("na", "nb", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("na", "nb") - 1)).alias("i")).select("i", (F.col("i") % F.col("na")).alias("a"), ((F.col("i") * 7 + 3) % F.col("nb")).alias("b"))
