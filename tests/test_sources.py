"""Files read and written as the evaluation's steps leave them."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.sources import files
from tilewright.streaming import append


def test_csv_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿tile_id,y,x,size,tissue\ny0_x0,0,0,256,0.5\ny0_x1,0,bad,,nan\n", encoding="utf-8")
    got = files.csv(spark, str(p), files.SCHEMAS["tile_index"]).orderBy("tile_id").collect()
    assert [tuple(r) for r in got] == [("y0_x0", 0, 0, 256, 0.5), ("y0_x1", 0, None, None, None)]
    wide = files.csv(spark, str(p), text_columns=("tile_id",))
    assert dict(wide.dtypes)["y"] == "double"
    empty = tmp_path / "b.csv"
    empty.write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        files.csv(spark, str(empty))


def test_csv_round_trip_keeps_order_and_digits(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456, "x")], "a int, b double, c string")
    files.write_csv(df, str(tmp_path / "o"), ["b", "a"], {"b": 3})
    got = spark.read.option("header", True).csv(str(tmp_path / "o"))
    assert got.columns == ["b", "a"] and tuple(got.first()) == ("0.123", "1")


def test_samples(spark, tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "sel.csv").write_text(f"n,v\n1,{s}\n")
    (tmp_path / "s3").mkdir()
    assert {(r["sample"], r.v) for r in files.samples(spark, str(tmp_path), "sel.csv").collect()} == {("s1", "s1"), ("s2", "s2")}


def test_sidecar_and_layout(spark, tmp_path):
    (tmp_path / "kv").write_text("﻿a=1\nb = x=y\n\n=z\nnone\n", encoding="utf-8")
    assert {(r.key, r.value) for r in files.sidecar(spark, str(tmp_path / "kv")).collect()} == {("a", "1"), ("b", "x=y")}
    (tmp_path / "lay").write_text("# made by hand\n\nt 1.tif\ty=10\tx=-2.5\nt2.tif  y=3 x=4\n")
    assert {tuple(r) for r in files.layout(spark, str(tmp_path / "lay")).collect()} == {("t 1.tif", 10.0, -2.5), ("t2.tif", 3.0, 4.0)}


def test_key_upsert(spark):
    lines = spark.createDataFrame([("a=1",), ("cover_x=2",)], "value string")
    got = files.upsert_keys(lines, "cover_", spark.createDataFrame([("cover_y=3",)], "value string"))
    assert {r.value for r in got.collect()} == {"a=1", "cover_y=3"}


def test_listing_and_content(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    for p, c in (("x/a.bin", b"11"), ("x/y/a.bin", b"22"), ("x/y/c.bin", b"11")):
        (tmp_path / p).write_bytes(c)
    f = files.listing(spark, str(tmp_path), "*.bin")
    assert {r.name: r.path.rsplit("/", 2)[1] for r in files.first_paths(f).collect()} == {"a.bin": "x", "c.bin": "y"}
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    same = files.same_content(raw, raw).where("a_path < b_path").collect()
    assert len(same) == 1 and same[0].b_path.endswith("c.bin")


def test_deck(spark, tmp_path):
    a, p, r = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    slide = f'<p:sld xmlns:p="{p}" xmlns:a="{a}" xmlns:r="{r}"><p:pic><p:blipFill><a:blip r:embed="rId2"/></p:blipFill><p:spPr><a:xfrm><a:off x="9525" y="19050"/><a:ext cx="100" cy="200"/></a:xfrm></p:spPr></p:pic></p:sld>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId2" Target="../media/image7.png"/></Relationships>'
    with zipfile.ZipFile(tmp_path / "d.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide)
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rels)
    got = files.deck_pictures(spark, str(tmp_path / "d.pptx")).first()
    assert (got.slide, got.picture, got.x, got.y, got.cx, got.cy) == ("slide1.xml", "image7.png", 9525, 19050, 100, 200)


def test_raster_rows(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 255, (37, 12)).astype("uint8")
    (tmp_path / "r.raw").write_bytes(a.tobytes())
    spark.dataSource.register(files.RasterSource)
    df = spark.read.format("raster_rows").option("path", str(tmp_path / "r.raw")).option("height", 37).option("width", 12).option("band", 10).load()
    got = df.orderBy("y").collect()
    assert df.rdd.getNumPartitions() == 4
    assert [r.top for r in got] == a.max(1).tolist() and np.frombuffer(got[5]["values"], "<f4").tolist() == a[5].tolist()


def test_turned_windows():
    a = np.arange(5 * 7).reshape(5, 7)
    for turn in (0, 90, 180, 270):
        shown = np.rot90(a, -turn // 90)
        t, l, h, w = files.windows(5, 7, 1, 2, 3, 2, turn)
        assert (np.rot90(a[t : t + h, l : l + w], -turn // 90) == shown[1:4, 2:4]).all()
    with pytest.raises(ValueError, match="leaves"):
        files.windows(5, 7, 3, 0, 3, 2)


def test_append_new_twice(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert append.append_new(spark, df, out, ["k"]) == 2
    assert append.append_new(spark, df.union(spark.createDataFrame([(3, "c")], "k int, v string")), out, ["k"]) == 1
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_overwrite_one_source(spark, tmp_path):
    out = str(tmp_path / "o")
    append.overwrite_sources(spark.createDataFrame([("a", 1), ("b", 2)], "source string, v int"), out)
    append.overwrite_sources(spark.createDataFrame([("b", 3)], "source string, v int"), out)
    assert {(r.source, r.v) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 3)}


def test_resumed_stream_equals_one_batch(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for part in range(3):
        e.where(F.col("event_id") % 3 == part).union(e.where(F.col("event_id") % 7 == part)).write.mode("append").parquet(src)
        append.resume(spark, src, "event_id long, user_id long, value double", out, ck, ["event_id"]).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == got.select("event_id").distinct().count() == e.count()


def test_streaming_windows_equal_the_batch(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    want = {tuple(r) for r in append.windowed(e, "ts", ["event_type"], "value").select("begin", "event_type", "n").collect()}
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "src"))
    s = append.windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "src")), "ts", ["event_type"], "value")
    q = s.writeStream.outputMode("complete").format("memory").queryName("w_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("w_out").select("begin", "event_type", "n").collect()} == want


def test_replay_gives_known_items(spark, tmp_path):
    spark.range(200).select((F.col("id") % 2).alias("k"), F.col("id").alias("item")).coalesce(1).write.parquet(str(tmp_path / "s"))
    q = append.replay(spark.readStream.schema("k long, item long").parquet(str(tmp_path / "s")), "k", "item", 10).writeStream.outputMode("append").format("memory").queryName("replayed").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("replayed").collect()
    assert len(rows) == 200 and all(r.given % 2 == r.k and r.given <= 199 for r in rows) and any(r.given != r.item for r in rows)
