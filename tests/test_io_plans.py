"""Readers, writers, pipelines, plans and the stream."""

import json
import math
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from furrow import queries
from furrow.functions import geo
from furrow.plans import cleaning
from furrow.sinks import files, raster
from furrow.sources import shapefile, text
from furrow.streaming import fields

LINE = "-69.856661,47.506122,{flow},1762958157,2,77,240,30.8,33,1,2410019049,F0:1,L0:<1>,Maïs"


def sample(spark, n=400):
    rows = [(i, i // 100 + 1, 1_704_067_200 + 2 * i, 435000.0 + 6 * (i // 100), 5262000.0 + 2.5 * (i % 100 if i // 100 % 2 == 0 else 99 - i % 100), -69.85, 47.5, 10.0 + i % 7, 2, 2.5, 6.0, 15.0 + i % 5, 33 if i % 50 else 99, 7 if i % 40 else 1, "Maïs") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "row_id long, Pass long, GPS_Time long, X double, Y double, Longitude double, Latitude double, Flow double, Interval int, Distance double, Swath double, Moisture double, HeaderStatus int, GPSStatus int, GrainType string")


@pytest.mark.parametrize(("tail", "names"), [(",7,0,61.3", ["GPSStatus", "DOP", "Altitude"]), (",61.3", ["Altitude"]), (",V1,61.3", ["Variety", "Altitude"]), (",61.3,x", ["Extra"])])
def test_text_layouts(spark, tmp_path, tail, names):
    file = tmp_path / "log.txt"
    file.write_text("\n".join(LINE.format(flow=f) + tail for f in (1.53, -1, 4.5, "oops")) + "\n")
    d = text.read_yield_text(spark, str(file))
    assert set(names) <= set(d.columns)
    rows = d.orderBy("row_id").collect()
    assert [r["Flow"] for r in rows] == [1.53, 4.5] and [r["row_id"] for r in rows] == [1, 2]
    assert rows[0]["Swath"] == pytest.approx(240 * 0.0254) and rows[0]["Serial"] == "2410019049"


def test_piped_layout_and_empty_file(spark, tmp_path):
    file = tmp_path / "piped.txt"
    file.write_text("1|" + LINE.format(flow=2) + ",more\n")
    assert text.read_yield_text(spark, str(file)).first()["GrainType"] == "Maïs,more"
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    with pytest.raises(ValueError):
        text.read_yield_text(spark, str(empty))
    with pytest.raises(ValueError):
        text.read_yield_data(spark)


def test_shapefile_round_trip(spark, tmp_path):
    d = geo.points(sample(spark, 20)).select("geometry", F.col("Flow").alias("VRYIELDMAS"), F.col("Moisture"), F.col("Swath").alias("SWATHWIDTH"), F.col("Distance").alias("DISTANCE"), F.col("GrainType").alias("Crop"))
    files.export(d, str(tmp_path / "field.shp"))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for end in ("shp", "shx", "dbf"):
            z.write(tmp_path / f"field.{end}", f"doc/field.{end}")
    listed = shapefile.list_fields(spark, str(tmp_path / "a.zip")).collect()
    assert [r["field_name"] for r in listed] == ["field"]
    back = shapefile.read_field(spark, str(tmp_path / "a.zip"), "field")
    assert back.count() == 20
    row = back.orderBy("row_id").first()
    assert row["Flow"] == pytest.approx(11_000) and row["Longitude"] == pytest.approx(-69.85) and row["Interval"] == 1
    with pytest.raises(ValueError):
        shapefile.read_field(spark, str(tmp_path / "a.zip"), "other")


def test_exports(spark, tmp_path):
    d = sample(spark, 5)
    file = files.export(d, str(tmp_path / "sub" / "a.csv"))
    assert len(open(file).read().splitlines()) == 6
    with pytest.raises(FileExistsError):
        files.export(d, file)
    with pytest.raises(ValueError):
        files.export(d, str(tmp_path / "a.xyz"))
    with pytest.raises(ValueError):
        files.export(d, str(tmp_path / "a.shp"))
    features = json.load(open(files.export(d, str(tmp_path / "a.geojson"))))["features"]
    assert len(features) == 5 and features[0]["geometry"]["type"] == "Point"
    shapes = geo.polygons(d)
    with sqlite3.connect(files.export(shapes, str(tmp_path / "a.gpkg"))) as db:
        assert db.execute("SELECT count(*) FROM yield_data").fetchone()[0] == shapes.count()
    grid = open(files.export(d, str(tmp_path / "a.asc"))).read().split()
    assert grid[0] == "ncols"


def test_interpolation_methods(spark):
    d = sample(spark, 60)
    for method in ("idw", "nearest", "tps"):
        found = raster.interpolate(d, 5, "Flow", method).toPandas()["value"]
        assert len(found) and found.between(0, 30).all()
    with pytest.raises(ValueError):
        raster.interpolate(d, 5, "Flow", "kriging")


def test_pipeline_keeps_or_logs_every_point(spark):
    result = cleaning.clean_yield(sample(spark), delay_range=(-1, 0, 1), n_iterations=2)
    kept, gone = {r["orig_row_id"] for r in result.clean.collect()}, {r["orig_row_id"] for r in result.deletions.collect()}
    assert kept | gone == set(range(1, 401)) and not kept & gone
    assert result.by_step().count() >= 2
    assert 0 < result.validation().first()["retention"] < 1


def test_tracking_tells_what_each_step_removed(spark):
    heard = []
    result = cleaning.clean_yield_with_tracking(sample(spark), lambda step, n: heard.append((step, n)), delays=False)
    assert [s for s, _ in heard if s in cleaning.REASONS] == [s for s, _ in heard] and ("gps", 10) in heard and ("velocity_jump", 0) in heard
    assert sum(n for _, n in heard) + result.clean.count() == 400


def test_cleaning_plans_stay_small(spark):
    plan = queries.QUERIES["pl1_clean_yield"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 4 and plan.count("InPandas") <= 2 and plan.count("Exchange") <= 16


def test_fast_pipeline_filters_only_when_asked(spark):
    prepared, _ = cleaning.prepare(sample(spark), cleaning.CleaningParams(delays=False))
    assert cleaning.clean_yield_fast(prepared).clean.count() == 400
    assert cleaning.clean_yield_fast(prepared, gps=True).clean.count() == 390


def test_file_pipeline_and_report(spark, tmp_path):
    file = tmp_path / "log.txt"
    file.write_text("\n".join(f"{-69.8566 + i * 2e-5},{47.5061 + i * 1e-5},{5 + i % 3},{1762958157 + 2 * i},2,77,240,{14 + i % 3},33,1,1,F,L,Maïs,7,1,60" for i in range(80)))
    result = cleaning.clean_file(spark, str(file), str(tmp_path / "out.csv"), str(tmp_path / "log" / "report.txt"), delays=False, overlap=False)
    assert (tmp_path / "out.csv").exists() and "Deleted by step" in (tmp_path / "log" / "report.txt").read_text()
    assert result.polygons().count() == result.clean.count()


def test_stream_cleans_arriving_fields(spark, tmp_path):
    sample(spark, 200).withColumn("field_id", F.lit("a")).write.parquet(str(tmp_path / "in" / "1"))
    got = []
    stream = fields.read_stream(spark, str(tmp_path / "in" / "*"), spark.read.parquet(str(tmp_path / "in" / "1")).schema)
    query = fields.clean_stream(stream, lambda r, n: got.append((n, r.clean.count())), str(tmp_path / "check"), delays=False)
    query.awaitTermination(120)
    assert len(got) == 1 and 0 < got[0][1] < 200


def test_no_python_and_no_single_partition_in_core_plans(spark):
    for name in ("f0_filter_data", "win8_smooth_heading", "x2_overlap_ratio", "x5_stray_positions", "a4_filter_counts"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "SinglePartition" not in plan, name


def test_nulls_and_empty_tables(spark):
    empty = sample(spark, 5).limit(0)
    assert cleaning.clean_yield(empty, delays=False).clean.count() == 0
    holes = sample(spark, 50).withColumns({c: F.when(F.col("row_id") % 7 != 0, F.col(c)) for c in ("Flow", "Moisture", "Interval", "GPSStatus", "HeaderStatus")})
    result = cleaning.clean_yield(holes, delays=False)
    assert result.clean.count() + result.deletions.count() == 50


def scattered(spark):
    """Two fields with equal distances, points at a cell's centre, a null value and a null place."""
    rng = random.Random(3)
    at = [(rng.randrange(-40, 160) / 2, rng.randrange(0, 90) / 2, rng.randrange(40) / 4) for _ in range(400)] + [(2.0, 2.0, 9.0), (2.0, 2.0, 4.0), (400.0, 30.0, 1.0), (5.0, 5.0, None), (None, 3.0, 2.0)]
    return [(k % 2, k, *p) for k, p in enumerate(at)]


def by_hand(rows, method, cell=4, margin=5):
    radius, out = (20 if method == "nearest" else 15) * cell, {}
    for field in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == field]
        (x0, x1), (y0, y1) = ((math.floor(min(c) / cell) - margin, math.floor(max(c) / cell) + margin) for c in ([r[i] for r in mine if r[i] is not None] for i in (2, 3)))
        for cx in range(x0, x1 + 1):
            for cy in range(y0, y1 + 1):
                near = sorted((math.sqrt(((cx + 0.5) * cell - x) ** 2 + ((cy + 0.5) * cell - y) ** 2), v) for _, _, x, y, v in mine if None not in (x, y, v))
                near = [(d, v) for d, v in near if d <= radius]
                centre = [v for d, v in near if d < 1e-12]
                if near:
                    weights = [1 / d**2 for d, _ in near if d >= 1e-12]
                    out[field, cx, cy] = near[0][1] if method == "nearest" else sum(centre) / len(centre) if centre else sum(w * v for w, (_, v) in zip(weights, near)) / sum(weights)
    return out


def gridded(spark, method, monkeypatch):
    rows = scattered(spark)
    d = spark.createDataFrame(rows, "field_id long, row_id long, X double, Y double, Flow double").repartition(3)
    want = by_hand(rows, method)
    monkeypatch.setattr(raster, "BLOCK", 1000)
    got = {(r["field_id"], r["cell_x"], r["cell_y"]): r["value"] for r in raster.interpolate(d, 4, "Flow", method).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    # A cell has a row for each batch of its tile, not one for each of its points.
    assert raster._near(d, "Flow", 4, 60, 5, method).count() <= 2 * len(want)


def test_nearest_map_makes_no_pairs(spark, monkeypatch):
    gridded(spark, "nearest", monkeypatch)


def test_distance_map_makes_no_pairs(spark, monkeypatch):
    gridded(spark, "idw", monkeypatch)
