"""Exact expectations on small fixtures, and properties of filters and detectors."""

import math
import warnings

import pytest
from pyspark.sql import functions as F

from furrow import queries
from furrow.adapter import yield_points
from furrow.functions import geo, units
from furrow.functions.rcompat import no_nan, r_div
from furrow.operators import anonymize, audit, delay, filters, motion, spatial, thresholds
from furrow.sinks import raster


def points(spark, **columns):
    n = len(next(iter(columns.values())))
    base = {"row_id": list(range(1, n + 1)), "GPS_Time": [1762958157 + 2 * i for i in range(n)], "Interval": [2] * n} | columns
    rows = [tuple(float(v) if k not in ("row_id", "GPS_Time", "Interval", "HeaderStatus", "GPSStatus", "Pass") and isinstance(v, int) else v for k, v in zip(base, r)) for r in zip(*base.values())]
    kinds = {"row_id": "long", "GPS_Time": "long", "Interval": "int", "HeaderStatus": "int", "GPSStatus": "int", "Pass": "long"}
    return spark.createDataFrame(rows, ", ".join(f"{k} {kinds.get(k, 'double') if not any(isinstance(v, str) for v in base[k]) else 'string'}" for k in base))


def ids(df):
    return sorted(r["row_id"] for r in df.select("row_id").collect())


def test_header_values_and_nulls(spark):
    d = points(spark, HeaderStatus=[1, 33, 33, 0, None])
    assert ids(filters.header(d)) == [1, 2, 3, 5]
    assert ids(filters.header(d, keep_null=False)) == [1, 2, 3]
    assert ids(filters.header(d, (0, 1, 33))) == [1, 2, 3, 4, 5]


def test_gps_dop_moisture_and_yield(spark):
    assert ids(filters.gps(points(spark, GPSStatus=[2, 4, 4, 7, None]))) == [2, 3, 4, 5]
    assert ids(filters.dop(points(spark, DOP=[5, 15, 8, 5, None]))) == [1, 3, 4, 5]
    assert ids(filters.moisture_range(points(spark, Moisture=[5, 15, 35, 45, 25]), 10, 40)) == [2, 3, 5]
    assert ids(filters.moisture_range(points(spark, Moisture=[5.0, None, 20.0]), 10, 40, keep_null=True)) == [2, 3]
    assert ids(filters.yield_range(points(spark, Yield_kg_ha=[6270, 9405, 3135, 18810, 11286]), 3135, 11286)) == [1, 2, 3, 5]


def test_missing_columns_warn_or_stay_silent(spark):
    d = points(spark, Flow=[1, 2])
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert ids(filters.velocity_range(d)) == [1, 2]
        assert ids(filters.gps(d, missing="warn")) == [1, 2]
        assert ids(filters.header(d)) == [1, 2]
    assert sum("missing" in str(w.message) for w in seen) == 2
    with pytest.raises(ValueError):
        motion.distances(d)


def test_velocity_bounds_and_first_row(spark):
    d = points(spark, X=[0, 4, 8, 12, 100], Y=[0, 0, 0, 0, 0])
    assert ids(filters.velocity_fixed(d, 0.5, 10)) == [2, 3, 4]
    assert ids(filters.velocity_range(d, 0, 10)) == [1, 2, 3, 4]


def test_filter_data_order_and_unknown_names(spark):
    d = points(spark, HeaderStatus=[1, 99, 33], GPSStatus=[7, 7, 1], X=[1, 2, 3], Y=[1, 2, 3])
    assert ids(filters.filter_data(d, ["gps", "header", "nonsense"])) == [1]
    with pytest.raises(TypeError):
        filters.filter_data(d, [1])


def test_division_keeps_nulls_and_signs(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in d.select(r_div(F.col("a"), F.col("b"))).collect()] == [0.5, math.inf, -math.inf, None, None]
    assert no_nan(spark.createDataFrame([(float("nan"),)], "a double")).first()[0] is None


def test_distances_and_jumps(spark):
    d = motion.distances(points(spark, X=[0, 10, 25], Y=[0, 0, 15]))
    assert [r["distance"] for r in d.orderBy("row_id").collect()] == [0, 10, math.hypot(15, 15)]
    assert not any(r["velocity_jump"] for r in motion.velocity_jump(points(spark, X=[0, 4, 8], Y=[0, 0, 0])).collect())


def test_heading_turns_back(spark):
    d = motion.heading_anomaly(points(spark, X=[0, 0, 0, 0], Y=[0, 5, 10, 5]))
    assert [r["row_id"] for r in d.filter("heading_anomaly").collect()] == [4]


def test_interpolation_and_delays(spark):
    d = points(spark, Flow=[None, 1.0, None, 3.0, None])
    assert [r["Flow"] for r in delay.interpolate(d).orderBy("row_id").collect()] == [None, 1, 2, 3, None]
    assert [r["Flow"] for r in delay.interpolate(d, edges=True).orderBy("row_id").collect()] == [2, 1, 2, 3, 2]
    m = points(spark, Moisture=[1, 2, 3])
    assert [r["Moisture"] for r in delay.moisture_delay(m, 1).orderBy("row_id").collect()] == [1, 2]
    assert [r["Moisture"] for r in delay.moisture_delay(m, 1, "backward").orderBy("row_id").collect()] == [2, 3]
    assert delay.flow_delay(d, 0).columns == d.columns


def test_trim_both_ends(spark):
    d = points(spark, Pass=[1, 1, 1, 1], Flow=[1, 1, 1, 1])
    assert ids(delay.trim_passes(d, 3)) == [2, 3, 4]
    assert ids(delay.trim_passes(d, -3)) == [1, 2]


def test_delay_search_finds_a_planted_shift(spark):
    xs = [(i % 20 if i // 20 % 2 == 0 else 19 - i % 20) * 2.0 for i in range(400)]  # back and forth
    ys = [(i // 20) * 2.0 for i in range(400)]
    true = [math.sin(x / 6) * math.cos(y / 5) * 10 for x, y in zip(xs, ys)]
    flow = [true[i - 3] if i >= 3 else true[0] for i in range(400)]
    d = points(spark, X=xs, Y=ys, Flow=flow)
    found = delay.delay_adjustment(d, list(range(-5, 6)), 2)
    assert found.best.first()["delay"] == 3
    assert found.best.first()["stability"] == 0


def test_delay_search_without_columns(spark):
    with pytest.warns(UserWarning):
        assert delay.delay_adjustment(points(spark, Flow=[1, 2])).best.count() == 0


def test_overlap_ratio_equals_marking_row_by_row(spark):
    import random

    rng = random.Random(3)
    xs, ys = [rng.uniform(0, 12) for _ in range(150)], [rng.uniform(0, 12) for _ in range(150)]
    d = points(spark, X=xs, Y=ys, Swath=[120] * 150)
    got = {r["row_id"]: r["overlap_ratio"] for r in spatial.overlap_ratio(d).collect()}
    cs, half = 0.3, 120 * 0.0254 / 2
    x0, y0 = math.floor(min(xs) / cs) * cs, math.floor(min(ys) / cs) * cs
    nx, ny = math.ceil((math.ceil(max(xs) / cs) * cs - x0) / cs), math.ceil((math.ceil(max(ys) / cs) * cs - y0) / cs)
    marked, k = set(), math.ceil(half / cs)
    for i, (x, y) in enumerate(zip(xs, ys), 1):
        cx, cy = math.floor((x - x0) / cs) + 1, math.floor((y - y0) / cs) + 1
        cells = [(a, b) for a in range(max(1, cx - k), min(nx, cx + k) + 1) for b in range(max(1, cy - 1), min(ny, cy + 1) + 1) if math.hypot(x0 + (a - 0.5) * cs - x, y0 + (b - 0.5) * cs - y) <= half]
        assert got[i] == pytest.approx(sum(c in marked for c in cells) / len(cells) if cells else 0)
        marked |= set(cells)


def test_local_outlier_goes(spark):
    d = points(spark, X=[1.0 + i / 10 for i in range(12)], Y=[1.0] * 12, Flow=[100.0] * 5 + [101.0] * 6 + [300.0], Swath=[240] * 12)
    assert 12 not in ids(spatial.local_sd_filter(d, limit=2.4))
    assert ids(spatial.detect_anomalies(d, "local_sd")) == list(range(1, 12))
    flagged = spatial.detect_anomalies(d, "local_sd", "detect")
    assert ids(flagged.filter(~F.col("local_sd_outlier"))) == list(range(1, 12))
    assert spatial.detect_anomalies(d, "all", "report").columns == d.columns


def test_stray_points_and_rescue(spark):
    xs = [0.0, 1, 2, 3, 4, 40, 500]
    d = points(spark, X=xs, Y=[0.0, 1, 2, 3, 30, 5, 500])
    assert ids(spatial.stray_positions(d, 50, 4, 20).filter("position_stray")) == [7]


def test_units(spark):
    assert units.flow_units(points(spark, Flow=[56, 112, 168])).select("Flow").rdd.flatMap(list).collect() == [1, 2, 3]
    d = units.imperial_to_metric(points(spark, Distance=[80, 85, 90], Swath=[300, 310, 320]))
    assert d.first()["Swath"] == pytest.approx(7.62) and d.first()["Distance"] == pytest.approx(2.032)
    same = units.imperial_to_metric(points(spark, Distance=[1.5, 2, 2.5], Swath=[8, 9, 10]))
    assert same.first()["Swath"] == 8
    y = units.flow_to_yield(points(spark, Flow=[5.0], Distance=[2.0], Swath=[7.5]))
    assert y.first()["Yield_kg_ha"] == pytest.approx(5 * 0.453592 * 2 / 15 * 10000)
    assert units.flow_to_yield(points(spark, Flow=[5000.0], Distance=[2.0], Swath=[7.5])).first()["Yield_kg_ha"] == 5000
    back = units.yield_to_flow(y)
    assert back.first()["Flow"] == pytest.approx(5 * 0.453592)


def test_utm_golden_points_and_round_trip(spark):
    golden = [(47.506122, -69.856661, 435489.6290, 5261765.7195), (47.506185, -69.856749, 435483.0794, 5261772.7941)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(golden)], "row_id long, Latitude double, Longitude double")
    moved = geo.latlon_to_utm(d)
    for r, (_, _, x, y) in zip(moved.orderBy("row_id").collect(), golden):
        assert r["X"] == pytest.approx(x, abs=1e-3) and r["Y"] == pytest.approx(y, abs=1e-3)
    back = geo.utm_to_latlon(moved.drop("Longitude", "Latitude"), 19)
    for r, (a, b, _, _) in zip(back.orderBy("row_id").collect(), golden):
        assert r["Latitude"] == pytest.approx(a, abs=1e-9) and r["Longitude"] == pytest.approx(b, abs=1e-9)
    south = geo.utm_to_latlon(spark.createDataFrame([(1, 500000.0, 6000000.0)], "row_id long, X double, Y double"), 19, "S")
    assert south.first()["Latitude"] < 0
    with pytest.raises(ValueError):
        geo.convert_coordinates(d, "latlon", "mars")


def test_polygon_area(spark):
    d = points(spark, Longitude=[-69.85, -69.85], Latitude=[47.5, 47.5001], Distance=[2.0, 2.0], Swath=[8.0, 8.0], Flow=[200, 300])
    s = geo.yield_summary(geo.polygons(d)).first()
    assert s["n"] == 2 and s["Area_ha"] == pytest.approx(2 * 16 / 10000, rel=1e-3)


def test_thresholds_defaults_and_join(spark):
    few = thresholds.auto_thresholds(points(spark, Yield_kg_ha=[1, 2, 3], X=[1, 2, 3], Y=[1, 2, 3])).first()
    assert (few["min_yield"], few["max_yield"], few["max_velocity"]) == (0, 300, 15)
    d = points(spark, Flow=[float(i) for i in range(20)], X=[float(i) for i in range(20)], Y=[0.0] * 20)
    assert thresholds.typed_thresholds(d, ("moisture", "yield")).first()["mean_yield"] == pytest.approx(10)


def test_audit_splits_and_counts(spark):
    d = points(spark, GPSStatus=[1, 5, None, 7], Flow=[1, 2, 3, 4]).withColumn("orig_row_id", F.col("row_id"))
    kept, log = audit.split(d, F.col("GPSStatus") >= 4, "gps", "low")
    assert kept.count() + log.count() == 4
    seen = audit.diagnostics(d, log)
    assert seen.filter("status = 'removed'").count() == log.count() and seen.count() == 4
    assert audit.deletions_by_step(log).first()["n"] == 2


def test_flags(spark):
    d = filters.add_flags(points(spark, HeaderStatus=[33, 99, None]))
    assert [r["flag_header"] for r in d.orderBy("row_id").collect()] == [0, 1, 1]


def test_anonymise_and_restore(spark, tmp_path):
    d = points(spark, Longitude=[-69.85, -69.86], Latitude=[47.5, 47.51])
    key_file = str(tmp_path / "key.json")
    moved, key = anonymize.anonymize_coordinates(d, key_file=key_file, password="secret", seed=5)
    assert moved.first()["Longitude"] != -69.85
    back = anonymize.restore_coordinates(moved, key_file=key_file, password="secret")
    assert back.first()["Longitude"] == pytest.approx(-69.85, abs=1e-10)
    with pytest.raises(ValueError):
        anonymize.restore_coordinates(moved, key_file=key_file, password="wrong")
    assert anonymize.verify_key_file(spark, key_file, "secret") and not anonymize.verify_key_file(spark, key_file, "no")
    assert anonymize.security_report(key, True)["level"] == "high"


def test_anonymise_needs_a_password(spark, monkeypatch):
    monkeypatch.delenv(anonymize.ENV, raising=False)
    with pytest.raises(ValueError):
        anonymize.anonymize_yield_data(points(spark, Longitude=[1.0], Latitude=[1.0]))
    monkeypatch.setenv(anonymize.ENV, "p")
    moved, _, report = anonymize.anonymize_yield_data(points(spark, Longitude=[1.0], Latitude=[1.0], Serial=["s"]))
    assert "Serial" not in moved.columns and report["level"] == "high"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with a table of parts of two fields, the second with a stray point."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = [(i, (i * 17 % 101) + i / 50, "view") for i in (*range(40, 240), *range(2900, 3100))]
    spark.createDataFrame(rows, "event_id long, value double, event_type string").write.parquet(f"{folder}/events.parquet")
    return folder


def valued(spark, folder):
    fields = {}
    for r in yield_points(spark, folder).orderBy("row_id").collect():
        fields.setdefault(r["field_id"], []).append((r["X"], r["Y"], r["Flow"]))
    return fields


@pytest.mark.parametrize("name", ["snk7_idw", "snk7_nearest"])
def test_map_queries_cover_all_points_of_all_fields(spark, events, name):
    want = {}
    for f, pts in valued(spark, events).items():
        (x0, x1), (y0, y1) = ((math.floor(min(p[i] for p in pts) / 4), math.floor(max(p[i] for p in pts) / 4)) for i in (0, 1))
        for a in range(x0 - 5, x1 + 6):
            for b in range(y0 - 5, y1 + 6):
                near = [(math.hypot(a * 4 + 2 - x, b * 4 + 2 - y), v) for x, y, v in pts if v is not None]
                near = [(d, v) for d, v in near if d <= (60 if name == "snk7_idw" else 80)]
                if near:
                    want[f, a, b] = sum(v / (d * d) for d, v in near) / sum(1 / (d * d) for d, _ in near) if name == "snk7_idw" else min(near)[1]
    got = {(r["field_id"], r["cell_x"], r["cell_y"]): r["value"] for r in queries.QUERIES[name](spark, events).collect()}
    assert got.keys() == want.keys() and {f for f, *_ in got} == {0, 1}
    assert all(got[c] == pytest.approx(want[c], abs=1e-6) for c in want)


@pytest.mark.parametrize("method", ["idw", "nearest"])
def test_maps_take_tasks_by_points_and_add_a_tile_s_batches(spark, events, monkeypatch, method):
    points = yield_points(spark, events)
    result = lambda: {(r["field_id"], r["cell_x"], r["cell_y"]): r["value"] for r in raster.interpolate(points, 4, "Flow", method).collect()}
    want = result()
    monkeypatch.setattr(raster, "TASK_POINTS", 300)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        table = raster.interpolate(points, 4, "Flow", method)
        assert table.rdd.getNumPartitions() == 1 + 9 * points.filter("Flow IS NOT NULL").count() // 300
        assert table.groupBy("field_id", "cell_x", "cell_y").count().filter("count > 1").isEmpty()
        assert result() == {c: pytest.approx(v, rel=1e-12) for c, v in want.items()}
    finally:
        spark.conf.set(batch, before)


def moran_by_trying_all(points, delay):
    """Moran's I of the values ``delay`` rows on, from the sorted distances of every point."""
    value = [points[i + delay][2] if 0 <= i + delay < len(points) else None for i in range(len(points))]
    at = [(x, y, v) for (x, y, _), v in zip(points, value) if v is not None]
    mean = sum(v for *_, v in at) / len(at)
    k, total = min(10, len(at) // 10), 0
    for i, (x, y, v) in enumerate(at):
        near = sorted(((a - x) * (a - x) + (b - y) * (b - y), j) for j, (a, b, _) in enumerate(at) if j != i)[:k]
        total += (v - mean) * sum((at[j][2] - mean) / (d + 1e-10) for d, j in near) / sum(1 / (d + 1e-10) for d, _ in near)
    return total / sum((v - mean) ** 2 for *_, v in at)


def test_delay_score_queries_keep_stray_points(spark, events):
    fields = valued(spark, events)
    assert max(x for x, *_ in fields[1]) > min(x for x, *_ in fields[1]) + 400
    got = {r["field_id"]: r["moran"] for r in queries.QUERIES["x8_moran"](spark, events).collect()}
    assert got == {f: pytest.approx(moran_by_trying_all(p, 0), abs=1e-5) for f, p in fields.items()}
    got = {(r["field_id"], r["delay"]): r["mean_score"] for r in queries.QUERIES["x9_delay_scores"](spark, events).collect()}
    assert got.keys() == {(f, d) for f in fields for d in range(-25, 26)}
    for f, p in fields.items():
        for d in (-25, -1, 1, 24):
            assert got[f, d] == pytest.approx(moran_by_trying_all(p, d), abs=1e-5)


@pytest.mark.parametrize("name", ["x9_best_delay", "a12_top_delays", "x10_optimize_delays", "pl1_clean_yield", "pl3_deletions_by_step", "pl4_polygons", "pl5_older_variant"])
def test_delay_queries_search_the_whole_range(spark, events, monkeypatch, name):
    seen, search = [], delay.delay_scores
    monkeypatch.setattr(delay, "delay_scores", lambda df, delays, *more: seen.append(delays) or search(df, delays, *more))
    queries.QUERIES[name](spark, events)
    assert seen and all(d == list(range(-25, 26)) for d in seen)


def test_best_delay_query_finds_a_shift_of_thirteen_rows(spark, tmp_path):
    at = [(i // 100 * 6, (i % 100 if i // 100 % 2 == 0 else 99 - i % 100) * 2.5) for i in range(600)]
    true = [100 + 40 * math.sin(x / 9) * math.cos(y / 17) for x, y in at]
    rows = [(i, true[max(i - 13, 0)], "view") for i in range(600)]
    spark.createDataFrame(rows, "event_id long, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert queries.QUERIES["x9_best_delay"](spark, str(tmp_path)).first()["delay"] == 13


def test_clamped_histogram_of_equal_quantiles_and_repeated_values(spark):
    """A field of one point is in the last bin, as in the SQL; quantiles weigh two neighbours also if they are equal."""
    values = [2.2] * 20 + [v / 7 for v in range(20, 45)] + [11.1] * 20
    d = points(spark, field_id=[7] + [8] * len(values), Flow=[3.0, *values])
    got = {(r["field_id"], r["bin"]): r["n"] for r in audit.clamped_histogram(d, "Flow").collect()}
    v, want = sorted(values), {(7, 49): 1}

    def quantile(q):
        at = (len(v) - 1) * q
        d = at - int(at)
        return v[int(at)] * (1 - d) + v[int(at) + 1] * d

    a, b = quantile(0.02), quantile(0.98)
    for x in v:
        at = (8, min(int((min(max(x, a), b) - a) / (b - a) * 50), 49))
        want[at] = want.get(at, 0) + 1
    assert got == want


def test_utm_takes_one_zone_for_all_fields(spark):
    """The zone of the table's first row, also for fields east of its border."""
    d = points(spark, field_id=[2, 1], Longitude=[-65.9, -66.1], Latitude=[47.5, 47.5])
    at = {r["field_id"]: r["X"] for r in geo.latlon_to_utm(d).collect()}
    fixed = {r["field_id"]: r["X"] for r in geo.latlon_to_utm(d, 19).collect()}
    assert at == fixed and at[2] > at[1]


def test_anonymise_orders_no_rows(spark):
    """The reference row is drawn by an aggregate: no plan takes the rows up to it to the driver."""
    d = points(spark, Longitude=[float(i) for i in range(50)], Latitude=[0.0] * 50)
    calls = []
    kept = type(d).orderBy
    type(d).orderBy = lambda self, *a, **k: calls.append(a) or kept(self, *a, **k)
    try:
        keys = [anonymize.anonymize_coordinates(d.repartition(n), seed=s)[1] for s, n in ((1, 1), (1, 5), (2, 1), (3, 1))]
    finally:
        type(d).orderBy = kept
    assert not calls and keys[0] == keys[1] and keys[0]["n"] == 50
    # dx is a drawn row's value and an offset of at most a degree.
    assert len({round(k["dx"]) for k in keys}) > 1 and all(-1 <= k["dx"] <= 50 and -1 <= k["dy"] <= 1 for k in keys)
