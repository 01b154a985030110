"""One query for each operator over the yield points, with the DuckDB SQL that must give the same rows, save where the README says that it covers less."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.adapter import POINTS_DUCKDB, yield_points
from furrow.functions import geo, units
from furrow.operators import anonymize, audit, delay, filters, motion, order, spatial, thresholds
from furrow.plans import cleaning
from furrow.sinks import raster

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


def scaled(column: str, digits: int) -> Column:
    """Rounded as DuckDB does it, by a power of ten; ``round`` goes by the shortest decimals, which part from that near a half."""
    c = F.col(column)
    return (F.signum(c) * F.floor(F.abs(c) * 10.0**digits + 0.5) / 10.0**digits).alias(column)


def add(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Registers a query over the points; ``sql`` starts after a CTE ``pts`` of them."""
    QUERIES[name] = lambda spark, sf_dir: run(yield_points(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH pts AS ({POINTS_DUCKDB}), {sql}"


IDS = ("field_id", "row_id")
W = 'WINDOW w AS (PARTITION BY field_id ORDER BY row_id), f AS (PARTITION BY field_id)'
#: Velocity of a point, null in a field's first row, infinite for no time.
V = 'CASE WHEN "Interval" <> 0 THEN sqrt(power(X - (lag(X) OVER w), 2) + power(Y - (lag(Y) OVER w), 2)) / "Interval" END'


def keep(name: str, run: Callable[[DataFrame], DataFrame], condition: str, inner: str = "*") -> None:
    """A filter: the ids and values that stay, against ``condition`` over the points with the ``inner`` columns."""
    columns = ("field_id", "row_id", "Flow", "Moisture", "HeaderStatus", "DOP")
    add(name, lambda d: run(d).select(*columns, F.col("GPSStatus").cast("double").alias("GPSStatus")), f"t AS (SELECT {inner} FROM pts {W}) SELECT {', '.join(columns)}, GPSStatus::DOUBLE AS GPSStatus FROM t WHERE {condition}")


# Row filters and predicates.
keep("f1_header", lambda d: filters.header(d), "HeaderStatus IN (1, 33) OR HeaderStatus IS NULL")
keep("f1b_header_status", lambda d: filters.header(d, keep_null=False), "HeaderStatus IN (1, 33)")
keep("f1c_header_pipeline", lambda d: filters.header(d, (0, 1, 33)), "HeaderStatus IN (0, 1, 33) OR HeaderStatus IS NULL")
keep("f2_gps", lambda d: filters.gps(d), "GPSStatus IS NULL OR GPSStatus >= 4")
keep("f3_dop", lambda d: filters.dop(d), "DOP IS NULL OR DOP <= 10")
_AUTO_V = f"*, coalesce({V}, 0) AS v"
_LIMITS_V = "q AS (SELECT field_id, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM t GROUP BY 1)"
add("f4_velocity_auto", lambda d: filters.velocity_range(d).select(*IDS), f"t AS (SELECT {_AUTO_V} FROM pts {W}), {_LIMITS_V} SELECT field_id, row_id FROM t JOIN q USING (field_id) WHERE v BETWEEN greatest(0.5, a - 1.5 * (b - a)) AND b + 1.5 * (b - a)")
keep("f4b_velocity_fixed", lambda d: filters.velocity_fixed(d), "v BETWEEN 0.5 AND 10", f"*, {V} AS v")
keep("f4c_velocity_pipeline", lambda d: d.withColumn("v", motion.clean_velocity(d)).filter(F.col("v").between(0.5, 1.5)), "v BETWEEN 0.5 AND 1.5", _AUTO_V)
_SPREAD = "*, avg({c}) OVER f AS m, stddev_samp({c}) OVER f AS s"
keep("f5_yield_range", lambda d: filters.yield_range(d), "Flow BETWEEN greatest(0, m - 3 * s) AND m + 3 * s", _SPREAD.format(c="Flow"))
keep("f5b_yield_column_range", lambda d: filters.yield_column_range(d, "Flow", n_std=1), "Flow BETWEEN m - s AND m + s", _SPREAD.format(c="Flow"))
keep("f5c_positive_yield", lambda d: filters.positive_yield(d.withColumn("Yield_kg_ha", F.col("Flow") - 5)), "Flow - 5 > 0")
keep("f6_moisture_range", lambda d: filters.moisture_range(d), "Moisture BETWEEN m - 3 * s AND m + 3 * s", _SPREAD.format(c="Moisture"))
keep("f6b_moisture_keep_null", lambda d: filters.moisture_range(d, keep_null=True), "Moisture IS NULL OR Moisture BETWEEN m - 3 * s AND m + 3 * s", _SPREAD.format(c="Moisture"))
keep("f7_bounds_utm", lambda d: filters.bounds(d, {"min_x": 435100, "max_x": 435900, "min_y": 5262050, "max_y": 5262200}), "X BETWEEN 435100 AND 435900 AND Y BETWEEN 5262050 AND 5262200")
keep("f7_bounds_latlon", lambda d: filters.bounds(d, {"min_x": -69.849, "max_x": -69.845, "min_y": 47.5005, "max_y": 47.502}, "latlon"), "Longitude BETWEEN -69.849e0 AND -69.845e0 AND Latitude BETWEEN 47.5005e0 AND 47.502e0")
add("f8_position_filter", lambda d: thresholds.position_filter(d, thresholds.auto_thresholds(d, gbuffer=5)).select(*IDS), "q AS (SELECT field_id, quantile_cont(X, 0.02) - 5 AS x0, quantile_cont(X, 0.98) + 5 AS x1, quantile_cont(Y, 0.02) - 5 AS y0, quantile_cont(Y, 0.98) + 5 AS y1 FROM pts GROUP BY 1) SELECT field_id, row_id FROM pts JOIN q USING (field_id) WHERE X BETWEEN x0 AND x1 AND Y BETWEEN y0 AND y1")
add(
    "f0_filter_data",
    lambda d: filters.filter_data(d).select(*IDS),
    f"""a AS (SELECT * FROM pts WHERE (HeaderStatus IN (1, 33) OR HeaderStatus IS NULL) AND (GPSStatus IS NULL OR GPSStatus >= 4) AND (DOP IS NULL OR DOP <= 10)),
t AS (SELECT {_AUTO_V} FROM a {W}), {_LIMITS_V},
b AS (SELECT t.* FROM t JOIN q USING (field_id) WHERE v BETWEEN greatest(0.5, q.a - 1.5 * (q.b - q.a)) AND q.b + 1.5 * (q.b - q.a)),
c AS (SELECT * FROM b QUALIFY Flow BETWEEN greatest(0, avg(Flow) OVER f - 3 * stddev_samp(Flow) OVER f) AND avg(Flow) OVER f + 3 * stddev_samp(Flow) OVER f WINDOW_CLAUSE),
d AS (SELECT * FROM c QUALIFY Moisture BETWEEN avg(Moisture) OVER f - 3 * stddev_samp(Moisture) OVER f AND avg(Moisture) OVER f + 3 * stddev_samp(Moisture) OVER f WINDOW_CLAUSE)
SELECT field_id, row_id FROM d""".replace("QUALIFY", "WINDOW f AS (PARTITION BY field_id) QUALIFY").replace(" WINDOW_CLAUSE", ""),
)
add("p1_pick", lambda d: filters.pick(d, {"row_id": "id", "Flow": "flow", "absent": "x", "Pass": "pass_no"}), 't AS (SELECT 1) SELECT row_id AS id, Flow AS flow, Pass AS pass_no FROM pts')
add("p2_flags", lambda d: filters.add_flags(d).select(*IDS, *filters.FLAGS), "t AS (SELECT 1) SELECT field_id, row_id, CASE WHEN HeaderStatus IN (0, 1, 33) THEN 0 ELSE 1 END AS flag_header, " + ", ".join(f"0 AS {f}" for f in filters.FLAGS[1:]) + " FROM pts")

# Windows over the order of points.
add("win1_velocity", lambda d: d.select(*IDS, r6(motion.velocity(d)).alias("velocity")), f"t AS (SELECT field_id, row_id, round({V}, 6) AS velocity FROM pts {W}) SELECT * FROM t")
_STEP = 'sqrt(power(X - ({f}(X) OVER g), 2) + power(Y - ({f}(Y) OVER g), 2))'
_G = "WINDOW g AS (PARTITION BY field_id ORDER BY GPS_Time, row_id)"
add("win2_velocity_jump", lambda d: motion.velocity_jump(d).select(*IDS, "velocity_jump"), f"""t AS (SELECT field_id, row_id, ({_STEP.format(f="lead")} / coalesce(lead("Interval") OVER g, 1) - {_STEP.format(f="lag")} / coalesce(lag("Interval") OVER g, 1)) / coalesce("Interval", 1) AS a FROM pts {_G})
SELECT field_id, row_id, coalesce(a > 5 OR a < -8, false) AS velocity_jump FROM t""")
_BEAR = "CASE WHEN {d} < 0 THEN {d} + 360 ELSE {d} END"
add("win3_heading", lambda d: motion.heading_anomaly(d).select(*IDS, "heading_anomaly"), f"""s AS (SELECT field_id, row_id, GPS_Time, degrees(atan2(X - (lag(X) OVER g), Y - (lag(Y) OVER g))) AS d FROM pts {_G}),
h AS (SELECT *, {_BEAR.format(d="d")} AS h FROM s), t AS (SELECT field_id, row_id, abs(h - (lag(h) OVER g)) AS c FROM h {_G})
SELECT field_id, row_id, coalesce(least(c, 360 - c) > 60, false) AS heading_anomaly FROM t""")
add("win4_flow_delay", lambda d: delay.flow_delay(d, 3).select(*IDS, "Flow", "Flow_raw"), f"t AS (SELECT field_id, row_id, lead(Flow, 3) OVER w AS Flow, Flow AS Flow_raw FROM pts {W}) SELECT * FROM t")
add("win5_moisture_delay", lambda d: delay.moisture_delay(d).select(*IDS, "Moisture", "Moisture_raw"), f"t AS (SELECT field_id, row_id, lag(Moisture, 15) OVER w AS Moisture, Moisture AS Moisture_raw FROM pts {W}) SELECT * FROM t WHERE Moisture IS NOT NULL")
_LINE = """n AS (SELECT field_id, row_id, Flow, row_number() OVER w AS n FROM pts WINDOW w AS (PARTITION BY field_id ORDER BY row_id)),
i AS (SELECT *, CASE WHEN Flow IS NOT NULL THEN n END AS i FROM n),
p AS (SELECT *, last_value(Flow IGNORE NULLS) OVER b AS v0, last_value(i IGNORE NULLS) OVER b AS i0, first_value(Flow IGNORE NULLS) OVER a AS v1, first_value(i IGNORE NULLS) OVER a AS i1, avg(Flow) OVER (PARTITION BY field_id) AS m FROM i
  WINDOW b AS (PARTITION BY field_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY field_id ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT field_id, row_id, round(coalesce(Flow, v0 + (v1 - v0) * (n - i0) / (i1 - i0){edge}), 6) AS Flow FROM p"""
add("win6_interpolate", lambda d: delay.interpolate(d).select(*IDS, r6("Flow").alias("Flow")), _LINE.format(edge=""))
add("win6b_interpolate_edges", lambda d: delay.interpolate(delay.flow_delay(d, 4), edges=True).select(*IDS, r6("Flow").alias("Flow")), _LINE.format(edge=", m").replace("SELECT field_id, row_id, Flow, row_number()", "SELECT field_id, row_id, lead(Flow, 4) OVER w AS Flow, row_number()"))
add("win7_trim_passes", lambda d: delay.trim_passes(d, 10).select(*IDS, F.col("row_in_pass").cast("long").alias("row_in_pass"), "n_in_pass"), """t AS (SELECT field_id, row_id, sum("Interval") OVER (PARTITION BY field_id, Pass ORDER BY GPS_Time, row_id) AS run, row_number() OVER (PARTITION BY field_id, Pass ORDER BY GPS_Time, row_id) AS row_in_pass, count(*) OVER (PARTITION BY field_id, Pass) AS n_in_pass FROM pts)
SELECT field_id, row_id, row_in_pass, n_in_pass FROM t WHERE run > 10""")
add("win8_smooth_heading", lambda d: motion.smooth_heading(d).select(*IDS, F.round("heading", 4).alias("heading")), f"""a AS (SELECT field_id, row_id, GPS_Time, degrees(atan2((lag(X) OVER g) - X, (lag(Y) OVER g) - Y)) AS d FROM pts {_G}),
b AS (SELECT *, {_BEAR.format(d="d")} AS h0 FROM a), c AS (SELECT *, coalesce(h0, lead(h0) OVER g, 0) AS h FROM b {_G}),
e AS (SELECT *, abs(h - (lag(h) OVER g)) AS ch FROM c {_G}),
s AS (SELECT *, sum(CASE WHEN least(ch, 360 - ch) > 30 THEN 1 ELSE 0 END) OVER g AS seg FROM e {_G}),
m AS (SELECT *, avg(sin(radians(h))) OVER q AS ms, avg(cos(radians(h))) OVER q AS mc, count(*) OVER q AS n, avg(sin(radians(h))) OVER r AS s3, avg(cos(radians(h))) OVER r AS c3, count(*) OVER r AS n3 FROM s WINDOW q AS (PARTITION BY field_id, seg), r AS (PARTITION BY field_id, seg ORDER BY GPS_Time, row_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
z AS (SELECT *, degrees(sqrt(-2 * ln(least(1, greatest(sqrt(ms * ms + mc * mc), 1e-12))))) AS sd, degrees(atan2(ms, mc)) AS hs, degrees(atan2(s3, c3)) AS h3 FROM m)
SELECT field_id, row_id, round(CASE WHEN sd > 15 THEN CASE WHEN n3 = 3 THEN {_BEAR.format(d="h3")} ELSE h END WHEN n >= 3 THEN {_BEAR.format(d="hs")} ELSE h END, 4) AS heading FROM z""")
keep("win9_pass_std", lambda d: spatial.pass_std_filter(d, 2), "Flow BETWEEN m - 2 * s AND m + 2 * s", "*, avg(Flow) OVER (PARTITION BY field_id, Pass) AS m, stddev_samp(Flow) OVER (PARTITION BY field_id, Pass) AS s")
_ROLL = "*, avg(Flow) OVER r AS m, stddev_samp(Flow) OVER r AS s, count(*) OVER r AS n, count(Flow) OVER r AS k"
add("win10_sliding_window", lambda d: spatial.sliding_window(d, 11, 2).select(*IDS), f"t AS (SELECT {_ROLL} FROM pts WINDOW r AS (PARTITION BY field_id ORDER BY row_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT field_id, row_id FROM t WHERE coalesce(n < 11 OR k < 11 OR abs(Flow - m) <= 2 * s, true)")
add("win11_row_number", lambda d: d.select(*IDS, F.row_number().over(order.by_time(d)).cast("long").alias("n")), "t AS (SELECT 1) SELECT field_id, row_id, row_number() OVER (PARTITION BY field_id ORDER BY GPS_Time, row_id) AS n FROM pts")

# Units and yield.
_MEANS = "means AS (SELECT *, avg(Distance) OVER f AS md, avg(Swath) OVER f AS msw, avg(Flow) OVER f AS mf FROM pts WINDOW f AS (PARTITION BY field_id))"
add("src2_imperial", lambda d: units.imperial_to_metric(d).select(*IDS, r6("Distance").alias("Distance"), r6("Swath").alias("Swath")), f"{_MEANS} SELECT field_id, row_id, round(CASE WHEN md > 20 AND md < 200 THEN Distance * 0.0254e0 ELSE Distance END, 6) AS Distance, round(CASE WHEN msw < 3 OR msw BETWEEN 100 AND 200 OR (msw > 200 AND msw < 500) THEN Swath * 0.0254e0 ELSE Swath END, 6) AS Swath FROM means")
add("src7_standard_moisture", lambda d: units.standard_moisture(d), "t AS (SELECT 1) SELECT field_id, 15.5e0 AS standard_moisture FROM pts GROUP BY 1")
_YIELD = 'Flow * 0.453592e0 * "Interval" / (Swath * Distance) * 10000'
add("u1_flow_to_yield", lambda d: units.flow_to_yield(d).select(*IDS, r6("Yield_kg_ha").alias("Yield_kg_ha")), f"t AS (SELECT 1) SELECT field_id, row_id, round({_YIELD}, 6) AS Yield_kg_ha FROM pts WHERE Flow > 0 AND Distance > 0 AND Swath > 0")
add("u2_pounds_per_bushel", lambda d: d.select(*IDS, units.pounds_per_bushel(F.col("GrainType")).alias("lbs")), "t AS (SELECT 1) SELECT field_id, row_id, 56e0 AS lbs FROM pts")
add("u3_flow_simple", lambda d: units.flow_simple(d).select(*IDS, r6("Yield").alias("Yield")), 't AS (SELECT 1) SELECT field_id, row_id, round(Flow * 43560 / (56 * Swath / 12 * (Distance / "Interval" / 12)), 6) AS Yield FROM pts')
add("u4_flow_units", lambda d: units.flow_units(d).select(*IDS, F.round("Flow", 9).alias("Flow")), "t AS (SELECT 1) SELECT field_id, row_id, round(Flow / 56, 9) AS Flow FROM pts")
add("u5_to_yield", lambda d: units.to_yield(d).select(*IDS, r6("Yield_buacre").alias("Yield_buacre")), f"t AS (SELECT *, {V} AS v FROM pts {W}) SELECT field_id, row_id, round(Flow * 0.0929e0 * 43560 / nullif(56 * v * Swath / 39.37e0, 0), 6) AS Yield_buacre FROM t")
add("u6_convert_yield", lambda d: units.convert_yield(units.convert_yield(d.withColumn("Yield_kg_ha", F.col("Flow") * 100), "kg_ha", "t_ha"), "kg_ha", "bu_acre", "soybean").select(*IDS, r6("Yield_t_ha").alias("t"), r6("Yield_buacre").alias("bu")), "t AS (SELECT 1) SELECT field_id, row_id, round(Flow * 100 * 0.001e0, 6) AS t, round(Flow * 100 * 0.0149e0, 6) AS bu FROM pts")
add("u7_flow_lbs_to_kgha", lambda d: units.convert_yield(d).select(*IDS, r6("Yield_kg_ha_wet").alias("wet"), r6("Yield_kg_ha").alias("dry")), 't AS (SELECT *, Flow * 0.453592e0 * "Interval" * 10000 / (Swath * 0.3048e0 * (Distance * 0.3048e0)) AS wet FROM pts) SELECT field_id, row_id, round(wet, 6) AS wet, round(wet * (100 - Moisture) / (100 - 15.5e0), 6) AS dry FROM t')
add("u8_kgha_to_buacre", lambda d: units.convert_yield(d.withColumn("Yield_kg_ha", F.col("Flow") * 100), "kg_ha", "bu_acre").select(*IDS, r6("Yield_buacre").alias("bu")), "t AS (SELECT 1) SELECT field_id, row_id, round(Flow * 100 * 0.0159e0, 6) AS bu FROM pts")
add("u9_buacre_to_kgha", lambda d: units.convert_yield(d.withColumn("Yield_buacre", F.col("Flow")), "bu_acre", "kg_ha", "wheat").select(*IDS, r6("Yield_kg_ha").alias("y")), "t AS (SELECT 1) SELECT field_id, row_id, round(Flow * 65, 6) AS y FROM pts")
add("u10_dry_yield", lambda d: d.select(*IDS, r6(units.dry_yield(F.col("Flow"), F.col("Moisture"), F.lit(15.5))).alias("dry")), "t AS (SELECT 1) SELECT field_id, row_id, round(Flow * (100 - Moisture) / (100 - 15.5e0), 6) AS dry FROM pts")
add("u11_polygon_sizes", lambda d: units.polygon_sizes(d).select(*IDS, r6("Swath_m").alias("Swath_m"), r6("Distance_m").alias("Distance_m")), "t AS (SELECT 1) SELECT field_id, row_id, 8e0 AS Swath_m, round(Distance * 0.3048e0, 6) AS Distance_m FROM pts")
add("u12_yield_to_flow", lambda d: units.yield_to_flow(d.withColumn("Yield_kg_ha", F.col("Flow") * 100)).select(*IDS, r6("Flow").alias("Flow")), 't AS (SELECT 1) SELECT field_id, row_id, round(Flow * 100 * Swath * Distance / ("Interval" * 10000), 6) AS Flow FROM pts')

# Coordinates and shapes.
add("g2_utm_round_trip", lambda d: geo.utm_to_latlon(geo.latlon_to_utm(d, 19).drop("Longitude", "Latitude"), 19).select(*IDS, F.round("Longitude", 8).alias("Longitude"), F.round("Latitude", 8).alias("Latitude")), "t AS (SELECT 1) SELECT field_id, row_id, round(Longitude, 8) AS Longitude, round(Latitude, 8) AS Latitude FROM pts")
add("g4_distances", lambda d: motion.distances(d).select(*IDS, r6("distance").alias("distance")), f"t AS (SELECT field_id, row_id, round(coalesce(sqrt(power(X - (lag(X) OVER w), 2) + power(Y - (lag(Y) OVER w), 2)), 0), 6) AS distance FROM pts {W}) SELECT * FROM t")
add("g6_points", lambda d: geo.points(d).select(*IDS, F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y")), "t AS (SELECT 1) SELECT field_id, row_id, Longitude AS x, Latitude AS y FROM pts")


def _utm_sql() -> str:
    e, j = geo._E, range(1, 7)
    east = " + ".join(["eta", *(f"{a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in zip(j, geo._ALPHA, strict=True))])
    north = " + ".join(["xi", *(f"{a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in zip(j, geo._ALPHA, strict=True))])
    return f"""a AS (SELECT field_id, row_id, radians(Latitude) AS p, radians(Longitude - (19 * 6 - 183)) AS l FROM pts),
b AS (SELECT *, sinh(atanh(sin(p)) - {e!r} * atanh({e!r} * sin(p))) AS t FROM a), c AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM b)
SELECT field_id, row_id, round({geo.EASTING!r} + {geo.K0 * geo._RADIUS!r} * ({east}), 4) AS X, round({geo.K0 * geo._RADIUS!r} * ({north}), 4) AS Y FROM c"""


add("g1_latlon_to_utm", lambda d: geo.latlon_to_utm(d).select(*IDS, scaled("X", 4), scaled("Y", 4)), _utm_sql())
add("g5_polygons", lambda d: geo.polygons(d).select("field_id", F.col("orig_row_id").alias("row_id"), F.round(F.col("geometry")[0]["x"], 8).alias("x0"), F.round(F.col("geometry")[0]["y"], 8).alias("y0"), F.round(F.col("geometry")[2]["x"], 8).alias("x2"), F.round(F.col("geometry")[2]["y"], 8).alias("y2"), F.round("Flow_kg_s", 9).alias("Flow_kg_s"), r6("Altitude_m").alias("Altitude_m")), f"""h AS (SELECT *, radians(coalesce(degrees(atan2(coalesce(lag(Longitude) OVER w, Longitude) - Longitude, coalesce(lag(Latitude) OVER w, Latitude) - Latitude)), 0)) AS a, 4e0 AS sw, Distance * 0.3048e0 / 2 AS l, 1 / (111320 * cos(radians(Latitude))) AS kx, 1 / 110540e0 AS ky FROM pts {W})
SELECT field_id, row_id, round(Longitude + (sin(a) * l + cos(a) * sw) * kx, 8) AS x0, round(Latitude + (cos(a) * l - sin(a) * sw) * ky, 8) AS y0, round(Longitude - (sin(a) * l + cos(a) * sw) * kx, 8) AS x2, round(Latitude - (cos(a) * l - sin(a) * sw) * ky, 8) AS y2, round(Flow * 0.453592e0, 9) AS Flow_kg_s, round(Altitude * 0.3048e0, 6) AS Altitude_m FROM h""")
add("g7_yield_summary", lambda d: geo.yield_summary(geo.polygons(d.withColumn("Yield_kg_ha", F.col("Flow") * 100))).select("field_id", "n", *(F.round(c, 3).alias(c) for c in ("Yield_mean", "Yield_sd", "Yield_min", "Yield_max"))), "t AS (SELECT 1) SELECT field_id, count(*) AS n, round(avg(Flow * 100), 3) AS Yield_mean, round(stddev_samp(Flow * 100), 3) AS Yield_sd, round(min(Flow * 100), 3) AS Yield_min, round(max(Flow * 100), 3) AS Yield_max FROM pts GROUP BY 1")

# Thresholds and aggregates.
_VT = f"t AS (SELECT *, {V} AS v FROM pts {W})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def _iqr(c: str, low: float, high: float, k: float, sign: str) -> str:
    a, b = f"quantile_cont({c}, {low})", f"quantile_cont({c}, {high})"
    return f"{a} - {k} * ({b} - {a})" if sign == "-" else f"{b} + {k} * ({b} - {a})"


add("a1_auto_thresholds", lambda d: rounded(thresholds.auto_thresholds(d)), f"""{_VT} SELECT field_id, round(greatest(0, {_iqr("Flow", 0.05, 0.95, 1.5, "-")}), 6) AS min_yield, round({_iqr("Flow", 0.05, 0.95, 1.5, "+")}, 6) AS max_yield, round(greatest(0.5, {_iqr("v", 0.02, 0.98, 1.5, "-")}), 6) AS min_velocity, round({_iqr("v", 0.02, 0.98, 1.5, "+")}, 6) AS max_velocity,
round(quantile_cont(X, 0.02) - 100, 6) AS min_x, round(quantile_cont(X, 0.98) + 100, 6) AS max_x, round(quantile_cont(Y, 0.02) - 100, 6) AS min_y, round(quantile_cont(Y, 0.98) + 100, 6) AS max_y FROM t GROUP BY 1""")
add("a2_typed_thresholds", lambda d: rounded(thresholds.typed_thresholds(d)), f"""{_VT} SELECT field_id, round(greatest(0, {_iqr("Flow", 0.1, 0.9, 1.1, "-")}), 6) AS min_yield, round({_iqr("Flow", 0.1, 0.9, 1.1, "+")}, 6) AS max_yield, round(avg(Flow), 6) AS mean_yield, round(stddev_samp(Flow), 6) AS sd_yield, round(greatest(0.5, {_iqr("v", 0.05, 0.95, 1.1, "-")}), 6) AS min_velocity, round({_iqr("v", 0.05, 0.95, 1.1, "+")}, 6) AS max_velocity,
round(min(X) + 100, 6) AS min_x, round(max(X) - 100, 6) AS max_x, round(min(Y) + 100, 6) AS min_y, round(max(Y) - 100, 6) AS max_y, round(avg(Moisture) - 3 * stddev_samp(Moisture), 6) AS min_moisture, round(avg(Moisture) + 3 * stddev_samp(Moisture), 6) AS max_moisture FROM (SELECT * REPLACE (CASE WHEN Flow > 0 THEN Flow END AS Flow) FROM t) GROUP BY 1""")
add("a3_auto_ranges", lambda d: rounded(thresholds.auto_ranges(d)), "t AS (SELECT *, Distance / \"Interval\" AS s FROM pts) SELECT field_id, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {side}_{n}" for n, c, a, b in (("flow", "Flow", 0.01, 0.99), ("x", "X", 0.001, 0.999), ("y", "Y", 0.001, 0.999), ("velocity", "s", 0.01, 0.99)) for side, q in (("min", a), ("max", b))) + " FROM t GROUP BY 1")
add("a5_validate", lambda d: rounded(audit.validate(filters.yield_range(d, 2, 40), d)), """r AS (SELECT field_id, count(*) AS raw_n, avg(Flow) AS raw_mean, stddev_samp(Flow) AS raw_sd, stddev_samp(Flow) / avg(Flow) * 100 AS raw_cv, min(Flow) AS raw_min, max(Flow) AS raw_max FROM pts GROUP BY 1),
c AS (SELECT field_id, count(*) AS clean_n, avg(Flow) AS clean_mean, stddev_samp(Flow) AS clean_sd, stddev_samp(Flow) / avg(Flow) * 100 AS clean_cv, min(Flow) AS clean_min, max(Flow) AS clean_max FROM pts WHERE Flow BETWEEN 2 AND 40 GROUP BY 1), j AS (SELECT *, clean_n / raw_n AS retention, (raw_cv - clean_cv) / raw_cv AS cv_improvement FROM r LEFT JOIN c USING (field_id))
SELECT field_id, raw_n, clean_n, """ + ", ".join(f"round({s}_{c}, 6) AS {s}_{c}" for s in ("raw", "clean") for c in ("mean", "sd", "cv", "min", "max")) + ", round(retention, 6) AS retention, round(cv_improvement, 6) AS cv_improvement, CASE WHEN retention < 0.5 THEN 'too many points removed' WHEN retention > 0.99 THEN 'hardly any points removed' END AS warning FROM j")
_PASSES = "p AS (SELECT field_id, Pass, median(Flow) AS m, count(*) AS n FROM pts GROUP BY ALL), b AS (SELECT *, coalesce(abs(m - median(m) OVER f) > 1.5 * stddev_samp(m) OVER f, false) AS abnormal FROM p WINDOW f AS (PARTITION BY field_id))"
add("a6_pass_medians", lambda d: audit.pass_medians(d.withColumn("Yield_kg_ha", F.col("Flow")), 1.5).select("field_id", "Pass", r6("median_yield").alias("median_yield"), "n_points", "abnormal"), f"{_PASSES} SELECT field_id, Pass, round(m, 6) AS median_yield, n AS n_points, abnormal FROM b")
add("a6_pass_filter", lambda d: audit.pass_filter(d.withColumn("Yield_kg_ha", F.col("Flow")), 1.5).select(*IDS), f"{_PASSES} SELECT field_id, row_id FROM pts WHERE NOT EXISTS (SELECT 1 FROM b WHERE abnormal AND b.field_id = pts.field_id AND b.Pass = pts.Pass)")


def _log(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = d.withColumn("orig_row_id", F.col("row_id"))
    kept, first = audit.split(d, F.col("GPSStatus").isNull() | (F.col("GPSStatus") >= 4), "gps", "status below 4", "GPSStatus")
    after = filters.dop(kept)
    return d, first.unionByName(audit.removed(kept, after, "dop", "above 10", "DOP"))


_LOG = "log AS (SELECT field_id, row_id AS orig_row_id, CASE WHEN GPSStatus < 4 THEN 'gps' ELSE 'dop' END AS step, CASE WHEN GPSStatus < 4 THEN GPSStatus::DOUBLE ELSE DOP END AS value FROM pts WHERE GPSStatus < 4 OR DOP > 10)"
add("o4_deletion_log", lambda d: _log(d)[1].select("field_id", "orig_row_id", "step", "value"), f"{_LOG} SELECT * FROM log")
add("a7_deletions_by_step", lambda d: audit.deletions_by_step(_log(d)[1]), f"{_LOG} SELECT step, count(*) AS n FROM log GROUP BY 1")
add("a8_stats", lambda d: rounded(audit.stats(d, "Flow")), "t AS (SELECT 1) SELECT field_id, count(*) AS n, round(avg(Flow), 6) AS mean, round(stddev_samp(Flow), 6) AS sd, round(stddev_samp(Flow) / avg(Flow) * 100, 6) AS cv, round(min(Flow), 6) AS min, round(max(Flow), 6) AS max FROM pts GROUP BY 1")
_DIAG = f"{_LOG}, diag AS (SELECT p.field_id, p.row_id AS orig_row_id, s.step, CASE WHEN l.step IS NULL THEN 'kept' ELSE 'removed' END AS status, coalesce(l.value, CASE s.step WHEN 'gps' THEN GPSStatus::DOUBLE ELSE Flow END) AS value, CASE s.step WHEN 'gps' THEN '' ELSE 'kg/ha' END AS unit FROM pts p, (SELECT DISTINCT step FROM log) s LEFT JOIN log l ON l.field_id = p.field_id AND l.orig_row_id = p.row_id AND l.step = s.step)"
add("a9_diagnostics", lambda d: audit.diagnostics(*_log(d)), f"{_DIAG} SELECT * FROM diag")
add("a10_diagnostic_stats", lambda d: rounded(audit.diagnostic_stats(audit.diagnostics(*_log(d)))), f"{_DIAG} SELECT step, status, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(min(value), 6) AS min, round(max(value), 6) AS max FROM diag GROUP BY 1, 2")
add("a10_histogram", lambda d: audit.histogram(d.withColumn("y", F.col("Flow") * 100), "y"), "t AS (SELECT 1) SELECT floor(Flow * 100 / 250) * 250 AS bin, count(*) AS n FROM pts WHERE Flow IS NOT NULL GROUP BY 1")
add("a11_clamped_histogram", lambda d: audit.clamped_histogram(d, "Flow"), "q AS (SELECT field_id, quantile_cont(Flow, 0.02) AS a, quantile_cont(Flow, 0.98) AS b FROM pts GROUP BY 1) SELECT field_id, least(floor((least(greatest(Flow, a), b) - a) / (b - a) * 50), 49)::INTEGER AS bin, count(*) AS n FROM pts JOIN q USING (field_id) WHERE Flow IS NOT NULL GROUP BY 1, 2")

# Spatial operators.
add("x1_cell_overlap", lambda d: spatial.cell_overlap(d, 10, 8).select(*IDS, "overlap_flag"), "t AS (SELECT 1) SELECT field_id, row_id, count(*) OVER (PARTITION BY field_id, floor(X / 10), floor(Y / 10)) > 8 AS overlap_flag FROM pts")
_X2 = """b AS (SELECT field_id, row_id, X, Y, Swath * 0.0254e0 / 2 AS half, floor(min(X) OVER f / 0.3e0) * 0.3e0 AS ox, floor(min(Y) OVER f / 0.3e0) * 0.3e0 AS oy, ceil(max(X) OVER f / 0.3e0) * 0.3e0 AS ex, ceil(max(Y) OVER f / 0.3e0) * 0.3e0 AS ey FROM pts WINDOW f AS (PARTITION BY field_id)),
g AS (SELECT *, greatest(1, ceil((ex - ox) / 0.3e0))::BIGINT AS nx, greatest(1, ceil((ey - oy) / 0.3e0))::BIGINT AS ny, floor((X - ox) / 0.3e0)::BIGINT + 1 AS cx, floor((Y - oy) / 0.3e0)::BIGINT + 1 AS cy, greatest(1, ceil(half / 0.3e0))::BIGINT AS k FROM b),
m AS (SELECT *, unnest(range(greatest(1, cx - k), least(nx, cx + k) + 1)) AS kx FROM g WHERE cx BETWEEN 1 AND nx AND cy BETWEEN 1 AND ny),
n AS (SELECT *, unnest(range(greatest(1, cy - 1), least(ny, cy + 1) + 1)) AS ky FROM m),
c AS (SELECT field_id, row_id, kx, ky FROM n WHERE sqrt(power(ox + (kx - 0.5e0) * 0.3e0 - X, 2) + power(oy + (ky - 0.5e0) * 0.3e0 - Y, 2)) <= half),
r AS (SELECT field_id, row_id, min(row_id) OVER (PARTITION BY field_id, kx, ky) < row_id AS hit FROM c),
s AS (SELECT field_id, row_id, sum(hit::INT) / count(*) AS ratio FROM r GROUP BY ALL)
SELECT pts.field_id, pts.row_id, round(coalesce(ratio, 0), 6) AS overlap_ratio FROM pts LEFT JOIN s USING (field_id, row_id)"""
add("x2_overlap_ratio", lambda d: spatial.overlap_ratio(d).select(*IDS, r6("overlap_ratio").alias("overlap_ratio")), _X2)
_CELL = "PARTITION BY field_id, floor(X / (5 * 240e0 * 0.0254e0)), floor(Y / (5 * 240e0 * 0.0254e0))"
add("x3_local_sd", lambda d: spatial.local_sd(d, limit=2).select(*IDS, "local_sd_outlier"), f"t AS (SELECT *, count(*) OVER c AS n, avg(Flow) OVER c AS lm, stddev_samp(Flow) OVER c AS ls, avg(Flow) OVER f AS gm, stddev_samp(Flow) OVER f AS gs FROM pts WINDOW c AS ({_CELL}), f AS (PARTITION BY field_id)), l AS (SELECT *, coalesce(CASE WHEN n >= 3 THEN lm END, gm) AS m, coalesce(CASE WHEN n >= 3 THEN ls END, gs) AS s FROM t) SELECT field_id, row_id, Flow > m + 2 * s OR Flow < m - 2 * s AS local_sd_outlier FROM l")
add("x4_local_mad", lambda d: spatial.local_mad(d).select(*IDS, "local_sd_outlier"), f"t AS (SELECT *, count(Flow) OVER c AS n, median(Flow) OVER c AS med FROM pts WINDOW c AS ({_CELL})), u AS (SELECT *, 1.4826e0 * median(abs(Flow - med)) OVER c AS mad FROM t WINDOW c AS ({_CELL})) SELECT field_id, row_id, coalesce(n >= 3 AND mad > 0 AND abs(Flow - med) > 2.4e0 * 1.4826e0 * mad, false) AS local_sd_outlier FROM u")
add("x5_stray_positions", lambda d: spatial.stray_positions(d).select(*IDS, "position_stray"), """b AS (SELECT field_id, row_id, X, Y, floor((X - min(X) OVER f) / 20) AS cx, floor((Y - min(Y) OVER f) / 20) AS cy FROM pts WINDOW f AS (PARTITION BY field_id)),
n AS (SELECT *, count(*) OVER (PARTITION BY field_id, cx, cy) >= 5 AS ok FROM b)
SELECT field_id, row_id, NOT ok AND NOT EXISTS (SELECT 1 FROM n v WHERE v.ok AND v.field_id = n.field_id AND sqrt(power(v.X - n.X, 2) + power(v.Y - n.Y, 2)) <= 50) AS position_stray FROM n""")
add("x6_position_box", lambda d: spatial.position_box(d, 20).select(*IDS, "position_outlier"), "t AS (SELECT *, min(X) OVER f + 20 AS x0, max(X) OVER f - 20 AS x1, min(Y) OVER f + 20 AS y0, max(Y) OVER f - 20 AS y1 FROM pts WINDOW f AS (PARTITION BY field_id)) SELECT field_id, row_id, x0 < x1 AND y0 < y1 AND NOT (X BETWEEN x0 AND x1 AND Y BETWEEN y0 AND y1) AS position_outlier FROM t")
add("x0_detect_anomalies", lambda d: spatial.detect_anomalies(d, ["overlap", "position"], "detect", cellsize=10, max_pass=8, gbuffer=20).select(*IDS, "overlap_flag", "position_outlier"), "t AS (SELECT *, min(X) OVER f + 20 AS x0, max(X) OVER f - 20 AS x1, min(Y) OVER f + 20 AS y0, max(Y) OVER f - 20 AS y1 FROM pts WINDOW f AS (PARTITION BY field_id)) SELECT field_id, row_id, count(*) OVER (PARTITION BY field_id, floor(X / 10), floor(Y / 10)) > 8 AS overlap_flag, x0 < x1 AND y0 < y1 AND NOT (X BETWEEN x0 AND x1 AND Y BETWEEN y0 AND y1) AS position_outlier FROM t")
add("x7_grid_sample", lambda d: delay.grid_sample(d, 1000, 50).select(*IDS))


#: More neighbours than points without a value can stand among the ten nearest with one.
_NEAR = 60


def _moran_sql(delays: list[int]) -> str:
    """CTEs up to ``scores`` (field_id, delay, score): the nearest points of each point once, the first k with a value for each delay."""
    d2 = "(b.X - a.X) * (b.X - a.X) + (b.Y - a.Y) * (b.Y - a.Y)"
    return f"""near AS (SELECT a.field_id, a.row_id, arg_min({{'j': b.row_id, 'd2': {d2}}}, {{'d2': {d2}, 'j': b.row_id}}, {_NEAR}) AS near FROM pts a JOIN pts b ON a.field_id = b.field_id AND a.row_id <> b.row_id GROUP BY 1, 2),
n AS (SELECT field_id, row_id, Flow, row_number() OVER (PARTITION BY field_id ORDER BY row_id) AS n FROM pts),
moved AS (SELECT a.field_id, a.row_id, d.delay, b.Flow AS v FROM n a, (SELECT unnest({delays}) AS delay) d JOIN n b ON b.field_id = a.field_id AND b.n = a.n + d.delay WHERE b.Flow IS NOT NULL),
z AS (SELECT *, (v - avg(v) OVER g) / stddev_samp(v) OVER g AS z, least(10, count(*) OVER g // 10) AS k, count(*) OVER g AS valid FROM moved WINDOW g AS (PARTITION BY field_id, delay)),
cand AS (SELECT field_id, row_id, unnest(near).j AS j, 1 / (unnest(near).d2 + 1e-10) AS iw, unnest(range(len(near))) AS r FROM near),
first AS (SELECT a.field_id, a.delay, a.row_id, a.z AS za, b.z * c.iw AS zw, c.iw FROM z a JOIN cand c ON c.field_id = a.field_id AND c.row_id = a.row_id JOIN z b ON b.field_id = a.field_id AND b.delay = a.delay AND b.row_id = c.j QUALIFY row_number() OVER (PARTITION BY a.field_id, a.delay, a.row_id ORDER BY c.r) <= a.k),
w AS (SELECT field_id, delay, za * sum(zw) / sum(iw) AS p FROM first GROUP BY field_id, delay, row_id, za),
q AS (SELECT field_id, delay, sum(z * z) AS zz, any_value(valid) AS valid FROM z GROUP BY 1, 2),
scores AS (SELECT field_id, delay, CASE WHEN any_value(valid) > 50 THEN sum(p) / any_value(zz) END AS score FROM w JOIN q USING (field_id, delay) GROUP BY 1, 2)"""


add("x8_moran", lambda d: delay.delay_scores(d, [0]).select("field_id", F.round("score", 5).alias("moran")), f"{_moran_sql([0])} SELECT field_id, round(score, 5) AS moran FROM scores")
#: All delays at once take DuckDB ten minutes: the tests hold these three against every point of small fields instead.
add("x9_delay_scores", lambda d: delay.delay_adjustment(d, n_iterations=2).scores.select("field_id", "delay", F.round("mean_score", 5).alias("mean_score"), "sd_score"))
add("x9_best_delay", lambda d: delay.delay_adjustment(d, n_iterations=2).best.select("field_id", "delay", F.round("mean_score", 5).alias("mean_score")))
add("a12_top_delays", lambda d: delay.top_delays(delay.delay_adjustment(d, n_iterations=2)).select("field_id", "delay", "rank", F.round("mean_score", 5).alias("mean_score")))
add("x9_fixed_delay", lambda d: delay.delay_adjustment(d, [3], 2).best.select("field_id", "delay", F.round("mean_score", 5).alias("mean_score")), f"{_moran_sql([3])} SELECT field_id, delay::INTEGER AS delay, round(score, 5) AS mean_score FROM scores")


def _shifted_sql(best: str) -> str:
    """CTEs up to ``moved``: the points with Flow taken ``delay`` rows on, gaps filled; ``best`` gives each field's delay."""
    line = _LINE.format(edge=", m").replace("n AS (", "num AS (", 1).replace("SELECT field_id, row_id, Flow, row_number() OVER w AS n FROM pts", "SELECT field_id, row_id, Flow, row_number() OVER w AS n FROM late").replace("FROM n)", "FROM num)").replace(", 6) AS Flow FROM p", ", 12) AS Flow FROM p")
    ctes, _, last = line.rpartition("SELECT field_id, row_id, round(")
    return f"""{best}, rows AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY row_id) AS at FROM pts), late AS (SELECT a.field_id, a.row_id, a.X, a.Y, b.Flow FROM rows a JOIN best USING (field_id) LEFT JOIN rows b ON b.field_id = a.field_id AND b.at = a.at + best.delay),
{ctes.strip()}, filled AS (SELECT field_id, row_id, round({last}), moved AS (SELECT pts.* REPLACE (filled.Flow AS Flow), pts.Flow AS Flow_raw FROM pts JOIN filled USING (field_id, row_id))"""


add("x10_optimize_delays", lambda d: delay.optimize_delays(d, "flow", n_iterations=2)[0].select(*IDS, r6("Flow").alias("Flow"), "Flow_raw"))
add("x10_fixed_delay", lambda d: delay.optimize_delays(d, "flow", delays=[-2], n_iterations=2)[0].select(*IDS, r6("Flow").alias("Flow"), "Flow_raw"), f"{_shifted_sql('best AS (SELECT DISTINCT field_id, -2 AS delay FROM pts)')} SELECT field_id, row_id, round(Flow, 6) AS Flow, Flow_raw FROM moved")
_BREAKS = "[" + ", ".join(f"{i / 49!r}" for i in range(50)) + "]"
add("x11_coherence", lambda d: spatial.coherence(d.filter("Flow IS NOT NULL")).select("field_id", r6("rsc").alias("rsc")), f"""b AS (SELECT field_id, quantile_cont(X, {_BREAKS}) AS bx, quantile_cont(Y, {_BREAKS}) AS byy, avg(Flow) AS m, var_samp(Flow) AS v FROM pts WHERE Flow IS NOT NULL GROUP BY 1),
k AS (SELECT field_id, Flow, m, v, len(list_filter(bx, lambda q: q <= X)) AS kx, len(list_filter(byy, lambda q: q <= Y)) AS ky FROM pts JOIN b USING (field_id) WHERE Flow IS NOT NULL),
c AS (SELECT field_id, kx, ky, avg(Flow) AS cm, any_value(m) AS m, any_value(v) AS v FROM k WHERE kx BETWEEN 1 AND 49 AND ky BETWEEN 1 AND 49 GROUP BY 1, 2, 3 HAVING count(*) > 2)
SELECT field_id, round(CASE WHEN count(*) >= 10 THEN greatest(0, least(1, 1 - avg((cm - m) * (cm - m)) / any_value(v))) ELSE 0 END, 6) AS rsc FROM c GROUP BY 1""")
add("a4_filter_counts", lambda d: audit.filter_counts(d.withColumn("Yield_kg_ha", F.col("Flow") * 100), velocity_jump=True, heading_anomaly=True))

# Anonymisation.
QUERIES["n5_sensitive_columns"] = lambda spark, sf_dir: anonymize.sensitive_columns(spark)
ORACLES["n5_sensitive_columns"] = 'SELECT * FROM (VALUES ' + ", ".join(str(tuple(r)) for r in anonymize.CATALOGUE) + ') t("column", description, sensitivity, recommendation)'
add("n1_anonymize_restore", lambda d: (lambda moved: anonymize.restore_coordinates(*moved))(anonymize.anonymize_coordinates(d, seed=7)).select(*IDS, F.round("Longitude", 9).alias("Longitude"), F.round("Latitude", 9).alias("Latitude")), "t AS (SELECT 1) SELECT field_id, row_id, round(Longitude, 9) AS Longitude, round(Latitude, 9) AS Latitude FROM pts")
add("n4_remove_sensitive", lambda d: anonymize.remove_sensitive(d, keep_temporal=True).select(*IDS, r6("Time_Relative_Min").alias("minutes"), "GrainType"), "t AS (SELECT 1) SELECT field_id, row_id, round((GPS_Time - min(GPS_Time) OVER (PARTITION BY field_id)) / 60, 6) AS minutes, GrainType FROM pts")
add("n4_generalize_hour", lambda d: anonymize.remove_sensitive(d, generalize="hour").select(*IDS, "GPS_Time"), "t AS (SELECT 1) SELECT field_id, row_id, strftime(make_timestamp(GPS_Time * 1000000), '%Y-%m-%d %H:00') AS GPS_Time FROM pts")
add("n8_translation", lambda d: anonymize.anonymize_data(d, dx=1000, dy=-2000).select(*IDS, r6("X").alias("X"), r6("Y").alias("Y"), F.round("Longitude", 8).alias("Longitude")), "t AS (SELECT 1) SELECT field_id, row_id, round(X + 1000, 6) AS X, round(Y - 2000, 6) AS Y, round(Longitude + 1000 / 111320e0, 8) AS Longitude FROM pts")
add("n8_rotation", lambda d: anonymize.anonymize_data(d, "coordinates", "rotation", angle=90.0).select(*IDS, F.round("X", 4).alias("X"), F.round("Y", 4).alias("Y")), "t AS (SELECT *, avg(X) OVER f AS mx, avg(Y) OVER f AS my FROM pts WINDOW f AS (PARTITION BY field_id)) SELECT field_id, row_id, round(mx - (Y - my), 4) AS X, round(my + (X - mx), 4) AS Y FROM t")
add("n9_aggregate_cells", lambda d: anonymize.aggregate_cells(d).select("field_id", F.col("cell_x").cast("double").alias("cell_x"), F.col("cell_y").cast("double").alias("cell_y"), "n", r6("Flow").alias("Flow")), "t AS (SELECT 1) SELECT field_id, floor(X / 50) * 50 AS cell_x, floor(Y / 50) * 50 AS cell_y, count(*) AS n, round(avg(Flow), 6) AS Flow FROM pts GROUP BY 1, 2, 3")
add("n9_rounded", lambda d: anonymize.rounded(d).select(*IDS, "Longitude", "Latitude"), "t AS (SELECT 1) SELECT field_id, row_id, round(Longitude, 3) AS Longitude, round(Latitude, 3) AS Latitude FROM pts")

# Gridded maps.
add("snk6_cell_means", lambda d: raster.cell_means(d).select("field_id", "cell_x", "cell_y", r6("value").alias("value"), "n"), "t AS (SELECT 1) SELECT field_id, floor(X / 5)::BIGINT AS cell_x, floor(Y / 5)::BIGINT AS cell_y, round(avg(Flow), 6) AS value, count(*) AS n FROM pts WHERE Flow IS NOT NULL GROUP BY 1, 2, 3")
_GRID = """b AS (SELECT field_id, floor(min(X) / 4)::BIGINT AS x0, floor(max(X) / 4)::BIGINT AS x1, floor(min(Y) / 4)::BIGINT AS y0, floor(max(Y) / 4)::BIGINT AS y1 FROM pts GROUP BY 1),
c AS (SELECT field_id, cell_x, y0, y1 FROM (SELECT *, unnest(range(x0 - 5, x1 + 6)) AS cell_x FROM b)), g AS (SELECT field_id, cell_x, unnest(range(y0 - 5, y1 + 6)) AS cell_y FROM c),
n AS (SELECT g.field_id, cell_x, cell_y, Flow AS v, sqrt(power((cell_x + 0.5e0) * 4 - X, 2) + power((cell_y + 0.5e0) * 4 - Y, 2)) AS d FROM g JOIN pts ON g.field_id = pts.field_id AND Flow IS NOT NULL)"""
add("snk7_idw", lambda d: raster.interpolate(d, 4, "Flow", "idw").select("field_id", "cell_x", "cell_y", r6("value").alias("value")), f"{_GRID} SELECT field_id, cell_x, cell_y, round(coalesce(avg(v) FILTER (d < 1e-12), sum(v / (d * d)) FILTER (d >= 1e-12) / sum(1 / (d * d)) FILTER (d >= 1e-12)), 6) AS value FROM n WHERE d <= 60 GROUP BY 1, 2, 3")
add("snk7_nearest", lambda d: raster.interpolate(d, 4, "Flow", "nearest").select("field_id", "cell_x", "cell_y", "value"), f"{_GRID} SELECT field_id, cell_x, cell_y, first(v ORDER BY d, v) AS value FROM n WHERE d <= 80 GROUP BY 1, 2, 3")

# Pipelines.
add("pl1_clean_yield", lambda d: cleaning.clean_yield(d, n_iterations=2, swath_unit="in").clean.select(*IDS, r6("Yield_kg_ha").alias("Yield_kg_ha")))
add("pl2_clean_fast", lambda d: cleaning.clean_yield_fast(cleaning.prepare(d, cleaning.CleaningParams(delays=False))[0], gps=True, header=True, null_yield=True).clean.select(*IDS, r6("Yield_kg_ha").alias("Yield_kg_ha")), f"t AS (SELECT *, {_YIELD} AS wet FROM pts WHERE Flow > 0 AND Distance > 0 AND Swath > 0), z AS (SELECT *, wet * (100 - coalesce(Moisture, 15.5e0)) / (100 - 15.5e0) AS dry FROM t) SELECT field_id, row_id, round(dry, 6) AS Yield_kg_ha FROM z WHERE (GPSStatus IS NULL OR GPSStatus >= 4) AND (HeaderStatus IN (0, 1, 33) OR HeaderStatus IS NULL) AND dry > 0")
add("pl3_deletions_by_step", lambda d: cleaning.clean_yield_with_tracking(d, swath_unit="in").by_step())
add("pl4_polygons", lambda d: cleaning.shapes(d, swath_unit="in").select("field_id", "orig_row_id", F.round("Heading_deg", 3).alias("heading"), r6("Yield_kg_ha").alias("Yield_kg_ha")))
add("pl5_older_variant", lambda d: cleaning.clean_yield_older(d, swath_unit="in").clean.select(*IDS, r6("Yield_kg_ha").alias("Yield_kg_ha")))


def _cleaning_sql(p: cleaning.CleaningParams, shift: int) -> tuple[str, list[tuple[str, str, str]]]:
    """CTEs of a whole cleaning with one fixed delay, and (step, table before, table after) of each step."""
    f, g = "WINDOW f AS (PARTITION BY field_id)", "WINDOW g AS (PARTITION BY field_id ORDER BY GPS_Time, row_id)"
    ctes, steps, last = [_shifted_sql(f"best AS (SELECT DISTINCT field_id, {shift} AS delay FROM pts)")], [], "moved"

    def step(name: str, columns: str, condition: str, window: str = "") -> None:
        nonlocal last
        ctes.append(f"m_{name} AS (SELECT *, {columns} FROM {last} {window})" if columns else f"m_{name} AS (FROM {last})")
        drop = [c.rpartition(" AS ")[2] for c in columns.split(" ; ")] if columns else []
        ctes[-1] = ctes[-1].replace(" ; ", ", ")
        ctes.append(f"s_{name} AS (SELECT * {'EXCLUDE (' + ', '.join(drop) + ')' if drop else ''} FROM m_{name} WHERE {condition})")
        steps.append((name, last, f"s_{name}"))
        last = f"s_{name}"

    step("no_flow", "", "Flow > 0 AND Distance > 0 AND Swath > 0")
    ctes.append(f"wet AS (SELECT *, {_YIELD} AS wet FROM {last}), dry AS (SELECT *, wet * (100 - coalesce(Moisture, 15.5e0)) / (100 - 15.5e0) AS yld FROM wet)")
    last = "dry"
    step("trim", 'sum("Interval") OVER (PARTITION BY field_id, Pass ORDER BY GPS_Time, row_id) AS run ; sum("Interval") OVER (PARTITION BY field_id, Pass) AS total', f"run > {shift}" if shift > 0 else f"total - run > {-shift}" if shift < 0 else "true")
    step("gps", "", "GPSStatus IS NULL OR GPSStatus >= 4")
    ctes.append(f"speed AS (SELECT *, coalesce({V}, 0) AS v FROM {last} {W})")
    last, before = "speed", last
    step("velocity", f"quantile_cont(v, {p.vllim}) OVER f AS a ; quantile_cont(v, {p.vulim}) OVER f AS b", f"v BETWEEN greatest({p.minv_abs}, a - {p.vscale} * (b - a)) AND b + {p.vscale} * (b - a)", f)
    steps[-1] = ("velocity", before, last)
    if p.velocity_jump:
        step("velocity_jump", f"""({_STEP.format(f="lead")} / coalesce(lead("Interval") OVER g, 1) - {_STEP.format(f="lag")} / coalesce(lag("Interval") OVER g, 1)) / coalesce("Interval", 1) AS acc""", f"NOT coalesce(acc > {p.max_acceleration} OR acc < {p.max_deceleration}, false)", g)
    if p.heading:
        ctes.append(f"bear AS (SELECT *, degrees(atan2(X - (lag(X) OVER g), Y - (lag(Y) OVER g))) AS d FROM {last} {g}), turn AS (SELECT * EXCLUDE (d), {_BEAR.format(d='d')} AS h FROM bear)")
        last, before = "turn", last
        step("heading", "abs(h - (lag(h) OVER g)) AS c", f"NOT coalesce(least(c, 360 - c) > {p.max_heading_change}, false)", g)
        steps[-1] = ("heading", before, last)
    step("header", "", "HeaderStatus IN (0, 1, 33) OR HeaderStatus IS NULL")
    step("null_yield", "", "yld > 0")
    step("yield_range", f"quantile_cont(yld, {p.yllim}) OVER f AS a ; quantile_cont(yld, {p.yulim}) OVER f AS b", f"yld BETWEEN greatest({p.miny_abs}, a - {p.yscale} * (b - a)) AND b + {p.yscale} * (b - a)", f)
    step("moisture", "avg(Moisture) OVER f AS m ; stddev_samp(Moisture) OVER f AS s", f"Moisture IS NULL OR Moisture BETWEEN m - {p.n_std} * s AND m + {p.n_std} * s", f)
    inner = _X2.replace("FROM pts WINDOW f", f"FROM {last} WINDOW f").rpartition("\nSELECT")[0]
    for name in "bgmncrs":
        inner = inner.replace(f"{name} AS (SELECT", f"o_{name} AS (SELECT", 1).replace(f" FROM {name} ", f" FROM o_{name} ").replace(f" FROM {name})", f" FROM o_{name})")
    ctes.append(f"{inner}, ratio AS (SELECT t.*, coalesce(ratio, 0) AS overlap FROM {last} t LEFT JOIN o_s USING (field_id, row_id))")
    last, before = "ratio", last
    step("overlap", "", f"overlap <= {p.overlap_threshold}")
    steps[-1] = ("overlap", before, last)
    cell = f"PARTITION BY field_id, floor(X / size), floor(Y / size)"
    ctes.append(f"sized AS (SELECT *, {p.n_swaths} * avg(Swath) OVER f * 0.0254e0 AS size FROM {last} {f})")
    last, before = "sized", last
    step("local_sd", "count(*) OVER c AS n ; avg(yld) OVER c AS lm ; stddev_samp(yld) OVER c AS ls ; avg(yld) OVER f AS gm ; stddev_samp(yld) OVER f AS gs", f"yld BETWEEN coalesce(CASE WHEN n >= {p.min_cells} THEN lm END, gm) - {p.lsd_limit} * coalesce(CASE WHEN n >= {p.min_cells} THEN ls END, gs) AND coalesce(CASE WHEN n >= {p.min_cells} THEN lm END, gm) + {p.lsd_limit} * coalesce(CASE WHEN n >= {p.min_cells} THEN ls END, gs)", f"WINDOW c AS ({cell}), f AS (PARTITION BY field_id)")
    steps[-1] = ("local_sd", before, last)
    if p.pass_filter:
        ctes.append(f"pm AS (SELECT field_id, Pass, median(yld) AS m FROM {last} GROUP BY ALL), pb AS (SELECT field_id, Pass, coalesce(abs(m - median(m) OVER f) > {p.pass_threshold} * stddev_samp(m) OVER f, false) AS bad FROM pm {f})")
        ctes.append(f"s_pass AS (SELECT t.* FROM {last} t JOIN pb USING (field_id, Pass) WHERE NOT bad)")
        steps.append(("pass_filter", last, "s_pass"))
        last = "s_pass"
    return ", ".join(ctes), steps


def _heading_sql(table: str) -> str:
    """The query of win8 on another table, up to its last SELECT, with CTEs of its own names."""
    body = next(v for k, v in ORACLES.items() if k == "win8_smooth_heading").partition("a AS (SELECT field_id, row_id, GPS_Time")[2]
    body = "ha AS (SELECT field_id, row_id, GPS_Time" + body.replace("FROM pts", f"FROM {table}")
    for name in "abcesmz":
        body = body.replace(f"\n{name} AS (", f"\nh{name} AS (").replace(f" {name} AS (SELECT", f" h{name} AS (SELECT").replace(f" FROM {name} ", f" FROM h{name} ").replace(f" FROM {name})", f" FROM h{name})")
    return body.replace("round(CASE", "CASE").replace("END, 4) AS heading FROM z", "END AS heading FROM hz")


#: The same pipelines with one delay for all fields, which SQL follows step by step.
FIXED = {"delay_range": (3,), "n_iterations": 2, "swath_unit": "in"}


def _add_fixed() -> None:
    params = lambda **more: cleaning.replace(cleaning.CleaningParams(), **FIXED, **more)
    ctes, steps = _cleaning_sql(params(), 3)
    add("pl1_fixed_delay", lambda d: cleaning.clean_yield(d, **FIXED).clean.select(*IDS, r6("Yield_kg_ha").alias("Yield_kg_ha")), f"{ctes} SELECT field_id, row_id, round(yld, 6) AS Yield_kg_ha FROM {steps[-1][2]}")
    add("pl4_fixed_delay", lambda d: cleaning.shapes(d, **FIXED).select("field_id", "orig_row_id", F.round("Heading_deg", 3).alias("heading"), r6("Yield_kg_ha").alias("Yield_kg_ha")), f"{ctes}, heads AS (SELECT * FROM ({'WITH ' + _heading_sql(steps[-1][2])})) SELECT field_id, row_id AS orig_row_id, round(heading, 3) AS heading, round(yld, 6) AS Yield_kg_ha FROM {steps[-1][2]} JOIN heads USING (field_id, row_id)")
    ctes, steps = _cleaning_sql(params(velocity_jump=True, heading=True, pass_filter=True), 3)
    counted = " UNION ALL ".join(f"SELECT '{n}' AS step, (SELECT count(*) FROM {a}) - (SELECT count(*) FROM {b}) AS n" for n, a, b in steps)
    add("pl3_fixed_delay", lambda d: cleaning.clean_yield_with_tracking(d, **FIXED).by_step(), f"{ctes} SELECT step, n FROM ({counted}) WHERE n > 0")
    older = cleaning.OLDER
    ctes, steps = _cleaning_sql(params(**older), 3)
    add("pl5_fixed_delay", lambda d: cleaning.clean_yield_older(d, **FIXED).clean.select(*IDS, r6("Yield_kg_ha").alias("Yield_kg_ha")), f"{ctes} SELECT field_id, row_id, round(yld, 6) AS Yield_kg_ha FROM {steps[-1][2]}")


_add_fixed()
