"""Row filters.  What happens to nulls and to missing columns is part of each one's meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.rcompat import INF, finite, first_of, need, only_finite
from furrow.operators import motion, order

ORDER = ("header", "gps", "dop", "velocity", "yield", "moisture", "bounds")


def header(df: DataFrame, values: tuple[int, ...] = (1, 33), keep_null: bool = True, missing: str = "silent") -> DataFrame:
    if not need(df, missing, "HeaderStatus"):
        return df
    ok = F.col("HeaderStatus").isin(*values)
    return df.filter(ok | F.col("HeaderStatus").isNull() if keep_null else ok)


def gps(df: DataFrame, least: float = 4, missing: str = "silent") -> DataFrame:
    """A status that is null or no number passes."""
    if not need(df, missing, "GPSStatus"):
        return df
    status = F.col("GPSStatus").try_cast("double")
    return df.filter(status.isNull() | (status >= least))


def dop(df: DataFrame, most: float = 10, missing: str = "silent") -> DataFrame:
    if not need(df, missing, "DOP"):
        return df
    return df.filter(F.col("DOP").isNull() | (F.col("DOP") <= most))


def quantile(df: DataFrame, value: Column, p: float) -> Column:
    """The linearly interpolated quantile of a field's finite values."""
    return F.percentile(only_finite(value), p).over(order.whole(df))


def velocity_range(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Keeps velocities in the range; the first row's is 0.

    A bound that is not given comes from the quantiles 0.05 and 0.95, widened by
    1.5 times their distance, the lower one 0.5 at least.
    """
    if not need(df, "warn", "X", "Y"):
        return df
    columns = df.columns
    df = df.withColumn("__v", F.coalesce(motion.velocity(df), F.lit(0.0)))
    v = F.col("__v")
    if low is None or high is None:
        df = df.withColumns({"__a": quantile(df, v, 0.05), "__b": quantile(df, v, 0.95)})
        span = 1.5 * (F.col("__b") - F.col("__a"))
        df = df.withColumns({"__low": F.greatest(F.lit(0.5), F.col("__a") - span), "__high": F.col("__b") + span})
    lower = F.lit(low) if low is not None else F.col("__low")
    upper = F.lit(high) if high is not None else F.col("__high")
    return df.filter(v.between(lower, upper)).select(*columns)


def velocity_fixed(df: DataFrame, low: float = 0.5, high: float = 10) -> DataFrame:
    """Keeps velocities in the range; the first row has none and goes."""
    if not need(df, "warn", "X", "Y", "Interval"):
        return df
    columns = df.columns
    return df.withColumn("__v", motion.velocity(df)).filter(F.col("__v").between(low, high)).select(*columns)


def within_spread(df: DataFrame, column: str, low: float | None, high: float | None, n_std: float, clamp: bool, keep_null: bool = False) -> DataFrame:
    """Keeps finite values in the range; a bound that is not given is the field's mean and so many standard deviations."""
    columns, value = df.columns, F.col(column)
    df = df.withColumns({"__m": F.avg(only_finite(value)).over(order.whole(df)), "__s": F.stddev_samp(only_finite(value)).over(order.whole(df))})
    lower = F.lit(low) if low is not None else F.col("__m") - n_std * F.col("__s")
    if low is None and clamp:
        lower = F.greatest(F.lit(0.0), lower)
    upper = F.lit(high) if high is not None else F.col("__m") + n_std * F.col("__s")
    ok = finite(value) & value.between(lower, upper)
    return df.filter(ok | value.isNull() if keep_null else ok).select(*columns)


def yield_range(df: DataFrame, low: float | None = None, high: float | None = None, n_std: float = 3) -> DataFrame:
    """On the first of Yield_kg_ha, Yield, Flow; the automatic lower bound is 0 at least."""
    column = first_of(df, "Yield_kg_ha", "Yield", "Flow")
    if column is None:
        need(df, "warn", "Yield_kg_ha")
        return df
    return within_spread(df, column, low, high, n_std, clamp=True)


def yield_column_range(df: DataFrame, column: str = "Yield_kg_ha", low: float | None = None, high: float | None = None, n_std: float = 3) -> DataFrame:
    """On the named column; the automatic lower bound may be negative."""
    return within_spread(df, column, low, high, n_std, clamp=False) if need(df, "warn", column) else df


def positive_yield(df: DataFrame, column: str = "Yield_kg_ha") -> DataFrame:
    return df.filter(F.col(column) > 0) if need(df, "silent", column) else df


def moisture_range(df: DataFrame, low: float | None = None, high: float | None = None, n_std: float = 3, keep_null: bool = False, missing: str = "silent") -> DataFrame:
    return within_spread(df, "Moisture", low, high, n_std, False, keep_null) if need(df, missing, "Moisture") else df


def bounds(df: DataFrame, box: dict[str, float] | None = None, coord_type: str = "utm", missing: str = "silent") -> DataFrame:
    """Keeps points in the box (min_x, max_x, min_y, max_y), borders included."""
    if box is None:
        if missing == "warn":
            need(df, "warn", "bounds")
        return df
    x, y = ("X", "Y") if coord_type == "utm" else ("Longitude", "Latitude")
    return df.filter(F.col(x).between(box["min_x"], box["max_x"]) & F.col(y).between(box["min_y"], box["max_y"]))


def filter_data(df: DataFrame, types: str | list[str] = "all", **params) -> DataFrame:
    """Applies the named filters in their fixed order; ``all`` leaves bounds out, unknown names are ignored."""
    if not isinstance(types, str) and not all(isinstance(t, str) for t in types):
        raise TypeError("types must be text")
    wanted = set(ORDER) - {"bounds"} if types == "all" or "all" in types else {types} if isinstance(types, str) else set(types)
    steps = {
        "header": lambda d: header(d, params.get("header_values", (1, 33))),
        "gps": lambda d: gps(d, params.get("min_gps_status", 4)),
        "dop": lambda d: dop(d, params.get("max_dop", 10)),
        "velocity": lambda d: velocity_range(d, params.get("min_velocity"), params.get("max_velocity")),
        "yield": lambda d: yield_range(d, params.get("min_yield"), params.get("max_yield"), params.get("n_std", 3)),
        "moisture": lambda d: moisture_range(d, params.get("min_moisture"), params.get("max_moisture"), params.get("n_std", 3)),
        "bounds": lambda d: bounds(d, params.get("bounds"), params.get("coord_type", "utm")),
    }
    for step in ORDER:
        if step in wanted:
            df = df.transform(steps[step])
    return df


FLAGS = ("flag_header", "flag_velocity", "flag_yield_range", "flag_moisture", "flag_gps", "flag_delay", "flag_overlap", "flag_std")


def add_flags(df: DataFrame, header_filtered: bool = True) -> DataFrame:
    """Eight flags of 0; the header flag is 1 for an inactive or null header."""
    df = df.withColumns({f: F.lit(0) for f in FLAGS})
    if header_filtered:
        df = df.withColumn("flag_header", F.when(F.coalesce(F.col("HeaderStatus").isin(0, 1, 33), F.lit(False)), 0).otherwise(1))
    return df


def pick(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns that are there, renamed."""
    return df.select(*(F.col(c).alias(name) for c, name in wanted.items() if c in df.columns))


__all__ = ["INF", "add_flags", "bounds", "dop", "filter_data", "gps", "header", "moisture_range", "pick", "positive_yield", "velocity_fixed", "velocity_range", "yield_column_range", "yield_range"]
