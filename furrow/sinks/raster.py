"""Gridded maps: cell means, and interpolation by inverse distances, nearest points or a thin plate spline."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.rcompat import first_of
from furrow.operators import order

#: Points on which a thin plate spline is solved on the driver, at most; more are interpolated by distances.
MAX_SPLINE_POINTS = 5000
NO_DATA = -9999
#: Distances of cells and points that a task holds at a time.
BLOCK = 1 << 18
#: Points that a task sorts, about; their number sets that of the tasks, whatever the session's partitions.
TASK_POINTS = 1 << 17


def cell_means(df: DataFrame, resolution: float = 5, column: str | None = None) -> DataFrame:
    """Rows (cell_x, cell_y, value, n) of cells that hold points."""
    column = column or first_of(df, "Yield_kg_ha", "Yield", "Flow")
    at = {c: F.floor(F.col(c) / resolution).cast("long") for c in ("X", "Y")}
    return df.filter(F.col(column).isNotNull()).groupBy(*order.keys(df), at["X"].alias("cell_x"), at["Y"].alias("cell_y")).agg(F.avg(column).alias("value"), F.count("*").alias("n"))


def template(df: DataFrame, cell: float, margin: int) -> DataFrame:
    """All cells of each field's bounding box and a margin, as their middles (gx, gy)."""
    box = df.groupBy(*order.keys(df)).agg(*(f(F.floor(F.col(c) / cell)).cast("long").alias(f"{n}{c}") for c in ("X", "Y") for n, f in (("lo", F.min), ("hi", F.max))))
    grid = box.withColumn("cell_x", F.explode(F.sequence(F.col("loX") - margin, F.col("hiX") + margin))).withColumn("cell_y", F.explode(F.sequence(F.col("loY") - margin, F.col("hiY") + margin)))
    return grid.select(*order.keys(df), "cell_x", "cell_y", ((F.col("cell_x") + 0.5) * cell).alias("gx"), ((F.col("cell_y") + 0.5) * cell).alias("gy"))


def _near(df: DataFrame, column: str, cell: float, radius: float, margin: int, method: str) -> DataFrame:
    """Rows (cell_x, cell_y, value) of the cells with a point within the radius.

    Points go to the tiles of the radius' size around them, and a batch of a tile's points
    meets the tile's cells as one block, so that pairs are never rows and a dense tile is
    taken batch by batch.  A cell lies in one tile, whose points come one after another,
    so that its batches are added where they are and a cell is a row once.
    """
    on = order.keys(df)
    box = df.groupBy(*on).agg(*(f(F.floor(F.col(c) / cell)).cast("long").alias(f"{n}{c}") for c in ("X", "Y") for n, f in (("lo", F.min), ("hi", F.max))))
    pts = df.filter(F.col(column).isNotNull()).select(*on, F.col("X").cast("double").alias("X"), F.col("Y").cast("double").alias("Y"), F.col(column).cast("double").alias("v"), F.floor(F.col("X") / radius).cast("long").alias("bx"), F.floor(F.col("Y") / radius).cast("long").alias("by"))
    pts = pts.filter(F.col("bx").isNotNull() & F.col("by").isNotNull())
    tasks = 1 + 9 * pts.count() // TASK_POINTS
    pts = pts.join(box, on) if on else pts.crossJoin(box)
    for b, c in (("bx", "X"), ("by", "Y")):
        pts = pts.withColumn(b, F.explode(F.array(F.col(b) - 1, F.col(b), F.col(b) + 1)))
        pts = pts.filter(((F.col(b) + 1) * radius >= (F.col(f"lo{c}") - margin) * cell) & (F.col(b) * radius <= (F.col(f"hi{c}") + margin + 1) * cell))
    tile = [*on, "bx", "by"]

    def middles(b: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(max(low - margin, int(b * radius // cell) - 2), min(high + margin, int((b + 1) * radius // cell) + 2) + 1)
        middle = (at + 0.5) * cell
        return at[np.floor(middle / radius) == b], middle[np.floor(middle / radius) == b]

    def block(gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        dx, dy = gx[:, None] - x, gy[:, None] - y
        d = np.sqrt(dx * dx + dy * dy)
        zero = np.zeros(len(gx))
        if method == "nearest":
            first = d.argmin(axis=1)  # values are in order, so ties go to the smaller
            best = d[np.arange(len(gx)), first]
            return best, v[first], zero, (best <= radius).astype(np.int64)
        near, centre = d <= radius, d < 1e-12
        apart = near & ~centre
        q = np.where(apart, d * d, 1.0)
        return np.where(apart, v / q, 0.0).sum(axis=1), np.where(apart, 1 / q, 0.0).sum(axis=1), np.where(centre, v, 0.0).sum(axis=1), np.where(near.any(axis=1), centre.sum(axis=1), -1)

    def merged(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        (a, b, c, n), (p, q, r, m) = one, two
        if method == "nearest":
            return np.minimum(a, p), np.where(a < p, b, np.where(a > p, q, np.fmin(b, q))), c, np.maximum(n, m)
        return a + p, b + q, c + r, np.where((n < 0) | (m < 0), np.maximum(n, m), n + m)

    def finished(key: tuple, cx: np.ndarray, cy: np.ndarray, sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        a, b, c, n = sums
        ok = n > 0 if method == "nearest" else n >= 0
        value = b if method == "nearest" else np.where(n > 0, c / np.maximum(n, 1), a / np.where(b > 0, b, 1.0))
        keys = [pa.repeat(k, int(ok.sum())) for k in key[: len(on)]]
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(v[ok]) for v in (cx, cy, value))], names=[*on, "cell_x", "cell_y", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("bx", "by", "X", "Y", "v", "loX", "hiX", "loY", "hiY")}
            new = np.zeros(batch.num_rows, bool)
            for n in tile:
                code = batch.column(n).dictionary_encode("encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            cuts = np.concatenate(([0], np.flatnonzero(new), [batch.num_rows])) if batch.num_rows else np.zeros(1, int)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                (kx, gx), (ky, gy) = middles(cols["bx"][i], cols["loX"][i], cols["hiX"][i]), middles(cols["by"][i], cols["loY"][i], cols["hiY"][i])
                if not len(kx) or not len(ky):
                    continue
                by_value = np.argsort(cols["v"][i:j], kind="stable")
                x, y, v = (cols[n][i:j][by_value] for n in ("X", "Y", "v"))
                cx, cy = np.repeat(kx, len(ky)), np.tile(ky, len(kx))
                mx, my = np.repeat(gx, len(ky)), np.tile(gy, len(kx))
                step = max(1, BLOCK // len(v))
                found = [block(mx[k : k + step], my[k : k + step], x, y, v) for k in range(0, len(cx), step)]
                sums = tuple(np.concatenate(part) for part in zip(*found, strict=True))
                key = tuple(batch.column(n)[i] for n in tile)
                if held and held[0] == key:
                    sums = merged(held[3], sums)
                elif held:
                    yield finished(*held)
                held = key, cx, cy, sums
        if held:
            yield finished(*held)

    kinds = "".join(f"`{c}` {pts.schema[c].dataType.simpleString()}, " for c in on)
    return pts.repartition(tasks, *tile).sortWithinPartitions(*tile).mapInArrow(run, f"{kinds}cell_x long, cell_y long, value double")


def interpolate(df: DataFrame, cell: float = 1, column: str = "Yield_kg_ha", method: str = "auto", margin: int = 5) -> DataFrame:
    """Rows (cell_x, cell_y, value); ``auto`` is a spline for few points, else inverse distances.

    Inverse distances: squared, within 15 cells; points at a cell's centre
    give it their mean value.  Nearest: within 20 cells, ties
    to the smaller value.  Cells with no point near are left out.
    """
    if method not in ("auto", "tps", "idw", "nearest"):
        raise ValueError(f"unknown method {method}")
    on = order.keys(df)
    if method == "tps" or method == "auto" and df.filter(F.col(column).isNotNull()).limit(MAX_SPLINE_POINTS + 1).count() <= MAX_SPLINE_POINTS and not on:
        return spline(df, cell, column, margin)
    return _near(df, column, cell, (20 if method == "nearest" else 15) * cell, margin, method)


def spline(df: DataFrame, cell: float, column: str, margin: int) -> DataFrame:
    """Thin plate spline; the points are bounded, and cells are evaluated where they are."""
    rows = df.filter(F.col(column).isNotNull()).groupBy("X", "Y").agg(F.avg(column).alias("v")).limit(MAX_SPLINE_POINTS + 1).toPandas().sort_values(["X", "Y"])
    if len(rows) > MAX_SPLINE_POINTS or len(rows) < 3:
        raise ValueError(f"a spline takes 3 to {MAX_SPLINE_POINTS} points")
    p, v = rows[["X", "Y"]].to_numpy(), rows["v"].to_numpy()
    centre = p.mean(axis=0)
    p = p - centre
    kernel = lambda d2: np.where(d2 > 0, d2 * np.log(np.maximum(d2, 1e-300)) / 2, 0.0)
    n = len(p)
    system = np.zeros((n + 3, n + 3))
    system[:n, :n] = kernel(((p[:, None] - p[None]) ** 2).sum(axis=2))
    system[:n, n] = system[n, :n] = 1
    system[:n, n + 1 :] = p
    system[n + 1 :, :n] = p.T
    weights = np.linalg.lstsq(system, np.append(v, np.zeros(3)), rcond=None)[0]

    def evaluate(parts):
        for g in parts:
            at = g[["gx", "gy"]].to_numpy() - centre
            out = np.empty(len(at))
            for a in range(0, len(at), 500):
                q = at[a : a + 500]
                out[a : a + 500] = kernel(((q[:, None] - p[None]) ** 2).sum(axis=2)) @ weights[:n] + weights[n] + q @ weights[n + 1 :]
            yield g.assign(value=out)[["cell_x", "cell_y", "value"]]

    return template(df, cell, margin).mapInPandas(evaluate, "cell_x long, cell_y long, value double")


def write_grid(cells: DataFrame, file: str, resolution: float) -> None:
    """An ESRI ASCII grid, a row at a time from the north; whatever the ending, cells without value are -9999."""
    box = cells.agg(*(f(c) for c in ("cell_x", "cell_y") for f in (F.min, F.max))).first()
    if box[0] is None:
        raise ValueError("no cells to write")
    x0, x1, y0, y1 = box
    rows = cells.groupBy("cell_y").agg(F.collect_list(F.struct("cell_x", "value")).alias("row")).orderBy(F.desc("cell_y"))
    with Path(file).open("w") as out:
        out.write(f"ncols {x1 - x0 + 1}\nnrows {y1 - y0 + 1}\nxllcorner {x0 * resolution}\nyllcorner {y0 * resolution}\ncellsize {resolution}\nNODATA_value {NO_DATA}\n")
        y = y1
        for r in rows.toLocalIterator():
            while y > r["cell_y"]:
                out.write(" ".join([str(NO_DATA)] * (x1 - x0 + 1)) + "\n")
                y -= 1
            line = [str(NO_DATA)] * (x1 - x0 + 1)
            for c in r["row"]:
                line[c["cell_x"] - x0] = repr(c["value"])
            out.write(" ".join(line) + "\n")
            y -= 1


def write_mean(df: DataFrame, file: str, resolution: float = 5, column: str | None = None) -> None:
    write_grid(cell_means(df, resolution, column), file, resolution)


__all__ = ["cell_means", "interpolate", "spline", "template", "write_grid", "write_mean"]
