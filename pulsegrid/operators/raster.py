"""Sparse rasters (ix, iy, value): filling, holes, and the point-to-surface pipelines."""

from __future__ import annotations

from functools import reduce
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.classify import sample_ground
from pulsegrid.operators.graph import components, counted

#: Width in cells of the tiles that neighbouring cells are dealt by.
TILE = 128


def grid(points: DataFrame, value: str, cell: float, p: float, least: int = 1) -> DataFrame:
    """Percentile p of value and count per cell."""
    keyed = points.select(F.floor(F.col("x") / cell).cast("bigint").alias("ix"), F.floor(F.col("y") / cell).cast("bigint").alias("iy"), F.col(value).alias("v"))
    return keyed.groupBy("ix", "iy").agg(F.percentile("v", F.lit(p)).alias("z"), F.count("*").alias("n")).where(F.col("n") >= least)


def _disk(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def _spread(cells: DataFrame, radius: int) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in _disk(radius)])
    return cells.select("ix", "iy", F.explode(offsets).alias("o")).select((F.col("ix") + F.col("o.a")).alias("ix"), (F.col("iy") + F.col("o.b")).alias("iy"))


def _tiled(cells: DataFrame) -> DataFrame:
    """cells dealt by tiles of TILE cells' width, so that copies of neighbours meet in their task, before a shuffle."""
    return cells.repartition(F.floor(F.col("ix") / TILE), F.floor(F.col("iy") / TILE))


def dilated(cells: DataFrame, radius: int = 1) -> DataFrame:
    return _spread(_tiled(cells.select("ix", "iy")), radius).distinct()


def closed(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Dilation, then the cells whose whole disk is in it."""
    return _spread(_tiled(dilated(cells, radius)), radius).groupBy("ix", "iy").agg(F.count("*").alias("n")).where(F.col("n") == len(_disk(radius))).select("ix", "iy")


def _holes(runs: DataFrame) -> DataFrame:
    """Background (iy, a, b), runs of a row, that no path over sides leads out of. runs (iy, a, b) share no cell.

    The gaps between the runs of a row are the nodes, gaps of neighbouring rows that overlap are linked, and a gap is open
    where the row above or below ends short of it. Components of gaps without an open one are holes. Nothing is made of the
    background outside the rows, and depth costs a logarithm of rounds. Gaps may be many, so none of the joins is left to be broadcast.
    """
    row = Window.partitionBy("iy").orderBy("a")
    gaps = runs.withColumn("to", F.lead("a").over(row)).where("to > b + 1").select("iy", (F.col("b") + 1).alias("a"), (F.col("to") - 1).alias("b"))
    gaps, n = counted(gaps.withColumn("id", F.col("iy") * F.lit(2**32) + F.col("a")))
    if not n:
        return gaps.drop("id")
    spans = runs.groupBy("iy").agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    sides = gaps.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("ny", F.col("iy") + F.col("side"))
    beside = sides.join(spans.withColumnRenamed("iy", "sy").hint("merge"), F.col("ny") == F.col("sy"), "left")
    open_ = beside.where("sy IS NULL OR a < lo OR b > hi").select("id").distinct()
    tiles = gaps.withColumn("tile", F.explode(F.expr("sequence(a div 64, b div 64)")))
    other = tiles.select(F.col("id").alias("id2"), (F.col("iy") - 1).alias("iy"), "tile", F.col("a").alias("a2"), F.col("b").alias("b2"))
    links = tiles.join(other.hint("merge"), ["iy", "tile"]).where("a <= b2 AND a2 <= b").select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
    named = components(links)
    own_name = gaps.select("id").join(named.hint("merge"), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
    leaking = own_name.join(open_.hint("merge"), "id").select("component").distinct()
    closed_ = own_name.join(leaking.hint("merge"), "component", "left_anti").select("id")
    return gaps.join(closed_.hint("merge"), "id", "left_semi").drop("id")


def without_holes(cells: DataFrame) -> DataFrame:
    """Cells and the background that no path over sides leads out of."""
    own = cells.select("ix", "iy").distinct()
    holes = _holes(own.select("iy", F.col("ix").alias("a"), F.col("ix").alias("b")))
    return own.unionByName(holes.select(F.explode(F.expr("sequence(a, b)")).alias("ix"), "iy"))


# --------------------------------------------------------------------------- tiles as arrays


def _width(halo: int) -> int:
    """Width of the tiles for a halo: wide ones where it is, so that there are less than twice as many copies as cells."""
    return max(TILE, 8 * halo)


def _over(width: int, halo: int, low: str, high: str | None = None):
    """Numbers of the tiles that hold the cells from low to high, or have them in their halo."""
    return F.sequence(F.floor((F.col(low) - halo) / width).cast("bigint"), F.floor((F.col(high or low) + halo) / width).cast("bigint"))


def _haloed(cells: DataFrame, width: int, halo: int) -> DataFrame:
    return cells.withColumn("tx", F.explode(_over(width, halo, "ix"))).withColumn("ty", F.explode(_over(width, halo, "iy")))


def _arrays(table: pa.Table, x0: int, y0: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, where there are cells, and where these have a value, as dense arrays from (x0, y0)."""
    z, held = np.full((side, side), np.nan), np.zeros((side, side), bool)
    at = table.column("ix").to_numpy() - x0, table.column("iy").to_numpy() - y0
    z[at], held[at] = table.column("z").to_numpy(), True
    return z, held, held & ~np.isnan(z)


def _inner(found: np.ndarray, halo: int, x0: int, y0: int) -> tuple[tuple[np.ndarray, np.ndarray], dict[str, np.ndarray]]:
    """Places in the arrays, and the cells, of what is found in the tile itself."""
    i, j = np.nonzero(found[halo : len(found) - halo, halo : len(found) - halo])
    return (i + halo, j + halo), {"ix": i + halo + x0, "iy": j + halo + y0}


def _moved(a: np.ndarray, di: int, dj: int, empty) -> np.ndarray:
    """The value di and dj cells on, for each cell; empty beyond the array."""
    out = np.full_like(a, empty)
    n, m = a.shape
    out[max(0, -di) : n - max(0, di), max(0, -dj) : m - max(0, dj)] = a[max(0, di) : n - max(0, -di), max(0, dj) : m - max(0, -dj)]
    return out


def _closed_array(held: np.ndarray, buffer: int, closing: int) -> np.ndarray:
    """held dilated by a disk, then closed by another."""
    for radius, join, empty in ((buffer, np.logical_or, False), (closing, np.logical_or, False), (closing, np.logical_and, False)):
        held = reduce(join, [_moved(held, a, b, empty) for a, b in _disk(radius)])
    return held


def _steps(cell: float, radius: float) -> list[tuple[int, int]]:
    """Offsets of the cells within radius, the nearest first; of equal distances the smaller (ix, iy)."""
    reach = int(radius / cell + 1e-9)
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= (radius / cell) ** 2 * (1 + 1e-12)]
    return sorted(steps, key=lambda o: (o[0] * o[0] + o[1] * o[1], o))


def _nearest(x: np.ndarray, y: np.ndarray, z: np.ndarray, held: np.ndarray, steps: list[tuple[int, int]], cell: float, k: int, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, distance of the nearest, and mean by inverse distance of the k first held cells over the steps from the places (x, y);
    places at least as far from the array's edges as the steps reach."""
    n, total, weights, nearest = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x)), np.full(len(x), np.nan)
    open_ = np.arange(len(x))
    for a, b in steps:
        if not len(open_):
            break
        i, j = x[open_] + a, y[open_] + b
        hit = held[i, j]
        if hit.any():
            some, dist = open_[hit], cell * (a * a + b * b) ** 0.5
            weight = 1 / max(dist, 1e-12) ** power
            nearest[some[n[some] == 0]] = dist
            n[some] += 1
            total[some] += weight * z[i, j][hit]
            weights[some] += weight
            open_ = open_[n[open_] < k]
    with np.errstate(invalid="ignore"):
        return n, nearest, total / weights


def _smoothed_array(z: np.ndarray, held: np.ndarray, kernel: list[float]) -> np.ndarray:
    half = len(kernel) // 2
    top, weight = np.where(held, z, 0.0), held.astype(float)
    for axis in (0, 1):  # the kernel is separable: two short passes in place of a square
        top, weight = (sum(w * _moved(a, (k - half) * (axis == 0), (k - half) * (axis == 1), 0.0) for k, w in enumerate(kernel)) for a in (top, weight))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(held, top / weight, np.nan)


def _opened_array(z: np.ndarray, held: np.ndarray, window: int) -> np.ndarray:
    """As ``opened``: each pass goes over cells that are there."""
    half, out = window // 2, z
    for pick, empty in ((np.minimum, np.inf), (np.maximum, -np.inf)):
        for axis in (0, 1):
            own = np.where(held, out, empty)
            out = reduce(pick, [_moved(own, k * (axis == 0), k * (axis == 1), empty) for k in range(-half, half + 1)])
    return out


def _progressive_array(z: np.ndarray, held: np.ndarray, stages: list[tuple[int, float]]) -> np.ndarray:
    for window, threshold in stages:
        low = _opened_array(z, held, window)
        with np.errstate(invalid="ignore"):
            z = np.where(held & (z - low > threshold), low, z)
    return z


def _kernel(sigma: float, reach: float) -> list[float]:
    n = int(reach * sigma + 0.5)
    return [exp(-0.5 * (k / sigma) ** 2) for k in range(-n, n + 1)]


def _by_tiles(cells: DataFrame, halo: int, change) -> DataFrame:
    """Cells (ix, iy, z) with z changed by a function of a dense array and where it holds values, which looks at most halo cells far.
    Cells meet by tiles, copies of those near its edge also in the tiles beside: one shuffle, whatever the function does. Cells without a value keep none."""
    width = _width(halo)

    def run(table: pa.Table) -> pa.Table:
        x0, y0 = table.column("tx")[0].as_py() * width - halo, table.column("ty")[0].as_py() * width - halo
        z, held, known = _arrays(table, x0, y0, width + 2 * halo)
        at, cells_ = _inner(held, halo, x0, y0)
        return pa.table(cells_ | {"z": pa.array(np.where(known, change(z, known), np.nan)[at], from_pandas=True)})

    own = cells.select("ix", "iy", F.col("z").cast("double").alias("z"))
    return _haloed(own, width, halo).groupBy("tx", "ty").applyInArrow(run, "ix bigint, iy bigint, z double")


def _blended(wanted: DataFrame, known: DataFrame, cell: float, radius: float, k: int, power: float, others: bool = False) -> DataFrame:
    """For each wanted cell (given once) that has a known one within radius: n (k at most), dist of the nearest, and z, the mean of the k
    nearest by inverse distance; of equal distances the smaller (ix, iy) counts first. With ``others``, wanted cells that are known are left out.

    Cells meet by tiles of ``TILE`` cells' width, known ones also in the tiles within reach. A tile is a dense array of bounded
    size, over which one offset after another is looked up, so no pair of cells is a row."""
    halo, steps, width = int(radius / cell + 1e-9), _steps(cell, radius), TILE
    own = wanted.select("ix", "iy", *[F.floor(F.col(c) / width).cast("bigint").alias(t) for c, t in (("ix", "tx"), ("iy", "ty"))])
    near = _haloed(known.select("ix", "iy", F.col("z").cast("double").alias("z")), width, halo)

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (left.column(c).to_numpy() for c in ("ix", "iy"))
        x0, y0 = (left.column(c)[0].as_py() * width - halo if len(x) else 0 for c in ("tx", "ty"))
        z, held, _ = _arrays(right, x0, y0, width + 2 * halo) if len(x) else (np.zeros((1, 1)), np.zeros((1, 1), bool), None)
        if others:
            far = ~held[x - x0, y - y0]
            x, y = x[far], y[far]
        n, nearest, mean = _nearest(x - x0, y - y0, z, held, steps, cell, k, power)
        out = n > 0
        return pa.table({"ix": x[out], "iy": y[out], "n": n[out], "dist": nearest[out], "z": mean[out]})

    return own.groupBy("tx", "ty").cogroup(near.groupBy("tx", "ty")).applyInArrow(fill, "ix bigint, iy bigint, n bigint, dist double, z double")


def filled_nearest(known: DataFrame, wanted: DataFrame, cell: float, radius: float) -> DataFrame:
    """Value of the nearest known cell within radius for each wanted cell (given once); ties go to the smaller (ix, iy)."""
    return _blended(wanted, known, cell, radius, 1, 0.0).select("ix", "iy", "z", "dist")


def filled_idw(known: DataFrame, wanted: DataFrame, cell: float, k: int = 12, power: float = 2.0, radius: float = 30.0, least: int = 1) -> DataFrame:
    """Known cells, and wanted ones by inverse distance; source 1 is a known cell, 2 a filled one."""
    near = _blended(wanted, known, cell, radius, k, power, others=True).where(F.col("n") >= least)
    return known.select("ix", "iy", "z", F.lit(1).alias("source")).unionByName(near.select("ix", "iy", "z", F.lit(2).alias("source")))


def surface(points: DataFrame, cell: float = 2.0, p: float = 0.95, radius: float = 8.0, closing: int = 2, k: int = 12, power: float = 2.0) -> DataFrame:
    """Surface model: observed cells (source 1), and by inverse distance the gaps inside their closing (source 2). Closing and filling meet
    in one array a tile, so that nothing but the points and their cells is shuffled."""
    steps = _steps(cell, radius)
    halo = max(2 * closing, int(radius / cell + 1e-9))
    width = _width(halo)

    def run(table: pa.Table) -> pa.Table:
        x0, y0 = table.column("tx")[0].as_py() * width - halo, table.column("ty")[0].as_py() * width - halo
        z, held, _ = _arrays(table, x0, y0, width + 2 * halo)
        (x, y), own = _inner(held, halo, x0, y0)
        (i, j), gaps = _inner(_closed_array(held, 0, closing) & ~held, halo, x0, y0)
        n, _, mean = _nearest(i, j, z, held, steps, cell, k, power)
        out = n > 0
        values = np.concatenate([z[x, y], mean[out]])
        return pa.table({c: np.concatenate([own[c], gaps[c][out]]) for c in ("ix", "iy")} | {"z": pa.array(values, from_pandas=True), "source": np.repeat(np.int32([1, 2]), [len(x), out.sum()])})

    return _haloed(grid(points, "refh", cell, p).select("ix", "iy", "z"), width, halo).groupBy("tx", "ty").applyInArrow(run, "ix bigint, iy bigint, z double, source int")


def opened(cells: DataFrame, window: int) -> DataFrame:
    """Cells (ix, iy, z) with o, the greyscale opening by a square of ``window`` (odd) cells; beyond the cells nothing counts."""
    half = window // 2

    def along(line: str, axis: str):
        return Window.partitionBy(line).orderBy(axis).rangeBetween(-half, half)

    low = cells.withColumn("_e", F.min("z").over(along("iy", "ix"))).withColumn("_e", F.min("_e").over(along("ix", "iy")))
    return low.withColumn("_o", F.max("_e").over(along("iy", "ix"))).withColumn("o", F.max("_o").over(along("ix", "iy"))).drop("_e", "_o")


def smoothed(cells: DataFrame, sigma: float, reach: float = 4.0) -> DataFrame:
    """Cells (ix, iy, z) with z as the Gaussian mean of the cells around, normalised by the weights that are there."""
    if sigma <= 0:
        return cells
    kernel = _kernel(sigma, reach)
    return _by_tiles(cells, len(kernel) // 2, lambda z, held: _smoothed_array(z, held, kernel))


def windows_of(sizes: list[float], cell: float, base: float, slope: float, most: float) -> list[tuple[int, float]]:
    """Odd window in cells and height threshold of each stage; thresholds grow with the window up to ``most``."""
    found = []
    for size in sizes:
        n = max(3, round(size / cell))
        found.append((n + (n % 2 == 0), min(most, base + slope * size)))
    return found


def progressive(cells: DataFrame, stages: list[tuple[int, float]]) -> DataFrame:
    """Cells (ix, iy, z) after one opening after another: where a cell stands above its opening by more than the stage's
    threshold, the opening takes its place."""
    return _by_tiles(cells, _sight(stages), lambda z, held: _progressive_array(z, held, stages))


def _sight(stages: list[tuple[int, float]]) -> int:
    """How many cells far the openings look."""
    return sum(2 * (window // 2) for window, _ in stages)


def _support_runs(cells: DataFrame, buffer: int, closing: int) -> DataFrame:
    """Runs (iy, a, b) in the rows of tiles of the cells dilated by a disk and closed by another."""
    halo = buffer + 2 * closing
    width = _width(halo)

    def run(table: pa.Table) -> pa.Table:
        x0, y0 = table.column("tx")[0].as_py() * width - halo, table.column("ty")[0].as_py() * width - halo
        area = _closed_array(_arrays(table, x0, y0, width + 2 * halo)[1], buffer, closing)[halo : halo + width, halo : halo + width]
        ends = np.diff(np.pad(area.astype(np.int8), ((1, 1), (0, 0))), axis=0)
        (row, a), (_, b) = np.nonzero(ends.T == 1), np.nonzero(ends.T == -1)
        return pa.table({"iy": row + halo + y0, "a": a + halo + x0, "b": b - 1 + halo + x0})

    return _haloed(cells.select("ix", "iy", F.lit(0.0).alias("z")), width, halo).groupBy("tx", "ty").applyInArrow(run, "iy bigint, a bigint, b bigint")


def ground(points: DataFrame, cell: float = 4.0, p: float = 0.1, buffer: int = 1, closing: int = 1, sigma: float = 1.0, sizes: tuple[float, ...] = (12.0, 20.0, 36.0), base: float = 0.5, slope: float = 0.05, most: float = 3.0, radius: float = 60.0) -> DataFrame:
    """Tentative ground (ix, iy, n, z): a low percentile of each cell, filled from the nearest cell inside the support (the cells dilated by a
    disk, closed by another, without holes), smoothed, and opened progressively. n is the cell's point count, 0 where it was filled. Support
    farther than ``radius`` from any cell is left out.

    Only holes are sought over the whole raster, among the gaps between runs of cells. All else looks so many cells far, and is done in one
    array a tile with as wide a halo: no raster is joined with another, so none of them can be sent to the driver as a small one."""
    low, _ = counted(grid(points, "refh", cell, p))
    runs, _ = counted(_support_runs(low, buffer, closing))
    holes, _ = counted(_holes(runs))
    stages, kernel, steps = windows_of(list(sizes), cell, base, slope, most), _kernel(sigma, 4.0) if sigma > 0 else [1.0], _steps(cell, radius)
    reach = int(radius / cell + 1e-9)
    halo = max(reach, buffer + 2 * closing) + len(kernel) // 2 + _sight(stages)
    width = _width(halo)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("ix", "iy", "n", "z")
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "z" else pa.int64()) for c in names})
        side, (x0, y0) = width + 2 * halo, (left.column(c)[0].as_py() * width - halo for c in ("tx", "ty"))
        z, held, known = _arrays(left, x0, y0, side)
        n = np.zeros((side, side), np.int64)
        n[left.column("ix").to_numpy() - x0, left.column("iy").to_numpy() - y0] = left.column("n").to_numpy()
        area = _closed_array(held, buffer, closing)
        for y, a, b in zip(*(right.column(c).to_numpy() for c in ("iy", "a", "b")), strict=True):
            area[max(0, a - x0) : max(0, b - x0 + 1), y - y0] = True
        # cells nearer to the edge than the sight of a look-up count for none of the tile's own
        i, j = (c + reach for c in np.nonzero((area & ~known)[reach : side - reach, reach : side - reach]))
        found, _, mean = _nearest(i, j, z, known, steps, cell, 1, 0.0)
        z[i, j], filled = mean, known.copy()
        filled[i, j] = found > 0
        z = _progressive_array(_smoothed_array(z, filled, kernel), filled, stages)
        at, cells_ = _inner(filled, halo, x0, y0)
        return pa.table(cells_ | {"n": n[at], "z": z[at]})

    near = holes.withColumn("tx", F.explode(_over(width, halo, "a", "b"))).withColumn("ty", F.explode(_over(width, halo, "iy")))
    return _haloed(low, width, halo).groupBy("tx", "ty").cogroup(near.groupBy("tx", "ty")).applyInArrow(run, "ix bigint, iy bigint, n bigint, z double")


def classified(points: DataFrame, cell: float = 4.0, tolerance: float = 1.0, top: float = 30.0, id_column: str = "pulse_index") -> DataFrame:
    """Height over the tentative ground and class of each point; the ground of cells without one comes by inverse distance."""
    base = ground(points, cell).select("ix", "iy", "z")
    own = sample_ground(points, base, cell, 12, 2.0, 30.0, id_column).withColumn("hag", F.col("refh") - F.col("ground"))
    kind = F.when(F.col("hag").isNull(), 1).when(F.abs("hag") <= tolerance, 2).when((F.col("hag") > top) | (F.col("hag") < -2), 7).otherwise(1)
    return own.select(id_column, "hag", kind.alias("class"))
