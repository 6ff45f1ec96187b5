"""Classification of points by height over ground: modes, guards and noise rules with their reasons.

``classify`` decides in steps. A step sees the class and reason so far and may move some points to another; the steps
are columns of one projection, so the whole cascade is one stage. Nulls and NaN fail every comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.graph import counted
from pulsegrid.operators.quantiles import BROADCAST_ROWS
from pulsegrid.operators.spatial import idw
from pulsegrid.operators.statistics import cells, finite, grid_aggregate, group_robust_z, median_nmad

# Codes of the classes and reasons.
PROCESSED, GROUND, NOISE = 1, 2, 7
REASONS = {
    "unknown": 0,
    "ground_abs_hag_within_tol": 1,
    "unclassified_missing_dtm": 2,
    "noise_below_ground": 3,
    "noise_above_max_hag": 4,
    "processed_unclassified_valid_hag": 5,
    "noise_low_density_pre_ground": 6,
    "processed_negative_hag_allowed": 7,
    "noise_low_density_post_ground": 8,
    "noise_low_density_processed_only": 9,
    "ground_rejected_low_signal_to_processed": 10,
    "ground_rejected_weak_dtm_to_processed": 11,
    "ground_rejected_low_density_to_processed": 12,
    "noise_low_signal_low_density": 13,
    "noise_low_amp_low_density": 14,
    "noise_scanline_hag_outlier": 15,
    "shallow_negative_hag_kept_processed": 16,
    "weak_dtm_shallow_negative_kept_processed": 17,
    "noise_nonfinite_height": 18,
}
MODES = ("height_only", "height_density_pre_ground", "height_density_post_ground", "height_density_processed_only", "height_no_below_noise", "rule_combined_v1")


@dataclass(frozen=True)
class CascadeOptions:
    """Defaults are the values that the classes are published with."""

    mode: str = "rule_combined_v1"
    ground_tolerance: float = 1.5
    above: float = 30.0
    below: float = 0.0
    least_density: float | None = 0.02
    low_density: float = 0.02
    low_snr: float = 2.5
    low_amp_z: float = -1.0
    support_distance: float = 30.0
    near_ground_guard: bool = False
    guard_height: float = 1.5
    support_confidence: bool = False
    signal_density_noise: bool = False
    signal_rule_height: float = 1.0
    scanline_noise: bool = True
    scanline_track: bool = True
    scanline_sweep: bool = False
    scanline_z: tuple[float, float | None] = (35.0, 55.0)
    scanline_height: tuple[float | None, float | None] = (8.0, 15.0)
    scanline_density: float | None = 2.0
    scanline_low_density: bool = False
    scanline_group: int = 30
    shallow: float | None = None
    shallow_low_density: bool = False
    shallow_low_snr: bool = False
    eps: float = 1e-6

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; one of {', '.join(MODES)}")


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _within(c: Column, low: float | None, high: float | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (c >= low)
    if high is not None:
        out = out & (c <= high)
    return _is(out)


def _first(hag: Column, density: Column, has_ground: Column, o: CascadeOptions) -> list[tuple[Column, int, str]]:
    """Conditions of the first step in the order of the mode."""
    near, under, over = _is(F.abs(hag) <= o.ground_tolerance), _is(hag < -o.below), _is(hag > o.above)
    thin = _is(density < o.least_density) if o.least_density is not None else F.lit(False)
    start = [(~has_ground, PROCESSED, "unclassified_missing_dtm"), (hag.isNull(), NOISE, "noise_nonfinite_height")]
    ground, below, above = (near, GROUND, "ground_abs_hag_within_tol"), (under, NOISE, "noise_below_ground"), (over, NOISE, "noise_above_max_hag")
    rest = (F.lit(True), PROCESSED, "processed_unclassified_valid_hag")
    if o.mode == "height_only":
        return [*start, ground, below, above, rest]
    if o.mode == "height_density_pre_ground":
        return [*start, (thin, NOISE, "noise_low_density_pre_ground"), ground, below, above, rest]
    if o.mode == "height_density_post_ground":
        return [*start, ground, (thin, NOISE, "noise_low_density_post_ground"), below, above, rest]
    if o.mode == "height_no_below_noise":
        return [*start, ground, above, (_is(hag < 0), PROCESSED, "processed_negative_hag_allowed"), rest]
    return [*start, ground, below, above, (thin, NOISE, "noise_low_density_processed_only"), rest]


def classify(points: DataFrame, options: CascadeOptions = CascadeOptions(), height: str = "refh", ground: str = "ground", density: str = "density", snr: str = "snr", amp: str = "amp", track: str = "track_num", sweep: str = "sweep_num", support: str = "support_dist") -> DataFrame:
    """points with hag, class and reason (code). ground is null where no ground is known; columns that points lack switch their rules off.

    hag is rounded to a billionth, so that a height on a limit is on it however the ground was interpolated."""
    o, has = options, set(points.columns)
    missing = F.lit(None).cast("double")
    field = lambda c: finite(c) if c in has else missing
    out = points.withColumn("hag", F.round(finite(height) - finite(ground), 9))
    if o.scanline_noise or o.signal_density_noise:
        out, _ = counted(out)  # what follows reads its columns for each statistic
    base = out
    low_amp = F.lit(False)
    if amp in has and o.signal_density_noise:
        med, nmad = median_nmad(base, amp, o.eps)
        low_amp = _is((finite(amp) - F.lit(med).cast("double")) / F.lit(nmad).cast("double") <= o.low_amp_z)
    # what the rules ask of a row alone is answered before rows are dealt by sweep, so that no measured value need go along
    out = out.withColumns({"_grounded": finite(ground).isNotNull(), "_low_amp": low_amp, "_low_snr": _is(field(snr) <= o.low_snr), "_weak": _is(field(support) > o.support_distance)})
    low_amp, low_snr, weak = F.col("_low_amp"), F.col("_low_snr"), F.col("_weak")
    scan = [(c, z) for c, z, on in ((sweep, "_sweep_z", o.scanline_sweep), (track, "_track_z", o.scanline_track)) if on and c in has and o.scanline_noise]
    for c, z in scan:  # tracks last: they are few, and their figures are sent to the rows
        out = group_robust_z(out, "hag", c, z, o.scanline_group, o.eps, base)
    hag, dense = F.col("hag"), field(density)
    low_density = _is(dense < o.low_density)

    def step(df: DataFrame, rules: list[tuple[Column, int, str]], last: bool = False) -> DataFrame:
        state = lambda kind, name: F.struct(F.lit(kind).alias("class"), F.lit(REASONS[name]).alias("reason"))
        chosen = F.when(rules[0][0], state(*rules[0][1:]))
        for condition, kind, name in rules[1:]:
            chosen = chosen.when(condition, state(kind, name))
        return df.withColumn("_s", chosen if last else chosen.otherwise(F.col("_s")))

    kind, code = F.col("_s.class"), F.col("_s.reason")
    out = step(out, _first(hag, dense, F.col("_grounded"), o), last=True)
    if o.near_ground_guard:
        close = (kind == GROUND) & _is(F.abs(hag) <= o.guard_height)
        out = step(out, [(close & low_snr, PROCESSED, "ground_rejected_low_signal_to_processed"), (close & weak, PROCESSED, "ground_rejected_weak_dtm_to_processed"), (close & low_density, PROCESSED, "ground_rejected_low_density_to_processed")])
    if o.support_confidence:
        out = step(out, [((kind == GROUND) & weak, PROCESSED, "ground_rejected_weak_dtm_to_processed")])
    if o.signal_density_noise:
        poor = (kind == PROCESSED) & _is(F.abs(hag) >= o.signal_rule_height) & low_density
        out = step(out, [(poor & low_snr, NOISE, "noise_low_signal_low_density"), (poor & low_amp, NOISE, "noise_low_amp_low_density")])
    if scan:
        odd = F.lit(False)
        for _, z in scan:
            odd = odd | _within(F.col(z), *o.scanline_z)
        odd = odd & (kind == PROCESSED) & _within(hag, *o.scanline_height) & _within(dense, o.scanline_density, None)
        out = step(out, [(odd & low_density if o.scanline_low_density else odd, NOISE, "noise_scanline_hag_outlier")])
    if o.shallow is not None:
        shallow = (kind == NOISE) & (code == REASONS["noise_below_ground"]) & _is((hag < 0) & (F.abs(hag) <= o.shallow))
        if o.shallow_low_density or density in has:
            shallow = shallow & (low_density if o.shallow_low_density else ~low_density)
        if o.shallow_low_snr or snr in has:
            shallow = shallow & (low_snr if o.shallow_low_snr else ~low_snr)
        out = step(out, [(shallow & weak, PROCESSED, "weak_dtm_shallow_negative_kept_processed"), (shallow, PROCESSED, "shallow_negative_hag_kept_processed")])
    return out.withColumn("class", kind).withColumn("reason", code).drop("_s", "_track_z", "_sweep_z", "_grounded", "_low_amp", "_low_snr", "_weak")


def first_class(height: Column, ground: Column, density: Column, options: CascadeOptions) -> Column:
    """Class by the first step of the mode alone, as a column of a row's own values."""
    return class_above_ground(finite(height) - finite(ground), density, finite(ground).isNotNull(), options)


def class_above_ground(hag: Column, density: Column, has_ground: Column, options: CascadeOptions) -> Column:
    """As ``first_class``, of the height above ground (null without either), density,
    and whether ground is known. The arguments stand in every rule, so they should be columns of the row and no long expressions."""
    rules = _first(hag, finite(density), has_ground, options)
    chosen = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, kind, _ in rules[1:]:
        chosen = chosen.when(condition, F.lit(kind))
    return chosen


def ground_grid(points: DataFrame, cell: float = 15.0, share: float = 0.02, least_snr: float = 5.0, least: int = 1, height: str = "refh", snr: str = "snr", by: tuple[str, ...] = ()) -> DataFrame:
    """(ix, iy, z, n) of the cells: a low quantile of the heights of strong points. With ``by``, of the cells of each file or the like."""
    strong = points.where(finite(snr) >= least_snr)
    if by:
        own = cells(strong.withColumn("_v", finite(height)), cell).where("_v IS NOT NULL AND ix IS NOT NULL AND iy IS NOT NULL")
        found = own.groupBy(*by, "ix", "iy").agg(F.count("_v").alias("n"), F.percentile("_v", F.lit(float(share))).alias("z"))
        return found.where(F.col("n") >= least).select(*by, "ix", "iy", "z", "n")
    return grid_aggregate(strong, height, cell, [share], least).select("ix", "iy", F.col("p0").alias("z"), "n")


def with_cell_ground(points: DataFrame, cell: float = 15.0, share: float = 0.02, least_snr: float = 5.0, height: str = "refh", snr: str = "snr") -> DataFrame:
    """points with ground and n of their own cell (ix, iy) as by ``ground_grid``, null where it has none: one shuffle of the points in
    place of a grid that is joined with them."""
    strong = F.when(finite(snr) >= least_snr, finite(height))
    own = Window.partitionBy("ix", "iy")
    met = cells(points, cell).withColumn("ground", F.percentile(strong, F.lit(float(share))).over(own)).withColumn("n", F.count(strong).over(own))
    placed = F.col("ix").isNotNull() & F.col("iy").isNotNull()
    return met.withColumn("ground", F.when(placed, F.col("ground"))).withColumn("n", F.when(placed & (F.col("n") > 0), F.col("n")))


def sample_ground(points: DataFrame, grid: DataFrame, cell: float = 15.0, k: int = 12, power: float = 2.0, radius: float = 30.0, id_column: str = "pulse_index", by: tuple[str, ...] = ()) -> DataFrame:
    """points with ground: of their own cell, else by inverse distance from the cells around, else null. The grid is written; a large one meets
    the points in a shuffle, and is not left to be broadcast by the driver. Where all points have ground in their cell, that is all."""
    own, n = counted(grid.select(*by, "ix", "iy", "z"))
    keyed = cells(points, cell).join(F.broadcast(own) if n <= BROADCAST_ROWS else own.hint("merge"), [*by, "ix", "iy"], "left")
    lone, rest = counted(keyed.where("z IS NULL AND ix IS NOT NULL AND iy IS NOT NULL").select(id_column, *by, "x", "y"))
    if not rest:
        return keyed.withColumn("ground", F.col("z")).drop("ix", "iy", "z")
    centred = own.select(*by, F.struct("ix", "iy").alias("cell_id"), ((F.col("ix") + 0.5) * cell).alias("x"), ((F.col("iy") + 0.5) * cell).alias("y"), "z")
    blend = idw(lone, centred, "z", k, power, radius, id_column, "cell_id", by=by).select(F.col(id_column).alias("_id"), F.col("value").alias("_v"))
    blend = F.broadcast(blend) if rest <= BROADCAST_ROWS else blend.hint("merge")
    return keyed.join(blend, F.col(id_column) == F.col("_id"), "left").withColumn("ground", F.coalesce("z", "_v")).drop("ix", "iy", "z", "_id", "_v")
