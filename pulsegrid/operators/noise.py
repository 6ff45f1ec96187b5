"""Noise labelling of pulses: reason bits from signal, height, error fields, and the surroundings of each point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.quantiles import keyed_few
from pulsegrid.operators.spatial import knn_whole
from pulsegrid.operators.statistics import MAD_TO_SIGMA, cell_median_mad, cells, finite, quantile_values

# Names and bits of the reasons.
REASONS = {
    "low_snr_hard": 1,
    "low_snr_and_low_amp": 2,
    "below_refh_threshold": 4,
    "local_height_outlier": 8,
    "open3d_sor_outlier": 16,
    "global_z_percentile_guard": 32,
    "refh_error_exceeds_threshold": 64,
    "refh_horizontal_error_exceeds_threshold": 128,
}


@dataclass(frozen=True)
class NoiseOptions:
    """Limits of each rule; a rule is off where its limit is None."""

    snr_hard: float | None = 1.5
    snr_soft: float = 1.8
    low_amp_share: float = 0.05
    soft_needs_low_amp: bool = True
    threshold_margin: float | None = 0.0
    error: float | None = None
    horizontal_error: float | None = None
    height_shares: tuple[float, float] | None = None
    cell: float | None = 5.0
    least_in_cell: int = 12
    residual: float = 25.0
    mad_multiple: float = 8.0
    least_sigma: float = 0.75
    neighbours: int | None = None
    neighbour_ratio: float = 2.5


def label_noise(points: DataFrame, options: NoiseOptions = NoiseOptions(), id_column: str = "pulse_index", height: str = "refh", snr: str = "snr", amp: str = "amp", threshold: str = "thres", error: str = "refh_error", horizontal: tuple[str, ...] = ("refh_longitude_error", "refh_latitude_error")) -> DataFrame:
    """points with local_median, local_mad, reason (bits) and keep. Columns that points lack switch their rules off.

    A comparison with a null or NaN raises no bit. Repeated rows are labelled alike; an empty table stays empty.
    """
    has = set(points.columns)
    bits: list[Column] = []

    def bit(name: str, holds: Column) -> None:
        bits.append(F.when(holds, F.lit(REASONS[name])).otherwise(F.lit(0)))

    out = points
    if options.snr_hard is not None and snr in has:
        bit("low_snr_hard", finite(snr) < options.snr_hard)
        if amp in has:
            soft = finite(snr) < options.snr_soft
            if options.soft_needs_low_amp:
                (dark,) = quantile_values(points, amp, [options.low_amp_share])
                soft = soft & (finite(amp) < F.lit(dark).cast("double"))
            bit("low_snr_and_low_amp", soft)
    if options.threshold_margin is not None and {amp, threshold} <= has:
        bit("below_refh_threshold", finite(amp) - finite(threshold) <= options.threshold_margin)
    if options.error is not None and error in has:
        bit("refh_error_exceeds_threshold", finite(error) > options.error)
    if options.horizontal_error is not None:
        beyond = [F.coalesce(F.abs(finite(c)) > options.horizontal_error, F.lit(False)) for c in horizontal if c in has]
        if beyond:
            bit("refh_horizontal_error_exceeds_threshold", F.greatest(*beyond, F.lit(False)))
    if options.height_shares is not None:
        low, high = (F.lit(q).cast("double") for q in quantile_values(points, height, list(options.height_shares)))
        bit("global_z_percentile_guard", (finite(height) < low) | (finite(height) > high))
    none = F.lit(None).cast("double")
    if options.cell is None:
        out = out.withColumn("local_median", none).withColumn("local_mad", none)
    else:
        local = cell_median_mad(points, height, options.cell, options.least_in_cell).select("ix", "iy", F.col("med").alias("local_median"), F.col("mad").alias("local_mad"))
        out = keyed_few(cells(out, options.cell), local, ["ix", "iy"]).drop("ix", "iy")  # few cells: no row of points is shuffled
        limit = F.greatest(F.lit(options.residual), options.mad_multiple * F.greatest(MAD_TO_SIGMA * F.col("local_mad"), F.lit(options.least_sigma)))
        bit("local_height_outlier", F.abs(finite(height) - F.col("local_median")) > limit)
    if options.neighbours is not None:
        far = statistical_outliers(points, options.neighbours, options.neighbour_ratio, id_column, ("x", "y", height)).where("outlier").select(F.col(id_column).alias("_id")).distinct()
        out = out.join(far, F.col(id_column) == F.col("_id"), "left")
        bit("open3d_sor_outlier", F.col("_id").isNotNull())
    reason = sum(bits, F.lit(0)).cast("bigint")
    return out.withColumn("reason", reason).withColumn("keep", F.col("reason") == 0).drop("_id")


def statistical_outliers(points: DataFrame, neighbours: int = 20, ratio: float = 2.5, id_column: str = "pulse_index", axes: tuple[str, ...] = ("x", "y", "refh"), radius: float = 5.0) -> DataFrame:
    """(id, mean_dist, outlier): a point is one where the mean distance to its ``neighbours`` nearest, itself included, is
    not below the mean of all points by ``ratio`` deviations. The nearest are exact however far they lie; ``radius`` is only the
    first that is tried. Points without coordinates are left out."""
    own = points.select(id_column, *[finite(a).alias(a) for a in axes]).dropna()
    near = knn_whole(own, own, neighbours, id_column, id_column, axes, radius)
    mean = near.groupBy(id_column).agg(F.avg("dist").alias("mean_dist"))
    limit = mean.where("mean_dist > 0").agg((F.avg("mean_dist") + ratio * F.stddev_samp("mean_dist")).alias("limit"))
    return mean.join(F.broadcast(limit)).select(id_column, "mean_dist", (~((F.col("mean_dist") > 0) & (F.col("mean_dist") < F.col("limit")))).alias("outlier"))


def reason_counts(labelled: DataFrame) -> DataFrame:
    """(name, bit, hits) of every reason, those without a hit included."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(b).cast("bigint").alias("bit"), F.col("reason").bitwiseAND(F.lit(b)).alias("hit")) for name, b in REASONS.items()])).alias("r")
    return labelled.select(each).groupBy("r.name", "r.bit").agg(F.count_if(F.col("r.hit") != 0).alias("hits"))
