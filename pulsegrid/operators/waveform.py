"""Waveform operators over an array column, one Arrow batch at a time over its flat value buffer.

A waveform is a row with an array of samples; null, NaN and infinite samples are gaps. What looks for peaks works inside the
runs of finite samples: no peak, base, width or resampled value reaches over a gap, and the ends of a run are no peaks. A
null or empty array gives no rows where rows are peaks, and a row with a status where there is one row a waveform. Keys and
other columns travel beside the samples and are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import kernels
from pulsegrid.operators.lineage import cut
from pulsegrid.operators.ordered import Ordered
from pulsegrid.operators.quantiles import finite, keyed

ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


def per_waveform(df: DataFrame, keys: str | Sequence[str], column: str, schema: str, compute: Callable[..., list[dict]], beside: Sequence[str] = (), empty: bool = False) -> DataFrame:
    """Rows (*keys, *schema) that compute(samples, *beside) makes of each array, gaps as NaN. ``beside`` are columns that compute gets
    as floats, NaN for null. Null and empty arrays are only given with ``empty``, as no samples."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kinds = [ARROW[part.strip().split(" ", 1)[1]] for part in schema.split(",")]
    packed = df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key"), F.col(column).cast("array<double>").alias("v"), *[F.col(f"`{b}`").cast("double").alias(f"b{i}") for i, b in enumerate(beside)])
    kind = packed.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(1)
            sizes = np.zeros(len(arrays), np.int64)
            held = arrays.is_valid().to_numpy(zero_copy_only=False)
            sizes[held] = np.diff(arrays.offsets.to_numpy())[held]
            flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            flat = np.where(np.isfinite(flat), flat, np.nan)
            ends = np.cumsum(sizes)
            extra = [batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(beside))]
            rows, of = [], []
            for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
                if b > a or empty:
                    made = compute(flat[a:b], *[x[i] for x in extra])
                    rows += made
                    of += [i] * len(made)
            columns = [pa.array([r[n] for r in rows], t, from_pandas=True) for n, t in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], ["key", *names])

    out = packed.mapInArrow(run, f"key {kind}, {schema}")
    return out.select(*[F.col(f"key.`{k}`") for k in keys], *names)


# --------------------------------------------------------------------------- preprocessing and components


@dataclass(frozen=True)
class Preprocess:
    """``background``: raw, minus_bg_mean or minus_refh_thres. ``clip`` sets what is then negative to zero. ``smoothing``: none, median or savgol."""

    background: str = "raw"
    clip: bool = False
    smoothing: str = "none"
    window: int = 7
    order: int = 2

    def __post_init__(self):
        if self.background not in ("raw", "minus_bg_mean", "minus_refh_thres"):
            raise ValueError(f"unknown background mode {self.background!r}")

    def applied(self, v: np.ndarray, mean: float, std: float, threshold: float) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Processed and smoothed samples, the noise scale (background deviation, else NMAD, else deviation, else one) and the offset."""
        offset = {"raw": 0.0, "minus_bg_mean": mean, "minus_refh_thres": threshold}[self.background]
        offset = offset if np.isfinite(offset) else 0.0
        processed = v - offset
        if self.clip:
            processed = np.where(np.isnan(processed), np.nan, np.maximum(processed, 0.0))
        sigma = std if np.isfinite(std) and std > 0 else kernels.robust_sigma(processed)
        return processed, kernels.smooth_runs(processed, self.smoothing, self.window, self.order), float(sigma), float(offset)


BACKGROUND = ("bg_mean", "bg_std", "thres")


def preprocess(df: DataFrame, keys: str | Sequence[str], column: str, options: Preprocess = Preprocess(), background: Sequence[str] = BACKGROUND) -> DataFrame:
    """One row a waveform: keys, valid, sigma, offset, processed, smoothed. Without a finite sample it is not valid and has nulls."""

    def compute(v: np.ndarray, *own: float) -> list[dict]:
        if not np.isfinite(v).any():
            return [dict.fromkeys(("sigma", "offset", "processed", "smoothed")) | {"valid": False}]
        processed, smoothed, sigma, offset = options.applied(v, *own)
        blank = lambda x: [None if y != y else y for y in x.tolist()]
        return [{"valid": True, "sigma": sigma, "offset": offset, "processed": blank(processed), "smoothed": blank(smoothed)}]

    return per_waveform(df, keys, column, "valid boolean, sigma double, offset double, processed array<double>, smoothed array<double>", compute, background, True)


@dataclass(frozen=True)
class Components:
    """Gates of candidate components, in units of the noise scale or in bins; ``most`` is how many of a waveform are kept (None: all)."""

    height: float = 3.0
    prominence: float = 3.0
    width: float = 1.0
    most_width: float | None = None
    distance: int = 3
    edge: int = 0
    most: int | None = None


COMPONENT = "rank bigint, rank_by_amplitude bigint, bin bigint, amplitude_raw double, amplitude double, prominence double, prominence_sigma double, width double, left double, right double, left_base bigint, right_base bigint, width_height double, area double, edge boolean, sigma double, offset double"


def components(df: DataFrame, keys: str | Sequence[str], column: str, options: Components = Components(), before: Preprocess = Preprocess(), background: Sequence[str] = BACKGROUND) -> DataFrame:
    """Candidate components of each waveform, one row each, ranked by prominence (``rank``) and by amplitude among all that pass the
    gates; ties go to the earlier bin. ``area`` is the positive signal between the half-prominence crossings."""
    o = options

    def compute(v: np.ndarray, *own: float) -> list[dict]:
        if not np.isfinite(v).any():
            return []
        processed, smoothed, sigma, offset = before.applied(v, *own)
        found = kernels.find_peaks(smoothed, max(0.0, o.height * sigma), max(0.0, o.prominence * sigma), max(o.width, 0.0), max(1, o.distance), np.inf if o.most_width is None else o.most_width)
        by_amplitude = {p["bin"]: k for k, p in enumerate(sorted(found, key=lambda p: (-processed[p["bin"]], p["bin"])), 1)}
        found.sort(key=lambda p: (-p["prominence"], p["bin"]))
        rows = []
        for rank, p in enumerate(found[: o.most], 1):
            k = p["bin"]
            under = processed[max(0, int(np.floor(p["left"]))) : int(np.ceil(p["right"])) + 1]
            rows.append(p | {"rank": rank, "rank_by_amplitude": by_amplitude[k], "amplitude_raw": v[k], "amplitude": processed[k], "prominence_sigma": p["prominence"] / sigma, "area": float(np.nansum(np.maximum(under, 0.0))), "edge": bool(k < o.edge or k > len(v) - 1 - o.edge), "sigma": sigma, "offset": offset})
        return rows

    return per_waveform(df, keys, column, COMPONENT, compute, background)


@dataclass(frozen=True)
class Roles:
    """Gates of prominent components, stricter than those of candidates."""

    prominence: float = 5.0
    relative: float = 0.2
    separation: float = 8.0
    width: float = 1.0
    most_width: float | None = None
    reject_edge: bool = True


def roles(found: DataFrame, keys: str | Sequence[str], options: Roles = Roles(), edge: int = 0) -> DataFrame:
    """Components with relative (prominence to the main one), separation (bins from it), is_main, is_prominent, is_secondary and
    rejected (reasons joined by ";", empty for prominent ones). The main component has the best rank and is always prominent."""
    keys, o = [keys] if isinstance(keys, str) else list(keys), options
    main = F.min_by(F.struct("bin", "prominence", "rank"), F.col("rank")).over(Window.partitionBy(*keys))  # the few components of a waveform
    own = found.withColumn("_main", main)
    is_main = F.col("rank") == F.col("_main.rank")
    relative = F.col("prominence") / F.when(F.col("_main.prominence") > 0, F.col("_main.prominence"))
    apart = F.abs(F.col("bin") - F.col("_main.bin"))
    reasons = [
        (~F.coalesce(F.col("prominence_sigma") >= o.prominence, F.lit(False)), "low_absolute_prominence"),
        (~is_main & ~F.coalesce(relative >= o.relative, F.lit(False)), "low_relative_prominence_to_main"),
        (~is_main & (apart < o.separation), "too_close_to_main"),
        (F.col("width") < o.width, "too_narrow"),
        (F.col("width") > o.most_width if o.most_width is not None else F.lit(False), "too_wide"),
        (F.col("edge") if o.reject_edge else F.lit(False), f"edge_exclusion_{edge}bins"),
    ]
    said = F.concat_ws(";", *[F.when(holds, F.lit(name)) for holds, name in reasons])
    prominent = is_main | (said == "")
    out = own.withColumn("relative", relative).withColumn("separation", apart).withColumn("is_main", is_main).withColumn("is_prominent", prominent).withColumn("is_secondary", prominent & ~is_main)
    return out.withColumn("rejected", F.when(prominent, F.lit("")).otherwise(said)).drop("_main")


# Reliability classes from best to worst.
RELIABILITY = {"clear_main_peak": 5, "clear_main_with_secondary_candidate": 4, "broad_main_peak": 3, "weak_main_peak": 2, "ambiguous_main_peak": 1, "low_snr_weak_main_peak": 0, "no_detected_main_peak": -1}


def pulse_features(pulses: DataFrame, found: DataFrame, keys: str | Sequence[str], raw_argmax: str, corrected_argmax: str, snr: str, good_snr: str | None = None, broad: float = 30.0, weak: float = 4.0, low_snr: float = 3.0) -> DataFrame:
    """One row a pulse, of its components with roles: counts, main and secondary component, ratios, flags and the reliability class,
    whose order of tests matters. A pulse without components has class no_detected_main_peak."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    part = F.struct("bin", "prominence", "width", "area", "amplitude_raw", "sigma", "is_prominent")
    of = found.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("is_prominent").alias("n_prominent"), F.count_if("is_secondary").alias("n_secondary"), F.min_by(part, "rank").alias("_m"), F.min_by(F.when(F.col("is_secondary"), part), F.when(F.col("is_secondary"), F.col("rank"))).alias("_s"))
    own = keyed(pulses.select(*keys, finite(raw_argmax).alias("_raw"), finite(corrected_argmax).alias("_cor"), finite(snr).alias("_snr"), (F.col(good_snr).cast("boolean") if good_snr else F.lit(None).cast("boolean")).alias("_good")), of, keys)
    low = F.coalesce(~F.col("_good"), F.lit(False)) | F.coalesce(F.col("_snr") < low_snr, F.lit(False))
    sigmas = F.col("_m.prominence") / F.when(F.col("_m.sigma") > 0, F.col("_m.sigma"))
    is_weak = ~F.coalesce(sigmas >= weak, F.lit(False))
    is_broad = F.coalesce(F.col("_m.width") >= broad, F.lit(False))
    clear = F.coalesce(F.col("_m.is_prominent"), F.lit(False)) & ~low
    second = F.col("_s").isNotNull()
    kind = F.when(F.col("_m").isNull(), "no_detected_main_peak").when(low & is_weak, "low_snr_weak_main_peak").when(is_broad, "broad_main_peak").when(second, "clear_main_with_secondary_candidate").when(clear, "clear_main_peak").when(is_weak, "weak_main_peak").otherwise("ambiguous_main_peak")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    ratio = lambda c: F.col(f"_s.{c}") / F.nullif(F.col(f"_m.{c}"), F.lit(0.0))
    out = own.select(
        *keys, zero("n"), zero("n_prominent"), zero("n_secondary"), F.col("_m.bin").alias("main_bin"), F.col("_m.prominence").alias("main_prominence"), F.col("_m.width").alias("main_width"), F.col("_m.area").alias("main_area"), F.col("_s.bin").alias("secondary_bin"),
        ratio("amplitude_raw").alias("amplitude_ratio"), ratio("prominence").alias("prominence_ratio"), F.abs(F.col("_m.bin") - F.col("_raw")).alias("main_from_raw"), F.abs(F.col("_cor") - F.col("_raw")).alias("corrected_from_raw"),
        sigmas.alias("main_sigmas"), clear.alias("has_clear_main"), second.alias("has_secondary"), is_broad.alias("has_broad_main"), is_weak.alias("has_weak_main"), low.alias("low_snr"), kind.alias("reliability"),
    )
    return out


def reliability_number(kind: str | Column) -> Column:
    """Number of a reliability class, higher is better; null for another text."""
    return F.create_map(*[x for k, n in RELIABILITY.items() for x in (F.lit(k), F.lit(n).cast("bigint"))])[F.col(kind) if isinstance(kind, str) else kind]


# --------------------------------------------------------------------------- events and candidates in units of the background


def events(df: DataFrame, keys: str | Sequence[str], column: str, height: float = 8.0, prominence: float = 4.0, distance: int = 5, background: Sequence[str] = BACKGROUND[:2]) -> DataFrame:
    """Peaks of every finite run, in deviations of the background: bin, excess, prominence, width, raw, n_valid. Waveforms with an
    unknown background, or one without deviation, have none."""
    if not height > 0 or not prominence >= 0 or distance < 1:
        raise ValueError("height must be positive, prominence not negative, distance at least one")

    def compute(v: np.ndarray, mean: float, std: float) -> list[dict]:
        if not (np.isfinite(mean) and np.isfinite(std) and std > 0):
            return []
        z = (v - mean) / std
        n = int(np.isfinite(z).sum())
        return [{"bin": p["bin"], "excess": p["amplitude"], "prominence": p["prominence"], "width": p["width"], "raw": v[p["bin"]], "n_valid": n} for p in kernels.find_peaks(z, height, prominence, 0.0, distance)]

    return per_waveform(df, keys, column, "bin bigint, excess double, prominence double, width double, raw double, n_valid bigint", compute, background)


CANDIDATE = "status string, finite_fraction double, detected boolean, bin bigint, height double, prominence double, width double, n_qualified bigint, top_prominence double"


def calibrated(df: DataFrame, keys: str | Sequence[str], column: str, threshold: float, width: float = 2.0, distance: int = 5, least_finite: float = 0.95, background: Sequence[str] = BACKGROUND[:2]) -> DataFrame:
    """One row a pulse: the best peak over a calibrated prominence, by prominence, then width, then the earlier bin. Status is
    invalid_waveform (too few finite samples), invalid_background, no_candidate or candidate."""
    if not threshold > 0 or width < 0:
        raise ValueError("the threshold must be positive and the width not negative")

    def compute(v: np.ndarray, mean: float, std: float) -> list[dict]:
        share = float(np.isfinite(v).mean()) if len(v) else 0.0
        row = dict.fromkeys(("bin", "height", "prominence", "width", "top_prominence")) | {"finite_fraction": share, "detected": False, "n_qualified": 0}
        if not len(v) or share < least_finite:
            return [row | {"status": "invalid_waveform"}]
        if not (np.isfinite(mean) and np.isfinite(std) and std > 0):
            return [row | {"status": "invalid_background"}]
        found = kernels.find_peaks((v - mean) / std, distance=distance)
        top = max((p["prominence"] for p in found), default=None)
        good = [p for p in found if p["amplitude"] > 0 and p["prominence"] >= threshold and p["width"] >= width]
        if not good:
            return [row | {"status": "no_candidate", "top_prominence": top}]
        best = max(good, key=lambda p: (p["prominence"], p["width"], -p["bin"]))
        return [row | {"status": "candidate", "detected": True, "bin": best["bin"], "height": best["amplitude"], "prominence": best["prominence"], "width": best["width"], "n_qualified": len(good), "top_prominence": top}]

    return per_waveform(df, keys, column, CANDIDATE, compute, background, True)


def roi_features(df: DataFrame, members: DataFrame, keys: Sequence[str], column: str, threshold: float, **options) -> DataFrame:
    """As ``calibrated``, for the pulses of a membership table (keys and further columns, which stay); a pulse in several regions has a row for each."""
    once = keyed(df, members.select(*keys).distinct(), list(keys), "left_semi")
    return keyed(members, calibrated(once, keys, column, threshold, **options), list(keys), "inner")


# --------------------------------------------------------------------------- noise calibration


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a counter-based generator: the same numbers at any partitioning."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_ids(replicates: np.ndarray, blocks: int, windows: int, seed: int) -> np.ndarray:
    """Which window stands at each block of each replicate."""
    counter = replicates.astype(np.uint64)[:, None] * np.uint64(blocks) + np.arange(blocks, dtype=np.uint64)[None, :]
    return (_mixed((counter + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) % np.uint64(windows)).astype(np.int64)


def null_maximum(v: np.ndarray, distance: int) -> tuple[float, float]:
    """Prominence and width of the most prominent peak; zeros without one."""
    best = max(kernels.find_peaks(v, distance=distance), key=lambda p: (p["prominence"], -p["bin"]), default=None)
    return (best["prominence"], best["width"]) if best else (0.0, 0.0)


#: Samples of all windows together that go to the tasks.
WINDOW_SAMPLES = 4_000_000


def noise_windows(df: DataFrame, key: str, column: str, length: int, samples: int = WINDOW_SAMPLES) -> DataFrame:
    """Finite background windows of the given length, at most as many as ``samples`` allows, the first in the order of a hash of the key."""
    most = max(1, samples // length)
    own = df.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("w")).where(F.size("w") == length).where(F.forall("w", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return own.orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(most)


def calibrate_noise(windows: DataFrame, length: int, quantile: float = 0.995, distance: int = 5, calibration: int = 10_000, validation: int = 10_000, width: float = 2.0, seed: int = 20261012, parts: int | None = None) -> DataFrame:
    """One row: the prominence that a share ``quantile`` of null waveforms does not reach, and how often validation waveforms do.

    A null waveform of ``length`` bins is made of windows (column w, standardised, from ``noise_windows``) drawn with replacement by a
    counter-based generator, so a task makes its range of replicates alone and only maxima leave it. Validation replicates are
    others than those of the calibration."""
    spark = windows.sparkSession
    held = np.array([r["w"] for r in windows.orderBy("id").collect()], float)  # bounded by WINDOW_SAMPLES
    if not 0.9 <= quantile < 1 or len(held) < 20 or held.shape[1] < 16 or length < held.shape[1]:
        raise ValueError("give at least 20 finite windows of 16 bins or more, a quantile from 0.9 and a length of a window at least")
    blocks = -(-length // held.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows = [null_maximum(held[own].reshape(-1)[:length], distance) for own in block_ids(ids, blocks, len(held), seed)]
            top, wide = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.float64()), pa.array(wide, pa.float64())], ["id", "top", "width"])

    n = parts or spark.sparkContext.defaultParallelism * 4
    maxima = cut(spark.range(0, calibration + validation, 1, n).mapInArrow(run, "id bigint, top double, width double"))
    first = F.col("id") < calibration
    level = maxima.where(first).agg(F.percentile("top", F.lit(quantile)).alias("threshold"))  # one value a replicate
    alarm = (F.col("top") >= F.col("threshold")) & (F.col("width") >= width)
    tested = maxima.where(~first).crossJoin(F.broadcast(level)).agg(F.max("threshold").alias("threshold"), F.count_if(alarm).alias("false_alarms"), F.avg(alarm.cast("double")).alias("false_alarm_rate"), F.percentile("top", F.lit(0.5)).alias("p50"), F.percentile("top", F.lit(0.95)).alias("p95"))
    return tested.select("threshold", F.lit(len(held)).cast("bigint").alias("n_windows"), F.lit(calibration).cast("bigint").alias("n_calibration"), F.lit(validation).cast("bigint").alias("n_validation"), "false_alarms", "false_alarm_rate", "p50", "p95")


# --------------------------------------------------------------------------- bins over sweeps


def bin_scores(df: DataFrame, track: str, sweep: str, column: str, early: int = 1200, threshold: float = 5.0, scene: str = "refh", background: Sequence[str] = BACKGROUND[:2], least_scene: int = 10, least_spread: float = 0.05) -> DataFrame:
    """Of each (track, bin) below ``early``: occupancy with its Wilson interval, counts, lower median of the excess of detections in counts and in
    deviations, early weight, correlation with the track's signal, longest run of sweeps with a detection, and the weighted score.

    Missing samples and unknown backgrounds leave the denominators. Counts and moments are added up map-side; only detections, which
    are few, are shuffled as rows. Sweeps follow each other as they stand in the table, gaps in their numbers aside; a track has at
    most one waveform a sweep."""
    mean, std = (finite(c) for c in background)
    z = f"transform(slice(_rx, 1, {early}), (x, i) -> struct(i AS bin, CAST(x AS DOUBLE) AS x))"
    own = df.select(F.col(track).alias("track"), F.col(sweep).alias("sweep"), F.col(column).alias("_rx"), mean.alias("_m"), F.when(std > 0, std).alias("_s"), finite(scene).alias("_y"))
    order = cut(Ordered(own.select("sweep").distinct(), [], ["sweep"]).running("pos", F.lit(1)).result())
    scenes = own.groupBy("track").agg(F.count("_y").alias("_ny"), F.avg("_y").alias("_ay"), F.stddev_pop("_y").alias("_sy"))
    bins = own.select("track", "sweep", "_m", "_s", "_y", F.inline(F.expr(z)))
    bins = bins.withColumn("raw", finite("x") - F.col("_m")).withColumn("z", F.col("raw") / F.col("_s")).withColumn("hit", F.coalesce(F.col("z") >= threshold, F.lit(False)))
    seen = F.col("_y").isNotNull()
    zy = F.when(seen, F.col("z"))
    totals = bins.groupBy("track", "bin").agg(F.count("z").alias("n_valid"), F.count_if("hit").alias("n_events"), F.count(zy).alias("_n"), F.sum(zy).alias("_sz"), F.sum(zy * zy).alias("_szz"), F.sum(zy * F.col("_y")).alias("_szy"), F.sum(F.when(zy.isNotNull(), F.col("_y"))).alias("_sy1"))
    hits = cut(keyed(bins.where("hit").select("track", "bin", "sweep", "raw", "z"), order, ["sweep"], "inner"))
    lower = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias
    medians = hits.groupBy("track", "bin").agg(lower("z")("median_sigma"), lower("raw")("median_counts"))  # detections of one bin
    runs = Ordered(hits, ["track", "bin"], ["pos"]).running("_i", F.lit(1)).df.groupBy("track", "bin", (F.col("pos") - F.col("_i")).alias("_g")).agg(F.count("*").alias("_c")).groupBy("track", "bin").agg(F.max("_c").alias("longest"))
    met = keyed(keyed(keyed(totals, medians, ["track", "bin"]), runs, ["track", "bin"]), scenes, ["track"])
    n, k = F.greatest(F.col("n_valid"), F.lit(1)), F.col("n_events")
    p, q = k / n, 1.959963984540054
    bottom = 1 + q * q / n
    centre, half = (p + q * q / (2 * n)) / bottom, q * F.sqrt(p * (1 - p) / n + q * q / (4 * n * n)) / bottom
    within = lambda c: F.when(F.col("n_valid") > 0, F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    assessed = (F.col("_ny") >= least_scene) & (F.col("_sy") >= least_spread)
    # sums about the means of z where it is known and of the signal over the whole track
    cross = F.col("_szy") - F.col("_ay") * F.col("_sz") - (F.col("_sz") / F.col("_n")) * (F.col("_sy1") - F.col("_n") * F.col("_ay"))
    power = (F.col("_szz") - F.col("_sz") * F.col("_sz") / F.col("_n")) * F.col("_ny") * F.col("_sy") * F.col("_sy")
    corr = F.when(assessed & (F.col("_n") > 0) & (power > 0), cross / F.sqrt(power))
    width = F.max("bin").over(Window.partitionBy("track"))  # a row a bin
    weight = 1 - F.col("bin") / F.greatest(width, F.lit(1))
    score = 0.45 * F.least(p / 0.5, F.lit(1.0)) + 0.35 * F.least(F.greatest(F.coalesce("median_sigma", F.lit(0.0)) / 12.0, F.lit(0.0)), F.lit(1.0)) + 0.10 * F.col("early_weight") + 0.10 * F.coalesce(1 - F.abs(F.col("scene_correlation")), F.lit(0.5))
    out = met.withColumn("early_weight", weight).withColumn("scene_correlation", corr)
    return out.select(F.col("track").alias(track), F.col("bin").cast("bigint").alias("bin"), p.alias("occupancy"), within(centre - half).alias("ci_low"), within(centre + half).alias("ci_high"), "n_events", "n_valid", "median_counts", "median_sigma", "early_weight", "scene_correlation", F.coalesce(assessed, F.lit(False)).alias("scene_assessed"), F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest"), score.alias("score"))


# --------------------------------------------------------------------------- other features


def smoothed(df: DataFrame, key: str, column: str, window: int = 7, order: int = 2) -> DataFrame:
    """Samples smoothed inside each finite run; gaps stay null."""
    return per_waveform(df, key, column, "smooth array<double>", lambda v: [{"smooth": [None if x != x else x for x in kernels.smooth_runs(v, "savgol", window, order).tolist()]}])


def responses(df: DataFrame, key: str, column: str) -> DataFrame:
    schema = "peak_bin bigint, half_width bigint, runs bigint, centroid double, e10 bigint, e50 bigint, e90 bigint, skew double, clipped bigint"
    return per_waveform(df, key, column, schema, lambda v: [kernels.response_features(v - np.nanmedian(v), kernels.robust_sigma(v))] if np.isfinite(v).any() else [])


def gaussians(df: DataFrame, key: str, column: str, most: int = 4) -> DataFrame:
    """Mixture components of the longest finite run of each waveform."""

    def compute(v: np.ndarray) -> list[dict]:
        starts, ends = kernels.finite_runs(v)
        if not len(starts):
            return []
        k = int(np.argmax(ends - starts))
        own = v[starts[k] : ends[k]]
        return [{"rank": i, "amplitude": a, "centre": c + int(starts[k]), "sigma": s} for i, (a, c, s) in enumerate(kernels.fit_gaussians(own - np.median(own), most), 1)]

    # a fit takes milliseconds, so rows are dealt over all tasks; their few bytes would leave them in one
    dealt = df.select(key, column).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return per_waveform(dealt, key, column, "rank bigint, amplitude double, centre double, sigma double", compute)


def morphology(df: DataFrame, key: str, column: str) -> DataFrame:
    """Category of each waveform, first match: boundary, weak, near tie, wide, single, double, multiple."""

    def compute(v: np.ndarray) -> list[dict]:
        if not np.isfinite(v).any():
            return []
        w, sigma = v - np.nanmedian(v), kernels.robust_sigma(v)
        found = sorted(kernels.find_peaks(w, 2 * sigma, sigma), key=lambda p: -p["prominence"])
        top = int(np.nanargmax(w))
        if top < 2 or top > len(w) - 3:
            kind = "boundary"
        elif not found:
            kind = "weak"
        elif len(found) > 1 and found[1]["amplitude"] > 0.95 * found[0]["amplitude"]:
            kind = "near_tie"
        elif found[0]["width"] > 12:
            kind = "wide"
        else:
            kind = {1: "single", 2: "double"}.get(len(found), "multiple")
        return [{"category": kind, "n": len(found)}]

    return per_waveform(df, key, column, "category string, n bigint", compute)


def curtain(df: DataFrame, key: str, column: str, top: float, bottom: float, rows: int) -> DataFrame:
    """Waveforms resampled to a grid of heights from top to bottom, inside finite runs only; cells in gaps have no row."""
    heights = np.linspace(top, bottom, rows)

    def compute(v: np.ndarray) -> list[dict]:
        got = kernels.resample_runs(v, (top - heights) / (top - bottom) * (len(v) - 1))
        return [{"h": float(h), "v": float(x)} for h, x in zip(heights, got, strict=True) if x == x]

    return per_waveform(df, key, column, "h double, v double", compute)
