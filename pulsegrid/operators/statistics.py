"""Robust statistics with parameters: exact quantiles of whole tables, grid aggregates, robust z scores, error metrics.

Nothing here brings all values of a table into one task. Quantiles of a whole table start from brackets around each rank
out of a mergeable sketch; while more than ``MOST`` rows lie in a bracket, counts of fine bins narrow it; then its
distinct values, at most as many, give the exact quantile. The few numbers come to the driver, so that plans which use them stay small. Quantiles within groups use Spark's own aggregate, as a group's values meet in one task anyway.
Nulls and NaN are skipped everywhere.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.lineage import cut
from pulsegrid.operators.quantiles import BROADCAST_ROWS, finite, grouped_median_nmad, grouped_quantiles, keyed, with_median_nmad

MAD_TO_SIGMA = 1.4826
#: Ranks that the sketch may err by, as a share of the rows, is the inverse of this; brackets are twice as wide on either side.
ACCURACY = 5000
BINS = 1024
MOST = 10_000


def _values(df: DataFrame, value: str | Column) -> DataFrame:
    """Column v of the finite values; the generator keeps a long expression from being copied into each of its uses."""
    return df.select(F.explode(F.array(finite(value))).alias("v")).where("v IS NOT NULL")


def quantile_values(df: DataFrame, value: str | Column, ps: list[float], accuracy: int = ACCURACY, bins: int = BINS, most: int = MOST) -> list[float | None]:
    """Exact quantiles of value at ps, linear between neighbouring ranks; None for no values."""
    v = _values(df, value)
    ends = [min(1.0, max(0.0, p + side * 2 / accuracy)) for p in ps for side in (-1, 1)]
    n, least, top, sketch = v.agg(F.count("*"), F.min("v"), F.max("v"), F.percentile_approx("v", F.array(*[F.lit(e) for e in ends]), F.lit(accuracy))).first()
    if not n:
        return [None] * len(ps)
    spans = [(sketch[2 * i], sketch[2 * i + 1]) for i in range(len(ps))]
    ranks = [p * (n - 1) for p in ps]
    inside = lambda a, b: (F.col("v") >= F.lit(a)) & (F.col("v") <= F.lit(b))
    known: dict[int, tuple[float, float]] = {}
    while True:
        counts = v.agg(*[c for a, b in spans for c in (F.count_if(F.col("v") < F.lit(a)), F.count_if(inside(a, b)))]).first()
        missed = [i for i in range(len(ps)) if counts[2 * i] > floor(ranks[i]) or counts[2 * i] + counts[2 * i + 1] <= ceil(ranks[i])]
        if missed:  # as in tables of few rows, where the next rank lies beyond the bracket
            spans = [(least, top) if i in missed else span for i, span in enumerate(spans)]
            continue
        wide = [i for i, (a, b) in enumerate(spans) if a < b and counts[2 * i + 1] > most and i not in known]
        if not wide:
            break
        for i in wide:
            a, b = spans[i]
            bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(a)) / F.lit(b - a) * bins))
            found = v.where(inside(a, b)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            at, low, high = counts[2 * i], None, None
            for r in sorted(found, key=lambda r: r["bin"]):
                at += r["c"]
                if at > floor(ranks[i]) and low is None:
                    low = r
                if at > ceil(ranks[i]):
                    high = r
                    break
            if low["bin"] != high["bin"]:  # neighbouring ranks in two bins: the last value of one and the first of the other
                known[i] = (low["high"], high["low"])
            spans[i] = (low["low"], high["high"])
    any_ = F.lit(False)
    for span in (span for i, span in enumerate(spans) if i not in known):
        any_ = any_ | inside(*span)
    held = sorted((r["v"], r["count"]) for r in v.where(any_).groupBy("v").count().collect())
    out = []
    for i, (a, b) in enumerate(spans):
        at, (low, high) = counts[2 * i], known.get(i, (None, None))
        for x, c in ((x, c) for x, c in held if a <= x <= b and i not in known):
            at += c
            if low is None and at > floor(ranks[i]):
                low = x
            if at > ceil(ranks[i]):
                high = x
                break
        part = ranks[i] - floor(ranks[i])
        out.append(low if not part else low * (1 - part) + high * part)
    return out


def cells(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """df with the cell (ix, iy) of each row; null coordinates have none."""
    if size <= 0:
        raise ValueError("the cell size must be positive")
    return df.withColumn("ix", F.floor(F.col(x) / size).cast("bigint")).withColumn("iy", F.floor(F.col(y) / size).cast("bigint"))


def grid_aggregate(df: DataFrame, value: str, size: float, ps: list[float] = (), least: int = 1, x: str = "x", y: str = "y") -> DataFrame:
    """Count, mean, extremes and quantiles p0, p1, ... of value in each cell that has at least ``least`` values."""
    keyed = cells(df.withColumn("_v", finite(value)), size, x, y).where("_v IS NOT NULL AND ix IS NOT NULL AND iy IS NOT NULL")
    out = keyed.groupBy("ix", "iy").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("low"), F.max("_v").alias("high"), *[F.percentile("_v", F.lit(float(p))).alias(f"p{k}") for k, p in enumerate(ps)])
    return out.where(F.col("n") >= least)


def cell_median_mad(df: DataFrame, value: str, size: float, least: int, x: str = "x", y: str = "y") -> DataFrame:
    """Cells with at least ``least`` values: count, median, and median absolute deviation from it. Cells are counted first; where few
    are left, values of no other cell are shuffled or sorted."""
    keyed = cells(df.select(F.col(x), F.col(y), finite(value).alias("_v")), size, x, y).where("_v IS NOT NULL").select("ix", "iy", "_v")
    if least > 1:
        full = cut(keyed.groupBy("ix", "iy").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("ix", "iy"))
        if full.count() <= BROADCAST_ROWS:
            keyed = keyed.join(F.broadcast(full), ["ix", "iy"], "left_semi")
    centre = keyed.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.percentile("_v", F.lit(0.5)).alias("med")).where(F.col("n") >= least)
    return keyed.join(centre, ["ix", "iy"]).groupBy("ix", "iy", "n", "med").agg(F.percentile(F.abs(F.col("_v") - F.col("med")), F.lit(0.5)).alias("mad"))


def median_nmad(df: DataFrame, value: str | Column, eps: float = 1e-6) -> tuple[float | None, float | None]:
    """Median and normalised median absolute deviation of value, the latter at least eps; nothing of no values."""
    (med,) = quantile_values(df, value, [0.5])
    if med is None:
        return None, None
    (mad,) = quantile_values(df, F.abs(finite(value) - F.lit(med)), [0.5])
    return med, max(float(eps), MAD_TO_SIGMA * mad)


def robust_z(df: DataFrame, value: str, out: str = "z", eps: float = 1e-6) -> DataFrame:
    """df with how many deviations each value lies from the median of the whole table."""
    med, nmad = median_nmad(df, value, eps)
    return df.withColumn(out, (finite(value) - F.lit(med).cast("double")) / F.lit(nmad).cast("double"))


def group_robust_z(df: DataFrame, value: str, group: str, out: str = "z", least: int = 30, eps: float = 1e-6, of: DataFrame | None = None) -> DataFrame:
    """df with the absolute robust z of value in its group; null in groups of fewer than ``least`` values. df, or ``of`` with the same
    rows, is read several times; give a written table where it is dear to compute."""
    met = with_median_nmad(df, group, value, eps, MAD_TO_SIGMA, of=of)
    return met.withColumn(out, F.when(F.col("_n") >= least, F.abs(finite(value) - F.col("_med")) / F.col("_nmad"))).drop("_n", "_med", "_nmad")


def grouped_metrics(df: DataFrame, groups: list[str], value: str | Column, ddof: int = 0) -> DataFrame:
    """As ``distribution_metrics``, for each group."""
    own = cut(df.select(*groups, F.explode(F.array(finite(value))).alias("r")))
    v = F.col("r")
    sd = F.when(F.count("r") == 1, F.lit(0.0)).otherwise(F.stddev_samp("r")) if ddof else F.stddev_pop("r")
    plain = own.groupBy(*groups).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), sd.alias("sd"), F.sqrt(F.avg(v * v)).alias("rmse"), F.avg(F.abs("r")).alias("mae"))
    ranks = {0.05: "p05", 0.5: "a50", 0.68: "a68", 0.9: "a90", 0.95: "a95"}
    found = grouped_quantiles(own, groups, {"r": v, "a": F.abs(v)}, list(ranks))
    nmad = grouped_median_nmad(own, groups, v, 0.0, MAD_TO_SIGMA)
    picked = found.select(*groups, F.col("r_q0").alias("p05"), F.col("r_q4").alias("p95"), *[F.col(f"a_q{i}").alias(n) for i, n in enumerate(ranks.values()) if i])
    out = keyed(keyed(plain, picked, groups), nmad.select(*groups, "med", "nmad"), groups)
    return out.select(*groups, "n", "mean", "med", "sd", "rmse", "mae", "nmad", "p05", "p95", "a50", "a68", "a90", "a95")


def summaries(df: DataFrame, groups: list[str], values: dict[str, str | Column], ps: dict[str, float]) -> DataFrame:
    """For each group and every name in values: name_n (finite values), name_mean, name_sd, name_low, name_high, and quantiles under
    the names in ps (name_p05 and the like)."""
    aggs = [F.count("*").alias("rows")]
    for name, c in values.items():
        v = finite(c)
        aggs += [F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_sd"), F.min(v).alias(f"{name}_low"), F.max(v).alias(f"{name}_high")]
    plain = df.groupBy(*groups).agg(*aggs)
    found = grouped_quantiles(df, groups, values, list(ps.values()))
    found = found.select(*groups, *[c for name in values for c in (f"{name}_n", *[F.col(f"{name}_q{i}").alias(f"{name}_{p}") for i, p in enumerate(ps)])])
    return keyed(plain, found, groups)


def calibrated_metrics(df: DataFrame, groups: list[str], value: str, role: Column) -> DataFrame:
    """The median of value over the rows of each group where role holds (off), and the metrics n, bias and rmse of value less it over
    the other rows; groups without either have no row."""
    off = grouped_quantiles(df.where(role), groups, {"v": value}, [0.5]).select(*groups, F.col("v_q0").alias("off"))
    rest = keyed(df.where(~role), off, groups).withColumn("_r", finite(value) - F.col("off")).where("_r IS NOT NULL")
    return rest.groupBy(*groups).agg(F.max("off").alias("off"), F.count("*").alias("n"), F.avg("_r").alias("bias"), F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rmse"))


def distribution_metrics(df: DataFrame, value: str, ddof: int = 0) -> DataFrame:
    """One row of error metrics of a whole table: bias, spread about the median, quantiles and absolute quantiles. ``ddof``
    is 0 or 1, the degrees of freedom that the deviation leaves out; of one value the deviation is zero."""
    v = _values(df, value).withColumnRenamed("v", "r")
    plain = v.agg(F.count("*").alias("n"), F.avg("r").alias("mean"), (F.when(F.count("r") == 1, F.lit(0.0)).otherwise(F.stddev_samp("r")) if ddof else F.stddev_pop("r")).alias("sd"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"), F.avg(F.abs("r")).alias("mae"))
    med, p05, p95 = quantile_values(v, "r", [0.5, 0.05, 0.95])
    away = quantile_values(v, F.abs("r"), [0.5, 0.68, 0.9, 0.95])
    nmad = None if med is None else MAD_TO_SIGMA * quantile_values(v, F.abs(F.col("r") - F.lit(med)), [0.5])[0]
    found = {"med": med, "nmad": nmad, "p05": p05, "p95": p95, **dict(zip(("a50", "a68", "a90", "a95"), away, strict=True))}
    out = plain.select("*", *[F.lit(x).cast("double").alias(name) for name, x in found.items()])
    return out.select("n", "mean", "med", "sd", "rmse", "mae", "nmad", "p05", "p95", "a50", "a68", "a90", "a95")


def clipped_median(df: DataFrame, value: str, rounds: int = 3, k: float = 3.0, least: float = 0.0) -> DataFrame:
    """One row (n, med, nmad) after repeatedly leaving out values more than k deviations (each at least ``least``) from the median."""
    kept = _values(df, value)
    for _ in range(rounds):
        med, nmad = median_nmad(kept, "v", least)
        kept = kept.where(F.abs(F.col("v") - F.lit(med).cast("double")) <= F.lit(k) * F.lit(nmad).cast("double"))
    med, nmad = median_nmad(kept, "v", 0.0)
    return kept.agg(F.count("*").alias("n")).select("n", F.lit(med).cast("double").alias("med"), F.lit(nmad).cast("double").alias("nmad"))


def select_configuration(metrics: DataFrame, evidence: DataFrame, population: str = "candidate_selection") -> DataFrame:
    """One row (candidate, status, rank, rmse): the candidate with the best evidence, of equal evidence the least mean RMSE, then the
    smaller name. metrics has candidate, role and rmse; evidence has candidate, verified, complete, provisional and rank.

    Verified candidates with a complete operation come before provisional ones. Metrics of another population than the one for
    selection are an error, as is having no candidate at all."""
    roles = [r["role"] for r in metrics.where(~F.col("role").eqNullSafe(F.lit(population))).select("role").distinct().limit(5).collect()]
    if roles:
        raise ValueError(f"forbidden populations: {sorted(map(str, roles))}")
    known = metrics.groupBy("candidate").agg(F.avg("rmse").alias("rmse")).join(evidence, "candidate").where(F.coalesce("complete", F.lit(True)))
    status = F.when(F.col("verified"), "verified").when(F.col("provisional"), "provisional")
    ranked = known.withColumn("status", status).where("status IS NOT NULL").select(F.struct((F.col("status") == "provisional").alias("late"), (-F.coalesce("rank", F.lit(0))).alias("worse"), "rmse", "candidate", "status", "rank").alias("c"))
    out = ranked.agg(F.min("c").alias("c")).where("c IS NOT NULL").select("c.candidate", "c.status", "c.rank", "c.rmse")
    if out.isEmpty():
        raise ValueError("no verified or provisional candidate")
    return out
