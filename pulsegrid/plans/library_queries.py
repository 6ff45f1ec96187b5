"""Queries that call the library's functions with parameters, with oracles written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import crs
from pulsegrid.operators import alignment, classify, noise, raster, statistics, sweep
from pulsegrid.plans.binding import with_tables
from pulsegrid.plans.dialect import Dialect
from pulsegrid.plans.operator_queries import GOOD, PULSES, _near, bound, rounded, shared
from pulsegrid.plans.sequence_queries import _haversine
from pulsegrid.plans.statistics_queries import MAD, _r
from pulsegrid.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]

RESIDUALS = "SELECT * FROM residuals"
CASCADE = classify.CascadeOptions(near_ground_guard=True, support_confidence=True, signal_density_noise=True, scanline_sweep=True, scanline_z=(3.0, 55.0), scanline_height=(2.0, 30.0), scanline_density=None, scanline_group=4, shallow=0.5, least_density=0.03, low_density=0.05, support_distance=9.0, below=1.5)
NOISE = noise.NoiseOptions(error=0.085, horizontal_error=7.5e-7, height_shares=(0.0005, 0.9995), residual=10.0)
SETTINGS = [sweep.Setting(mode, share=share, tolerance=tolerance, below=1.0) for mode in ("height_only", "height_no_below_noise") for share in (0.02, 0.3) for tolerance in (1.0, 2.0)]
POINTS = "SELECT ref_id, x, y, z FROM refs"


def _cascade_points(spark: SparkSession, d: str) -> DataFrame:
    """Pulses with the ground of their cell, the density of their cell, and the distance from its centre; no column that no rule reads."""
    points = statistics.cells(bound(spark, d, "SELECT pulse_index, sweep_num, track_num, x, y, refh, snr, amp FROM pulses"), 15.0)
    away = F.sqrt((F.col("x") - (F.col("ix") + 0.5) * 15) ** 2 + (F.col("y") - (F.col("iy") + 0.5) * 15) ** 2)
    met = classify.with_cell_ground(points.withColumn("away", away), 15.0, 0.02, 5.0)
    return met.withColumn("density", F.col("n") / 225.0).withColumn("support_dist", F.when(F.col("ground").isNotNull(), F.col("away"))).drop("x", "y", "ix", "iy", "n", "away")


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    """pulse_index and reason bits: low snr, low snr and amplitude, below the threshold, off the median of its cell of 5 m."""
    points = bound(spark, d, GOOD)
    dark = F.lit(statistics.quantile_values(points, "amp", [0.05])[0]).cast("double")
    local = statistics.cell_median_mad(points, "refh", 5.0, 12).select("ix", "iy", "med", "mad")
    limit = F.greatest(F.lit(10.0), 8 * F.greatest(1.4826 * F.col("mad"), F.lit(0.75)))
    rules = {1: F.col("snr") < 1.5, 2: (F.col("snr") < 1.8) & (F.col("amp") < dark), 4: F.col("amp") - F.col("thres") <= 0, 8: F.abs(F.col("refh") - F.col("med")) > limit}
    reason = sum((F.when(holds, bit).otherwise(0) for bit, holds in rules.items()), F.lit(0)).cast("bigint")
    return statistics.cells(points, 5.0).join(local, ["ix", "iy"], "left").select("pulse_index", reason.alias("reason"))


def _metrics(spark: SparkSession, d: str, ddof: int) -> DataFrame:
    return rounded(statistics.distribution_metrics(bound(spark, d, RESIDUALS), "r", ddof))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def query(name: str):
        def add(f: Query) -> Query:
            q[name] = f
            return f

        return add

    @query("a1_grid_aggregate")
    def _(spark, d):
        points = bound(spark, d, GOOD)
        z = statistics.grid_aggregate(points, "refh", 4.0, [0.5, 0.95], 2).select("ix", "iy", F.col("high").alias("z_max"), F.col("mean").alias("z_mean"), F.col("p0").alias("z_med"), F.col("p1").alias("z_p95"), "n")
        s = statistics.grid_aggregate(points, "snr", 4.0).select("ix", "iy", F.col("high").alias("snr_max"), F.col("mean").alias("snr_mean"))
        return rounded(z.join(s, ["ix", "iy"]).withColumnsRenamed({"ix": "col", "iy": "row_"}))

    @query("a2_grid_percentile")
    def _(spark, d):
        out = statistics.grid_aggregate(bound(spark, d, GOOD), "refh", 6.0, [0.1])
        return rounded(out.select(F.col("ix").alias("col"), F.col("iy").alias("row_"), F.col("p0").alias("z"), "n"))

    @query("a3_cell_median_mad")
    def _(spark, d):
        return rounded(statistics.cell_median_mad(bound(spark, d, GOOD), "refh", 5.0, 12))

    @query("a7_global_robust_z")
    def _(spark, d):
        return rounded(statistics.robust_z(bound(spark, d, PULSES), "amp", "z", 1e-9).select("pulse_index", "z"))

    @query("a8_median_nmad")
    def _(spark, d):
        points = bound(spark, d, RESIDUALS)
        med, nmad = statistics.median_nmad(points, "r", 0.0)
        return rounded(points.agg(F.count("r").alias("n")).select(F.lit(med).cast("double").alias("med"), F.lit(nmad).cast("double").alias("nmad"), "n"))

    @query("a9_group_robust_z")
    def _(spark, d):
        return rounded(statistics.group_robust_z(bound(spark, d, "SELECT * FROM pulses WHERE refh IS NOT NULL"), "refh", "sweep_num", "z", 4).select("pulse_index", "z"), 4)

    @query("a10_array_summary")
    def _(spark, d):
        points = bound(spark, d, PULSES)
        ends = points.agg(F.count("*").alias("n"), F.count("refh").alias("n_finite"), F.min("refh").alias("low"), F.max("refh").alias("high"))
        middle = statistics.quantile_values(points, "refh", [0.02, 0.5, 0.98])
        return rounded(ends.select("*", *[F.lit(x).cast("double").alias(name) for x, name in zip(middle, ("p02", "p50", "p98"), strict=True)]))

    q["a13_distribution_metrics"] = lambda spark, d: _metrics(spark, d, 0)
    q["a14_elevation_metrics"] = lambda spark, d: _metrics(spark, d, 1)

    @query("a15_residual_decomposition")
    def _(spark, d):
        points = bound(spark, d, RESIDUALS)
        own = points.withColumn("m", F.lit(statistics.quantile_values(points, "r", [0.5])[0]).cast("double"))
        share = F.avg("r") * F.avg("r") / F.nullif(F.avg(F.col("r") * F.col("r")), F.lit(0.0))
        adds = F.abs(F.avg(F.col("r") * F.col("r")) - F.avg("r") * F.avg("r") - F.var_pop("r")) < 1e-6
        out = own.agg(F.count("r").alias("n"), F.avg("r").alias("bias"), F.stddev_pop("r").alias("crmse"), F.sqrt(F.avg((F.col("r") - F.col("m")) ** 2)).alias("about_median"), share.alias("bias_share"), (1 - share).alias("spread_share"), adds.alias("adds_up"))
        return rounded(out)

    @query("a38_clipped_median")
    def _(spark, d):
        out = statistics.clipped_median(bound(spark, d, RESIDUALS), "r", 3, 3.0, 1e-3)
        return rounded(out.select(F.col("med").alias("shift"), "nmad", "n"))

    @query("p2_staged_mask")
    def _(spark, d):
        finite = bound(spark, d, "SELECT snr, amp FROM pulses WHERE refh IS NOT NULL")
        low, high = (F.lit(x).cast("double") for x in statistics.quantile_values(finite.where("snr >= 2"), "amp", [0.1, 0.99]))
        bright = F.col("snr") >= 2
        n = finite.agg(F.count("*").alias("finite"), F.count_if(bright).alias("snr"), F.count_if(bright & F.col("amp").between(low, high)).alias("amp"))
        return n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in ("finite", "snr", "amp")])))

    @query("p9_reason_bits")
    def _(spark, d):
        return _reasons(spark, d).where("reason <> 0").select("pulse_index", "reason", F.bit_count("reason").cast("bigint").alias("n_reasons"))

    @query("a47_noise_counts")
    def _(spark, d):
        bits = F.explode(F.array(*[F.lit(b).cast("bigint") for b in (1, 2, 4, 8)])).alias("bit")
        hit = F.col("reason").bitwiseAND(F.col("bit")) != 0
        return rounded(_reasons(spark, d).select("reason", bits).groupBy("bit").agg(F.count_if(hit).alias("hits"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("share")))

    @query("e20_crosscheck")
    def _(spark, d):
        off = bound(spark, d, f"SELECT abs(a - b) AS v FROM (SELECT {_haversine('-869e-1', '404e-1', 'lon', 'lat')} AS a, sqrt(power((lon + 869e-1) * 111194.93e0 * cos(radians(404e-1)), 2) + power((lat - 404e-1) * 111194.93e0, 2)) AS b FROM good) AS c")
        med = F.lit(statistics.quantile_values(off, "v", [0.5])[0]).cast("double")
        return rounded(off.agg(F.max("v").alias("top")).select(med.alias("med"), "top"), 7)

    @query("r6_smooth")
    def _(spark, d):
        return rounded(raster.smoothed(raster.grid(bound(spark, d, GOOD), "refh", 4.0, 0.1), 1.0, 2.0))

    @query("f2_normalise")
    def _(spark, d):
        points = bound(spark, d, PULSES)
        lo, hi = (F.lit(x).cast("double") for x in statistics.quantile_values(points, "amp", [0.02, 0.98]))
        v = F.least(F.greatest((F.col("amp") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return rounded(points.select("pulse_index", v.alias("v"), (F.least(F.greatest(F.col("amp") * 1000, F.lit(0)), F.lit(65535)).cast("bigint") > 50000).alias("bright")))

    @query("e21_height_selection")
    def _(spark, d):
        off = F.lit(statistics.quantile_values(bound(spark, d, GOOD), F.col("refh") - F.col("ground"), [0.5])[0]).cast("double")
        status = F.when(F.col("refh").isNull(), "missing").when(F.col("track_num") == 1, "raw").otherwise("shifted")
        return rounded(bound(spark, d, PULSES).select("pulse_index", status.alias("status"), F.when(F.col("track_num") == 1, F.col("refh")).otherwise(F.col("refh") - off).alias("h")))

    @query("e33_percentile_clip")
    def _(spark, d):
        points = bound(spark, d, RESIDUALS)
        low, high = statistics.quantile_values(points, "r", [0.01, 0.99])
        return points.where((F.col("r") >= F.lit(low).cast("double")) & (F.col("r") <= F.lit(high).cast("double"))).select("pulse_index")

    @query("j2_alignment")
    def _(spark, d):
        reference = bound(spark, d, "SELECT pulse_index, lon, lat, refh, ref_class, roi = 'R' AS withheld FROM pulses WHERE track_num <= 4")
        return alignment.align(bound(spark, d, PULSES), reference, "pulse_index", {"lon": 1e-7, "lat": 1e-7, "refh": 1e-3}, "ref_class", "withheld")

    @query("j4_same_cell_ground")
    def _(spark, d):
        grid = statistics.grid_aggregate(bound(spark, d, GOOD), "refh", 2.0, [0.1], 6).select("ix", "iy", F.col("p0").alias("z"))
        out = classify.sample_ground(bound(spark, d, GOOD).drop("ground"), grid, 2.0, 8, 2.0, 12.0)
        return rounded(out.select("pulse_index", F.col("ground").alias("g")), 4)

    @query("c1_full_cascade")
    def _(spark, d):
        return rounded(classify.classify(_cascade_points(spark, d), CASCADE).select("pulse_index", "hag", F.col("class").cast("bigint").alias("class"), F.col("reason").cast("bigint").alias("reason")))

    for mode in classify.MODES[:-1]:
        q[f"c1_mode_{mode}"] = lambda spark, d, mode=mode: classify.classify(_cascade_points(spark, d), classify.CascadeOptions(mode=mode, scanline_noise=False, least_density=0.05, below=1.0)).groupBy("class", "reason").agg(F.count("*").alias("n")).select(F.col("class").cast("bigint").alias("class"), F.col("reason").cast("bigint").alias("reason"), "n")

    @query("c4_noise_labelling")
    def _(spark, d):
        points = bound(spark, d, "SELECT *, tax + 1e-2 AS refh_error, discount * 1e-5 AS refh_longitude_error, CASE WHEN track_num > 1 THEN -tax * 1e-5 END AS refh_latitude_error FROM good")
        return rounded(noise.label_noise(points, NOISE).select("pulse_index", F.col("local_median").alias("med"), F.col("local_mad").alias("mad"), "reason", "keep"))

    @query("c6_parameter_sweep")
    def _(spark, d):
        points = bound(spark, d, "SELECT pulse_index, granule, x, y, refh, snr, ref_class FROM pulses")
        results = sweep.run(points, SETTINGS, shared(spark, "sweep"))
        return rounded(sweep.ranked(results, SETTINGS).drop("setting"), 6)

    @query("c5_statistical_outliers")
    def _(spark, d):
        shared(spark, "c5")
        return rounded(noise.statistical_outliers(bound(spark, d, POINTS), 9, 2.0, "ref_id", ("x", "y", "z"), 4.0))

    @query("a51_id_set_hash")
    def _(spark, d):
        ids = bound(spark, d, "SELECT DISTINCT pulse_index, track_num FROM good")
        # digests of runs of ids, which a run bounds, then the digest of those in their order
        runs = ids.groupBy("track_num", F.expr("pulse_index div 17592186044416").alias("run")).agg(F.count("*").alias("m"), F.sha2(F.array_join(F.array_sort(F.collect_list("pulse_index")), ","), 256).alias("s"))
        return runs.groupBy("track_num").agg(F.sum("m").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "s"))), lambda r: r["s"]), ","), 256).alias("digest"))

    @query("k1_point_sink")
    def _(spark, d):
        path = shared(spark, "points")
        bound(spark, d, "SELECT pulse_index, x, y, refh AS z, ref_class AS classification, track_num FROM good").write.partitionBy("track_num").parquet(path)
        return rounded(spark.read.parquet(path).select("pulse_index", F.col("track_num").cast("bigint").alias("track_num"), F.col("classification").cast("bigint").alias("classification"), "x", "y", "z"))

    @query("k2_raster_sink")
    def _(spark, d):
        path = shared(spark, "raster")
        statistics.grid_aggregate(bound(spark, d, GOOD), "refh", 4.0).select("ix", "iy", F.col("mean").alias("value"), F.col("n").cast("int").alias("n")).write.parquet(path)
        return rounded(spark.read.parquet(path).select(F.col("ix").alias("col"), F.col("iy").alias("row_"), "value", F.col("n").cast("bigint").alias("n")))

    @query("e5_horizontal_crs")
    def _(spark, d):
        zone = F.pmod("station_id", F.lit(60)) + 1
        text = F.when(F.pmod("station_id", F.lit(3)) == 0, F.concat(F.lit("EPSG:326"), F.lpad(zone.cast("string"), 2, "0"), F.lit("+5703"))).when(F.pmod("station_id", F.lit(3)) == 1, F.concat(F.lit("WGS 84 / UTM zone "), zone.cast("string"), F.lit("S"))).otherwise(F.lit("local grid"))
        return bound(spark, d, "SELECT station_id FROM stations").select("station_id", crs.horizontal(text).cast("bigint").alias("code"))

    def streamed(make) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            folder = shared(spark, "stream")
            return windows.run_to_end(make(windows.bounded_stream(spark, d, folder)), f"{folder}/out", f"{folder}/state")

        return run

    window = ("unix_millis(w.start) AS from_ms", "unix_millis(w.end) AS to_ms")
    q["st1_tumbling_stream"] = lambda spark, d: rounded(streamed(windows.tumbling)(spark, d).selectExpr(*window, "event_type", "n", "mean"))
    q["st2_sliding_stream"] = lambda spark, d: rounded(streamed(windows.sliding)(spark, d).selectExpr(*window, "n", "top"))
    q["st3_session_stream"] = lambda spark, d: streamed(windows.sessions)(spark, d).selectExpr(*window, "user_id", "n")
    q["st4_latest_stream"] = lambda spark, d: rounded(streamed(lambda e: windows.latest(e).select("event_id", "event_type", "value"))(spark, d).where("event_id IS NOT NULL"))
    q["st5_stateful_visits"] = streamed(windows.visits)
    return q


def oracle_sql() -> dict[str, str]:
    d = Dialect(False)
    cell = lambda size, a="": f"floor({a}x / {size}e0) AS ix, floor({a}y / {size}e0) AS iy"
    points = f"""p AS (SELECT *, {cell(15)} FROM pulses), g AS (SELECT ix, iy, quantile_cont(refh, 0.02) AS z, count(refh) AS n FROM p WHERE snr >= 5 AND refh IS NOT NULL GROUP BY ix, iy),
        k AS (SELECT p.* EXCLUDE (ground), g.z AS gz, g.n / 225e0 AS dens, CASE WHEN g.z IS NOT NULL THEN sqrt(pow(x - (p.ix + 0.5) * 15, 2) + pow(y - (p.iy + 0.5) * 15, 2)) END AS away, round(refh - g.z, 9) AS hag FROM p LEFT JOIN g ON g.ix = p.ix AND g.iy = p.iy)"""
    z_of = lambda name, group: f"{name}m AS (SELECT {group}, median(hag) AS m FROM k WHERE hag IS NOT NULL GROUP BY {group} HAVING count(*) >= 4), {name} AS (SELECT k.{group}, any_value(m) AS m, greatest(1e-6, {MAD} * median(abs(hag - m))) AS s FROM k JOIN {name}m ON {name}m.{group} = k.{group} WHERE hag IS NOT NULL GROUP BY k.{group})"
    modes = {
        "height_only": [("ground", 2, 1), ("low", 7, 3), ("high", 7, 4)],
        "height_density_pre_ground": [("thin", 7, 6), ("ground", 2, 1), ("low", 7, 3), ("high", 7, 4)],
        "height_density_post_ground": [("ground", 2, 1), ("thin", 7, 8), ("low", 7, 3), ("high", 7, 4)],
        "height_density_processed_only": [("ground", 2, 1), ("low", 7, 3), ("high", 7, 4), ("thin", 7, 9)],
        "height_no_below_noise": [("ground", 2, 1), ("high", 7, 4), ("hag < 0", 1, 7)],
    }
    texts = {"ground": "abs(hag) <= 1.5", "low": "hag < -1", "high": "hag > 30", "thin": "dens < 0.05"}

    def mode_sql(rules: list[tuple[str, int, int]]) -> str:
        pick = lambda n: "CASE WHEN gz IS NULL THEN {} WHEN hag IS NULL THEN {} ".format(*((1, 7) if n == 1 else (2, 18))) + " ".join(f"WHEN {texts.get(r[0], r[0])} THEN {r[n]}" for r in rules) + f" ELSE {(0, 1, 5)[n]} END"
        return f"WITH {points} SELECT CAST({pick(1)} AS BIGINT) AS class, CAST({pick(2)} AS BIGINT) AS reason, count(*) AS n FROM k GROUP BY 1, 2"

    o = {f"c1_mode_{mode}": mode_sql(rules) for mode, rules in modes.items()}
    # states are class * 100 + reason
    o["c1_full_cascade"] = f"""
        WITH {points}, {z_of('tr', 'track_num')}, {z_of('sw', 'sweep_num')},
        am AS (SELECT median(amp) AS m FROM pulses), az AS (SELECT any_value(m) AS m, greatest(1e-6, {MAD} * median(abs(amp - m))) AS s FROM pulses, am),
        f AS (SELECT k.*, abs(hag - tr.m) / tr.s AS tz, abs(hag - sw.m) / sw.s AS sz, (amp - az.m) / az.s <= -1 AS dim, coalesce(snr <= 2.5, false) AS faint, coalesce(dens < 0.05, false) AS sparse, coalesce(away > 9, false) AS weak
            FROM k CROSS JOIN az LEFT JOIN tr ON tr.track_num = k.track_num LEFT JOIN sw ON sw.sweep_num = k.sweep_num),
        s0 AS (SELECT *, CASE WHEN gz IS NULL THEN 102 WHEN hag IS NULL THEN 718 WHEN hag BETWEEN -1.5 AND 1.5 THEN 201 WHEN hag < -1.5 THEN 703 WHEN hag > 30 THEN 704 WHEN dens < 0.03 THEN 709 ELSE 105 END AS s FROM f),
        s1 AS (SELECT * REPLACE (CASE WHEN s = 201 AND faint THEN 110 WHEN s = 201 AND weak THEN 111 WHEN s = 201 AND sparse THEN 112 ELSE s END AS s) FROM s0),
        s2 AS (SELECT * REPLACE (CASE WHEN s // 100 = 1 AND abs(hag) >= 1 AND sparse AND faint THEN 713 WHEN s // 100 = 1 AND abs(hag) >= 1 AND sparse AND dim THEN 714 ELSE s END AS s) FROM s1),
        s3 AS (SELECT * REPLACE (CASE WHEN s // 100 = 1 AND hag BETWEEN 2 AND 30 AND (tz BETWEEN 3 AND 55 OR sz BETWEEN 3 AND 55) THEN 715 ELSE s END AS s) FROM s2),
        s4 AS (SELECT * REPLACE (CASE WHEN s = 703 AND hag >= -0.5 AND NOT sparse AND NOT faint THEN CASE WHEN weak THEN 117 ELSE 116 END ELSE s END AS s) FROM s3)
        SELECT pulse_index, {_r('hag')} AS hag, CAST(s // 100 AS BIGINT) AS class, CAST(s % 100 AS BIGINT) AS reason FROM s4"""
    o["c4_noise_labelling"] = f"""
        WITH t AS (SELECT quantile_cont(amp, 0.05) AS dark, quantile_cont(refh, 0.0005) AS z0, quantile_cont(refh, 0.9995) AS z1 FROM good),
        c AS (SELECT {cell(5)}, * FROM good), m AS (SELECT ix, iy, median(refh) AS med FROM c GROUP BY ix, iy HAVING count(*) >= 12),
        s AS (SELECT c.ix, c.iy, any_value(med) AS med, median(abs(refh - med)) AS mad FROM c JOIN m ON m.ix = c.ix AND m.iy = c.iy GROUP BY c.ix, c.iy),
        r AS (SELECT pulse_index, med, mad, list_filter([CASE WHEN snr < 1.5 THEN 1 END, CASE WHEN snr < 1.8 AND amp < dark THEN 2 END, CASE WHEN amp <= thres THEN 4 END,
            CASE WHEN med IS NOT NULL AND abs(refh - med) > 10 AND abs(refh - med) > 8 * 0.75 AND abs(refh - med) > 8 * {MAD} * mad THEN 8 END, CASE WHEN refh NOT BETWEEN z0 AND z1 THEN 32 END,
            CASE WHEN tax + 1e-2 > 0.085 THEN 64 END, CASE WHEN discount * 1e-5 > 7.5e-7 OR (track_num > 1 AND tax * 1e-5 > 7.5e-7) THEN 128 END], lambda b: b IS NOT NULL) AS bits
            FROM c CROSS JOIN t LEFT JOIN s ON s.ix = c.ix AND s.iy = c.iy)
        SELECT pulse_index, {_r('med')} AS med, {_r('mad')} AS mad, CAST(coalesce(list_sum(bits), 0) AS BIGINT) AS reason, len(bits) = 0 AS keep FROM r"""
    parts, tries = [], []
    for k, share in enumerate((0.02, 0.3)):
        parts.append(f"""g{k} AS (SELECT granule, ix, iy, (ix + 0.5) * 15 AS x, (iy + 0.5) * 15 AS y, quantile_cont(refh, {share}) AS z, CAST(row_number() OVER (ORDER BY granule, ix, iy) AS BIGINT) AS cid FROM p WHERE snr >= 5 AND refh IS NOT NULL GROUP BY granule, ix, iy),
            n{k} AS ({_near('(SELECT p.* FROM p ANTI JOIN g' + str(k) + ' AS o ON o.granule = p.granule AND o.ix = p.ix AND o.iy = p.iy) AS q', 'g' + str(k), 30, 'pulse_index', 'cid', ', a.granule AS ga, b.granule AS gb, b.z AS v')}),
            i{k} AS (SELECT aid, sum(v / (dist * dist)) / sum(1 / (dist * dist)) AS v FROM (SELECT * FROM n{k} WHERE ga = gb QUALIFY row_number() OVER (PARTITION BY aid ORDER BY dist, bid) <= 12) AS r GROUP BY aid),
            h{k} AS (SELECT p.granule, p.ref_class AS t, p.refh, coalesce(g{k}.z, i{k}.v) AS gz FROM p LEFT JOIN g{k} ON g{k}.granule = p.granule AND g{k}.ix = p.ix AND g{k}.iy = p.iy LEFT JOIN i{k} ON i{k}.aid = p.pulse_index)""")
        for mode, low in (("height_only", "WHEN refh - gz < -1 THEN 7"), ("height_no_below_noise", "")):
            for tol in (1, 2):
                tries.append(f"SELECT '{mode}' AS mode, '{share}-{tol}' AS part, granule, t, CASE WHEN gz IS NULL THEN 1 WHEN refh IS NULL THEN 7 WHEN abs(refh - gz) <= {tol} THEN 2 {low} WHEN refh - gz > 30 THEN 7 ELSE 1 END AS k FROM h{k}")
    f1 = lambda c: f"coalesce(2 * count(*) FILTER (t = {c} AND k = {c}) / nullif(count(*) FILTER (t = {c}) + count(*) FILTER (k = {c}), 0), 0)"
    o["c6_parameter_sweep"] = f"""
        WITH p AS (SELECT *, {cell(15)} FROM pulses), {', '.join(parts)}, u AS ({' UNION ALL '.join(tries)}),
        f AS (SELECT mode, part, granule, {f1(1)} AS f1, {f1(2)} AS f2, {f1(7)} AS f7, coalesce(count(*) FILTER (t = 7 AND k = 7) / nullif(count(*) FILTER (t = 7), 0), 0) AS r7 FROM u GROUP BY mode, part, granule),
        s AS (SELECT *, (f1 + f2 + f7) / 3 AS macro, 0.5 * f2 + 0.3 * f7 + 0.2 * (f1 + f2 + f7) / 3 - CASE WHEN least(f1, f2, f7) < 0.1 THEN 0.1 ELSE 0 END AS obj FROM f),
        m AS (SELECT mode, part, count(*) AS n_files, avg(obj) AS a, min(obj) AS b, avg(macro) AS c, avg(r7) AS e FROM s GROUP BY mode, part)
        SELECT mode, n_files, {_r('a', 6)} AS mean_objective, {_r('b', 6)} AS least_objective, {_r('c', 6)} AS mean_macro_f1, {_r('e', 6)} AS mean_recall_7, row_number() OVER (ORDER BY round(a, 9) DESC, round(b, 9) DESC, round(c, 9) DESC, round(e, 9) DESC, mode = 'height_no_below_noise', part) AS rank FROM m"""
    o["c5_statistical_outliers"] = f"""
        WITH n AS (SELECT a.ref_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM refs a, refs b QUALIFY row_number() OVER (PARTITION BY a.ref_id ORDER BY dist) <= 9),
        m AS (SELECT ref_id, avg(dist) AS mean_dist FROM n GROUP BY ref_id), l AS (SELECT avg(mean_dist) + 2 * stddev_samp(mean_dist) AS lim FROM m WHERE mean_dist > 0)
        SELECT ref_id, {_r('mean_dist')} AS mean_dist, NOT (mean_dist > 0 AND mean_dist < lim) AS outlier FROM m, l"""
    o["j2_alignment"] = "SELECT pulse_index, track_num <= 4 AND roi <> 'R' AND refh IS NOT NULL AS valid, CAST(CASE WHEN track_num <= 4 THEN ref_class ELSE 0 END AS BIGINT) AS gt FROM pulses"
    o["j4_same_cell_ground"] = f"""
        WITH c AS (SELECT pulse_index, x, y, refh, {cell(2)} FROM good), g AS (SELECT ix, iy, (ix + 0.5) * 2 AS x, (iy + 0.5) * 2 AS y, quantile_cont(refh, 0.1) AS z, CAST(row_number() OVER (ORDER BY ix, iy) AS BIGINT) AS cid FROM c GROUP BY ix, iy HAVING count(*) >= 6),
        near AS ({_near('c', 'g', 12, 'pulse_index', 'cid', ', b.z AS v')}), b AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY aid ORDER BY dist, bid) <= 8),
        i AS (SELECT aid, CASE WHEN min(dist) = 0 THEN min_by(v, dist) ELSE sum(v / (dist * dist)) / sum(1 / (dist * dist)) END AS v FROM b GROUP BY aid)
        SELECT c.pulse_index, {_r('coalesce(g.z, i.v)', 4)} AS g FROM c LEFT JOIN g ON g.ix = c.ix AND g.iy = c.iy LEFT JOIN i ON i.aid = c.pulse_index"""
    o["a51_id_set_hash"] = "WITH r AS (SELECT track_num, pulse_index // 17592186044416 AS run, count(*) AS m, sha256(string_agg(CAST(pulse_index AS VARCHAR), ',' ORDER BY pulse_index)) AS s FROM (SELECT DISTINCT pulse_index, track_num FROM good) AS i GROUP BY 1, 2) SELECT track_num, CAST(sum(m) AS BIGINT) AS n, sha256(string_agg(s, ',' ORDER BY run)) AS digest FROM r GROUP BY track_num"
    o["k1_point_sink"] = f"SELECT pulse_index, track_num, CAST(ref_class AS BIGINT) AS classification, {_r('x')} AS x, {_r('y')} AS y, {_r('refh')} AS z FROM good"
    o["k2_raster_sink"] = f"SELECT CAST(floor(x / 4) AS BIGINT) AS col, CAST(floor(y / 4) AS BIGINT) AS row_, {_r('avg(refh)')} AS value, count(*) AS n FROM good GROUP BY 1, 2"
    o["e5_horizontal_crs"] = "SELECT station_id, CAST(CASE station_id % 3 WHEN 0 THEN 32601 + station_id % 60 WHEN 1 THEN 32701 + station_id % 60 END AS BIGINT) AS code FROM stations"
    o["k3_stable_parquet"] = "SELECT pulse_index, track_num, snr FROM good"
    o["s6_optional_columns"] = "SELECT pulse_index, refh, 0e0 AS geoid FROM pulses"
    o["s15_labelled_reference"] = "SELECT ref_id, class, tile, 'part' AS provenance FROM refs"
    o["g2_ecef_to_geodetic"] = f"SELECT pulse_index, {_r('lon + 1.3e-7')} AS lon, {_r('lat + 1.3e-7')} AS lat, {_r('refh + 1.3e-7')} AS h FROM good"
    o["f9_json"] = "SELECT event_id, json_valid(props) AS valid, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events"
    o["e36_cache_keys"] = """SELECT page_id, sha256('{"provider":"provider","url":"' || url || '"}') AS cache_key FROM pages"""
    ms = "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"
    hour = 3_600_000
    o["st1_tumbling_stream"] = f"SELECT {ms} // {hour} * {hour} AS from_ms, ({ms} // {hour} + 1) * {hour} AS to_ms, event_type, count(*) AS n, {_r('avg(value)')} AS mean FROM events GROUP BY 1, 2, 3"
    o["st2_sliding_stream"] = f"SELECT ({ms} // {hour} - k) * {hour} AS from_ms, ({ms} // {hour} - k + 2) * {hour} AS to_ms, count(*) AS n, {_r('max(value)')} AS top FROM events, (SELECT unnest([0, 1]) AS k) AS o GROUP BY 1, 2"
    o["st3_session_stream"] = f"""
        WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER u + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT min({ms}) AS from_ms, CAST(floor(epoch_us(max(ts) + INTERVAL 30 MINUTE) / 1000) AS BIGINT) AS to_ms, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
    o["st4_latest_stream"] = f"SELECT event_id, event_type, {_r('value')} AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1"
    o["st5_stateful_visits"] = f"SELECT user_id, event_id, row_number() OVER u AS n, m - lag(m) OVER u AS gap_ms FROM (SELECT *, {ms} AS m FROM events) AS e WINDOW u AS (PARTITION BY user_id ORDER BY m, event_id)"
    return {name: with_tables(d, text) for name, text in o.items()}
