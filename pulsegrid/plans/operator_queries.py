"""Queries of the DataFrame operators: joins by distance, rasters, waveforms, geodesy, samples, streams (§2.4, 2.10-2.14)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import atmosphere, geodesy
from pulsegrid.operators import beam_rules, raster, sampling, spatial, waveform
from pulsegrid.operators.lineage import shared
from pulsegrid.plans.binding import for_spark, with_tables
from pulsegrid.plans.dialect import Dialect
from pulsegrid.plans.statistics_queries import _r
from pulsegrid.sources import readers

Query = Callable[[SparkSession, str], DataFrame]


def bound(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    sql, used = for_spark(with_tables(Dialect(True), body))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in used})


def rounded(df: DataFrame, n: int = 5) -> DataFrame:
    """As _r of the SQL plans, for every double column."""
    return df.select(*[(F.round(F.col(c) + 1.7e-9, n) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


PULSES, GOOD, REFS, STATIONS, WAVES = (f"SELECT * FROM {t}" for t in ("pulses", "good", "refs", "stations", "waves"))
CENTRES = "SELECT ix * 100000 + iy AS rid, (ix + 5e-1) * 4 AS x, (iy + 5e-1) * 4 AS y, z FROM (SELECT CAST(floor(x / 4e0) AS BIGINT) AS ix, CAST(floor(y / 4e0) AS BIGINT) AS iy, min(refh) AS z FROM good WHERE snr >= 5 GROUP BY 1, 2) AS g"


def _near(left: str, right: str, radius: float, left_id: str, right_id: str, more: str = "", axes: tuple[str, ...] = ("x", "y")) -> str:
    """Pairs within the radius, in the oracle's SQL, by the same cells."""
    cell = ", ".join(f"CAST(floor({a} / {radius}e0) AS BIGINT) AS c{a}" for a in axes)
    square = " + ".join(f"(a.{a} - b.{a}) * (a.{a} - b.{a})" for a in axes)
    spread = f"(SELECT b0.*, {', '.join(f'c{a} + o{a}.k AS k{a}' for a in axes)} FROM (SELECT *, {cell} FROM {right}) AS b0, {', '.join(f'(SELECT unnest([-1, 0, 1]) AS k) AS o{a}' for a in axes)})"
    return f"SELECT a.{left_id} AS aid, b.{right_id} AS bid, sqrt({square}) AS dist{more} FROM (SELECT *, {cell} FROM {left}) AS a JOIN {spread} AS b ON {' AND '.join(f'a.c{a} = b.k{a}' for a in axes)} AND {square} <= {radius}e0 * {radius}e0"


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def query(name: str):
        def add(f: Query) -> Query:
            q[name] = f
            return f

        return add

    @query("j5_idw_ground_join")
    def _(spark, d):
        return rounded(spatial.idw(bound(spark, d, STATIONS).drop("z"), bound(spark, d, CENTRES), "z", 12, 2.0, 30.0, "station_id", "rid"), 4)

    @query("j6_idw_fill")
    def _(spark, d):
        known = raster.grid(bound(spark, d, GOOD), "refh", 4.0, 0.1, 3).select("ix", "iy", "z")
        shared(spark, "j6")
        return rounded(raster.filled_idw(known, raster.dilated(known.select("ix", "iy")), 4.0, 8, 2.0, 12.0), 3)

    @query("j7_idw_reference")
    def _(spark, d):
        return rounded(spatial.idw(bound(spark, d, STATIONS).drop("z"), bound(spark, d, REFS), "z", 8, 3.0, 20.0, "station_id", "ref_id"), 4)

    @query("j8_density")
    def _(spark, d):
        n = spatial.radius_counts(bound(spark, d, GOOD), 3.0, "pulse_index")
        return rounded(n.withColumn("density", F.col("n") / (4 / 3 * 3.141592653589793 * 27)))

    @query("j9_nearest_support")
    def _(spark, d):
        near = spatial.cell_join(bound(spark, d, STATIONS).drop("z"), bound(spark, d, REFS), 25.0)
        return rounded(near.groupBy("station_id").agg(F.count("*").alias("n"), F.min("dist").alias("nearest"), F.min_by("r_ref_id", F.struct("dist", "r_ref_id")).alias("ref_id")))

    @query("j10_neighbourhood")
    def _(spark, d):
        return rounded(spatial.neighbourhood(bound(spark, d, STATIONS).drop("z"), bound(spark, d, GOOD), "refh", 3.0, "station_id", 3))

    @query("j11_majority_vote")
    def _(spark, d):
        return rounded(spatial.majority(bound(spark, d, STATIONS), bound(spark, d, REFS), "class", 12, 30.0, "station_id", "ref_id"))

    @query("j12_local_plane")
    def _(spark, d):
        found = spatial.ground_surface(bound(spark, d, STATIONS), bound(spark, d, REFS), "z", 32, 30.0, "station_id", "ref_id", most_slope=0.3, most_residual=0.05)
        return rounded(found.drop("condition"), 4)

    @query("j13_local_features")
    def _(spark, d):
        return rounded(spatial.local_features(bound(spark, d, STATIONS), bound(spark, d, REFS), 24, 30.0, "station_id", "ref_id"), 4)

    @query("j14_near_semi_join")
    def _(spark, d):
        return spatial.cell_join(bound(spark, d, "SELECT ref_id, x, y FROM refs WHERE class = 2"), bound(spark, d, "SELECT station_id, x, y FROM stations"), 3.6, how="left_semi").select("ref_id")

    @query("j15_point_in_polygon")
    def _(spark, d):
        rois = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0), (100.0, 60.0), (50.0, 20.0), (0.0, 60.0)]), (2, [(80.0, 10.0), (180.0, 40.0), (120.0, 150.0)])], "roi_id bigint, ring array<struct<x:double,y:double>>")
        return spatial.in_polygon(bound(spark, d, "SELECT pulse_index, x, y FROM good"), rois, "pulse_index")

    @query("r4_hole_filling")
    def _(spark, d):
        shared(spark, "r4")
        return raster.without_holes(bound(spark, d, "SELECT DISTINCT CAST(floor(x / 20e0) AS BIGINT) AS ix, CAST(floor(y / 20e0) AS BIGINT) AS iy FROM good WHERE snr > 9"))

    @query("r5_nearest_fill")
    def _(spark, d):
        known = raster.grid(bound(spark, d, GOOD), "refh", 4.0, 0.1, 4).select("ix", "iy", "z")
        return rounded(raster.filled_nearest(known, raster.dilated(known.select("ix", "iy")), 4.0, 10.0))

    @query("r10_ground_surface")
    def _(spark, d):
        shared(spark, "r10")
        return rounded(raster.ground(bound(spark, d, GOOD)))

    @query("pipeline_surface_model")
    def _(spark, d):
        return rounded(raster.surface(bound(spark, d, GOOD)), 3)

    @query("pipeline_classify_points")
    def _(spark, d):
        shared(spark, "classify")
        return rounded(raster.classified(bound(spark, d, GOOD)))

    def _(spark, d):
        points = bound(spark, d, "SELECT ref_id, x, y, z FROM refs")
        near = spatial.knn(points, points, 9, 20.0, "ref_id", "ref_id", ("x", "y")).where("rank > 1")
        mean = near.groupBy("ref_id").agg(F.avg("dist").alias("m"))
        s = mean.agg((F.avg("m") + 2 * F.stddev_pop("m")).alias("limit"))
        return mean.join(F.broadcast(s)).select("ref_id", (F.col("m") > F.col("limit")).alias("outlier"))

    # ---- geodesy
    @query("g2_ecef_to_geodetic")
    def _(spark, d):
        p = bound(spark, d, GOOD)
        x, y, z = geodesy.to_ecef(F.col("lon"), F.col("lat"), F.col("refh"))
        lon, lat, h = geodesy.from_ecef(F.col("ex"), F.col("ey"), F.col("ez"))
        # off the exact half steps of the data, as the round trip is exact to a billionth only
        return rounded(p.select("pulse_index", x.alias("ex"), y.alias("ey"), z.alias("ez")).select("pulse_index", *[(c + 1.3e-7).alias(n) for c, n in ((lon, "lon"), (lat, "lat"), (h, "h"))]), 5)

    @query("g3_utm_round_trip")
    def _(spark, d):
        p = bound(spark, d, GOOD).withColumn("epsg", geodesy.utm_epsg(F.col("lon"), F.col("lat")))
        east, north = geodesy.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
        p = p.withColumn("east", east).withColumn("north", north)
        lon, lat = geodesy.from_utm(F.col("east"), F.col("north"), F.col("epsg"))
        back = p.withColumn("err", F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))))
        return back.select("pulse_index", F.col("epsg").cast("bigint").alias("epsg"), F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), (F.col("err") < 1e-9).alias("ok"))

    @query("g18_frame_change")
    def _(spark, d):
        # there at the pulse's own epoch, and back; off the exact half steps, as in g2
        epoch = F.lit(1970.0) + F.col("delta_time") / (365.25 * 86400)
        at = bound(spark, d, GOOD).withColumn("epoch", epoch)
        at = at.select("pulse_index", "epoch", *[c.alias(n) for c, n in zip(geodesy.to_ecef(F.col("lon"), F.col("lat"), F.col("refh")), "xyz", strict=True)])
        there = at.select("*", *[c.alias(n) for c, n in zip(geodesy.change_frame(*(F.col(c) for c in "xyz"), F.col("epoch")), "uvw", strict=True)])
        back = geodesy.change_frame(*(F.col(c) for c in "uvw"), F.col("epoch"), inverse=True)
        off = reduce(F.greatest, [F.abs(b - F.col(c)) for b, c in zip(back, "xyz", strict=True)])
        moved = [F.round((F.col(a) - F.col(b)) * 1000 + 1.3e-3, 1).alias(f"d{b}") for a, b in zip("uvw", "xyz", strict=True)]
        return there.select("pulse_index", *moved, (off < 1e-7).alias("ok"))

    @query("g9_geodesic_distance")
    def _(spark, d):
        return rounded(bound(spark, d, GOOD).select("pulse_index", geodesy.geodesic(F.lit(-86.9), F.lit(40.4), F.col("lon"), F.col("lat")).alias("dist")), 3)

    @query("g12_common_origin")
    def _(spark, d):
        p = bound(spark, d, GOOD).select((F.col("x") / 100).alias("px"), (F.col("y") / 100).alias("py"), F.lit(0.0).alias("pz"), F.col("tax").alias("a"), F.col("discount").alias("b"))
        n = F.sqrt(F.col("a") ** 2 + F.col("b") ** 2 + 1)
        u = {"x": F.col("a") / n, "y": F.col("b") / n, "z": -1 / n}
        terms = {f"m{i}{j}": F.sum((1.0 if i == j else 0.0) - u[i] * u[j]) for i, j in ("xx", "xy", "xz", "yy", "yz", "zz")}
        right = {f"v{i}": F.sum(reduce(lambda s, j: s + ((1.0 if i == j else 0.0) - u[i] * u[j]) * F.col(f"p{j}"), "xyz", F.lit(0.0))) for i in "xyz"}
        s = p.agg(*[c.alias(k) for k, c in {**terms, **right}.items()])
        det = F.expr("mxx * (myy * mzz - myz * myz) - mxy * (mxy * mzz - myz * mxz) + mxz * (mxy * myz - myy * mxz)")
        ox = F.expr("vx * (myy * mzz - myz * myz) - mxy * (vy * mzz - myz * vz) + mxz * (vy * myz - myy * vz)") / det
        oy = F.expr("mxx * (vy * mzz - myz * vz) - vx * (mxy * mzz - myz * mxz) + mxz * (mxy * vz - vy * mxz)") / det
        oz = F.expr("mxx * (myy * vz - vy * myz) - mxy * (mxy * vz - vy * mxz) + vx * (mxy * myz - myy * mxz)") / det
        return rounded(s.select(ox.alias("ox"), oy.alias("oy"), oz.alias("oz")))

    @query("g13_rule_scoring")
    def _(spark, d):
        shared(spark, "g13")
        # beams from a platform by a known convention: depression in the first column, azimuth from the east, counter-clockwise, in the second
        points = bound(spark, d, """SELECT a, b, ix + r * cos(radians(a)) * sin(radians(90 - b - 2e-2)) + snr * 1e-2 AS x, iy + r * cos(radians(a)) * cos(radians(90 - b - 2e-2)) AS y, 8000 - r * sin(radians(a)) AS z, ix, iy, 8000e0 AS iz
            FROM (SELECT 84 + discount * 40 AS a, tax * 500 AS b, x * 1e-3 AS ix, y * 1e-3 AS iy, 7000 + amp AS r, snr FROM good) AS beams""")
        return rounded(beam_rules.search(points, ("a", "b"), ("x", "y", "z"), ("ix", "iy", "iz")).drop("origin_condition"), 4)

    # ---- waveforms
    for name, make in {
        "v3_smoothing": lambda w: waveform.smoothed(w, "pulse_index", "rx").select("pulse_index", F.posexplode("smooth").alias("bin", "smooth")).select("pulse_index", F.col("bin").cast("bigint").alias("bin"), (F.round(F.col("smooth") + 1.7e-9, 5) + 0.0).alias("smooth")),
        "v8_response_features": lambda w: waveform.responses(w, "pulse_index", "rx"),
        "v19_morphology": lambda w: waveform.morphology(w, "pulse_index", "rx"),
    }.items():
        q[name] = lambda spark, d, make=make: make(bound(spark, d, WAVES))

    @query("v16_gaussian_fit")
    def _(spark, d):
        # returns of one or two surfaces at places that the stations' numbers give, over a slight ripple
        bumps = "(20 + station_id % 7) * exp(-power(k - (22 + station_id % 11), 2) / (2 * power(2e0 + station_id % 3 * 5e-1, 2))) + CASE WHEN station_id % 2 = 0 THEN (12 + station_id % 5) * exp(-power(k - (60 + station_id % 13), 2) / (2 * power(3e0, 2))) ELSE 0e0 END"
        made = bound(spark, d, f"SELECT station_id, transform(sequence(0, 95), k -> {bumps} + 2e-2 * sin(k * (3 + station_id % 5))) AS rx FROM stations")
        return waveform.gaussians(made, "station_id", "rx").select("station_id", "rank", F.round("centre", 1).alias("centre"), F.round("sigma", 1).alias("sigma"), F.round("amplitude").alias("amplitude"))

    # ---- samples
    for name, make in {
        "t7_random_sample": lambda p: sampling.sample(p, "pulse_index", 500),
        "t8_reservoir": lambda p: sampling.reservoir(p, "pulse_index", 500),
        "t9_stratified_sample": lambda p: sampling.stratified(p, F.least(F.floor(F.col("snr") / 2), F.lit(4)), "pulse_index", 600, 5),
        "t10_per_group_cap": lambda p: sampling.per_group(p, ["track_num"], "pulse_index", 40),
    }.items():
        q[name] = lambda spark, d, make=make: make(bound(spark, d, "SELECT pulse_index, track_num, snr FROM pulses"))
    q["t12_farthest_points"] = lambda spark, d: sampling.farthest(bound(spark, d, "SELECT station_id, x, y FROM stations"), "station_id", ("x", "y"), 12)

    @query("a43_block_bootstrap")
    def _(spark, d):
        return rounded(sampling.block_bootstrap(bound(spark, d, "SELECT CAST(floor(x / 20e0) AS BIGINT) AS block, r FROM residuals"), "block", "r"))

    @query("f13_excess_path")
    def _(spark, d):
        heights = "array(100D, 950D, 1800D, 2800D, 4100D, 5600D, 7300D, 9400D, 11800D, 16000D, 20000D, 26000D)"
        profiles = bound(spark, d, f"""SELECT station_id, array(1000D, 900D, 800D, 700D, 600D, 500D, 400D, 300D, 200D, 100D, 50D, 20D) AS level_hpa, transform({heights}, h -> 286.15D - 0.0065D * h + site * 0.3D) AS temperature_k,
            transform({heights}, h -> 0.01D * exp(-h / 2500D)) AS humidity, transform({heights}, h -> h * 9.80665D) AS geopotential, 101325D - station_id % 5 * 2500D AS surface_pa, z AS ground_m, 8000D + station_id AS instrument_m, radians(85D + station_id % 5) AS elevation_rad FROM stations""")
        found = atmosphere.excess_path(profiles)
        return found.select("station_id", "path_status", F.round("zenith_path", 7).alias("zenith_path"), F.round("slant_path", 7).alias("slant_path"), F.round("surface_refractivity", 11).alias("surface_refractivity"), F.round("instrument_refractivity", 11).alias("instrument_refractivity"))

    # ---- sources and sinks
    q["s6_optional_columns"] = lambda spark, d: readers.with_default(bound(spark, d, "SELECT pulse_index, refh FROM pulses"), "geoid", 0.0)
    q["s7_attributes"] = lambda spark, d: readers.attributes(bound(spark, d, PULSES))
    q["s15_labelled_reference"] = lambda spark, d: bound(spark, d, "SELECT ref_id, class, tile FROM refs").withColumn("provenance", F.lit("part"))

    @query("k3_stable_parquet")
    def _(spark, d):
        path = shared(spark, "k3")
        readers.write_stable(bound(spark, d, "SELECT pulse_index, track_num, snr FROM good"), path)
        return spark.read.parquet(path)

    @query("k4_csv_summary")
    def _(spark, d):
        # a summary of each track, and a table of outliers for each threshold, written and read as CSV
        path, points = shared(spark, "k4"), bound(spark, d, "SELECT track_num, pulse_index, r FROM residuals")
        points.groupBy("track_num").agg(F.count("*").alias("n"), F.max(F.abs("r")).alias("top")).write.csv(f"{path}/summary", header=True)
        limits = F.explode(F.array(*[F.lit(x) for x in (2.0, 5.0, 8.0)])).alias("threshold")
        points.select("track_num", "pulse_index", "r", limits).where(F.abs("r") > F.col("threshold")).write.partitionBy("threshold").csv(f"{path}/outliers", header=True)
        beyond = spark.read.csv(f"{path}/outliers", header=True, schema="track_num bigint, pulse_index bigint, r double, threshold double")
        told = spark.read.csv(f"{path}/summary", header=True, schema="track_num bigint, n bigint, top double")
        return rounded(beyond.groupBy("track_num", "threshold").agg(F.count("*").alias("n_beyond"), F.min("pulse_index").alias("first_id"), F.avg("r").alias("mean")).join(told, "track_num"))

    @query("f9_json")
    def _(spark, d):
        return bound(spark, d, "SELECT event_id, props FROM events").select("event_id", F.to_json(F.from_json("props", "map<string,string>")).isNotNull().alias("valid"), F.size(F.map_keys(F.from_json("props", "map<string,string>"))).cast("bigint").alias("n_keys"))

    @query("e36_cache_keys")
    def _(spark, d):
        return bound(spark, d, "SELECT page_id, url FROM pages").select("page_id", F.sha2(F.to_json(F.struct(F.lit("provider").alias("provider"), F.col("url").alias("url"))), 256).alias("cache_key"))

    return q


def oracle_sql() -> dict[str, str]:
    d = Dialect(False)
    st, rf = "stations", "refs"
    knn = lambda left, right, r, a, b, k, more="", axes=("x", "y"): f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY dist, bid) AS rank FROM ({_near(left, right, r, a, b, more, axes)}) AS n) AS m WHERE rank <= {k}"
    blend = lambda left, right, r, a, b, k, p, n: f"WITH k AS ({knn(left, right, r, a, b, k, ', b.z AS v')}) SELECT aid AS {a}, count(*) AS n, {_r('min(dist)', n)} AS nearest, {_r(f'CASE WHEN min(dist) = 0 THEN min_by(v, rank) ELSE sum(v / power(greatest(dist, 1e-12), {p})) / sum(1 / power(greatest(dist, 1e-12), {p})) END', n)} AS value FROM k GROUP BY aid"
    fit = "avg(dx) AS x0, avg(dy) AS y0, avg(z) AS z0, covar_pop(dx, dx) AS cxx, covar_pop(dx, dy) AS cxy, covar_pop(dy, dy) AS cyy, covar_pop(dx, z) AS cxz, covar_pop(dy, z) AS cyz"
    solved = "(cxz * cyy - cyz * cxy) / (cxx * cyy - cxy * cxy) AS sx, (cyz * cxx - cxz * cxy) / (cxx * cyy - cxy * cxy) AS sy"
    # refractivity of standard dry air and vapour over their densities, at 1.04 micrometres and 420 ppm
    wave, mass = 1 / 1.04**2, (28.9635 + 12.011e-6 * 20) * 1e-3
    still = lambda p, c, x: p / ((1 - p / (c + 273.15) * (1.58123e-6 - 2.9331e-8 * c + 1.1043e-10 * c * c + (5.707e-6 - 2.051e-8 * c) * x + (1.9898e-4 - 2.376e-6 * c) * x * x) + (p / (c + 273.15)) ** 2 * (1.83e-11 - 0.765e-8 * x * x)) * 8.31451 * (c + 273.15))
    dry = (5792105.0 * (238.0185 + wave) / (238.0185 - wave) ** 2 + 167917.0 * (57.362 + wave) / (57.362 - wave) ** 2) * (1 - 30 * 0.534e-6) / (still(101325.0, 15.0, 0) * mass)
    wet = 1.022 * (295.235 + 3 * 2.6422 * wave - 5 * 0.032380 * wave**2 + 7 * 0.004028 * wave**3) / (still(1333.0, 20.0, 1) * 0.018015)
    # least-squares parabola over seven samples: the row of its hat matrix for each place in the window
    design = np.vander(np.arange(-3, 4), 3, increasing=True)
    hat = design @ np.linalg.pinv(design)
    term = lambda row, first: " + ".join(f"{float(h)!r} * CAST(rx[{first} + {k}] AS DOUBLE)" for k, h in enumerate(hat[row]))
    smooth = "CASE " + " ".join(f"WHEN i = {j} THEN {term(j, 1)} WHEN i = n - {j + 1} THEN {term(6 - j, 'n - 6')}" for j in range(3)) + f" ELSE {term(3, 'i - 2')} END"
    poisson = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
    steps = ["n AS (SELECT station_id, x, y, (x - min(x) OVER ()) / greatest(1e-12, max(x) OVER () - min(x) OVER ()) AS u, (y - min(y) OVER ()) / greatest(1e-12, max(y) OVER () - min(y) OVER ()) AS v FROM stations)", "c0 AS (SELECT * FROM n ORDER BY pow(u - 0.5, 2) + pow(v - 0.5, 2), station_id LIMIT 1)"]
    for k in range(1, 12):
        steps.append(f"c{k} AS (SELECT * FROM c{k - 1} UNION ALL (SELECT n.* FROM n, c{k - 1} AS c GROUP BY ALL ORDER BY min(pow(n.u - c.u, 2) + pow(n.v - c.v, 2)) DESC, n.station_id LIMIT 1))")
    farthest = f"WITH {', '.join(steps)} SELECT DISTINCT station_id, x, y FROM c11"
    o = {
        "j5_idw_ground_join": blend("stations", f"({CENTRES}) AS c", 30, "station_id", "rid", 12, 2, 4),
        "k4_csv_summary": f"""
            WITH t AS (SELECT track_num, count(*) AS n, max(abs(r)) AS top FROM residuals GROUP BY track_num)
            SELECT track_num, threshold, count(*) AS n_beyond, min(pulse_index) AS first_id, {_r('avg(r)')} AS mean, any_value(t.n) AS n, {_r('any_value(t.top)')} AS top FROM residuals JOIN t USING (track_num), (SELECT unnest([2e0, 5e0, 8e0]) AS threshold) AS l WHERE abs(r) > threshold GROUP BY track_num, threshold""",
        "g12_common_origin": f"""
            WITH l AS (SELECT x / 100 AS px, y / 100 AS py, tax / sqrt(tax * tax + discount * discount + 1) AS ux, discount / sqrt(tax * tax + discount * discount + 1) AS uy, -1 / sqrt(tax * tax + discount * discount + 1) AS uz FROM good),
            s AS (SELECT sum(1 - ux * ux) AS a, sum(-ux * uy) AS b, sum(-ux * uz) AS c, sum(1 - uy * uy) AS e, sum(-uy * uz) AS f, sum(1 - uz * uz) AS i, sum(px - ux * (ux * px + uy * py)) AS v1, sum(py - uy * (ux * px + uy * py)) AS v2, sum(-uz * (ux * px + uy * py)) AS v3 FROM l),
            d AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM s)
            SELECT {_r('(v1 * (e * i - f * f) - v2 * (b * i - c * f) + v3 * (b * f - c * e)) / det')} AS ox, {_r('(-v1 * (b * i - f * c) + v2 * (a * i - c * c) - v3 * (a * f - b * c)) / det')} AS oy, {_r('(v1 * (b * f - e * c) - v2 * (a * f - b * c) + v3 * (a * e - b * b)) / det')} AS oz FROM d""",
        "v16_gaussian_fit": """
            SELECT station_id, 1 AS rank, 22e0 + station_id % 11 AS centre, 2e0 + station_id % 3 * 5e-1 AS sigma, 20e0 + station_id % 7 AS amplitude FROM stations
            UNION ALL SELECT station_id, 2, 60e0 + station_id % 13, 3e0, 12e0 + station_id % 5 FROM stations WHERE station_id % 2 = 0""",
        "v3_smoothing": f"WITH b AS (SELECT w.pulse_index, k - 1 AS i, len(rx) AS n, rx FROM waves w, unnest(generate_series(1, len(rx))) AS t(k)) SELECT pulse_index, i AS bin, {_r(smooth)} AS smooth FROM b",
        "g18_frame_change": """
            WITH p AS (SELECT *, 1970 + delta_time / (365.25e0 * 86400) - 2010 AS dt, 6378137e0 / sqrt(1 - 0.00669437999014e0 * pow(sin(radians(lat)), 2)) AS n FROM good),
            e AS (SELECT pulse_index, dt, (n + refh) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + refh) * cos(radians(lat)) * sin(radians(lon)) AS y, (n * (1 - 0.00669437999014e0) + refh) * sin(radians(lat)) AS z, (-0.02e0 + 0.03e0 * dt) * 1e-9 AS d FROM p)
            SELECT pulse_index, round(1.6e0 + d * x * 1000 + 1.3e-3, 1) AS dx, round(1.9e0 + d * y * 1000 + 1.3e-3, 1) AS dy, round(2.4e0 - 0.1e0 * dt + d * z * 1000 + 1.3e-3, 1) AS dz, true AS ok FROM e""",
        "j6_idw_fill": f"""
            WITH k AS (SELECT CAST(floor(x / 4) AS BIGINT) AS ix, CAST(floor(y / 4) AS BIGINT) AS iy, quantile_cont(refh, 0.1) AS z FROM good GROUP BY 1, 2 HAVING count(*) >= 3),
            w AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM k, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dx, dy)), m AS (SELECT * FROM w ANTI JOIN k USING (ix, iy)),
            n AS (SELECT m.ix, m.iy, k.z, 4 * sqrt(pow(m.ix - k.ix, 2) + pow(m.iy - k.iy, 2)) AS dist, row_number() OVER (PARTITION BY m.ix, m.iy ORDER BY pow(m.ix - k.ix, 2) + pow(m.iy - k.iy, 2), k.ix, k.iy) AS r FROM m JOIN k ON abs(m.ix - k.ix) <= 3 AND abs(m.iy - k.iy) <= 3 AND pow(m.ix - k.ix, 2) + pow(m.iy - k.iy, 2) <= 9)
            SELECT ix, iy, {_r('z', 3)} AS z, 1 AS source FROM k UNION ALL SELECT ix, iy, {_r('sum(z / (dist * dist)) / sum(1 / (dist * dist))', 3)}, 2 FROM n WHERE r <= 8 GROUP BY ix, iy""",
        "r5_nearest_fill": f"""
            WITH k AS (SELECT CAST(floor(x / 4) AS BIGINT) AS ix, CAST(floor(y / 4) AS BIGINT) AS iy, quantile_cont(refh, 0.1) AS z FROM good GROUP BY 1, 2 HAVING count(*) >= 4),
            w AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM k, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dx, dy)),
            n AS (SELECT w.ix, w.iy, k.z, 16 * (pow(w.ix - k.ix, 2) + pow(w.iy - k.iy, 2)) AS sq, k.ix AS kx, k.iy AS ky FROM w JOIN k ON abs(w.ix - k.ix) <= 2 AND abs(w.iy - k.iy) <= 2)
            SELECT ix, iy, {_r('z')} AS z, {_r('sqrt(sq)')} AS dist FROM n WHERE sq <= 100 QUALIFY row_number() OVER (PARTITION BY ix, iy ORDER BY sq, kx, ky) = 1""",
        "j15_point_in_polygon": """
            WITH e AS (SELECT * FROM (VALUES (1, 0e0, 0e0, 100e0, 0e0), (1, 100, 0, 100, 60), (1, 100, 60, 50, 20), (1, 50, 20, 0, 60), (1, 0, 60, 0, 0), (2, 80, 10, 180, 40), (2, 180, 40, 120, 150), (2, 120, 150, 80, 10)) AS v(roi, ax, ay, zx, zy)),
            h AS (SELECT pulse_index, e.roi FROM good, e WHERE (ay > y) <> (zy > y) AND x < (zx - ax) * (y - ay) / (zy - ay) + ax GROUP BY pulse_index, e.roi HAVING count(*) % 2 = 1)
            SELECT pulse_index, CAST(CASE WHEN count(*) = 1 THEN min(roi) END AS BIGINT) AS roi_id, count(*) > 1 AS ambiguous FROM h GROUP BY pulse_index""",
        "t7_random_sample": "SELECT pulse_index, track_num, snr FROM pulses ORDER BY md5(pulse_index || ':0'), pulse_index LIMIT 500",
        "t8_reservoir": "SELECT pulse_index, track_num, snr FROM pulses ORDER BY md5(pulse_index || ':0') DESC, pulse_index DESC LIMIT 500",
        "t9_stratified_sample": """
            WITH b AS (SELECT pulse_index, track_num, snr, row_number() OVER (PARTITION BY least(floor(snr / 2), 4) ORDER BY md5(pulse_index || ':0'), pulse_index) AS k FROM pulses)
            SELECT pulse_index, track_num, snr FROM b WHERE k <= 60 UNION ALL (SELECT pulse_index, track_num, snr FROM b WHERE k > 60 ORDER BY md5(pulse_index || ':1'), pulse_index LIMIT 300)""",
        "t10_per_group_cap": "SELECT pulse_index, track_num, snr FROM pulses QUALIFY row_number() OVER (PARTITION BY track_num ORDER BY md5(pulse_index || ':0'), pulse_index) <= 40",
        "t12_farthest_points": farthest,
        "a43_block_bootstrap": f"""
            WITH b AS (SELECT CAST(floor(x / 20) AS BIGINT) AS block, sum(r) AS s, count(r) AS c FROM residuals GROUP BY 1),
            u AS (SELECT rep, s, c, CAST('0x' || substr(md5(rep || ':' || block), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM b, (SELECT unnest(generate_series(0, 199)) AS rep) AS r),
            w AS (SELECT *, {' + '.join(f'(u >= {t!r})::INT' for t in poisson)} AS w FROM u), m AS (SELECT rep, sum(w * s) / nullif(sum(w * c), 0) AS mean FROM w GROUP BY rep)
            SELECT {_r('quantile_cont(mean, 0.025)')} AS low, {_r('quantile_cont(mean, 0.975)')} AS high, count(*) AS n FROM m""",
        "f13_excess_path": f"""
            WITH s AS (SELECT *, 101325e0 - station_id % 5 * 2500e0 AS ps, 8000e0 + station_id AS top FROM stations), v AS (SELECT unnest([1000e0, 900, 800, 700, 600, 500, 400, 300, 200, 100, 50, 20]) AS p, unnest([100e0, 950, 1800, 2800, 4100, 5600, 7300, 9400, 11800, 16000, 20000, 26000]) AS h),
            l AS (SELECT station_id, z, ps, top, h, ln(p * 100) AS lp, 286.15 - 0.0065 * h + site * 0.3 AS t, 0.01 * exp(-h / 2500) AS q FROM s, v WHERE p * 100 < ps),
            e AS (SELECT station_id, ps, pos, arg_max(h, h) FILTER (h <= pos) AS h0, arg_max(lp, h) FILTER (h <= pos) AS lp0, arg_max(t, h) FILTER (h <= pos) AS t0, arg_max(q, h) FILTER (h <= pos) AS q0, arg_min(h, h) FILTER (h > pos) AS h1, arg_min(lp, h) FILTER (h > pos) AS lp1, arg_min(t, h) FILTER (h > pos) AS t1, arg_min(q, h) FILTER (h > pos) AS q1, any_value(pos = z) AS low
                FROM l, LATERAL (SELECT unnest([z, top]) AS pos) AS a GROUP BY station_id, ps, pos),
            n AS (SELECT station_id, h, exp(lp) AS p, t - 273.15 AS c, q FROM l WHERE h > z AND h < top UNION ALL
                SELECT station_id, pos, CASE WHEN low THEN ps ELSE exp(coalesce(lp0 + (lp1 - lp0) * (pos - h0) / (h1 - h0), lp1, lp0)) END, coalesce(t0 + (t1 - t0) * (pos - h0) / (h1 - h0), t1, t0) - 273.15, coalesce(q0 + (q1 - q0) * (pos - h0) / (h1 - h0), q1, q0) FROM e),
            x AS (SELECT *, q / 0.018015 / (q / 0.018015 + (1 - q) / {mass!r}) AS x FROM n),
            d AS (SELECT *, p / ((1 - p / (c + 273.15) * (1.58123e-6 - 2.9331e-8 * c + 1.1043e-10 * c * c + (5.707e-6 - 2.051e-8 * c) * x + (1.9898e-4 - 2.376e-6 * c) * x * x) + pow(p / (c + 273.15), 2) * (1.83e-11 - 0.765e-8 * x * x)) * 8.31451 * (c + 273.15)) AS dens FROM x),
            r AS (SELECT station_id, h, ({dry!r} * dens * {mass!r} * (1 - x) + {wet!r} * dens * 0.018015 * x) * 1e-8 AS n FROM d),
            g AS (SELECT *, (h - lag(h) OVER w) * (n + lag(n) OVER w) / 2 AS part FROM r WINDOW w AS (PARTITION BY station_id ORDER BY h)),
            t AS (SELECT station_id, sum(part) AS zen, arg_min(n, h) AS low, arg_max(n, h) AS top FROM g GROUP BY station_id),
            b AS (SELECT s.station_id, CASE WHEN count(h) < 3 THEN 'few_levels' WHEN NOT any_value(s.z < s.top) THEN 'bad_endpoints' WHEN any_value(s.z) < min(h) - 1500 OR any_value(s.top) > max(h) + 1500 THEN 'not_bracketed' ELSE 'integrated' END AS path_status FROM s LEFT JOIN l ON l.station_id = s.station_id GROUP BY s.station_id)
            SELECT b.station_id, path_status, round(zen, 7) AS zenith_path, round(zen / sin(radians(85 + b.station_id % 5)), 7) AS slant_path, round(low, 11) AS surface_refractivity, round(t.top, 11) AS instrument_refractivity FROM b LEFT JOIN t ON t.station_id = b.station_id AND path_status = 'integrated'""",
        "j7_idw_reference": blend(st, rf, 20, "station_id", "ref_id", 8, 3, 4),
        "j8_density": f"SELECT aid AS pulse_index, count(*) AS n, {_r('count(*) / (4 / 3e0 * 3.141592653589793e0 * 27)')} AS density FROM ({_near('good', 'good', 3, 'pulse_index', 'pulse_index', '', ('x', 'y', 'refh'))}) AS n GROUP BY aid",
        "j9_nearest_support": f"SELECT aid AS station_id, count(*) AS n, {_r('min(dist)')} AS nearest, min_by(bid, row(dist, bid)) AS ref_id FROM ({_near(st, rf, 25, 'station_id', 'ref_id')}) AS n GROUP BY aid",
        "j10_neighbourhood": f"WITH n AS ({_near(st, 'good', 3, 'station_id', 'pulse_index', ', b.refh AS v')}), m AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY aid) AS m FROM n) SELECT aid AS station_id, count(*) AS n, {_r('max(m)')} AS med, {_r('1.4826e0 * quantile_cont(abs(v - m), 0.5)')} AS nmad, {_r('quantile_cont(v, 0.05)')} AS p05, {_r('quantile_cont(v, 0.95)')} AS p95 FROM m GROUP BY aid HAVING count(*) >= 3",
        "j11_majority_vote": f"WITH k AS ({knn(st, rf, 30, 'station_id', 'ref_id', 12, ', b.class AS c', ('x', 'y', 'z'))}), v AS (SELECT aid, c, count(*) AS votes FROM k GROUP BY 1, 2), w AS (SELECT *, sum(votes) OVER (PARTITION BY aid) AS n, row_number() OVER (PARTITION BY aid ORDER BY votes DESC, c) AS pos FROM v) SELECT aid AS station_id, c AS label, {_r('votes / n')} AS ratio, CAST(CASE WHEN votes / n >= 75e-2 THEN 0 WHEN votes / n > 5e-1 THEN 1 ELSE 3 END AS BIGINT) AS status FROM w WHERE pos = 1",
        "j12_local_plane": f"""
            WITH k AS ({knn(st, rf, 30, 'station_id', 'ref_id', 32, ', b.x - a.x AS dx, b.y - a.y AS dy, b.z AS z')}),
            c AS (SELECT aid, count(*) AS n, min(dist) AS nearest, median(z) AS base FROM k GROUP BY aid),
            f AS (SELECT aid, {fit} FROM k JOIN c USING (aid) WHERE n >= 6 GROUP BY aid), g AS (SELECT *, {solved} FROM f),
            r AS (SELECT k.*, z - z0 - sx * (dx - x0) - sy * (dy - y0) AS e FROM k JOIN g USING (aid)),
            m AS (SELECT aid, median(e) AS em FROM r GROUP BY aid), w AS (SELECT aid, any_value(em) AS em, greatest(3 * 1.4826e0 * median(abs(e - em)), 0.02) AS lim FROM r JOIN m USING (aid) GROUP BY aid),
            i AS (SELECT r.* FROM r JOIN w USING (aid) WHERE abs(e - em) <= lim), f2 AS (SELECT aid, count(*) AS used, median(z) AS med, {fit} FROM i GROUP BY aid), g2 AS (SELECT *, {solved} FROM f2),
            r2 AS (SELECT i.aid, z - z0 - sx * (dx - x0) - sy * (dy - y0) AS e FROM i JOIN g2 USING (aid)), m2 AS (SELECT aid, median(e) AS em FROM r2 GROUP BY aid),
            w2 AS (SELECT aid, any_value(em) AS em, 1.4826e0 * median(abs(e - em)) AS res FROM r2 JOIN m2 USING (aid) GROUP BY aid),
            ro AS (SELECT aid, 1.4826e0 * median(abs(z - base)) AS rough FROM k JOIN c USING (aid) GROUP BY aid),
            o AS (SELECT s.station_id, coalesce(n, 0) AS n, coalesce(used, 0) AS used, nearest, z0 - sx * x0 - sy * y0 + em AS plane, med AS median, degrees(atan(sqrt(sx * sx + sy * sy))) AS slope, res AS residual, CASE WHEN used IS NOT NULL THEN rough END AS rough
                FROM stations s LEFT JOIN c ON c.aid = s.station_id LEFT JOIN g2 ON g2.aid = s.station_id LEFT JOIN w2 ON w2.aid = s.station_id LEFT JOIN ro ON ro.aid = s.station_id)
            SELECT station_id, n, used, {_r('nearest', 4)} AS nearest, {_r('plane', 4)} AS plane, {_r('median', 4)} AS median, {_r('slope', 4)} AS slope, {_r('residual', 4)} AS residual, {_r('rough', 4)} AS rough, coalesce(slope <= 0.3 AND residual <= 0.05, false) AS acceptable,
                CASE WHEN n < 6 THEN 'insufficient_neighbors' WHEN used = 0 THEN 'ill_conditioned_plane' WHEN slope > 0.3 THEN 'steep_local_surface' WHEN residual > 0.05 THEN 'rough_local_surface' ELSE 'matched' END AS status FROM o""",
        "j14_near_semi_join": f"SELECT DISTINCT aid AS ref_id FROM ({_near('(SELECT * FROM refs WHERE class = 2) AS r', st, 3.6, 'ref_id', 'station_id').replace('3.6e0', '36e-1')}) AS n",
    }
    return {name: with_tables(d, text) for name, text in o.items()}
