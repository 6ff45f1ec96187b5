"""Waveforms with gaps (§2.11): components, roles, features, events, candidates, bin scores; oracles by joins over single bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import waveform
from pulsegrid.operators.lineage import cut, shared
from pulsegrid.plans.binding import with_tables
from pulsegrid.plans.dialect import Dialect
from pulsegrid.plans.operator_queries import bound, rounded
from pulsegrid.plans.statistics_queries import MAD, _r

Query = Callable[[SparkSession, str], DataFrame]
GAPPED = "SELECT * FROM gapped"
BEFORE = waveform.Preprocess("minus_bg_mean")
GATES = waveform.Components(height=1.0, prominence=1.0, width=0.5, distance=1, edge=3, most=6)
ROLES = waveform.Roles(prominence=2.0, relative=0.5, separation=4.0, width=1.0, most_width=6.0)


def _components(spark: SparkSession, d: str) -> DataFrame:
    return waveform.components(bound(spark, d, GAPPED), "pulse_index", "rx", GATES, BEFORE)


def _roles(spark: SparkSession, d: str) -> DataFrame:
    return waveform.roles(_components(spark, d), "pulse_index", ROLES, GATES.edge)


def _features(spark: SparkSession, d: str) -> DataFrame:
    pulses = bound(spark, d, "SELECT pulse_index, snr, snr > 4 AS good, CAST(array_position(rx, array_max(rx)) - 1 AS DOUBLE) AS raw_bin, pulse_index % 64 AS corrected_bin FROM gapped")
    return waveform.pulse_features(pulses, _roles(spark, d), "pulse_index", "raw_bin", "corrected_bin", "snr", "good", 3.0, 3.0)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def query(name: str):
        def add(f: Query) -> Query:
            q[name] = f
            return f

        return add

    @query("v2_preprocess")
    def _(spark, d):
        out = waveform.preprocess(bound(spark, d, GAPPED), "pulse_index", "rx", waveform.Preprocess("minus_refh_thres", clip=True))
        return rounded(out.select("pulse_index", "valid", "sigma", "offset", F.aggregate(F.filter("processed", lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x).alias("energy"), F.size(F.filter("smoothed", lambda x: x.isNotNull())).cast("bigint").alias("n_finite")))

    @query("v4_components")
    def _(spark, d):
        return rounded(_components(spark, d).drop("left_base", "right_base"))

    @query("v5_component_roles")
    def _(spark, d):
        return rounded(_roles(spark, d).select("pulse_index", "bin", "relative", "separation", "is_main", "is_prominent", "is_secondary", "rejected"))

    @query("v6_pulse_features")
    def _(spark, d):
        return rounded(_features(spark, d).select("pulse_index", "n", "n_prominent", "n_secondary", "main_bin", "main_width", "main_area", "secondary_bin", "amplitude_ratio", "prominence_ratio", "main_from_raw", "corrected_from_raw", "has_clear_main", "has_broad_main", "has_weak_main", "low_snr", "reliability"))

    @query("v7_reliability_number")
    def _(spark, d):
        return _features(spark, d).groupBy(waveform.reliability_number("reliability").alias("ordinal")).agg(F.count("*").alias("n"))

    @query("v9_calibrated_candidate")
    def _(spark, d):
        return rounded(waveform.calibrated(bound(spark, d, GAPPED), "pulse_index", "rx", 4.0, 1.5, 1))

    @query("v10_roi_features")
    def _(spark, d):
        members = bound(spark, d, "SELECT pulse_index, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS roi FROM (SELECT vec_id AS pulse_index, label FROM embeddings WHERE vec_id % 3 > 0 UNION ALL SELECT vec_id, label + 1 FROM embeddings WHERE vec_id % 3 = 2) AS m")
        return rounded(waveform.roi_features(bound(spark, d, GAPPED), members, ["pulse_index"], "rx", 4.0, width=1.5, distance=1).select("pulse_index", "roi", "status", "bin", "prominence"))

    @query("v12_bin_scores")
    def _(spark, d):
        return rounded(waveform.bin_scores(bound(spark, d, GAPPED), "track_num", "sweep_num", "rx", 40, 1.5))

    @query("v13_all_bin_events")
    def _(spark, d):
        return rounded(waveform.events(bound(spark, d, GAPPED), ["pulse_index", "track_num", "sweep_num"], "rx", 1.5, 1.0, 1))

    @query("v20_curtain")
    def _(spark, d):
        return rounded(waveform.curtain(bound(spark, d, GAPPED), "pulse_index", "rx", 120.0, 20.0, 41))

    @query("a45_noise_calibration")
    def _(spark, d):
        shared(spark, "a45")
        own = bound(spark, d, "SELECT pulse_index, transform(slice(rx, 1, 32), x -> (x - bg_mean) / bg_std) AS w FROM gapped UNION ALL SELECT -1 - pulse_index, transform(slice(rx, 33, 32), x -> (x - bg_mean) / bg_std) FROM gapped")
        return rounded(waveform.calibrate_noise(cut(waveform.noise_windows(own, "pulse_index", "w", 32)), 200, 0.995, 5, 2000, 2000))

    return q


def _peaks(source: str, height: str = "", flat: bool = False) -> str:
    """Tables over source (pulse_index, bin, z; null in gaps) that end in pk: peaks of each run with prominence and crossings; with
    flat, also the middles of flat tops."""
    keep = f" AND z >= {height}" if height else ""
    tops = f"pz AS (SELECT pulse_index, run, bin, z FROM nz WHERE z > za AND z > zb{keep})"
    if flat:  # a top that reaches an end of its run finds itself there, and is none
        tops = f"""tz AS (SELECT *, count(*) FILTER (z IS DISTINCT FROM za) OVER (PARTITION BY pulse_index, run ORDER BY bin) AS level FROM nz),
        pz AS (SELECT pulse_index, run, (min(bin) + max(bin)) // 2 AS bin, any_value(z) AS z FROM tz GROUP BY pulse_index, run, level HAVING any_value(z) > arg_min(za, bin) AND any_value(z) > arg_max(zb, bin){keep})"""
    return f"""
        wz AS (SELECT *, count(*) FILTER (z IS NULL) OVER (PARTITION BY pulse_index ORDER BY bin) AS run FROM {source}),
        fz AS (SELECT pulse_index, run, bin, z FROM wz WHERE z IS NOT NULL),
        nz AS (SELECT *, lag(z) OVER g AS za, lead(z) OVER g AS zb FROM fz WINDOW g AS (PARTITION BY pulse_index, run ORDER BY bin)),
        {tops},
        lz AS (SELECT p.pulse_index, p.run, p.bin, any_value(p.z) AS z, coalesce(max(f.bin) FILTER (f.bin < p.bin AND f.z > p.z), -1) AS l, coalesce(min(f.bin) FILTER (f.bin > p.bin AND f.z > p.z), 1000000) AS r FROM pz p JOIN fz f USING (pulse_index, run) GROUP BY ALL),
        mz AS (SELECT p.pulse_index, p.run, p.bin, any_value(p.z) AS z, any_value(p.z) - greatest(min(f.z) FILTER (f.bin > l AND f.bin <= p.bin), min(f.z) FILTER (f.bin < r AND f.bin >= p.bin)) AS prom FROM lz p JOIN fz f USING (pulse_index, run) GROUP BY ALL),
        cz AS (SELECT p.pulse_index, p.run, p.bin, any_value(p.z) AS z, any_value(prom) AS prom, any_value(p.z - prom / 2) AS h, max(f.bin) FILTER (f.bin < p.bin AND f.z <= p.z - prom / 2) AS i, min(f.bin) FILTER (f.bin > p.bin AND f.z <= p.z - prom / 2) AS j FROM mz p JOIN fz f USING (pulse_index, run) GROUP BY ALL),
        pk AS (SELECT c.pulse_index, c.bin, c.z, c.prom, c.i + (h - a.z) / (b.z - a.z) AS x0, c.j - (h - e.z) / (d.z - e.z) AS x1 FROM cz c
            JOIN fz a ON a.pulse_index = c.pulse_index AND a.bin = c.i JOIN fz b ON b.pulse_index = c.pulse_index AND b.bin = c.i + 1 JOIN fz e ON e.pulse_index = c.pulse_index AND e.bin = c.j JOIN fz d ON d.pulse_index = c.pulse_index AND d.bin = c.j - 1)"""


def oracle_sql() -> dict[str, str]:
    g = "gb AS (SELECT g.*, k - 1 AS bin, rx[k] AS v FROM gapped g, unnest(generate_series(1, len(rx))) AS t(k))"
    standard = f"WITH {g}, sz AS (SELECT pulse_index, bin, (v - bg_mean) / bg_std AS z FROM gb), {_peaks('sz')}"
    comp = f"""
        WITH {g}, md AS (SELECT pulse_index, median(v) AS m FROM gb GROUP BY pulse_index),
        sg AS (SELECT pulse_index, coalesce(any_value(bg_std), nullif({MAD} * median(abs(v - m)), 0), nullif(stddev_pop(v), 0), 1) AS sigma, any_value(bg_mean) AS off FROM gb JOIN md USING (pulse_index) GROUP BY pulse_index),
        sz AS (SELECT pulse_index, bin, v - bg_mean AS z FROM gb), {_peaks('sz')},
        gz AS (SELECT pk.*, sigma, off FROM pk JOIN sg USING (pulse_index) WHERE z >= sigma AND prom >= sigma AND x1 - x0 >= 0.5),
        co AS (SELECT *, row_number() OVER (PARTITION BY pulse_index ORDER BY prom DESC, bin) AS rank, row_number() OVER (PARTITION BY pulse_index ORDER BY z DESC, bin) AS ra, bin < 3 OR bin > 60 AS edge FROM gz QUALIFY rank <= 6)"""
    role = f"""{comp},
        mn AS (SELECT pulse_index, bin AS mb, prom AS mp FROM co WHERE rank = 1),
        ro AS (SELECT co.*, prom / mp AS rel, abs(bin - mb) AS sep, concat_ws(';', CASE WHEN prom < 2 * sigma THEN 'low_absolute_prominence' END, CASE WHEN rank > 1 AND prom / mp < 0.5 THEN 'low_relative_prominence_to_main' END, CASE WHEN rank > 1 AND abs(bin - mb) < 4 THEN 'too_close_to_main' END,
            CASE WHEN x1 - x0 < 1 THEN 'too_narrow' END, CASE WHEN x1 - x0 > 6 THEN 'too_wide' END, CASE WHEN edge THEN 'edge_exclusion_3bins' END) AS why FROM co JOIN mn USING (pulse_index))"""
    areas = "ar AS (SELECT co.pulse_index, co.bin, sum(greatest(sz.z, 0)) AS area FROM co JOIN sz ON sz.pulse_index = co.pulse_index AND sz.bin BETWEEN floor(x0) AND ceil(x1) GROUP BY 1, 2)"
    feature = f"""{role}, {areas},
        ag AS (SELECT pulse_index, count(*) AS n, count(*) FILTER (rank = 1 OR why = '') AS np, count(*) FILTER (rank > 1 AND why = '') AS ns, min(rank) FILTER (rank > 1 AND why = '') AS second FROM ro GROUP BY pulse_index),
        ft AS (SELECT g.pulse_index, coalesce(ag.n, 0) AS n, coalesce(np, 0) AS n_prominent, coalesce(ns, 0) AS n_secondary, m.bin AS main_bin, m.x1 - m.x0 AS main_width, ar.area AS main_area, s.bin AS secondary_bin, (s.z + s.off) / nullif(m.z + m.off, 0) AS amplitude_ratio, s.prom / m.prom AS prominence_ratio,
            list_position(rx, list_max(rx)) - 1 AS raw_bin, NOT snr > 4 OR snr < 3 AS low_snr, coalesce(m.prom / m.sigma < 3, true) AS weak, coalesce(m.x1 - m.x0 >= 3, false) AS broad
            FROM gapped g LEFT JOIN ag USING (pulse_index) LEFT JOIN ro m ON m.pulse_index = g.pulse_index AND m.rank = 1 LEFT JOIN ro s ON s.pulse_index = g.pulse_index AND s.rank = ag.second LEFT JOIN ar ON ar.pulse_index = m.pulse_index AND ar.bin = m.bin),
        fc AS (SELECT *, n > 0 AND NOT low_snr AS clear, CASE WHEN n = 0 THEN 'no_detected_main_peak' WHEN low_snr AND weak THEN 'low_snr_weak_main_peak' WHEN broad THEN 'broad_main_peak' WHEN n_secondary > 0 THEN 'clear_main_with_secondary_candidate' WHEN NOT low_snr THEN 'clear_main_peak' WHEN weak THEN 'weak_main_peak' ELSE 'ambiguous_main_peak' END AS kind FROM ft)"""
    candidate = f"""{standard},
        sh AS (SELECT pulse_index, count(v) / count(*) AS share, any_value(bg_std) AS std FROM gb GROUP BY pulse_index),
        ok AS (SELECT pk.*, row_number() OVER (PARTITION BY pulse_index ORDER BY prom DESC, x1 - x0 DESC, bin) AS k, count(*) OVER (PARTITION BY pulse_index) AS n FROM pk WHERE z > 0 AND prom >= 4 AND x1 - x0 >= 1.5),
        tp AS (SELECT pulse_index, max(prom) AS top FROM pk GROUP BY pulse_index),
        cd AS (SELECT pulse_index, CASE WHEN share < 0.95 THEN 'invalid_waveform' WHEN std IS NULL THEN 'invalid_background' WHEN ok.bin IS NULL THEN 'no_candidate' ELSE 'candidate' END AS status, share, ok.bin, ok.z, ok.prom, ok.x1 - ok.x0 AS width, n, top FROM sh LEFT JOIN tp USING (pulse_index) LEFT JOIN ok USING (pulse_index) WHERE coalesce(k, 1) = 1)"""
    only = lambda c: f"CASE WHEN status = 'candidate' THEN {c} END"
    o = {
        "v2_preprocess": f"""
            WITH {g}, p AS (SELECT pulse_index, bg_std, greatest(v - 2e-2, 0) AS v FROM gb WHERE v IS NOT NULL), m AS (SELECT pulse_index, median(v) AS m FROM p GROUP BY pulse_index)
            SELECT pulse_index, true AS valid, {_r(f'coalesce(any_value(bg_std), nullif({MAD} * median(abs(v - m)), 0), nullif(stddev_pop(v), 0), 1)')} AS sigma, 2e-2 AS "offset", {_r('sum(v)')} AS energy, count(*) AS n_finite FROM p JOIN m USING (pulse_index) GROUP BY pulse_index""",
        "v4_components": f"{comp}, {areas} SELECT co.pulse_index, rank, ra AS rank_by_amplitude, co.bin, {_r('z + off')} AS amplitude_raw, {_r('z')} AS amplitude, {_r('prom')} AS prominence, {_r('prom / sigma')} AS prominence_sigma, {_r('x1 - x0')} AS width, {_r('x0')} AS \"left\", {_r('x1')} AS \"right\", {_r('z - prom / 2')} AS width_height, {_r('area')} AS area, edge, {_r('sigma')} AS sigma, {_r('off')} AS \"offset\" FROM co JOIN ar ON ar.pulse_index = co.pulse_index AND ar.bin = co.bin",
        "v5_component_roles": f"{role} SELECT pulse_index, bin, {_r('rel')} AS relative, sep AS separation, rank = 1 AS is_main, rank = 1 OR why = '' AS is_prominent, rank > 1 AND why = '' AS is_secondary, CASE WHEN rank = 1 THEN '' ELSE why END AS rejected FROM ro",
        "v6_pulse_features": f"{feature} SELECT pulse_index, n, n_prominent, n_secondary, main_bin, {_r('main_width')} AS main_width, {_r('main_area')} AS main_area, secondary_bin, {_r('amplitude_ratio')} AS amplitude_ratio, {_r('prominence_ratio')} AS prominence_ratio, {_r('abs(main_bin - raw_bin)')} AS main_from_raw, {_r('abs(pulse_index % 64 - raw_bin)')} AS corrected_from_raw, clear AS has_clear_main, broad AS has_broad_main, weak AS has_weak_main, low_snr, kind AS reliability FROM fc",
        "v7_reliability_number": f"{feature} SELECT CAST(CASE kind WHEN 'clear_main_peak' THEN 5 WHEN 'clear_main_with_secondary_candidate' THEN 4 WHEN 'broad_main_peak' THEN 3 WHEN 'weak_main_peak' THEN 2 WHEN 'ambiguous_main_peak' THEN 1 WHEN 'low_snr_weak_main_peak' THEN 0 ELSE -1 END AS BIGINT) AS ordinal, count(*) AS n FROM fc GROUP BY 1",
        "v9_calibrated_candidate": f"{candidate} SELECT pulse_index, status, {_r('share')} AS finite_fraction, status = 'candidate' AS detected, {only('bin')} AS bin, {_r(only('z'))} AS height, {_r(only('prom'))} AS prominence, {_r(only('width'))} AS width, CASE WHEN status = 'candidate' THEN n ELSE 0 END AS n_qualified, CASE WHEN status NOT LIKE 'invalid%' THEN {_r('top')} END AS top_prominence FROM cd",
        "v10_roi_features": f"{candidate}, mm AS (SELECT vec_id AS pulse_index, label FROM embeddings WHERE vec_id % 3 > 0 UNION ALL SELECT vec_id, label + 1 FROM embeddings WHERE vec_id % 3 = 2) SELECT pulse_index, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS roi, status, {only('bin')} AS bin, {_r(only('prom'))} AS prominence FROM mm JOIN cd USING (pulse_index)",
        "v12_bin_scores": f"""
            WITH {g}, z AS (SELECT track_num, sweep_num, bin, refh, v - bg_mean AS raw, (v - bg_mean) / bg_std AS z FROM gb WHERE bin < 40),
            sw AS (SELECT sweep_num, row_number() OVER (ORDER BY sweep_num) AS pos FROM (SELECT DISTINCT sweep_num FROM gapped) AS s),
            h AS (SELECT z.*, pos, pos - row_number() OVER (PARTITION BY track_num, bin ORDER BY pos) AS island FROM z JOIN sw USING (sweep_num) WHERE z >= 1.5),
            ru AS (SELECT track_num, bin, max(c) AS longest FROM (SELECT track_num, bin, island, count(*) AS c FROM h GROUP BY ALL) AS i GROUP BY ALL),
            md AS (SELECT track_num, bin, quantile_disc(z, 0.5) AS ms, quantile_disc(raw, 0.5) AS mc FROM h GROUP BY ALL),
            sc AS (SELECT track_num, count(refh) AS ny, avg(refh) AS ay, stddev_pop(refh) AS sy FROM gapped GROUP BY track_num),
            az AS (SELECT track_num, bin, avg(z) AS a FROM z GROUP BY ALL),
            t AS (SELECT z.track_num, z.bin, count(z) AS nv, count(*) FILTER (z >= 1.5) AS ne, sum((z - a) * (refh - ay)) / sqrt(sum(pow(z - a, 2)) * any_value(ny * sy * sy)) AS corr, any_value(ny >= 10 AND sy >= 0.05) AS ok FROM z JOIN sc USING (track_num) JOIN az ON az.track_num = z.track_num AND az.bin = z.bin GROUP BY ALL),
            u AS (SELECT *, ne / nv AS p, 1.959963984540054 AS q, 1 - bin / 39 AS ew FROM t),
            w AS (SELECT *, (p + q * q / (2 * nv)) / (1 + q * q / nv) AS c, q * sqrt(p * (1 - p) / nv + q * q / (4 * nv * nv)) / (1 + q * q / nv) AS hw FROM u LEFT JOIN ru USING (track_num, bin) LEFT JOIN md USING (track_num, bin))
            SELECT track_num, bin, {_r('p')} AS occupancy, {_r('greatest(0, c - hw)')} AS ci_low, {_r('least(1, c + hw)')} AS ci_high, ne AS n_events, nv AS n_valid, {_r('mc')} AS median_counts, {_r('ms')} AS median_sigma, {_r('ew')} AS early_weight, {_r('corr')} AS scene_correlation, ok AS scene_assessed, coalesce(longest, 0) AS longest,
                {_r('0.45 * least(p / 0.5, 1) + 0.35 * least(greatest(coalesce(ms, 0) / 12, 0), 1) + 0.1 * ew + 0.1 * (1 - abs(corr))')} AS score FROM w""",
        "v13_all_bin_events": f"{standard}, nv AS (SELECT pulse_index, any_value(track_num) AS track_num, any_value(sweep_num) AS sweep_num, count(v) AS n FROM gb GROUP BY pulse_index) SELECT pk.pulse_index, track_num, sweep_num, pk.bin, {_r('z')} AS excess, {_r('prom')} AS prominence, {_r('x1 - x0')} AS width, {_r('v')} AS raw, n AS n_valid FROM pk JOIN nv USING (pulse_index) JOIN gb ON gb.pulse_index = pk.pulse_index AND gb.bin = pk.bin WHERE z >= 1.5 AND prom >= 1".replace("track_num, sweep_num, pk.bin", "nv.track_num, nv.sweep_num, pk.bin"),
        "v19_morphology": f"""
            WITH {g.replace('gapped g', '(SELECT pulse_index, list_transform(rx, lambda v: CAST(v AS DOUBLE)) AS rx FROM waves) AS g')}, md AS (SELECT pulse_index, median(v) AS m FROM gb GROUP BY pulse_index), sg AS (SELECT pulse_index, coalesce(nullif({MAD} * median(abs(v - m)), 0), nullif(stddev_pop(v), 0), 1) AS sigma FROM gb JOIN md USING (pulse_index) GROUP BY pulse_index),
            sz AS (SELECT pulse_index, bin, v - m AS z FROM gb JOIN md USING (pulse_index)), {_peaks('sz', flat=True)},
            ok AS (SELECT pk.*, row_number() OVER (PARTITION BY pulse_index ORDER BY prom DESC, bin) AS k FROM pk JOIN sg USING (pulse_index) WHERE z >= 2 * sigma AND prom >= sigma),
            tp AS (SELECT pulse_index, arg_max(bin, row(z, -bin)) AS top, count(*) AS bins FROM sz GROUP BY pulse_index),
            ct AS (SELECT pulse_index, count(*) AS n, max(z) FILTER (k = 1) AS z1, max(z) FILTER (k = 2) AS z2, max(x1 - x0) FILTER (k = 1) AS w FROM ok GROUP BY pulse_index)
            SELECT pulse_index, CASE WHEN top < 2 OR top > bins - 3 THEN 'boundary' WHEN n IS NULL THEN 'weak' WHEN z2 > 0.95 * z1 THEN 'near_tie' WHEN w > 12 THEN 'wide' WHEN n = 1 THEN 'single' WHEN n = 2 THEN 'double' ELSE 'multiple' END AS category, coalesce(n, 0) AS n FROM tp LEFT JOIN ct USING (pulse_index)""",
        "v20_curtain": f"WITH {g}, h AS (SELECT k, 120 - 2.5e0 * k AS h, k * 63 / 40e0 AS pl FROM unnest(generate_series(0, 40)) AS t(k)) SELECT a.pulse_index, h, {_r('CASE WHEN pl = floor(pl) THEN a.v ELSE a.v * (1 - pl + floor(pl)) + b.v * (pl - floor(pl)) END')} AS v FROM h JOIN gb a ON a.bin = floor(pl) LEFT JOIN gb b ON b.pulse_index = a.pulse_index AND b.bin = a.bin + 1 WHERE a.v IS NOT NULL AND (pl = floor(pl) OR b.v IS NOT NULL)",
    }
    return {name: with_tables(Dialect(False), text) for name, text in o.items()}
