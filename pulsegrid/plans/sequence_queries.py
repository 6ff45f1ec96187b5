"""Scans, joins on keys, windows, scalar functions, arrays and geometry of the survey (§2.1, 2.4, 2.6, 2.9-2.11, 2.13, 2.17)."""

from __future__ import annotations

from pulsegrid.plans.dialect import Dialect
from pulsegrid.plans.statistics_queries import _r

#: WGS84 semi-major axis and first eccentricity squared.
A, E2 = "6378137e0", "6.69437999014132e-3"


def _ecef(lon: str, lat: str, h: str) -> tuple[str, str, str]:
    n = f"({A} / sqrt(1 - {E2} * power(sin(radians({lat})), 2)))"
    return (f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))", f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))", f"(({n} * (1 - {E2}) + {h}) * sin(radians({lat})))")


def _haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"2 * 6371008.8e0 * asin(sqrt(least(1e0, power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"


def _cascade(hag: str = "hag") -> str:
    """Height classes over the ground, in the order in which the rules are tested."""
    return f"CASE WHEN {hag} IS NULL THEN 1 WHEN abs({hag}) <= 1 THEN 2 WHEN {hag} > 30 THEN 7 WHEN {hag} > 1 THEN 1 WHEN {hag} < -2 THEN 7 ELSE 7 END"


def plans(d: Dialect) -> dict[str, str]:
    q: dict[str, str] = {}
    # ---- scans
    q["s1_point_scan"] = "SELECT pulse_index, lon, lat, refh, amp, snr FROM good WHERE track_num BETWEEN 2 AND 5"
    q["s2_surface_scan"] = "SELECT pulse_index, refh, amp, snr, refh IS NULL AS invalid FROM pulses"
    q["s3_classifier_scan"] = f"SELECT pulse_index, {_r('coalesce(snr_bg, amp / nullif(thres, 0))')} AS snr FROM pulses WHERE refh IS NOT NULL"
    q["s4_transfer_scan"] = "SELECT pulse_index, sweep_num, track_num, refh FROM pulses WHERE sweep_num BETWEEN 100 AND 2000"
    q["s5_diagnosis_scan"] = "SELECT pulse_index, refh, x, y, tax AS geoid FROM pulses WHERE snr >= 5 AND refh IS NOT NULL"
    q["s8_record_fetch"] = "SELECT w.pulse_index, " + d.size("w.rx") + " AS n_bins FROM waves w WHERE w.pulse_index IN (SELECT station_id FROM stations)"
    q["s9_sweep_matrix"] = f"SELECT k.track_num, s.sweep_num, p.n FROM (SELECT DISTINCT sweep_num FROM pulses) AS s CROSS JOIN (SELECT CAST(k AS BIGINT) AS track_num FROM (SELECT 1 AS one) AS o CROSS JOIN {d.each('1', '7')} AS j) AS k LEFT JOIN (SELECT sweep_num, track_num, count(*) AS n FROM pulses GROUP BY 1, 2) AS p ON p.sweep_num = s.sweep_num AND p.track_num = k.track_num"
    q["s10_sweep_block"] = "SELECT sweep_num, count(DISTINCT track_num) AS tracks, count(DISTINCT track_num) = 7 AS complete FROM pulses WHERE sweep_num BETWEEN 0 AND 999 GROUP BY sweep_num"
    q["s11_fill_scale_contract"] = f"SELECT pulse_index, {_r('CASE WHEN tax IN (0e0, 8e-2) THEN NULL ELSE tax * 1e1 + 5 END')} AS v FROM pulses"
    q["s12_reference_scan"] = "SELECT ref_id, x, y, z, class FROM refs WHERE x BETWEEN 10 AND 150 AND y BETWEEN 0 AND 100"
    q["s13_ground_scan"] = "SELECT ref_id, tile, z FROM refs WHERE class = 2"
    q["s14_tile_statistics"] = "SELECT tile, class, count(*) AS n FROM refs GROUP BY tile, class"
    q["s16_channel_layout"] = f"SELECT source, {d.matched('source', '([0-9]+)$')} AS channel, count(*) AS n FROM documents GROUP BY 1, 2"
    q["s17_bounded_rows"] = d.pick("SELECT pulse_index, CAST(pos AS BIGINT) AS sample, CAST(v AS DOUBLE) AS v FROM waves LATERAL VIEW posexplode(slice(rx, 1, 4)) AS pos, v WHERE pulse_index % 7 = 0", "SELECT pulse_index, CAST(i - 1 AS BIGINT) AS sample, CAST(rx[i] AS DOUBLE) AS v FROM waves, unnest(generate_series(1, 4)) AS t(i) WHERE pulse_index % 7 = 0")
    q["s18_swath_order"] = "SELECT pulse_index, bin, bin % 8 * 8 + bin // 8 AS footprint, v FROM bins WHERE bin BETWEEN 4 AND 59".replace("//", d.pick("DIV", "//"))
    q["s20_object_listing"] = "SELECT page_id, url FROM pages WHERE length(html) > 0 AND url NOT LIKE '%/'"
    q["s22_matched_read"] = "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 500"
    q["s23_raster_sample"] = f"SELECT s.station_id, {_r('c.z')} AS z FROM stations s LEFT JOIN (SELECT {d.floor('x / 10e0')} AS ix, {d.floor('y / 10e0')} AS iy, avg(refh) AS z FROM good GROUP BY 1, 2) AS c ON c.ix = {d.floor('s.x / 10e0')} AND c.iy = {d.floor('s.y / 10e0')}"
    # ---- joins on keys
    q["j1_pulse_context"] = "SELECT c.pulse_index, c.bin, CASE WHEN w.pulse_index IS NULL THEN 'absent' WHEN w.track_num <> c.track_num THEN 'track_mismatch' ELSE 'ok' END AS status FROM (SELECT * FROM bins WHERE v > 3e-1) AS c LEFT JOIN waves w ON w.pulse_index = c.pulse_index"
    q["j3_cell_back_join"] = f"SELECT p.pulse_index, {_r('p.refh - c.m')} AS above FROM good p JOIN (SELECT {d.floor('x / 5e0')} AS ix, {d.floor('y / 5e0')} AS iy, {d.pct('refh', 0.5)} AS m FROM good GROUP BY 1, 2) AS c ON c.ix = {d.floor('p.x / 5e0')} AND c.iy = {d.floor('p.y / 5e0')}"
    q["j16_raster_sample_nearest"] = f"SELECT p.ref_id, {_r('p.z - c.g')} AS dz FROM refs p JOIN (SELECT {d.floor('x / 4e0')} AS ix, {d.floor('y / 4e0')} AS iy, min(refh) AS g FROM good GROUP BY 1, 2) AS c ON c.ix = {d.floor('p.x / 4e0')} AND c.iy = {d.floor('p.y / 4e0')}"
    q["j17_method_pairing"] = f"WITH m AS (SELECT pulse_index, 'segment' AS method, refh AS h FROM good UNION ALL SELECT pulse_index, 'beam', ground + tax FROM good) SELECT pulse_index, {_r(chr(39).join(['max(CASE WHEN method = ', 'segment', ' THEN h END) - max(CASE WHEN method = ', 'beam', ' THEN h END)']))} AS gap FROM m GROUP BY pulse_index"
    q["j18_common_tracks"] = f"SELECT a.track_num, {_r('a.m - b.m')} AS diff FROM (SELECT track_num, avg(refh) AS m FROM good WHERE roi = 'A' GROUP BY track_num) AS a JOIN (SELECT track_num, avg(refh) AS m FROM good WHERE roi = 'N' GROUP BY track_num) AS b ON a.track_num = b.track_num"
    q["j19_outer_compare"] = "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL AS gained, b.doc_id IS NULL AS lost FROM (SELECT doc_id FROM labels WHERE quality = 1) AS a FULL JOIN (SELECT doc_id FROM labels WHERE toxic = 0) AS b ON a.doc_id = b.doc_id"
    q["j20_dimension_join"] = "SELECT s.s_suppkey AS station_id, n.n_name AS site, r.r_name AS region_ FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"
    q["j21_baseline_lookup"] = f"WITH g AS (SELECT roi, granule, track_num, avg(r) AS m FROM residuals GROUP BY 1, 2, 3) SELECT g.roi, g.granule, g.track_num, {_r('g.m - b.m')} AS delta FROM g JOIN g AS b ON b.roi = g.roi AND b.granule = g.granule AND b.track_num = 1"
    q["j22_missing_cells"] = f"WITH e AS (SELECT s.sweep_num, k.track_num FROM (SELECT DISTINCT sweep_num FROM pulses) AS s CROSS JOIN (SELECT CAST(k AS BIGINT) AS track_num FROM (SELECT 1 AS one) AS o CROSS JOIN {d.each('1', '7')} AS j) AS k) SELECT e.sweep_num, e.track_num FROM e LEFT JOIN pulses p ON p.sweep_num = e.sweep_num AND p.track_num = e.track_num WHERE p.pulse_index IS NULL"
    q["j23_parameter_grid"] = "SELECT DISTINCT g.source AS file_, a.lo, b.hi FROM (SELECT DISTINCT source FROM documents) AS g CROSS JOIN (SELECT 1 AS lo UNION ALL SELECT 2 UNION ALL SELECT 2) AS a CROSS JOIN (SELECT 5 AS hi UNION ALL SELECT 6) AS b"
    q["j24_strong_bin_distance"] = "SELECT pulse_index, bin, least(bin - max(CASE WHEN v > 2e-1 THEN bin END) OVER (PARTITION BY pulse_index ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), min(CASE WHEN v > 2e-1 THEN bin END) OVER (PARTITION BY pulse_index ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - bin) AS gap FROM bins"
    # ---- windows
    order = "PARTITION BY track_num ORDER BY sweep_num, pulse_index"
    q["w6_rank_by_amplitude"] = "SELECT pulse_index, bin, row_number() OVER (PARTITION BY pulse_index ORDER BY v DESC, bin) AS rk FROM bins"
    q["w7_config_ranking"] = "SELECT roi, granule, track_num, row_number() OVER (ORDER BY round(m, 6) DESC, n DESC, roi, granule, track_num) AS rk FROM (SELECT roi, granule, track_num, avg(abs(r)) AS m, count(*) AS n FROM residuals GROUP BY 1, 2, 3) AS g"
    q["w8_half_split"] = f"SELECT site, station_id, row_number() OVER (PARTITION BY site ORDER BY x, y, station_id) <= {d.floor('count(*) OVER (PARTITION BY site) / 2e0')} AS calibration FROM stations"
    q["w11_band_merging"] = "SELECT track_num, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n FROM (SELECT track_num, bin, bin - row_number() OVER (PARTITION BY track_num ORDER BY bin) AS g FROM (SELECT track_num, bin FROM bins GROUP BY 1, 2 HAVING avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END) >= 5e-1) AS q) AS w GROUP BY track_num, g"
    q["w12_support_runs"] = f"SELECT pulse_index, min(bin) AS first_bin, count(*) AS width, {_r('sum(v)')} AS energy FROM (SELECT pulse_index, bin, v, bin - row_number() OVER (PARTITION BY pulse_index ORDER BY bin) AS g FROM bins WHERE v > 1e-1) AS w GROUP BY pulse_index, g"
    q["w14_energy_quantiles"] = "SELECT pulse_index, min(CASE WHEN cum >= 1e-1 * total THEN bin END) AS q10, min(CASE WHEN cum >= 5e-1 * total THEN bin END) AS q50, min(CASE WHEN cum >= 9e-1 * total THEN bin END) AS q90 FROM (SELECT pulse_index, bin, sum(greatest(v, 0)) OVER (PARTITION BY pulse_index ORDER BY bin ROWS UNBOUNDED PRECEDING) + 1e-9 AS cum, sum(greatest(v, 0)) OVER (PARTITION BY pulse_index) AS total FROM bins) AS w GROUP BY pulse_index"
    ig = d.pick("last(v, true) OVER (PARTITION BY pulse_index ORDER BY bin ROWS UNBOUNDED PRECEDING)", "last_value(v IGNORE NULLS) OVER (PARTITION BY pulse_index ORDER BY bin ROWS UNBOUNDED PRECEDING)")
    ig2 = d.pick("first(v, true) OVER (PARTITION BY pulse_index ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "first_value(v IGNORE NULLS) OVER (PARTITION BY pulse_index ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    ib = "max(CASE WHEN v IS NOT NULL THEN bin END) OVER (PARTITION BY pulse_index ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    ib2 = "min(CASE WHEN v IS NOT NULL THEN bin END) OVER (PARTITION BY pulse_index ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    q["w15_gap_interpolation"] = f"SELECT pulse_index, bin, {_r('coalesce(CASE WHEN b1 = b0 THEN v0 ELSE v0 + (v1 - v0) * (bin - b0) / nullif(b1 - b0, 0) END, v0, v1)')} AS v FROM (SELECT pulse_index, bin, {ig} AS v0, {ig2} AS v1, {ib} AS b0, {ib2} AS b1 FROM (SELECT pulse_index, bin, CASE WHEN abs(v) < 2e-1 THEN v END AS v FROM bins) AS n) AS w"
    # ---- scalars
    q["f1_safe_divide"] = f"SELECT pulse_index, {_r('amp / nullif(discount, 0)')} AS v FROM pulses"
    q["f2_normalise"] = f"WITH l AS (SELECT {d.pct('amp', 0.02)} AS lo, {d.pct('amp', 0.98)} AS hi FROM pulses) SELECT pulse_index, {_r('least(greatest((amp - lo) / nullif(hi - lo, 0), 0e0), 1e0)')} AS v, {d.floor('least(greatest(amp * 1000, 0), 65535)')} > 50000 AS bright FROM pulses CROSS JOIN l"
    q["f3_math"] = f"SELECT pulse_index, {_r('ln(1 + amp)')} AS l1p, {_r('log10(amp)')} AS l10, {_r('sqrt(amp)')} AS sq, {_r('asinh(amp)')} AS ash, {_r('cbrt(amp)')} AS cb, {_r('exp(-snr)')} AS ex, {_r('degrees(acos(discount))')} AS ac, {_r('atan2(amp, snr)')} AS at2 FROM pulses"
    q["f4_bits"] = "SELECT track_num, CAST(1 << CAST(track_num AS INT) AS BIGINT) AS bit, CAST(bit_count(CAST(track_num * 37 AS BIGINT)) AS BIGINT) AS ones, (track_num & 3) AS low FROM (SELECT DISTINCT track_num FROM pulses) AS t"
    q["f5_binning"] = f"SELECT pulse_index, CASE WHEN snr <= 2 THEN 0 WHEN snr <= 5 THEN 1 ELSE 2 END AS snr_bin, {d.floor('sweep_num / 512e0')} AS block, {d.mod('track_num', '4')} AS phase, CAST(least(floor(x / 50e0), 3) * 4 + least(floor(y / 50e0), 3) AS BIGINT) AS quad FROM pulses"
    q["f6_nearest_band"] = f"SELECT pulse_index, {_r('least(greatest(greatest(1e0 - h, h - 3e0), 0), greatest(greatest(8e0 - h, h - 15e0), 0))')} AS err, CASE WHEN greatest(greatest(1e0 - h, h - 3e0), 0) <= greatest(greatest(8e0 - h, h - 15e0), 0) THEN 'low' ELSE 'high' END AS band FROM (SELECT pulse_index, refh - ground AS h FROM good) AS g"
    q["f7_regex"] = f"SELECT page_id, {d.matched('url', '^(https?)://')} AS scheme, {d.matched('url', '://([^/]+)')} AS host, {d.matched('url', '/([a-z][a-z])/([0-9]+)', 1)} AS folder, {d.matched('url', '/([a-z][a-z])/([0-9]+)', 2)} AS num, lower(regexp_replace(url, '[^A-Za-z0-9]+', '_'{d.pick('', ', ' + chr(39) + 'g' + chr(39))})) AS slug FROM pages"
    q["f8_dates"] = d.pick(
        "SELECT event_id, date_format(ts, 'yyyy-MM-dd') AS day, CAST(datediff(ts, DATE '2024-01-01') AS BIGINT) AS offset_days, round(year(ts) + (dayofyear(ts) - 1) / 366e0, 6) AS decimal_year, CAST(hour(ts) + CASE WHEN minute(ts) >= 30 THEN 1 ELSE 0 END AS BIGINT) AS hour_index FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS offset_days, round(year(ts) + (dayofyear(ts) - 1) / 366e0, 6) AS decimal_year, CAST(hour(ts) + CASE WHEN minute(ts) >= 30 THEN 1 ELSE 0 END AS BIGINT) AS hour_index FROM events",
    )
    q["f10_hash"] = d.pick("SELECT doc_id, sha2(text, 256) AS sha, substr(sha1(source), 1, 10) AS short FROM documents", "SELECT doc_id, sha256(text) AS sha, substr(sha1(source), 1, 10) AS short FROM documents")
    q["f11_boxes"] = "SELECT a.station_id AS a, b.station_id AS b FROM stations a JOIN stations b ON a.site = b.site AND a.station_id < b.station_id WHERE a.x - 20 <= b.x + 20 AND b.x - 20 <= a.x + 20 AND a.y - 20 <= b.y + 20 AND b.y - 20 <= a.y + 20"
    q["f12_units"] = f"SELECT pulse_index, {_r('tax * CASE track_num % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 299792458e-9 ELSE 149896229e-9 END', 7)} AS metres FROM pulses"
    q["f13_physics"] = f"SELECT pulse_index, {_r('snr * 101.325e0 / (0.622e0 + 0.378e0 * tax)')} AS vapour, {_r('-0.198e0 * (1.5e0 * power(sin(radians(lat)), 2) - 5e-1)', 7)} AS tide FROM pulses"
    q["f14_status"] = "SELECT pulse_index, CASE WHEN refh IS NULL THEN 'missing' WHEN abs(refh - ground) < 5e-1 THEN 'applied' WHEN abs(refh - ground) < 2 THEN 'uncertain' ELSE 'not_applied' END AS state FROM pulses"
    q["f15_wilson"] = f"WITH c AS (SELECT track_num, count(*) * 1e0 AS n, avg(CASE WHEN snr > 5 THEN 1e0 ELSE 0e0 END) AS p FROM pulses GROUP BY track_num) SELECT track_num, {_r('greatest((p + 1.9208e0 / n - 1.96e0 * sqrt(p * (1 - p) / n + 0.9604e0 / (n * n))) / (1 + 3.8416e0 / n), 0)')} AS low, {_r('least((p + 1.9208e0 / n + 1.96e0 * sqrt(p * (1 - p) / n + 0.9604e0 / (n * n))) / (1 + 3.8416e0 / n), 1)')} AS high FROM c"
    # ---- geometry
    ex, ey, ez = _ecef("lon", "lat", "refh")
    q["g1_geodetic_to_ecef"] = f"SELECT pulse_index, {_r(ex, 3)} AS ex, {_r(ey, 3)} AS ey, {_r(ez, 3)} AS ez FROM good"
    q["g4_segment"] = f"SELECT pulse_index, {_r('x + tax * (y - x)')} AS px, {_r('ground + discount * (refh - ground)')} AS pz FROM good"
    q["g5_bin_mapping"] = f"SELECT bin, {_r('bin / 63e0')} AS h1, {_r('(bin + 5e-1) / 64e0')} AS h2, {_r('1 - bin / 63e0')} AS h3 FROM (SELECT DISTINCT bin FROM bins) AS b"
    q["g6_range_window"] = f"SELECT pulse_index, bin, {_r('120e0 + bin / 63e0 * (20e0 - 120e0)')} AS h, {_r('20e0 + bin / 63e0 * (120e0 - 20e0)')} AS h_rev FROM bins"
    q["g7_beam"] = f"SELECT pulse_index, {_r('-sin(tax) * cos(discount)')} AS e, {_r('-cos(tax) * cos(discount)')} AS n, {_r('-sin(discount)')} AS u FROM pulses"
    ox, oy, oz = _ecef("-869e-1", "404e-1", "0")
    q["g8_enu"] = f"SELECT pulse_index, {_r(f'-sin(radians(-869e-1)) * ({ex} - {ox}) + cos(radians(-869e-1)) * ({ey} - {oy})', 3)} AS e, {_r(f'cos(radians(404e-1)) * cos(radians(-869e-1)) * ({ex} - {ox}) + cos(radians(404e-1)) * sin(radians(-869e-1)) * ({ey} - {oy}) + sin(radians(404e-1)) * ({ez} - {oz})', 3)} AS u FROM good"
    q["g9_haversine"] = f"SELECT pulse_index, {_r(_haversine('-869e-1', '404e-1', 'lon', 'lat'), 3)} AS dist FROM good"
    q["g10_point_segment"] = f"SELECT pulse_index, {_r('t')} AS t, {_r('sqrt(power(x - 200 * greatest(0, least(1, t)), 2) + power(y - 100 * greatest(0, least(1, t)), 2))')} AS dist FROM (SELECT pulse_index, x, y, (x * 200 + y * 100) / 5e4 AS t FROM good) AS p"
    q["g11_angle"] = f"SELECT pulse_index, {_r('degrees(atan2(sqrt(power(y * 1 - 40 * 0, 2) + power(40 * 1 - x * 1, 2) + power(x * 0 - y * 1, 2)), x * 1 + y * 0 + 40 * 1))')} AS ang FROM good"
    q["g14_transect"] = f"SELECT pulse_index, {_r('x * 8e-1 + y * 6e-1')} AS along, {_r('abs(-x * 6e-1 + y * 8e-1)')} AS across FROM good"
    q["g15_principal_direction"] = f"SELECT {_r('degrees(atan2(2 * sxy, sxx - syy)) / 2', 4)} AS axis, {_r('rho')} AS rho FROM (SELECT covar_pop(x, y) AS sxy, var_pop(x) AS sxx, var_pop(y) AS syy, corr(x, track_num) AS rho FROM good) AS c"
    q["g16_bilinear"] = f"WITH g AS (SELECT {d.floor('x / 20e0')} AS ix, {d.floor('y / 20e0')} AS iy, avg(refh) AS z FROM good GROUP BY 1, 2), s AS (SELECT station_id, {d.floor('x / 20e0')} AS ix, {d.floor('y / 20e0')} AS iy, x / 20e0 - floor(x / 20e0) AS u, y / 20e0 - floor(y / 20e0) AS v FROM stations) SELECT s.station_id, {_r('a.z * (1 - u) * (1 - v) + b.z * u * (1 - v) + c.z * (1 - u) * v + e.z * u * v')} AS z FROM s LEFT JOIN g a ON a.ix = s.ix AND a.iy = s.iy LEFT JOIN g b ON b.ix = s.ix + 1 AND b.iy = s.iy LEFT JOIN g c ON c.ix = s.ix AND c.iy = s.iy + 1 LEFT JOIN g e ON e.ix = s.ix + 1 AND e.iy = s.iy + 1"
    q["g17_target"] = f"SELECT pulse_index, {_r('x + 500 * tax')} AS tx, {_r('y + 500 * discount')} AS ty, {_r('500 - 500 * sqrt(1 - tax * tax - discount * discount)')} AS tz FROM good"
    # ---- waveform arrays
    q["v1_argmax"] = f"SELECT pulse_index, {d.argmax_bin('rx')} AS bin, {_r('CAST(' + d.elem('rx', d.argmax_bin('rx')) + ' AS DOUBLE)')} AS v FROM waves"
    q["v11_background_windows"] = f"SELECT pulse_index, {_r(d.total(d.part('rx', 1, 8)) + ' / 8e0')} AS m0, {_r(d.total(d.part('rx', 57, 8)) + ' / 8e0')} AS m7 FROM waves"
    q["v14_mask_bins"] = f"SELECT pulse_index, bin, CASE WHEN bin BETWEEN 10 AND 20 OR bin BETWEEN 40 AND 44 THEN NULL ELSE {_r('v - 5e-1 * t.m')} END AS v FROM bins JOIN (SELECT bin AS tb, avg(v) AS m FROM bins GROUP BY bin) AS t ON t.tb = bins.bin"
    lead = d.ordered(d.part("rx", 1, 15))
    q["v15_baseline"] = f"SELECT pulse_index, {_r('CAST(' + d.elem(lead, '7') + ' AS DOUBLE)')} AS base, {_r('CAST(' + d.elem(d.ordered(d.transform(d.part('rx', 1, 15), 'z', 'abs(z)')), '7') + ' AS DOUBLE)')} AS spread FROM waves"
    q["v17_moments"] = f"WITH m AS (SELECT pulse_index, avg(v) AS a FROM bins GROUP BY pulse_index) SELECT b.pulse_index, {_r('avg(power(v - a, 3)) / power(avg(power(v - a, 2)), 15e-1)')} AS skew, {_r('avg(power(v - a, 4)) / power(avg(power(v - a, 2)), 2) - 3')} AS kurt FROM bins b JOIN m ON m.pulse_index = b.pulse_index GROUP BY b.pulse_index"
    q["v18_pulse_audit"] = f"SELECT pulse_index, max(CASE WHEN rk = 1 THEN bin END) AS top_bin, {_r('max(CASE WHEN rk = 2 THEN v END)')} AS second, count(CASE WHEN v = top THEN 1 END) AS ties, count(CASE WHEN v >= 9e-1 * top THEN 1 END) AS near_top FROM (SELECT *, row_number() OVER (PARTITION BY pulse_index ORDER BY v DESC, bin) AS rk, max(v) OVER (PARTITION BY pulse_index) AS top FROM bins) AS w GROUP BY pulse_index"
    q["a46_stationarity"] = f"SELECT track_num, seg, {_r('avg(v)')} AS mean, {_r('stddev_pop(v)')} AS sd, {_r('corr(v, prev)')} AS lag1 FROM (SELECT track_num, {d.floor('bin / 16e0')} AS seg, v, lag(v) OVER (PARTITION BY pulse_index ORDER BY bin) AS prev FROM bins) AS w GROUP BY track_num, seg"
    # ---- classes
    q["c3_label_mapping"] = "SELECT ref_id, CASE WHEN class = 2 THEN 2 WHEN class IN (7, 18) THEN 7 ELSE 1 END AS mapped FROM refs"
    # ---- rasters
    q["r1_grid_key"] = f"WITH b AS (SELECT min(x) AS x0, max(y) AS y1 FROM good) SELECT pulse_index, {d.floor('(y1 - y) / 2e0')} AS row_, {d.floor('(x - x0) / 2e0')} AS col FROM good CROSS JOIN b"
    cells = f"SELECT DISTINCT {d.floor('x / 10e0')} AS ix, {d.floor('y / 10e0')} AS iy FROM good WHERE snr > 8"
    disk = f"SELECT a.k AS dx, b.k AS dy FROM (SELECT 1 AS one) AS o CROSS JOIN {d.each('-1', '1')} AS a CROSS JOIN {d.each('-1', '1')} AS b WHERE a.k * a.k + b.k * b.k <= 1"
    dilated = f"WITH c AS ({cells}), k AS ({disk}), dil AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM c CROSS JOIN k)"
    q["r3_dilation"] = f"{dilated} SELECT ix, iy FROM dil"
    q["r3_closing"] = f"{dilated} SELECT e.ix, e.iy FROM (SELECT dil.ix + dx AS ix, dil.iy + dy AS iy FROM dil CROSS JOIN k) AS e GROUP BY e.ix, e.iy HAVING count(*) = 5"
    grid = f"SELECT {d.floor('x / 4e0')} AS ix, {d.floor('y / 4e0')} AS iy, {d.pct('refh', 0.1)} AS z FROM good GROUP BY 1, 2"
    q["r6_smooth"] = f"WITH g AS ({grid}), k AS (SELECT a.k AS dx, b.k AS dy, exp(-(a.k * a.k + b.k * b.k) / 2e0) AS w FROM (SELECT 1 AS one) AS o CROSS JOIN {d.each('-2', '2')} AS a CROSS JOIN {d.each('-2', '2')} AS b), s AS (SELECT g.ix + dx AS ix, g.iy + dy AS iy, z * w AS zw, w FROM g CROSS JOIN k) SELECT g.ix, g.iy, {_r('sum(zw) / sum(w)')} AS z FROM g JOIN s ON s.ix = g.ix AND s.iy = g.iy GROUP BY g.ix, g.iy"
    row_w = "PARTITION BY iy ORDER BY ix RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING"
    col_w = "PARTITION BY ix ORDER BY iy RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING"
    q["r7_morphological_opening"] = f"WITH g AS ({grid}), a AS (SELECT ix, iy, z, min(z) OVER ({row_w}) AS e FROM g), b AS (SELECT ix, iy, z, min(e) OVER ({col_w}) AS e FROM a), c AS (SELECT ix, iy, z, max(e) OVER ({row_w}) AS o FROM b), f AS (SELECT ix, iy, z, max(o) OVER ({col_w}) AS o FROM c) SELECT ix, iy, {_r('CASE WHEN z - o > 5e-1 THEN o ELSE z END')} AS z, z - o > 5e-1 AS replaced FROM f"
    q["r8_median_filter"] = f"WITH g AS ({grid}), k AS (SELECT a.k AS dx, b.k AS dy FROM (SELECT 1 AS one) AS o CROSS JOIN {d.each('-1', '1')} AS a CROSS JOIN {d.each('-1', '1')} AS b), s AS (SELECT g.ix + dx AS ix, g.iy + dy AS iy, z AS nz FROM g CROSS JOIN k) SELECT g.ix, g.iy, {_r(d.pct('nz', 0.5))} AS z FROM g JOIN s ON s.ix = g.ix AND s.iy = g.iy GROUP BY g.ix, g.iy"
    q["r9_residual_classes"] = "SELECT pulse_index, CASE WHEN r < -3 THEN 7 WHEN r <= 25e-1 THEN 2 WHEN r > 25e-1 THEN 1 ELSE 1 END AS class FROM residuals"
    q["k6_mesh_quads"] = f"WITH g AS ({grid}) SELECT a.ix, a.iy, 2 AS triangles FROM g a JOIN g b ON b.ix = a.ix + 1 AND b.iy = a.iy JOIN g c ON c.ix = a.ix AND c.iy = a.iy + 1 JOIN g e ON e.ix = a.ix + 1 AND e.iy = a.iy + 1 WHERE greatest(a.z, b.z, c.z, e.z) - least(a.z, b.z, c.z, e.z) <= 15"
    # ---- second pass
    q["e2_field_default"] = "SELECT pulse_index, coalesce(snr_bg, -1e0) IS NOT NULL AND refh IS NOT NULL AS finite FROM pulses"
    q["e6_error_samples"] = "SELECT doc_id, subset FROM (SELECT doc_id, subset, row_number() OVER (PARTITION BY subset ORDER BY doc_id) AS rk FROM (SELECT doc_id, CASE WHEN t = p THEN 'correct' WHEN t = 2 THEN 'missed' ELSE 'false' END AS subset FROM truth) AS s) AS w WHERE rk <= 20"
    q["e7_exceedance"] = f"SELECT s.lo, t.lim, count(CASE WHEN abs(r) > t.lim THEN 1 END) AS over, {_r('avg(CASE WHEN abs(r) > t.lim THEN 1e0 ELSE 0e0 END)')} AS probability FROM residuals JOIN (SELECT -1e0 AS lo UNION ALL SELECT 3e0 UNION ALL SELECT 5e0) AS s ON snr >= s.lo CROSS JOIN (SELECT 25e-2 AS lim UNION ALL SELECT 5e-1 UNION ALL SELECT 1e0 UNION ALL SELECT 2e0) AS t GROUP BY s.lo, t.lim"
    q["e10_site_split"] = "SELECT site IN (1, 4, 7, 10) AS calibration, count(*) AS n FROM stations GROUP BY 1"
    q["e11_support_gate"] = f"SELECT track_num, count(*) AS n, count(DISTINCT {d.floor('x / 25e0')}) AS blocks, count(*) >= 30 AND count(DISTINCT {d.floor('x / 25e0')}) >= 3 AS supported FROM good WHERE snr >= 8 GROUP BY track_num"
    q["e12_raster_validity"] = f"WITH g AS ({grid}) SELECT ix, iy, z IS NOT NULL AND z > 0 AND z < 100 AS valid FROM g"
    q["e13_class_lookup"] = "SELECT count(*) AS n, count(l.doc_id) AS covered, count(*) - count(DISTINCT d.doc_id) AS duplicates FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
    q["e16_cross_granule"] = f"SELECT granule, 'mean' AS model, {_r('avg(r)')} AS v FROM residuals GROUP BY granule UNION ALL SELECT granule, 'rmse', {_r('sqrt(avg(r * r))')} FROM residuals GROUP BY granule"
    q["e17_angle_encodings"] = f"SELECT m.name, count(*) AS n, {_r('avg(CASE m.name WHEN ' + chr(39) + 'swap' + chr(39) + ' THEN discount WHEN ' + chr(39) + 'negate' + chr(39) + ' THEN -tax ELSE tax END)', 7)} AS az FROM pulses CROSS JOIN (SELECT 'same' AS name UNION ALL SELECT 'swap' UNION ALL SELECT 'negate') AS m GROUP BY m.name"
    q["e20_crosscheck"] = f"SELECT {_r(d.pct('abs(a - b)', 0.5), 7)} AS med, {_r('max(abs(a - b))', 7)} AS top FROM (SELECT {_haversine('-869e-1', '404e-1', 'lon', 'lat')} AS a, sqrt(power((lon + 869e-1) * 111194.93e0 * cos(radians(404e-1)), 2) + power((lat - 404e-1) * 111194.93e0, 2)) AS b FROM good) AS c"
    q["e21_height_selection"] = f"WITH m AS (SELECT {d.pct('refh - ground', 0.5)} AS off FROM good) SELECT pulse_index, CASE WHEN refh IS NULL THEN 'missing' WHEN track_num = 1 THEN 'raw' ELSE 'shifted' END AS status, {_r('CASE WHEN track_num = 1 THEN refh ELSE refh - off END')} AS h FROM pulses CROSS JOIN m"
    q["e22_role_stratum"] = f"SELECT CASE WHEN track_num <= 4 THEN 'calibration' ELSE 'test' END AS role, s.lo, count(*) AS n, {_r('avg(r)')} AS bias FROM residuals JOIN (SELECT 0e0 AS lo UNION ALL SELECT 3e0 UNION ALL SELECT 5e0) AS s ON snr >= s.lo GROUP BY 1, 2"
    q["e23_identity_key"] = "SELECT pulse_index, md5(concat_ws('|', " + ", ".join(d.text(c) for c in ("delta_time", "sweep_num", "track_num", "ref_class")) + ")) AS key_ FROM pulses"
    q["e26_evidence_grade"] = "SELECT event_type, CASE WHEN count(DISTINCT CASE WHEN value > 50 THEN user_id END) > 100 THEN 'D' WHEN count(DISTINCT user_id) > 120 THEN 'A' WHEN avg(value) > 10 THEN 'B' ELSE 'C' END AS grade FROM events GROUP BY event_type"
    q["e29_last_record"] = "SELECT sweep_num, track_num, max_by(refh, pulse_index) AS refh, count(*) AS n FROM good GROUP BY sweep_num, track_num"
    q["e30_workunit_preference"] = f"SELECT p_partkey AS id, CASE WHEN {d.matched('p_brand', '#([0-9]+)')} IN ('1', '2', '3') THEN 1 ELSE 2 END AS ql, p_size >= 10 AS preferred FROM part"
    q["e31_top_confusions"] = "SELECT t, p, n FROM (SELECT t, p, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, t, p) AS rk FROM truth WHERE t <> p GROUP BY t, p) AS w WHERE rk <= 2"
    q["e32_scene_loading"] = "SELECT doc_id, t AS class, CAST(n_chars AS DOUBLE) AS n FROM truth WHERE t IN (1, 2, 7) AND n_chars IS NOT NULL"
    q["e33_percentile_clip"] = f"WITH l AS (SELECT {d.pct('r', 0.01)} AS lo, {d.pct('r', 0.99)} AS hi FROM residuals) SELECT pulse_index FROM residuals CROSS JOIN l WHERE r BETWEEN lo AND hi"
    return q
