"""Statistics, predicates, sorts and set operations of the survey, as plans that both engines read (§2.3, 2.5, 2.7, 2.8)."""

from __future__ import annotations

from pulsegrid.plans.dialect import Dialect

MAD = "1.4826e0"


def _r(x: str, n: int = 5) -> str:
    """Rounded for comparison; the shift keeps the many exact half steps of the data off the rounding edge, and
    the zero makes a negative zero positive."""
    return f"(round(({x}) + 1.7e-9, {n}) + 0e0)"


def _summary(d: Dialect, x: str) -> str:
    ps = ", ".join(f"{_r(d.pct(x, p))} AS p{round(p * 100):02d}" for p in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))
    return f"count({x}) AS n, {_r(f'avg({x})')} AS mean, {_r(f'stddev_pop({x})')} AS sd, {_r(f'min({x})')} AS low, {_r(f'max({x})')} AS high, {ps}"


def _metrics(d: Dialect, table: str, x: str, group: str = "", ddof: int = 0) -> str:
    """Distribution metrics of x in table by group: bias, spread about the median, and absolute percentiles."""
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    part = f"PARTITION BY {group}" if group else ""
    sd = f"{'stddev_samp' if ddof else 'stddev_pop'}({x})"
    if ddof:
        sd = f"CASE WHEN count({x}) = 1 THEN 0e0 ELSE {sd} END"
    return f"""
        SELECT {g}count({x}) AS n, {_r(f'avg({x})')} AS mean, {_r('max(m)')} AS med, {_r(sd)} AS sd, {_r(f'sqrt(avg({x} * {x}))')} AS rmse, {_r(f'avg(abs({x}))')} AS mae,
            {_r(f'{MAD} * ' + d.pct(f'abs({x} - m)', 0.5))} AS nmad, {_r(d.pct(x, 0.05))} AS p05, {_r(d.pct(x, 0.95))} AS p95,
            {_r(d.pct(f'abs({x})', 0.5))} AS a50, {_r(d.pct(f'abs({x})', 0.68))} AS a68, {_r(d.pct(f'abs({x})', 0.9))} AS a90, {_r(d.pct(f'abs({x})', 0.95))} AS a95
        FROM (SELECT *, {d.pct_over(x, 0.5, part)} AS m FROM {table}) AS centred {by}"""


def _metrics_two_pass(d: Dialect, table: str, x: str, ddof: int = 0) -> str:
    """As _metrics without a group: the median comes from an aggregate, as a window over a whole table is one task."""
    body = _metrics(d, "t", x, "", ddof)
    return f"WITH t AS (SELECT * FROM {table}), c AS (SELECT {d.pct(x, 0.5)} AS m FROM t)" + body.replace(f"(SELECT *, {d.pct_over(x, 0.5, '')} AS m FROM t) AS centred", "t CROSS JOIN c")


CELLS = "CAST(floor(x / 5e0) AS BIGINT) AS ix, CAST(floor(y / 5e0) AS BIGINT) AS iy"


def noise_bits(d: Dialect) -> str:
    """Validity, cell median and deviation at 5 m, and reason bits; the flagship."""
    return f"""
        WITH v AS (SELECT *, {CELLS} FROM good),
        p AS (SELECT {d.pct('amp', 0.05)} AS low_amp FROM v),
        m AS (SELECT *, count(*) OVER cell AS n, {d.pick('percentile', 'quantile_cont')}(refh, 0.5) OVER cell AS med FROM v WINDOW cell AS (PARTITION BY ix, iy)),
        a AS (SELECT *, {d.pct_over('abs(refh - med)', 0.5, 'PARTITION BY ix, iy')} AS mad FROM m),
        b AS (SELECT pulse_index, n, CASE WHEN n >= 12 THEN med END AS med, CASE WHEN n >= 12 THEN mad END AS mad,
            CASE WHEN snr < 15e-1 THEN 1 ELSE 0 END + CASE WHEN snr < 18e-1 AND amp < low_amp THEN 2 ELSE 0 END + CASE WHEN amp - thres <= 0 THEN 4 ELSE 0 END
            + CASE WHEN n >= 12 AND abs(refh - med) > greatest(10e0, 8 * greatest({MAD} * mad, 75e-2)) THEN 8 ELSE 0 END AS reason FROM a CROSS JOIN p)
        SELECT pulse_index, CAST(n AS BIGINT) AS n, {_r('med')} AS med, {_r('mad')} AS mad, CAST(reason AS BIGINT) AS reason, reason = 0 AS keep FROM b"""


def _counts_by_bit(d: Dialect) -> str:
    return f"WITH q AS ({noise_bits(d)}) SELECT b AS bit, count(CASE WHEN (reason & b) <> 0 THEN 1 END) AS hits, {_r('avg(CASE WHEN (reason & b) <> 0 THEN 1e0 ELSE 0e0 END)')} AS share FROM q CROSS JOIN (SELECT CAST(k AS BIGINT) AS b FROM (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 4 UNION ALL SELECT 8) AS u) AS bits GROUP BY b"


def _confusion() -> str:
    cells = ", ".join(f"count(CASE WHEN t = {a} AND p = {b} THEN 1 END) AS c{a}{b}" for a in (1, 2, 7) for b in (1, 2, 7))
    return f"SELECT {cells}, count(*) AS n FROM truth"


def _report() -> str:
    rows = " UNION ALL ".join(f"SELECT {c} AS class, count(CASE WHEN t = {c} AND p = {c} THEN 1 END) AS hit, count(CASE WHEN p = {c} THEN 1 END) AS said, count(CASE WHEN t = {c} THEN 1 END) AS support, count(*) AS n FROM truth" for c in (1, 2, 7))
    return f"""
        WITH c AS ({rows}),
        f AS (SELECT *, coalesce(hit / nullif(said, 0), 0e0) AS pr, coalesce(hit / nullif(support, 0), 0e0) AS rc FROM c),
        g AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0e0) AS f1 FROM f)
        SELECT CAST(class AS BIGINT) AS class, round(pr, 6) AS pr, round(rc, 6) AS rc, round(f1, 6) AS f1, support FROM g
        UNION ALL SELECT -1, round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM g
        UNION ALL SELECT -2, round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM g
        UNION ALL SELECT -3, round(sum(hit) / max(n), 6), round(sum(hit) / max(n), 6), round(sum(hit) / max(n), 6), max(n) FROM g"""


def plans(d: Dialect) -> dict[str, str]:
    q: dict[str, str] = {}

    # ---- filters and predicates
    q["p1_validity_mask"] = "SELECT pulse_index, refh IS NOT NULL AND amp IS NOT NULL AND snr >= 2e0 AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND track_num BETWEEN 1 AND 6 AND sweep_num >= 10 AS valid FROM pulses"
    q["p2_staged_mask"] = f"""
        WITH a AS (SELECT * FROM pulses WHERE refh IS NOT NULL), b AS (SELECT * FROM a WHERE snr >= 2e0), t AS (SELECT {d.pct('amp', 0.1)} AS lo, {d.pct('amp', 0.99)} AS hi FROM b), c AS (SELECT b.* FROM b CROSS JOIN t WHERE amp BETWEEN lo AND hi)
        SELECT 'finite' AS stage, count(*) AS n FROM a UNION ALL SELECT 'snr', count(*) FROM b UNION ALL SELECT 'amp', count(*) FROM c"""
    q["p3_named_filters"] = "SELECT f.name, count(*) AS n, round(avg(refh), 5) AS mean FROM pulses CROSS JOIN (SELECT 'all' AS name, 0e0 AS lo, 1 AS t0, 7 AS t1 UNION ALL SELECT 'bright', 6e0, 1, 7 UNION ALL SELECT 'edge', 0e0, 6, 7) AS f WHERE refh IS NOT NULL AND snr >= f.lo AND track_num BETWEEN f.t0 AND f.t1 GROUP BY f.name"
    q["p4_display_filter"] = "SELECT pulse_index, x, y, refh FROM pulses WHERE snr BETWEEN 2e0 AND 8e0 AND x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 90 AND refh IS NOT NULL"
    q["p5_eligibility"] = d.pick(
        "SELECT pulse_index, array_join(array_compact(array(CASE WHEN roi = 'R' THEN 'roi' END, CASE WHEN granule = 'F' THEN 'granule' END, CASE WHEN delta_time < 820454400 THEN 'date' END)), ';') AS reasons FROM pulses",
        "SELECT pulse_index, array_to_string(list_filter([CASE WHEN roi = 'R' THEN 'roi' END, CASE WHEN granule = 'F' THEN 'granule' END, CASE WHEN delta_time < 820454400 THEN 'date' END], lambda v: v IS NOT NULL), ';') AS reasons FROM pulses",
    )
    q["p6_first_failing_reason"] = "SELECT pulse_index, CASE WHEN refh IS NULL THEN 'missing' WHEN snr < 2e0 THEN 'snr' WHEN amp < bg_mean THEN 'background' WHEN track_num > 6 THEN 'track' ELSE 'ok' END AS gate FROM pulses"
    q["p7_derived_snr"] = f"SELECT pulse_index, {_r('coalesce(CASE WHEN bg_std <> 0 THEN (amp - bg_mean) / bg_std END, amp / nullif(thres, 0))')} AS snr, {_r('amp / nullif(thres, 0)')} AS surface_snr, amp / nullif(thres, 0) >= 5e0 AS good_snr FROM pulses"
    q["p8_quality_flags"] = "SELECT pulse_index, CAST((CASE WHEN refh IS NULL THEN 1 ELSE 0 END) | (CASE WHEN snr < 5e0 THEN 2 ELSE 0 END) | (CASE WHEN snr < 3e0 THEN 4 ELSE 0 END) | (CASE WHEN coalesce(refh - ground, 0) > 10 THEN 8 ELSE 0 END) | (CASE WHEN coalesce(refh - ground, 0) > 2 THEN 16 ELSE 0 END) AS BIGINT) AS flags FROM pulses"
    q["p9_reason_bits"] = f"SELECT pulse_index, reason, CAST(bit_count(reason) AS BIGINT) AS n_reasons FROM ({noise_bits(d)}) AS q WHERE reason <> 0"
    q["p10_common_support"] = "SELECT pulse_index FROM pulses WHERE refh IS NOT NULL AND snr_bg IS NOT NULL AND thres IS NOT NULL AND ground IS NOT NULL AND refh - ground BETWEEN -50 AND 50"
    q["p11_snr_strata"] = f"SELECT s.stratum, count(*) AS n, {_r('avg(r)')} AS bias, {_r('sqrt(avg(r * r))')} AS rmse FROM residuals JOIN (SELECT 'all' AS stratum, -1e0 AS lo UNION ALL SELECT 'snr3', 3e0 UNION ALL SELECT 'snr5', 5e0) AS s ON snr >= s.lo GROUP BY s.stratum"
    q["p12_confusion_subset"] = "SELECT doc_id, CASE WHEN t = p THEN 'correct' WHEN t = 2 AND p = 1 THEN 'ground_missed' WHEN t = 1 AND p = 2 THEN 'false_ground' WHEN p = 7 THEN 'false_noise' WHEN t = 7 THEN 'noise_missed' ELSE 'other' END AS subset FROM truth"
    q["p13_component_role"] = "SELECT pulse_index, bin, CASE WHEN rk = 1 THEN 'main' WHEN v >= 5e-1 * top THEN 'secondary' ELSE 'rejected' END AS role FROM (SELECT pulse_index, bin, v, row_number() OVER (PARTITION BY pulse_index ORDER BY v DESC, bin) AS rk, max(v) OVER (PARTITION BY pulse_index) AS top FROM bins) AS w WHERE rk <= 8"
    offsets = {"c0": "0", "c1": "-30", "c2": "30", "c3": "tax", "c4": "tax - 30", "c5": "30 - tax", "c6": "-tax"}
    q["p14_height_candidates"] = "SELECT pulse_index, " + ", ".join(f"{_r(f'refh + ({x})')} AS {c}" for c, x in offsets.items()) + " FROM pulses WHERE refh IS NOT NULL"
    q["p15_candidate_residuals"] = f"""
        WITH c AS (SELECT refh - ground AS c0, refh - 30 - ground AS c1, refh + 30 - ground AS c2, refh + tax - ground AS c3 FROM pulses WHERE refh IS NOT NULL),
        u AS (SELECT 'c0' AS candidate, c0 AS r FROM c UNION ALL SELECT 'c1', c1 FROM c UNION ALL SELECT 'c2', c2 FROM c UNION ALL SELECT 'c3', c3 FROM c)
        SELECT candidate, count(*) AS n, {_r('avg(r)')} AS bias, {_r(d.pct('r', 0.5))} AS med, {_r('stddev_pop(r)')} AS sd FROM u GROUP BY candidate"""
    q["p16_outlier_marks"] = "SELECT pulse_index, abs(r) > 5e-1 AS over_half, abs(r) > 1 AS over_one, abs(r) > 2 AS over_two, CASE WHEN r > 0 THEN 'above' WHEN r < 0 THEN 'below' ELSE 'equal' END AS side FROM residuals"

    # ---- aggregates
    q["a1_grid_aggregate"] = f"SELECT {d.floor('x / 4e0')} AS col, {d.floor('y / 4e0')} AS row_, {_r('max(refh)')} AS z_max, {_r('avg(refh)')} AS z_mean, {_r(d.pct('refh', 0.5))} AS z_med, {_r(d.pct('refh', 0.95))} AS z_p95, count(*) AS n, {_r('max(snr)')} AS snr_max, {_r('avg(snr)')} AS snr_mean FROM good GROUP BY 1, 2 HAVING count(*) >= 2"
    q["a2_grid_percentile"] = f"SELECT {d.floor('x / 6e0')} AS col, {d.floor('y / 6e0')} AS row_, {_r(d.pct('refh', 0.1))} AS z, count(*) AS n FROM good GROUP BY 1, 2"
    q["a3_cell_median_mad"] = f"SELECT ix, iy, n, {_r('med')} AS med, {_r(d.pct('abs(refh - med)', 0.5))} AS mad FROM (SELECT ix, iy, refh, count(*) OVER w AS n, {d.pick('percentile', 'quantile_cont')}(refh, 0.5) OVER w AS med FROM (SELECT refh, {CELLS} FROM good) AS c WINDOW w AS (PARTITION BY ix, iy)) AS m WHERE n >= 12 GROUP BY ix, iy, n, med"
    q["a4_cell_robust_outlier"] = f"WITH m AS (SELECT pulse_index, ix, iy, refh, {d.pct_over('refh', 0.5, 'PARTITION BY ix, iy')} AS med FROM (SELECT *, {CELLS} FROM good) AS c), a AS (SELECT *, {d.pct_over('abs(refh - med)', 0.5, 'PARTITION BY ix, iy')} AS mad FROM m) SELECT pulse_index, abs(refh - med) > greatest(3e0, 6 * {MAD} * mad) AS outlier FROM a"
    q["a5_cell_low_surface"] = f"SELECT {d.floor('x / 10e0')} AS ix, {d.floor('y / 10e0')} AS iy, count(*) AS n, {_r('min(refh)')} AS low, {_r(d.pct('refh', 0.05))} AS p05, {_r(d.pct('refh', 0.1))} AS p10 FROM good GROUP BY 1, 2"
    q["a6_holdout_grid"] = f"SELECT {d.floor('x / 10e0')} AS ix, {d.floor('y / 10e0')} AS iy, count(CASE WHEN {d.mod('ref_id', '10')} = 0 THEN 1 END) AS held, count(*) AS n, {_r(f'avg(CASE WHEN {d.mod("ref_id", "10")} <> 0 THEN z END)')} AS z FROM refs WHERE class = 2 GROUP BY 1, 2"
    q["a7_global_robust_z"] = f"WITH c AS (SELECT {d.pct('amp', 0.5)} AS m FROM pulses), s AS (SELECT max(m) AS m, {MAD} * {d.pct('abs(amp - m)', 0.5)} AS nmad FROM pulses CROSS JOIN c) SELECT pulse_index, {_r('(amp - m) / greatest(nmad, 1e-9)')} AS z FROM pulses CROSS JOIN s"
    q["a8_median_nmad"] = f"WITH c AS (SELECT {d.pct('r', 0.5)} AS m FROM residuals) SELECT {_r('max(m)')} AS med, {_r(f'{MAD} * ' + d.pct('abs(r - m)', 0.5))} AS nmad, count(r) AS n FROM residuals CROSS JOIN c"
    q["a9_group_robust_z"] = f"WITH m AS (SELECT pulse_index, sweep_num, refh, count(refh) OVER w AS n, {d.pick('percentile', 'quantile_cont')}(refh, 0.5) OVER w AS med FROM pulses WHERE refh IS NOT NULL WINDOW w AS (PARTITION BY sweep_num)), a AS (SELECT *, {d.pct_over('abs(refh - med)', 0.5, 'PARTITION BY sweep_num')} AS mad FROM m) SELECT pulse_index, CASE WHEN n >= 4 THEN {_r(f'abs(refh - med) / greatest({MAD} * mad, 1e-6)', 4)} END AS z FROM a"
    q["a10_array_summary"] = f"SELECT count(*) AS n, count(refh) AS n_finite, {_r('min(refh)')} AS low, {_r(d.pct('refh', 0.02))} AS p02, {_r(d.pct('refh', 0.5))} AS p50, {_r(d.pct('refh', 0.98))} AS p98, {_r('max(refh)')} AS high FROM pulses"
    q["a13_distribution_metrics"] = _metrics_two_pass(d, "residuals", "r")
    q["a14_elevation_metrics"] = _metrics_two_pass(d, "residuals", "r", 1)
    q["a15_residual_decomposition"] = f"WITH c AS (SELECT {d.pct('r', 0.5)} AS m, avg(r) AS b FROM residuals) SELECT count(r) AS n, {_r('avg(r)')} AS bias, {_r('stddev_pop(r)')} AS crmse, {_r('sqrt(avg((r - m) * (r - m)))')} AS about_median, {_r('avg(r) * avg(r) / nullif(avg(r * r), 0)')} AS bias_share, {_r('1 - avg(r) * avg(r) / nullif(avg(r * r), 0)')} AS spread_share, abs(avg(r * r) - avg(r) * avg(r) - var_pop(r)) < 1e-6 AS adds_up FROM residuals CROSS JOIN c"
    q["a18_class_counts"] = "SELECT c.class, count(t.doc_id) AS n FROM (SELECT 1 AS class UNION ALL SELECT 2 UNION ALL SELECT 7 UNION ALL SELECT 9) AS c LEFT JOIN truth t ON t.t = c.class GROUP BY c.class"
    q["a20_confusion_matrix"] = _confusion()
    q["a20_class_report"] = _report()
    q["a21_all_files_rollup"] = "SELECT CASE WHEN grouping(source) = 1 THEN '__all__' ELSE source END AS file, count(*) AS n, count(CASE WHEN t = p THEN 1 END) AS hits FROM truth GROUP BY ROLLUP(source)"
    q["a22_class_drift"] = "WITH f AS (SELECT c.class, avg(CASE WHEN t = c.class THEN 1e0 ELSE 0e0 END) AS a, avg(CASE WHEN p = c.class THEN 1e0 ELSE 0e0 END) AS b FROM truth CROSS JOIN (SELECT 1 AS class UNION ALL SELECT 2 UNION ALL SELECT 7) AS c GROUP BY c.class) SELECT round(sum(abs(a - b)), 6) AS drift FROM f"
    q["a23_objective_score"] = f"WITH r AS ({_report()}) SELECT round(5e-1 * max(CASE WHEN class = 2 THEN f1 END) + 3e-1 * max(CASE WHEN class = 7 THEN f1 END) + 2e-1 * max(CASE WHEN class = -1 THEN f1 END) - CASE WHEN min(CASE WHEN class > 0 THEN f1 END) < 1e-1 THEN 1e-1 ELSE 0e0 END, 5) AS score FROM r"
    q["a25_threshold_shares"] = "SELECT t.lim AS lim, round(avg(CASE WHEN abs(r) < t.lim THEN 1e0 ELSE 0e0 END), 6) AS share FROM residuals CROSS JOIN (SELECT 1e-1 AS lim UNION ALL SELECT 5e-1 UNION ALL SELECT 1e0 UNION ALL SELECT 2e0) AS t GROUP BY t.lim"
    q["a26_sweep_summary"] = f"SELECT sweep_num, count(*) AS n, {_r(d.pct('amp', 0.5))} AS amp, {_r(d.pct('snr', 0.5))} AS snr, {_r('avg(CASE WHEN snr > 5 THEN 1e0 ELSE 0e0 END)')} AS good, {_r('avg(CASE WHEN refh IS NULL THEN 1e0 ELSE 0e0 END)')} AS missing FROM pulses GROUP BY sweep_num"
    q["a27_fixed_bin_stripe"] = f"WITH b AS (SELECT track_num, CAST({d.rint('amp')} AS BIGINT) AS bin FROM pulses), m AS (SELECT track_num, {d.mode('bin')} AS top FROM b GROUP BY track_num) SELECT b.track_num, max(m.top) AS top, {_r('avg(CASE WHEN abs(b.bin - m.top) <= 1 THEN 1e0 ELSE 0e0 END)')} AS share, avg(CASE WHEN abs(b.bin - m.top) <= 1 THEN 1e0 ELSE 0e0 END) > 3e-1 AS stripe FROM b JOIN m ON b.track_num = m.track_num GROUP BY b.track_num"
    q["a29_candidate_validation"] = "SELECT g.granule, count(*) AS n, count(CASE WHEN p.sweep_num <> g.sweep_num THEN 1 END) AS sweep_mismatch, count(CASE WHEN abs(p.x - g.x) > 1e-6 THEN 1 END) AS moved, count(CASE WHEN p.pulse_index IS NULL THEN 1 END) AS absent FROM good g LEFT JOIN pulses p ON p.pulse_index = g.pulse_index GROUP BY g.granule"
    q["a32_transition_counts"] = "WITH a AS (SELECT DISTINCT sweep_num, track_num FROM pulses WHERE granule = 'O'), b AS (SELECT DISTINCT sweep_num, track_num FROM pulses WHERE granule = 'F') SELECT coalesce(a.track_num, b.track_num) AS track_num, count(CASE WHEN a.track_num IS NULL THEN 1 END) AS gained, count(CASE WHEN b.track_num IS NULL THEN 1 END) AS lost, count(CASE WHEN a.track_num IS NOT NULL AND b.track_num IS NOT NULL THEN 1 END) AS held FROM a FULL JOIN b ON a.sweep_num = b.sweep_num AND a.track_num = b.track_num GROUP BY 1"
    q["a33_audit_groups"] = f"SELECT coalesce(roi, '*') AS roi, coalesce({d.text('track_num')}, '*') AS track, count(r) AS n, {_r('max(abs(r))')} AS top, {_r('avg(r)')} AS mean FROM residuals GROUP BY GROUPING SETS ((roi), (track_num), (roi, track_num), ())"
    q["a34_bin_agreement"] = f"SELECT track_num, {_r('avg(CASE WHEN abs(amp - snr * 10) <= 5e-1 THEN 1e0 ELSE 0e0 END)')} AS within_half, {_r('avg(CASE WHEN abs(amp - snr * 10) <= 1 THEN 1e0 ELSE 0e0 END)')} AS within_one, {_r('avg(amp - snr * 10)')} AS bias FROM pulses GROUP BY track_num"
    q["a35_spatial_summary"] = f"SELECT {d.floor('x / 20e0')} AS block, count(*) AS n, {_r('avg(r)')} AS mean, CASE WHEN count(*) >= 5 THEN {_r('stddev_pop(r)')} END AS sd FROM residuals GROUP BY 1"
    q["a36_context_table"] = f"SELECT granule, roi, track_num, snr >= 3 AS snr3, snr >= 5 AS snr5, count(*) AS n, {_r('avg(r)')} AS bias, {_r('sqrt(avg(r * r))')} AS rmse FROM residuals GROUP BY 1, 2, 3, 4, 5"
    clip = f"c0 AS (SELECT {d.pct('r', 0.5)} AS m FROM residuals), s0 AS (SELECT max(m) AS m, {MAD} * {d.pct('abs(r - m)', 0.5)} AS w FROM residuals CROSS JOIN c0)"
    for k in (1, 2, 3):
        clip += f", k{k} AS (SELECT r FROM residuals CROSS JOIN s{k - 1} WHERE abs(r - m) <= 3 * greatest(w, 1e-3)), c{k} AS (SELECT {d.pct('r', 0.5)} AS m FROM k{k}), s{k} AS (SELECT max(m) AS m, {MAD} * {d.pct('abs(r - m)', 0.5)} AS w, count(*) AS n FROM k{k} CROSS JOIN c{k})"
    q["a38_clipped_median"] = f"WITH {clip} SELECT {_r('m')} AS shift, {_r('w')} AS nmad, n FROM s3"
    q["a40_pearson"] = f"SELECT track_num, {_r('corr(r, snr)')} AS c_snr, {_r('corr(r, amp)')} AS c_amp FROM residuals GROUP BY track_num"
    q["a41_histogram_quantile"] = f"WITH h AS (SELECT track_num, {d.floor('snr * 5')} AS bin, count(*) AS n FROM pulses GROUP BY 1, 2), c AS (SELECT track_num, bin, sum(n) OVER (PARTITION BY track_num ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY track_num) AS total FROM h) SELECT track_num, min(CASE WHEN cum > 5e-1 * (total - 1) THEN bin END) AS q50, min(CASE WHEN cum > 9e-1 * (total - 1) THEN bin END) AS q90 FROM c GROUP BY track_num"
    q["a44_leave_one_out"] = f"WITH s AS (SELECT sum(r) AS t, count(*) AS n, avg(r) AS m FROM residuals) SELECT pulse_index, round((t - r) / (n - 1) - m, 9) AS delta FROM residuals CROSS JOIN s"
    q["a47_noise_counts"] = _counts_by_bit(d)
    q["a48_inventory"] = "SELECT v.lang, count(d.doc_id) AS n, CAST(coalesce(sum(d.n_chars), 0) AS BIGINT) AS bytes FROM (SELECT 'en' AS lang UNION ALL SELECT 'de' UNION ALL SELECT 'fr' UNION ALL SELECT 'es' UNION ALL SELECT 'xx') AS v LEFT JOIN documents d ON d.lang = v.lang GROUP BY v.lang"
    q["a52_window_screening"] = f"SELECT {d.floor('x / 100e0')} AS wx, {d.floor('y / 100e0')} AS wy, count(*) AS n, {_r('avg(CASE WHEN snr >= 5 THEN 1e0 ELSE 0e0 END)')} AS good, {_r(d.pct('refh', 0.95))} AS p95, {_r(f'avg(CASE WHEN snr >= 5 THEN 1e0 ELSE 0e0 END) * ({d.pct("refh", 0.95)} - {d.pct("refh", 0.05)})')} AS score FROM good GROUP BY 1, 2"
    q["a53_open_site"] = f"SELECT cx, cy, pulse_index, snr FROM (SELECT cx, cy, pulse_index, snr, row_number() OVER (PARTITION BY cx, cy ORDER BY snr DESC, pulse_index) AS rk FROM (SELECT *, {d.floor('x / 50e0')} AS cx, {d.floor('y / 50e0')} AS cy FROM good) AS c) AS w WHERE rk = 1"
    q["a56_rule_exploration"] = "SELECT lim, round(2e0 * sum(CASE WHEN said AND t = 7 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN said THEN 1 ELSE 0 END) + sum(CASE WHEN t = 7 THEN 1 ELSE 0 END), 0), 6) AS f1 FROM (SELECT t, lim, n_chars < lim AS said FROM truth CROSS JOIN (SELECT 200 AS lim UNION ALL SELECT 500 UNION ALL SELECT 1000 UNION ALL SELECT 2000) AS r) AS e GROUP BY lim"

    # ---- sorts and samples
    q["t1_top_k"] = "WITH a AS (SELECT pulse_index, 'amp' AS why, amp AS v, row_number() OVER (ORDER BY amp DESC, pulse_index) AS rk FROM (SELECT * FROM pulses ORDER BY amp DESC, pulse_index LIMIT 10) AS p), b AS (SELECT pulse_index, 'low' AS why, refh AS v, row_number() OVER (ORDER BY refh, pulse_index) AS rk FROM (SELECT * FROM pulses WHERE refh IS NOT NULL ORDER BY refh, pulse_index LIMIT 10) AS p) SELECT pulse_index, why, round(v, 6) AS v, rk FROM a UNION ALL SELECT pulse_index, why, round(v, 6), rk FROM b"
    q["t2_first_k_components"] = "SELECT pulse_index, bin, rk FROM (SELECT pulse_index, bin, row_number() OVER (PARTITION BY pulse_index ORDER BY v DESC, bin) AS rk FROM bins) AS w WHERE rk <= 3"
    q["t4_workunit_order"] = "SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size >= 25 THEN 0 ELSE 1 END, p_size, p_retailprice, p_partkey) AS pos FROM part"
    q["t6_range_step"] = f"SELECT DISTINCT p.sweep_num FROM pulses p JOIN (SELECT k FROM (SELECT 1 AS one) AS o CROSS JOIN {d.each('100', '400')} AS s WHERE {d.mod('k - 100', '7')} = 0) AS w ON p.sweep_num = w.k"

    # ---- sets
    q["u1_union_by_name"] = "SELECT 'ref' AS kind, ref_id AS id, x, y, z, tile FROM refs UNION ALL SELECT 'station', station_id, x, y, z, NULL FROM stations"
    q["u2_common_tracks"] = "SELECT sweep_num, track_num FROM pulses WHERE granule = 'O' INTERSECT SELECT sweep_num, track_num FROM pulses WHERE granule = 'F'"
    q["u3_missing_keys"] = "SELECT sweep_num, track_num FROM pulses WHERE granule = 'O' EXCEPT SELECT sweep_num, track_num FROM pulses WHERE granule = 'F'"
    q["u4_duplicates"] = "SELECT sweep_num, track_num, count(*) AS n FROM pulses GROUP BY sweep_num, track_num HAVING count(*) > 1"
    q["u5_set_equality"] = "SELECT (SELECT count(*) FROM (SELECT ref_id FROM refs EXCEPT SELECT p_partkey FROM part) AS a) = 0 AND (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT ref_id FROM refs) AS b) = 0 AS equal"
    return q
