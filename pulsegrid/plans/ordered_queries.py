"""Ordered functions over hot keys (§2.6, 2.7) by prefix scan, and their oracles as windows, written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import ordered
from pulsegrid.plans.binding import with_tables
from pulsegrid.plans.dialect import Dialect
from pulsegrid.plans.operator_queries import GOOD, PULSES, STATIONS, bound, rounded
from pulsegrid.plans.statistics_queries import _r

Query = Callable[[SparkSession, str], DataFrame]
TRACK, ALONG = ["track_num"], ["sweep_num", "pulse_index"]
RESIDUALS = "SELECT * FROM residuals"


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def query(name: str):
        def add(f: Query) -> Query:
            q[name] = f
            return f

        return add

    @query("w1_rolling_median")
    def _(spark, d):
        return rounded(ordered.continuity(bound(spark, d, PULSES), ["sweep_num"], ["track_num", "pulse_index"], "amp", 1, 20.0))

    @query("w2_lag_difference")
    def _(spark, d):
        return rounded(ordered.jumps(bound(spark, d, GOOD), TRACK, ALONG, "refh", ["x", "y", "refh"]).select("pulse_index", "jump", "turn"), 4)

    @query("w3_path_length")
    def _(spark, d):
        return rounded(ordered.path_length(bound(spark, d, GOOD), TRACK, ALONG).select("track_num", "pulse_index", "dist"), 3)

    @query("w3_path_length_geographic")
    def _(spark, d):
        return rounded(ordered.path_length(bound(spark, d, GOOD), TRACK, ALONG, "lon", "lat", True).select("track_num", "pulse_index", "dist"), 2)

    @query("w4_heading")
    def _(spark, d):
        return rounded(ordered.headings(bound(spark, d, GOOD), TRACK, ALONG).select("pulse_index", "heading"), 4)

    @query("w5_rank")
    def _(spark, d):
        return ordered.ranks(bound(spark, d, STATIONS), [], "site", "rk").select("station_id", F.col("rk").cast("bigint").alias("rk"))

    @query("w9_axis_thirds")
    def _(spark, d):
        return rounded(ordered.thirds(bound(spark, d, GOOD), ["roi"], 2.0).select("pulse_index", "along", "role"), 4)

    @query("w10_longest_run")
    def _(spark, d):
        found = ordered.longest_runs(bound(spark, d, "SELECT track_num, bin, pulse_index, v > 5e-2 AS seen FROM bins"), ["track_num", "bin"], ["pulse_index"], "seen")
        return found.select("track_num", "bin", F.col("longest").cast("bigint").alias("longest"))

    @query("w13_scan_segments")
    def _(spark, d):
        found = ordered.segments(bound(spark, d, GOOD), TRACK, ALONG, "sweep_num", 3, 3.0, 3)
        return rounded(found.select("track_num", F.col("seg").cast("bigint").alias("seg"), "n", F.col("first").alias("first_sweep"), F.col("last").alias("last_sweep"), "length", "reversed"), 3)

    @query("w16_history")
    def _(spark, d):
        return ordered.history(bound(spark, d, PULSES), TRACK, "sweep_num").select("track_num", "sweep_num", "seen", F.col("steps").cast("bigint").alias("steps"))

    @query("a39_spearman")
    def _(spark, d):
        return rounded(ordered.spearman(bound(spark, d, RESIDUALS), TRACK, "snr", "amp"))

    @query("t3_case_pick")
    def _(spark, d):
        points = bound(spark, d, RESIDUALS).withColumn("strong", F.col("snr") >= 3)
        return rounded(ordered.case_pick(points, TRACK, "r", "pulse_index", "strong", 1.0, 2.0, 25.0), 6)

    @query("t5_even_pick")
    def _(spark, d):
        return ordered.even_pick(bound(spark, d, PULSES), TRACK, ["amp", "pulse_index"], 10).select("track_num", "pulse_index")

    @query("e25_pulse_distribution")
    def _(spark, d):
        found = ordered.shares(bound(spark, d, RESIDUALS), TRACK, "r")
        return found.select("pulse_index", (F.round(F.col("centred") + 1.7e-9, 5) + 0.0).alias("centred"), (F.round(F.col("share") + 1.7e-9, 7) + 0.0).alias("share"))

    return q


def oracle_sql() -> dict[str, str]:
    along = "(PARTITION BY track_num ORDER BY sweep_num, pulse_index)"
    step = "sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2))"
    o = {
        "w1_rolling_median": f"""
            WITH r AS (SELECT sweep_num, abs(amp - median(amp) OVER (PARTITION BY sweep_num ORDER BY track_num, pulse_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS r FROM pulses)
            SELECT sweep_num, {_r('median(r)')} AS med, {_r('quantile_cont(r, 0.95)')} AS p95, {_r('max(r)')} AS top, count(*) FILTER (r >= 20) AS jumps FROM r GROUP BY sweep_num""",
        "w2_lag_difference": f"""
            WITH p AS (SELECT pulse_index, refh, x, y, lag(refh) OVER w AS h0, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM good WINDOW w AS {along})
            SELECT pulse_index, {_r('abs(refh - h0)', 4)} AS jump, {_r('CASE WHEN h0 IS NOT NULL THEN degrees(acos(least(1, greatest(-1, (x * x0 + y * y0 + refh * h0) / (sqrt(x * x + y * y + refh * refh) * sqrt(x0 * x0 + y0 * y0 + h0 * h0)))))) END', 4)} AS turn FROM p""",
        "w3_path_length": f"SELECT track_num, pulse_index, {_r('sum(step) OVER (PARTITION BY track_num ORDER BY sweep_num, pulse_index ROWS UNBOUNDED PRECEDING)', 3)} AS dist FROM (SELECT *, coalesce({step}, 0) AS step FROM good WINDOW w AS {along}) AS s",
        "w3_path_length_geographic": f"""
            WITH p AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM good WINDOW w AS {along}),
            s AS (SELECT *, coalesce(2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat)) * cos(radians(lat0)) * pow(sin(radians(lon - lon0) / 2), 2)))), 0) AS step FROM p)
            SELECT track_num, pulse_index, {_r('sum(step) OVER (PARTITION BY track_num ORDER BY sweep_num, pulse_index ROWS UNBOUNDED PRECEDING)', 2)} AS dist FROM s""",
        "w4_heading": f"""
            WITH h AS (SELECT pulse_index, degrees(atan2(coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x), coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y))) AS h FROM good WINDOW w AS {along})
            SELECT pulse_index, {_r('CASE WHEN h < 0 THEN h + 360 ELSE h END', 4)} AS heading FROM h""",
        "w5_rank": "SELECT station_id, rank() OVER (ORDER BY site NULLS LAST) AS rk FROM stations",
        "w9_axis_thirds": f"""
            WITH c AS (SELECT roi, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM good GROUP BY roi),
            u AS (SELECT *, atan2(2 * b, a - c) / 2 AS t FROM c),
            s AS (SELECT pulse_index, roi, (x - mx) * cos(t) + (y - my) * sin(t) AS s FROM good JOIN u USING (roi)),
            e AS (SELECT roi, min(s) AS lo, max(s) AS hi FROM s GROUP BY roi)
            SELECT pulse_index, {_r('s', 4)} AS along, CASE WHEN s < lo + (hi - lo) / 3 - 1 THEN 'calibration' WHEN s > lo + (hi - lo) / 3 + 1 AND s < lo + 2 * (hi - lo) / 3 - 1 THEN 'selection' WHEN s > lo + 2 * (hi - lo) / 3 + 1 THEN 'test' ELSE 'guard' END AS role
            FROM s JOIN e USING (roi)""",
        "w10_longest_run": """
            WITH b AS (SELECT track_num, bin, v > 5e-2 AS seen, row_number() OVER (PARTITION BY track_num, bin ORDER BY pulse_index) - row_number() OVER (PARTITION BY track_num, bin, v > 5e-2 ORDER BY pulse_index) AS island FROM bins),
            r AS (SELECT track_num, bin, count(*) AS n FROM b WHERE seen GROUP BY track_num, bin, island)
            SELECT k.track_num, k.bin, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT track_num, bin FROM bins) AS k LEFT JOIN r USING (track_num, bin) GROUP BY k.track_num, k.bin""",
        "w13_scan_segments": f"""
            WITH s AS (SELECT *, {step} AS step, sweep_num - lag(sweep_num) OVER w AS gap FROM good WINDOW w AS {along}),
            m AS (SELECT track_num, greatest(median(CASE WHEN step > 0 THEN step END), 1e-6) AS m FROM s GROUP BY track_num),
            b AS (SELECT s.*, CASE WHEN gap > 3 OR step > 3 * m THEN 1 ELSE 0 END AS brk FROM s JOIN m USING (track_num)),
            g AS (SELECT *, sum(brk) OVER (PARTITION BY track_num ORDER BY sweep_num, pulse_index ROWS UNBOUNDED PRECEDING) AS seg, row_number() OVER {along} AS i FROM b),
            r AS (SELECT track_num, seg, count(*) AS n, min(sweep_num) AS first_sweep, max(sweep_num) AS last_sweep, coalesce(sum(CASE WHEN brk = 0 THEN step END), 0) AS len, arg_max(x, i) - arg_min(x, i) AS dx, arg_max(y, i) - arg_min(y, i) AS dy FROM g GROUP BY track_num, seg)
            SELECT track_num, CAST(seg AS BIGINT) AS seg, n, first_sweep, last_sweep, {_r('len', 3)} AS length, dx < 0 OR (abs(dx) <= 1e-9 AND dy < 0) AS reversed FROM r WHERE n >= 3""",
        "w16_history": "WITH c AS (SELECT track_num, sweep_num, count(*) AS c FROM pulses GROUP BY track_num, sweep_num) SELECT track_num, sweep_num, CAST(sum(c) OVER w AS BIGINT) AS seen, count(*) OVER w AS steps FROM c WINDOW w AS (PARTITION BY track_num ORDER BY sweep_num)",
        "a39_spearman": f"""
            WITH r AS (SELECT track_num, rank() OVER (PARTITION BY track_num ORDER BY snr) + (count(*) OVER (PARTITION BY track_num, snr) - 1) / 2e0 AS a, rank() OVER (PARTITION BY track_num ORDER BY amp) + (count(*) OVER (PARTITION BY track_num, amp) - 1) / 2e0 AS b FROM residuals)
            SELECT track_num, count(*) AS n, CASE WHEN count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b) THEN {_r('corr(a, b)')} END AS rho FROM r GROUP BY track_num""",
        "t3_case_pick": """
            WITH n AS (SELECT track_num, 'nearest' AS pick, pulse_index, r FROM residuals WHERE abs(r) <= 1 QUALIFY row_number() OVER (PARTITION BY track_num ORDER BY abs(r), pulse_index) = 1),
            g AS (SELECT *, row_number() OVER (PARTITION BY track_num ORDER BY abs(r) DESC, pulse_index) AS k FROM residuals WHERE abs(r) > 2),
            s AS (SELECT g.*, row_number() OVER (PARTITION BY g.track_num ORDER BY CASE WHEN (g.snr >= 3) <> (f.snr >= 3) OR sqrt(pow(g.x - f.x, 2) + pow(g.y - f.y, 2)) >= 25 THEN 0 ELSE 1 END, g.k) AS j FROM g JOIN g AS f ON f.track_num = g.track_num AND f.k = 1 WHERE g.k > 1)
            SELECT track_num, pick, pulse_index, round(r + 1.7e-9, 6) + 0e0 AS r FROM n UNION ALL SELECT track_num, 'gross1', pulse_index, round(r + 1.7e-9, 6) + 0e0 FROM g WHERE k = 1 UNION ALL SELECT track_num, 'gross2', pulse_index, round(r + 1.7e-9, 6) + 0e0 FROM s WHERE j = 1""",
        "t5_even_pick": """
            WITH p AS (SELECT track_num, pulse_index, row_number() OVER (PARTITION BY track_num ORDER BY amp, pulse_index) - 1 AS i, count(*) OVER (PARTITION BY track_num) AS n FROM pulses)
            SELECT DISTINCT track_num, pulse_index FROM p, (SELECT unnest(generate_series(0, 9)) AS k) AS s WHERE n <= 10 OR i = CAST(floor(k * (n - 1) / 9e0) AS BIGINT)""",
        "e25_pulse_distribution": f"WITH c AS (SELECT pulse_index, track_num, r - avg(r) OVER (PARTITION BY track_num) AS c FROM residuals) SELECT pulse_index, {_r('c')} AS centred, {_r('c * c / nullif(sum(c * c) OVER (PARTITION BY track_num), 0)', 7)} AS share FROM c",
    }
    return {name: with_tables(Dialect(False), text) for name, text in o.items()}
