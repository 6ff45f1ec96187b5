"""Summaries with exact quantiles of groups of any size (§2.5), and their oracles, written apart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import classify, quantiles, sampling, statistics
from pulsegrid.operators.lineage import cut
from pulsegrid.plans.binding import with_tables
from pulsegrid.plans.dialect import Dialect
from pulsegrid.plans.operator_queries import GOOD, PULSES, REFS, bound, rounded
from pulsegrid.plans.statistics_queries import MAD, _r

Query = Callable[[SparkSession, str], DataFrame]
NINE = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
RESIDUALS, TRUTH = "SELECT * FROM residuals", "SELECT * FROM truth"


def _plain(df: DataFrame, name: str, groups: list[str], *columns: str) -> DataFrame:
    """The groups and the columns of one value of a summary, without its name."""
    return rounded(df.select(*groups, *[F.col(f"{name}_{c}").alias(c) for c in columns]))


def _sites(df: DataFrame) -> DataFrame:
    """Medians of each site, and of these the median, range and list of sites; repeated pulses count once."""
    once = df.select("pulse_index", "roi", "track_num", "amp").distinct()
    site = cut(quantiles.grouped_quantiles(once, ["roi", "track_num"], {"m": "amp"}, [0.5]).select("roi", "track_num", F.col("m_q0").alias("m")))
    over = statistics.summaries(site, ["roi"], {"m": "m"}, {"med": 0.5})
    ids = site.groupBy("roi").agg(F.array_join(F.transform(F.sort_array(F.collect_set("track_num")), lambda v: v.cast("string")), ",").alias("ids"))  # one row a site
    return quantiles.keyed(over, ids, ["roi"]).select("roi", F.col("m_n").alias("sites"), F.col("m_med").alias("med"), (F.col("m_high") - F.col("m_low")).alias("span"), "ids")


def _scopes(df: DataFrame, value: str, scopes: dict[str, str | None]) -> DataFrame:
    """Count, median, p90 and largest absolute value for each scope: the whole table, or the groups of a column."""
    own = cut(df.select(*[c for c in scopes.values() if c], statistics.finite(value).alias("v")))
    parts = []
    for scope, column in scopes.items():
        found = statistics.summaries(own, [column] if column else [], {"v": F.abs("v")}, {"med": 0.5, "p90": 0.9})
        parts.append(found.select(F.lit(scope).alias("scope"), (F.col(column).cast("string") if column else F.lit("all")).alias("name"), F.col("v_n").alias("n"), F.col("v_med").alias("med"), F.col("v_p90").alias("p90"), F.col("v_high").alias("top")))
    return reduce(DataFrame.unionByName, parts)


def _wide(df: DataFrame, group: str, kinds: tuple[int, ...], values: dict[str, str]) -> DataFrame:
    """One row: the count of each kind and the quantiles of every value in it; a kind without rows has a count of zero."""
    found = statistics.summaries(df, [group], values, {"p05": 0.05, "med": 0.5, "p95": 0.95})
    cells = []
    for kind in kinds:
        here = F.col(group) == kind
        cells.append(F.coalesce(F.max(F.when(here, F.col("rows"))), F.lit(0)).alias(f"n_{kind}"))
        cells += [F.max(F.when(here, F.col(f"{name}_{p}"))).alias(f"{name}_{p}_{kind}") for name in values for p in ("p05", "med", "p95")]
    return found.agg(*cells)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def query(name: str):
        def add(f: Query) -> Query:
            q[name] = f
            return f

        return add

    @query("a11_surface_summary")
    def _(spark, d):
        return _plain(statistics.summaries(bound(spark, d, PULSES), ["granule"], {"v": "refh"}, NINE), "v", ["granule"], "n", "mean", "sd", "low", "high", *NINE)

    @query("a12_quantile_summary")
    def _(spark, d):
        return _plain(statistics.summaries(bound(spark, d, PULSES), ["roi"], {"v": "snr"}, {"p05": 0.05, "med": 0.5, "p95": 0.95}), "v", ["roi"], "p05", "med", "p95")

    @query("a16_audit_statistics")
    def _(spark, d):
        points = bound(spark, d, PULSES)
        found = statistics.summaries(points, ["track_num"], {"v": "refh"}, {"med": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
        nmad = quantiles.grouped_median_nmad(points, ["track_num"], "refh").select("track_num", "nmad")
        plain = quantiles.keyed(found, nmad, ["track_num"]).select("track_num", F.col("rows").alias("n_total"), F.col("v_n").alias("n_valid"), (F.col("rows") - F.col("v_n")).alias("rejected"), (F.col("v_n") / F.col("rows")).alias("share"), "nmad", *[F.col(f"v_{c}").alias(c) for c in ("mean", "low", "high", "med", "p90", "p95", "p99")])
        return rounded(plain)

    @query("a17_per_tile_metrics")
    def _(spark, d):
        found = statistics.summaries(bound(spark, d, REFS), ["tile"], {"z": "z", "y": "y"}, {"med": 0.5})
        long = [found.select("tile", F.lit(name).alias("field"), *[F.col(f"{name}_{c}").alias(c) for c in ("n", "mean", "med", "sd")]) for name in ("z", "y")]
        return rounded(long[0].unionByName(long[1]))

    @query("a19_class_summary_row")
    def _(spark, d):
        points = bound(spark, d, "SELECT ref_class, refh - ground AS hag, snr, discount * 10 AS density FROM pulses")
        return rounded(_wide(points, "ref_class", (1, 2, 7), {"hag": "hag", "snr": "snr", "density": "density"}))

    @query("a24_error_features")
    def _(spark, d):
        # subsets of true and predicted class, by the first step of the cascade about the pulses' own ground
        points = bound(spark, d, PULSES)
        kind = classify.first_class(F.col("refh"), F.col("ground"), F.lit(None), classify.CascadeOptions("height_only", ground_tolerance=0.4))
        names = ("snr", "amp", "discount", "tax")
        subset = F.concat_ws("-", F.col("ref_class").cast("string"), kind.cast("string"))
        s = statistics.summaries(points.withColumn("subset", subset), ["subset"], {n: n for n in names}, {"p05": 0.05, "med": 0.5, "p95": 0.95})
        each = [s.select("subset", F.lit(n).alias("feature"), *[F.col(f"{n}_{c}").alias(c) for c in ("n", "p05", "med", "p95")]) for n in names]
        return rounded(reduce(DataFrame.unionByName, each))

    @query("c7_selection")
    def _(spark, d):
        metrics = bound(spark, d, "SELECT roi AS candidate, 'candidate_selection' AS role, sqrt(avg(r * r)) AS rmse FROM residuals GROUP BY roi, granule")
        evidence = bound(spark, d, "SELECT DISTINCT roi AS candidate, roi = 'R' AS verified, roi <> 'R' AS complete, true AS provisional, CASE roi WHEN 'R' THEN 9 ELSE 4 END AS rank FROM pulses")
        return rounded(statistics.select_configuration(metrics, evidence))

    @query("t11_proportional_quota")
    def _(spark, d):
        return sampling.proportional(bound(spark, d, "SELECT roi, pulse_index FROM pulses WHERE refh IS NOT NULL"), "roi", ["pulse_index"], 1000)

    @query("a49_crosstab")
    def _(spark, d):
        known = bound(spark, d, "SELECT source, coalesce(lang, 'none') AS lang FROM documents")
        return known.groupBy("source").pivot("lang").count().na.fill(0)

    @query("a50_property_variation")
    def _(spark, d):
        each = bound(spark, d, "SELECT event_type, props FROM events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("property", "value"))
        return each.groupBy("event_type", "property").agg(F.count_distinct("value").alias("variants"), F.count("*").alias("n"), F.min("value").alias("first"))

    @query("a28_closure_summary")
    def _(spark, d):
        return rounded(_scopes(bound(spark, d, RESIDUALS), "r", {"overall": None, "track": "track_num", "roi": "roi", "sweep": "sweep_num"}))

    @query("a30_roi_track")
    def _(spark, d):
        points = bound(spark, d, PULSES)
        seen = points.groupBy("roi", "track_num").agg(F.count("*").alias("n"), F.count_if(F.col("snr") >= 5).alias("detected"))
        found = statistics.summaries(points, ["roi", "track_num"], {"refh": "refh", "amp": F.when(F.col("snr") >= 5, F.col("amp"))}, {"p10": 0.1, "med": 0.5, "p90": 0.9})
        both = quantiles.keyed(seen, found, ["roi", "track_num"])
        return rounded(both.select("roi", "track_num", "n", "detected", (F.col("detected") / F.col("n")).alias("rate"), *[f"{v}_{c}" for v in ("refh", "amp") for c in ("n", "p10", "med", "p90")]))

    @query("a31_site_variability")
    def _(spark, d):
        return rounded(_sites(bound(spark, d, PULSES)))

    @query("a36_metrics_by_track")
    def _(spark, d):
        return rounded(statistics.grouped_metrics(bound(spark, d, RESIDUALS), ["track_num"], "r"))

    @query("a37_calibrated_holdout")
    def _(spark, d):
        return rounded(statistics.calibrated_metrics(bound(spark, d, RESIDUALS), ["granule"], "r", F.col("track_num") <= 4))

    @query("a42_fd_edges")
    def _(spark, d):
        s = statistics.summaries(bound(spark, d, RESIDUALS), [], {"r": "r"}, {"q1": 0.25, "q3": 0.75})
        width = F.greatest(2 * (F.col("r_q3") - F.col("r_q1")) / F.pow("r_n", 1 / 3), F.lit(0.02))
        return rounded(s.withColumn("width", width).select("width", F.floor(F.col("r_low") / F.col("width")).cast("bigint").alias("first_edge"), F.ceil(F.col("r_high") / F.col("width")).cast("bigint").alias("last_edge")))

    @query("a54_footprint")
    def _(spark, d):
        s = statistics.summaries(bound(spark, d, PULSES), [], {"lon": "lon", "lat": "lat"}, {"med": 0.5})
        return s.select(*[F.round(c, 7).alias(n) for n, c in (("west", "lon_low"), ("east", "lon_high"), ("south", "lat_low"), ("north", "lat_high"), ("lon_med", "lon_med"), ("lat_med", "lat_med"))], F.round(F.col("lon_low") - 1e-3, 7).alias("buf_west"))

    @query("a55_utm_zone")
    def _(spark, d):
        s = quantiles.grouped_quantiles(bound(spark, d, PULSES), [], {"lon": "lon", "lat": "lat"}, [0.5])
        zone = F.least(F.greatest(F.floor((F.col("lon_q0") + 180) / 6) + 1, F.lit(1)), F.lit(60))
        return s.select((F.when(F.col("lat_q0") >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("bigint").alias("epsg"))

    @query("e18_height_sanity")
    def _(spark, d):
        flat = F.col("x") * F.col("x") + F.col("y") * F.col("y")
        values = {"vertical": F.col("refh") - F.col("ground"), "horizontal": F.sqrt(flat), "slant": F.sqrt(flat + F.col("refh") * F.col("refh"))}
        s = statistics.summaries(bound(spark, d, GOOD), [], values, {"p10": 0.1, "med": 0.5, "p90": 0.9})
        return rounded(s.select(*[f"{v}_{c}" for v in values for c in ("n", "p10", "med", "p90")]))

    @query("e24_model_differences")
    def _(spark, d):
        values = {"ab": F.col("tax") - F.col("discount"), "ac": F.col("tax") - 0.1, "bc": F.col("discount") - 0.1}
        s = statistics.summaries(bound(spark, d, PULSES), [], values, {"p05": 0.05, "med": 0.5, "p95": 0.95})
        each = [s.select(F.lit(pair).alias("pair"), *[F.col(f"{pair}_{c}").alias(c) for c in ("n", "mean", "p05", "med", "p95")], F.greatest(F.abs(f"{pair}_low"), F.abs(f"{pair}_high")).alias("top")) for pair in values]
        return rounded(reduce(DataFrame.unionByName, each))

    @query("e28_display_range")
    def _(spark, d):
        s = quantiles.grouped_quantiles(bound(spark, d, "SELECT * FROM bins"), ["track_num"], {"v": "v"}, [0.02, 0.98])
        return rounded(s.select("track_num", F.col("v_q0").alias("lo"), F.col("v_q1").alias("hi")))

    @query("e34_feature_summary")
    def _(spark, d):
        names = ("refh", "snr", "amp")
        s = statistics.summaries(bound(spark, d, PULSES), [], {n: n for n in names}, {"p05": 0.05, "med": 0.5, "p95": 0.95})
        each = [s.select(F.lit(n).alias("feature"), (F.col(f"{n}_n") / F.col("rows")).alias("valid"), *[F.col(f"{n}_{c}").alias(c) for c in ("p05", "med", "p95")]) for n in names]
        return rounded(reduce(DataFrame.unionByName, each))

    return q


def oracle_sql() -> dict[str, str]:
    def at(x: str, names: dict[str, float]) -> str:
        return ", ".join(f"{_r(f'quantile_cont({x}, {p})')} AS {n}" for n, p in names.items())

    three, edge = {"p05": 0.05, "med": 0.5, "p95": 0.95}, {"p10": 0.1, "med": 0.5, "p90": 0.9}
    moments = lambda x: f"{_r(f'avg({x})')} AS mean, {_r(f'min({x})')} AS low, {_r(f'max({x})')} AS high"
    o = {
        "a11_surface_summary": f"SELECT granule, count(refh) AS n, {moments('refh')}, {_r('stddev_pop(refh)')} AS sd, {at('refh', NINE)} FROM pulses GROUP BY granule",
        "a12_quantile_summary": f"SELECT roi, {at('snr', three)} FROM pulses GROUP BY roi",
        "a16_audit_statistics": f"""
            WITH m AS (SELECT track_num, median(refh) AS m FROM pulses GROUP BY track_num), n AS (SELECT track_num, {MAD} * median(abs(refh - m)) AS nmad FROM pulses JOIN m USING (track_num) GROUP BY track_num)
            SELECT track_num, count(*) AS n_total, count(refh) AS n_valid, count(*) - count(refh) AS rejected, {_r('count(refh) / count(*)')} AS share, {_r('max(nmad)')} AS nmad, {moments('refh')},
                {at('refh', {'med': 0.5, 'p90': 0.9, 'p95': 0.95, 'p99': 0.99})} FROM pulses JOIN n USING (track_num) GROUP BY track_num""",
        "a17_per_tile_metrics": " UNION ALL ".join(f"SELECT tile, '{f}' AS field, count({f}) AS n, {_r(f'avg({f})')} AS mean, {at(f, {'med': 0.5})}, {_r(f'stddev_pop({f})')} AS sd FROM refs GROUP BY tile" for f in ("z", "y")),
        "a19_class_summary_row": "SELECT " + ", ".join(f"count(*) FILTER (ref_class = {k}) AS n_{k}, " + ", ".join(f"{_r(f'quantile_cont({x}, {p}) FILTER (ref_class = {k})')} AS {n}_{c}_{k}" for n, x in (("hag", "refh - ground"), ("snr", "snr"), ("density", "discount * 10")) for c, p in three.items()) for k in (1, 2, 7)) + " FROM pulses",
        "a28_closure_summary": " UNION ALL ".join(f"SELECT '{scope}' AS scope, {name} AS name, count(r) AS n, {at('abs(r)', {'med': 0.5, 'p90': 0.9})}, {_r('max(abs(r))')} AS top FROM residuals {group}" for scope, name, group in (("overall", "'all'", ""), ("track", "CAST(track_num AS VARCHAR)", "GROUP BY track_num"), ("roi", "roi", "GROUP BY roi"), ("sweep", "CAST(sweep_num AS VARCHAR)", "GROUP BY sweep_num"))),
        "a24_error_features": "WITH u AS (SELECT ref_class || '-' || CASE WHEN refh IS NULL THEN 7 WHEN abs(refh - ground) <= 0.4 THEN 2 WHEN refh - ground < 0 THEN 7 WHEN refh - ground > 30 THEN 7 ELSE 1 END AS subset, * FROM pulses) " + " UNION ALL ".join(f"SELECT subset, '{x}' AS feature, count({x}) AS n, {at(x, three)} FROM u GROUP BY subset" for x in ("snr", "amp", "discount", "tax")),
        "a49_crosstab": "PIVOT (SELECT source, coalesce(lang, 'none') AS lang FROM documents) ON lang USING count(*) GROUP BY source",
        "a50_property_variation": "SELECT event_type, k AS property, count(DISTINCT json_extract_string(props, '$.' || k)) AS variants, count(*) AS n, min(json_extract_string(props, '$.' || k)) AS first FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events) AS e GROUP BY event_type, k",
        "c7_selection": f"WITH m AS (SELECT roi, sqrt(avg(r * r)) AS e FROM residuals GROUP BY roi, granule) SELECT roi AS candidate, 'provisional' AS status, 4 AS rank, {_r('avg(e)')} AS rmse FROM m WHERE roi <> 'R' GROUP BY roi ORDER BY avg(e), roi LIMIT 1",
        "t11_proportional_quota": """
            WITH p AS (SELECT roi, pulse_index, row_number() OVER (PARTITION BY roi ORDER BY pulse_index) - 1 AS i FROM pulses WHERE refh IS NOT NULL),
            c AS (SELECT roi, count(*) AS n, row_number() OVER (ORDER BY roi) - 1 AS k, count(*) * (1000e0 / sum(count(*)) OVER ()) AS e FROM p GROUP BY roi),
            q AS (SELECT *, floor(e) + CASE WHEN row_number() OVER (ORDER BY floor(e) - e, roi) <= 1000 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS q, k * 0.618033988749895e0 - floor(k * 0.618033988749895e0) AS ph FROM c),
            t AS (SELECT roi, CAST(floor((j + ph) * n / q) AS BIGINT) AS i FROM q, unnest(generate_series(0, CAST(q AS BIGINT) - 1)) AS s(j))
            SELECT roi, pulse_index FROM p JOIN t USING (roi, i)""",
        "a30_roi_track": "SELECT roi, track_num, count(*) AS n, count(*) FILTER (snr >= 5) AS detected, " + _r("count(*) FILTER (snr >= 5) / count(*)") + " AS rate, " + ", ".join(f"count({x}) AS {v}_n, " + at(x, {f"{v}_{n}": p for n, p in edge.items()}) for v, x in (("refh", "refh"), ("amp", "CASE WHEN snr >= 5 THEN amp END"))) + " FROM pulses GROUP BY roi, track_num",
        "a31_site_variability": f"WITH t AS (SELECT roi, track_num, quantile_cont(amp, 0.5) AS m FROM (SELECT DISTINCT pulse_index, roi, track_num, amp FROM pulses) AS s GROUP BY roi, track_num) SELECT roi, count(*) AS sites, {at('m', {'med': 0.5})}, {_r('max(m) - min(m)')} AS span, string_agg(CAST(track_num AS VARCHAR), ',' ORDER BY track_num) AS ids FROM t GROUP BY roi",
        "a36_metrics_by_track": f"""
            WITH m AS (SELECT track_num, median(r) AS m FROM residuals GROUP BY track_num)
            SELECT track_num, count(r) AS n, {_r('avg(r)')} AS mean, {_r('any_value(m)')} AS med, {_r('stddev_pop(r)')} AS sd, {_r('sqrt(avg(r * r))')} AS rmse, {_r('avg(abs(r))')} AS mae, {_r(f'{MAD} * median(abs(r - m))')} AS nmad,
                {at('r', {'p05': 0.05, 'p95': 0.95})}, {at('abs(r)', {'a50': 0.5, 'a68': 0.68, 'a90': 0.9, 'a95': 0.95})} FROM residuals JOIN m USING (track_num) GROUP BY track_num""",
        "a37_calibrated_holdout": f"WITH c AS (SELECT granule, median(r) AS o FROM residuals WHERE track_num <= 4 GROUP BY granule) SELECT granule, {_r('any_value(o)')} AS off, count(*) AS n, {_r('avg(r - o)')} AS bias, {_r('sqrt(avg(pow(r - o, 2)))')} AS rmse FROM residuals JOIN c USING (granule) WHERE track_num > 4 GROUP BY granule",
        "a42_fd_edges": f"WITH w AS (SELECT greatest(2 * (quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) / pow(count(*), 1 / 3e0), 0.02) AS w, min(r) AS a, max(r) AS b FROM residuals) SELECT {_r('w')} AS width, CAST(floor(a / w) AS BIGINT) AS first_edge, CAST(ceil(b / w) AS BIGINT) AS last_edge FROM w",
        "a54_footprint": "SELECT round(min(lon), 7) AS west, round(max(lon), 7) AS east, round(min(lat), 7) AS south, round(max(lat), 7) AS north, round(median(lon), 7) AS lon_med, round(median(lat), 7) AS lat_med, round(min(lon) - 1e-3, 7) AS buf_west FROM pulses",
        "a55_utm_zone": "SELECT CAST(CASE WHEN median(lat) >= 0 THEN 32600 ELSE 32700 END + least(60, greatest(1, 1 + floor((180 + median(lon)) / 6))) AS BIGINT) AS epsg FROM pulses",
        "e18_height_sanity": "SELECT " + ", ".join(f"count({x}) AS {v}_n, " + at(x, {f"{v}_{n}": p for n, p in edge.items()}) for v, x in (("vertical", "refh - ground"), ("horizontal", "sqrt(x * x + y * y)"), ("slant", "sqrt(x * x + y * y + refh * refh)"))) + " FROM good",
        "e24_model_differences": " UNION ALL ".join(f"SELECT '{n}' AS pair, count({x}) AS n, {_r(f'avg({x})')} AS mean, {at(x, three)}, {_r(f'max(abs({x}))')} AS top FROM pulses" for n, x in (("ab", "tax - discount"), ("ac", "tax - 0.1e0"), ("bc", "discount - 0.1e0"))),
        "e28_display_range": f"SELECT track_num, {at('v', {'lo': 0.02, 'hi': 0.98})} FROM bins GROUP BY track_num",
        "e34_feature_summary": " UNION ALL ".join(f"SELECT '{x}' AS feature, {_r(f'count({x}) / count(*)')} AS valid, {at(x, three)} FROM pulses" for x in ("refh", "snr", "amp")),
    }
    return {name: with_tables(Dialect(False), text) for name, text in o.items()}
