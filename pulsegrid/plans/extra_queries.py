"""Compositions and metadata queries: exports, checks against saved values, inventories, batch audits (§2.1, 2.2, 2.17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import geodesy
from pulsegrid.operators import spatial
from pulsegrid.plans.binding import SOURCES, with_tables
from pulsegrid.plans.dialect import Dialect
from pulsegrid.plans.operator_queries import Query, bound, rounded, shared
from pulsegrid.plans.statistics_queries import _r
from pulsegrid.sources import readers


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def query(name: str):
        def add(f: Query) -> Query:
            q[name] = f
            return f

        return add

    @query("e1_export_points")
    def _(spark, d):
        p = bound(spark, d, "SELECT pulse_index, lon, lat, refh, amp, snr, delta_time FROM good").withColumn("epsg", geodesy.utm_epsg(F.col("lon"), F.col("lat")))
        east, north = geodesy.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
        path = shared(spark, "export")
        p.select("*", east.alias("easting"), north.alias("northing"), F.lit(1).alias("classification")).write.parquet(path)
        return rounded(spark.read.parquet(path), 3)

    def _(spark, d):
        path = shared(spark, "points")
        bound(spark, d, "SELECT pulse_index, x, y, refh AS z, ref_class AS classification, track_num FROM good").write.partitionBy("track_num").parquet(path)
        return spark.read.parquet(path).select("pulse_index", F.col("track_num").cast("bigint").alias("track_num"), "classification")

    def _(spark, d):
        path = shared(spark, "raster")
        bound(spark, d, "SELECT CAST(floor(x / 4e0) AS BIGINT) AS col, CAST(floor(y / 4e0) AS BIGINT) AS row_, CAST(avg(refh) AS FLOAT) AS value FROM good GROUP BY 1, 2").write.parquet(path)
        return spark.read.parquet(path).select("col", "row_", F.col("value").isNotNull().alias("valid"))

    @query("s19_raw_bytes")
    def _(spark, d):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{d}/region.parquet")
        return files.select("length", F.substring("content", 1, 4).cast("string").alias("lead"), (F.expr("substring(content, length(content) - 3, 4)").cast("string") == "PAR1").alias("whole"))

    def _(spark, d):
        text = '{"features":[{"properties":{"roi_id":"a","class_label":"forest"},"geometry":{"coordinates":[[[0,0],[4,0],[4,4]]]}},{"properties":{"roi_id":"b","class_label":"water"},"geometry":{"coordinates":[[[5,5],[9,5],[9,9]]]}}]}'
        schema = "features array<struct<properties:map<string,string>,geometry:struct<coordinates:array<array<array<double>>>>>>"
        one = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", schema)["features"]).alias("f"))
        return one.select(F.col("f.properties")["roi_id"].alias("roi_id"), F.col("f.properties")["class_label"].alias("class_label"), F.size(F.col("f.geometry.coordinates")[0]).cast("bigint").alias("n_vertices"))

    @query("s25_node_bounds")
    def _(spark, d):
        p = bound(spark, d, "SELECT station_id, x, y FROM stations")
        side = 4000.0 / 2**5
        return p.select("station_id", F.format_string("5-%d-%d", F.floor(F.col("x") / side).cast("bigint"), F.floor(F.col("y") / side).cast("bigint")).alias("node"), (F.floor(F.col("x") / side) * side).alias("x0"), (F.floor(F.col("y") / side) * side).alias("y0"))

    def _(spark, d):
        rows = [tuple(vars(FillParameters(r).resolved()).values()) for r in (0.5, 1.0, 2.0, 5.0)]
        return spark.createDataFrame(rows, "resolution double, buffer double, closing double, radius double")

    def _(spark, d):
        rows = [(m, c.needs_density, c.needs_support, c.needs_scan_lines) for m in MODES for c in (ClassifierConfig(m),)]
        return spark.createDataFrame(rows, "mode string, density boolean, support boolean, scan_lines boolean")

    @query("e9_interpolation_check")
    def _(spark, d):
        refs = bound(spark, d, "SELECT ref_id, x, y, z FROM refs WHERE class = 2")
        held, rest = refs.where(F.col("ref_id") % 10 == 0), refs.where(F.col("ref_id") % 10 != 0)
        fit = spatial.plane_fit(held.drop("z"), rest, "z", 32, 30.0, "ref_id", "ref_id").join(held.select(F.col("ref_id").alias("k"), "z"), F.col("ref_id") == F.col("k"))
        e = F.col("value") - F.col("z")
        return rounded(fit.agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse")), 4)

    @query("e35_context_join")
    def _(spark, d):
        fit = spatial.plane_fit(bound(spark, d, "SELECT station_id, x, y FROM stations"), bound(spark, d, "SELECT ref_id, x, y, z FROM refs"), "z", 16, 30.0, "station_id", "ref_id")
        own = bound(spark, d, "SELECT station_id AS k, z FROM stations")
        return rounded(fit.join(own, F.col("station_id") == F.col("k")).select("station_id", "n", (F.col("z") - F.col("value")).alias("c7"), (F.col("z") - F.col("value") + 0.1).alias("c8")), 4)

    def attributes(spark, d) -> DataFrame:
        parts = [readers.attributes(spark.read.parquet(f"{d}/{t}.parquet")).select(F.lit(t).alias("object"), F.col("name").alias("field"), "type") for t in SOURCES]
        return reduce(DataFrame.unionByName, parts)

    @query("e15_schema_inventory")
    def _(spark, d):
        return attributes(spark, d).withColumn("documented", F.col("field").rlike("^[a-z_]+$"))

    @query("e27_batch_audit")
    def _(spark, d):
        parts = []
        for name in (*SOURCES, "absent"):
            try:
                rows = spark.read.parquet(f"{d}/{name}.parquet").agg(F.count("*").alias("n"))
                parts.append(rows.select(F.lit(name).alias("file"), F.lit("ok").alias("status"), "n"))
            except Exception as e:  # one row for each file, also for one that cannot be read
                parts.append(spark.createDataFrame([(name, type(e).__name__, None)], "file string, status string, n bigint"))
        return reduce(DataFrame.unionByName, parts)

    return q


def plans(d: Dialect) -> dict[str, str]:
    return {
        "e8_matched_summary": f"WITH s AS (SELECT granule, round(avg(r), 2) AS saved FROM residuals GROUP BY granule) SELECT t.granule, count(*) AS n, {_r('avg(r)')} AS bias, abs(avg(r) - max(saved)) <= 1e-2 AS agrees FROM residuals t JOIN s ON s.granule = t.granule GROUP BY t.granule",
        "e14_product_discovery": "SELECT source, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS state, min(doc_id) AS first_id FROM documents GROUP BY source",
        "e19_operation_choice": f"SELECT p_brand, p_partkey AS id, {_r('p_retailprice')} AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rk FROM part WHERE p_size > 5 AND p_type NOT LIKE '%BALLPARK%') AS w WHERE rk = 1",
        "e3_finite_helpers": f"SELECT sweep_num, {_r(d.pct('refh', 0.5))} AS med, {_r('avg(refh)')} AS mean, count(refh) AS n FROM pulses GROUP BY sweep_num",
        "s21_deduplicated_index": "SELECT min(page_id) AS page_id, " + d.matched("url", "://([^/]+)") + " AS host, count(*) AS n FROM pages GROUP BY 2",
    }


def oracle_sql() -> dict[str, str]:
    own = " UNION ALL ".join(f"SELECT '{name}' AS file, 'ok' AS status, count(*) AS n FROM {name}" for name in SOURCES)
    return {
        "e27_batch_audit": f"{own} UNION ALL SELECT 'absent', 'AnalysisException', NULL",
        "s25_node_bounds": with_tables(Dialect(False), "SELECT station_id, '5-' || CAST(floor(x / 125) AS BIGINT) || '-' || CAST(floor(y / 125) AS BIGINT) AS node, 125e0 * floor(x / 125) AS x0, 125e0 * floor(y / 125) AS y0 FROM stations"),
    }
