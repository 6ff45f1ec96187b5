"""Registry of the queries for the survey's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.plans import extra_queries, grouped_queries, library_queries, operator_queries, ordered_queries, sequence_queries, statistics_queries, waveform_queries
from pulsegrid.plans.binding import for_spark, with_tables
from pulsegrid.plans.dialect import Dialect

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (statistics_queries, sequence_queries, extra_queries)


def planned(text: str) -> Query:
    """A query from SQL text over the domain tables."""
    sql, used = for_spark(with_tables(Dialect(True), text))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in used})

    return run


def queries() -> dict[str, Query]:
    return {name: planned(text) for module in MODULES for name, text in module.plans(Dialect(True)).items()} | operator_queries.queries() | extra_queries.queries() | library_queries.queries() | grouped_queries.queries() | ordered_queries.queries() | waveform_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(Dialect(False), text) for module in MODULES for name, text in module.plans(Dialect(False)).items()} | operator_queries.oracle_sql() | extra_queries.oracle_sql() | library_queries.oracle_sql() | grouped_queries.oracle_sql() | ordered_queries.oracle_sql() | waveform_queries.oracle_sql()
