"""Readers and sinks: synonyms and contracts over any table Spark reads, metadata, and chunk-stable Parquet."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ordered names under which a logical field may come; the first present wins.
SYNONYMS = {"refh": ("refh", "height", "z"), "refh_amp": ("refh_amp", "amp", "amplitude"), "lon": ("refh_longitude", "longitude", "lon"), "lat": ("refh_latitude", "latitude", "lat")}


def is_finite(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def nulled(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns as null, so that aggregates skip them."""
    return df.select(*[F.when(is_finite(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def resolve(df: DataFrame, synonyms: Mapping[str, tuple[str, ...]] = SYNONYMS, required: bool = True) -> DataFrame:
    """Logical fields by their first synonym that is there; a missing one raises, or is left out."""
    chosen, missing = {}, []
    for field, names in synonyms.items():
        found = next((n for n in names if n in df.columns), None)
        if found:
            chosen[field] = F.col(found).alias(field)
        else:
            missing.append(field)
    if missing and required:
        raise ValueError(f"no column for {', '.join(missing)}")
    rest = [c for c in df.columns if c not in {n for names in synonyms.values() for n in names}]
    return df.select(*chosen.values(), *rest)


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def unpacked(column: str, fill: list[float], scale: float = 1.0, offset: float = 0.0) -> Column:
    """Fill values as null, then scale and offset, in that order."""
    return F.when(~F.col(column).isin(fill), F.col(column) * scale + offset)


def checked(df: DataFrame, key: list[str], nonnegative: list[str] = ()) -> DataFrame:
    """df, after one aggregate has found its key unique and its ids not negative."""
    found = df.agg(F.count("*").alias("n"), F.count_distinct(*key).alias("d"), *[F.min(c).alias(c) for c in nonnegative]).first()
    if found["n"] != found["d"]:
        raise ValueError(f"{found['n'] - found['d']} rows repeat their {', '.join(key)}")
    for c in nonnegative:
        if found[c] is not None and found[c] < 0:
            raise ValueError(f"{c} has negative values")
    return df


def attributes(df: DataFrame) -> DataFrame:
    """One row of metadata for each column: name, type, nullability."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "name string, type string, nullable boolean")


def json_safe(value):
    """Value as plain JSON: NaN and infinities become null, unknown objects their text."""
    if isinstance(value, Mapping):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [json_safe(v) for v in value]
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if hasattr(value, "item"):
        return json_safe(value.item())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return str(value)


def run_metadata(spark: SparkSession, config: Mapping) -> DataFrame:
    return spark.createDataFrame([(json.dumps(json_safe(config), sort_keys=True),)], "config string")


def write_stable(df: DataFrame, path: str) -> None:
    """Parquet with df's schema, also when there are no rows."""
    df.write.mode("overwrite").parquet(path)
