"""Validated alignment of predictions with reference records of the same points."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.statistics import finite


def align(prediction: DataFrame, reference: DataFrame, id_column: str, tolerances: Mapping[str, float], label: str, withheld: str | None = None) -> DataFrame:
    """(id, valid, gt) for every prediction: whether a usable reference record names it, and that record's label (0 if none).

    Raises where an id is null or twice on either side, where the reference names a point that is not predicted, or where
    a coordinate differs by more than its tolerance (two nulls or NaN are equal). The checks are one join and two
    aggregates; nothing but their counts comes to the driver. A withheld record, or one without finite coordinates,
    is not valid.
    """
    for name, side in (("prediction", prediction), ("reference", reference)):
        for column in (id_column, *tolerances):
            if column not in side.columns:
                raise ValueError(f"{name} has no {column}; identity cannot be verified")
        twice = side.groupBy(id_column).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id_column).isNull())
        if not twice.isEmpty():
            raise ValueError(f"{name} has null or repeated {id_column}; identity is ambiguous")
    own = prediction.select(F.col(id_column).alias("_id"), *[finite(c).alias(f"p_{c}") for c in tolerances], F.lit(True).alias("_there"))
    other = reference.select(F.col(id_column).alias("_ref"), *[finite(c).alias(f"r_{c}") for c in tolerances], F.col(label).alias("_gt"), (F.coalesce(F.col(withheld).cast("boolean"), F.lit(False)) if withheld else F.lit(False)).alias("_out"))
    met = own.join(other, F.col("_id") == F.col("_ref"), "full")
    matched = F.col("_id").isNotNull() & F.col("_ref").isNotNull()
    differs = [F.count_if(matched & ~F.coalesce(F.abs(F.col(f"p_{c}") - F.col(f"r_{c}")) <= t, F.col(f"p_{c}").isNull() & F.col(f"r_{c}").isNull())).alias(c) for c, t in tolerances.items()]
    found = met.agg(F.count_if(F.col("_id").isNull()).alias("_absent"), *differs).first()
    if found["_absent"]:
        raise ValueError(f"{found['_absent']} reference records are absent from the prediction")
    for c in tolerances:
        if found[c]:
            raise ValueError(f"{found[c]} records differ in {c}; coordinate identity is broken")
    usable = matched & ~F.coalesce("_out", F.lit(False))
    for c in tolerances:
        usable = usable & F.col(f"r_{c}").isNotNull()
    return met.select(F.col("_id").alias(id_column), usable.alias("valid"), F.coalesce(F.col("_gt").cast("bigint"), F.lit(0)).alias("gt"))
