"""Samples that are the same at any partitioning: by the order of a hash of the id."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.lineage import cut
from pulsegrid.operators.ordered import Ordered


def _order(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), F.col(key)]


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(*_order(key, seed)).limit(n)


def reservoir(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows of the largest hashes, so that the reservoirs of parts merge into that of the whole."""
    return df.orderBy(*[c.desc() for c in _order(key, seed)]).limit(n)


def per_group(df: DataFrame, group: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group."""
    window = Window.partitionBy(*group).orderBy(*_order(key, seed))
    return df.withColumn("_pos", F.row_number().over(window)).where(F.col("_pos") <= n).drop("_pos")


def stratified(df: DataFrame, band: Column, key: str, n: int, bands: int, seed: int = 0, shards: int = 64) -> DataFrame:
    """Half of n evenly from the bands, the rest from what is left. The first of each band are found among the first of its
    shards, so that no band is sorted in one task; keys must be unique."""
    each = max(1, n // (2 * bands))
    keyed = df.select(F.col(key), band.alias("_band"))
    order = _order(key, seed)
    some = keyed.withColumn("_pos", F.row_number().over(Window.partitionBy("_band", F.pmod(F.xxhash64(key), F.lit(shards))).orderBy(*order))).where(F.col("_pos") <= each)
    chosen = some.withColumn("_pos", F.row_number().over(Window.partitionBy("_band").orderBy(*order))).where(F.col("_pos") <= each).select(key)
    rest = df.join(F.broadcast(chosen), key, "left_anti").orderBy(*_order(key, seed + 1)).limit(max(0, n - each * bands))
    return df.join(F.broadcast(chosen), key, "left_semi").unionByName(rest)


def farthest(df: DataFrame, key: str, axes: tuple[str, str], n: int) -> DataFrame:
    """Greedy max-min sample in the normalised plane: n steps, each one aggregate over the whole table.

    The chosen rows, n at most, are kept on the driver; the distances to them are a constant expression.
    """
    lows = df.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)]).first()
    unit = [(F.col(a) - lows[f"min_{a}"]) / max(1e-12, lows[f"max_{a}"] - lows[f"min_{a}"]) for a in axes]
    flat = df.select(F.col(key).alias("k"), unit[0].alias("u"), unit[1].alias("v"))
    chosen: list = []
    for _ in range(n):
        if chosen:
            near = [(F.col("u") - p["u"]) ** 2 + (F.col("v") - p["v"]) ** 2 for p in chosen]
            score = F.least(*near) if len(near) > 1 else near[0]
        else:
            score = -((F.col("u") - 0.5) ** 2 + (F.col("v") - 0.5) ** 2)
        best = flat.agg(F.max(F.struct(score.alias("s"), (-F.col("k")).alias("m"), "k", "u", "v")).alias("b")).first()["b"]
        if best is None or best["k"] in {p["k"] for p in chosen}:
            break
        chosen.append(best)
    return df.where(F.col(key).isin([p["k"] for p in chosen]))


def block_bootstrap(df: DataFrame, block: str | Column, value: str | Column, replicates: int = 200, ends: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """One row: quantiles low and high of the mean of value over ``replicates`` resamples of blocks, and n, the replicates.

    A block stands in a replicate as often as a Poisson number of mean one says, which a hash of both gives; so each block's sum and
    count go into all replicates in one pass, at any partitioning, and no block meets another."""
    value = F.col(value) if isinstance(value, str) else value
    sums = df.groupBy((F.col(block) if isinstance(block, str) else block).alias("_b")).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    each = sums.select("_b", "_s", "_c", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    # the first 32 bits of a digest as a number in [0, 1)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("_b").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    steps, chance, total = [], exp(-1.0), 0.0
    for k in range(12):
        total += chance
        steps.append(total)
        chance /= k + 1
    weight = sum(((u >= t).cast("int") for t in steps), F.lit(0))
    means = each.withColumn("_w", weight).groupBy("rep").agg((F.sum(F.col("_w") * F.col("_s")) / F.nullif(F.sum(F.col("_w") * F.col("_c")), F.lit(0))).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(ends[0])).alias("low"), F.percentile("mean", F.lit(ends[1])).alias("high"), F.count("*").alias("n"))


GOLDEN = 0.618033988749895


def proportional(df: DataFrame, group: str, order: list[str], budget: int, parts: int | None = None) -> DataFrame:
    """At most ``budget`` rows: each group gets its share by largest remainder (ties to the smaller group), at even places along its
    order. The first place of the k-th group is shifted by the fraction of k golden ratios, so that picks do not line up over groups."""
    counts = cut(df.groupBy(group).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n").alias("n")).first()["n"] or 0
    budget = min(total, max(0, budget))
    exact = F.col("_n") * F.lit(budget / max(total, 1))
    shares = cut(Ordered(counts, [], [group], parts).running("_k", F.lit(1)).result().withColumn("_whole", F.floor(exact)).withColumn("_rest", -(exact - F.floor(exact))))
    left = budget - (shares.agg(F.sum("_whole").alias("n")).first()["n"] or 0)
    ranked = Ordered(shares, [], ["_rest", group], parts).running("_r", F.lit(1)).result()
    quotas = ranked.select(F.col(group).alias("_g"), "_n", (F.col("_k") - 1).alias("_k"), (F.col("_whole") + (F.col("_r") <= left).cast("bigint")).alias("_q")).where("_q > 0")
    rows = Ordered(df, [group], order, parts).running("_i", F.lit(1)).result()
    met = rows.join(quotas, F.col(group).eqNullSafe(F.col("_g")))
    phase = F.col("_k") * GOLDEN - F.floor(F.col("_k") * GOLDEN)
    at = F.ceil((F.col("_i") - 1) * F.col("_q") / F.col("_n") - phase)
    taken = [(j >= 0) & (j < F.col("_q")) & (F.floor((j + phase) * F.col("_n") / F.col("_q")) == F.col("_i") - 1) for j in (at - 1, at, at + 1)]
    return met.where(taken[0] | taken[1] | taken[2]).select(*df.columns)
