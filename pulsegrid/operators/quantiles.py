"""Exact quantiles of groups of any size, by brackets that are narrowed in DataFrames.

One pass counts the values of each group; groups of at most ``most`` values are then left to Spark's exact aggregate. For the
others a mergeable sketch gives a bracket around every wanted rank, and one pass counts the values below and inside each
bracket; brackets that missed their rank start again from the extremes. While more than ``most`` values lie inside one, counts of
fine bins narrow it, and at last its distinct values give the quantile. The brackets are a table, one row for each
group, value and rank: nothing of it comes to the driver but the number of groups that are large and of brackets that are wide. No task
holds the values of a group; a task of the last step holds the distinct values of a bracket.

Passes read the input again. Where it is dear to compute, give a written table (``lineage.cut``).
Nulls, NaN and infinities are skipped; a group without any value has null quantiles; null keys form a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.graph import counted
from pulsegrid.operators.lineage import cut

#: Values that one task may hold for a group or a bracket.
MOST = 10_000
#: Ranks that the sketch may err by, as a share of the rows, is the inverse of this; brackets are twice as wide on either side.
ACCURACY = 5000
BINS = 1024
#: Large groups and brackets up to this number are sent to every task; beyond it both sides are shuffled.
BROADCAST_ROWS = 100_000


def finite(c: str | Column) -> Column:
    """The value as a double; null where it is null, NaN or infinite."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """left with the one row of right for its keys, where nulls are equal."""
    other = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return left.join(F.broadcast(other) if rows <= BROADCAST_ROWS else other, on, how).drop(*[f"_r{k}" for k in keys])


def keyed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left with the one row of right for its keys, nulls equal. No broadcast is forced: right may have any size."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(other, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def keyed_few(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """As keyed, for keys that may be few and hot: right is written and counted, and sent to every task if it is small, so that no task
    reads all rows of a key. Beyond that a key has few rows, and both sides are shuffled."""
    if not keys:
        return keyed(left, right, keys, how)
    held = cut(right)
    n = held.count()
    return keyed(left, F.broadcast(held) if n <= BROADCAST_ROWS else held, keys, how)


def grouped_quantiles(df: DataFrame, groups: list[str], values: dict[str, str | Column], ps: list[float], most: int = MOST, accuracy: int = ACCURACY, bins: int = BINS) -> DataFrame:
    """One row for each group (one in all for no group columns, also of no rows): the groups, and for every name in values the
    number of finite values (``name_n``) and their quantiles at ps, linear between neighbouring ranks (``name_q0``, ``name_q1``, ...)."""
    keys = [f"_g{i}" for i in range(len(groups))] + ["_value"]
    picked = [F.struct(F.lit(j).alias("_value"), finite(v).alias("_v")) for j, v in enumerate(values.values())]
    long = df.select(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)], F.inline(F.array(*picked)))  # the generator keeps long expressions from being copied
    told = cut(long.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")))
    large = told.where(F.col("_n") > most)
    n_large = large.count()
    exact = [F.count("_v").alias("_n"), F.percentile("_v", F.array(*[F.lit(float(p)) for p in ps])).alias("_q")]
    if n_large:
        rest = _joined(long, large.select(*keys), keys, n_large, "left_anti")
        own = _joined(long.where("_v IS NOT NULL"), large.select(*keys), keys, n_large, "left_semi")
        refined = _joined(large.select(*keys, "_n"), _refined(own, large, keys, ps, most, accuracy, bins, n_large), keys, n_large)
        all_ = rest.groupBy(*keys).agg(*exact).unionByName(refined)
    else:
        all_ = long.groupBy(*keys).agg(*exact)  # counts again, so that the many groups are not joined with their counts
    pivot = []
    for j, name in enumerate(values):
        here = F.col("_value") == j
        pivot.append(F.coalesce(F.max(F.when(here, F.col("_n"))), F.lit(0)).alias(f"{name}_n"))
        pivot += [F.max(F.when(here, F.col("_q")[i])).alias(f"{name}_q{i}") for i in range(len(ps))]
    out = all_.groupBy(*keys[:-1]).agg(*pivot)
    return out.withColumnsRenamed({f"_g{i}": g for i, g in enumerate(groups)})


def _refined(own: DataFrame, large: DataFrame, keys: list[str], ps: list[float], most: int, accuracy: int, bins: int, n_large: int) -> DataFrame:
    """Quantiles (array _q) of the large groups."""
    ends = [min(1.0, max(0.0, p + side * 2 / accuracy)) for p in ps for side in (-1, 1)]
    sketch = own.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), F.lit(accuracy)).alias("_s"))
    large = cut(_joined(large, sketch, keys, n_large))
    spans = F.array(*[F.struct((F.lit(float(p)) * (F.col("_n") - 1)).alias("rank"), F.col("_s")[2 * i].alias("a"), F.col("_s")[2 * i + 1].alias("b")) for i, p in enumerate(ps)])
    start = large.select(*keys, "_n", "_min", "_max", spans.alias("_spans"))

    # how many values lie below and inside each bracket
    seen = _joined(own, start.select(*keys, "_spans"), keys, n_large)
    sums = []
    for i in range(len(ps)):
        a, b = F.col("_spans")[i]["a"], F.col("_spans")[i]["b"]
        sums += [F.count_if(F.col("_v") < a).alias(f"_below{i}"), F.count_if((F.col("_v") >= a) & (F.col("_v") <= b)).alias(f"_inside{i}")]
    counts = seen.groupBy(*keys).agg(*sums)
    of = [F.struct(F.lit(i).alias("_p"), F.col("_spans")[i]["rank"].alias("_rank"), F.col("_spans")[i]["a"].alias("_a"), F.col("_spans")[i]["b"].alias("_b"), F.col(f"_below{i}").alias("_below"), F.col(f"_inside{i}").alias("_inside")) for i in range(len(ps))]
    known = _joined(start, counts, keys, n_large).select(*keys, "_n", "_min", "_max", F.inline(F.array(*of)))
    missed = (F.col("_below") > F.floor("_rank")) | (F.col("_below") + F.col("_inside") <= F.ceil("_rank"))
    again = {"_a": "_min", "_b": "_max", "_below": F.lit(0), "_inside": "_n"}
    known = known.select(*keys, "_p", "_rank", *[F.when(missed, F.col(new) if isinstance(new, str) else new).otherwise(F.col(c)).alias(c) for c, new in again.items()])
    # a bracket is narrow if few values lie inside, or at most two distinct ones
    narrow = (F.col("_inside") <= most) | (F.col("_a") == F.col("_b"))
    brackets = cut(known.withColumn("_done", narrow))
    key = [*keys, "_p"]
    while True:
        wide = brackets.where("NOT _done")
        n_wide = wide.count()
        if not n_wide:
            break
        inside = _within(own, wide, keys, n_wide)
        place = (F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)
        binned = inside.withColumn("_bin", F.least(F.lit(bins - 1), F.floor(place * bins)).cast("int"))
        binned = binned.groupBy(*key, "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        binned = _joined(binned, wide.select(*key, "_rank", "_below"), key, n_wide)
        up_to = Window.partitionBy(*key).orderBy("_bin")  # as many rows as bins
        binned = binned.withColumn("_to", F.col("_below") + F.sum("_c").over(up_to)).withColumn("_from", F.col("_to") - F.col("_c"))
        holds = lambda r: (F.col("_from") <= r) & (F.col("_to") > r)
        first, last = holds(F.floor("_rank")), holds(F.ceil("_rank"))
        at = lambda which, c: F.max(F.when(which, F.col(c)))
        found = binned.groupBy(*key, "_rank").agg(at(first, "_bin").alias("_i"), at(last, "_bin").alias("_j"), at(first, "_low").alias("_low"), at(first, "_high").alias("_mid"), at(last, "_low").alias("_next"), at(last, "_high").alias("_high"), at(first, "_from").alias("_from"), at(first, "_c").alias("_c"), at(last, "_c").alias("_d"))
        # two neighbouring ranks in two bins are the last value of one and the first of the other
        apart = F.col("_i") != F.col("_j")
        found = found.select(*key, "_rank", F.when(apart, F.col("_mid")).otherwise(F.col("_low")).alias("_a"), F.when(apart, F.col("_next")).otherwise(F.col("_high")).alias("_b"), F.when(apart, F.lit(None)).otherwise(F.col("_from")).alias("_below"), F.when(apart, F.col("_c") + F.col("_d")).otherwise(F.col("_c")).alias("_inside"))
        brackets = cut(brackets.where("_done").unionByName(found.withColumn("_done", F.col("_below").isNull() | narrow)))
    apart = brackets.where("_below IS NULL").select(*key, "_rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"))
    held = brackets.where("_below IS NOT NULL")
    n_held = held.count()
    distinct = _within(own, held, keys, n_held).groupBy(*key, "_v").agg(F.count("*").alias("_c"))
    distinct = _joined(distinct, held.select(*key, "_rank", "_below"), key, n_held)
    up_to = Window.partitionBy(*key).orderBy("_v")  # the distinct values of a bracket
    distinct = distinct.withColumn("_to", F.col("_below") + F.sum("_c").over(up_to))
    reach = lambda r: F.min(F.when(F.col("_to") > r, F.col("_v")))
    found = distinct.groupBy(*key, "_rank").agg(reach(F.floor("_rank")).alias("_lo"), reach(F.ceil("_rank")).alias("_hi")).unionByName(apart)
    part = F.col("_rank") - F.floor("_rank")
    value = F.when(part == 0, F.col("_lo")).otherwise(F.col("_lo") * (1 - part) + F.col("_hi") * part)
    each = found.withColumn("_x", value).groupBy(*keys).agg(*[F.max(F.when(F.col("_p") == i, F.col("_x"))).alias(f"_x{i}") for i in range(len(ps))])
    return each.select(*keys, F.array(*[f"_x{i}" for i in range(len(ps))]).alias("_q"))


def _within(own: DataFrame, brackets: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Values inside the brackets of their group: keys, _p, _v, _a and _b."""
    packed = brackets.groupBy(*keys).agg(F.collect_list(F.struct("_p", "_a", "_b")).alias("_own"))  # as many as ranks
    met = _joined(own, packed, keys, rows)
    hit = F.filter("_own", lambda s: (F.col("_v") >= s["_a"]) & (F.col("_v") <= s["_b"]))
    return met.select(*keys, "_v", F.inline(hit))


def grouped_median_nmad(df: DataFrame, groups: list[str], value: str | Column, eps: float = 0.0, factor: float = 1.4826, **how) -> DataFrame:
    """Count, median, and normalised median absolute deviation (at least eps) of value in each group."""
    own = df.select(*[F.col(f"`{g}`") for g in groups], F.explode(F.array(finite(value))).alias("_x"))
    centre = cut(grouped_quantiles(own, groups, {"x": "_x"}, [0.5], **how))
    n = centre.count()
    away = _joined(own, centre.select(*groups, "x_q0"), groups, n) if groups else own.crossJoin(F.broadcast(centre.select("x_q0")))  # one row
    spread = grouped_quantiles(away.withColumn("_d", F.abs(F.col("_x") - F.col("x_q0"))), groups, {"d": "_d"}, [0.5], **how)
    nmad = F.when(F.col("x_n") > 0, F.greatest(F.lit(float(eps)), F.lit(factor) * F.col("d_q0"))).alias("nmad")
    both = _joined(centre, spread, groups, n) if groups else centre.crossJoin(F.broadcast(spread))
    return both.select(*groups, F.col("x_n").alias("n"), F.col("x_q0").alias("med"), nmad)


def with_median_nmad(df: DataFrame, group: str, value: str | Column, eps: float = 0.0, factor: float = 1.4826, most: int = MOST, of: DataFrame | None = None) -> DataFrame:
    """df with _n, _med and _nmad of value in the row's group, as ``grouped_median_nmad``; null where the group is. Groups of more than
    ``most`` rows are told by their brackets. The rows of the others meet in one shuffle, in which both medians are taken, and no table of
    groups is joined with them; rows of large groups go along dealt by a hash, or where there are no others are not shuffled at all. Rows are counted, and large groups
    read, in ``of``, a table of the same rows that is cheaper to read."""
    own, of = df, df if of is None else of
    has = F.col(f"`{group}`").isNotNull()
    large, n_large = counted(of.where(has).groupBy(F.col(f"`{group}`").alias("_g")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most))
    told = {c: F.lit(None).cast(t) for c, t in (("_ln", "bigint"), ("_lmed", "double"), ("_lnmad", "double"))}
    if n_large:
        of_large = of.where(has).join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large.hint("merge"), F.col(f"`{group}`") == F.col("_g"), "left_semi")
        found = counted(grouped_median_nmad(of_large, [group], value, eps, factor).select(F.col(f"`{group}`").alias("_g"), F.col("n").alias("_ln"), F.col("med").alias("_lmed"), F.col("nmad").alias("_lnmad")))[0]
        own = own.join(F.broadcast(found) if n_large <= BROADCAST_ROWS else found.hint("merge"), F.col(f"`{group}`") == F.col("_g"), "left").drop("_g")
    else:
        own = own.withColumns(told)
    rest = of.where(has).count() - (large.agg(F.sum("_rows")).first()[0] or 0)
    if not rest:
        return own.withColumnsRenamed({"_ln": "_n", "_lmed": "_med", "_lnmad": "_nmad"})
    here = has & F.col("_ln").isNull()
    # a column, as Spark does not see that equal expressions deal the rows alike; dealt first, so that the value does not go along twice
    own = own.withColumn("_apart", F.when(~here, F.xxhash64(*[F.col(f"`{c}`") for c in of.columns if c in df.columns])))
    own = own.repartition(F.col(f"`{group}`"), "_apart").withColumn("_x", finite(value))
    met = Window.partitionBy(F.col(f"`{group}`"), "_apart")
    own = own.withColumn("_med", F.percentile("_x", F.lit(0.5)).over(met)).withColumn("_n", F.count("_x").over(met))
    away = F.percentile(F.abs(F.col("_x") - F.col("_med")), F.lit(0.5)).over(met)
    own = own.withColumn("_nmad", F.when(F.col("_n") > 0, F.greatest(F.lit(float(eps)), F.lit(factor) * away)))
    return own.withColumns({c: F.when(here, F.col(c)).otherwise(F.col(f"_l{c[1:]}")) for c in ("_n", "_med", "_nmad")}).drop("_x", "_apart", *told)
