"""Ordered functions over few and hot keys: a prefix scan that deals one key over many tasks.

Rows are dealt by ranges of (key, order) and written, each with its range. Windows then run inside a range, so no task holds
a key. What a key brings from one range to the next (a last row, a sum) goes through a summary of one row for each key and
range; of these only the keys that lie in several ranges matter, at most one for each range, so the summary is sent to
every task. Results equal those of a window over the whole key, up to the rounding of sums.

The order should end with an id: rows that are equal in all of it stay in one range, and their order is arbitrary, as in a
window. Nulls come first. Null keys form a key like any other. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.graph import counted
from pulsegrid.operators.lineage import cut
from pulsegrid.operators.quantiles import BROADCAST_ROWS, finite, grouped_quantiles, keyed, keyed_few

PART = "_part"


class Ordered:
    """A table dealt by ranges of keys and order; each method adds a column and leaves the rows as they are."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None):
        spark = df.sparkSession
        n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order, self.columns = list(keys), list(order), df.columns
        self.df = cut(df.repartitionByRange(n, *[F.col(f"`{c}`") for c in (*keys, *order)]).withColumn(PART, F.spark_partition_id()))

    def result(self) -> DataFrame:
        return self.df.drop(PART)

    def _local(self):
        return Window.partitionBy(PART, *self.keys).orderBy(*self.order)

    def _met(self, carried: DataFrame, column: str) -> DataFrame:
        """The rows with what their key brings into their range; there is at most one such key in a range."""
        other = carried.select(F.col(PART).alias("_p"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(self.keys)], column)
        on = [F.col(PART) == F.col("_p"), *[F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]]
        return self.df.join(F.broadcast(other), on, "left").drop("_p", *[f"_k{i}" for i in range(len(self.keys))])

    def _next(self, df: DataFrame) -> Ordered:
        out = object.__new__(Ordered)
        out.keys, out.order, out.columns, out.df = self.keys, self.order, self.columns, df
        return out

    def shifted(self, name: str, value: str | Column, forward: bool = False) -> Ordered:
        """The value of the row before (or, forward, after) in the key; null where there is none."""
        value = F.col(value) if isinstance(value, str) else value
        place = F.struct(*[F.col(f"`{c}`") for c in self.order])
        held = self.df.groupBy(PART, *self.keys).agg((F.min_by if forward else F.max_by)(F.struct(value.alias("v")), place).alias("_held"))
        across = Window.partitionBy(*self.keys).orderBy(F.desc(PART) if forward else F.asc(PART))  # as many rows as ranges
        carried = held.withColumn("_came", F.lag("_held").over(across)).where("_came IS NOT NULL")
        near = (F.lead if forward else F.lag)(F.struct(value.alias("v"))).over(self._local())
        return self._next(self._met(carried, "_came").withColumn(name, F.coalesce(near, F.col("_came"))["v"]).drop("_came"))

    def running(self, name: str, value: str | Column) -> Ordered:
        """Sum of the value from the first row of the key to this one; nulls add nothing."""
        value = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
        totals = self.df.groupBy(PART, *self.keys).agg(F.sum(value).alias("_total"))
        before = Window.partitionBy(*self.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.withColumn("_came", F.sum("_total").over(before)).where("_came IS NOT NULL")
        here = F.sum(value).over(self._local().rowsBetween(Window.unboundedPreceding, 0))
        return self._next(self._met(carried, "_came").withColumn(name, here + F.coalesce("_came", F.lit(0))).drop("_came"))

    def with_column(self, name: str, value: Column) -> Ordered:
        """A column made of a row alone."""
        return self._next(self.df.withColumn(name, value))


def ranks(df: DataFrame, keys: Sequence[str], value: str | Column, out: str = "rank", method: str = "min", descending: bool = False, parts: int | None = None) -> DataFrame:
    """df with the rank of value within keys: "min" (ties share the smallest), "average" or "dense". Nulls and NaN come last; they
    share a rank, which is null for "average". Ranks come from the counts of distinct values, so a common value is one row of the scan."""
    own = df.withColumn("_x", -finite(value) if descending else finite(value)).withColumn("_x", F.col("_x") + F.lit(0.0))
    counts = own.where("_x IS NOT NULL").groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    seen = Ordered(counts, keys, ["_x"], parts).running("_to", "_c")
    if method == "dense":
        seen = seen.running("_dense", F.lit(1))
    rank = {"min": F.col("_to") - F.col("_c") + 1, "average": F.col("_to") - (F.col("_c") - 1) / 2.0, "dense": F.col("_dense") if method == "dense" else None}[method]
    placed = cut(seen.result().select(*keys, "_x", rank.alias("_rank")))
    n = placed.count()
    other = placed.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_x": "_kx"})
    on = [F.col("_x") == F.col("_kx"), *[F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    met = own.join(F.broadcast(other) if n <= BROADCAST_ROWS else other, on, "left").drop("_kx", *[f"_k{i}" for i in range(len(keys))])
    if method == "average":
        return met.withColumn(out, F.col("_rank")).drop("_x", "_rank")
    last = own.groupBy(*keys).agg((F.count("_x") if method == "min" else F.count_distinct("_x")).alias("_n"))
    return keyed(met, last, keys).withColumn(out, F.coalesce("_rank", F.col("_n") + 1)).drop("_x", "_rank", "_n")


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, least: int = 5) -> DataFrame:
    """Rank correlation of a and b in each key over rows that have both; null for fewer than ``least`` pairs or a constant column."""
    both = df.withColumn("_a", finite(a)).withColumn("_b", finite(b)).select(*keys, "_a", "_b").where("_a IS NOT NULL AND _b IS NOT NULL")
    ranked = ranks(ranks(both, keys, "_a", "_ra", "average"), keys, "_b", "_rb", "average")
    varies = (F.min("_ra") < F.max("_ra")) & (F.min("_rb") < F.max("_rb"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when((F.count("*") >= least) & varies, F.corr("_ra", "_rb")).alias("rho"))


def path_length(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str = "x", y: str = "y", geographic: bool = False, radius: float = 6371008.8, parts: int | None = None) -> DataFrame:
    """df with ``step`` (from the row before, 0 at the start) and ``dist`` (their running sum). With ``geographic``, x and y are
    longitude and latitude in degrees and steps are great-circle distances."""
    o = Ordered(df, keys, order, parts).shifted("_was", F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    dx, dy = F.col(x) - F.col("_was.x"), F.col(y) - F.col("_was.y")
    if geographic:
        h = F.pow(F.sin(F.radians(dy) / 2), 2) + F.cos(F.radians(F.col(y))) * F.cos(F.radians(F.col("_was.y"))) * F.pow(F.sin(F.radians(dx) / 2), 2)
        step = 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    else:
        step = F.sqrt(dx * dx + dy * dy)
    return o.with_column("step", F.coalesce(step, F.lit(0.0))).running("dist", "step").result().drop("_was")


def jumps(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, vector: Sequence[str] | None = None, parts: int | None = None) -> DataFrame:
    """df with ``jump``, the absolute difference of value from the row before, and with a vector of three columns ``turn``, the angle
    between it and the one before in degrees. Null at the start of a key."""
    o = Ordered(df, keys, order, parts)
    held = [F.col(value).alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(vector or ())]]
    o = o.shifted("_was", F.struct(*held)).with_column("jump", F.abs(F.col(value) - F.col("_was.v")))
    if vector:
        total = lambda terms: sum(terms[1:], terms[0])
        now, was = [F.col(c) for c in vector], [F.col(f"_was.c{i}") for i in range(3)]
        norm = lambda v: F.sqrt(total([c * c for c in v]))
        cosine = total([p * q for p, q in zip(now, was, strict=True)]) / F.nullif(norm(now) * norm(was), F.lit(0.0))
        o = o.with_column("turn", F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))))
    return o.result().drop("_was")


def headings(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str = "x", y: str = "y", parts: int | None = None) -> DataFrame:
    """df with the heading in degrees from north, clockwise, of central differences, one-sided at the ends; 0 for a single row."""
    here = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    o = Ordered(df, keys, order, parts).shifted("_was", here).shifted("_will", here, forward=True)
    ahead, back = ([F.coalesce(F.col(f"{side}.{c}"), F.col(own)) for c, own in (("x", x), ("y", y))] for side in ("_will", "_was"))
    return o.with_column("heading", F.pmod(F.degrees(F.atan2(ahead[0] - back[0], ahead[1] - back[1])) + 360.0, F.lit(360.0))).result().drop("_was", "_will")


def _same(table: pa.Table, keys: int) -> np.ndarray:
    """Whether each row but the first has the keys (the first columns) of the row before; nulls are equal, and so are NaN."""
    out = np.ones(max(table.num_rows - 1, 0), bool)
    for c in table.columns[:keys]:
        now, was = c[1:], c[:-1]
        equal = pc.or_(pc.fill_null(pc.equal(now, was), False), pc.and_(pc.is_null(now, nan_is_null=True), pc.is_null(was, nan_is_null=True)))
        out &= equal.to_numpy()
    return out


def _stepped(df: DataFrame, keys: list[str], order: list[str], track: str, x: str, y: str, most_gap: float, parts: int | None) -> DataFrame:
    """Written rows (keys, PART, _row in it, _t, _x, _y) with _far (track grew by more than most_gap since the row before) and _step from it.

    Rows are dealt by ranges and sorted once; the row before is the one that comes before in the sorted stream, so neither the order's
    columns are written nor are rows dealt again for it. What goes over the edge of a range is told by the ranges' last rows."""
    n, m = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(keys)
    sorts = [*[f"_k{i}" for i in range(m)], *[f"_o{i}" for i in range(len(order))]]
    own = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)], F.col(track).alias("_t"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    own = own.repartitionByRange(n, *sorts).sortWithinPartitions(*sorts).select(*sorts[:m], "_t", "_x", "_y", F.spark_partition_id().alias(PART))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # the row before, with what is told of it; the rows before it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is None:
                head = [pa.array([True]), pa.array([None], pa.bool_()), pa.array([None], pa.float64())]
            else:
                head = [held[c].combine_chunks() for c in ("_first", "_far", "_step")]
                rows = pa.concat_tables([held.select(rows.column_names), rows])
            rows = rows.combine_chunks()
            same = _same(rows, m)
            less = lambda c: pc.subtract(rows[c][1:], rows[c][:-1])  # noqa: E731, B023
            dx, dy = less("_x"), less("_y")
            step = pc.sqrt(pc.add(pc.multiply(dx, dx), pc.multiply(dy, dy)))
            tail = [pa.array(~same), *[pc.if_else(pa.array(same), c, pa.scalar(None, c.type)) for c in (pc.greater(less("_t"), most_gap), step)]]
            for c, one, more in zip(("_first", "_far", "_step"), head, tail, strict=True):
                rows = rows.append_column(c, pa.chunked_array([one, *(more.chunks if isinstance(more, pa.ChunkedArray) else [more])], one.type).combine_chunks())
            yield from told(rows.slice(0, len(same)), ~same, done)
            held, done = rows.slice(len(same)), done + len(same)
        if held is not None:
            yield from told(held, np.array([True]), done)

    def told(rows: pa.Table, last: np.ndarray, done: int) -> Iterator[pa.RecordBatch]:
        out = rows.append_column("_row", pa.array(np.arange(done, done + rows.num_rows))).append_column("_last", pa.array(last))
        yield from out.select([*names, "_row", "_first", "_last", "_far", "_step"]).combine_chunks().to_batches()

    rows, _ = counted(own.mapInArrow(run, f"{fields}, _row bigint, _first boolean, _last boolean, _far boolean, _step double"))
    at = [f"_k{i}" for i in range(m)]
    across = Window.partitionBy(*at).orderBy(PART)  # as many rows as ranges
    point = F.struct("_t", "_x", "_y")
    ends = rows.where("_first OR _last").groupBy(PART, *at).agg(F.max(F.when(F.col("_first"), point)).alias("_a"), F.max(F.when(F.col("_last"), point)).alias("_b")).withColumn("_was", F.lag("_b").over(across)).where("_was IS NOT NULL")
    step = F.sqrt(F.pow(F.col("_a._x") - F.col("_was._x"), 2) + F.pow(F.col("_a._y") - F.col("_was._y"), 2))
    over = ends.select(F.col(PART).alias("_p"), *[F.col(k).alias(f"_r{k}") for k in at], (F.col("_a._t") - F.col("_was._t") > most_gap).alias("_cfar"), step.alias("_cstep"))
    met = rows.join(F.broadcast(over), [F.col(PART) == F.col("_p"), F.col("_first"), *[F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in at]], "left")
    return met.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], PART, "_row", "_t", "_x", "_y", F.coalesce("_far", "_cfar").alias("_far"), F.coalesce("_step", "_cstep").alias("_step"))


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], track: str, most_gap: float, factor: float | None = None, least: int = 1, x: str = "x", y: str = "y", parts: int | None = None) -> DataFrame:
    """Runs of rows, one row each: a run breaks where track grows by more than most_gap or, with a factor, where the step is
    longer than factor times the median positive step of the key. Runs of fewer than ``least`` rows are left out. Gives the
    keys, seg (from 0), n, first and last track, length, and reversed: whether display order (left to right, then upward) turns it round."""
    keys = list(keys)
    own = _stepped(df, keys, list(order), track, x, y, most_gap, parts)
    breaks = F.col("_far")
    if factor is not None:
        median = grouped_quantiles(own, keys, {"s": F.when(F.col("_step") > 0, F.col("_step"))}, [0.5]).select(*keys, F.col("s_q0").alias("_median"))
        own = keyed_few(own, median, keys)
        breaks = breaks | (F.col("_step") > factor * F.greatest(F.coalesce("_median", F.lit(0.0)), F.lit(1e-6)))
    rows = own.select(*keys, PART, "_row", "_t", "_x", "_y", "_step", F.coalesce(breaks.cast("bigint"), F.lit(0)).alias("_break"))
    o = object.__new__(Ordered)
    o.keys, o.order, o.columns, o.df = keys, ["_row"], rows.columns, rows
    o = o.running("seg", "_break")
    point, place = F.struct("_t", "_x", "_y"), F.struct(PART, "_row")
    ends = [F.min_by(point, place).alias("_a"), F.max_by(point, place).alias("_b")]
    length = F.sum(F.when(F.col("_break") == 0, F.col("_step")))
    found = o.df.groupBy(*keys, "seg").agg(F.count("*").alias("n"), *ends, length.alias("length")).where(F.col("n") >= least)
    dx, dy = F.col("_b._x") - F.col("_a._x"), F.col("_b._y") - F.col("_a._y")
    turned = (dx < 0) | ((F.abs(dx) <= 1e-9) & (dy < 0))
    return found.select(*keys, "seg", "n", F.col("_a._t").alias("first"), F.col("_b._t").alias("last"), F.coalesce("length", F.lit(0.0)).alias("length"), turned.alias("reversed"))


def longest_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str | Column, parts: int | None = None) -> DataFrame:
    """Longest run of consecutive rows with the flag in each key (0 where there is none); a null flag breaks a run."""
    flag = F.coalesce((F.col(flag) if isinstance(flag, str) else flag).cast("boolean"), F.lit(False))
    o = Ordered(df.withColumn("_on", flag.cast("bigint")), keys, order, parts).running("_island", 1 - F.col("_on"))
    return o.df.groupBy(*keys, "_island").agg(F.sum("_on").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("longest"))


def even_pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], picks: int, parts: int | None = None) -> DataFrame:
    """At most ``picks`` rows of each key, at evenly spaced places from its first to its last row (places are cut to whole
    numbers and taken once); all rows of a key that has no more."""
    o = Ordered(df, keys, order, parts).running("_i", F.lit(1))
    i, n = F.col("_i") - 1, F.col("_n")
    found = keyed_few(o.result(), df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    if picks == 1:
        return found.where(i == 0).drop("_i", "_n")
    # the first whole number k with floor(k (n - 1) / (picks - 1)) = i
    k = F.ceil(i * (picks - 1) / (n - 1).cast("double"))
    near = [F.floor(((k + d) * (n - 1)).cast("double") / (picks - 1)) == i for d in (-1, 0)]
    return found.where((n <= picks) | (i == 0) | near[0] | near[1]).drop("_i", "_n")


def continuity(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, reach: int = 4, jump: float = 6.0) -> DataFrame:
    """How steadily value runs along the order of each group: median, 95th percentile and largest absolute residual from the centred
    rolling median over ``reach`` rows on either side, and how many residuals reach ``jump``. Rows without a value are passed over; a
    group of nothing else has nulls and no jump. A group (such as the tracks of a sweep) is one task's."""
    own = df.select(*groups, *order, finite(value).alias("_v"))
    around = Window.partitionBy(*groups).orderBy(*order).rowsBetween(-reach, reach)
    far = own.where("_v IS NOT NULL").withColumn("_r", F.abs(F.col("_v") - F.percentile("_v", F.lit(0.5)).over(around)))
    told = far.groupBy(*groups).agg(F.percentile("_r", F.lit(0.5)).alias("med"), F.percentile("_r", F.lit(0.95)).alias("p95"), F.max("_r").alias("top"), F.count_if(F.col("_r") >= jump).alias("jumps"))
    out = keyed(own.select(*groups).distinct(), told, list(groups))
    return out.withColumn("jumps", F.coalesce("jumps", F.lit(0)))


def history(df: DataFrame, keys: Sequence[str], step: str, parts: int | None = None) -> DataFrame:
    """For every distinct step of a key, ``seen``: how many rows the key has up to and including it, and ``steps``: how many distinct steps."""
    counts = df.groupBy(*keys, step).agg(F.count("*").alias("_c"))
    return Ordered(counts, keys, [step], parts).running("seen", "_c").running("steps", F.lit(1)).result().drop("_c")


def shares(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """df with ``centred`` (value less the mean of its key) and ``share`` (its square of the sum of those squares; null where that is zero)."""
    v = finite(value)
    mean = df.groupBy(*keys).agg(F.avg(v).alias("_mean"))
    own = keyed_few(df, mean, keys).withColumn("centred", finite(value) - F.col("_mean"))
    total = own.groupBy(*keys).agg(F.sum(F.col("centred") * F.col("centred")).alias("_total"))
    return keyed_few(own, total, keys).withColumn("share", F.col("centred") * F.col("centred") / F.nullif(F.col("_total"), F.lit(0.0))).drop("_mean", "_total")


def thirds(df: DataFrame, keys: Sequence[str], gap: float, x: str = "x", y: str = "y") -> DataFrame:
    """df with ``along``, the place on the principal axis of its key's points (pointing to larger x, then y), and ``role`` by thirds of the
    axis, with a guard of width ``gap`` around both cuts: calibration, selection, test or guard."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    mean = df.where(both).groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    own = keyed_few(df, mean, list(keys)).withColumn("_dx", F.col(x) - F.col("_mx")).withColumn("_dy", F.col(y) - F.col("_my"))
    moments = own.groupBy(*keys).agg(F.sum(F.col("_dx") * F.col("_dx")).alias("_a"), F.sum(F.col("_dx") * F.col("_dy")).alias("_b"), F.sum(F.col("_dy") * F.col("_dy")).alias("_c"))
    angle = F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_c")) / 2  # in (-90, 90] degrees, so it points to larger x
    axis = moments.select(*keys, F.cos(angle).alias("_ux"), F.sin(angle).alias("_uy"))
    placed = keyed_few(own, axis, list(keys)).withColumn("along", F.col("_dx") * F.col("_ux") + F.col("_dy") * F.col("_uy"))
    extent = placed.groupBy(*keys).agg(F.min("along").alias("_low"), F.max("along").alias("_high"))
    met = keyed_few(placed, extent, list(keys))
    one, two = (F.col("_low") + k * (F.col("_high") - F.col("_low")) / 3 for k in (1, 2))
    half, s = gap / 2, F.col("along")
    role = F.when(s < one - half, "calibration").when((s > one + half) & (s < two - half), "selection").when(s > two + half, "test").when(s.isNotNull(), "guard")
    return met.withColumn("role", role).drop("_mx", "_my", "_dx", "_dy", "_ux", "_uy", "_low", "_high")


def case_pick(df: DataFrame, keys: Sequence[str], value: str, key: str, band: str, least_low: float, least_gross: float, separation: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows worth a look in each key: ``nearest``, the smallest absolute value of at most least_low; ``gross1``, the largest of more than
    least_gross; ``gross2``, the next that has another band or lies at least ``separation`` away from it, or else simply the next.
    Ties go to the smaller id. A pick that does not exist has no row."""
    size = F.abs(finite(value))
    row = F.struct(F.col(key).alias("id"), F.col(value).alias("value"), F.col(band).alias("band"), F.col(x).alias("x"), F.col(y).alias("y"))
    own = df.select(*keys, size.alias("_s"), row.alias("_row")).where("_s IS NOT NULL")
    best = lambda where: F.min_by(F.when(where, F.col("_row")), F.when(where, F.struct(-F.col("_s"), F.col("_row.id"))))
    low, gross = F.col("_s") <= least_low, F.col("_s") > least_gross
    first = own.groupBy(*keys).agg(F.min_by(F.when(low, F.col("_row")), F.when(low, F.struct("_s", "_row.id"))).alias("nearest"), best(gross).alias("gross1"))
    met = keyed_few(own.where(gross), first.select(*keys, "gross1"), list(keys))
    away = F.sqrt(F.pow(F.col("_row.x") - F.col("gross1.x"), 2) + F.pow(F.col("_row.y") - F.col("gross1.y"), 2))
    other = F.col("_row.id") != F.col("gross1.id")
    apart = other & (~F.col("_row.band").eqNullSafe(F.col("gross1.band")) | (away >= separation))
    second = met.groupBy(*keys).agg(F.coalesce(best(apart), best(other)).alias("gross2"))
    picks = keyed(first, second, keys)
    named = F.inline(F.array(*[F.struct(F.lit(n).alias("pick"), F.col(n).alias("row")) for n in ("nearest", "gross1", "gross2")]))
    return picks.select(*keys, named).where("row IS NOT NULL").select(*keys, "pick", F.col("row.id").alias(key), F.col("row.value").alias(value))
