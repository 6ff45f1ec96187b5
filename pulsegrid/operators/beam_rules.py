"""Search for the convention of encoded beam angles, coarse to fine.

A rule says how two encoded angles are a direction: unit, which of them is azimuth and with what sign, where azimuth is zero and
which way it turns, what elevation is measured from, the sign of the vector, and whether lines start at the reference point or
at the instrument. Rules are scored on how well lines meet the other point, point from the instrument to the reference, and
meet each other in one origin.

A direction is linear in eight products of the angles' cosines and sines, whatever the rule and its biases. So one pass over the
data adds up products of these with each other and the points (a few thousand sums a unit), and the cosines, squared
distances and normal equations of every rule are made of them on the driver, also for the grid of biases around the
best ones. Only the few finalists get exact medians and the strict gate: their figures are made anew in each pass and counted in bins, never
written. Rows with a missing value are left out; with fewer than three rows there is no rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import astuple, dataclass, fields, replace
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.lineage import cut
from pulsegrid.operators.quantiles import MOST, finite

# The conventions.
BASES = ("refh", "instrument")
ZEROS = {"north": 0.0, "east": 90.0, "south": 180.0, "west": 270.0}
ROTATIONS = {"clockwise": 1.0, "counterclockwise": -1.0}
ELEVATIONS = ("elevation_from_horizon", "depression_from_horizon", "angle_from_up_vertical", "angle_from_down_vertical")
SIGNS = {"as_encoded": 1.0, "negated": -1.0}
UNITS = {"degree": math.pi / 180, "radian": 1.0}
TRANSFORMS = {"as_named": (0, 1, 1, 1), "swap_az_el": (1, 0, 1, 1), "negate_az": (0, 1, -1, 1), "negate_el": (0, 1, 1, -1), "negate_both": (0, 1, -1, -1), "swap_and_negate_both": (1, 0, -1, -1)}
BIASES = (0.0, -0.02, 0.02, -0.05, 0.05, -0.1, 0.1)
#: Rows that one numpy pass takes through all rules.
ROWS = 2048
SUMS = 17
#: Bins of a bracket, and rows that give the first brackets of the finalists' quantiles.
BINS = 4096
SAMPLE = 10_000


@dataclass(frozen=True)
class Rule:
    basis: str = "refh"
    zero: str = "north"
    rotation: str = "clockwise"
    elevation: str = "elevation_from_horizon"
    sign: str = "as_encoded"
    unit: str = "degree"
    transform: str = "as_named"
    az_bias: float = 0.0
    el_bias: float = 0.0

    def directions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unit vectors (east, north, up), three rows."""
        first, second, s, t = TRANSFORMS[self.transform]
        pair = (a * UNITS[self.unit], b * UNITS[self.unit])
        turn = math.radians(ZEROS[self.zero]) + ROTATIONS[self.rotation] * (s * pair[first] + math.radians(self.az_bias))
        el = t * pair[second] + math.radians(self.el_bias)
        kind = ELEVATIONS.index(self.elevation)
        flat, up = (np.cos(el), np.sin(el)) if kind < 2 else (np.sin(el), np.cos(el))
        return SIGNS[self.sign] * np.stack([flat * np.sin(turn), flat * np.cos(turn), -up if kind % 2 else up])


def all_rules() -> list[Rule]:
    return [Rule(*x) for x in product(BASES, ZEROS, ROTATIONS, ELEVATIONS, SIGNS, UNITS, TRANSFORMS)]


def _features(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the angles' cosines and sines that every rule of one unit is linear in, eight rows."""
    ca, sa, cb, sb = np.cos(a), np.sin(a), np.cos(b), np.sin(b)
    return np.stack([ca * cb, sa * cb, ca * sb, sa * sb, ca, sa, cb, sb])


def _matrix(rule: Rule) -> np.ndarray:
    """Three rows of eight factors: its product with the features is the rule's directions. Rules that name the same directions have
    equal factors to the last bit, as quarter turns are exact."""
    first, _, s, t = TRANSFORMS[rule.transform]
    c, d = math.cos(math.radians(rule.az_bias)), math.sin(math.radians(rule.az_bias))
    turn = ROTATIONS[rule.rotation]
    sine, cosine = np.array([turn * d, turn * s * c]), np.array([c, -s * d])  # of the turned azimuth, by its cosine and sine
    for _ in range(round(ZEROS[rule.zero] / 90)):
        sine, cosine = cosine, -sine
    c, d = math.cos(math.radians(rule.el_bias)), math.sin(math.radians(rule.el_bias))
    flat, up = np.array([c, -t * d]), np.array([d, t * c])
    kind = ELEVATIONS.index(rule.elevation)
    if kind >= 2:
        flat, up = up, flat
    place = np.array([[0, 1], [2, 3]])  # of products, by the sine of b and of a
    place = place.T if first else place  # rows are the elevation, columns the azimuth
    out = np.zeros((3, 8))
    for row, own in enumerate((sine, cosine)):
        out[row, place] = flat[:, None] * own[None, :]
    out[2, [4, 5] if first else [6, 7]] = -up if kind % 2 else up
    return SIGNS[rule.sign] * out + 0.0


def _parts() -> list[tuple[str, tuple[int, ...]]]:
    return [("n", ()), ("square", ()), ("features", (8, 8)), ("cosine", (8, 3)), ("segment", (24, 24)), *[(f"{k}{q}", shape) for q in "pi" for k, shape in (("sum", (3,)), ("square", ()), ("third", (64, 3)), ("gram", (24, 24)))]]


def _moments(own: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """Sums of each unit that the figures of all its rules are made of: products of the features with each other and the points."""
    units = list(UNITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[list] = [[0.0] * len(_parts()) for _ in units]
        for batch in batches:
            columns = np.array([c.to_numpy() for c in batch.columns])
            for at in range(0, columns.shape[1], ROWS):
                a, b, *rest = columns[:, at : at + ROWS]
                p, i = np.array(rest[:3]), np.array(rest[3:])
                seg = p - i
                square = (seg * seg).sum(0)
                length = np.sqrt(square)
                for k, unit in enumerate(units):
                    f = _features(a * UNITS[unit], b * UNITS[unit])
                    by = lambda q: (q[:, None, :] * f[None, :, :]).reshape(24, -1)  # noqa: E731, B023
                    pairs = (f[:, None, :] * f[None, :, :]).reshape(64, -1)
                    s = by(seg)
                    part = [len(a), square.sum(), f @ f.T, f @ (seg / np.where(length > 0, length, 1.0)).T, s @ s.T]
                    for q in (p, i):
                        g = by(q)
                        part += [q.sum(1), (q * q).sum(), pairs @ q.T, g @ g.T]
                    total[k] = [x + y for x, y in zip(total[k], part, strict=True)]
        rows = [np.concatenate([np.ravel(x + np.zeros(shape)) for x, (_, shape) in zip(t, _parts(), strict=True)]) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(units)), pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["unit", "sums"])

    parts = own.mapInArrow(run, "unit bigint, sums array<double>").select("unit", F.posexplode("sums").alias("pos", "s"))
    size = sum(math.prod(shape) for _, shape in _parts())
    flat = np.zeros((len(units), size))
    for r in parts.groupBy("unit", "pos").agg(F.sum("s").alias("s")).collect():  # a few thousand sums
        flat[r["unit"], r["pos"]] = r["s"]
    out: dict[str, dict[str, np.ndarray]] = {}
    for k, unit in enumerate(units):
        at = 0
        for name, shape in _parts():
            out.setdefault(unit, {})[name] = flat[k, at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
    return out


def _sums(moments: dict[str, dict[str, np.ndarray]], rules: list[Rule]) -> np.ndarray:
    """Of each rule, whatever its basis: n, cosines, squared distances, the six sums of the normal matrix, and for either basis the right
    side and the squares."""
    out = np.zeros((len(rules), SUMS))
    for k, rule in enumerate(rules):
        s, u = moments[rule.unit], _matrix(rule)
        flat = u.ravel()
        n = float(s["n"])
        m = np.eye(3) * n - u @ s["features"] @ u.T
        part = [n, float((u * s["cosine"].T).sum()), max(float(s["square"] - flat @ s["segment"] @ flat), 0.0), m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2]]
        for q in "pi":
            along = np.einsum("aj,bk,jkb->a", u, u, s[f"third{q}"].reshape(8, 8, 3))
            part += [*(s[f"sum{q}"] - along), float(s[f"square{q}"] - flat @ s[f"gram{q}"] @ flat)]
        out[k] = part
    return out


def _origin(sums: np.ndarray, basis: str) -> tuple[np.ndarray, float, float]:
    """Common origin of the lines, their root mean square distance from it, and the condition of the normal matrix."""
    xx, xy, xz, yy, yz, zz = sums[3:9]
    m = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])
    v, square = (sums[9:12], sums[12]) if basis == "refh" else (sums[13:16], sums[16])
    origin = np.linalg.lstsq(m, v, rcond=None)[0]
    return origin, math.sqrt(max(square - 2 * v @ origin + origin @ m @ origin, 0.0) / sums[0]), float(np.linalg.cond(m))


def _coarse(sums: np.ndarray, basis: str) -> float:
    """Merged score, smaller is better: distance of lines from the other point, from the common origin, and pointing the wrong way."""
    n, cosine = sums[0], sums[1] / sums[0]
    wrong = 1e6 + 1e5 * abs(cosine) if cosine < 0 else 1e5 * (1 - cosine)
    return math.sqrt(sums[2] / n) + 0.2 * _origin(sums, basis)[1] + wrong


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])


def _edges(a: float, b: float) -> np.ndarray:
    """Ascending edges from a to b; together they neither overflow nor leave the two."""
    t = np.linspace(0.0, 1.0, BINS + 1)
    out = np.maximum.accumulate(np.clip(a * (1 - t) + b * t, a, b))
    out[0], out[-1] = a, b
    return out


def _quantiles(own: DataFrame, rows: int, measured: Callable[[np.ndarray], Iterator[np.ndarray]], series: Sequence[int], ps: Sequence[float], most: int = MOST, sample: int = SAMPLE) -> tuple[dict[int, int], dict[int, list[float | None]]]:
    """Number of finite values and exact quantiles, linear between neighbouring ranks, of what measured makes of the columns of own.

    The measured values are made anew in each pass and never written. Every so many rows give first brackets; counts of fine bins
    narrow them, and a bracket that missed its rank starts again from the extremes; the last pass sends on at most ``most``
    values a quantile."""
    step = max(1, rows // sample)

    def passed(schema: str, start: Callable[[], list], see: Callable[[list, int, np.ndarray], None], told: Callable[[list], pa.RecordBatch]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = start()
            for batch in batches:
                columns = np.array([c.to_numpy() for c in batch.columns])
                for at in range(0, columns.shape[1], ROWS):
                    for k, v in enumerate(measured(columns[:, at : at + ROWS])):
                        see(state, k, v)
            yield told(state)

        return own.mapInArrow(run, schema)

    def ends(state: list, k: int, v: np.ndarray) -> None:
        have = state[k] = state[k] or [0, math.inf, -math.inf, [], 0]
        have[3].extend(v[-have[4] % step :: step].tolist())
        have[4] += len(v)
        v = v[np.isfinite(v)]
        if len(v):
            have[0], have[1], have[2] = have[0] + len(v), min(have[1], float(v.min())), max(have[2], float(v.max()))

    def of_ends(state: list) -> pa.RecordBatch:
        some = [(k, *x[:3], [y for y in x[3] if math.isfinite(y)]) for k, x in enumerate(state) if x]
        return pa.RecordBatch.from_pylist([dict(zip(("series", "n", "low", "high", "some"), x, strict=True)) for x in some], pa.schema([("series", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("some", pa.list_(pa.float64()))]))

    counts, extremes, some = {k: 0 for k in series}, {k: (math.inf, -math.inf) for k in series}, {k: [] for k in series}
    size = len(series)
    for r in passed("series bigint, n bigint, low double, high double, some array<double>", lambda: [None] * size, ends, of_ends).collect():  # bounded by the sample and a row a task
        k = r["series"]
        counts[k] += r["n"]
        extremes[k] = min(extremes[k][0], r["low"]), max(extremes[k][1], r["high"])
        some[k].extend(r["some"])
    # brackets are half open: from a, below b
    brackets, place = [], {}
    for k in series:
        if counts[k]:
            low, high = extremes[k][0], float(np.nextafter(extremes[k][1], np.inf))
            for j, p in enumerate(ps):
                a, b = low, high
                if len(some[k]) >= 100:
                    reach = 5 * math.sqrt(p * (1 - p) / len(some[k]))
                    a, b = np.quantile(some[k], [max(0.0, p - reach), min(1.0, p + reach)])
                    a, b = float(a), float(np.nextafter(b, np.inf))
                rank = p * (counts[k] - 1)
                place[k, j] = rank, len(brackets)
                for whole in (math.floor(rank), math.ceil(rank)):  # each alone, so that its bracket ends at one value
                    brackets.append({"series": k, "rank": whole, "a": a, "b": b, "below": None, "inside": counts[k], "ends": (low, high)})
    done = lambda x: x["below"] is not None and (x["inside"] <= most or np.nextafter(x["a"], np.inf) >= x["b"])
    while open_ := [w for w, x in enumerate(brackets) if not done(x)]:
        spans = sorted({(brackets[w]["series"], brackets[w]["a"], brackets[w]["b"]) for w in open_})
        edges = [_edges(a, b) for _, a, b in spans]
        of = {span: g for g, span in enumerate(spans)}

        def binned(state: list, k: int, v: np.ndarray) -> None:
            for g, (own_k, a, b) in enumerate(spans):  # noqa: B023
                if own_k == k:
                    have = state[g] = state[g] if state[g] is not None else np.zeros(BINS + 1, np.int64)
                    have[0] += int((v < a).sum() - (v == -np.inf).sum())
                    have[1:] += np.bincount(np.searchsorted(edges[g], v[(v >= a) & (v < b)], "right") - 1, minlength=BINS)  # noqa: B023

        def of_bins(state: list) -> pa.RecordBatch:
            at = [(w, i, int(x[i])) for w, x in enumerate(state) if x is not None for i in np.flatnonzero(x)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.int64()), pa.array([x[2] for x in at], pa.int64())], ["w", "bin", "n"])

        total = np.zeros((len(spans), BINS + 1), np.int64)
        size = len(spans)
        for r in passed("w bigint, bin bigint, n bigint", lambda: [None] * size, binned, of_bins).groupBy("w", "bin").agg(F.sum("n").alias("n")).collect():  # the bins of a few brackets
            total[r["w"]][r["bin"]] = r["n"]
        for w in open_:
            x = brackets[w]
            g = of[x["series"], x["a"], x["b"]]
            up_to = np.cumsum(total[g])
            if not up_to[0] <= x["rank"] < up_to[-1]:
                x["a"], x["b"] = x["ends"]
                continue
            i = int(np.searchsorted(up_to, x["rank"], "right"))
            x["a"], x["b"], x["below"], x["inside"] = float(edges[g][i - 1]), float(edges[g][i]), int(up_to[i - 1]), int(total[g][i])

    held = sorted({(x["series"], x["a"], x["b"]) for x in brackets if x["inside"] <= most})

    def within(state: list, k: int, v: np.ndarray) -> None:
        for g, (own_k, a, b) in enumerate(held):
            if own_k == k:
                state[g].append(v[(v >= a) & (v < b)])

    def of_within(state: list) -> pa.RecordBatch:
        flat = [(w, v) for w, x in enumerate(state) if x and len(v := np.concatenate(x))]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in flat], pa.int64()), pa.array([v for _, v in flat], pa.list_(pa.float64()))], ["w", "v"])

    values: dict[tuple, list[float]] = {span: [] for span in held}
    size = len(held)
    for r in passed("w bigint, v array<double>", lambda: [[] for _ in range(size)], within, of_within).collect():  # at most ``most`` values a rank
        values[held[r["w"]]].extend(r["v"])
    values = {span: sorted(v) for span, v in values.items()}

    def at(x: dict) -> float:
        some_values = values.get((x["series"], x["a"], x["b"]))
        return some_values[x["rank"] - x["below"]] if some_values else x["a"]

    found: dict[int, list[float | None]] = {k: [None] * len(ps) for k in series}
    for (k, j), (rank, w) in place.items():
        part = rank - math.floor(rank)
        found[k][j] = at(brackets[w]) if part == 0 else at(brackets[w]) * (1 - part) + at(brackets[w + 1]) * part
    return counts, found


def search(df: DataFrame, angles: Sequence[str], reference: Sequence[str], instrument: Sequence[str], top: int = 12, finalists: int = 8, biases: Sequence[float] = BIASES, rules: list[Rule] | None = None) -> DataFrame:
    """The finalists, one row each, best first by ``rank``: the rule's fields, its common origin, exact medians and 90th percentiles,
    ``passes`` (the strict gate) and ``score``. angles are the two encoded columns; the points are in metres (east, north, up)."""
    spark = df.sparkSession
    names = [*angles, *reference, *instrument]
    values = df.select(*[finite(c).alias(f"v{k}") for k, c in enumerate(names)]).dropna()
    middle = values.agg(*[F.avg(f"v{k}").alias(f"v{k}") for k in range(5, 8)], F.count("*").alias("n")).first()
    schema = ", ".join(f"{f.name} {'double' if f.type == 'float' else 'string'}" for f in fields(Rule))
    result = f"{schema}, origin_x double, origin_y double, origin_z double, origin_condition double, n bigint, cross_med double, cross_p90 double, angle_med double, cosine_med double, range_med double, origin_med double, origin_p90 double, passes boolean, score double, rank bigint"
    if middle["n"] < 3:
        return spark.createDataFrame([], result)
    shift = [middle[f"v{k}"] for k in range(5, 8)]  # about the instruments, so that squares lose no digits
    parts = spark.sparkContext.defaultParallelism * 2  # a row costs far more than it is wide
    own = cut(values.repartition(parts).select("v0", "v1", *[(F.col(f"v{k}") - shift[(k - 2) % 3]).alias(f"v{k}") for k in range(2, 8)]))

    moments = _moments(own)

    def best(asked: list[Rule], n: int) -> list[tuple[Rule, np.ndarray]]:
        lines = list(dict.fromkeys(replace(r, basis="refh") for r in asked))
        sums = dict(zip(lines, _sums(moments, lines), strict=True))
        order = {r: k for k, r in enumerate(asked)}
        scored = sorted((round(_coarse(sums[replace(r, basis="refh")], r.basis), 9), order[r], r) for r in asked)
        return [(r, sums[replace(r, basis="refh")]) for _, _, r in scored[:n]]

    base = [r for r, _ in best(rules or all_rules(), top)]
    chosen = best([replace(r, az_bias=x, el_bias=y) for r in base for x, y in product(biases, biases)], finalists)
    origins = [_origin(s, r.basis) for r, s in chosen]

    def measured(columns: np.ndarray) -> Iterator[np.ndarray]:
        a, b, p, i = columns[0], columns[1], columns[2:5], columns[5:8]
        seg = p - i
        length = np.sqrt((seg * seg).sum(0))
        for (rule, _), (origin, _, _) in zip(chosen, origins, strict=True):
            u = rule.directions(a, b)
            cross = np.sqrt((_cross(seg, u) ** 2).sum(0))
            along = (u * seg).sum(0)
            cosine = along / np.where(length > 0, length, np.nan)
            away = np.sqrt((_cross(origin[:, None] - (p if rule.basis == "refh" else i), u) ** 2).sum(0))
            yield from (cross, np.degrees(np.arctan2(cross, along)), cosine, length, away)

    kinds = ("cross", "angle", "cosine", "range", "origin")
    counts, values = _quantiles(own, middle["n"], measured, [len(kinds) * k + j for k in range(len(chosen)) for j in range(len(kinds))], (0.5, 0.9))
    medians = [{"rule": k} | {f"{c}_n": counts[len(kinds) * k + j] for j, c in enumerate(kinds)} | {f"{c}_q{x}": values[len(kinds) * k + j][x] for j, c in enumerate(kinds) for x in range(2)} for k in range(len(chosen))]
    rows = []
    for r in medians:
        rule, _ = chosen[r["rule"]]
        origin, _, condition = origins[r["rule"]]
        cross, angle, cosine, length = (r[f"{c}_q0"] for c in ("cross", "angle", "cosine", "range"))
        passes = cosine > 0.9999 and angle < 0.05 and cross < 5.0 and 100.0 <= length <= 50_000.0
        wrong = 1e6 + 1e5 * abs(cosine) if cosine < 0 else 1e5 * (1 - cosine)
        score = cross + 0.5 * r["cross_q1"] + 0.2 * r["origin_q0"] + 0.05 * r["origin_q1"] + 0.03 * math.log10(max(condition, 1e-300)) + 0.1 * abs(origin[2]) + 0.02 * math.hypot(*origin[:2]) + wrong + 100.0 * angle
        rows.append((*astuple(rule), *(float(o + s) for o, s in zip(origin, shift, strict=True)), condition, r["cross_n"], cross, r["cross_q1"], angle, cosine, length, r["origin_q0"], r["origin_q1"], bool(passes), float(score)))
    place = result.split(", ").index("score double")
    rows.sort(key=lambda x: (not x[place - 1], round(x[place], 9)))
    return spark.createDataFrame([(*x, k) for k, x in enumerate(rows, 1)], result)


def rule_count() -> int:
    return reduce(lambda a, b: a * len(b), (BASES, ZEROS, ROTATIONS, ELEVATIONS, SIGNS, UNITS, TRANSFORMS), 1)
