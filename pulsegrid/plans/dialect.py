"""The few places where Spark SQL and the oracle's SQL spell the same operation differently."""

from __future__ import annotations


class Dialect:
    """Spells expressions for Spark, or for DuckDB when ``spark`` is false."""

    def __init__(self, spark: bool):
        self.spark = spark

    def pick(self, spark: str, duck: str) -> str:
        return spark if self.spark else duck

    def pct(self, x: str, p: float | str, where: str = "") -> str:
        """Exact percentile with linear interpolation; nulls are skipped."""
        tail = f" FILTER (WHERE {where})" if where else ""
        return f"{self.pick('percentile', 'quantile_cont')}({x}, {p}){tail}"

    def pct_over(self, x: str, p: float, window: str) -> str:
        return f"{self.pick('percentile', 'quantile_cont')}({x}, {p}) OVER ({window})"

    def disc(self, x: str, p: float) -> str:
        """Lower percentile: an element of the group."""
        return self.pick(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})", f"quantile_disc({x}, {p})")

    def rint(self, x: str) -> str:
        return self.pick(f"rint({x})", f"round_even({x}, 0)")

    def each(self, first: str, last: str, name: str = "k") -> str:
        """A lateral table of the whole numbers from first to last."""
        return self.pick(f"LATERAL (SELECT explode(sequence(CAST({first} AS BIGINT), CAST({last} AS BIGINT))) AS {name})", f"LATERAL (SELECT unnest(generate_series(CAST({first} AS BIGINT), CAST({last} AS BIGINT))) AS {name})")

    def floor(self, x: str) -> str:
        return f"CAST(floor({x}) AS BIGINT)"

    def mod(self, a: str, b: str) -> str:
        return self.pick(f"pmod({a}, {b})", f"((({a}) % ({b})) + ({b})) % ({b})")

    def mode(self, x: str) -> str:
        """Commonest value, the smallest of those."""
        return self.pick(f"mode({x}, true)", f"mode({x} ORDER BY {x})")

    def epoch(self, ts: str) -> str:
        return self.pick(f"CAST(unix_seconds(CAST({ts} AS TIMESTAMP)) AS BIGINT)", f"CAST(epoch({ts}) AS BIGINT)")

    def hex_id(self, text: str) -> str:
        """60 bits of an MD5 as a whole number."""
        return self.pick(f"CAST(conv(substr(md5({text}), 1, 15), 16, 10) AS BIGINT)", f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)")

    def text(self, x: str) -> str:
        return f"CAST({x} AS {self.pick('STRING', 'VARCHAR')})"

    def matched(self, text: str, pattern: str, group: int = 1) -> str:
        """The group of the first match, empty if there is none; the pattern is a raw regular expression."""
        return self.pick(f"regexp_extract({text}, r'{pattern}', {group})", f"regexp_extract({text}, '{pattern}', {group})")

    def argmax_bin(self, a: str) -> str:
        """First place of the greatest element, from 0; null for an array of nulls."""
        return self.pick(f"CAST(array_position({a}, array_max({a})) - 1 AS BIGINT)", f"CAST(list_position({a}, list_max({a})) - 1 AS BIGINT)")

    def elem(self, a: str, i: str) -> str:
        """Element i, counted from 0; null outside."""
        return self.pick(f"get({a}, CAST({i} AS INT))", f"{a}[CAST({i} AS INT) + 1]")

    def transform(self, a: str, x: str, body: str) -> str:
        return self.pick(f"transform({a}, {x} -> {body})", f"list_transform({a}, lambda {x}: {body})")

    def kept(self, a: str, x: str, body: str) -> str:
        return self.pick(f"filter({a}, {x} -> {body})", f"list_filter({a}, lambda {x}: {body})")

    def size(self, a: str) -> str:
        return self.pick(f"CAST(size({a}) AS BIGINT)", f"CAST(len({a}) AS BIGINT)")

    def total(self, a: str) -> str:
        """Sum of an array of doubles, from the left."""
        return self.pick(f"aggregate({a}, CAST(0 AS DOUBLE), (s, v) -> s + CAST(v AS DOUBLE))", f"list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform({a}, lambda v: CAST(v AS DOUBLE))), lambda s, v: s + v)")

    def part(self, a: str, first: int, n: int) -> str:
        """n elements from the first, counted from 1."""
        return self.pick(f"slice({a}, {first}, {n})", f"{a}[{first}:{first + n - 1}]")

    def ordered(self, a: str) -> str:
        return self.pick(f"array_sort({a})", f"list_sort({a})")
