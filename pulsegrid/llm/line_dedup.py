"""Fuzzy line deduplication by MinHash, in DataFrame operations alone.

Equal lines are one node, named by a 64-bit hash. A line is the set of its character shingles (by code points, each
named by a 64-bit hash). A node's signature holds the minima of its shingle hashes under several exclusive-or
permutations, which behave like independent minima over random hashes; triples of minima are the bands. Every pair that
meets in a bucket is decided exactly:

* In the first turn the members of a bucket meet its pivots, the smallest nodes of a few residue classes; similar pairs
  are links, united by distributed union-find.
* Then the members of buckets that hold more than one component are compared with those of other components, in blocks
  of ``BLOCK`` members, inside the join on the block. Members of one component need no further comparison.

A pair is compared by parity sketches first: each member of a set turns one bit over, so two sketches differ in at most
as many bits as the sets have members apart; a pair beyond the bound cannot be similar and nothing similar is lost. What is left is verified by the Jaccard
similarity of the sets. Of each component one line stays: the first by id, text (by hash) and line number.

Lines without a visible character are no nodes and always stay. Null texts have no lines, an empty text has one empty
line; a line shorter than a shingle is its own only shingle. Rows may share an id or have none: a row is named by id and
text, so no row loses lines for another; rows that are equal in both get equal results, that is, keep the same lines. An
empty table gives no rows. Other columns are ignored, and returned by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import counted, cut
from pulsegrid.llm.components import components

SHINGLE = 12
SIMILARITY = 0.8
#: Triples of twelve minima, no two of which share a pair: of two lines of similarity 0.8, 99.3 in a hundred meet in one.
BANDS = ((0, 2, 4), (0, 5, 7), (0, 6, 8), (1, 3, 9), (1, 5, 11), (1, 6, 7), (2, 3, 6), (2, 5, 10), (3, 10, 11), (4, 7, 8), (4, 9, 10), (8, 9, 11))
#: Pivots of a bucket, and of one of more than MANY members, which more lines can miss.
PIVOTS = 4
MANY_PIVOTS = 16
MANY = 64
#: Members of a bucket that one group of the second turn holds on either side.
BLOCK = 1024
#: Longs of a parity sketch, a power of two.
SKETCH = 16
#: Most rows of (key) or (node) that are sent to all executors; beyond it both sides are shuffled.
BROADCAST_ROWS = 400_000
#: The ASCII white space, of which invisible lines consist.
BLANK = " \t\n\x0b\x0c\r"


def _constants(n: int) -> list[int]:
    """Multiples of an odd constant: their leading bits differ evenly, so the permutations choose in different regions."""
    return [((k * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % 2**64) - 2**63 for k in range(n)]


def lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, version, line_no, line, node) of every line; version is a hash of the text; node is null where nothing is visible."""
    split = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("version"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return split.withColumn("node", F.when(F.ltrim("line", F.lit(BLANK)) != "", F.xxhash64("line")))


# --------------------------------------------------------------------------- shingles: four bytes a code point


def _points(line: str) -> Column:
    return F.encode(line, "UTF-32")


def _starts(points: str, size: int) -> str:
    """First byte of each shingle, from one."""
    return f"sequence(1, greatest(length({points}) - {4 * size - 1}, 1), 4)"


def _shingle(points: str, at: str, size: int) -> str:
    return f"xxhash64(substring({points}, {at}, {4 * size}))"


def _set(line: str, size: int) -> Column:
    """Set of the shingles of a line; the outer lambda holds the bytes, so that they are not copied for each shingle."""
    return F.array_distinct(F.expr(f"transform(array(encode({line}, 'UTF-32')), b -> transform({_starts('b', size)}, i -> {_shingle('b', 'i', size)}))[0]"))


def _spread(nodes: DataFrame, size: int) -> DataFrame:
    """(node, h) of every shingle of (node, line), repeats included."""
    each = nodes.select("node", _points("line").alias("u")).select("node", "u", F.explode(F.expr(_starts("u", size))).alias("i"))
    return each.select("node", F.expr(_shingle("u", "i", size)).alias("h"))


def signatures(nodes: DataFrame, size: int = SHINGLE, n: int = 12) -> DataFrame:
    """node and its minima of (node, line), 32 bits of each, two to a long: the leading ones are much the same in all."""
    least = _spread(nodes, size).groupBy("node").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(c))).alias(f"m{k}") for k, c in enumerate(_constants(n))])
    return least.select("node", *[F.expr(f"(m{k} & 4294967295L) | shiftleft(m{min(k + 1, n - 1)}, 32)").alias(f"w{k // 2}") for k in range(0, n, 2)])


def _keys(signed: DataFrame, bands) -> DataFrame:
    """(node, key) for each band."""
    half = lambda j: F.expr(f"w{j // 2} & 4294967295L" if j % 2 == 0 else f"shiftrightunsigned(w{j // 2}, 32)")
    return signed.select("node", F.explode(F.array(*[F.xxhash64(F.lit(k), *[half(j) for j in b]) for k, b in enumerate(bands)])).alias("key"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# --------------------------------------------------------------------------- comparison


def sketches(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """node, n (its number of different shingles) and their parity over the bits of s0, s1, ..."""
    each = texts.select("node", F.explode(_set("line", size)).alias("h"))
    bit = "shiftleft(1L, cast(h & 63 as int))"
    return each.groupBy("node").agg(F.count("*").alias("n"), *[F.expr(f"bit_xor(if(shiftrightunsigned(h, 6) & {SKETCH - 1} = {k}, {bit}, 0L))").alias(f"s{k}") for k in range(SKETCH)])


def _side(sketch: DataFrame, name: str, *more) -> DataFrame:
    return sketch.select(*more, F.col("node").alias(name), F.col("n").alias(f"{name}_n"), *[F.col(f"s{k}").alias(f"{name}_s{k}") for k in range(SKETCH)])


def _possible(similarity: float) -> Column:
    """False only for pairs (a, b) that cannot be similar: sizes too far apart, or more members apart than allowed."""
    ratio = F.least("a_n", "b_n") >= F.lit(similarity) * F.greatest("a_n", "b_n") - 1e-9
    apart = F.expr(" + ".join(f"bit_count(a_s{k} ^ b_s{k})" for k in range(SKETCH)))
    return ratio & ((1 + similarity) * apart <= (1 - similarity) * (F.col("a_n") + F.col("b_n")) + 1e-9)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of nodes whose shingle sets have at least the similarity."""
    one = texts.select(F.col("node").alias("a"), F.col("line").alias("x"))
    two = texts.select(F.col("node").alias("b"), F.col("line").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    # the generator keeps the sets from being made once for each use
    sets = both.select("a", "b", F.explode(F.array(F.struct(_set("x", size).alias("p"), _set("y", size).alias("q")))).alias("s"))
    common = F.size(F.array_intersect("s.p", "s.q"))
    return sets.where((1 + similarity) * common + 1e-9 >= similarity * (F.size("s.p") + F.size("s.q"))).select("a", "b")


def _pivoted(members: DataFrame) -> DataFrame:
    """(a, b, n) of each bucket's pivots with its other members."""
    most = max(PIVOTS, MANY_PIVOTS)
    residue = F.pmod("node", F.when(F.col("n") > MANY, MANY_PIVOTS).otherwise(PIVOTS))
    pivots = members.groupBy("key").agg(*[F.min(F.when(residue == j, F.col("node"))).alias(f"p{j}") for j in range(most)])
    met = members.join(pivots, "key").select("n", F.col("node").alias("b"), F.explode(F.array_compact(F.array(*[F.col(f"p{j}") for j in range(most)]))).alias("a"))
    return met.where("a <> b").select("a", "b", "n")


def _star_candidates(pairs: DataFrame, sketch: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b, n) that may be similar; the partners of a pivot of large buckets are dealt over several tasks."""
    once, _ = counted(pairs.groupBy("a", "b").agg(F.max("n").alias("n")).select("a", "b", F.expr(f"cast(pmod(b, n div {BLOCK} + 1) as int)").alias("part")))
    pivots = once.select("a", "part").distinct().join(_side(sketch, "a"), "a")
    met = once.join(pivots, ["a", "part"]).join(_side(sketch, "b"), "b").where(_possible(similarity))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crossing_candidates(live: DataFrame, sketch: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components in the buckets of live (key, node, c, m), m the members of the key."""
    own = live.join(sketch, "node").withColumn("blocks", F.expr(f"cast((m - 1) div {BLOCK} + 1 as int)")).withColumn("at", F.expr("cast(pmod(node, blocks) as int)"))
    left = own.withColumn("to", F.explode(F.expr("sequence(at, blocks - 1)")))
    right = own.withColumn("from", F.explode(F.expr("sequence(0, at)")))
    one = _side(left, "a", "key", F.col("at").alias("i"), F.col("to").alias("j"), F.col("c").alias("a_c"))
    two = _side(right, "b", "key", F.col("from").alias("i"), F.col("at").alias("j"), F.col("c").alias("b_c"))
    met = one.join(two, ["key", "i", "j"]).where((F.col("a_c") != F.col("b_c")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & _possible(similarity))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --------------------------------------------------------------------------- links and classes


def links(rows: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands=BANDS) -> DataFrame | None:
    """Components (node, component) of the similar lines of rows (node, line); None if no bucket has two lines."""
    signed = cut(signatures(rows, size, 1 + max(max(b) for b in bands)))
    spread = _keys(signed, bands)
    shared, _ = counted(spread.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1"))
    # a bucket of two names both; the members of the fewer larger ones are looked up
    larger, n = counted(shared.where("n > 2").select("key", "n"))
    members, _ = counted(spread.join(_sent(larger, n), "key").select("key", "node", "n"))
    pairs = shared.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"), "n").unionByName(_pivoted(members))
    wanted, n = counted(members.select("node").unionByName(shared.where("n = 2").select(F.explode(F.array("low", "high")).alias("node"))).distinct())
    if not n:
        return None
    texts = cut(rows.join(_sent(wanted, n), "node").groupBy("node").agg(F.first("line").alias("line")))
    sketch, _ = counted(sketches(texts, size))
    edges, _ = counted(verified(_star_candidates(pairs, sketch, similarity), texts, similarity, size))
    found, _ = counted(components(edges))
    own = found.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    placed = members.join(own, F.col("node") == F.col("_n"), "left").select("key", "node", F.coalesce("_c", "node").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).where("low < high").select("key", "m")
    live = placed.join(mixed, "key")
    more, n = counted(verified(_crossing_candidates(live, sketch, similarity), texts, similarity, size))
    if not n:
        return found
    # the components of the first turn are the nodes of the second
    first = own.withColumnRenamed("_c", "component")
    joined = more
    for end in ("a", "b"):
        joined = joined.join(first, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("component", end)).select("a", "b")
    later = components(joined).select(F.col("node").alias("_r"), F.col("component").alias("_last"))
    nodes = found.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return cut(nodes.join(later, F.col("component") == F.col("_r"), "left").select("node", F.coalesce("_last", "component").alias("component")))


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, size: int = SHINGLE, **how) -> DataFrame:
    """(id, version, line_no, component, kept) of every line of df; component is null, and kept true, where nothing is visible."""
    rows = lines(df, text, key)
    found = links(rows.where("node IS NOT NULL").select("node", "line"), similarity, size, **how)
    own = rows.select("id", "version", "line_no", "node")
    if found is None:
        labelled = own.withColumnRenamed("node", "component")
    else:
        sent = _sent(found.select(F.col("node").alias("_n"), "component"), found.count())
        labelled = own.join(sent, F.col("node") == F.col("_n"), "left").select("id", "version", "line_no", F.coalesce("component", "node").alias("component"))
    labelled = cut(labelled)
    places = labelled.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "version", "line_no")).alias("p")).select("p.*")
    # a kept line is found by its place, which no other line of another row shares, so that no component is one task
    first = places.select(F.col("id").alias("_i"), F.col("version").alias("_v"), F.col("line_no").alias("_l"))
    out = labelled.join(first, F.col("id").eqNullSafe(F.col("_i")) & (F.col("version") == F.col("_v")) & (F.col("line_no") == F.col("_l")), "left")
    return out.select("id", "version", "line_no", "component", (F.col("component").isNull() | F.col("_l").isNotNull()).alias("kept"))


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """df with the lines that stay; a text keeps its row even if no line of it stays, and a null text stays null.

    The columns travel as one struct against clashes.
    """
    gone = classes(df, text, key, **how).where("NOT kept").groupBy(F.col("id").alias("gone_id"), F.col("version").alias("gone_version")).agg(F.collect_set("line_no").alias("gone"))
    packed = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("own"))
    joined = packed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left")
    # as in verified(), the generator keeps the split out of the lambda
    parted = joined.withColumn("parts", F.explode(F.array(F.split("own", "\n"))))
    kept = F.expr("CASE WHEN gone IS NULL THEN own ELSE array_join(transform(array_except(sequence(0, size(parts) - 1), gone), i -> parts[i]), '\n') END")
    return parted.select(*[kept.alias(c) if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])
