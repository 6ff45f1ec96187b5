"""Parameter sweep of the classification over files: shared ground and density tables, resumed where it stopped.

Settings that agree in the seven fields of the ground share one table of points with their ground heights, and those with one radius share one
table of densities; each is built once, written under the sweep's folder, and found there by a later run. All
settings of a ground and radius are then tried in one pass over the points, whose result is a count for each file, setting,
true and predicted class. Passes are appended to the folder ``results``, which is the manifest too: pairs of file and
setting that stand there are not tried again. Heights, classes and files may be null; points without a known class are not
counted, and a null file is a file like any other in the counts but shares no cells.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import groupby

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators import classify, spatial
from pulsegrid.operators.graph import counted
from pulsegrid.operators.quantiles import keyed_few

CLASSES = (classify.PROCESSED, classify.GROUND, classify.NOISE)
#: Settings that one pass tries; each has a count for every pair of classes.
PASS = 16
COUNTS = [f"c{t}{p}" for t in CLASSES for p in CLASSES]
RESULT = "file string, setting string, " + ", ".join(f"{c} bigint" for c in COUNTS)


@dataclass(frozen=True)
class Setting:
    """One setting; the first seven fields after the mode are those of the ground."""

    mode: str = "height_only"
    snr: float = 5.0
    cell: float = 15.0
    share: float = 0.02
    least: int = 1
    neighbours: int = 12
    power: float = 2.0
    reach: float = 30.0
    radius: float | None = None
    tolerance: float = 1.5
    above: float = 30.0
    below: float = 0.0
    least_density: float | None = None

    @property
    def ground(self) -> tuple:
        return self.snr, self.cell, self.share, self.least, self.neighbours, self.power, self.reach

    @property
    def name(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]

    def options(self) -> classify.CascadeOptions:
        return classify.CascadeOptions(mode=self.mode, ground_tolerance=self.tolerance, above=self.above, below=self.below, least_density=self.least_density, scanline_noise=False)


def _stored(spark: SparkSession, path: str, make, fresh: set[str]) -> DataFrame:
    """The table at path, made and written first where it is not there whole; fresh gets the path then."""
    try:
        spark.read.text(f"{path}/_SUCCESS")  # written last, so a table without it is half a table
    except AnalysisException:
        make().write.mode("overwrite").parquet(path)
        fresh.add(path)
    return spark.read.parquet(path)


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the passes that ended, one row for each file and setting."""
    try:
        return spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(f"{folder}/results").distinct()
    except AnalysisException:
        return spark.createDataFrame([], RESULT)


def run(points: DataFrame, settings: list[Setting], folder: str, file: str = "granule", truth: str = "ref_class", id_column: str = "pulse_index") -> DataFrame:
    """Tries every setting on every file of points (id, x, y, refh, snr, file, true class) that has no result yet; returns all results."""
    spark = points.sparkSession
    own, _ = counted(points.select(F.col(id_column).alias("id"), F.col(file).cast("string").alias("file"), "x", "y", "refh", "snr", F.col(truth).cast("int").alias("truth")))  # read for each table and pass
    files, fresh = own.select("file").distinct(), set()
    order = sorted(set(settings), key=lambda s: (str(s.ground), str(s.radius), s.name))
    for (ground, radius), some in groupby(order, key=lambda s: (s.ground, s.radius)):
        some = list(some)
        for batch in (some[a : a + PASS] for a in range(0, len(some), PASS)):
            asked = files.withColumn("setting", F.explode(F.array(*[F.lit(s.name) for s in batch])))
            done = finished(spark, folder).select(F.col("file").alias("_f"), F.col("setting").alias("_s"))
            waiting, n = counted(asked.join(done, F.col("file").eqNullSafe(F.col("_f")) & (F.col("setting") == F.col("_s")), "left_anti"))
            if n:
                _tried(spark, own, batch, waiting, ground, radius, folder, fresh).write.parquet(f"{folder}/results/{uuid.uuid4().hex}")
    wanted = [s.name for s in order]
    return finished(spark, folder).where(F.col("setting").isin(wanted))


def _tried(spark: SparkSession, own: DataFrame, batch: list[Setting], waiting: DataFrame, ground: tuple, radius: float | None, folder: str, fresh: set[str]) -> DataFrame:
    snr, cell, share, least, neighbours, power, reach = ground

    def heights() -> DataFrame:
        grid = classify.ground_grid(own, cell, share, snr, least, by=("file",))
        return classify.sample_ground(own.select("id", "file", "x", "y", "refh", "truth"), grid, cell, neighbours, power, reach, "id", ("file",)).select("id", "file", "refh", "truth", "ground")

    name = lambda x: hashlib.sha256(repr(x).encode()).hexdigest()[:12]
    path = f"{folder}/ground/{name(ground)}"
    base = _stored(spark, path, heights, fresh)
    if path not in fresh:  # of an earlier run, whose points may have been others
        base = own.join(base.select("id", "ground"), "id", "left")
    base = keyed_few(base, waiting.select("file").distinct(), ["file"], "left_semi")  # few files: no point is shuffled for them
    density = F.lit(None).cast("double")
    if radius is not None:
        volume = 4 / 3 * 3.141592653589793 * radius**3
        near = _stored(spark, f"{folder}/density/{name(radius)}", lambda: spatial.radius_counts(own.where("refh IS NOT NULL"), radius, "id", by=("file",)).select("id", (F.col("n") / volume).alias("density")), fresh)
        base, density = base.join(near, "id", "left"), F.col("density")
    known = F.when(F.col("truth").isin(*CLASSES), F.col("truth")).alias("truth")
    # a generator each, so that the rules name columns: with their expressions in every rule a row's code is too long to be compiled
    above = F.struct((classify.finite("refh") - classify.finite("ground")).alias("hag"), classify.finite("ground").isNotNull().alias("has"), density.alias("dense"))
    base = base.select("file", known, F.inline(F.array(above)))
    kinds = base.select("file", "truth", F.inline(F.array(F.struct(*[classify.class_above_ground(F.col("hag"), F.col("dense"), F.col("has"), s.options()).alias(f"k{i}") for i, s in enumerate(batch)]))))
    # points that all settings class alike are counted together: a row each costs one count in place of nine a setting
    alike = kinds.groupBy("file", "truth", *[f"k{i}" for i in range(len(batch))]).agg(F.count("*").alias("n"))
    each = alike.select("file", "truth", "n", F.inline(F.array(*[F.struct(F.lit(s.name).alias("setting"), F.col(f"k{i}").alias("kind")) for i, s in enumerate(batch)])))
    cells = [F.coalesce(F.sum(F.when((F.col("truth") == t) & (F.col("kind") == p), F.col("n"))), F.lit(0)).cast("bigint").alias(f"c{t}{p}") for t in CLASSES for p in CLASSES]
    return keyed_few(each.groupBy("file", "setting").agg(*cells), waiting, ["file", "setting"], "left_semi").select("file", "setting", *COUNTS)


def scored(results: DataFrame) -> DataFrame:
    """results with precision, recall and F1 of each class (0 where undefined), macro_f1, and the objective: half the F1 of ground, three
    tenths of noise, two of the macro F1, less a tenth where the F1 of any class lies below a tenth."""
    total = lambda names: reduce(lambda a, b: a + b, [F.col(n) for n in names])
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = results
    for k in CLASSES:
        hit = F.col(f"c{k}{k}")
        out = out.withColumn(f"precision_{k}", share(hit, total([f"c{t}{k}" for t in CLASSES]))).withColumn(f"recall_{k}", share(hit, total([f"c{k}{p}" for p in CLASSES])))
        out = out.withColumn(f"f1_{k}", share(2 * F.col(f"precision_{k}") * F.col(f"recall_{k}"), F.col(f"precision_{k}") + F.col(f"recall_{k}")))
    f1 = [F.col(f"f1_{k}") for k in CLASSES]
    macro = (f1[0] + f1[1] + f1[2]) / 3
    return out.withColumn("macro_f1", macro).withColumn("objective", 0.5 * f1[1] + 0.3 * f1[2] + 0.2 * F.col("macro_f1") - F.when(F.least(*f1) < 0.1, 0.1).otherwise(0.0))


# Of equal settings, the mode that comes first is preferred.
PREFERENCE = ("height_only", "height_density_post_ground", "height_density_processed_only", "height_density_pre_ground", "height_no_below_noise")


def ranked(results: DataFrame, settings: list[Setting]) -> DataFrame:
    """Settings by mean objective, least objective, mean macro F1, mean recall of noise, then the preferred mode (and the name): name,
    mode, n_files and these figures, with their rank."""
    spark = results.sparkSession
    known = spark.createDataFrame([(s.name, s.mode, PREFERENCE.index(s.mode) if s.mode in PREFERENCE else 99) for s in sorted(set(settings), key=lambda s: s.name)], "setting string, mode string, preference int")
    each = scored(results).groupBy("setting").agg(F.count("*").alias("n_files"), F.avg("objective").alias("mean_objective"), F.min("objective").alias("least_objective"), F.avg("macro_f1").alias("mean_macro_f1"), F.avg("recall_7").alias("mean_recall_7"))
    met = each.join(F.broadcast(known), "setting")  # a row a setting
    order = [F.round(c, 9).desc() for c in ("mean_objective", "least_objective", "mean_macro_f1", "mean_recall_7")] + [F.asc("preference"), F.asc("setting")]
    return met.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).drop("preference")


def best_by_file(results: DataFrame) -> DataFrame:
    """The best setting of each file: by objective, macro F1, recall of noise, then the name."""
    row = F.struct(F.round("objective", 9), F.round("macro_f1", 9), F.round("recall_7", 9))
    return scored(results).groupBy("file").agg(F.max_by(F.struct("setting", "objective", "macro_f1", "recall_7"), F.struct(row, -F.conv("setting", 16, 10).cast("bigint"))).alias("b")).select("file", "b.*")
