"""Structured Streaming forms of the windowed operators.

In append mode a window comes out when the watermark has passed it, so a bounded input would keep its last windows back.
``bounded_stream`` therefore ends the input with one row far in the future, which ``run_to_end`` needs to emit everything; its own window
never comes out. With it the results equal the batch forms. Rows later than the watermark are dropped; ``dropped`` tells how many.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The time of the row that ends a bounded stream.
END = "2200-01-01 00:00:00"


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean by window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def latest(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """First arrival of each event id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def visits(events: DataFrame) -> DataFrame:
    """user_id, event_id, the number of the user's events up to it, and the milliseconds since the one before, kept in a
    state of two numbers for each user. Events of one micro-batch are taken by time and id."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        # one user's events of one micro-batch, whose size the source bounds
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        gaps = rows["ms"].diff()
        if last is not None and len(rows):
            gaps.iloc[0] = rows["ms"].iloc[0] - last
        out = pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "n": range(n + 1, n + 1 + len(rows)), "gap_ms": gaps.astype("Int64")})
        state.update((n + len(rows), int(rows["ms"].iloc[-1])))
        yield out

    own = events.where("user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "event_id", F.unix_millis("ts").alias("ms"))
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, n bigint, gap_ms bigint", "n bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


def stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The parquet files under folder that match pattern, as a stream."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def bounded_stream(spark: SparkSession, folder: str, shared: str, pattern: str = "events.parquet") -> DataFrame:
    """``stream`` with the row that ends it, which is written under the folder ``shared``."""
    rows = stream(spark, folder, pattern)
    last = spark.range(1).select(*[(F.to_timestamp(F.lit(END)) if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    last.write.mode("overwrite").parquet(f"{shared}/end")
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{shared}/end"))


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Writes all that is there to path and reads it back."""
    run(df, path, checkpoint, mode)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dropped(query: StreamingQuery) -> int:
    """Rows that came later than the watermark, over all micro-batches that the query still remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
