"""Structured Streaming forms of the operations queries; each equals its batch form on the same rows.

Event times are timestamp_ntz in the tables; watermarks need timestamps, so they are cast with the session in UTC.
State is bounded by watermarks (windows, sessions, dedup) or by the number of keys (latest value). Sinks write a
batch's rows under its batch id, so that a replayed batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reqloom.sources.tables import Scratch, table

WATERMARK = "1 day"


def event_stream(spark: SparkSession, base: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as a file stream with an event time in `ts`."""
    schema = table(spark, base, "events").schema
    path = f"{base}/events.parquet"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # a folder of part files is watched itself, a single file through its parent
    s = r.parquet(path) if fs.getFileStatus(p).isDirectory() else r.option("pathGlobFilter", "events.parquet").parquet(base)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(result: DataFrame, mode: str, tmp: Scratch, latest_of: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns what its sink holds.

    `append`: all rows written; `update`: the last version of each key of `latest_of`.
    """
    where, state = f"{tmp.root}/out", f"{tmp.root}/state"

    def sink(df: DataFrame, batch: int) -> None:
        df.withColumn("batch_", F.lit(batch)).write.mode("overwrite").parquet(f"{where}/batch={batch}")

    q = result.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = result.sparkSession
    cols = result.columns
    rows = spark.read.schema(result.withColumn("batch_", F.lit(0)).schema).option("recursiveFileLookup", "true").parquet(where)
    if latest_of is None:
        return rows.select(*cols)
    rest = [c for c in cols if c not in latest_of]
    return rows.groupBy(*latest_of).agg(F.max_by(F.struct(*rest), "batch_").alias("v")).select(*latest_of, *[F.col(f"v.{c}").alias(c) for c in rest])


def tumbling(df: DataFrame, width: str = "1 hour") -> DataFrame:
    g = df.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, width: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    g = df.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def latest(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = df.withWatermark("ts", WATERMARK).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(df: DataFrame) -> DataFrame:
    """Each event id once within the watermark, counted by type."""
    return df.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


def retained(df: DataFrame, keep: str = "30 days") -> DataFrame:
    """Rows not older than `keep` behind the stream's clock (late ones are dropped by the watermark)."""
    return df.withWatermark("ts", keep)


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def _query(build: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None, times: list[str]):
    def query(spark: SparkSession, base: str) -> DataFrame:
        out = drain(build(event_stream(spark, base)), mode, Scratch(spark), keys)
        return _ntz(out, *times)

    return query


def stream_tumbling_counts(spark: SparkSession, base: str) -> DataFrame:
    out = _query(tumbling, "update", ["start", "event_type"], ["start"])(spark, base)
    return out.withColumn("total", F.round("total", 4))


stream_latest_per_key = _query(latest, "update", ["event_type"], ["ts"])
stream_dedup_counts = _query(deduplicated, "update", ["event_type"], [])


def stream_session_counts(spark: SparkSession, base: str) -> DataFrame:
    """Sessions in complete mode: what the sink holds after the last batch."""
    rows = drain(sessions(event_stream(spark, base)), "complete", Scratch(spark))
    # complete mode repeats all sessions in each batch: the longest version of a start is the last one
    out = rows.groupBy("user_id", "start").agg(F.max(F.struct("end", "n")).alias("v")).select("user_id", "start", "v.end", "v.n")
    return _ntz(out, "start", "end")


def _number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Running line numbers of one job; the state is how many lines it has had."""
    n = state.get[0] if state.exists else 0
    rows = [b for b in batches if len(b)]
    if rows:
        pdf = pd.concat(rows).sort_values(["ts", "event_id"], kind="stable")
        yield pd.DataFrame({"job_id": pdf["user_id"], "event_id": pdf["event_id"], "line_number": np.arange(n + 1, n + 1 + len(pdf))})
        state.update((n + len(pdf),))


def numbered_lines(df: DataFrame) -> DataFrame:
    """Log lines as they come, each with the next number of its job: a poll for lines after the last one seen is a filter.

    Lines of one trigger are ordered by time and id; numbers, once given, do not change when a late line arrives.
    """
    return df.groupBy("user_id").applyInPandasWithState(_number, "job_id long, event_id long, line_number long", "n long", "append", GroupStateTimeout.NoTimeout)


def stream_sliding_counts(spark: SparkSession, base: str) -> DataFrame:
    """Hourly windows every 15 minutes."""
    return _query(lambda df: sliding(df, "1 hour", "15 minutes"), "update", ["start", "event_type"], ["start"])(spark, base)


stream_log_lines = _query(numbered_lines, "append", None, [])
