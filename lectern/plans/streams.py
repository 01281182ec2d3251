"""Streaming operators run over the events and conversations until all input is read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import sessions as S
from .tables import table


def _place(spark: SparkSession) -> str:
    """A fresh folder that all executors reach: below spark.checkpoint.dir, or a temporary one in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lectern-")
    return f"{base}/{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame) -> DataFrame:
    """A streaming query's whole output as a table, by a file sink."""
    spark, place = stream.sparkSession, _place(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def session_cut_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The values of each user's events as samples, cut into pieces at quiet places by a stateful stream."""
    place = _place(spark)
    events = table(spark, folder, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("value").alias("sample"), F.lit(False).alias("flush"))
    ends = events.groupBy("session").agg(F.max("seq").alias("seq"))
    rows = events.join(ends.withColumn("last", F.lit(True)), ["session", "seq"], "left").withColumn("flush", F.coalesce("last", F.lit(False))).drop("last")
    rows.write.parquet(f"{place}/in")
    return run_to_end(S.session_pieces(spark.readStream.schema(rows.schema).parquet(f"{place}/in")))


def session_totals(spark: SparkSession, folder: str) -> DataFrame:
    """No sample is lost by the cuts: samples and energy of each session over its pieces."""
    return session_cut_stream(spark, folder).groupBy("session").agg(F.sum("n").alias("samples"), F.round(F.sum("energy"), 2).alias("energy"))


def settled_open(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of each conversation as a stream: settled and open lengths after every turn."""
    place = _place(spark)
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text")
    rows.write.parquet(f"{place}/in")
    return run_to_end(S.settled_text(spark.readStream.schema(rows.schema).parquet(f"{place}/in"))).select("session", "seq", F.length("settled").alias("settled_chars"), F.length("open").alias("open_chars"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per hour and type (batch form of the windowed stream)."""
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed_counts(rows).select(F.unix_seconds("start").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (session_cut_stream, session_totals, settled_open, event_windows)}

ORACLES = {
    "session_totals": "SELECT user_id AS session, count(*) AS samples, round(sum(value * value), 2) AS energy FROM events GROUP BY user_id",
    "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
