"""Pauses between blocks, and audio stretches: frames, quiet places and silences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds after and before a block by kind (headings by level). Fixed values.
AFTER_HEADING, BEFORE_HEADING = (0.8, 0.7, 0.6, 0.5), (1.4, 1.2, 1.0, 0.9)


def _level(values: tuple[float, ...], level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.least(level, F.lit(len(values))))


def pause_between(kind: Column, level: Column, quote: Column, lead_in: Column, next_kind: Column, next_level: Column, next_quote: Column) -> Column:
    """Seconds between two spoken blocks: the larger of what the first wants after it and the second before it."""
    after = (
        F.when(kind == "heading", _level(AFTER_HEADING, level))
        .when(kind == "rule", 1.6)
        .when((kind == "item") & (next_kind == "item"), 0.4)
        .when((kind == "row") & (next_kind == "row"), 0.35)
        .otherwise(0.75)
    )
    before = (
        F.when(next_kind == "heading", _level(BEFORE_HEADING, next_level))
        .when(next_kind == "rule", 1.6)
        .when(next_kind == "code", 0.75)
        .when((next_kind == "item") & (kind != "item"), 0.6)
        .otherwise(0.0)
    )
    quoted = F.when(quote != next_quote, 0.6).otherwise(0.0)
    return F.when((kind == "heading") & (next_kind == "heading"), 0.6).when(lead_in & (next_kind == "item"), 0.45).otherwise(F.greatest(after, before, quoted))


def pauses(blocks: DataFrame) -> DataFrame:
    """Each spoken block of (doc_id, pos, kind, level, quote, lead_in, spoken) with the pause after it: the largest of the
    pauses at the edges up to the next spoken block, through those that are not spoken; 0.5 after the last."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    following = {c: F.lead(c).over(by) for c in ("kind", "level", "quote")}
    rows = blocks.select("*", *(v.alias(f"n_{c}") for c, v in following.items()))
    edge = pause_between(*(F.col(c) for c in ("kind", "level", "quote", "lead_in", "n_kind", "n_level", "n_quote")))
    rows = rows.withColumn("edge", edge).withColumn("island", F.sum(F.col("spoken").cast("int")).over(by))
    first = F.max(F.when(F.col("spoken"), F.col("pos"))).alias("pos")
    gaps = rows.where("island > 0").groupBy("doc_id", "island").agg(first, F.max(F.when(F.col("n_kind").isNotNull(), F.col("edge"))).alias("pause"), F.count("*").alias("n"))
    last = F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos")).isNull()
    return gaps.select("doc_id", "pos", F.when(last, F.lit(0.5)).otherwise(F.col("pause")).alias("pause"))


def quietest_frame(samples: Column, size: int, hop: int) -> Column:
    """Where the frame of least energy begins, in samples; the first of equals."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(samples) - size, F.lit(0)), F.lit(hop))
    energy = F.transform(starts, lambda s: F.struct(F.round(F.aggregate(F.slice(samples, s + 1, F.lit(size)), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")), 12).alias("e"), s.alias("at")))
    return F.array_min(energy)["at"]


def silence_runs(samples: DataFrame, least: int, level: float) -> DataFrame:
    """Runs of at least `least` near-silent samples in (vec_id, pos, x): gaps and islands."""
    quiet = samples.withColumn("quiet", F.abs("x") <= level)
    by = Window.partitionBy("vec_id").orderBy("pos")
    island = F.col("pos") - F.row_number().over(by)
    runs = quiet.where("quiet").withColumn("island", island).groupBy("vec_id", "island").agg(F.min("pos").alias("start"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("island")
