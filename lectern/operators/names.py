"""Names analytics: counts from several registers, population scores, ranks, triage, samples, coverage and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least size of a sample that stands alone, and of a cell in it. Fixed values.
MIN_SAMPLE, MIN_CELL = 2_000, 2


def clean_name(name: Column) -> Column:
    """One kind of apostrophe and hyphen, single spaces."""
    return F.trim(F.regexp_replace(F.translate(name, "’ʼ‐‑", "''--"), r"\s+", " "))


def key_of(name: Column) -> Column:
    return F.lower(clean_name(name))


def valid_name(name: Column) -> Column:
    """Letters with marks, apostrophes, hyphens and spaces only; two letters at least, 40 characters and three words at
    most, no mark at an edge, and no placeholder."""
    placeholder = F.lower(name).isin("unknown", "unnamed", "not stated", "none", "baby", "test")
    return name.rlike(r"^[\p{L}\p{M}](?:[\p{L}\p{M}' -]*[\p{L}\p{M}])?$") & (F.regexp_count(name, F.lit(r"\p{L}")) >= 2) & (F.length(name) <= 40) & (F.size(F.split(name, " ")) <= 3) & ~placeholder


def tally(people: DataFrame) -> DataFrame:
    """From source, form, n: counts by source and key, and by form below it (null: the key's total)."""
    rows = people.where(valid_name(clean_name(F.col("form")))).select("source", key_of(F.col("form")).alias("key"), clean_name(F.col("form")).alias("form"), "n")
    return rows.groupingSets([["source", "key", "form"], ["source", "key"]], "source", "key", "form").agg(F.sum("n").alias("n"))


def pool_small(samples: DataFrame, least: int = MIN_SAMPLE) -> DataFrame:
    """Samples (country, key, n) with those below the least size put into one pool."""
    size = F.sum("n").over(Window.partitionBy("country"))
    pooled = samples.withColumn("sample", F.when(size >= least, F.col("country")).otherwise(F.lit("pool")))
    return pooled.groupBy("sample", "key").agg(F.sum("n").alias("n"))


def scores(counts: DataFrame, populations: DataFrame, least_cell: int = 0) -> DataFrame:
    """From counts (source, key, n) and populations (source, population, anglo): per key its score, in people, the share
    of it from English-speaking sources, and how many sources have it."""
    totals = counts.groupBy("source").agg(F.sum("n").alias("total")).where("total > 0")
    weights = totals.join(populations, "source", "left").select("source", (F.coalesce("population", F.lit(0)) / F.col("total")).alias("weight"), F.coalesce("anglo", F.lit(False)).alias("anglo"))
    part = F.col("n") * F.col("weight")
    summed = counts.where(F.col("n") >= least_cell).join(weights, "source").groupBy("key").agg(F.sum(part).alias("score"), F.sum(F.when(F.col("anglo"), part).otherwise(0.0)).alias("anglo"), F.count("*").alias("n_sources"))
    return summed.where("score > 0")


def affinity(anglo: Column, score: Column, anglo_pop: Column, other_pop: Column) -> Column:
    """How much more common per head in English-speaking countries: 0.5 as common, 1 only there."""
    inside, outside = anglo / anglo_pop, (score - anglo) / other_pop
    return inside / (inside + outside)


def english_usage(share: Column) -> Column:
    return F.when(share >= 2 / 3, "english").when(share >= 0.4, "shared").otherwise("other")


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The top keys by score, rounded so that the order of sums does not matter, then key; rank from 1. The limit is taken
    before the numbering, so no task sorts all keys."""
    best = scored.withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "key").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")))


def top_per_key(counts: DataFrame, k: int, of: str = "country") -> DataFrame:
    """The k largest countries of each key, as text, largest first."""
    w = Window.partitionBy("key").orderBy(F.desc("n"), of)
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", of))), lambda x: x[of]), ",").alias("top"))


def display_form(forms: DataFrame) -> DataFrame:
    """The spelling of each key that most people have, by the first tier that has any (tier, key, form, n)."""
    best = forms.groupBy("key", "tier").agg(F.max(F.struct("n", "form")).alias("best"))
    return best.groupBy("key").agg(F.min_by("best.form", "tier").alias("form"))


def bucket(rank: Column, word_frequency: Column, multiword: Column) -> Column:
    """The first triage bucket that fits."""
    return F.when(multiword, "multiword").when(word_frequency >= 4, "common word").when(word_frequency >= 3, "uncommon word").when(rank <= 100, "top").otherwise("rest")


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum by the order of a hash, the same ones on every run."""
    draw = F.md5(F.concat_ws("/", F.lit(seed), F.col(stratum), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("draw", draw).withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy("draw"))).where(F.col("r") <= n).drop("draw", "r")


def coverage(ledger: DataFrame) -> DataFrame:
    """Names and settled names by bucket, by source, and in total, in one pass of grouping sets."""
    sets = ledger.cube("bucket", "source").agg(F.count("*").alias("names"), F.sum(F.col("settled").cast("long")).alias("settled"), F.sum((F.col("settled") & (F.col("rank") <= 1000)).cast("long")).alias("settled_top"), F.grouping_id().alias("level"))
    return sets.where("level in (0, 1, 2, 3)")


def drop_covered(names: DataFrame) -> DataFrame:
    """Without the names of several words whose every word is a name of its own."""
    singles = names.where(~F.col("name").contains(" ")).select(F.col("name").alias("part")).distinct()
    parts = names.where(F.col("name").contains(" ")).select("name", F.explode(F.split("name", " ")).alias("part"))
    open_ = parts.join(singles, "part", "left_anti").select("name").distinct()
    return names.where(~F.col("name").contains(" ")).unionByName(names.join(open_, "name", "left_semi").select(*names.columns))


def batches(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Rows with their batch within the group, from 1, of a fixed size."""
    return rows.withColumn("batch", F.ceil(F.row_number().over(Window.partitionBy(*group).orderBy(*order)) / size))
