"""Layered dictionaries: upserts, packs, conflicts, merges, and evidence windows for corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity(word: Column, case_sensitive: Column) -> Column:
    return F.when(case_sensitive, F.concat(F.lit("="), word)).otherwise(F.concat(F.lit("~"), F.lower(word)))


def upsert(entries: DataFrame, order: str) -> DataFrame:
    """One row per identity: the latest entry, which keeps an older dictation (with its spoken forms) and older flags
    where it has none itself. Null is not false: a flag that is false replaces an older one."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    dictation = F.max_by(F.struct("dictation", "spoken"), F.when(F.col("dictation").isNotNull(), F.col(order))).alias("d")
    rows = entries.groupBy("identity").agg(F.max_by("us", order).alias("us"), dictation, latest("evidence"), latest("unit"))
    return rows.select("identity", "us", "d.dictation", "d.spoken", "evidence", "unit")


def resolve(entries: DataFrame, packs: list[str]) -> DataFrame:
    """The entries in force for the enabled packs: general ones and those of enabled packs; of a spelling the user's come
    first, then pack-only ones, then later files."""
    usable = entries.where(~F.col("pack_only") | F.col("pack").isin(packs) | (F.col("pack") == "user"))
    tier = F.when(F.col("pack") == "user", 2).when(F.col("pack_only"), 1).otherwise(0)
    w = Window.partitionBy(F.lower("word")).orderBy(F.desc(tier), F.desc("ordinal"))
    return usable.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def match_order(entries: DataFrame) -> DataFrame:
    """Entries with their place in the order of matching: longest first, then rank, case-sensitive first, then key; and
    the two letters that candidates are looked up by."""
    w = Window.partitionBy(F.substring(F.lower("word"), 1, 2)).orderBy(F.desc(F.length("word")), F.desc("ordinal"), F.desc("case_sensitive"), "word")
    return entries.withColumn("bucket", F.substring(F.lower("word"), 1, 2)).withColumn("place", F.row_number().over(w))


def ambiguous(variants: DataFrame) -> DataFrame:
    """Spoken forms (pattern, word) with how many words own them; more than one makes them ambiguous."""
    pattern = F.trim(F.regexp_replace(F.lower(F.translate("pattern", "’", "'")), r"[\s-]+", " "))
    rows = variants.select(pattern.alias("pattern"), "word").where((F.length("pattern") >= 2) & F.col("pattern").rlike(r"[\p{L}\p{N}]"))
    return rows.groupBy("pattern").agg(F.count_distinct("word").alias("owners"), F.min("word").alias("first_word"))


def resolve_collisions(variants: DataFrame, terms: DataFrame) -> DataFrame:
    """Variants (word, variant) without those that are another term, or that two words own."""
    others = terms.select(F.lower("word").alias("variant")).distinct()
    kept = variants.join(others, "variant", "left_anti")
    owners = Window.partitionBy("variant")
    return kept.withColumn("owners", F.size(F.collect_set("word").over(owners))).where("owners = 1").drop("owners")


def near_evidence(hits: DataFrame, distance: int = 12) -> DataFrame:
    """Hits (doc_id, field, first, last, gated) with `applied`: not gated, or evidence of the same field (the user's of any)
    at most `distance` words away on either side. A gated hit is evidence for others, too, if it is not alone."""
    same = Window.partitionBy("doc_id", "field").orderBy("first")
    near = lambda w: (F.col("first") - F.lag("last").over(w) <= distance) | (F.lead("first").over(w) - F.col("last") <= distance)
    return hits.withColumn("applied", ~F.col("gated") | F.coalesce(near(same), F.lit(False)))


def best_by_confidence(entries: DataFrame) -> DataFrame:
    """One entry per key: the highest confidence (high, medium, low), of equals the first batch and position."""
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    w = Window.partitionBy("key").orderBy(rank, "batch", "pos")
    return entries.withColumn("r", F.row_number().over(w)).withColumn("rivals", F.count("*").over(Window.partitionBy("key")) - 1).where("r = 1").drop("r")


def shadowed(entries: DataFrame) -> DataFrame:
    """Spellings that two packs or more give two readings or more."""
    return entries.groupBy(F.lower("word").alias("word")).agg(F.count_distinct("pack").alias("packs"), F.count_distinct("us").alias("readings")).where("packs >= 2 and readings >= 2")


def batch_problems(entries: DataFrame) -> DataFrame:
    """Each entry with the problems a batch check finds: missing fields, unknown words for enumerations, unknown symbols
    and doubled stress."""
    checks = (
        ("no word", F.coalesce(F.trim("word"), F.lit("")) == ""),
        ("no reading", F.coalesce(F.trim("us"), F.lit("")) == ""),
        ("unknown dictation", F.col("dictation").isNotNull() & ~F.col("dictation").isin("always", "context", "never")),
        ("unknown symbol", F.col("us").rlike(r"[0-9A-HJ-Z#]")),
        ("two main stresses", F.regexp_count("us", F.lit("ˈ")) > 1),
    )
    return entries.withColumn("problems", F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks))))
