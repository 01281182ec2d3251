"""Dictionary folders of JSON files, with what is wrong in them as a column instead of an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "word string, match string, us string, gb string, dictation string, spoken array<string>, spoken_variants array<string>, spoken_context_only array<string>, evidence boolean, unit boolean, caps_word boolean, pack_only boolean"


def read_lexicons(spark: SparkSession, folder: str, user_folder: str | None = None) -> DataFrame:
    """Entries of all *.json files of a folder but heteronyms.json: pack (from the file's name; user for the second
    folder, which comes last), ordinal for precedence, and problems. A file is a list, or has it under entries or words.
    Unknown fields are ignored; an unknown dictation becomes never, with a problem; spoken forms without one mean context."""
    found = None
    for place, at in enumerate((folder, user_folder)):
        if at is None:
            continue
        files = spark.read.text(at, wholetext=True, pathGlobFilter="*.json").select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("file"))
        entries = f"array<struct<{_typed()}>>"
        wrapped = F.from_json("value", f"struct<entries: {entries}, words: {entries}>")
        lists = F.when(F.regexp_replace("value", r"^\s+", "").startswith("["), F.from_json("value", entries)).otherwise(F.coalesce(wrapped["entries"], wrapped["words"]))
        pack = F.lit("user") if place else F.regexp_replace("file", "-lexicon$", "")
        rows = files.where("file <> 'heteronyms'").select(pack.alias("pack"), "file", F.posexplode_outer(lists).alias("pos", "e")).withColumn("place", F.lit(place))
        found = rows if found is None else found.unionByName(rows)
    e = found.select("pack", "place", "file", "pos", "e.*")
    bad = F.col("dictation").isNotNull() & ~F.col("dictation").isin("always", "context", "never")
    problems = F.array_compact(F.array(F.when(F.coalesce(F.trim("word"), F.lit("")) == "", "no word"), F.when(F.coalesce(F.trim("us"), F.lit("")) == "", "no us reading"), F.when(bad, F.concat(F.lit("unknown dictation "), "dictation"))))
    spoken = F.coalesce("spoken", "spoken_variants")
    dictation = F.when(bad, F.lit("never")).when(F.col("dictation").isNull() & (F.size(F.coalesce(spoken, F.array())) > 0), "context").otherwise(F.col("dictation"))
    ordinal = F.concat_ws("/", F.col("place").cast("string"), "file", F.lpad(F.col("pos").cast("string"), 9, "0"))
    return e.select("pack", ordinal.alias("ordinal"), "word", F.coalesce("match", F.lit("case-insensitive")).alias("match"), "us", "gb", dictation.alias("dictation"), F.coalesce(spoken, F.array().cast("array<string>")).alias("spoken"), "evidence", "unit", "caps_word", "pack_only", problems.alias("problems"))


def _typed() -> str:
    return ", ".join(f"{c.split(' ')[0]}: {c.split(' ')[1]}" for c in _ENTRY.split(", "))


def read_heteronyms(spark: SparkSession, path: str) -> DataFrame:
    """word, us, gb, say and means (two of each) of a heteronym table; pairs that are not two are left out."""
    files = spark.read.text(path, wholetext=True)
    words = F.from_json("value", "struct<words: map<string, struct<us: array<string>, gb: array<string>, say: array<string>, means: array<string>>>>")["words"]
    rows = files.select(F.explode(words).alias("word", "e")).select("word", "e.*")
    return rows.where(" and ".join(f"size({c}) = 2" for c in ("us", "gb", "say", "means")))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """word and readings (tag to phonemes; plain entries under DEFAULT) of a dictionary in JSON."""
    files = spark.read.text(path, wholetext=True)
    rows = files.select(F.explode(F.from_json("value", "map<string, string>")).alias("word", "raw"))
    return rows.select("word", F.when(F.col("raw").startswith("{"), F.from_json("raw", "map<string, string>")).otherwise(F.create_map(F.lit("DEFAULT"), F.col("raw"))).alias("readings"))


def grow_dictionary(entries: DataFrame) -> DataFrame:
    """Entries (word, phonemes) with their capitalised or lower-case twins; an original wins over a twin."""
    twin = F.when(F.col("word") == F.lower("word"), F.initcap("word")).when(F.col("word") == F.initcap("word"), F.lower("word"))
    both = entries.select("word", "phonemes", F.lit(0).alias("r")).unionByName(entries.where(F.length("word") >= 2).select(twin.alias("word"), "phonemes", F.lit(1).alias("r")).where("word is not null"))
    return both.groupBy("word").agg(F.min_by("phonemes", F.struct("r", "phonemes")).alias("phonemes"))


def write_lexicon(entries: DataFrame, path: str) -> None:
    """The slim run-time form: a line of JSON per entry, without empty fields."""
    entries.select([c for c in entries.columns if c not in ("problems", "ordinal")]).write.mode("overwrite").option("ignoreNullFields", True).json(path)
