"""Registers of names: yearly files, wide tables, statistical cubes, word frequencies, and tab-separated ledgers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years before it are not counted. A fixed value.
FIRST_YEAR = 1925


def read_yearly(spark: SparkSession, folder: str) -> DataFrame:
    """yobYYYY.txt files of name, sex, count: form, n, year, from the first year on (pruned by the file's name)."""
    rows = spark.read.csv(folder, schema="form string, sex string, n long", pathGlobFilter="yob*.txt").withColumn("year", F.regexp_extract(F.input_file_name(), r"yob(\d{4})", 1).cast("int"))
    return rows.where((F.col("year") >= FIRST_YEAR) & F.col("n").isNotNull()).select("form", "n", "year")


def melt_counts(wide: DataFrame, name: str, ending: str = "Count") -> DataFrame:
    """Columns that end in Count as rows: form, column, n."""
    counts = [c for c in wide.columns if c.endswith(ending)]
    return wide.unpivot(name, counts, "column", "n").where("n is not null").select(F.col(name).alias("form"), "column", F.col("n").cast("long").alias("n"))


def read_coalesced(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], sep: str = ";") -> DataFrame:
    """A CSV whose column names changed over the years: each new name takes the first old one that is there."""
    rows = spark.read.csv(path, header=True, sep=sep)
    pick = lambda names: F.coalesce(*([F.col(f"`{c}`") for c in names if c in rows.columns] or [F.lit(None)]))
    return rows.select(*(pick(names).alias(new) for new, names in columns.items()))


def read_cube(spark: SparkSession, path: str, latest: str | None = None) -> DataFrame:
    """A JSON-stat cube, long: key (labels of all dimensions joined by |) and value. The place in the flat list of values
    is decoded by mixed radix. latest names a dimension of which only the largest label is kept."""
    text = spark.read.text(path, wholetext=True)
    cube = text.select(F.from_json("value", "struct<id: array<string>, size: array<int>, value: array<double>, labels: map<string, array<string>>>").alias("c")).select("c.*")
    rows = cube.select("id", "size", "labels", F.posexplode("value").alias("at", "v")).where("v is not null")
    weight = lambda i: F.aggregate(F.slice("size", i + 2, F.size("size")), F.lit(1), lambda a, x: a * x)
    digits = F.transform("id", lambda name, i: F.element_at(F.element_at("labels", name), F.floor(F.col("at") / weight(i)).cast("int") % F.element_at("size", i + 1) + 1))
    rows = rows.select("id", digits.alias("key"), F.col("v").alias("value"))
    if latest is None:
        return rows.select(F.array_join("key", "|").alias("key"), "value")
    period = F.element_at("key", F.array_position("id", F.lit(latest)).cast("int"))
    rows = rows.withColumn("period", period)
    last = rows.agg(F.max("period").alias("period"))
    return rows.join(F.broadcast(last), "period").select(F.array_join("key", "|").alias("key"), "value")  # one row, by construction


def literal(text: Column) -> Column:
    """The text and language of "text"@lang, unescaped; an identifier of an address in angle brackets."""
    body = F.regexp_extract(text, r'^"(.*)"(?:@([A-Za-z-]+)|\^\^.*)?$', 1)
    unescaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r'\\"', '"'), r"\\t", "\t"), r"\\\\", r"\\")
    return F.struct(F.when(text.startswith("<"), F.regexp_extract(text, r"([^/#>]+)>$", 1)).otherwise(unescaped).alias("value"), F.nullif(F.regexp_extract(text, r'"@([A-Za-z-]+)$', 1), F.lit("")).alias("lang"))


def _unpack(data: bytes, at: int = 0) -> tuple[object, int]:
    """One MessagePack value of the kinds that frequency lists have."""
    kind = data[at]
    at += 1
    if kind <= 0x7F:
        return kind, at
    if kind >= 0xE0:
        return kind - 256, at
    sizes = {0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I", 0xC4: ">B", 0xC5: ">H", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xCA: ">f", 0xCB: ">d"}
    if kind in sizes:
        n = struct.unpack_from(sizes[kind], data, at)[0]
        at += struct.calcsize(sizes[kind])
    if kind in (0xCC, 0xCD, 0xCE, 0xCF, 0xD0, 0xD1, 0xD2, 0xCA, 0xCB):
        return n, at
    if kind in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[kind], at
    if 0xA0 <= kind <= 0xBF or kind in (0xD9, 0xDA, 0xDB):
        n = kind & 31 if kind <= 0xBF else n
        return data[at : at + n].decode(), at + n
    if kind in (0xC4, 0xC5):
        return data[at : at + n], at + n
    items: list = []
    is_map = 0x80 <= kind <= 0x8F or kind in (0xDE, 0xDF)
    n = kind & 15 if kind <= 0x9F else n
    for _ in range(n * (2 if is_map else 1)):
        item, at = _unpack(data, at)
        items.append(item)
    return (dict(zip(items[::2], items[1::2], strict=True)) if is_map else items), at


def read_word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """word and zipf (9 - place / 100, the first place of a word counts) of cBpack frequency lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                lists, _ = _unpack(content)
                for place, words in enumerate(lists):
                    if isinstance(words, list):
                        for begin in range(0, len(words), 65_536):
                            part = words[begin : begin + 65_536]
                            yield pa.RecordBatch.from_pydict({"word": part, "place": [place - 1] * len(part)}, schema=pa.schema([("word", pa.string()), ("place", pa.int32())]))

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "word string, place int")
    return rows.groupBy("word").agg((F.lit(9.0) - F.min("place") / 100).alias("zipf"))


def write_ledger(rows: DataFrame, path: str, same: tuple[str, str] | None = None) -> None:
    """A tab-separated table with a header; the second of two columns is left empty where it repeats the first."""
    if same:
        rows = rows.withColumn(same[1], F.nullif(F.col(same[1]), F.col(same[0])))
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
