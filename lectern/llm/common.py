"""Helpers that the operators share: the cluster's common folder, and text columns in slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled together inside an Arrow batch, so that temporary arrays stay small however many rows a batch has.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 22
#: Bytes in an Arrow batch between the JVM and Python, which each hold some copies of one for every task.
BATCH_BYTES = 1 << 22
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and every executor can reach, as a URI.

    It lies in spark.checkpoint.dir. Only where that is unset, as in tests on one machine, a temporary folder takes its
    place, and the session's checkpoint folder is set to it.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(base)
    return f"{as_uri(base)}/{uuid.uuid4().hex}"


def as_uri(path: str) -> str:
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:") :]
    return path if "://" in path else f"file://{path}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, readable after executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in a folder of its own below the shared one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made, self.paths = spark, shared_folder(spark), 0, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a Parquet table: computed once, readable after executors are lost."""
        self.made += 1
        path = f"{self.folder}/{self.made}-{name}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = table
        return table

    def keep_only(self, *tables: DataFrame) -> None:
        """Removes all other tables, which nothing may read any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path, table in list(self.paths.items()):
            if not any(table is t for t in tables):
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)
                del self.paths[path]


#: What this worker keeps from task to task: the models or caches of one operator.
_kept: dict[Hashable, Any] = {}


def trim() -> None:
    """Gives free memory back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def release() -> None:
    """Drops what the worker keeps. Workers outlive operators, so without this the caches of one add to what the next one
    needs."""
    _kept.clear()
    trim()


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's state under this key; it takes the place of any other operator's."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to BATCH_BYTES; a lower limit stays. Spark's own limit of
    64 MB gives batches of 10,000 whole texts. How rows are dealt to batches changes no result."""
    jvm = spark._jvm.org.apache.spark.network.util.JavaUtils
    if not 0 < jvm.byteStringAsBytes(spark.conf.get(_BATCH_SETTING)) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns, so that no other column of the input can clash with an operator's own."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part has at most SLICE_ROWS rows and, past one row, most_bytes of text."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and (i - begin >= SLICE_ROWS or total + n > most_bytes):
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)
    trim()  # an idle worker holds no more than it keeps
