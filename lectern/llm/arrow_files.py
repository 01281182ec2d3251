"""Token ids in the Arrow stream-file format: fixed-size-list batches with masks, for random access without copies.

Documents are dealt by ranges of their id, each task encodes its range in order and writes one shard, an Arrow IPC file
whose record batches have two fixed-size-list columns of `length` entries, ids and mask. All rows are equally long, so
row k of a memory-mapped file is found by arithmetic and read without a copy. The last row of a shard is filled up with
zeros, which its mask excludes. Beside each shard lies an index file with doc_id, start and n_tokens in the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, shared_folder, slices
from .tokens import byte_bpe, default_vocabulary

#: Rows that one record batch of a shard has.
BATCH_ROWS = 512
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def shard_schema(length: int, width: int) -> pa.Schema:
    """Ids as unsigned integers of `width` bytes, masks as bits."""
    return pa.schema([("ids", pa.list_(pa.uint16() if width == 2 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes ids, given document by document, as rows of `length` ids."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, length: int, width: int):
        self.schema, self.length, self.dtype = shard_schema(length, width), length, f"<u{width}"
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.dtype))
        self.n_waiting += len(ids)
        whole = self.length * BATCH_ROWS  # all batches but the last have equally many rows
        if self.n_waiting >= whole:
            self._flush(self.n_waiting // whole * whole)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n
        ids = ids[:n]
        rows = -(-n // self.length)
        flat = np.zeros(rows * self.length, self.dtype)
        flat[:n] = ids
        mask = np.arange(rows * self.length) < n
        for i in range(0, rows, BATCH_ROWS):
            cut = slice(i * self.length, (i + BATCH_ROWS) * self.length)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[cut], f.type.value_type), self.length) for x, f in zip((flat, mask), self.schema, strict=True)]
            self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.written += n

    def close(self) -> int:
        if self.n_waiting:
            self._flush(self.n_waiting)
        self.file.close()
        self.sink.close()
        return self.written


class ShardReader:
    """Random access to a shard: rows, or runs of ids across rows."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.fs, self.path = fs, path
        source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def batch(self, k: int) -> np.ndarray:
        """The ids of record batch k as one flat array over the file's own bytes."""
        if self.held[0] != k:
            self.held = (k, self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self.held[1]

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row k."""
        batch = self.file.get_batch(k // BATCH_ROWS)
        return tuple(batch.column(c)[k % BATCH_ROWS].values.to_numpy(zero_copy_only=False) for c in ("ids", "mask"))

    def run(self, start: int, n: int) -> np.ndarray:
        """n ids of the shard from start on."""
        size, out = self.length * BATCH_ROWS, []
        while n > 0:
            part = self.batch(start // size)[start % size : start % size + n]
            if not len(part):
                raise ValueError(f"{self.path} ends before id {start}")
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, length: int = 1024, shards: int | None = None) -> DataFrame:
    """Encodes the texts, each with an end id, and writes them below folder (a URI that all executors reach) in ascending
    order of the id. Returns the written manifest: shard, path, index_path, n_tokens, n_docs, start (ids before the shard).

    A null or empty text is the end id alone; null ids come first; rows with equal ids are ordered by text. An empty table
    gives no shard. Other columns are ignored. A task that runs again writes files of another name, and the manifest, a
    table written once, names those of the attempt that was kept.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary("byte_bpe_50k.json")
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if max(byte_bpe(path).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, local = pyarrow.fs.FileSystem.from_uri(name)
        fs.create_dir(local.rpartition("/")[0], recursive=True)
        encoder, writer = byte_bpe(path), None
        ids_of, counts = [], []
        for part in slices(batches):
            if writer is None:
                writer = ShardWriter(fs, f"{local}.arrow", length, width)
            for ids in encoder.encode(part.column("text")):
                ids = np.frombuffer(ids + end, "<u4")
                counts.append(len(ids))
                writer.add(ids)
            ids_of += part.column("doc_id").to_pylist()
        if writer is None:
            return
        total = writer.close()
        n = np.array(counts, np.int64)
        index = pa.RecordBatch.from_arrays([pa.array(ids_of, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n)], schema=_INDEX)
        with fs.open_output_stream(f"{local}.index.arrow") as sink, pa.ipc.new_file(sink, _INDEX) as out:
            out.write_table(pa.Table.from_batches([index]), 65_536)
        yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "path": [f"{name}.arrow"], "index_path": [f"{name}.index.arrow"], "n_tokens": [total], "n_docs": [len(n)]})

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(write, "shard long, path string, index_path string, n_tokens long, n_docs long")
    manifest.write.parquet(f"{folder}/manifest")
    kept = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not each document
    return kept.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """The documents in the files of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = pyarrow.fs.FileSystem.from_uri(row["path"])
                reader = ShardReader(fs, local)
                with fs.open_input_file(pyarrow.fs.FileSystem.from_uri(row["index_path"])[1]) as source:
                    index = pa.ipc.open_file(source).read_all()
                for part in index.to_batches(8192):
                    starts, counts = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    crcs = [zlib.crc32(reader.run(s, n).astype("<u4")) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts + row["start"]), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "index_path", "start").repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, shared_folder(spark)))


QUERIES = {"op9_arrow_files": op9_arrow_files}
