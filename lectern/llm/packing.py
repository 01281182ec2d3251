"""Packing documents into training sequences by best-fit decreasing.

Every task packs the documents of its own input partition, so nothing is shuffled. Documents longer than a window are
first cut into full windows, which are done at once; the rests wait in a buffer of bounded size, are sorted from long to
short, and each goes to the open window with the tightest room, found in a segment tree indexed by remaining capacity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, slices
from .tokens import byte_bpe, default_vocabulary

#: Rests that a task packs together. More make the packing only a little tighter, and each holds its ids in memory.
BUFFER_PIECES = 16_384
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class OpenWindows:
    """Windows with room left, in a segment tree whose leaf c counts the windows with exactly c places left."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, window: int, room: int) -> None:
        self.at[room].append(window)
        self._add(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the window with the least room that is at least length: (window, room)."""
        count, node = self.count, self.leaves + length
        if length >= len(self.at):
            return None
        while not count[node]:  # up until a subtree to the right holds a window
            while node & 1:
                node >>= 1
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # went past the right edge
                return None
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.at[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """For each length (1 to capacity) its window and its offset there. Ties keep the order of the input."""
    spots = [(0, 0)] * len(lengths)
    windows, opened = OpenWindows(capacity), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = windows.tightest(lengths[i])
        window, room = found or (opened, capacity)
        opened += found is None
        spots[i] = (window, capacity - room)
        if room > lengths[i]:
            windows.put(window, room - lengths[i])
    return spots


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = 1024, buffer_pieces: int = BUFFER_PIECES) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids (unsigned 32-bit, little-endian),
    doc_tokens, sequence_id, offset (place in the sequence; gapless from 0).

    A null or empty text is the end id alone. A null doc_id stays null. Repeated rows are packed each. An empty table
    gives an empty result. Other columns are left out. sequence_id holds the input partition above bit 40 and counts from
    0 below it, so that a task that runs again gives the same ids.
    """
    path = vocabulary or default_vocabulary("byte_bpe_50k.json")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = byte_bpe(path), TaskContext.get().partitionId() << 40
        rests: list[tuple] = []
        used = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal used
            spots = best_fit_decreasing([r[2] for r in rests], capacity)
            for i in range(0, len(rests), 1024):
                rows = [(*r, base + used + w, o) for r, (w, o) in zip(rests[i : i + 1024], spots[i : i + 1024], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            used += 1 + max((w for w, _ in spots), default=-1)
            rests.clear()

        for part in slices(batches):
            full = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n - capacity + 1, capacity):
                    full.append((doc_id, start, capacity, ids[4 * start : 4 * (start + capacity)], n, base + used, 0))
                    used += 1
                if rest := n % capacity:
                    rests.append((doc_id, n - rest, rest, ids[4 * (n - rest) :], n))
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*full, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            if len(rests) >= buffer_pieces:
                yield from packed()
        if rests:
            yield from packed()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op10_pack": op10_pack}
