"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order of nearness, and posted in the inverted file of its nearest one.
A file is kept as blocks of vectors that are written once. A query reads the files of its own nearest pivots only; in
each block the footrule distance between its order of pivots and the vectors' orders picks the share that is ranked again
by the exact cosine. All rows are indexed. Files with many blocks are salted, so that no pivot's file lies in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors that the pivots are drawn from at most, pivots (no more than one for PIVOT_EACH of the sample), how many of its
#: nearest ones stand for a vector, and the share of the files that a query reads.
PIVOT_SAMPLE, PIVOTS, PIVOT_EACH, NEAREST, PROBE_SHARE = 2_048, 128, 8, 64, 0.75
#: The share of a block that is ranked by the exact measure, and its least number of vectors.
RERANK_SHARE, RERANK_LEAST = 0.4, 64
#: Vectors in a block of rows and of queries at most, bytes of a block, and bytes that a task gathers for all its blocks.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_BYTES, GATHER_BYTES = 4_096, 512, 1 << 21, 1 << 26
#: Blocks of one file that one task reads.
BLOCKS_A_SALT = 8

_BLOCK = "file int, n int, dim int, ids binary, vectors binary, orders binary"


def usable(matrix: np.ndarray) -> np.ndarray:
    """Which rows are finite and not zero."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.isfinite(matrix).all(1) & (matrix.astype(float) ** 2).sum(1).astype(bool)


def nearest_pivots(matrix: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots by cosine, nearest first; equals in the pivots' order."""
    near = matrix.astype(np.float64) @ pivots.T
    return np.argsort(-near, 1, kind="stable")[:, :nearest].astype("<u2")


def _arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length, without null ones; null components become NaN."""
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.reshape(len(rows), dim)


def _packer(pivots: np.ndarray, nearest: int, files: int, most: int):
    """Posts each vector in the files of its `files` nearest pivots, as blocks. Vectors of another length than the
    pivots' have one file for each length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        rows_in: dict[int, int] = {}
        gathered = 0

        def block(file: int) -> pa.RecordBatch:
            ids, matrix, orders = (np.concatenate(x) for x in zip(*waiting.pop(file), strict=True))
            order = np.argsort(ids, kind="stable")
            values = [rows_in.pop(file)], [matrix.shape[1]], [ids[order].astype("<i8").tobytes()], [matrix[order].astype("<f8").tobytes()], [orders[order].tobytes()]
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=["file", "n", "dim", "ids", "vectors", "orders"])

        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                for rows, matrix in _arrays(part.column("vector")):
                    fine = usable(matrix)
                    own, matrix, dim = ids[rows[fine]], matrix[fine], matrix.shape[1]
                    same = pivots.shape[1:] == (dim,)
                    orders = nearest_pivots(matrix, pivots, max(nearest, files)) if same else np.empty((len(own), 0), "<u2")
                    posted = orders[:, :files].astype(np.int64) if same else np.full((len(own), 1), -dim)
                    orders = orders[:, :nearest]
                    at, place = np.repeat(np.arange(len(own)), posted.shape[1]), posted.ravel()
                    by = np.argsort(place, kind="stable")
                    for some in np.split(by, np.flatnonzero(np.diff(place[by])) + 1) if len(by) else ():
                        file, some_rows = int(place[some[0]]), at[some]
                        waiting.setdefault(file, []).append((own[some_rows], matrix[some_rows], orders[some_rows]))
                        rows_in[file] = rows_in.get(file, 0) + len(some_rows)
                        gathered += len(some_rows) * dim * 8
                        if rows_in[file] >= min(most, max(1, BLOCK_BYTES // (8 * dim))):
                            gathered -= rows_in[file] * dim * 8
                            yield block(file)
                while gathered > GATHER_BYTES:
                    file = max(rows_in, key=lambda f: (rows_in[f] * waiting[f][0][1].shape[1], f))
                    gathered -= rows_in[file] * waiting[file][0][1].shape[1] * 8
                    yield block(file)
        for file in sorted(waiting):
            yield block(file)

    return pack


def closeness(a: np.ndarray, b: np.ndarray, pivots: int) -> np.ndarray:
    """For each order of pivots in a and each in b how far the footrule distance lies below that of orders without a
    common pivot, halved: the sum of k less the larger of the two places, over the pivots that both have."""
    k = a.shape[1]
    worth = [np.zeros((len(x), pivots), np.int16) for x in (a, b)]
    for w, x in zip(worth, (a, b), strict=True):
        np.put_along_axis(w, x.astype(np.int64), np.arange(k, 0, -1, dtype=np.int16)[None].repeat(len(x), 0), 1)
    left, right = np.ascontiguousarray(worth[0].T), np.ascontiguousarray(worth[1].T)
    total = np.zeros((len(a), len(b)), np.int16)
    for p in range(pivots):
        total += np.minimum(left[p][:, None], right[p][None])
    return total


def search_block(query_ids, queries, query_orders, ids, vectors, orders, k: int, share: float, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id and cosine of the k nearest vectors of a block, for each query, but its own."""
    n = len(ids)
    norms, query_norms = np.sqrt((vectors * vectors).sum(1)), np.sqrt((queries * queries).sum(1))
    near = (queries / query_norms[:, None]) @ (vectors / norms[:, None]).T
    near[query_ids[:, None] == ids[None]] = -9.0
    most = max(RERANK_LEAST, 8 * k, int(share * n))
    if orders.shape[1] and most < n:
        close = closeness(query_orders, orders, pivots)
        near[close < np.partition(close, n - most, 1)[:, n - most][:, None]] = -9.0
    least = np.partition(near, n - k, 1)[:, n - k] if n > k else np.full(len(queries), -2.0)
    q, v = np.nonzero((near >= least[:, None] - 1e-9) & (near > -8.0))  # all that rounding could put among the k
    cosines = (vectors[v] * queries[q]).sum(1) / (norms[v] * query_norms[q])
    order = np.lexsort((ids[v], -cosines, q))
    q, v, cosines = q[order], v[order], cosines[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return query_ids[q[nth < k]], ids[v[nth < k]], cosines[nth < k]


def _unpack(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, dim = row[f"{prefix}n"], row[f"{prefix}dim"]
    orders = np.frombuffer(row[f"{prefix}orders"], "<u2")
    return np.frombuffer(row[f"{prefix}ids"], "<i8"), np.frombuffer(row[f"{prefix}vectors"], "<f8").reshape(n, dim), orders.reshape(n, -1) if orders.size else orders.reshape(n, 0)


def draw_pivots(vectors: DataFrame, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Unit vectors of the most frequent length from a bounded sample by a hash of the id, without near copies, each
    next one the farthest from those before."""
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(sample).toArrow()
    found = []
    for _, matrix in _arrays(pa.concat_arrays(rows.column("vector").chunks)) if rows.num_rows else ():
        matrix = matrix[usable(matrix)].astype(np.float64)
        found.append(matrix / np.sqrt((matrix**2).sum(1, keepdims=True)))
    unit = max(found, key=len, default=np.empty((0, 0)))
    chosen, near = [], np.full(len(unit), -np.inf)
    while len(chosen) < min(count, -(-len(unit) // PIVOT_EACH)):
        at = int(near.argmin())
        if near[at] > 1 - 1e-9:
            break
        chosen.append(at)
        near = np.maximum(near, unit @ unit[at])
    return unit[chosen]


def nearest_neighbours(table: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, nearest: int = NEAREST, probe_share: float = PROBE_SHARE, share: float = RERANK_SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for each row where is_query holds.

    Nearness is the cosine in double precision; of equals the smaller id comes first. A vector that is null, empty or
    zero, or has null or non-finite components, takes no part, nor has a row without id; vectors of different lengths are
    never near. Repeated rows of one id are candidates each, but never for that id. An empty table gives an empty result;
    other columns are left out. Vectors of another length than most are searched without pivots.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("vec_id is not null and vector is not null")
    scratch, chosen = Scratch(table.sparkSession), draw_pivots(rows, pivots)
    count = len(chosen)
    blocks = scratch.write(rows.select("vec_id", "vector").mapInArrow(_packer(chosen, nearest, 1, BLOCK_ROWS), _BLOCK), "files")
    salts = blocks.groupBy("file").agg(F.ceil(F.count("*") / BLOCKS_A_SALT).cast("int").alias("salts"))
    asked = rows.where("is_query").select("vec_id", "vector").mapInArrow(_packer(chosen, nearest, math.ceil(probe_share * count), BLOCK_QUERIES), _BLOCK)
    asked = asked.select(F.col("file"), *(F.col(c).alias(f"q_{c}") for c in ("n", "dim", "ids", "vectors", "orders")))
    asked = asked.join(salts, "file").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    dealt = blocks.join(salts, "file").withColumn("salt", F.pmod(F.xxhash64("ids"), F.col("salts")).cast("int")).drop("salts")
    pairs = dealt.join(asked.hint("shuffle_hash"), ["file", "salt"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = search_block(*_unpack(row, "q_"), *_unpack(row, ""), k, share, count)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nearest_neighbours of every fiftieth vector; nulls, ties, repeats and empty tables as there."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op7_neighbours": op7_neighbours}
