"""N-gram Jaccard join of whole texts: classes of texts that links connect.

1. One pass hashes every text's shingles. A text is represented by the hash of its set, so that equal sets are one node;
   the pass also gives each node an odd sketch (parities of its members by hash), whose distance to another sketch is
   never more than the symmetric difference, and counts the signatures that many sets share.
2. A second pass indexes the nodes: the universe is partitioned by hash into segments, by bands of size; see shingles.py.
   Which segments a node takes, and whether with one-deletion neighbourhoods, is decided by what they cost.
3. Nodes with a common signature are candidates. They are compared in blocks, of rows that come from the left against
   rows from the right: the first step keeps the rows that sizes and sketches allow a link, or the pairs where they are
   few, in a form that is the same whichever signature it came from, so that what many signatures share is kept once. The
   second verifies with whole sets, nearest pairs first, and leaves out pairs that are connected already. So a block gives
   no more rows than some times those it gets, and no more links than a forest has.
4. At first the least node of each signature is a block's left side, then a few nodes of those signatures that still lie
   in several components, as long as that connects them; at last all nodes outside a signature's main component are
   compared with all its nodes, in tiles. The components of all links are the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, release, slices
from .components import connected_components
from .shingles import Threshold, mix, set_hashes, shingle_sets, signatures

#: Bits of a sketch at least; larger sets have the next power of two from their size on.
SKETCH_BITS = 1024
#: A signature counts as hot from so many sets on; a task reports at most HOT_REPORTED of those it has LOCAL_HOT times
#: among HOT_BATCH, and so many of the most frequent ones go to the workers. It steers costs only, never results.
HOT, LOCAL_HOT, HOT_REPORTED, HOT_BATCH, HOT_KEPT = 48, 4, 2_048, 1_000_000, 16_384
#: Nodes on one side of a block, and shingles that they have together at most (a single larger set is a side of its own).
TILE, TILE_SHINGLES = 512, 1 << 22
#: Nodes that a signature with more than a tile of nodes outside its main component compares in a further round.
HUBS = 8
#: Candidate pairs for each row of a block up to which they are given as pairs.
PAIRED = 2
#: Rows and bytes of blocks that a worker handles together.
HELD_ROWS, HELD_BYTES = 4_096, 1 << 24
#: Bytes of text that are hashed together.
SLICE = 1 << 20
#: Nodes that a task remembers, to leave out repeats before any shuffle; past it, it begins anew.
SEEN = 1_000_000
#: Rows of numbers that may be sent to every executor (some 40 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000

_BLOCK = "key long, tile int, other int, node long, size long, component long, main boolean, away boolean, is_left boolean, is_right boolean, sketch binary"
_KEYS = ("key", "tile", "other")
_PLACE = [c.split()[0] for c in _BLOCK.split(", ")][:-1]
_HUB = ("hub", "hub_size", "hub_component")


def _sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set the parities of its members by hash, in as many places as its size asks for."""
    cuts, places = np.append(0, np.cumsum(sizes)), mix(hashes ^ np.uint64(0xD6E8FEB86659FD93))
    out: list[bytes] = [b""] * len(sizes)
    widths = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for width in np.unique(widths).tolist():
        for rows in np.array_split(np.flatnonzero(widths == width), 1 + (widths == width).sum() * width // (1 << 25)):
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            take = np.concatenate([np.arange(cuts[r], cuts[r + 1]) for r in rows])
            counts = np.bincount(owner * width + (places[take] & np.uint64(width - 1)).astype(np.int64), minlength=len(rows) * width)
            packed = np.packbits((counts & 1).astype(np.uint8).reshape(len(rows), width), axis=1, bitorder="little")
            for r, line in zip(rows, packed, strict=True):
                out[r] = line.tobytes()
    return out


class Sketches:
    """The sketches of some rows; those of unequal width are compared at the smaller one."""

    def __init__(self, column: pa.Array):
        self.raw = column.to_pylist()
        self.words = np.array([len(r) // 8 for r in self.raw], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _at(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the sketches at a width; half a sketch folded on the other is that of half the width."""
        if words not in self.folded:
            rows = np.flatnonzero(self.words >= words)
            table = np.empty((len(rows), words), np.uint64)
            for k, r in enumerate(rows):
                table[k] = np.bitwise_xor.reduce(np.frombuffer(self.raw[r], "<u8").reshape(-1, words), axis=0)
            place = np.full(len(self.raw), -1)
            place[rows] = np.arange(len(rows))
            self.folded[words] = place, table
        return self.folded[words]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The distances of pairs of rows."""
        out, narrow = np.zeros(len(x), np.int64), np.minimum(self.words[x], self.words[y])
        for words in np.unique(narrow).tolist():
            place, table = self._at(words)
            for some in np.array_split(np.flatnonzero(narrow == words), 1 + int((narrow == words).sum()) * words // (1 << 21)):
                out[some] = np.bitwise_count(table[place[x[some]]] ^ table[place[y[some]]]).sum(1)
        return out


def describe(docs: DataFrame, n: int, threshold: Threshold) -> DataFrame:
    """Rows of documents: doc_id, size, node, sketch; and rows of frequent signatures: signature, times (the rest null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("signature", pa.int64()), ("times", pa.int64())])
        waiting: list[np.ndarray] = []
        seen: set[int] = set()
        release()

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            top = np.argsort(-counts, kind="stable")[:HOT_REPORTED]
            top = top[counts[top] >= LOCAL_HOT]
            none = [None] * len(top)
            columns = [none, none, none, none, values[top].view(np.int64), counts[top]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for part in slices(batches, most_bytes=SLICE):
            hashes, sizes = shingle_sets(part.column("text").to_pylist(), n)
            nodes = set_hashes(hashes, sizes)
            columns = [part.column("doc_id"), pa.array(sizes), pa.array(nodes.view(np.int64)), pa.array(_sketches(hashes, sizes), pa.binary()), pa.nulls(len(sizes), pa.int64()), pa.nulls(len(sizes), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            hashes, sizes, _ = _unseen(hashes, sizes, nodes, seen)
            waiting.append(signatures(hashes, sizes, threshold, None)[1])
            if sum(map(len, waiting)) >= HOT_BATCH:
                yield frequent()
        if waiting:
            yield frequent()

    return docs.mapInArrow(run, "doc_id long, size long, node long, sketch binary, signature long, times long")


def _unseen(hashes: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, seen: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets whose node this task does not remember."""
    if len(seen) > SEEN:
        seen.clear()
    keep = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes.tolist()):
        if node not in seen and sizes[i]:
            seen.add(node)
            keep[i] = True
    return hashes[np.repeat(keep, sizes)], sizes[keep], nodes[keep]


def index(docs: DataFrame, n: int, threshold: Threshold, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """signature, node, size, away: what each node is indexed by. Two nodes that are both away need no comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        release()
        for part in slices(batches, most_bytes=SLICE):
            hashes, sizes = shingle_sets(part.column("text").to_pylist(), n)
            hashes, sizes, nodes = _unseen(hashes, sizes, set_hashes(hashes, sizes), seen)
            rows, found, away = signatures(hashes, sizes, threshold, hot)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(nodes[rows].view(np.int64)), pa.array(sizes[rows]), pa.array(away)], names=["signature", "node", "size", "away"])

    return docs.mapInArrow(run, "signature long, node long, size long, away boolean")


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows of signature, node, size and away the different ones whose signature several nodes have, one of them not
    away; with the least node that isn't away and its size. All rows are shuffled once, and a signature's are never held
    at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        names = ["signature", "node", "size", "away", "least", "least_size"]
        given: tuple | None = None  # of a signature that is given in part: itself, its last row, its least node

        def give(signature: np.ndarray, node: np.ndarray, size: np.ndarray, away: np.ndarray) -> pa.RecordBatch:
            begins = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))
            counts = np.diff(np.append(begins, len(signature)))
            several = np.minimum.reduceat(node, begins) != np.maximum.reduceat(node, begins)
            has, least, least_size = ~away[begins], node[begins], size[begins]
            if given and given[0] == signature[0]:
                several[0], (has[0], least[0], least_size[0]) = True, given[2]
            keep = np.repeat(several & has, counts)
            columns = [signature, node, size, away, np.repeat(least, counts), np.repeat(least_size, counts)]
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=names)

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names[:4]]
            new[3] = new[3].astype(bool)
            new = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            signature, node, _, away = new
            fresh = np.append(True, (signature[1:] != signature[:-1]) | (node[1:] != node[:-1]) | (away[1:] != away[:-1]))
            fresh[0] = not given or given[:2] != (signature[0], (node[0], away[0]))
            new = [c[fresh] for c in new]
            if not len(new[0]):
                held = None
                continue
            # rows come by signature, those that aren't away first, and node
            cut = int(np.searchsorted(new[0], new[0][-1]))
            if cut:
                yield give(*(c[:cut] for c in new))
            held = [c[cut:] for c in new]
            if len(held[0]) >= HELD_ROWS:  # more than two different rows are of several nodes
                yield give(*held)
                of = given[2] if given and given[0] == held[0][0] else (not held[3][0], held[1][0], held[2][0])
                given, held = (held[0][-1], (held[1][-1], held[3][-1]), of), None
        if held is not None and len(held[0]):
            yield give(*held)

    ordered = rows.repartition("signature").sortWithinPartitions("signature", "away", "node")
    return ordered.mapInArrow(run, "signature long, node long, size long, away boolean, least long, least_size long")


def _in_blocks(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """work on whole blocks, several at a time: tables whose rows come sorted by block and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        release()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                held.append(batch.slice(begin, 256))
                if sum(b.num_rows for b in held) < HELD_ROWS and sum(b.nbytes for b in held) < HELD_BYTES:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                same = np.ones(table.num_rows, bool)
                for c in _KEYS:
                    values = table.column(c).to_numpy()
                    same &= values == values[-1]
                if whole := table.num_rows - int(same.sum()):
                    yield from work(table.slice(0, whole).combine_chunks()).to_batches()
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "node").mapInArrow(run, schema)


def _candidates(table: pa.Table, threshold: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a block, one from the left and one from the right, of different components, that sizes and
    sketches allow a link; and their sketches' distances."""
    begins = np.flatnonzero(np.diff(_block_of(table), prepend=-1))
    ends = np.repeat(np.append(begins[1:], table.num_rows), np.diff(np.append(begins, table.num_rows)))
    size, component = (table.column(c).to_numpy() for c in ("size", "component"))
    away, left, right, main = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("away", "is_left", "is_right", "main"))
    sketches = Sketches(table.column("sketch").combine_chunks())
    found, rows, step = [], np.arange(table.num_rows), 1
    while len(rows := rows[rows + step < ends[rows]]):
        x, y = rows, rows + step
        fine = (component[x] != component[y]) & ~(away[x] & away[y]) & (left[x] & right[y] | right[x] & left[y])
        x, y = x[fine], y[fine]
        small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        fine = threshold.den * small >= threshold.num * large
        x, y = x[fine], y[fine]
        apart = sketches.apart(x, y)
        fine = apart <= (threshold.den - threshold.num) * (size[x] + size[y]) // (threshold.den + threshold.num)
        found.append((x[fine], y[fine], apart[fine]))
        step += 1
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _block_of(table: pa.Table) -> np.ndarray:
    """The number of each row's block."""
    edge = np.zeros(table.num_rows, bool)
    for c in _KEYS:
        k = table.column(c).to_numpy()
        edge |= np.append(True, k[1:] != k[:-1])
    return np.cumsum(edge) - 1


def _linked_rows(blocks: DataFrame, threshold: Threshold) -> DataFrame:
    """What of blocks has a candidate, in a form that is the same whichever signature it came from: a few pairs as (hub,
    node), with hub the smaller node; more than PAIRED a row as their rows, in a block named by its content."""

    def work(table: pa.Table) -> pa.Table:
        x, y, _ = _candidates(table, threshold)
        block = _block_of(table)
        keep = np.zeros(table.num_rows, bool)
        keep[x] = keep[y] = True
        dense = np.bincount(block[x], minlength=block[-1] + 1) > PAIRED * np.bincount(block[keep], minlength=block[-1] + 1)
        rows, paired = np.flatnonzero(keep & dense[block]), ~dense[block[x]]
        node = table.column("node").to_numpy()
        x, y = x[paired], y[paired]
        hub, other = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)

        content = table.column("node").to_numpy().view(np.uint64)[rows]
        for salt, c in enumerate(("component", "away", "is_left", "is_right"), 1):
            content = mix(content ^ mix(table.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[rows] + np.uint64(salt)))
        names = np.zeros(block[-1] + 1, np.uint64)
        np.add.at(names, block[rows], content)
        plain = table.select(_PLACE).take(pa.array(rows))
        plain = plain.set_column(0, "key", pa.array(mix(names)[block[rows]].view(np.int64))).set_column(1, "tile", pa.array(np.zeros(len(rows), np.int32))).set_column(2, "other", pa.array(np.zeros(len(rows), np.int32)))
        for c in _HUB:
            plain = plain.append_column(c, pa.nulls(len(rows), pa.int64()))
        pairs = {c: pa.nulls(len(other), plain.schema.field(c).type) for c in _PLACE}
        pairs |= {c: pa.array(table.column(c).to_numpy()[other]) for c in ("node", "size", "component")}
        pairs |= {h: pa.array(table.column(c).to_numpy()[hub]) for h, c in zip(_HUB, ("node", "size", "component"), strict=True)}
        return pa.concat_tables([plain, pa.table(pairs, schema=plain.schema)])

    return _in_blocks(blocks, work, _BLOCK.removesuffix(", sketch binary") + "".join(f", {c} long" for c in _HUB))


def _forest(blocks: DataFrame, threshold: Threshold) -> DataFrame:
    """a, b: links between the rows of blocks, verified by whole sets (members), without those that close a circle."""

    def work(table: pa.Table) -> pa.Table:
        x, y, apart = _candidates(table, threshold)
        order = np.argsort(apart, kind="stable")
        members = [np.frombuffer(m, np.uint64) for m in table.column("members").to_pylist()]
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        # of one component within one block
        names = np.unique(np.stack([_block_of(table), component], 1), axis=0, return_inverse=True)[1].ravel().tolist()
        parent = list(range(table.num_rows))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        links: list[tuple[int, int]] = []
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            one, two = top(names[i]), top(names[j])
            if one == two:
                continue
            small, large = sorted((members[i], members[j]), key=len)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            if threshold.linked(int((large[at] == small).sum()), len(small), len(large)):
                parent[max(one, two)] = min(one, two)
                links.append((i, j))
        i, j = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    return _in_blocks(blocks, work, "a long, b long")


class JaccardJoin:
    """The steps after the first pass, with what they share."""

    def __init__(self, scratch: Scratch, docs: DataFrame, n: int, threshold: Threshold):
        self.scratch, self.docs, self.n, self.threshold = scratch, docs, n, threshold
        self.nodes: DataFrame | None = None

    def bounded(self, table: DataFrame) -> DataFrame:
        """The written table, marked for a broadcast if it is small."""
        return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table

    def posted(self, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """signature, node, size, away and the signature's least node that isn't away, where several nodes share one."""
        return self.scratch.write(_shared(index(self.docs, self.n, self.threshold, hot)), "posted")

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """node, members (64-bit hashes, ascending) and sketch of the wanted nodes."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for part in slices(batches, most_bytes=SLICE):
                hashes, sizes = shingle_sets(part.column("text").to_pylist(), n)
                cuts = np.append(0, np.cumsum(sizes))
                members = pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(hashes, sizes).view(np.int64)), members, pa.array(_sketches(hashes, sizes), pa.binary())], names=["node", "members", "sketch"])

        wanted = self.scratch.write(self.nodes.join(wanted, "node").select("doc_id", "node"), "wanted")
        ids = self.bounded(wanted.where("doc_id is not null").select("doc_id").distinct())
        # a node is fetched by its least id; nodes without any are looked for among the texts without id
        texts = self.docs.join(ids, "doc_id", "left_semi").union(self.docs.where("doc_id is null")).select("text")
        found = texts.mapInArrow(run, "node long, members binary, sketch binary").join(self.bounded(wanted.select("node")), "node", "left_semi")
        return self.scratch.write(found.dropDuplicates(["node"]), "sets")

    def links(self, blocks: DataFrame) -> DataFrame:
        """The links in blocks of (key, tile, other, node, size, component, main, away, is_left, is_right)."""
        columns = [*_PLACE, "sketch"]
        rows = _linked_rows(blocks.join(self.nodes.select("node", "sketch"), "node").select(*columns), self.threshold)
        rows = self.scratch.write(rows.distinct(), "candidates")
        rows = rows.where("hub is null").select(*_PLACE).union(self.star_blocks(rows.where("hub is not null").select(*_HUB, "node", "size", "component")))
        sets = self.sets_of(rows.select("node").distinct())
        return self.scratch.write(_forest(rows.join(sets, "node").select(*columns, "members"), self.threshold).distinct(), "found")

    def stars(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs of a left node with others: (hub, hub_size, node, size)."""
        alike = self.threshold.den * F.least("hub_size", "size") >= self.threshold.num * F.greatest("hub_size", "size")
        pairs = self.scratch.write(pairs.where(alike & (F.col("hub") != F.col("node"))).distinct(), "pairs")
        return self.links(self.star_blocks(pairs.select("hub", "hub_size", F.col("hub").alias("hub_component"), "node", "size", F.col("node").alias("component"))))

    def star_blocks(self, pairs: DataFrame) -> DataFrame:
        """Blocks of different pairs (hub, hub_size, hub_component, node, size, component), of a hub with its nodes."""
        side = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_SHINGLES) / F.max("hub_size"))))
        tiles = pairs.groupBy("hub").agg(F.ceil(F.count("*") / side).cast("int").alias("tiles")).where("tiles > 1")
        tiles = self.bounded(self.scratch.write(tiles, "tiles"))
        placed = pairs.join(tiles, "hub", "left").withColumn("tile", F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int"))

        def rows(node: str, size: str, component: str, is_left: bool) -> list[Column]:
            flags = (F.lit(False).alias("main"), F.lit(False).alias("away"), F.lit(is_left).alias("is_left"), F.lit(not is_left).alias("is_right"))
            return [F.col("hub").alias("key"), "tile", F.lit(-1).alias("other"), F.col(node).alias("node"), F.col(size).alias("size"), F.col(component).alias("component"), *flags]

        hubs = placed.select(*rows("hub", "hub_size", "hub_component", True)).distinct()
        return hubs.union(placed.select(*rows("node", "size", "component", False)))

    def placed(self, posted: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The nodes of all signatures with their components; and for each signature that still has several of them its
        main component, how many nodes it has, how many outside the main component, and its largest set.

        A signature's least node has been compared with all others, so it is left out."""
        reached = self.scratch.write(connected_components(links, self.scratch), "reached")
        rows = posted.where("node <> least").join(reached, "node", "left").select("signature", "node", "size", "away", F.coalesce("component", "node").alias("component"))
        rows = self.scratch.write(rows, "placed")
        counted = rows.groupBy("signature", "component").agg(F.count("*").alias("n"), F.max("size").alias("largest"))
        state = counted.groupBy("signature").agg(F.max(F.struct("n", "component")).alias("best"), F.sum("n").alias("n"), F.max("largest").alias("largest"), F.count("*").alias("parts")).where("parts > 1")
        state = self.scratch.write(state.select("signature", F.col("best.component").alias("main"), "n", (F.col("n") - F.col("best.n")).alias("outside"), "largest"), "state")
        return rows, state

    def more_hubs(self, rows: DataFrame, state: DataFrame, seed: int) -> DataFrame:
        """Pairs of some nodes outside the main component of each signature that has many of them, and all its nodes."""
        many = self.bounded(state.where(F.col("outside") > TILE).select("signature", "main"))
        own = rows.join(many, "signature")
        drawn = own.where("component <> main and not away").groupBy("signature", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(HUBS)).alias("slot")).agg(F.min(F.struct(F.xxhash64("node", F.lit(-seed)).alias("draw"), "node", "size", "component")).alias("hub"))
        drawn = self.bounded(self.scratch.write(drawn.select("signature", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.component").alias("hub_component")), "hubs"))
        return own.join(drawn, "signature").where("component <> hub_component").select("hub", "hub_size", "node", "size")

    def tiles(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        """Blocks of all nodes outside a signature's main component against all its nodes."""
        side = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_SHINGLES) / F.col("largest"))))
        sized = state.select("signature", F.col("main").alias("main_component"), F.ceil(F.col("outside") / side).cast("int").alias("lefts"), F.ceil(F.col("n") / side).cast("int").alias("rights"))
        own = rows.join(self.bounded(self.scratch.write(sized, "sized")), "signature").withColumn("main", F.col("component") == F.col("main_component"))
        drawn = F.xxhash64("node")
        columns = lambda tile, other, left, right: ["signature", tile, other, "node", "size", "component", "main", "away", left, right]
        yes, no = F.lit(True), F.lit(False)
        one = (F.col("lefts") == 1) & (F.col("rights") == 1)
        single = own.where(one).select(*columns(F.lit(0).alias("tile"), F.lit(0).alias("other"), (~F.col("main")).alias("is_left"), yes.alias("is_right")))
        lefts = own.where(~one & ~F.col("main")).select(*columns(F.pmod(drawn, F.col("lefts")).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("other"), yes.alias("is_left"), no.alias("is_right")))
        rights = own.where(~one).select(*columns(F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("tile"), F.pmod(drawn, F.col("rights")).cast("int").alias("other"), no.alias("is_left"), yes.alias("is_right")))
        return single.union(lefts).union(rights).withColumnRenamed("signature", "key")

    def run(self, rows: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """All links that are needed to connect what is linked."""
        posted = self.posted(hot)
        nodes = rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch"))
        self.nodes = self.scratch.write(nodes.join(posted.select("node").distinct(), "node", "left_semi"), "nodes")
        links = self.stars(posted.select(F.col("least").alias("hub"), F.col("least_size").alias("hub_size"), "node", "size"))
        before, seed = None, 1
        while True:
            placed, state = self.placed(posted, links)
            outside = state.agg(F.sum("outside"), F.sum(F.when(F.col("outside") > TILE, F.col("outside")))).first()
            if not outside[0]:
                return links
            if not outside[1] or before is not None and outside[1] > 0.8 * before:
                return self.scratch.write(links.union(self.links(self.tiles(placed, state))), "links")
            before, seed = outside[1], seed + 1
            links = self.scratch.write(links.union(self.stars(self.more_hubs(placed, state, seed))), "links")


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) for each row.

    Texts are linked where den * intersection >= num * union of their sets of distinct n-word shingles; words are runs
    without ASCII white space, with A-Z in lower case. A shorter text has its whole sequence as one shingle. Null, empty
    and wordless texts have no shingle and are linked with nothing: their component is their own id. Equal texts are
    linked. Rows with a null id take part like others and have the component of what they reach, null if that has no id;
    rows with equal ids stay single rows, and a component reaches through every text of an id. Texts of any length go in
    whole; blocks of very long ones hold fewer of them. An empty table gives an empty result; other columns are left out,
    whatever their names. Shingles and sets count as equal if 64-bit hashes of them are (among 10^9 different sets, two
    are taken for one with a probability of about 3 %).
    """
    threshold = Threshold(num, den)
    own, scratch = id_and_text(docs, id_col, text_col), Scratch(docs.sparkSession)
    described = scratch.write(describe(own, n, threshold), "described")
    counted = described.where("signature is not null").groupBy("signature").agg(F.sum("times").alias("times")).where(F.col("times") >= HOT)
    hot = counted.orderBy(F.desc("times"), "signature").limit(HOT_KEPT).toArrow()
    values, times = (hot.column(c).to_numpy().astype(np.int64) for c in ("signature", "times"))
    order = np.argsort(values.view(np.uint64))
    rows = described.where("size is not null").select("doc_id", "size", "node", "sketch")

    links = JaccardJoin(scratch, own, n, threshold).run(rows, (values.view(np.uint64)[order], times[order]))
    classes = scratch.write(connected_components(links, scratch), "classes")
    joined = rows.join(classes, "node", "left").select("doc_id", "size", F.coalesce("component", "node").alias("component"))
    least = scratch.write(joined.where("size > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    found = joined.where("size > 0").join(least, "component").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    scratch.keep_only(described, classes, least)
    return found.union(joined.where("size = 0").select("doc_id", "size", "doc_id"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows, with all their columns, without those that links connect to a row of a smaller id. Rows of one id, and
    rows without id, stay together. Nulls, repeats, very long texts and empty tables as for jaccard_classes."""
    classes = jaccard_classes(docs, id_col=id_col, text_col=text_col, n=n, num=num, den=den)
    scratch = Scratch(docs.sparkSession)
    gone = scratch.write(classes.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_classes of all documents with three words and 0.9; nulls, repeats, ties and empty tables as there."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90)


QUERIES = {"op2_jaccard": op2_jaccard}

#: The same classes by a join of all shingles and a walk along the links.
ORACLES = {
    "op2_jaccard": r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 90 * (x.n + y.n - common.n)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
    JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id"""
}
