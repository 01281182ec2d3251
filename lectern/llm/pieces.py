"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut where no piece of the vocabulary can cross (before a space mark, around line ends), and each different part
is encoded once per worker. The parts of a slice lie one after another in one flat numpy array of symbols. In each round
every part finds its best pair (the minimum rank over its segment), all parts merge at once, leftmost first, and finished
symbols are compacted away, until no pair remains.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, kept, slices
from .tokens import default_vocabulary

_MARK = "▁"  # what the library writes for a space
_NONE = np.iinfo(np.int32).max
#: Parts that a worker keeps before it starts afresh, and the longest part that it keeps.
CACHE_PARTS, CACHE_CHARS = 500_000, 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value, of a protocol-buffers message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[i : i + n]
        i += n


class PieceModel:
    """A BPE model file with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        found = [dict(_fields(v)) for k, v in model if k == 1]
        trainer, normaliser = (dict(_fields(next(v for k, v in model if k == n))) for n in (2, 3))
        if trainer.get(3) != 2 or not trainer.get(35) or normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        self.pieces = [p[1].decode() for p in found]
        kinds = [p.get(3, 1) for p in found]  # 1 normal, 2 unknown, 3 control, 6 byte
        self.end_id = next(i for i, p in enumerate(self.pieces) if p == "</s>")
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == 1}
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses words")
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        scores = np.array([struct.unpack("<f", p[2])[0] for p in found])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        # what a piece decodes to
        surface = [{1: p.replace(_MARK, " ").encode(), 2: " ⁇ ".encode(), 6: b""}.get(k, b"") for p, k in zip(self.pieces, kinds, strict=True)]
        for b, i in enumerate(self.byte_ids):
            surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        # symbols of single characters; unknown ones count on from the end of the vocabulary
        n = len(self.pieces)
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # pairs that merge, and whether all places of a pair may merge at once: no longer piece with it comes first
        first = np.full(n, _NONE, np.int64)
        keys, merged = [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                for part in (a, b):
                    if part is not None:
                        first[part] = min(first[part], rank[i])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.rank, self.at_once = rank, first > rank
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # parts without and with a space mark before

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbol and its rank for each pair, _NONE where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        into = np.where(hit, self.merged[at], 0)
        return into, np.where(hit, self.rank[into], _NONE)

    def merge(self, parts: Sequence[str]) -> list[bytes]:
        """The ids of each part (not empty) as little-endian 32-bit integers."""
        sizes = np.array([len(p) for p in parts])
        done: list[bytes | None] = [None] * len(parts)
        sym = self.symbol[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        word = np.repeat(np.arange(len(parts)), sizes)
        into, rank = self._pairs(sym, np.append(sym[1:], 0))
        rank[np.cumsum(sizes) - 1] = _NONE
        while len(sym):
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, begins)
            counts = np.diff(np.append(begins, len(sym)))
            ended = best == _NONE
            if ended.any():
                out = np.repeat(ended, counts)
                flat, ends = sym[out], np.cumsum(counts[ended])
                for w, b, e in zip(word[begins[ended]].tolist(), (ends - counts[ended]).tolist(), ends.tolist(), strict=True):
                    done[w] = self._ids(flat[b:e])
                keep = ~out
                sym, word, into, rank = sym[keep], word[keep], into[keep], rank[keep]
                best, counts = best[~ended], counts[~ended]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, counts))
            # leftmost first: every second hit of a run of overlapping ones; one hit a part where later ones must wait
            run = np.diff(hits, prepend=-2) != 1
            place = np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
            leftmost = np.diff(word[hits], prepend=-1) != 0
            hits = hits[leftmost | self.at_once[into[hits]] & (place % 2 == 0)]
            sym[hits] = into[hits]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, into, rank = sym[keep], word[keep], into[keep], rank[keep]
            changed = place[hits]
            changed = np.unique(np.concatenate([changed, np.maximum(changed - 1, 0)]))
            right = np.minimum(changed + 1, len(sym) - 1)
            into[changed], rank[changed] = self._pairs(sym[changed], sym[right])
            rank[changed[(right == changed) | (word[changed] != word[right])]] = _NONE
        return done

    def _ids(self, symbols: np.ndarray) -> bytes:
        n = len(self.pieces)
        if (symbols < n).all():
            return symbols.astype("<i4").tobytes()
        out = []
        for s in symbols.tolist():
            out += [s] if s < n else [self.byte_ids[b] for b in chr(s - n).encode()]
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text, without an end id; a null text counts as empty."""
        bare, marked = self.known
        plans = [self._parts(t) for t in texts]
        long = []
        for known, prefix, lists in ((bare, "", [p for plan in plans for p in plan[0]]), (marked, _MARK, [p for plan in plans for p in plan[1]])):
            if len(known) > CACHE_PARTS:
                known.clear()
            fresh = list(set().union(*lists).difference(known))
            if fresh:
                long += [(known, p) for p in fresh if len(p) > CACHE_CHARS]
                known.update(zip(fresh, self.merge([prefix + p for p in fresh]), strict=True))
        newline = np.array([self.byte_ids[10]], "<i4").tobytes()
        out = []
        for heads, rests in plans:
            lines = [b"".join(map(bare.__getitem__, h)) + b"".join(map(marked.__getitem__, r)) for h, r in zip(heads, rests, strict=True)]
            out.append(newline.join(lines))
        for known, part in long:
            del known[part]
        return out

    def _parts(self, text: str | None) -> tuple[list[list[str]], list[list[str]]]:
        """For each line, the part before its first space mark (none, or one) and those after one."""
        if not text:
            return [], []
        heads, rests = [], []
        for i, line in enumerate(text.replace(_MARK, " ").split("\n")):
            words = (f" {line}" if i == 0 else line).split(" ")
            head = words[0]
            heads.append([head] if head else [])
            rests.append(words[1:] if "" not in words else _with_runs(words[1:]))
        return heads, rests

    def decode(self, ids: Iterable[np.ndarray]) -> list[str]:
        """The texts of lists of ids, as the library decodes them: controls go, and the dummy prefix goes. Bytes that are
        no UTF-8 become U+FFFD; encode() makes none."""
        lists = list(ids)
        flat = np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)
        sizes = self.surface_len[flat]
        ends = np.cumsum(sizes)
        at = np.repeat(self.surface_at[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        data, ends = self.surface[at].tobytes(), np.append(0, ends)
        cuts = ends[np.cumsum([0, *(len(x) for x in lists)])].tolist()
        out = []
        for b, e in zip(cuts, cuts[1:], strict=False):
            out.append(data[b + (data[b : b + 1] == b" ") : e].decode("utf-8", "replace"))
        return out


def _with_runs(words: list[str]) -> list[str]:
    """Words that a space stood before, with runs of spaces put back: each of them as marks before the next word."""
    out, marks = [], 0
    for w in words[:-1]:
        if w:
            out.append(_MARK * marks + w)
            marks = 0
        else:
            marks += 1
    out.append(_MARK * marks + words[-1]) if words else None
    return out


def piece_model(path: str) -> PieceModel:
    """The worker's model of a vocabulary file, kept between tasks."""
    return kept(("pieces", path), lambda: PieceModel(path))


def encode_and_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, add_end: bool = True) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text of those ids again).

    A null text counts as empty: the end id alone, decoded to the empty string. Every row is handled by itself, so repeated
    rows and null ids pass through; other columns are left out; an empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        end = model.end_id.to_bytes(4, "little") if add_end else b""
        for part in slices(batches):
            encoded = [ids + end for ids in model.encode(part.column("text").to_pylist())]
            flat = np.frombuffer(b"".join(encoded), "<i4")
            cuts = np.cumsum([0, *(len(e) // 4 for e in encoded)])
            decoded = model.decode(np.split(flat, cuts[1:-1])) if encoded else []
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op5_pieces": op5_pieces}
