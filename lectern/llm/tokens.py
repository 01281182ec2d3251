"""Byte-level BPE ids of whole texts, as the tokenizers library gives them, with repeated words encoded once per worker.

A group of texts is cut into the pieces of the vocabulary's own splitting pattern in numpy, by the classes of its bytes. A
table gives the ids of pieces met before, new ones go through the vocabulary's merges together, and the ids are gathered.
Words with characters whose classes may change, or with an apostrophe, go through the library, and so do texts with white
space beyond ASCII, cut where the pattern always cuts. The result is that of encoding the whole text; only repeats are spared.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa

from .common import kept

#: White space as the vocabulary's splitting pattern has it (Unicode's White_Space property). Fixed values.
_SPACE = "\t-\r \x85\xa0  -     　"
#: The splitting pattern never joins characters across these chunks: one space goes to the word after it, and of a longer
#: run of white space the last character stays apart.
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The splitting pattern for characters below U+0250, whose classes never change. Fixed values.
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: White space beyond ASCII, as in _SPACE.
_WHITE_POINTS = [ord(c) for c in (*"\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))]
#: Marks that stay a piece of their own after a word of letters.
_MARKS = frozenset(",.;:!?")
#: What a worker keeps at most: two generations of parts, some 200 bytes each. A part longer than CACHE_CHARS is encoded
#: each time.
CACHE_WORDS, CACHE_FIRST, CACHE_CHARS = 87_000, 10_000, 64
#: UTF-8 bytes of texts that are cut and merged together; a longer text goes alone.
GROUP_CHARS = 1 << 20
#: Slots of a worker's table of pieces (a power of two; some 50 bytes each), the bytes of a piece it has at most (two
#: 64-bit numbers) and the ids. A new piece takes the place of the one in its slot. Other pieces are merged each time.
TABLE_SLOTS, TABLE_BYTES, TABLE_IDS = 1 << 17, 16, 8
#: Longer pieces than these bytes go through the library.
MERGE_BYTES = 2 * CACHE_CHARS + 1
#: Words are merged beside others of like length: at most so many bytes, a space included.
_WIDTHS = (7, 10, 14, 20, 32, MERGE_BYTES)
#: Classes of bytes. Those of U+00C0 to U+024F, save three of which two are signs, are all of letters.
_IS_LETTER, _IS_NUMBER, _IS_SIGN, _IS_ODD, _IS_SPACE, _IS_WHITE = range(6)
#: For the bytes of a piece that are part of a key: all bits of so many bytes.
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(TABLE_BYTES + 1)], np.uint64)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(TABLE_BYTES + 1)], np.uint64)


def _byte_class(b: int) -> int:
    if b == 32:
        return _IS_SPACE
    if 9 <= b <= 13:
        return _IS_WHITE
    if b >= 0x80:  # two-byte characters up to U+024F; bytes within characters go with what begins them
        return _IS_LETTER if b < 0xC0 or 0xC3 <= b <= 0xC9 else _IS_ODD
    c = chr(b)
    return _IS_LETTER if c.isalpha() else _IS_NUMBER if c.isdigit() else _IS_ODD if b < 32 or c in "'\x7f" else _IS_SIGN


_CLASSES = bytes(map(_byte_class, range(256)))


def default_vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine; the operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    """From a part of text to its ids; a missing part is encoded by `make`, which also says whether to keep it.

    Parts come in two generations: when the young one is full, it takes the place of the old one, and parts of the old
    one that are met again become young. So frequent parts stay.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids, keep = self.make(part)
            if not keep:
                return ids
        if len(self) >= self.most:
            self._age()
        self[part] = ids
        return ids

    def _age(self) -> None:
        self.old.clear()
        self.old = dict(self)
        self.clear()


class Merges:
    """The merges of a byte-level BPE model, for many words side by side.

    Words are the columns of an array, their symbols its rows. In each round the best pair of every column, the leftmost of
    the least rank, becomes one symbol, until no column has a pair. Rows of merged symbols stay, empty, and each row knows
    the filled ones above and below it.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], letters: dict[int, str]):
        found = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(merges)}
        self.none = 1 + max(vocab.values())  # stands for no symbol; no pair has it
        self.no_rank = len(merges)
        self.into = np.zeros(len(merges) + 1, np.int32)
        pairs = np.array(list(found), np.uint64).reshape(-1, 2)
        ranks = np.array([i for i, _ in found.values()], np.int32)
        self.into[ranks] = [new for _, new in found.values()]
        keys = pairs[:, 0] << np.uint64(32) | pairs[:, 1]
        # a hash table; keys that find their slot taken are in sorted arrays beside it
        self.shift = np.uint64(64 - max(2 * len(keys), 2).bit_length() - 1)
        slots = self._slots(keys)
        self.slot_key, self.slot_rank = (np.full(1 << (64 - int(self.shift)), x, t) for x, t in ((~np.uint64(0), np.uint64), (self.no_rank, np.int32)))
        at = np.unique(slots, return_index=True)[1]
        self.slot_key[slots[at]], self.slot_rank[slots[at]] = keys[at], ranks[at]
        rest = np.delete(np.arange(len(keys)), at)
        rest = rest[np.argsort(keys[rest])]
        self.crowded = np.zeros(len(self.slot_key), bool)
        self.crowded[slots[rest]] = True
        self.rest_key, self.rest_rank = np.append(keys[rest], ~np.uint64(0)), np.append(ranks[rest], self.no_rank).astype(np.int32)
        # single bytes, and 256 for none
        self.byte = np.array([vocab[letters[b]] for b in range(256)] + [self.none], np.int32)
        self.byte_rank = self._ranks(np.repeat(self.byte, 257), np.tile(self.byte, 257))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; no_rank where it doesn't merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = self._slots(keys)
        hit = self.slot_key[slots] == keys
        ranks = np.where(hit, self.slot_rank[slots], np.int32(self.no_rank))
        again = np.flatnonzero(~hit & self.crowded[slots])
        if len(again):
            at = np.searchsorted(self.rest_key, keys[again])
            ranks[again] = np.where(self.rest_key[at] == keys[again], self.rest_rank[at], self.no_rank)
        return ranks

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word after a space; each word is one piece of the splitting pattern."""
        data = np.frombuffer(" ".join(["", *words]).encode(), np.uint8)
        begins = np.flatnonzero(data == 32)
        ids, starts, counts = self.spans(data, begins, np.diff(np.append(begins, len(data))))
        raw = ids.tobytes()
        return [raw[4 * b : 4 * (b + n)] for b, n in zip(starts.tolist(), counts.tolist(), strict=True)]

    def spans(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the pieces at these places of UTF-8 data: all ids, and for each piece its first one's place there and
        their number."""
        starts, counts = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        out: list[np.ndarray] = []
        least = total = 0
        for most in (*_WIDTHS, max(_WIDTHS[-1], int(sizes.max(initial=0)))):
            chosen = np.flatnonzero((sizes > least) & (sizes <= most))
            least = most
            if len(chosen):
                rows = np.arange(min(most, int(sizes[chosen].max())))[:, None]
                codes = np.where(rows < sizes[chosen], data[np.minimum(begins[chosen] + rows, len(data) - 1)].astype(np.int32), 256)
                for ids, n, which in self._block(codes, chosen):
                    starts[which], counts[which] = total + np.cumsum(n) - n, n
                    out.append(ids)
                    total += len(ids)
        return np.concatenate(out) if out else np.zeros(0, "<u4"), starts, counts

    def _block(self, codes: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The words in the columns of codes (bytes, or 256 for none) as they are done: ids, their number by word, which."""
        height, n = codes.shape
        bits = height.bit_length()
        none = np.full((1, n), self.none, np.int32)
        sym = np.concatenate([none, self.byte[codes], none])  # an empty row above and below
        ranks = np.full((height + 2, n), self.no_rank, np.int32)
        ranks[1:height] = self.byte_rank[codes[:-1] * 257 + codes[1:]]
        place = np.arange(height + 2, dtype=np.int32)[:, None]
        best = (ranks.astype(np.int64) << bits + 1) | place
        up, down = (np.repeat(x, n, 1) for x in (np.maximum(place - 1, 0), np.minimum(place + 1, height + 1)))
        end = np.int64(self.no_rank) << bits + 1
        while True:
            least = best.min(axis=0)
            going = least < end
            left = np.count_nonzero(going)
            if left <= 0.7 * n:
                yield (*self._done(sym[:, ~going]), chosen[~going])
                if not left:
                    return
                sym, best, up, down = (np.compress(going, x, axis=1) for x in (sym, best, up, down))  # in row order, so that reshape makes views
                chosen, least, n = chosen[going], least[going], left
                columns = np.arange(n)
            else:
                columns = np.flatnonzero(going)
                least = least[columns]
            flat_sym, flat_best, flat_up, flat_down = (x.reshape(-1) for x in (sym, best, up, down))
            row = least & (2 << bits) - 1
            new = self.into[least >> bits + 1]
            here = row * n + columns
            gone = flat_down[here].astype(np.int64) * n + columns
            below_row = flat_down[gone]
            below, above_row = below_row.astype(np.int64) * n + columns, flat_up[here]
            above = above_row.astype(np.int64) * n + columns
            flat_sym[here], flat_sym[gone] = new, self.none
            flat_best[gone] = end
            flat_down[here], flat_up[below] = below_row, row
            ranks = self._ranks(np.concatenate([new, flat_sym[above]]), np.concatenate([flat_sym[below], new])).astype(np.int64) << bits + 1
            flat_best[here], flat_best[above] = ranks[: len(row)] | row, ranks[len(row) :] | above_row

    def _done(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sym = np.ascontiguousarray(sym.T)
        held = sym != self.none
        return sym[held].astype("<u4"), np.count_nonzero(held, axis=1)


class PieceTable:
    """Ids of pieces met before, by the bytes of a piece as two numbers. Each piece has one slot it can be in."""

    def __init__(self, slots: int):
        self.shift = np.uint64(65 - slots.bit_length())
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)  # 0: empty, as no piece here has a byte 0
        self.counts = np.zeros(slots, np.int64)
        self.ids = np.zeros(slots * TABLE_IDS, "<u4")

    @staticmethod
    def hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(31)
        return mixed * np.uint64(0xD6E8FEB86659FD93)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def put(self, slots: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Different pieces, with their ids in `ids`; of several for one slot one is kept, and none with too many ids."""
        few = np.flatnonzero(counts <= TABLE_IDS)
        few = few[np.unique(slots[few], return_index=True)[1]]
        slots, starts, counts = slots[few], starts[few], counts[few]
        self.low[slots], self.high[slots], self.counts[slots] = low[few], high[few], counts
        places = np.arange(TABLE_IDS)
        self.ids.reshape(-1, TABLE_IDS)[slots] = ids[np.minimum(starts[:, None] + places, len(ids) - 1)]


def _joined_spans(sources: list[np.ndarray], which: np.ndarray, starts: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The runs of `counts` entries from `starts` of source number `which`, one after another; `ends` are their sums."""
    base = np.cumsum([0, *map(len, sources)])
    pool = np.concatenate(sources)
    return pool[np.repeat(starts + base[which] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class ByteBpe:
    """Encodes texts to unsigned 32-bit little-endian ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.piece_model = self.tokenizer.model
        self.first = _Cache(lambda part: (self._chunk(part), len(part) <= CACHE_CHARS), CACHE_FIRST)  # parts that no space stands before
        self.words = _Cache(self._word, CACHE_WORDS)  # words after a space, which is left out of the key
        self.newline = self._library("\n")
        self.merges = self._merges()
        self.table = PieceTable(TABLE_SLOTS)

    def _merges(self) -> Merges | None:
        """The model's merges; none if it has more rules than these, so that each part goes through the library."""
        model = json.loads(self.tokenizer.to_str())["model"]
        more = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if any(model.get(x) for x in more) or not model["vocab"].keys() >= set(self.letters.values()):
            return None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return Merges(model["vocab"], pairs, self.letters)

    def _library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.letters[32])
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([pack("<I", t.id) for t in self.piece_model.tokenize(shown)])

    def _word(self, word: str) -> tuple[bytes, bool]:
        keep = len(word) <= CACHE_CHARS
        if word[0] == "\n":  # a line end before the word in place of a space
            return self.newline + self.first[word[1:]], keep
        if not keep or not word.isascii() and max(word) >= "ɐ":
            return self._chunk(" " + word), keep
        if word.isalpha():
            return self._piece(" " + word), True
        if word[-1:] in _MARKS and word[:-1].isalpha():  # the word itself and the mark are kept already, or will be
            return self.words[word[:-1]] + self.first[word[-1]], False
        return self._chunk(" " + word), True

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if len(chunk) > 4096 or not chunk.isascii() and max(chunk) >= "ɐ":
            return self._library(chunk)
        found = _PIECE.findall(chunk)
        return self._piece(chunk) if len(found) == 1 else self._joined(found)

    def _joined(self, parts: list[str]) -> bytes:
        words, first = self.words, self.first
        return b"".join([words[p[1:]] if p[0] == " " and not p.isspace() else first[p] for p in parts])

    def _plan(self, text: str | None) -> list[str] | None:
        """The words of a text with one space or one line end between any two; a line end stays before its word."""
        if not text or any(t in text for t in self.added):
            return None
        words = text.split()
        lines = "\n" in text
        if " ".join(words) != (text.replace("\n", " ") if lines else text):
            return None
        return text.replace("\n", " \n").split(" ") if lines else words

    def _from_plan(self, plan: list[str]) -> bytes:
        return self.first[plan[0]] + b"".join(map(self.words.__getitem__, plan[1:]))

    def encode_one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):  # their places come before all splitting
            return self._library(text)
        plan = self._plan(text)
        return self._joined(_CHUNK.findall(text)) if plan is None else self._from_plan(plan)

    def encode(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text; a null text counts as empty and has none."""
        if not self.merges:
            return [self.encode_one(t) for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        if not data:
            return [b""] * len(texts)
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)
        out, begin = [], 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + GROUP_CHARS, "right")) - 1)
            out += self._group(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
            begin = end
        return out

    def _apart(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> list[int]:
        """Which of the texts have white space beyond ASCII, or one of the vocabulary's added tokens."""
        found = []
        leads = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
        if len(leads):
            one, two, three = (data[np.minimum(leads + i, len(data) - 1)].astype(np.int64) for i in range(3))
            points = np.where(one == 0xC2, two, (one & 15) << 12 | (two & 63) << 6 | three & 63)
            found.append(leads[np.isin(points, _WHITE_POINTS)])
        apart = set(np.searchsorted(offsets, np.concatenate(found), "right").tolist()) if found else set()
        apart = {i - 1 for i in apart}
        for token in self.added:
            if (t := token.encode()) in raw:
                apart |= {i for i, (b, e) in enumerate(pairwise(offsets.tolist())) if t in raw[b:e]}
        return sorted(apart)

    def _cut(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """Where the pieces of these texts begin, which of them are odd (more than one piece of the pattern, perhaps), and
        the places where texts begin that are left whole."""
        n = len(data)
        classes = np.frombuffer(bytearray(raw + b"\n").translate(_CLASSES), np.uint8)  # one more at the end
        starts = np.zeros(n + 1, bool)
        starts[offsets] = True
        if not raw.isascii():
            pairs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC9) & (data[1:] >= 0x90))
            classes[pairs] = _IS_ODD
        odd = np.flatnonzero(classes == _IS_ODD)
        whole = set()
        if len(odd):  # an odd byte makes its whole word odd
            breaks = np.flatnonzero((classes >= _IS_SPACE) | starts)
            words = np.unique(np.searchsorted(breaks, odd, "right")) - 1
            inside = np.zeros(n + 1, np.int8)
            inside[breaks[words] + (classes[breaks[words]] >= _IS_SPACE)] += 1
            inside[breaks[words + 1]] -= 1
            classes[np.cumsum(inside, dtype=np.int8).view(bool)] = _IS_ODD
        for i in self._apart(data, raw, offsets):
            b, e = offsets[i : i + 2].tolist()
            classes[b:e] = _IS_ODD
            whole.add(b)
        cuts = np.empty(n + 1, bool)
        cuts[0] = True
        np.not_equal(classes[1:], classes[:-1], out=cuts[1:])
        white = np.flatnonzero(classes[:n] >= _IS_SPACE)
        after = white[classes[white] == _IS_SPACE] + 1  # a space goes to what comes after it
        cuts[after[classes[after] < _IS_SPACE]] = False
        run = white[1:][np.diff(white) == 1]  # of several the last stays apart if something comes after it
        cuts[run] = (classes[run + 1] < _IS_SPACE) & ~starts[run + 1]
        cuts[offsets] = True
        begins = np.flatnonzero(cuts[:n])
        return begins, classes[np.append(begins[1:], n) - 1] == _IS_ODD, whole

    def _odd(self, piece: str) -> bytes:
        return self.words[piece[1:]] if piece[0] == " " and len(piece) > 1 else self.first[piece]

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of the texts in this UTF-8 data, which begin and end at these offsets."""
        if not len(data):
            return [b""] * (len(offsets) - 1)
        raw = data.tobytes()
        begins, odd, whole = self._cut(data, raw, offsets)
        sizes = np.diff(np.append(begins, len(data)))
        # sources of ids: the table, this group's merges, the library
        which = np.zeros(len(begins), np.int8)
        padded = np.frombuffer(raw + bytes(TABLE_BYTES), np.uint8)
        eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        held = np.minimum(sizes, TABLE_BYTES)
        low, high = eight[begins] & _LOW[held], eight[begins + 8] & _HIGH[held]
        hashes, table = PieceTable.hashes(low, high), self.table
        slots = table.slots(hashes)
        short = (sizes <= TABLE_BYTES) & ~odd
        known = (table.low[slots] == low) & (table.high[slots] == high) & short
        starts, counts = slots * TABLE_IDS, table.counts[slots]
        # new short pieces once each, and long ones
        new = np.flatnonzero(short & ~known)
        first, same = np.unique(hashes[new], return_index=True, return_inverse=True)[1:]
        first = new[first]
        clash = (low[first[same]] != low[new]) | (high[first[same]] != high[new])  # equal hashes of different pieces
        long = np.flatnonzero(~short & ~odd & (sizes <= MERGE_BYTES))
        seen: dict[bytes, int] = {}
        long_same = [seen.setdefault(raw[b:e], len(seen)) for b, e in zip(begins[long].tolist(), (begins + sizes)[long].tolist(), strict=True)]
        long_first = long[np.unique(np.array(long_same, np.int64), return_index=True)[1]]
        made = np.concatenate([first, long_first])
        ids, its_starts, its_counts = self.merges.spans(data, begins[made], sizes[made])
        for pieces, number in ((new, same), (long, np.array(long_same, np.int64) + len(first))):
            which[pieces], starts[pieces], counts[pieces] = 1, its_starts[number], its_counts[number]
        # the others one by one
        rest = np.concatenate([np.flatnonzero(odd | (sizes > MERGE_BYTES)), new[clash]])
        numbers: dict[bytes, int] = {}
        parts: list[bytes] = []
        number: list[int] = []
        for b, e in zip(begins[rest].tolist(), (begins + sizes)[rest].tolist(), strict=True):
            piece = raw[b:e]
            number.append(numbers.setdefault(piece, len(parts)))
            if number[-1] == len(parts):
                parts.append(self.encode_one(piece.decode()) if b in whole else self._odd(piece.decode()))
        part_counts = np.array([len(p) // 4 for p in parts], np.int64)
        which[rest], starts[rest], counts[rest] = 2, (np.cumsum(part_counts) - part_counts)[number], part_counts[number]
        ends = np.cumsum(counts)
        out = _joined_spans([table.ids, ids, np.frombuffer(b"".join(parts), "<u4")], which, starts, counts, ends).tobytes()
        if len(first):
            table.put(slots[first], low[first], high[first], ids, its_starts[: len(first)], its_counts[: len(first)])
        at = (4 * np.append(0, ends))[np.searchsorted(begins, offsets)].tolist()
        return [out[b:e] for b, e in pairwise(at)]


def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    return kept(("byte_bpe", path), lambda: ByteBpe(path))
