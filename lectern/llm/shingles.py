"""Hashes of word shingles of many texts at once, and the signatures that the n-gram Jaccard join is indexed by."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np

_U = np.uint64
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_IS_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def shingle_sets(texts: Sequence[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct n-word shingles of the texts, one text after another and ascending in each, and the size
    of each text's set. A text of fewer words has its whole sequence as one shingle; one without words has none."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts])
    data = _LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    space = _IS_SPACE[data]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = np.flatnonzero(space & np.append(False, ~space[:-1])) - starts
    inside = np.flatnonzero(~space)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(begins, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE | _U(1)))
    words = mix(np.add.reduceat(_BYTES[data[inside]] * powers[place], begins) + lengths.astype(np.uint64))
    text_of = np.repeat(np.arange(len(texts)), sizes)[starts]
    counts = np.bincount(text_of, minlength=len(texts))
    # a shingle begins at every word that has n - 1 words of its text behind it, and at the first word of a short text
    firsts = np.cumsum(counts) - counts
    rank = np.arange(len(words)) - firsts[text_of]
    span = np.minimum(counts[text_of], n)
    at = np.flatnonzero(rank + span <= counts[text_of])
    at = at[(span[at] == n) | (rank[at] == 0)]
    total = span[at].astype(np.uint64)
    for k in range(n):
        rows = at + np.minimum(k, span[at] - 1)
        total = mix(total * _BASE + words[rows]) if n <= 8 else total * _BASE + words[rows]
    owner = text_of[at]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        total[a:b].sort()
    fresh = np.append(True, (total[1:] != total[:-1]) | (owner[1:] != owner[:-1]))
    return total[fresh], np.bincount(owner[fresh], minlength=len(texts))


def set_hashes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set that does not depend on anything but its members."""
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(mix(hashes ^ _U(0x5851F42D4C957F2D)), (np.cumsum(sizes) - sizes)[some])
    return mix(out + sizes.astype(np.uint64) * _BASE)


@dataclass(frozen=True)
class Threshold:
    """Two sets are linked where den * intersection >= num * union."""

    num: int
    den: int

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def most_apart(self, total: int) -> int:
        """The largest symmetric difference that linked sets with so many members together can have."""
        return (self.den - self.num) * total // (self.den + self.num)

    def least_partner(self, size: int) -> int:
        return -(-self.num * size // self.den)


@dataclass(frozen=True)
class Scheme:
    """How sets of a band of sizes, low..high, and their smaller partners are indexed.

    The universe of shingles is dealt by hash to `segments`. At most `apart` shingles differ between linked sets, so by the
    pigeonhole principle either one of apart + 1 segments is equal (all bands above DELETION_SIZE: of half as many
    segments again each set takes as many of the cheapest as can differ from its partners, and one more), or, where `deletions` segments are also compared after the deletion
    of one shingle, which covers two differences in one segment, half as many segments do.
    """

    low: int
    high: int
    apart: int
    segments: int
    deletions: int


#: Up to this size, segments with one-deletion neighbourhoods cost less than many tiny segments: the neighbourhoods add a
#: signature for each shingle, and tiny or empty segments are shared by unlike sets.
DELETION_SIZE = 48
#: Ratio of the sizes in a band. Wider bands index fewer sets twice, narrower ones need fewer segments.
BAND = 2.0


@cache
def schemes(threshold: Threshold, largest: int) -> list[Scheme]:
    found, low = [], 1
    while low <= largest:
        high = max(low, int(low * max(BAND, threshold.den / threshold.num)) + 1)  # partners lie in the band or the one below
        apart = threshold.most_apart(2 * high)
        if high <= DELETION_SIZE:
            found.append(Scheme(low, high, apart, (apart + 2) // 2, (apart + 1) // 2))
        else:
            found.append(Scheme(low, high, apart, 3 * (apart + 1) // 2, 0))
        low = high + 1
    return found


def signatures(hashes: np.ndarray, sizes: np.ndarray, threshold: Threshold, hot: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets: (row of the set, signature, whether the set is away there, as after a deletion).

    Two sets need to be compared where they share a signature and not both are away. Where nothing is left of a segment,
    the signature also has a size: a set is at home at its own and away at those of its possible partners.

    hot has signatures (ascending) and how many sets have them; other signatures count as rare. Of a set's segments the
    rarest are taken, by a total order of all signatures, so that linked sets take a common one. Without hot, all are
    given and no deletions, which is what the frequencies are counted from.
    """
    rows_out, sig_out, deleted_out = [], [], []
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    mixed = mix(hashes + _BASE)
    for k, scheme in enumerate(schemes(threshold, int(sizes.max() / min(1.0, threshold.num / threshold.den)) + 2)):
        if scheme.apart == 0:
            continue  # only equal sets are linked
        used = (sizes >= threshold.least_partner(scheme.low)) & (sizes <= scheme.high)
        if not used.any() or hot is None and scheme.deletions:
            continue
        take = used[row_of]
        rows, members = row_of[take], mixed[take]
        segment = ((hashes[take] >> _U(32)) * _U(scheme.segments) >> _U(32)).astype(np.int64)
        cell = rows * scheme.segments + segment
        order = np.argsort(cell, kind="stable")
        cell, members = cell[order], members[order]
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        # also the empty segments: every set has all of them
        cells = (np.flatnonzero(used)[:, None] * scheme.segments + np.arange(scheme.segments)).ravel()
        sums = np.zeros(len(cells), np.uint64)
        at = np.searchsorted(cells, cell[begins])
        sums[at] = np.add.reduceat(members, begins)
        salt = mix((np.arange(scheme.segments, dtype=np.uint64) + _U(k << 32)) * _BASE + _U(1))
        sig = mix(sums + salt[cells % scheme.segments])
        rows = cells // scheme.segments
        if scheme.deletions:
            few = cells % scheme.segments < scheme.deletions
            filled = np.zeros(len(cells), np.int64)
            filled[at] = np.diff(np.append(begins, len(cell)))
            which = np.repeat(at, np.diff(np.append(begins, len(cell))))
            keep = few[which]
            del_sig = mix(sums[which] - members + salt[cells[which] % scheme.segments])[keep]
            del_rows, del_empty = rows[which][keep], filled[which][keep] == 1
            own, theirs = sizes[rows], sizes[del_rows]
            low, high = threshold.least_partner(scheme.low), scheme.high
            # what is left of a segment is nothing: such sets share a signature only with those of a size in reach
            empty = filled == 0
            parts = [(rows[~empty], sig[~empty], False), (del_rows[~del_empty], del_sig[~del_empty], True), (rows[empty], mix(sig[empty] ^ own[empty].astype(np.uint64) * _BASE), False)]
            for r, g, z, same in ((rows[empty], sig[empty], own[empty], False), (del_rows[del_empty], del_sig[del_empty], theirs[del_empty], True)):
                least = np.maximum(low, -(-threshold.num * z // threshold.den))
                most = np.minimum(high, threshold.den * z // threshold.num)
                count = np.maximum(0, most - least + 1)
                partner = np.repeat(least, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                other = np.flatnonzero(same | (partner != np.repeat(z, count)))
                parts.append((np.repeat(r, count)[other], mix(np.repeat(g, count) ^ partner.astype(np.uint64) * _BASE)[other], True))
            for r, g, away in parts:
                rows_out.append(r)
                sig_out.append(g)
                deleted_out.append(np.full(len(g), away))
            continue
        if hot is not None:
            place = np.minimum(np.searchsorted(hot[0], sig), max(0, len(hot[0]) - 1))
            cost = np.where(hot[0][place] == sig, hot[1][place], 1) if len(hot[0]) else np.ones(len(sig), np.int64)
            empty = np.ones(len(cells), bool)
            empty[at] = False
            cost = np.where(empty, np.iinfo(np.int64).max, cost)
            filled = np.zeros(len(cells), np.int64)
            filled[at] = np.diff(np.append(begins, len(cell)))
            order = np.lexsort((sig, -filled, cost, rows))  # of equally rare ones those with more shingles
            nth = np.arange(len(order)) % scheme.segments
            # a set's partners in this band are no larger than `high`, nor than the threshold allows
            partner = np.minimum(scheme.high, sizes[rows[order]] * threshold.den // threshold.num)
            apart = (threshold.den - threshold.num) * (sizes[rows[order]] + partner) // (threshold.den + threshold.num)
            chosen = order[nth <= apart]
            rows, sig = rows[chosen], sig[chosen]
        rows_out.append(rows)
        sig_out.append(sig)
        deleted_out.append(np.zeros(len(sig), bool))
    if not rows_out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    return np.concatenate(rows_out), np.concatenate(sig_out), np.concatenate(deleted_out)
