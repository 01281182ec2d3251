"""License notices in whole texts: exact phrases, and short notices with a few edits.

A notice of n characters with at most k edits is split into k + 1 pieces, of which at least one must occur unchanged
(pigeonhole). Exact searches for the pieces locate candidate windows; only there does the regex library match the notice
with bounded errors, which verifies the edits and gives the span.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, kept, slices

#: Phrases and labels of the base search. Fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices, labels, and edits allowed in them.
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("this work is licensed under the gnu general public license version 3", "gpl", 7),
    ("apache license", "apache", 1),
    ("licensed under the apache license version 2 0", "apache", 5),
    ("mit license", "mit", 1),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 8),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("creative commons attribution", "cc-by", 3),
    ("free and unencumbered software released into the public domain", "unlicense", 6),
    ("all rights reserved", "proprietary", 2),
)
_WORD = bytes(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_TABLE = bytes(c if c in _WORD else 32 for c in (b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))


@dataclass(frozen=True)
class Span:
    """A place: first word and number of words, label, edits, likeness (1 without edits), and whether it is a base phrase."""

    first: int
    words: int
    label: str
    edits: int
    likeness: float
    base: bool


class NoticeSearch:
    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str, int]] = NOTICES):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices = []
        for text, label, edits in notices:
            body = text.encode()
            cuts = [len(body) * i // (edits + 1) for i in range(edits + 2)]
            pieces = [(body[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
            pattern = regex.compile(rb"(?<= )(?:" + regex.escape(text).encode() + rb"){e<=%d}(?= )" % edits, regex.BESTMATCH)
            self.notices.append((body, label, edits, pieces, pattern))

    @staticmethod
    def words(text: str | None) -> bytes:
        """The words, in lower case, each with a space on both sides."""
        return b" %b " % b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())

    def spans(self, line: bytes) -> list[Span]:
        found = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append(Span(line.count(b" ", 0, at), phrase.count(b" ") - 1, label, 0, 1.0, True))
                at = line.find(phrase, at + 1)
        for body, label, edits, pieces, pattern in self.notices:
            windows = []
            for piece, offset in pieces:
                at = line.find(piece)
                while at >= 0:
                    begin = at - offset - edits - 1
                    windows.append((max(0, begin), begin + len(body) + 2 * edits + 2))
                    at = line.find(piece, at + 1)
            # The best match of a part comes first; worse ones may stand before and after it.
            parts = list(_joined(sorted(windows)))
            while parts:
                begin, stop = parts.pop()
                if m := pattern.search(line, begin, stop):
                    parts += [(begin, m.start()), (m.end(), stop)]
                    n = sum(m.fuzzy_counts)
                    found.append(Span(line.count(b" ", 0, m.start()) - 1, m.group().count(b" ") + 1, label, n, 1 - n / len(body), False))
        return found


def _joined(windows: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Windows that overlap, as one."""
    if not windows:
        return
    begin, end = windows[0]
    for b, e in windows[1:]:
        if b > end:
            yield begin, end
            begin = b
        end = max(end, e)
    yield begin, end


def find_notices(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """doc_id, n_words, and spans (array of first, words, label, edits, likeness, base), in order of place.

    A null or empty text has no words and no spans. Rows are handled one by one, so null ids and repeated rows pass
    through; other columns are left out; an empty table gives an empty result.
    """
    key = (tuple(phrases), tuple(notices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = kept(("notices", key), lambda: NoticeSearch(*key))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("likeness", pa.float64()), ("base", pa.bool_())]))
        for part in slices(batches):
            lines = [search.words(t) for t in part.column("text").to_pylist()]
            spans = [[vars(s) for s in sorted(search.spans(x), key=lambda s: (s.first, not s.base, s.label, s.edits))] for x in lines]
            counts = pa.array([max(0, x.count(b" ") - 1) if len(x) > 2 else 0 for x in lines], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, pa.array(spans, kind)], names=["doc_id", "n_words", "spans"])

    span = "struct<first: long, words: long, label: string, edits: long, likeness: double, base: boolean>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_words long, spans array<{span}>")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s.base)
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    first = F.transform(base, lambda s: s["first"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.likeness)), F.lit(0.0)).alias("score"),
        F.size(F.filter("spans", lambda s: ~s.base)).cast("long").alias("n_fuzzy"),
    )


QUERIES = {"op1_licenses": op1_licenses}
