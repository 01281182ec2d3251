"""Incremental operators. Order is that of arrival, by a sequence number; a session ends by a flush row."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Shortest and longest piece, and the frame that is looked for, in samples.
LEAST, MOST, FRAME = 16, 40, 4


def quietest_cut(samples: list[float], least: int, most: int, frame: int = FRAME) -> int:
    """Where to cut: the middle of the frame with the least energy that begins from least to most - frame."""
    places = range(least, max(least, min(most, len(samples)) - frame) + 1)
    best = min(places, key=lambda i: (round(sum(x * x for x in samples[i : i + frame]), 9), i))
    return min(best + frame // 2, len(samples))


def cut_session(samples: list[float], flush: bool, least: int = LEAST, most: int = MOST) -> tuple[list[list[float]], list[float]]:
    """The pieces that can be cut now, and what stays in the buffer."""
    pieces = []
    while len(samples) >= most:
        at = quietest_cut(samples, least, most)
        pieces.append(samples[:at])
        samples = samples[at:]
    if flush and samples:
        pieces.append(samples)
        samples = []
    return pieces, samples


def session_pieces(events: DataFrame) -> DataFrame:
    """A stream (or table) of session, seq, sample, flush as pieces: session, piece, start, n, energy.

    The state of a session is the offset of its buffer and the buffer, which is shorter than the longest piece.
    """
    schema = "session long, piece long, start long, n long, energy double"

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        piece, start, buffer = state.get if state.exists else (0, 0, [])
        buffer, flush = list(buffer), False
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for sample, last in zip(rows["sample"], rows["flush"], strict=True):
            buffer.append(float(sample))
            flush |= bool(last)
            pieces, buffer = cut_session(buffer, bool(last))
            for p in pieces:
                out.append((key[0], piece, start, len(p), round(sum(x * x for x in p), 6)))
                piece, start = piece + 1, start + len(p)
        state.remove() if flush else state.update((piece, start, buffer))
        yield pd.DataFrame(out, columns=["session", "piece", "start", "n", "energy"])

    return events.groupBy("session").applyInPandasWithState(step, schema, "piece long, start long, buffer array<double>", "append", GroupStateTimeout.NoTimeout)


def settled_text(turns: DataFrame) -> DataFrame:
    """A stream of session, seq, text as settled text: every pass keeps the last two sentences (of 50 words at most) open,
    and settles the rest."""
    schema = "session long, seq long, settled string, open string"

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        out = []
        for seq, text in pd.concat(list(batches)).sort_values("seq")[["seq", "text"]].itertuples(index=False):
            done, held = split_off(f"{held} {text}".strip())
            out.append((key[0], seq, done, held))
        state.update((held,))
        yield pd.DataFrame(out, columns=["session", "seq", "settled", "open"])

    return turns.groupBy("session").applyInPandasWithState(step, schema, "open string", "append", GroupStateTimeout.NoTimeout)


def split_off(text: str, sentences: int = 2, words: int = 50) -> tuple[str, str]:
    """What is settled, and the last sentences that stay open."""
    import re

    cuts = [0, *(m.end() for m in re.finditer(r"[.!?…]['\"”’)]*\s+", text))]
    for at in cuts[-sentences:]:
        if len(text[at:].split()) <= words:
            return text[:at].strip(), text[at:].strip()
    return text, ""


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """An addition beside the incremental operators: counts by event time, with late rows dropped behind a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
