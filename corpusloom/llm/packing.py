"""Best-fit packing of token counts into sequences of one capacity.

Every document becomes pieces: full ones of exactly the capacity, which are
sequences by themselves, and one rest, which comes first. Rests have one of
capacity - 1 sizes, so the packing is decided on the histogram of sizes, whose
size the corpus does not change: first large-item matching (rests above a third
of the capacity share a sequence with at most one other, greedily with the
largest that still fits), then best fit, largest size first, of the smaller
rests into the smallest remaining gap. The decisions are runs of equal
sequences; pieces take their slots by their rank within their size.

Nulls and empty texts hold the end id alone. Repeated rows are packed each.
Extra columns are ignored. An empty table gives no rows. Null doc_ids are kept.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, forget_others
from .encode import ended, tokenizer_encoder

#: Chunks that a worker keeps in each of two generations: fewer than for token files, as other stages run beside it.
CACHE_CHUNKS = 250_000


def cut(ends: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """text, piece, start and length of the pieces of consecutive texts whose ids, with the end ids, end there."""
    sizes = np.diff(ends, prepend=0)
    pieces = -(-sizes // capacity)
    text = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (sizes - 1) % capacity + 1
    start = np.where(piece == 0, 0, first[text] + (piece - 1) * capacity)
    return text, piece, start, np.where(piece == 0, first[text], capacity)


def ranked(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Of each length, how many equal ones came before; seen counts those of earlier calls and is brought up to date."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=len(seen))
    out = np.empty(len(lengths), "i8")
    out[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
    seen += counts
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text, with its task (block) and its rank there among pieces of its length (nth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(encoders=False)
        enc = tokenizer_encoder(tokenizer, "spaced", CACHE_CHUNKS)
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        for b in batches:
            at = 0
            for ids, ends in enc.columns(b.column(1)):
                own = b.column(0).slice(at, len(ends))
                at += len(ends)
                ids, ends = ended(ids, ends, end_id)
                text, piece, start, length = cut(ends, capacity)
                first = 4 * (start + (ends - np.diff(ends, prepend=0))[text])
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[i:j]) for i, j in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                cols = (own.take(pa.array(text)), piece, start, length, crc, np.full(len(text), block), ranked(length, seen))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, block long, nth long")


@dataclass
class Run:
    """`count` equal sequences numbered from `first`; `used` tokens are taken in each."""

    first: int
    count: int
    used: int


@dataclass
class Slot:
    """Ranks [rank, rank + count) of one size go to sequences first, first + 1, ... at `offset`."""

    size: int
    rank: int
    count: int
    first: int
    offset: int


def plan(sizes: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Slots for a histogram {size: count} and the number of sequences."""
    left = {s: n for s, n in sizes.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    slots: list[Slot] = []
    gaps: dict[int, list[Run]] = {}
    total = 0

    def take(size: int, count: int, first: int, offset: int) -> None:
        slots.append(Slot(size, rank[size], count, first, offset))
        rank[size] += count
        left[size] -= count

    def keep(run: Run) -> None:
        if run.used < capacity:
            gaps.setdefault(capacity - run.used, []).append(run)

    def open_runs(parts: tuple[int, ...], count: int) -> None:
        nonlocal total
        at = 0
        for p in parts:
            take(p, count, total, at)
            at += p
        keep(Run(total, count, at))
        total += count

    if n := left.pop(capacity, 0):
        left[capacity] = n
        open_runs((capacity,), n)
    large = sorted(s for s in left if s > capacity // 3 and s < capacity)
    for s in reversed(large):
        while left[s]:
            i = bisect.bisect_right(large, min(s, capacity - s)) - 1
            while i >= 0 and (left[large[i]] < 1 or (large[i] == s and left[s] < 2)):
                i -= 1
            if i < 0:
                open_runs((s,), left[s])
            elif large[i] == s:
                m = left[s] // 2
                slots.append(Slot(s, rank[s], m, total, 0))
                slots.append(Slot(s, rank[s] + m, m, total, s))
                rank[s] += 2 * m
                left[s] -= 2 * m
                keep(Run(total, m, 2 * s))
                total += m
            else:
                open_runs((s, large[i]), min(left[s], left[large[i]]))
    for s in sorted((s for s in left if s <= capacity // 3), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s), default=None)
            if gap is None:
                k = capacity // s
                if left[s] >= k:  # whole sequences of this size
                    m = left[s] // k
                    for j in range(k):
                        take(s, m, total, j * s)
                    keep(Run(total, m, k * s))
                    total += m
                else:
                    for j in range(n := left[s]):
                        take(s, 1, total, j * s)
                    keep(Run(total, 1, n * s))
                    total += 1
                continue
            run = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            k = min(gap // s, max(1, left[s] // run.count))
            m = min(run.count, left[s])
            for j in range(k):
                take(s, m, run.first, run.used + j * s)
            keep(Run(run.first, m, run.used + k * s))
            if m < run.count:
                keep(Run(run.first + m, run.count - m, run.used))
    return slots, total


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    Only the histogram of sizes (at most `capacity` rows) and the slots derived from it reach the driver.
    Ranks within a size come from counts per (size, block) and their prefix sums, so that no size gathers in one task.
    """
    held = Staged(pieces(docs, tokenizer, capacity, end_id), "pieces").df
    counts = held.groupBy("length", "block").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    starts = Staged(counts.withColumn("base", base), "piece-counts").df
    sizes = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(sizes, capacity)

    by_size: dict[int, tuple[np.ndarray, ...]] = {}
    for s in sizes:
        own = sorted((x for x in slots if x.size == s), key=lambda x: x.rank)
        by_size[s] = tuple(np.array([getattr(x, f) for x in own], "int64") for f in ("rank", "first", "offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            seq, off = np.zeros(len(rank), "int64"), np.zeros(len(rank), "int64")
            for s in np.unique(length):
                own = length == s
                ranks, first, offset = by_size[int(s)]
                i = np.searchsorted(ranks, rank[own], "right") - 1
                seq[own], off[own] = first[i] + rank[own] - ranks[i], offset[i]
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
            yield from t.to_batches()

    slotted = held.join(starts.select("length", "block", "base"), ["length", "block"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return slotted.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
