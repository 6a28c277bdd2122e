"""Removal of repeated byte strings by distributed prefix doubling.

Every byte covered by a string of `LENGTH` bytes (a window) that also starts earlier, in a smaller doc_id or further left,
is removed. Strings are judged on the input and never cross documents.

- Names (64-bit ranks of equal strings) of all positions are built by doubling: the name of 2n bytes at p
  comes from the pair of names of n bytes at p and p + n, up to 64, and any length from two that overlap.
- Every window is tied to its least name of 50 bytes, its anchor: equal windows have equal anchors at equal
  places, so only anchors are compared instead of all positions, about one in 26.
- Spark ranks rows of neighbouring windows in rounds of growing length of what all windows of a row share (50,
  93, then 100 bytes; 51, 8, then 1 window a row). A row whose shared string is unique is done: no window of it is
  repeated. Rows with the same shared string and the same windows form a class, ranked by its first position: all others
  of it are repeats. Only first rows that share their string with another class enter the next round.
- Counts and first positions are pre-aggregated per task before they are shuffled, and repeated strings are
  joined back by sort-merge joins that Spark can split, so that a hot string gathers in no task.

Windows are compared by two 64-bit names. Windows that are unlike in all their parts are taken for equal with a probability
of 2**-128 a pair; both names are made from the same names of shorter strings, so for windows that differ in one short
part only, which near copies have, it is 2**-64 a pair.

Null texts count as empty. Rows of one doc_id with unlike texts are documents of their own, ordered by the SHA-256 of their
texts; rows equal in both are one document, and all lose the same bytes. Rows with a null doc_id are kept as
they are and do not count for others. Extra columns of any name are ignored or, by `remove`, kept. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, forget_others, packed, release

LENGTH = 100
#: Windows in a row, by round.
ROUNDS = (51, 8, 1)
#: Bytes of text named at once, and rows that lose their repeats at once: both bound a worker's memory.
_SLICE, ROWS_AT_ONCE = (1 << 19) - 4 * LENGTH, 500
_LOW = np.uint64((1 << 20) - 1)

_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 2**63, 256, "u8")
_ODD = _rng.integers(0, 2**62, 64, "u8") * np.uint64(2) + np.uint64(1)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = (x ^ (x >> np.uint64(29))) * _C1 + (y ^ (y >> np.uint64(31))) * _C2
    h ^= h >> np.uint64(32)
    return h


class _Names:
    """Names of the strings of some lengths at all positions of a buffer."""

    def __init__(self, data: np.ndarray, lengths: set[int]) -> None:
        now, size, self.of = _BYTE[data], 1, {}
        while size <= max(lengths):
            for n in lengths:
                if size <= n < 2 * size:
                    self.of[n] = now if n == size else _pair(now[: len(now) - (n - size)], now[n - size :]) if len(now) > n - size else now[:0]
            if len(now) <= size:
                now = now[:0]
            else:
                now = _pair(now[:-size], now[size:])
            size *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Sliding minima."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _rows(docs: list[tuple[int, bytes, np.ndarray | None]], group: int, only_core: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """core, class, pos, n of the rows of windows. docs: place of the first byte, text, and (first, n) of its windows or None for all."""
    held: list[tuple[int, bytes, int, np.ndarray | None]] = []
    size = 0
    for base, text, own in docs:
        for at in range(0, max(1, len(text) - LENGTH + 1), _SLICE):
            part = text[at : at + _SLICE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size + len(part) > _SLICE + LENGTH:
                yield _slice_rows(held, group, only_core)
                held, size = [], 0
            held.append((base + at, part, at, own))
            size += len(part)
    if held:
        yield _slice_rows(held, group, only_core)


def _slice_rows(held: list, group: int, only_core: bool) -> tuple[np.ndarray, ...]:
    seed = LENGTH + 1 - ROUNDS[0]
    data = np.frombuffer(b"".join(h[1] for h in held), "u1")
    sizes = np.array([len(h[1]) for h in held])
    starts = np.cumsum(sizes) - sizes
    active = np.zeros(len(data) + 1, "i4")
    for s, (_, part, at, own) in zip(starts.tolist(), held, strict=True):
        last = len(part) - LENGTH + 1
        if own is None:
            active[s] += 1
            active[s + last] -= 1
        else:
            lo, hi = np.clip(own[0] - at, 0, last), np.clip(own[0] + own[1] - at, 0, last)
            np.add.at(active, s + lo, 1)
            np.add.at(active, s + hi, -1)
    p = np.flatnonzero(np.cumsum(active[:-1]) > 0)
    if not len(p):
        return tuple(np.empty(0, "i8") for _ in range(1 if only_core else 4))
    names = _Names(data, {seed, LENGTH + 1 - group} if only_core else {seed, LENGTH + 1 - group, LENGTH}).of
    order = names[seed] & ~_LOW | np.arange(len(names[seed]), dtype="u8")
    anchor = (_least(order, ROUNDS[0])[p] & _LOW).astype("i8")
    step = (anchor - p) // group
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (step[1:] != step[:-1]) | (p[1:] != p[:-1] + 1)))
    first = np.flatnonzero(new)
    core = names[LENGTH + 1 - group][anchor[first] - group * step[first]]
    if only_core:
        return (core.view("i8"),)
    n = np.diff(np.concatenate((first, [len(p)])))
    if group > 1:
        same = np.add.reduceat(names[LENGTH][p] * _ODD[np.arange(len(p)) - np.repeat(first, n)], first)
    else:
        same = names[seed][anchor[first]]
    doc = np.searchsorted(starts, p[first], "right") - 1
    pos = np.array([h[0] for h in held], "i8")[doc] + p[first] - starts[doc]
    return core.view("i8"), same.view("i8"), pos, n


def _windows(docs: DataFrame, group: int, only_core: bool = False) -> DataFrame:
    """Rows of windows of docs (base, text and, unless all windows are meant, own: array of (first, n)), or only their shared strings."""
    columns = ["core"] if only_core else ["core", "same", "pos", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                own: list = [None] * part.num_rows
                if b.num_columns == 3:
                    own = [np.array([[r["first"], r["n"]] for r in x], "i8").T for x in part.column(2).to_pylist()]
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                for cols in _rows(list(zip(part.column(0).to_pylist(), texts, own, strict=True)), group, only_core):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], columns)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _round(docs: DataFrame, k: int) -> tuple[Staged, Staged | None]:
    """pos, n of the repeated rows of round k, and of the first rows that the next round must look into."""
    group, spark = ROUNDS[k], docs.sparkSession
    if k:  # few rows: written, so that they are made once
        made = Staged(_windows(docs, group), "windows")
        cores, rows = made.df, made.df
    else:  # all rows: made again, so that they take no disk
        cores, rows = _windows(docs, group, only_core=True), _windows(docs, group)
    if k == len(ROUNDS) - 1:
        first = rows.groupBy("core", "same").agg(F.min("pos").alias("head"), F.count("*").alias("k")).where("k > 1").select("core", "same", "head")
        repeats = Staged(rows.join(Staged(first, "first").df, ["core", "same"]).where("pos > head").select("pos", "n"), "repeats")
        made.drop()
        return repeats, None
    twice = cores.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core")
    twice = Staged(twice, "twice").df  # written, so that the join's sides are plain shuffles, which Spark can split
    release(spark)
    held = Staged(rows.join(twice, "core"), "rows")
    if k:
        made.drop()
    release(spark)
    classes = Staged(held.df.groupBy("core", "same", "n").agg(F.min("pos").alias("head")), "classes")
    several = Staged(classes.df.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core"), "several").df
    repeats = Staged(held.df.join(classes.df, ["core", "same", "n"]).where("pos > head").select("pos", "n"), "repeats")
    unclear = Staged(classes.df.join(several, "core").select(F.col("head").alias("pos"), "n"), "unclear")
    held.drop()
    classes.drop()
    release(spark)
    return repeats, unclear


def _per_doc(found: DataFrame, bits: int) -> DataFrame:
    """base, own: the (first, n) of each document."""
    at = F.shiftleft(F.shiftright("pos", bits), bits)
    one = F.struct((F.col("pos") - at).alias("first"), "n")
    return found.select(at.alias("base"), one.alias("one")).groupBy("base").agg(F.collect_list("one").alias("own"))


def _placed(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, int]:
    """row (the columns to keep), text, base (the place of a text's first byte in one order of all bytes) and the bits of the place within a document."""
    rows = docs.select(packed(docs, keep).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    code = F.xxhash64("text")
    ids = rows.groupBy("id").agg(F.min(code).alias("lo"), F.max(code).alias("hi"), F.max(F.octet_length("text")).alias("size"))
    lo, hi, longest, unlike = ids.agg(F.min("id"), F.max("id"), F.max("size"), F.max(F.expr("id IS NOT NULL AND lo <> hi"))).first()
    bits = max(1, int(longest or 0).bit_length())
    if lo is None or ((hi - lo).bit_length() + bits < 63 and not unlike):
        return rows.select("row", "text", F.shiftleft(F.col("id") - F.lit(lo or 0), bits).alias("base")), bits
    # ids too far apart, or several texts under one id: number the documents by their order
    rows = rows.withColumn("tie", F.sha2(F.coalesce("text", F.lit("")), 256))
    keys = rows.select("id", "tie").where("id IS NOT NULL").distinct().sort("id", "tie")
    keys = Staged(keys.withColumn("m", F.monotonically_increasing_id()), "ids").df.withColumn("task", F.shiftright("m", 33))
    counts = sorted((r["task"], r["k"]) for r in keys.groupBy("task").agg(F.count("*").alias("k")).collect())  # a row a task of the sort
    at, bases = 0, []
    for task, k in counts:
        bases.append((task, at))
        at += k
    starts = docs.sparkSession.createDataFrame(bases, "task long, at long")
    numbered = keys.join(starts, "task").select("id", "tie", F.shiftleft(F.col("at") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)), bits).alias("base"))
    return rows.join(numbered, ["id", "tie"], "left").select("row", "text", "base"), bits


def _apply(placed: DataFrame, repeats: DataFrame, bits: int, finish: Callable[[bytes, np.ndarray], tuple], made: T.StructType) -> DataFrame:
    """row and made (a struct of what finish(text, kept bytes as a mask) returns) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for b in batches:
            for i in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(i, ROWS_AT_ONCE)
                out = [finish(*left(t, own)) for t, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                cols = [pa.array(list(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.StructArray.from_arrays(cols, names)], ["row", "made"])

    def left(text: str | None, own: list | None) -> tuple[bytes, np.ndarray]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        cover = np.zeros(len(raw) + 1, "i4")
        if own:
            first = np.array([r["first"] for r in own])
            np.add.at(cover, first, 1)
            np.add.at(cover, first + np.array([r["n"] for r in own]) - 1 + LENGTH, -1)
        return raw, np.cumsum(cover[:-1]) == 0

    names = made.fieldNames()
    joined = placed.join(_per_doc(repeats, bits), "base", "left").select("row", "text", "own")
    return joined.mapInArrow(run, T.StructType([placed.schema["row"], T.StructField("made", made)]))


def find_repeats(placed: DataFrame, bits: int) -> DataFrame:
    """pos, n: n neighbouring windows from place pos on that all start earlier too."""
    known = placed.where("base IS NOT NULL").select("base", "text")
    found: DataFrame | None = None
    unclear: Staged | None = None
    for k in range(len(ROUNDS)):
        docs = known if unclear is None else known.join(_per_doc(unclear.df, bits), "base")
        repeats, following = _round(docs, k)
        found = repeats.df if found is None else found.unionByName(repeats.df)
        if unclear is not None:
            unclear.drop()
        unclear = following
    release(placed.sparkSession)
    return found


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def finish(raw: bytes, kept: np.ndarray) -> tuple:
        rest = np.frombuffer(raw, "u1")[kept].tobytes()
        gone = np.concatenate(([False], ~kept))
        return len(raw), len(raw) - len(rest), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()

    placed, bits = _placed(docs, ["doc_id"])
    made = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    found = _apply(placed, find_repeats(placed, bits), bits, finish, made)
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "made.*")


def remove(docs: DataFrame) -> DataFrame:
    """The rows of docs with the repeated bytes taken out of their texts; characters cut through by a removal go too."""

    def finish(raw: bytes, kept: np.ndarray) -> tuple:
        return (np.frombuffer(raw, "u1")[kept].tobytes().decode("utf-8", "ignore"),)

    placed, bits = _placed(docs, [c for c in docs.columns if c != "text"])
    found = _apply(placed, find_repeats(placed, bits), bits, finish, T.StructType().add("text", "string"))
    return found.select(*[F.col("made.text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
