"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

1. A text's set is its distinct shingles of `width` lower-cased words, hashed to 64 bits. ROWS * BANDS minima of
   universal hashes a * x + b are taken over whole sets; each band of minima (ROWS of them, fewer below 85 %) is a
   bucket key, and one byte of every minimum is kept as the signature.
2. Texts with equal sets become one class, of which one representative goes on: copies cost no pairs.
3. In each bucket every member is compared with the smallest one only, so that a bucket of n costs n pairs. Pairs that
   pass the sizes and the signature are confirmed on the full sets, the likeliest of each document first; pairs that
   confirmed links already connect need no confirmation.
4. Buckets whose members are still in several components go on. Small ones compare the members of different
   components pair by pair. In large ones the members outside the largest component are compared with all
   others, in blocks of both, by one product of their set matrices a pair of blocks; only links come out. So no bucket
   is capped and no link between different texts is lost but with the probability that a pair at the
   threshold shares no band, (1 - 0.85**6)**40 = 6e-9, or fails the signature, about 1e-8.
5. Components by large-star and small-star.

Null and empty texts have empty sets and are linked with nothing. Rows of equal doc_id are one vertex, which has the links of
all its texts and so one component, while n_shingles is that of each row's text; rows with a null doc_id are kept, with a
null component. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, forget_others, release
from .components import components

ROWS, BANDS, WIDTH = 6, 40, 5
#: A pair whose signatures agree so many standard deviations below the threshold is not confirmed; 0.72 at 85 %.
MARGIN = 5.64
#: A pair at the threshold may share no band with this probability at most.
MISSED = 1e-8
#: Unresolved buckets up to this size compare pair by pair, larger ones in blocks of about so many members.
SMALL, BLOCK = 32, 256
#: Common shingles whose columns are multiplied at once.
COLUMNS = 8192
#: Bytes of text that a worker shingles at once.
SLICE = 1 << 20

_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(1, 2**64, 256, "u8", endpoint=False) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**63, dtype="u8")) * 2 + 1
_STEP = np.uint64(int(_rng.integers(1, 2**63, dtype="u8")) * 2 + 1)
_A = _rng.integers(0, 2**31, ROWS * BANDS, "u4") * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, ROWS * BANDS, "u4")
_MIX = _rng.integers(0, 2**63, ROWS, "u8") * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + (1 << 16))

        def row(b: int) -> np.ndarray:
            out = np.full(size, b, "u8")
            out[0] = 1
            return np.multiply.accumulate(out)

        _POWERS[:] = [row(_BASE), row(pow(_BASE, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte positions of the words of a buffer."""
    raw = np.frombuffer(data, "u1")
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view("i1")))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[_LOWER[raw]] * up[: len(raw)], dtype="u8")))
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype("u8")), starts


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= SLICE:
            yield from _sets(held, width)
            held, size = [], 0
    yield from _sets(held, width)


def _sets(held: list[bytes], width: int) -> Iterator[np.ndarray]:
    if not held:
        return
    words, at = _word_hashes(b"\n".join(held))
    lengths = np.array([len(h) + 1 for h in held])
    ends = np.searchsorted(at, np.cumsum(lengths))
    n = len(words) - width + 1
    if n > 0:
        runs = words[:n].copy()
        for j in range(1, width):
            runs = runs * _STEP + words[j : j + n]
        runs = _mixed(runs)
    first = 0
    for last in ends.tolist():
        if last - first >= width:
            yield np.unique(runs[first : last - width + 1])
        elif last > first:
            whole = np.uint64(last - first)
            for w in words[first:last].tolist():
                whole = np.uint64((int(whole) * int(_STEP) + w) % 2**64)
            yield _mixed(np.array([whole], "u8"))
        else:
            yield np.empty(0, "u8")
        first = last


def minima(shingles: np.ndarray) -> np.ndarray:
    """ROWS * BANDS minima over a set, as unsigned 32-bit integers."""
    x = (shingles >> np.uint64(32)).astype("u4")
    best = np.full(len(_A), 0xFFFFFFFF, "u4")
    for i in range(0, len(x), 1024):
        np.minimum(best, (_A[:, None] * x[None, i : i + 1024] + _B[:, None]).min(1), out=best)
    return best


def likely(percent: int) -> float:
    """The least share in which the signatures of a pair must agree to be confirmed."""
    p = percent / 100
    return p - MARGIN * (p * (1 - p) / (ROWS * BANDS)) ** 0.5


def band_rows(percent: int) -> int:
    """Minima a band: ROWS, or fewer where a pair at the threshold would share no band too often."""
    p, n = percent / 100, ROWS * BANDS
    return next((r for r in range(ROWS, 1, -1) if n % r == 0 and (1 - p**r) ** (n // r) <= MISSED), 1)


def _band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    bands = len(least) // rows
    mixed = (least.reshape(bands, rows).astype("u8") * _MIX[:rows]).sum(1, dtype="u8") + np.arange(bands, dtype="u8") * np.uint64(0x632BE59BD9B4E019)
    return _mixed(mixed).view("i8")


def signatures(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (which name the set), bands, sig; the last two empty for empty sets."""
    own = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for b in (part.slice(i, 500) for part in batches for i in range(0, part.num_rows, 500)):
            n, k1, k2, bands, sig = [], [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), width):
                n.append(len(s))
                name = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                k1.append(int(name[0]))
                k2.append(int(name[1]))
                least = minima(s) if len(s) else None
                bands.append(_band_keys(least, own) if len(s) else np.empty(0, "i8"))
                sig.append(least.astype("u1").tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary")


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, shingles of the documents in ids(id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                own = b.slice(i, 256)
                sets = [s.view("i8") for s in shingle_sets(own.column(1).to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(run, "id long, shingles array<long>")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b, likeness of the pairs whose sizes and signatures allow a link."""
    side = reps.select(F.col("doc_id"), "n_shingles", "sig")
    both = pairs.join(side.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b")
    both = both.join(side.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a")
    both = both.where(F.least("na", "nb") >= F.greatest("na", "nb") * (percent / 100))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "u1").reshape(b.num_rows, -1) for c in (2, 3))
                like = (x == y).mean(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(like)], ["a", "b", "likeness"])

    found = both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, likeness double")
    return found.where(F.col("likeness") >= likely(percent)).groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: the pairs whose full sets are alike enough."""
    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y") - shared).alias("union")).where(F.lit(100) * F.col("i") >= F.lit(percent) * F.col("union")).select(F.col("b").alias("u"), F.col("a").alias("v"))


class _Links:
    """The confirmed links so far, and the component of every vertex that has one."""

    def __init__(self, docs: DataFrame, reps: DataFrame, percent: int, width: int) -> None:
        self.docs, self.reps, self.percent, self.width = docs, reps, percent, width
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def labelled(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        if self.roots is None:
            return rows.withColumn(name, F.col(key))
        found = rows.join(self.roots.select(F.col("u").alias(key), F.col("v").alias("_root")), key, "left")
        return found.withColumn(name, F.coalesce("_root", key)).drop("_root")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are in different components."""
        return self.labelled(self.labelled(pairs, "a", "_a"), "b", "_b").where("_a <> _b").drop("_a", "_b")

    def add(self, pairs: DataFrame) -> None:
        """Confirm pairs (a, b), each document's likeliest first."""
        found = Staged(_likely(pairs, self.reps, self.percent), "pairs").df
        if found.isEmpty():
            return
        ids = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = Staged(_sets_of(self.docs, ids, self.width), "sets")
        best = found.groupBy("b").agg(F.max_by("a", F.struct("likeness", -F.col("a"))).alias("a"))
        self.take(_confirmed(best, sets.df, self.percent))
        rest = Staged(self.apart(found.join(best, ["a", "b"], "left_anti")), "pairs").df
        if not rest.isEmpty():
            self.take(_confirmed(rest, sets.df, self.percent))
        sets.drop()

    def take(self, links: DataFrame) -> None:
        new = Staged(links, "links").df
        self.links = new if self.roots is None else self.roots.unionByName(new)
        self.roots = components(self.links)


def _several(buckets: DataFrame, links: _Links) -> DataFrame:
    """h, id, root, main (the root of most members), n, apart (members of other roots) of the buckets with several components."""
    rows = Staged(links.labelled(buckets, "id", "root"), "labelled").df
    counts = rows.groupBy("h", "root").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("h").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    mixed = Staged(mixed.select("h", "n", F.col("most.root").alias("main"), (F.col("n") - F.col("most.k")).alias("apart")), "mixed").df
    return Staged(rows.join(mixed, "h"), "mixed").df


def _block_links(percent: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        """One link of every two components that a member asked for (ask) and any other member join."""
        ids, roots, ask = (rows[c].to_numpy() for c in ("id", "root", "ask"))
        sets = [np.asarray(x.values) for x in rows["shingles"]]
        sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(every, kind="stable")
        new = np.concatenate(([True], np.diff(every[order]) != 0))
        name = np.empty(len(every), "i8")
        name[order] = np.cumsum(new) - 1
        common = np.bincount(name) > 1  # a shingle of one member is in no intersection
        place = (np.cumsum(common) - 1)[name]
        use = order[common[name[order]]]  # the entries of common shingles, by shingle
        a, b = np.flatnonzero(ask), np.flatnonzero(~ask)
        shared = np.zeros((len(a), len(b)), "i8")
        at = np.searchsorted(place[use], np.arange(0, int(common.sum()) + COLUMNS, COLUMNS))
        for k in range(len(at) - 1):
            own = use[at[k] : at[k + 1]]
            held = np.zeros((len(sets), COLUMNS), "f4")
            held[owner[own], place[own] - k * COLUMNS] = 1
            shared += (held[a] @ held[b].T).astype("i8")
        union = sizes[a][:, None] + sizes[b][None] - shared
        x, y = np.nonzero((100 * shared >= percent * union) & (roots[a][:, None] != roots[b][None]))
        pairs = np.stack([roots[a][x], roots[b][y]], 1)
        _, first = np.unique(pairs, axis=0, return_index=True)
        return pa.table({"u": ids[a][x[first]], "v": ids[b][y[first]]}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def _in_blocks(large: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """u, v: links between the members of large buckets (as of _several) that are outside the main component and all others."""
    sets = Staged(_sets_of(docs, large.select("id").distinct(), width), "sets").df
    rows = large.withColumn("rows", F.ceil(F.col("n") / BLOCK)).withColumn("asks", F.ceil(F.col("apart") / BLOCK))
    code = F.xxhash64("id")
    everyone = rows.select("h", "id", "root", F.lit(False).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("qb"), F.pmod(code, "rows").alias("mb"))
    asking = rows.where("root <> main").select("h", "id", "root", F.lit(True).alias("ask"), F.pmod(code, "asks").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("mb"))
    blocks = everyone.unionByName(asking).join(sets, "id")
    return blocks.groupBy("h", "qb", "mb").applyInArrow(_block_links(percent), "u long, v long").distinct()


def link_classes(docs: DataFrame, reps: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame | None:
    """Components (u, v) of the representatives `reps`, or None where nothing is linked."""
    links = _Links(docs, reps, percent, width)
    buckets = reps.select(F.explode("bands").alias("h"), F.col("doc_id").alias("id"))
    shared = Staged(buckets.groupBy("h").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1"), "shared").df
    held = Staged(buckets.join(shared, "h").select("h", "id", "a", "n"), "buckets").df
    release(docs.sparkSession)
    links.add(held.where("id <> a").select("a", F.col("id").alias("b")).distinct())

    rest = _several(held.where("n > 2").select("h", "id"), links)
    small = rest.where(F.col("n") <= SMALL).select("h", "id", "root")
    left, right = (small.select("h", F.col("id").alias(i), F.col("root").alias(r)) for i, r in (("a", "ra"), ("b", "rb")))
    links.add(left.join(right, "h").where("a < b AND ra <> rb").select("a", "b").distinct())

    large = rest.where(F.col("n") > SMALL)
    if not large.isEmpty():
        links.take(_in_blocks(_several(large.select("h", "id"), links), docs, percent, width))
    return links.roots


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed = Staged(signatures(docs, percent, width), "signatures").df
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = Staged(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid")), "classes").df
    reps = Staged(known.join(classes.select(F.col("cid").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"]), "representatives").df
    roots = link_classes(docs, reps, percent, width)
    # ids with several sets tie the classes of these sets together
    names = F.struct("k1", "k2")
    several = known.groupBy("doc_id").agg(F.min(names).alias("lo"), F.max(names).alias("hi")).where("lo <> hi").select("doc_id")
    ties = Staged(known.join(several, "doc_id", "left_semi").join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("u"), F.col("cid").alias("v")).where("u <> v").distinct(), "ties").df
    if not ties.isEmpty():
        roots = components(ties if roots is None else ties.unionByName(roots))
    if roots is not None:
        classes = Staged(classes.join(roots.select(F.col("u").alias("cid"), F.col("v").alias("root")), "cid", "left").select("k1", "k2", F.coalesce("root", "cid").alias("cid")), "classes").df
    same = known.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "n_shingles", F.col("cid").alias("component_id"))
    alone = signed.where("NOT (doc_id IS NOT NULL AND n_shingles > 0)").select("doc_id", "n_shingles")
    other = same.join(alone.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "component_id").distinct()  # of ids with other texts
    alone = alone.join(other, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    kept: Column = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return same.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept)
