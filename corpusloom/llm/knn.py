"""Exact top-k search by inner product: a Voronoi kNN join over integer vectors.

1. Components become floor(256 * x). Vectors that are null, hold null or non-finite components, or have no id take no
   part; vectors of different lengths are not compared. They travel as 16-bit integers where these hold them.
2. Data are grouped by the nearest of about sqrt(n) pivots p (at most PIVOTS), vectors with the smallest hashes of their ids.
   Queries are grouped by the nearest of a few of these, at most GROUPS, so that a group has some hundreds of queries.
3. Each query q is first compared with a bounded sample of the data group nearest to it; its k-th best score there is a
   threshold t that its k best overall reach. As q.x <= q.p + |q| |x - p|, a vector x of a data group can matter to a query only
   if |x - p| >= (t - q.p) / |q|. The least of these distances over the queries of a group is all that the group says
   to a data group: vectors that lie closer to their pivot are not copied there, whole data groups are skipped by
   their radius, and short vectors by |x| >= t / |q|.
4. A group of queries is cut into blocks and the vectors it needs into slices, so that no group, however hot, is one
   task; each block meets each slice, and the k best of the slices are merged.

The pivots and samples only make the bounds tight: any give the same result. Clustered data are copied to few groups of
queries; where distances tell nothing, as for random directions in many dimensions, every vector goes to every group.

Ties go to the smaller vec_id. Rows of equal vec_id are candidates each; of equal queries one is asked. Extra columns
are ignored. An empty table gives no rows. Products that 64-bit floats cannot hold are made with Python's integers, and
scores beyond 64 bits are cut to their range. What reaches the driver: the pivots, one row a data group, and one distance
for each pair of a group of queries and a data group, at most GROUPS * PIVOTS.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged

#: Pivots and groups of queries at most, mean queries in a group, queries in a block, vectors in a slice, and vectors of a data group's sample.
PIVOTS, GROUPS, QUERY_GROUP, QUERY_BLOCK, SLICE, SAMPLE = 1024, 256, 512, 1024, 65_536, 2048
_LIMIT = 2.0**53


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, dim, v (the components as 16-bit integers, or 64-bit floats where these do not hold them) of the vectors that take part."""
    scaled = F.transform(embedding, lambda x: x.cast("double") * 256)
    held = rows.select(F.col(vec_id).cast("long").alias("id"), scaled.alias("v"))
    held = held.where("id IS NOT NULL AND v IS NOT NULL").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def packed(v: np.ndarray) -> bytes:
        return v.astype("<i2").tobytes() if np.abs(v).max(initial=0) < 1 << 15 else v.astype("<f8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [np.floor(np.asarray(x.values, "f8")) if len(x) else np.empty(0) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(v) for v in vecs], pa.int32()), pa.array(map(packed, vecs), pa.binary())], ["id", "dim", "v"])

    return held.mapInArrow(run, "id long, dim int, v binary")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    held = column.to_pylist()
    if all(len(x) == 2 * dim for x in held):
        return np.frombuffer(b"".join(held), "<i2").reshape(len(held), dim).astype("f8")
    return np.stack([np.frombuffer(x, "<i2" if len(x) == 2 * dim else "<f8").astype("f8") for x in held])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance to it."""
    far = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)
    near = far.argmin(1)
    return near, _norms(x - pivots[near])


def _with_group(rows: DataFrame, pivots: np.ndarray, few: np.ndarray) -> DataFrame:
    """rows with the numbers of the nearest pivot and of the nearest of a few, the distance to the first, and the norm."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim)
                near, far = _nearest(x, pivots)
                cols = [b.column(0), b.column(1), pa.array(near.astype("i4")), pa.array(_nearest(x, few)[0].astype("i4")), pa.array(far), pa.array(_norms(x))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "v", "g", "qg", "far", "norm"])

    return rows.select("id", "v").mapInArrow(run, "id long, v binary, g int, qg int, far double, norm double")


def _slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What rounding may add to a product of vectors of these norms."""
    return 1e-6 * a * b + 1e-3


def _reached(queries: DataFrame, data: DataFrame, sizes: DataFrame, dim: int, k: int) -> DataFrame:
    """id, low: the k-th best score of each query among the sample of its nearest data group, or none."""
    sampled = data.join(F.broadcast(sizes), "g").where("pmod(xxhash64(id), parts) = 0").select("id", "v", "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"))
    asked = queries.join(F.broadcast(sizes), "g").select("id", "v", "g", F.expr("pmod(xxhash64(id, 1), blocks)").cast("int").alias("qb"))
    best = asked.groupBy("g", "qb").cogroup(sampled.groupBy("g", "qb")).applyInArrow(_solve(dim, k), "query_id long, vec_id long, score long")
    return best.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where((F.col("n") >= k) & (F.col("low") > -(2**63))).select(F.col("query_id").alias("id"), "low")


def _wanted(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """qg, g, far: the least distance from a pivot at which a vector may matter to a group of queries; g is -1 for the least norm."""
    dim, most = pivots.shape[1], _norms(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            q, low = _matrix(b.column(0), dim), b.column(2).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
            norm = np.maximum(_norms(q), 1e-9)[:, None]
            against = np.concatenate([q @ pivots.T + _slack(norm, most[None]), np.full((len(q), 1), 1e-3)], 1)
            far = (low[:, None] - against) / norm
            for g in np.unique(qg := b.column(1).to_numpy()).tolist():
                own = far[qg == g].min(0)
                least[g] = np.minimum(least[g], own) if g in least else own
        for g, far in least.items():
            places = pa.array(np.append(np.arange(len(far) - 1), -1).astype("i4"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(far), g, "i4")), places, pa.array(far)], ["qg", "g", "far"])

    # the queries of a group lie in a few tasks, so that few rows are merged
    dealt = queries.select("v", "qg", F.col("low").cast("double"), F.expr("pmod(id, 4)").alias("part")).repartition("qg", "part").select("v", "qg", "low")
    return dealt.mapInArrow(run, "qg int, g int, far double").groupBy("qg", "g").agg(F.min("far").alias("far"))


def _needed(data: DataFrame, wanted: np.ndarray, norms: np.ndarray) -> DataFrame:
    """id, v and qg: each vector once for every group of queries that it may matter to. wanted: the least distance by group of queries and pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                g, far, norm = (b.column(i).to_numpy() for i in (2, 3, 4))
                # rounding: distances of floats, by a share of what they were made from
                slack = 1e-6 * (far + norm) + 1e-3
                i, qg = np.nonzero(((far + slack)[:, None] >= wanted.T[g]) & ((norm + slack)[:, None] >= norms[None]))
                for at in range(0, len(i), 20_000):
                    own = pa.array(i[at : at + 20_000])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(qg[at : at + 20_000].astype("i4"))], ["id", "v", "qg"])

    return data.select("id", "v", "g", "far", "norm").mapInArrow(run, "id long, v binary, qg int")


def _solve(dim: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        """The k best of one slice for each query of one block."""
        if not queries.num_rows or not data.num_rows:
            return out.empty_table()
        q, x = _matrix(queries["v"], dim), _matrix(data["v"], dim)
        ids, own = data["id"].to_numpy(), queries["id"].to_numpy()
        exact = dim * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < _LIMIT
        got: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            if exact:
                scores = (part @ x.T).astype("i8")
            else:
                whole = np.array([[int(a) for a in row] for row in part], object) @ np.array([[int(a) for a in row] for row in x], object).T
                scores = np.array([[max(-(2**63), min(2**63 - 1, int(a))) for a in row] for row in whole], "i8").reshape(len(part), len(x))
            for i, row in enumerate(scores):
                use = np.flatnonzero(ids != own[at + i])
                if len(use) > k:
                    least = np.partition(row[use], len(use) - k)[len(use) - k]
                    use = use[row[use] >= least]
                use = use[np.lexsort((ids[use], -row[use].astype("f8") if not exact else -row[use]))[:k]]
                got[0].extend([int(own[at + i])] * len(use))
                got[1].extend(ids[use].tolist())
                got[2].extend(row[use].tolist())
        return pa.table([pa.array(c, pa.int64()) for c in got], schema=out)

    return run


@dataclass
class Join:
    """The groups of queries and the vectors copied to each."""

    queries: DataFrame
    needed: DataFrame
    asked: dict[int, int]
    copied: dict[int, int]
    vectors: int

    @property
    def share(self) -> float:
        """The share of all copies that a join without bounds would make."""
        return sum(self.copied.values()) / max(1, self.vectors * len(self.asked))


def top_k(rows: DataFrame, is_query: str, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row with is_query (an expression over id)."""
    vectors = Staged(integer_vectors(rows), "vectors").df
    out: DataFrame | None = None
    for (dim,) in sorted(tuple(r) for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).select("dim").collect()):
        join = plan(vectors.where(F.col("dim") == dim), is_query, k, pivots, dim)
        found = None if join is None else _solved(join, dim, k)
        out = found if out is None else out if found is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def plan(vectors: DataFrame, is_query: str, k: int, pivots: int, dim: int) -> Join | None:
    """Group vectors (id, v) of one length, bound what each group of queries needs, and copy it there."""
    asked_for = Staged(vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v")), "asked").df
    total, questions = vectors.count(), asked_for.count()
    if not questions:
        return None
    picked = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(min(pivots, math.isqrt(total) + 1)).select("v").collect()
    centres = np.unique(_matrix(pa.array([r["v"] for r in picked], pa.binary()), dim), axis=0)
    parts = min(len(centres), GROUPS, math.ceil(questions / QUERY_GROUP))
    few = centres[np.unique(np.linspace(0, len(centres) - 1, parts).astype(int))]
    data = Staged(_with_group(vectors, centres, few[:1]), "grouped").df
    queries = Staged(_with_group(asked_for, centres, few), "queries").df

    counts = data.groupBy("g").agg(F.count("*").alias("n")).join(queries.groupBy("g").agg(F.count("*").alias("q")), "g")
    sizes = counts.select("g", F.ceil(F.col("n") / SAMPLE).alias("parts"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("blocks"))  # at most a row a pivot
    low = _reached(queries, data, sizes, dim, k)
    queries = Staged(queries.select("id", "v", "qg").join(low, "id", "left"), "bounded").df
    wanted, norms = np.full((len(few), len(centres)), np.inf), np.full(len(few), np.inf)
    for r in _wanted(queries, centres).collect():
        if r["g"] < 0:
            norms[r["qg"]] = r["far"]
        else:
            wanted[r["qg"], r["g"]] = r["far"]
    needed = Staged(_needed(data, wanted, norms), "needed").df
    asked = {r["qg"]: r["n"] for r in queries.groupBy("qg").agg(F.count("*").alias("n")).collect()}
    copied = {r["qg"]: r["n"] for r in needed.groupBy("qg").agg(F.count("*").alias("n")).collect()}
    return Join(queries, needed, asked, copied, total)


def _solved(join: Join, dim: int, k: int) -> DataFrame:
    def per_group(counts: dict[int, int], size: int) -> Column:
        return F.element_at(F.array(*[F.lit(math.ceil(counts.get(g, 1) / size)) for g in range(max(join.asked) + 1)]), F.col("qg") + 1)

    blocks, slices, code = per_group(join.asked, QUERY_BLOCK), per_group(join.copied, SLICE), F.xxhash64("id")
    asked = join.queries.select("id", "v", "qg", F.pmod(code, blocks).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("xs"))
    given = join.needed.select("id", "v", "qg", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("qb"), F.pmod(code, slices).cast("int").alias("xs"))
    keys = ["qg", "qb", "xs"]
    best = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(_solve(dim, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
