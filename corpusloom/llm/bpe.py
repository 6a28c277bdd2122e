"""Byte-level BPE by merge replay over the distinct words of blocks of texts.

An inverted index maps each mergeable token pair to its positions in all distinct words of a block that the worker has
not met. Merges are applied in rank order to every position of their pair; a merge removes and adds only the pairs of the
touched neighbours. Ids are looked up again for each text. Equal words have equal ids whatever else a block holds, so
blocks need no shuffle: replaying the words of the whole corpus at once gives the same ids, but every text, or every
word of every block, has to be shuffled to its ids and back, which the README has figures for.

Null and empty texts have no ids. Rows are encoded each, so ties and repeated rows do not matter; extra columns
are ignored by the query and kept by `encode`, whose new column has underscores after its name where docs has that name
already; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, packed
from .encode import CachedEncoder, gathered, spaced


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """The merge table of a rank file: which pairs of ids merge, and into what."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}

    def of(self, left: int, right: int) -> int:
        """The id that the pair merges into, or -1."""
        pair = (left, right)
        got = self.merged.get(pair)
        if got is None:
            got = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
            if len(self.merged) > 2_000_000:
                self.merged.clear()
            self.merged[pair] = got
        return got

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word. The words share one array of tokens; -1 ends a word and marks what was merged away."""
        ids = self.byte_ids
        tokens: list[int] = [-1]
        for w in words:
            tokens.extend([ids[b] for b in w])
            tokens.append(-1)
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        merged, of = self.merged, self.of
        for i in range(1, n - 1):
            left, right = tokens[i], tokens[i + 1]
            if left >= 0 and right >= 0:
                r = merged.get((left, right))
                if r is None:
                    r = of(left, right)
                if r >= 0:
                    index.setdefault(r, []).append(i)
        ranks = list(index)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            places = index.pop(rank, None)
            if not places:
                continue
            places.sort()
            for k, i in enumerate(places):
                j = after[i]
                if tokens[i] < 0 or tokens[j] < 0 or of(tokens[i], tokens[j]) != rank:
                    continue  # a neighbour has changed since
                tokens[i] = rank
                tokens[j] = -2
                nxt = after[j]
                after[i] = nxt
                before[nxt] = i
                low = False
                prev = before[i]
                for a, b, at in ((tokens[prev], rank, prev), (rank, tokens[nxt], i)):
                    if a >= 0 and b >= 0:
                        r = merged.get((a, b))
                        if r is None:
                            r = of(a, b)
                        if r >= 0:
                            if r not in index:
                                index[r] = [at]
                                heapq.heappush(ranks, r)
                            else:
                                index[r].append(at)
                            low |= r <= rank
                if low:  # a lower rank has come up, which goes first
                    if k + 1 < len(places):
                        index.setdefault(rank, []).extend(places[k + 1 :])
                        heapq.heappush(ranks, rank)
                    break
        out: list[list[int]] = []
        word: list[int] = []
        for t in tokens[1:]:
            if t >= 0:
                word.append(t)
            elif t == -1:
                out.append(word)
                word = []
        return out


class Vocabulary:
    """The bytes of every id."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        held = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.flat = np.frombuffer(b"".join(held), "u1")
        self.sizes = np.array([len(t) for t in held])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and where each id's end."""
        return gathered(self.flat, self.starts[ids], self.sizes[ids])


_CODECS: dict[tuple[str, str], tuple[CachedEncoder, Vocabulary]] = {}


def codec(path: str, pattern: str) -> tuple[CachedEncoder, Vocabulary]:
    """Encoder and the bytes of every id, one per worker process."""
    if (path, pattern) not in _CODECS:
        merges, find = Merges(load_ranks(path)), regex.compile(pattern).findall

        def many(chunks: list[str]) -> Iterable[bytes]:
            cut = [find(c) for c in chunks]
            words = list({w for ws in cut for w in ws})
            known = {w: array("I", ids).tobytes() for w, ids in zip(words, merges.replay([w.encode("utf-8", "surrogatepass") for w in words]), strict=True)}
            return [b"".join([known[w] for w in ws]) for ws in cut]

        _CODECS[path, pattern] = (CachedEncoder(many, spaced), Vocabulary(merges.bytes_of))
    return _CODECS[path, pattern]


def encode_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encoded, and decoded again from the ids."""

    def digests(raw: bytes, ends: np.ndarray) -> list[str]:
        view, at = memoryview(raw), [0, *ends.tolist()]
        return [hashlib.sha256(view[i:j]).hexdigest() for i, j in itertools.pairwise(at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, vocabulary = codec(ranks, pattern)
        for b in batches:
            at = 0
            for ids, ends in enc.columns(b.column(1)):
                own = b.column(0).slice(at, len(ends))
                at += len(ends)
                text, text_ends = vocabulary.decode(ids)
                text_ends = np.concatenate(([0], text_ends))[ends]
                cols = [own, pa.array(np.diff(ends, prepend=0)), pa.array(digests(ids.astype("<u4", copy=False).tobytes(), 4 * ends)), pa.array(digests(text.tobytes(), text_ends))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows of `docs` with the ids of their texts as an array, `ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = codec(ranks, pattern)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype("int32") for x in enc.ids(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["row", "made"])

    rows = docs.select(packed(docs, docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("made", T.ArrayType(T.IntegerType()))]))
    return got.select("row.*", F.col("made").alias(free("ids", docs.columns)))


def decode(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with the text of their array of ids, `decoded`; bytes that are no UTF-8 become U+FFFD, and null ids the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vocabulary = codec(ranks, pattern)
        for b in batches:
            texts = [vocabulary.decode(np.array(x or [], "i8"))[0].tobytes().decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "made"])

    own = rows.select(packed(rows, rows.columns).alias("row"), F.col(f"`{ids}`").cast("array<long>").alias("ids"))
    got = own.mapInArrow(run, T.StructType([own.schema["row"], T.StructField("made", T.StringType())]))
    return got.select("row.*", F.col("made").alias(free("decoded", rows.columns)))
