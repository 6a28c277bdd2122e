"""Token ids as flat binary files with 64-bit document offsets.

Layout below one folder:
- parts/kind=ids/part-N-*.txt     unsigned 16- or 32-bit little-endian ids, each document ended by the end id, nothing else;
- parts/kind=index/part-N-*.txt   signed 64-bit doc_ids of the part, then unsigned 64-bit offsets (one more than documents)
                                  counted in ids from the start of the part, then the 8 bytes of INDEX_END and one end id;
- bases                           Parquet: part, n_ids and base, the prefix sum of the counts of the parts before it.
Parts hold ascending, disjoint ranges of (doc_id, hash of the text), so that one hot doc_id is many parts. Texts are dealt to
their ranges once and tokenised there; the files are written by Spark's committer, so a lost executor leaves no half
file and any store works. Readers on a mounted store map them into memory. Nothing about documents reaches the
driver, and the plan does not grow with the table.

Null and empty texts hold the end id alone. Null doc_ids come first. Equal doc_ids are ordered by their
texts' hash and kept. Extra columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import glob
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import ended, tokenizer_encoder

#: Ends an index; also tells that it is whole.
INDEX_END = b"LOOMIDX2"
#: Mean bytes of text in a part, and parts at most, beyond which parts are larger: their bases are summed up in one task.
PART_BYTES, MOST_PARTS = 16 << 20, 200_000
#: Indexes of at most so many bytes are sent to every reader of the ids.
BROADCAST_BYTES = 32 << 20
_NONE = -(1 << 63)


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, dtype: str = "uint16", part_bytes: int = PART_BYTES) -> None:
    """Write the files of `docs` below `out`. dtype must hold every id."""
    kind = np.dtype(dtype).newbyteorder("<")
    end = np.array([end_id], kind).tobytes()
    assert end.isascii(), "the end id's bytes must be ASCII"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer_encoder(tokenizer, "words")
        doc_ids, sizes, seq = [], [], 0
        for b in batches:
            doc_ids.append(b.column(0).fill_null(_NONE).to_numpy().astype("<i8"))
            for ids, ends in enc.columns(b.column(1)):
                ids, ends = ended(ids, ends, end_id)
                sizes.append(np.diff(ends, prepend=0))
                value = ids[:-1].astype(kind).tobytes()  # the writer ends every value with the end id
                yield pa.RecordBatch.from_arrays([pa.array(["ids"]), pa.array([seq]), pa.array([value], pa.binary())], ["kind", "seq", "value"])
                seq += 1
        if seq:
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype("<u8")
            value = np.concatenate(doc_ids).tobytes() + offsets.tobytes() + INDEX_END
            yield pa.RecordBatch.from_arrays([pa.array(["index"]), pa.array([0]), pa.array([value], pa.binary())], ["kind", "seq", "value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 4)).first()[0] or 0
    parts = min(max(1, math.ceil(size / part_bytes)), MOST_PARTS)
    order = ["doc_id", "tie"]
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = dealt.select("doc_id", "text").mapInArrow(run, "kind string, seq long, value binary").sortWithinPartitions("kind", "seq")
    written.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", end.decode()).text(f"{out}/parts")
    if not size:
        return
    counts = _files(docs.sparkSession, out, "ids").select("part", F.floor(F.col("length") / kind.itemsize).cast("long").alias("n_ids"))
    base = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    counts.withColumn("base", base).coalesce(1).write.parquet(f"{out}/bases")


def _files(spark: SparkSession, out: str, what: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{out}/parts/kind={what}")
    return found.withColumn("part", F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("long"))


def _split_index(raw: bytes, item: int) -> tuple[np.ndarray, np.ndarray]:
    n = (len(raw) - 16 - item) // 16
    assert raw[16 * n + 8 : 16 * n + 16] == INDEX_END, "the index is not whole"
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n + 1, 8 * n)


def read(spark: SparkSession, out: str, dtype: str = "uint16") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit) of every document, from the files."""
    kind = np.dtype(dtype).newbyteorder("<")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids_raw, index_raw, base in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(ids_raw.as_buffer(), kind)
                doc_ids, offsets = _split_index(index_raw.as_py(), kind.itemsize)
                at = offsets.astype("i8")
                assert at[-1] == len(ids), "ids and index differ"
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == _NONE), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/bases")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)  # of an empty table
    index = _files(spark, out, "index")
    size = index.agg(F.sum("length")).first()[0]
    index = index.select("part", F.col("content").alias("index"))
    if size <= BROADCAST_BYTES:  # 16 bytes a document; beyond it both sides are shuffled
        index = F.broadcast(index)
    bases = spark.read.parquet(f"{out}/bases").select("part", "base")  # at most MOST_PARTS rows
    found = _files(spark, out, "ids").select("part", F.col("content").alias("ids")).join(index, "part").join(F.broadcast(bases), "part")
    return found.select("ids", "index", "base").mapInArrow(rows, schema)


class Mapped:
    """Random access to the files of a mounted folder through memory maps."""

    def __init__(self, folder: str, dtype: str = "uint16") -> None:
        def parts(what: str) -> dict[int, str]:
            return {int(re.search(r"/part-(\d+)-[^/]*$", p)[1]): p for p in glob.glob(f"{folder}/parts/kind={what}/*.txt")}

        ids, index = parts("ids"), parts("index")
        kind = np.dtype(dtype).newbyteorder("<")
        self.ids = [np.memmap(ids[p], kind, "r") for p in sorted(ids)]
        split = [_split_index(bytes(np.memmap(index[p], "u1", "r")), kind.itemsize) for p in sorted(ids)]
        self.doc_ids = [s[0] for s in split]
        self.offsets = [s[1] for s in split]
        self.bases = np.cumsum([0, *(len(i) for i in self.ids)])

    def __len__(self) -> int:
        return int(self.bases[-1])

    def document(self, part: int, i: int) -> np.ndarray:
        o = self.offsets[part]
        return self.ids[part][int(o[i]) : int(o[i + 1])]

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the whole corpus, over as many files as they span."""
        got = []
        p = int(np.searchsorted(self.bases, start, "right")) - 1
        while start < stop and p < len(self.ids):
            own = self.ids[p][start - int(self.bases[p]) : stop - int(self.bases[p])]
            got.append(own)
            start, p = start + len(own), p + 1
        return np.concatenate(got) if got else np.empty(0, "u4")
