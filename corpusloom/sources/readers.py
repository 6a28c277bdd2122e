"""Readers of document sources: Parquet with positions, JSON lines, HTTP ranges, question-and-answer XML, file lists."""

from __future__ import annotations

import fnmatch
import json
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def parquet_rows(spark: SparkSession, path: str | list[str], columns: Sequence[str], after: tuple[str, int] | None = None) -> DataFrame:
    """The columns that exist, with file and row of each; only rows after a (file, row) position."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    rows = df.select(*[c for c in columns if c in df.columns], F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if after:
        rows = rows.where((F.col("file") > after[0]) | ((F.col("file") == after[0]) & (F.col("row") > after[1])))
    return rows


def json_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """JSON lines, gzipped or not; blank lines are skipped. Strict raises on a bad line, otherwise it is dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    rows = lines.select(row.alias("r"), "value")
    if not strict:
        rows = rows.where(F.expr("try_parse_json(value)").isNotNull())
    return rows.select("r.*")


class HttpLines(DataSource):
    """JSON lines over HTTP, cut into byte ranges that readers align to line ends; columns at (byte of the line) and value.

    Options: url, stripes, start (the byte after the last line that was read before) and size (what the file must have). A line
    that ends before the file's size without a line end was cut off on its way: that is an error, so the task is tried again and
    no line is skipped.
    """

    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def schema(self) -> str:
        return "at bigint, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HttpReader(self.options)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int, size: int, aligned: bool) -> None:
        self.start, self.stop, self.size, self.aligned = start, stop, size, aligned


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.stripes, self.start = options["url"], int(options.get("stripes", 4)), int(options.get("start", 0))
        self.pinned = int(options["size"]) if "size" in options else None

    def partitions(self) -> list[InputPartition]:
        with urllib.request.urlopen(urllib.request.Request(self.url, method="HEAD")) as r:
            size = int(r.headers["Content-Length"])
        if self.pinned is not None and size != self.pinned:
            raise ValueError(f"{self.url} has {size} bytes instead of {self.pinned}")
        left = max(0, size - self.start)
        cuts = [self.start + left * i // self.stripes for i in range(self.stripes + 1)]
        return [_Range(a, b, size, a == self.start) for a, b in zip(cuts, cuts[1:]) if a < b] or [_Range(0, 0, size, True)]

    def read(self, part: _Range) -> Iterator[tuple[int, str]]:
        """Lines that start within the range; the line that the range begins in belongs to the one before."""
        if part.start >= part.stop:
            return
        first = part.start if part.aligned else part.start - 1
        with urllib.request.urlopen(urllib.request.Request(self.url, headers={"Range": f"bytes={first}-"})) as r:
            at = first
            if not part.aligned:
                at += len(r.readline())
            while at < part.stop:
                line = r.readline()
                if not line.endswith(b"\n") and at + len(line) < part.size:
                    raise OSError(f"{self.url} was cut off at byte {at + len(line)} of {part.size}")
                if not line:
                    break
                if line.strip():
                    yield at, line.decode("utf-8").rstrip("\r\n")
                at += len(line)


def http_lines(spark: SparkSession, url: str, stripes: int = 4, start: int = 0, size: int | None = None) -> DataFrame:
    spark.dataSource.register(HttpLines)
    reader = spark.read.format("http_lines").option("url", url).option("stripes", str(stripes)).option("start", str(start))
    return (reader if size is None else reader.option("size", str(size))).load()


def striped_order(rows: DataFrame, at: str, size: int, stripes: int) -> DataFrame:
    """place: rows taken from equal byte stripes in turn."""
    stripe = F.floor(F.col(at) * stripes / size)
    ranked = rows.withColumn("stripe", stripe).withColumn("_n", F.row_number().over(Window.partitionBy("stripe").orderBy(at)))
    return ranked.withColumn("place", F.struct("_n", "stripe")).drop("_n")


def posts_xml(spark: SparkSession, path: str, cutoff: str | None = None) -> DataFrame:
    """question_id, score, text of questions with their answers: accepted first, then by score and id.

    Rows dated after the cutoff (YYYY-MM-DD) raise.
    """
    schema = "_Id long, _PostTypeId int, _ParentId long, _AcceptedAnswerId long, _Score long, _Title string, _Body string, _CreationDate string"
    posts = spark.read.format("xml").option("rowTag", "row").schema(schema).load(path)
    if cutoff:
        late = F.substring("_CreationDate", 1, 10) > cutoff
        posts = posts.withColumn("_Id", F.when(late, F.raise_error(F.concat(F.lit("a post after the cutoff: "), "_CreationDate"))).otherwise(F.col("_Id")))
    asked = posts.where("_PostTypeId = 1").select(F.col("_Id").alias("question_id"), F.col("_AcceptedAnswerId").alias("accepted"), F.col("_Score").alias("score"), "_Title", "_Body")
    answer = posts.where("_PostTypeId = 2").select(F.col("_ParentId").alias("question_id"), F.col("_Id").alias("id"), F.col("_Score").alias("points"), F.col("_Body").alias("body"))
    both = asked.join(answer, "question_id", "left")
    key = F.struct((~F.coalesce(F.col("id") == F.col("accepted"), F.lit(False))).alias("late"), (-F.col("points")).alias("p"), "id", "body")
    grouped = both.groupBy("question_id", "score", "_Title", "_Body").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), key))).alias("a"))
    parts = F.concat(F.array("_Title", "_Body"), F.transform("a", lambda x: x["body"]))
    return grouped.select("question_id", "score", F.array_join(F.filter(parts, lambda p: p.isNotNull() & (F.trim(p) != "")), "\n\n").alias("text"))


def list_files(names: Sequence[str], patterns: Sequence[str], newest_dirs_first: bool = False, start: int = 0, stop: int | None = None) -> list[str]:
    """Files that match the patterns, in the patterns' order, without repeats; directories newest first if asked for."""
    out: dict[str, None] = {}
    for p in patterns:
        found = sorted(n for n in names if fnmatch.fnmatchcase(n, p))
        if newest_dirs_first:
            found.sort(key=lambda n: n.rsplit("/", 1)[0] if "/" in n else "", reverse=True)
        out.update(dict.fromkeys(found))
    return list(out)[start:stop]


def source_identity(files: Sequence[str], revision: str, skip_rows: int = 0) -> str:
    """A digest that changes when the files, the revision or the start do."""
    import hashlib

    return hashlib.sha256(json.dumps([list(files), revision, skip_rows]).encode()).hexdigest()


def open_source(spark: SparkSession, kind: str, at: str, **options) -> DataFrame:
    """The rows of a source by its kind: parquet, json_lines, http_lines or posts_xml, with that reader's options."""
    readers = {"parquet": parquet_rows, "json_lines": json_lines, "http_lines": http_lines, "posts_xml": posts_xml}
    if kind not in readers:
        raise ValueError(f"no reader of kind {kind!r}; there are {', '.join(readers)}")
    return readers[kind](spark, at, **options)
