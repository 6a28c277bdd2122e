import gzip
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers as R
from corpusloom.sources import writers as W


def test_parquet_rows_resume(spark, tmp_path):
    spark.range(100).withColumn("text", F.col("id").cast("string")).coalesce(1).write.parquet(f"file://{tmp_path}/p")
    rows = R.parquet_rows(spark, f"file://{tmp_path}/p", ["id", "absent"]).collect()
    assert len(rows) == 100 and set(rows[0].asDict()) == {"id", "file", "row"}
    rest = R.parquet_rows(spark, f"file://{tmp_path}/p", ["id"], (rows[0].file, 39)).collect()
    assert sorted(r.id for r in rest) == list(range(40, 100))


def test_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n\n{"a": 2}\n{"a": ')
    got = R.json_lines(spark, f"file://{tmp_path}/a.jsonl.gz", "a int", strict=False).collect()
    assert [r.a for r in got] == [1, 2]
    try:
        R.json_lines(spark, f"file://{tmp_path}/a.jsonl.gz", "a int").collect()
        raise SystemExit("a bad line must raise")
    except Exception as e:
        assert "a bad line" not in str(e)


def test_http_lines(spark):
    lines = [json.dumps({"i": i, "pad": "x" * (i % 37)}) for i in range(200)]
    data = ("\n".join(lines) + "\n").encode()

    served = [None]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):
            start = int(self.headers.get("Range", "bytes=0-")[6:].split("-")[0])
            self.send_response(206)
            self.end_headers()
            self.wfile.write(data[start : served[0]])

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = R.http_lines(spark, f"http://127.0.0.1:{server.server_port}/x", 7)
        assert [r.value for r in rows.orderBy("at").collect()] == lines
        first = [r.value for r in R.striped_order(rows, "at", len(data), 4).orderBy("place").limit(4).collect()]
        assert first[0] == lines[0] and len(set(first)) == 4
        url, seen = f"http://127.0.0.1:{server.server_port}/x", len("\n".join(lines[:80])) + 1
        rest = R.open_source(spark, "http_lines", url, stripes=3, start=seen, size=len(data)).orderBy("at").collect()
        assert [r.value for r in rest] == lines[80:] and rest[0]["at"] == seen
        assert R.http_lines(spark, url, 3, len(data)).collect() == []
        with pytest.raises(Exception, match="instead of"):
            R.http_lines(spark, url, 3, size=len(data) + 1).collect()
        served[0] = len(data) - 3  # the connection ends within the last line
        with pytest.raises(Exception, match="cut off"):
            R.http_lines(spark, url, 3).collect()
    finally:
        server.shutdown()


def test_posts_xml(spark, tmp_path):
    (tmp_path / "posts.xml").write_text(
        '<posts><row Id="1" PostTypeId="1" AcceptedAnswerId="4" Score="5" Title="T" Body="Q" CreationDate="2020-01-01T00:00:00"/>'
        '<row Id="2" PostTypeId="2" ParentId="1" Score="9" Body="high" CreationDate="2020-01-02"/>'
        '<row Id="3" PostTypeId="2" ParentId="1" Score="9" Body="later" CreationDate="2020-01-02"/>'
        '<row Id="4" PostTypeId="2" ParentId="1" Score="1" Body="accepted" CreationDate="2020-01-02"/>'
        '<row Id="5" PostTypeId="1" Score="0" Title="Alone" Body="" CreationDate="2020-01-02"/></posts>'
    )
    got = {r.question_id: r.text for r in R.posts_xml(spark, f"file://{tmp_path}/posts.xml").collect()}
    assert got == {1: "T\n\nQ\n\naccepted\n\nhigh\n\nlater", 5: "Alone"}


def test_file_lists_and_identity():
    names = ["a/2.txt", "b/1.txt", "a/1.txt", "c/x.md"]
    assert R.list_files(names, ["*.md", "*"]) == ["c/x.md", "a/1.txt", "a/2.txt", "b/1.txt"]
    assert R.list_files(names, ["*.txt"], newest_dirs_first=True, stop=2) == ["b/1.txt", "a/1.txt"]
    assert R.source_identity(["a"], "r") != R.source_identity(["a"], "r", 1)


def test_sources_by_kind(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/p")
    assert R.open_source(spark, "parquet", f"file://{tmp_path}/p", columns=["id"]).count() == 3
    with pytest.raises(ValueError, match="no reader"):
        R.open_source(spark, "tar", "x")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([({"_x": "1", "url": "u"},)], "meta map<string,string>")
    assert df.select(W.provenance(F.col("meta"))).first()[0] == '{"url":"u"}'
    rows = spark.range(10).selectExpr("id", "id % 2 AS split", "id AS shard", "id AS start")
    W.shard_table(rows, f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == 10
    got = W.missing_files(spark.range(3), spark.range(1, 5), "id").collect()
    assert sorted((r.id, r.side) for r in got) == [(0, "missing"), (3, "extra"), (4, "extra")]
