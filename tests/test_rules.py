"""Single rules of rendering, chat data and catalogues on rows made for them."""

from pyspark.sql import functions as F

from corpusloom.operators import catalogue as K
from corpusloom.operators import chatdata as C
from corpusloom.operators import rendering as R
from corpusloom.operators import reports as P


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_rendering(spark):
    assert one(spark, R.titled(F.col("t"), F.col("b")), t="  Head ", b="text") == "Head\n\ntext"
    assert one(spark, R.titled(F.lit(None).cast("string"), F.col("b")), b="text") == "text"
    assert tuple(one(spark, R.question_link(F.col("u")), u="https://a.b.com/questions/12/x")) == ("a.b.com", "12")
    assert tuple(one(spark, R.question_link(F.col("u")), u="https://a.b.com/q/12")) == (None, None)
    assert one(spark, R.literal_as_json(F.col("m")), m="{'a': 1, 'b': None}") == '{"a": 1, "b": null}'
    assert one(spark, R.literal_as_json(F.col("m")), m='{"a": true}') == '{"a": true}'
    assert one(spark, R.literal_as_json(F.col("m")), m="f(x)") == "{}"


def test_html(spark):
    html = "<p>One &amp; &#233;&#x4e00;  two<br>three</p>\n<pre>a  b\n\n\n  c</pre><p>last<script>x  = 1</script></p>"
    assert one(spark, R.html_text(F.col("h")), h=html) == "One & é一 two\nthree\n\na  b\n\n  c\n\nlastx = 1"


def test_held_out_ids(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (None,), (3,)], "id long").write.parquet(f"file://{tmp_path}/ids")
    ids = R.held_out_ids(spark, [f"file://{tmp_path}/ids"], "id")
    rows = R.mark_held_out(spark.range(5), ids, "id")
    assert {r.id: r.held_out for r in rows.collect()} == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_source_rows_push_their_filters(spark, tmp_path):
    spark.createDataFrame([("py", "mit", 1), ("py", None, 2), (None, "mit", 3), ("c", "mit", 4)], "language string, license string, n long").write.parquet(f"file://{tmp_path}/code")
    df = R.source_rows(spark.read.parquet(f"file://{tmp_path}/code"), "language", ["py"], "license", ["mit"])
    assert [r.n for r in df.collect()] == [1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "language" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_screening_order(spark):
    talk = {1: [("user", "hi"), ("assistant", "yes")], 2: [("user", "hi"), ("assistant", "yes")], 3: [("user", " "), ("assistant", "x")], 4: [("user", "a <|end|>"), ("assistant", "x")], 5: [("assistant", "x")], 6: [("system", "s"), ("user", "u"), ("assistant", "w " * 50)], 7: [("user", "u"), ("assistant", "x"), ("user", "more"), ("assistant", "w " * 50)]}
    turns = spark.createDataFrame([(c, i, r, t) for c, own in talk.items() for i, (r, t) in enumerate(own)], "conv_id long, turn int, role string, text string")
    bench = spark.createDataFrame([(1, "x" * 80 + " none")], "item_id long, text string")
    got = {r.conv_id: (r.reason, r.fitted, r.truncated, r.split) for r in C.screen(turns, bench, 30, F.col("conv_id") == 7).collect()}
    assert got == {1: (None, 2, False, "train"), 2: ("duplicate", None, None, None), 3: ("empty", None, None, None), 4: ("special_tokens", None, None, None), 5: ("format", None, None, None), 6: ("too_long", None, None, None), 7: (None, 2, True, "val")}


def test_masked_blocks(spark):
    rows = [(i, 1 if i == 2 else 0) for i in range(4)] + [(4, 1), (5, 0), (6, 0), (7, 0)] + [(i, 2) for i in range(8, 12)] + [(12, 1), (13, 1)]
    got = {r.block: r.problem for r in C.mask_problems(spark.createDataFrame(rows, "pos long, mask int"), 4).collect()}
    assert got == {1: "no_target", 2: "mask_values", 3: "short_block"}


def test_catalogue(spark):
    assert str(one(spark, K.http_day(F.col("d")), d="Sun, 06 Nov 1994 08:49:37 GMT")) == "1994-11-06"
    assert one(spark, K.http_day(F.col("d")), d="soon") is None
    assert [one(spark, K.retry_wait(F.lit(n))) for n in (1, 2, 6, 7, 12)] == [5, 10, 160, 300, 300]
    assert [one(spark, K.is_permanent(F.lit(s))) for s in (404, 408, 429, 500, 200)] == [True, False, False, False, False]
    assert [one(spark, K.valid_repo(F.lit(r))) for r in ("a/b", "../b", "a/b/c", "a b/c", "a/..")] == [True, False, False, False, False]
    assert one(spark, K.docstrings(F.col("s")), s="x = '''a'''\n\"\"\"b\nc\"\"\" ''' '''") == ["a", "b\nc"]
    assert one(spark, K.same_code(F.col("a"), F.col("b")), a="x  \r\n\r\ny", b="x\ny\n\n") is True
    raw = "\x01abc\x02p q\x02Fix it\n\x03\n\n3\t1\tsrc/{a => b}/x.py\n-\t-\tlogo.png\n5\t0\told.py => new.py\n\x01def\x02\x02Start\x03\n"
    got = one(spark, K.parsed_log(F.col("r")), r=raw)
    assert [(c.sha, c.parents, c.message) for c in got] == [("abc", 2, "Fix it"), ("def", 0, "Start")]
    assert [tuple(c) for c in got[0].changes] == [("src/b/x.py", 3, 1), ("logo.png", None, None), ("new.py", 5, 0)]


def test_cadence():
    assert [P.aligned_every(*x) for x in ((100, 30, 10), (97, 10, 40), (1000, 250, 40), (12, 3, 100))] == [25, 97, 250, 3]


def test_normalised_for_language_id(spark):
    from corpusloom.operators.records import normalised_for_lid

    assert one(spark, normalised_for_lid(F.col("t")), t="ﬁne ² ½ 　ｗide\né") == "fine 2 1⁄2 wide é"
    assert one(spark, normalised_for_lid(F.lit(None).cast("string"))) is None
    assert len(one(spark, normalised_for_lid(F.col("t")), t="ab" * 1500)) == 2000
