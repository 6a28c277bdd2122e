import html as H
import re

import numpy as np

from corpusloom.llm import htmlcrf
from corpusloom.llm.htmlblocks import blocks


def test_pages_of_the_table(spark):
    """Against the article element cut out by patterns, which these pages all have."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        cut = [" ".join(H.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want[r.page_id] = "\n".join(x for x in cut if x)
    got = {r.page_id: r for r in htmlcrf.extract(pages).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_held_out_layouts():
    field = htmlcrf.default_field()
    wrong = total = 0
    for html, main in htmlcrf.labelled_pages(200, 5_000):
        page = blocks(html)
        wrong += sum((b.text in main) != bool(y) for b, y in zip(page, field.decode(page)))
        total += len(page)
    assert wrong <= 0.01 * total


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(0)
    page = blocks("".join(f"<p>{'word ' * i}{'.' * (i % 2)}</p><li><a>x{i}</a></li>" for i in range(1, 5)))
    for _ in range(20):
        names = {f: i for i, f in enumerate(sorted({f for b in page for f in htmlcrf.features(b)}))}
        field = htmlcrf.Field(names, rng.normal(size=(len(names), 2)), rng.normal(size=(2, 2)) * 3)
        emit = field.scores(page)

        def score(bits):
            labels = [bits >> i & 1 for i in range(len(page))]
            return sum(e[y] for e, y in zip(emit, labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))

        best = max(range(1 << len(page)), key=score)
        assert field.decode(page) == [best >> i & 1 for i in range(len(page))]


def test_odd_pages(spark):
    html = [
        None,
        "",
        "plain words only",
        "<article><p>One &amp; two&nbsp; three &#233;&lt;b&gt;<p>Two <i>in</i>line<br>break</article><div class=comments><p>I liked it.</p></div>",
        "<nav><ul><li><a>Home</a></li></ul></nav>",
        "<article><p>" + "long text. " * 200_000 + "</p>",
        "<article><p>kept &am",
    ]
    df = spark.createDataFrame([(i, None, h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in htmlcrf.extract(df).collect()}
    assert got[0] == got[1] == got[4] == ""
    assert got[3] == "One & two three é<b>\nTwo inline break"
    assert len(got[5]) == len("long text. ") * 200_000 - 1
    assert got[6] == "kept &am"
    assert htmlcrf.extract(df.limit(0)).collect() == []
