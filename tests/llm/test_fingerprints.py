import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints as fp


def test_next_text_and_edited_text(docs):
    got = {(r.doc_id, r.n_chars): r for r in fp.compare_with_edited(docs).collect()}
    rows = docs.collect()
    assert len(fp.compare_with_edited(docs).collect()) == len(rows)
    order = sorted({(r.doc_id if r.doc_id is not None else -(10**9), r.text or "") for r in rows}, reverse=True)
    rep = [x for x in order for _ in range(2 if x[0] == 7 else 1)]
    for i, (doc_id, text) in enumerate(rep):
        nxt = rep[(i + 1) % len(rep)][1]
        half = len(text) // 2
        want = text[: len(text) - half] + nxt[:half]
        key = (None if doc_id == -(10**9) else doc_id, len(text))
        if doc_id != 7:
            assert got[key].edited_sha256 == hashlib.sha256(want.encode()).hexdigest(), key


def hashed(parts):
    """Spark's xxhash64 of some strings or longs, which chains its seed."""
    seed = 42
    for x in parts:
        raw = x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_sketch(text):
    words = [hashed([w]) for w in re.split("[ \t-\r]+", text.lower()) if w]
    runs = [hashed(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [hashed([" ".join(map(str, words))])] if words else []
    return sorted(set(runs))[:128]


def plain_likeness(a, b):
    least = sorted(set(a) | set(b))[:128]
    return 1.0 if not a and not b else len(set(least) & set(a) & set(b)) / max(1, len(least))


def encoded(sketch):
    return "".join(f"{h & (1 << 64) - 1:016X}" for h in sketch)


def test_equals_plain_sketches(spark):
    """Every column of every document, made again outside Spark; ids repeat, with equal and unlike texts."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id // 2 * 2 if r.doc_id < 40 else r.doc_id, r.text) for r in table] + [(7, "one two"), (7, "one two"), (None, "x y z a b c"), (9_000, None)]
    got = fp.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # null ids come last, and rows of one id by their text's hash
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed([r[1] or ""])))
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        a, b, c = map(plain_sketch, (text, edit, after))
        want.append((doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), encoded(a), encoded(b), plain_likeness(a, b), plain_likeness(a, c)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:7]) for r in got)


def test_estimates(spark, docs):
    r = {x.doc_id: x for x in fp.compare_with_edited(docs).collect()}
    assert r[10].fingerprint == r[5].fingerprint != ""
    assert r[8].fingerprint == r[9].fingerprint == "" and r[9].near_next == 1.0
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in r.values())
    a, b = [f"w{i}" for i in range(4000)], [f"w{i}" for i in range(1000, 5000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    df = df.select(fp.word_hashes(F.col("a")).alias("a"), fp.word_hashes(F.col("b")).alias("b")).select(fp.sketch_of(F.col("a"), 512).alias("a"), fp.sketch_of(F.col("b"), 512).alias("b"))
    j, c, n = df.select(fp.resemblance(F.col("a"), F.col("b"), 512), fp.containment(F.col("a"), F.col("b"), 512), fp.distinct_shingles(F.col("a"), 512)).first()
    assert abs(j - 0.6) < 0.1 and abs(c - 0.75) < 0.1 and abs(n / 4000 - 1) < 0.2


def test_merge_equals_sketch_of_the_union(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[i : i + 504]) for i in range(0, 2496, 500)]
    parts = spark.createDataFrame([(1, t) for t in texts], "k int, text string").select("k", fp.word_hashes(F.col("text")).alias("h")).select("k", fp.sketch_of(F.col("h")).alias("s"))
    whole = spark.createDataFrame([(" ".join(words[: 5 * 500 + 4]),)], "text string").select(fp.word_hashes(F.col("text")).alias("h")).select(fp.sketch_of(F.col("h")).alias("s"))
    assert fp.merge(parts, "k", "s").first()["s"] == whole.first()["s"]


def test_empty_table(no_docs):
    assert fp.compare_with_edited(no_docs).collect() == []
