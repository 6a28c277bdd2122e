"""Bottom-k sketches of word shingles: fingerprints that merge and estimate resemblance, containment and size.

A text's shingles are runs of `width` lower-cased words, cut at white space; a text with fewer words is one shingle,
a text without words has none. Shingles are hashed to 64 bits and the k smallest distinct hashes, in ascending
order, are the sketch. Sketches of fewer than k hashes are the whole set, and estimates from them are exact.
All functions here are DataFrame expressions that stay in the JVM.

Null texts count as empty. Equal texts have equal fingerprints. Rows with equal doc_id are kept and ordered by their
text's hash. Null doc_ids come last. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounds, bucket, shuffle_parts

K = 128
WIDTH = 5


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words of a text."""
    return F.transform(F.filter(F.split(F.lower(text), "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text from its word hashes. Give a materialised column: it is used many times."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))
    whole = F.when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", hashes.cast("array<string>"))))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(F.when(n >= width, runs).otherwise(whole))), 1, k)


def merge_two(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets of shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge(sketches: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """key, sketch: the sketch of all parts of each key.

    The k smallest hashes of a key are cut within each task before the shuffle, so that a hot key costs k rows a task.
    """
    hashes = sketches.select(key, F.explode(sketch).alias("h")).distinct()
    least = hashes.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("nth") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles."""
    spread = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / spread)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated Jaccard likeness of two sets of shingles, 0 to 1; 1 where both are empty."""
    least = merge_two(a, b, k)
    both = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(least), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the first set that lies in the second, 0 to 1; 1 where the first is empty."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def encoded(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (doc_id, text) with the row that follows in descending doc_id; after the last comes the first.

    Rows are dealt by ranges of doc_id, one to a partition; the first row of each range is copied to the range before
    it, so no task needs more than its own range. Columns: doc_id, text, hashes, next_text, next_hashes.
    """
    cuts = bounds(docs, "doc_id", buckets)
    ranged = docs.withColumn("range", bucket(F.col("doc_id"), cuts))
    tops = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    held = sorted(tops)
    # the row that ends range r is followed by the first row of the next lower range that holds rows
    above = {r: held[(i + 1) % len(held)] for i, r in enumerate(held)}
    n = len(cuts) + 1
    top = F.element_at(F.array(*[F.lit(tops.get(r)).cast("long") for r in range(n)]), F.col("range") + 1)
    also = F.element_at(F.array(*[F.lit(above.get(r, 0)) for r in range(n)]), F.col("range") + 1)
    own = F.struct(F.col("range").alias("r"), F.lit(False).alias("copy"))
    places = F.when(F.col("doc_id").eqNullSafe(top), F.array(own, F.struct(also.alias("r"), F.lit(True).alias("copy")))).otherwise(F.array(own))
    label = F.element_at(F.array(*map(F.lit, apart(docs.sparkSession, n))), F.col("place.r") + 1)
    dealt = ranged.withColumn("place", F.explode(places)).select("doc_id", "text", label.alias("range"), F.col("place.copy").alias("copy"))
    dealt = dealt.repartition(n, "range").withColumn("hashes", word_hashes(F.col("text")))
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    for c in ("text", "hashes"):
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.where(~F.col("copy"))


def apart(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a shuffle by hash deals to n different partitions."""
    found: dict[int, int] = {}
    size = 20 * n + 100
    while len(found) < n:
        own = spark.range(size).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
        found = {r["p"]: r["id"] for r in own.collect()}
        size *= 4
    return [found[p] for p in range(n)]


def edited(text: Column, other: Column) -> Column:
    """text with its last half replaced by the first as many code points of the other."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def compare_with_edited(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(rows, 2 * shuffle_parts(spark))
    near = near.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_hashes", word_hashes(F.col("edited")))
    near = near.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        sketch_of(F.col("hashes"), k, width).alias("a"),
        sketch_of(F.col("edited_hashes"), k, width).alias("b"),
        sketch_of(F.col("next_hashes"), k, width).alias("c"),
    )
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        encoded(F.col("a")).alias("fingerprint"),
        encoded(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("c"), k).alias("near_next"),
        distinct_shingles(F.col("a"), k).alias("shingles_estimate"),
    )
