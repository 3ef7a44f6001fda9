"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks; DataFrame functions only.

An item of n words is compared with windows of n words of a document.  Words are lower-case runs of letters and digits;
a text's features are its five-word shingles, weighted by how often they occur in the window.

1. Shingles of documents are joined to those of the benchmark (a broadcast while Spark's size limit allows it, a sort-merge join
   beyond).  A window of similarity s shares at least s of the item's shingles (2s/(1+s) if it is of the item's size, but the
   document's end may cut it short), so pairs of document and item with fewer shared places are out without loss, and so
   are windows; a best window starts at a shared shingle.
2. Windows of equal content are one.  Each gets a 64-bit SimHash, which is cut in 32 blocks of two bits: fingerprints within
   31 bits agree in a block, so the join on (item, block, bits) finds all items within the radius.  A similar window differs
   by 10 bits on average; the worst case is four of an item's five shingles (12 bits), where less than one in a million is
   beyond 31.
3. Those within the radius are verified by the exact similarity: sum of the smaller weights over sum of the larger.

A document is contaminated by an item if some item-sized window is within the radius and has the similarity.  Long windows may
end with the document.  Items of fewer than five words have no shingle and match nothing; null texts likewise.  Null ids are
kept as ids of their own text.  Rows that repeat are found once.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, BLOCKS = 5, 32
BLOCK_BITS = 64 // BLOCKS
RADIUS = BLOCKS - 1


def let(value, body):
    """body of a value that is computed once, also where body uses it in each step of a loop over an array."""
    return F.transform(F.array(value), body)[0]


def words(text):
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return let(plain, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " ")))


def shingles(w):
    """Hashes of all runs of five words; an empty array for fewer words."""

    def runs(x):
        places = F.when(F.size(x) >= SHINGLE, F.sequence(F.lit(1), F.size(x) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(x, i, SHINGLE)))

    return let(w, runs)


def simhash(features):
    """Bit b is set if over half of the hashes have it."""
    n = F.size(features)

    def bit(b):
        ones = F.aggregate(features, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int"))
        return F.when(ones * 2 > n, F.expr("1L")).otherwise(F.expr("0L"))

    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.struct(b.alias("b"), bit(b).alias("v")))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", x["v"], x["b"])))


def similarity(a, b):
    """Weighted Jaccard similarity of two bags of hashes."""
    both = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return both / (F.size(a) + F.size(b) - both)


def _contaminated(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """doc_id, t (hash of the text), item_id and best (similarity, minus the start) of every contaminated text and item."""
    share = least - 1e-9
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("w")).select("item_id", shingles(F.col("w")).alias("item"))
    items = items.where(F.size("item") > 0).withColumns({"m": F.size("item"), "c": F.xxhash64("item")})
    keys = items.select("item_id", "c", "m", F.explode(F.array_distinct("item")).alias("h"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    texts = texts.withColumn("t", F.xxhash64("text"))
    found = texts.select("doc_id", "t", F.posexplode(shingles(words(F.col("text")))).alias("p", "h")).join(keys, "h")
    need = F.ceil(F.col("m") * share).cast("int")
    hits = found.groupBy("doc_id", "t", "item_id", "c", "m").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("p")).alias("at")).where(F.size("at") >= need)
    at = F.col("at")
    dense = F.filter(F.sequence(F.lit(1), F.size(at) - need + 1), lambda i: F.element_at(at, i + need - 1) < F.element_at(at, i) + F.col("m"))
    starts = hits.select("doc_id", "t", "c", "m", F.explode(F.transform(dense, lambda i: F.element_at(at, i))).alias("s")).distinct()
    wanted = starts.groupBy("doc_id", "t").agg(F.collect_list(F.struct("c", "m", "s")).alias("windows"))
    wanted = wanted.select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), "windows")
    again = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t"))).select("doc_id", "t", shingles(words(F.col("text"))).alias("f"), "windows")
    windows = again.select("doc_id", "t", F.inline(F.transform("windows", lambda x: F.struct(x["c"].alias("c"), x["m"].alias("m"), x["s"].alias("s"), F.slice("f", x["s"] + 1, x["m"]).alias("window")))))
    windows = windows.select("doc_id", "t", "c", "m", "s", "window", F.xxhash64("window").alias("k1"), F.xxhash64(F.lit("second"), "window").alias("k2"))
    contents = windows.groupBy("c", "m", "k1", "k2").agg(F.any_value("window").alias("window")).withColumn("print", simhash(F.col("window")))

    def blocks(df):
        block = [F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("print", BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).alias("bits")) for b in range(BLOCKS)]
        return df.select("*", F.inline(F.array(*block)))

    left = blocks(contents)
    right = blocks(items.withColumn("print", simhash(F.col("item"))).withColumnRenamed("print", "item_print").withColumn("print", F.col("item_print")).select("item_id", "c", "item", "item_print", "print")).drop("print")
    near = left.join(right, ["c", "block", "bits"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    near = near.groupBy("c", "m", "k1", "k2", "item_id").agg(F.any_value("window").alias("window"), F.any_value("item").alias("item"))
    verified = near.select("c", "m", "k1", "k2", "item_id", similarity(F.col("window"), F.col("item")).alias("similarity")).where(F.col("similarity") >= least - 1e-12)
    best = F.struct(F.col("similarity"), -F.col("s"))
    return windows.drop("window").join(verified, ["c", "m", "k1", "k2"]).groupBy("doc_id", "t", "item_id").agg(F.max(best).alias("best"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, start_word, similarity: the best window of every contaminated document and item."""
    out = _contaminated(docs, benchmark, least).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return out.select("doc_id", "item_id", (-F.col("best.col2")).cast("long").alias("start_word"), F.round(F.col("best.similarity"), 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """docs without contaminated documents; those of one id, or of none, are told apart by their texts."""
    bad = _contaminated(docs, benchmark, least).select(F.col("doc_id").alias("__ow_bad"), F.col("t").alias("__ow_t")).distinct()
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("__ow_bad")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__ow_t"))
    return docs.join(bad, here, "left_anti")
