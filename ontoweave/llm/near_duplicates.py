"""SimHash near-dedup of documents by verified similarity: the pipeline's form of the SimHash operator.

Words are runs of other than ASCII white space, in lower case (ASCII); a text's set is that of its five-word shingles, and of the
whole text if it has one to four words.  Two texts are linked if the sets' Jaccard similarity is at least 0.8 (texts of equal
words always), and classes are the connected components.

1. Texts of equal words are one content.  The byte-position index of ``simhash`` links contents whose fingerprints (of five-word
   shingles) are within its radius; each link is verified on the whole sets.
2. Sets of similarity 0.8 have fingerprints that differ in about ten bits of 64, so they need not share any byte: no count of shared bytes
   guarantees them.  An inverted index of shingles with count filtering finds the links that the fingerprints miss, all of them.
   Of a set of n shingles only the least n - ceil(0.8 n) + l(n) hashes are indexed, with l(n) = max(1, n // 10): the common part of two
   similar sets has at least 0.8 of either, so its least l hashes are in both selections.  The smaller of two similar sets has at
   least ceil(0.8 n), so each set shares q = l(ceil(0.8 n)) selected hashes or has no similar one.  Hashes of one content only
   are dropped, then contents with fewer than q others.  Of c shared hashes the c - q + 1 rarest are kept: under the one order by
   frequency and hash, similar sets still meet in one.
3. In each posting list all contents are compared with the least one, so a large group of copies is not compared pair by pair.
4. Contents of lists that still hold several components are indexed once more by whole sets: of n shingles the n - ceil(0.8 n) + 1 rarest,
   in which two similar sets must meet.  A passage that many unlike texts share is not rare in any text that has a fifth of its own, so
   it makes no list there.  Pairs of different components in these lists are compared.

Comparisons are of whole sets of 64-bit shingle hashes.  Rows without an id cannot be named as the kept one, so all of them stay.  Rows
of one id and one text are one document; texts of one id that differ are compared like others.  The kept document of a class has the
smallest id.  Null and empty texts are one content.  Other columns are untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, forget, run_hashes, steps, utf8, word_hashes, word_spans, written
from .simhash import components
from .simhash import links as fingerprint_links

SHINGLE = 5
#: Members of a list that the others are compared with in one round.
CENTRES = 24
#: Rounds end where not one comparison in so many makes a link.
FEW = 20


def needed(n):
    """ceil(0.8 n), of an int or an integer column."""
    return n - n // 5 if isinstance(n, int) else n - F.floor(n / 5)


def _sets(data: np.ndarray, offsets: np.ndarray):
    """(content hash, sorted distinct shingle hashes) of each row."""
    first, starts, ends = word_spans(data, offsets)
    w = word_hashes(data, starts, ends)
    runs = run_hashes(w, SHINGLE)
    for a, z in zip(first.tolist(), first[1:].tolist(), strict=False):
        words = w[a:z]
        content = int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")
        if z - a >= SHINGLE:
            yield content, np.unique(runs[a : z - SHINGLE + 1])
        else:
            yield content, run_hashes(words, z - a) if z > a else words


def _fingerprint(hashes: np.ndarray) -> int:
    """64 bits: bit k is set if over half of the hashes have it."""
    ones = sum(np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(hashes), 8192))
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def _hashed(whole: bool):
    def run(batches):
        forget()
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            for i, j in steps(offsets):
                part = slice(offsets[i], offsets[j])
                contents, sizes, sets, prints = [], [], [], []
                for content, s in _sets(LOWER[data[part]], offsets[i : j + 1] - offsets[i]):
                    n = len(s)
                    contents.append(content)
                    sizes.append(n)
                    prints.append(_fingerprint(s))
                    sets.append(s if whole else s[: n - needed(n) + max(1, n // 10)])
                ends = np.cumsum([0, *map(len, sets)])
                hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).astype(np.uint64).view(np.int64)))
                content = pa.array(np.array(contents, np.uint64).view(np.int64))
                bits = pa.array(np.array(prints, np.uint64).view(np.int64))
                columns = [batch.column("doc_id").slice(i, j - i), batch.column("t").slice(i, j - i), content, bits, pa.array(sizes, pa.int32()), hashes]
                yield pa.record_batch(columns, ["doc_id", "t", "k", "bits", "n", "hashes"])

    return run


_SCHEMA = "doc_id long, t long, k long, bits long, n int, hashes array<long>"


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v of contents whose sets are similar."""
    a, b = sets.select(F.col("k").alias("u"), F.col("hashes").alias("a")), sets.select(F.col("k").alias("v"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    sized = pairs.join(a, "u").join(b, "v").select("u", "v", both.alias("both"), (F.size("a") + F.size("b")).alias("n"))
    return sized.where("both * 5 >= (n - both) * 4").select("u", "v")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), owner_id, owner_t of documents with an id: the class's document of the smallest id."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("t", F.xxhash64("text"))
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = written(named.mapInArrow(_hashed(False), _SCHEMA), "contents")
    distinct = prints.dropDuplicates(["k"])
    # fingerprints within the radius, and contents of one fingerprint with the least of them
    of_bits = written(distinct.groupBy("bits").agg(F.min("k").alias("least"), F.max("k").alias("most")), "print-contents")
    edges = fingerprint_links(of_bits.select("bits"), n_parts)
    near = edges.join(of_bits.select(F.col("bits").alias("u"), F.col("least").alias("a")), "u").join(of_bits.select(F.col("bits").alias("v"), F.col("least").alias("b")), "v").select("a", "b")
    same = distinct.join(of_bits.where("least < most").select("bits", "least"), "bits").where("k <> least").select(F.col("least").alias("a"), F.col("k").alias("b"))
    near = near.union(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    # the inverted index of shingles
    rows = distinct.select("k", "n", F.explode("hashes").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(common, "h").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared"))
    q = F.greatest(F.lit(1), F.floor(needed(F.col("n")) / 10)).cast("int")
    rare = F.slice("shared", F.lit(1), F.size("shared") - q + 1)
    lists = shared.where(F.size("shared") >= q).select("k", "n", F.inline(rare)).select("h", "k", "n")
    lists = written(lists, "posting-lists")
    centres = written(lists.groupBy("h").agg(F.min(F.struct("k", "n")).alias("c"), F.max("k").alias("most")).where("c.k < most").select("h", "c"), "centres")
    met = lists.join(centres, "h")
    close = lambda n, m: (F.least(n, m) * 5 >= F.greatest(n, m) * 4)
    stars = met.where(F.col("k") != F.col("c.k")).where(close(F.col("n"), F.col("c.n"))).select(F.col("c.k").alias("u"), F.col("k").alias("v"))
    pairs = written(near.union(stars).distinct(), "star-pairs")
    nodes = met.select("k").union(pairs.select("u")).union(pairs.select("v")).distinct()
    nodes = nodes.join(prints.groupBy("k").agg(F.min(F.struct("doc_id", "t")).alias("at")), "k")
    nodes = written(nodes.select("at.doc_id", "at.t"), "compared")
    sets = written(named.join(nodes, ["doc_id", "t"]).mapInArrow(_hashed(True), _SCHEMA).dropDuplicates(["k"]).select("k", "n", "hashes"), "sets")
    links = written(_linked(pairs, sets), "star-links")
    roots = written(components(links, "star-components").withColumnRenamed("node", "k"), "star-roots")

    def several(of: DataFrame, name: str) -> DataFrame:
        """Rows of lists that hold several components, with root."""
        parted = written(of.join(roots, "k", "left").select(*of.columns, F.coalesce("root", "k").alias("root")), name)
        mixed = written(parted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h"), name)
        return parted.join(mixed, "h")

    left = several(lists, "parted-lists").select("k").distinct()
    whole = sets.join(left, "k").select("k", "n", F.explode("hashes").alias("h"))
    df = whole.groupBy("h").agg(F.count("*").alias("df"))
    ordered = whole.join(df, "h").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("all"))
    # most: the largest partner whose set can still be similar if the token at this place is the first that both have
    placed = F.transform(F.slice("all", F.lit(1), (F.col("n") - needed(F.col("n")) + 1).cast("int")), lambda x, i: F.struct(x["df"].alias("df"), x["h"].alias("h"), F.floor((F.col("n") - i) * 9 / 4 - F.col("n")).alias("most")))
    rarest = F.filter(placed, lambda x: (x["df"] > 1) & (x["most"] >= needed(F.col("n"))))
    rare = written(ordered.select("k", "n", F.inline(rarest)).select("h", "k", "n", "most"), "rare-lists")
    smallest = written(rare.groupBy("h").agg(F.min("n").alias("smallest")), "rare-sizes")
    rare = written(rare.join(smallest, "h").where("most >= smallest"), "rare-kept")
    turn = 0
    while True:  # stars around members of each list, other ones in each round, until they link little; what is left is compared
        rest = written(several(rare, "rare-parted"), "mixed-lists")
        pick = lambda seed: F.min_by(F.struct("k", "n", "most", "root"), F.xxhash64("h", "k", F.lit(seed)))
        centres = written(rest.groupBy("h").agg(F.array_distinct(F.array(*(pick(CENTRES * turn + i) for i in range(CENTRES)))).alias("c")).select("h", F.explode("c").alias("c")), "rare-centres")
        met = rest.join(centres, "h").where("root <> c.root and n <= c.most and c.n <= most").where(close(F.col("n"), F.col("c.n")))
        stars = written(met.select(F.least("k", "c.k").alias("u"), F.greatest("k", "c.k").alias("v")).distinct(), "rare-stars")
        more = written(_linked(stars, sets), "rare-links")
        if more.count() * FEW <= stars.count():
            links = links.union(more)
            break
        turn, links = turn + 1, written(links.union(more), "more-links")
        roots = written(components(links, "rare-components").withColumnRenamed("node", "k"), "rare-roots")
    other = rest.select("h", F.col("k").alias("v"), F.col("n").alias("m"), F.col("most").alias("most_v"), F.col("root").alias("other"))
    pairs = rest.withColumnRenamed("k", "u").join(other, "h").where("root < other and m <= most and n <= most_v").where(close(F.col("n"), F.col("m"))).select("u", "v").distinct()
    links = written(links.union(_linked(written(pairs, "rest-pairs"), sets)), "content-links")
    roots = components(links, "content-components").withColumnRenamed("node", "k")
    labelled = prints.select("doc_id", "t", "k").join(roots, "k", "left").select("doc_id", "t", F.coalesce("root", "k").alias("root"))
    owners = labelled.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("owner"))
    return labelled.join(owners, "root").select("doc_id", "t", F.col("owner.doc_id").alias("owner_id"), F.col("owner.t").alias("owner_t"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of docs; rows without an id stay."""
    key, t = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    kept = classes(docs).where("doc_id = owner_id and t = owner_t").select(F.col("doc_id").alias("__ow_kept"), F.col("t").alias("__ow_t")).distinct()
    named = docs.where(key.isNotNull()).join(kept, (key == F.col("__ow_kept")) & (t == F.col("__ow_t"))).dropDuplicates(["__ow_kept", "__ow_t"]).drop("__ow_kept", "__ow_t")
    return named.unionByName(docs.where(key.isNull()))
