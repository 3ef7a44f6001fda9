"""Line dedup by winnowing over line hashes.

Every run of ``window`` lines selects the least of its line hashes (the leftmost of equals) as fingerprint, so two texts that
share ``window`` consecutive lines are guaranteed to share a fingerprint at the same place of the run.  Only selected lines are
kept, about half of them, each with the lines around it; those whose fingerprint is found at one place only are dropped.  The places of
the others are joined: a match of two fingerprints is extended line by line both ways, up to the runs that select the
line, and counts if the extended lines are the same at an earlier place of the corpus (smaller id, then earlier line).  Runs that
follow each other extend the match further; the lines of the later occurrence are deleted.

Runs shorter than ``window`` are compared too where ``words`` is given (the pipeline's stage; the query has runs of three
lines only, as its SQL): those of at least that many words, and whole documents, to whole documents.

So a line goes if and only if some run of ``window`` consecutive lines that covers it also starts at an earlier place.  Lines
are compared as they are, by two 64-bit hashes over a run; an empty line is a line.  All steps are partial aggregates and joins
of written tables, which adaptive execution splits at hot keys, so a passage in a third of all documents is no hot task.

Nulls: a null text has no lines and stays null; a null id counts as larger than all others.  Rows of one id and one text
are one place, so they delete nothing from each other.  Other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, written


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__ow_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__ow_hash": F.xxhash64("text"), "__ow_lines": F.split("text", "\n")})


def _short_repeats(docs: DataFrame, window: int, words: int) -> DataFrame:
    """__ow_id, __ow_hash, s and n (place and lines) of later occurrences of runs of fewer lines than window."""
    lines = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).where(F.col("text").isNotNull())
    # a line of fewer than 2 * words - 1 characters has fewer words, but may be one of several in a run
    counted = F.transform("__ow_lines", lambda x: F.regexp_count(x, F.lit(r"[^ \t\r\f\x0B]+")))
    lines = lines.where((F.length("text") >= 2 * words - 1) | (F.size("__ow_lines") < window))
    lines = lines.select("__ow_id", "__ow_hash", F.transform("__ow_lines", lambda x: F.xxhash64(x)).alias("h"), counted.alias("c"))

    def runs(n):
        places = F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)).otherwise(F.array().cast("array<int>"))
        long = F.filter(places, lambda s: sum((F.element_at("c", s + k + 1) for k in range(n)), F.lit(0)) >= words)
        return F.transform(long, lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), F.lit(False).alias("whole"), F.slice("h", s + 1, n).alias("run")))

    copy = F.struct(F.lit(0).alias("s"), F.size("h").alias("n"), F.lit(True).alias("whole"), F.col("h").alias("run"))
    has = (F.size("h") < window) & F.exists("c", lambda x: x > 0)
    whole = F.when(has, F.array(copy)).otherwise(F.slice(F.array(copy), 1, 0))
    placed = lines.select("__ow_id", "__ow_hash", F.inline(F.concat(*(runs(n) for n in range(1, window)), whole)))
    at = F.struct("__ow_id", "__ow_hash", "s").alias("at")
    placed = placed.select("n", F.xxhash64("whole", "run").alias("r1"), F.xxhash64(F.lit("second"), "whole", "run").alias("r2"), at)
    first = placed.groupBy("r1", "r2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").select("r1", "r2", "first")
    return placed.join(written(first, "first-runs"), ["r1", "r2"]).where("at > first").select("at.*", "n")


def _positions(docs: DataFrame, window: int) -> DataFrame:
    """__ow_id, __ow_hash, at, fingerprint and near (its lines and window - 1 more on either side, null beyond the text) of selected lines."""
    lines = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).where(F.size("__ow_lines") >= window)
    lines = lines.select("__ow_id", "__ow_hash", F.transform("__ow_lines", lambda x: F.xxhash64(x)).alias("h"))

    def selected(s):
        run = F.slice("h", s + 1, window)
        return (s + F.array_position(run, F.array_min(run)) - 1).cast("int")

    places = lines.select("__ow_id", "__ow_hash", "h", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - window), selected))).alias("at"))
    near = F.array(*(F.get("h", F.col("at") + k) for k in range(1 - window, window)))
    return places.select("__ow_id", "__ow_hash", "at", F.get("h", F.col("at")).alias("fingerprint"), near.alias("near"))


def _extended(window: int):
    """The runs that a selected line's match can be extended to: those in whose window it is the leftmost least."""
    near, runs = lambda k: F.get("near", F.lit(window - 1 + k)), []
    for o in range(window):  # lines of the run before the selected one
        least = [near(k) > F.col("fingerprint") for k in range(-o, 0)] + [near(k) >= F.col("fingerprint") for k in range(1, window - o)]
        good = F.lit(True)
        for x in least:
            good = good & F.coalesce(x, F.lit(False))
        run = [near(k) for k in range(-o, window - o)]
        runs.append(F.struct(good.alias("good"), (F.col("at") - o).alias("s"), F.xxhash64(*run).alias("r1"), F.xxhash64(F.lit("second"), *run).alias("r2")))
    return F.filter(F.array(*runs), lambda x: x["good"])


def repeated_lines(docs: DataFrame, window: int = 3, words: int | None = None) -> DataFrame:
    """__ow_id, __ow_hash and __ow_gone (sorted places of lines to delete) of documents that have some."""
    positions = written(_positions(docs, window), "line-positions")
    place = F.struct("__ow_id", "__ow_hash", "at").alias("place")
    common = positions.groupBy("fingerprint").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("fingerprint")
    # written, so that either side of a join is an exchange of its own, which adaptive execution can split at a hot key
    joined = positions.join(written(common, "line-fingerprints"), "fingerprint")
    matched = joined.select("__ow_id", "__ow_hash", F.inline(_extended(window))).select("r1", "r2", F.struct("__ow_id", "__ow_hash", "s").alias("at"))
    matched = written(matched, "line-matches")
    first = matched.groupBy("r1", "r2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").select("r1", "r2", "first")
    later = matched.join(written(first, "first-lines"), ["r1", "r2"]).where("at > first").select("at.*", F.lit(window).alias("n"))
    if words is not None:
        later = later.unionByName(_short_repeats(docs, window, words))
    starts = later.groupBy("__ow_id", "__ow_hash").agg(F.collect_set(F.struct("s", "n")).alias("starts"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))))
    return starts.select("__ow_id", "__ow_hash", gone.alias("__ow_gone"))


def _deduped(docs: DataFrame, window: int, words: int | None = None) -> DataFrame:
    """docs with text without its repeated lines, and columns __ow_n_lines and __ow_n_removed."""
    marked = _keyed(docs.withColumn("text", F.col("text").cast("string"))).drop("__ow_lines")
    joined = marked.join(repeated_lines(docs, window, words), ["__ow_id", "__ow_hash"], "left")
    lines = F.split("text", "\n")
    # the lines between deleted ones: from behind one deleted line to before the next
    edges = F.concat(F.array(F.lit(-1)), F.col("__ow_gone"), F.array(F.size(lines)))
    pieces = F.transform(F.sequence(F.lit(1), F.size("__ow_gone") + 1), lambda k: F.slice(lines, F.element_at(edges, k) + 2, F.element_at(edges, k + 1) - F.element_at(edges, k) - 1))
    kept = F.when(F.col("__ow_gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_gone = F.when(F.col("__ow_gone").isNull(), 0).otherwise(F.size("__ow_gone")).cast("long")
    return joined.select(*(kept.alias(c) if c == "text" else F.col(c) for c in docs.columns), n_lines.alias("__ow_n_lines"), n_gone.alias("__ow_n_removed"))


def line_dedup(docs: DataFrame, window: int = 3) -> DataFrame:
    """docs with text without its repeated lines, and columns n_lines and n_removed (longs; they replace columns of these names)."""
    out = _deduped(docs, window)
    return out.drop("n_lines", "n_removed").withColumnsRenamed({"__ow_n_lines": "n_lines", "__ow_n_removed": "n_removed"})


def without_repeats(docs: DataFrame, window: int = 3, words: int | None = 50) -> DataFrame:
    """docs, with its columns: text without repeated lines, n_chars (if there) to match, and no document that was all repeats."""
    kept = _deduped(docs, window, words).where("__ow_n_removed = 0 or __ow_n_removed < __ow_n_lines")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__ow_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def digest(docs: DataFrame, window: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the kept text (null text: of nothing)."""
    out = line_dedup(docs.select("doc_id", "text"), window)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
