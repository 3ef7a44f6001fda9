"""Context pruning: which units of an index a task needs.

focus: table of iri; known: the closure of closure.closure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoweave.functions.text import label_from_iri


def focused_iris(focus: DataFrame, known: DataFrame, max_ancestor_depth: int | None = None) -> DataFrame:
    """The focus and its ancestors (at most so many edges up, if given)."""
    above = known if max_ancestor_depth is None else known.where(F.col("lo") <= max_ancestor_depth)
    up = above.join(focus.select(F.col("iri").alias("child")), "child", "left_semi").select(F.col("parent").alias("iri"))
    return focus.select("iri").unionByName(up).distinct()


def neighborhood_iris(focus: DataFrame, known: DataFrame, max_ancestor_depth: int | None = None, max_descendant_depth: int = 1) -> DataFrame:
    """The focus, its ancestors, and its children (or descendants to that depth)."""
    down = known.where(F.col("lo") <= max_descendant_depth).join(focus.select(F.col("iri").alias("parent")), "parent", "left_semi").select(F.col("child").alias("iri"))
    return focused_iris(focus, known, max_ancestor_depth).unionByName(down).distinct()


def dependency_iris(focus: DataFrame, known: DataFrame, class_ranges: DataFrame, classes: DataFrame) -> DataFrame:
    """The focus with ancestors, the classes its own properties range over, and their ancestors; one hop."""
    ranged = class_ranges.join(focus.select(F.col("iri").alias("class_iri")), "class_iri", "left_semi").select(F.col("range").alias("iri")).join(classes.select("iri"), "iri", "left_semi").distinct()
    return focused_iris(focus, known).unionByName(focused_iris(ranged, known)).distinct()


def select_context(index: DataFrame, focus: DataFrame, known: DataFrame, strategy: str = "Full", **depths) -> DataFrame:
    """The units of an index by strategy Full, Focused or Neighborhood."""
    if strategy == "Full":
        return index
    iris = {"Focused": focused_iris, "Neighborhood": neighborhood_iris}[strategy](focus, known, **depths)
    return index.join(iris, "iri", "left_semi")


def select_minimal(index: DataFrame, focus: DataFrame, known: DataFrame, class_ranges: DataFrame) -> DataFrame:
    return index.join(dependency_iris(focus, known, class_ranges, index), "iri", "left_semi")


def analyze_reduction(full: DataFrame, pruned: DataFrame, avg_tokens: int = 50) -> DataFrame:
    """full_size, focused_size, reduction_percent, estimated_token_savings."""
    sizes = full.agg(F.count("*").alias("full_size")).crossJoin(pruned.agg(F.count("*").alias("focused_size")))  # one row each
    gone = F.col("full_size") - F.col("focused_size")
    return sizes.select("full_size", "focused_size", F.when(F.col("full_size") == 0, 0.0).otherwise(gone / F.col("full_size") * 100).alias("reduction_percent"), (gone * avg_tokens).alias("estimated_token_savings"))


def index_documents(index: DataFrame) -> DataFrame:
    """id, text of each unit for search: label, definition and labels of properties."""
    labels = F.transform("properties", lambda p: F.coalesce(p["label"], F.lit("")))
    return index.select(F.col("iri").alias("id"), F.concat_ws(" ", "label", "definition", labels).alias("text"))


def filter_properties(texts: DataFrame, properties: DataFrame, bm25: DataFrame | None = None, most: int = 100, lemmas=None, verbs=None) -> DataFrame:
    """id, prop_iri, score, rank: the properties that a text calls for, best first, at most ``most``.

    Signals: the label without blanks in the text (15), a word of the label among the text's (8), among its lemmas (6) or its
    verbs (4), and one and a half times a BM25 score (id, prop_iri, bm25).  lemmas and verbs are functions of the text's column;
    where none is given, lemmas are the words, and verbs add nothing.  properties are an ontology's vocabulary and bounded by it.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: F.length(w) > 2))
    label = F.lower(label_from_iri(F.col("prop_iri")))
    props = properties.select("prop_iri", F.replace(label, F.lit(" "), F.lit("")).alias("_joined"), F.filter(F.split(label, r"\s+"), lambda w: F.length(w) > 2).alias("_label"))
    left = texts.select("id", F.lower("text").alias("_text"), words(F.col("text")).alias("_words"))
    left = left.withColumns({"_lemmas": lemmas(F.col("_text")) if lemmas else F.col("_words"), "_verbs": verbs(F.col("_text")) if verbs else F.array().cast("array<string>")})
    points = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    score = points(F.contains("_text", "_joined"), 15) + points(F.arrays_overlap("_label", "_words"), 8) + points(F.arrays_overlap("_label", "_lemmas"), 6) + points(F.arrays_overlap("_label", "_verbs"), 4)
    pairs = left.crossJoin(F.broadcast(props) if _small(props) else props)
    if bm25 is not None:
        pairs = pairs.join(bm25.select("id", "prop_iri", "bm25"), ["id", "prop_iri"], "left")
        score = score + F.coalesce(F.col("bm25"), F.lit(0.0)) * 1.5
    scored = pairs.select("id", "prop_iri", score.alias("score")).where("score > 0")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "prop_iri")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def _small(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most
