"""Class hierarchies: closure, depth, order, disjointness and inherited properties over edge tables (child, parent).

The closure is built by recursive doubling, so a chain of n classes takes log2 n rounds; every round is written to the shared
folder.  A cycle shows as a class above itself, in the same rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.errors import GraphCycleError


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local one in local mode where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.gettempdir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: a table in the folder that spark.checkpoint.dir names, computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ontoweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _doubling(edges: DataFrame, depths: bool) -> DataFrame:
    known = edges.where("child is not null and parent is not null").select("child", "parent").distinct()
    known = known.select("child", "parent", F.lit(1).alias("lo"), F.lit(1).alias("hi"))
    state = None
    while True:
        up = known.select(F.col("child").alias("parent"), F.col("parent").alias("far"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        longer = known.join(up, "parent").select("child", F.col("far").alias("parent"), (F.col("lo") + F.col("lo2")).alias("lo"), (F.col("hi") + F.col("hi2")).alias("hi"))
        hi = F.max("hi") if depths else F.min("hi")
        known = cut(known.unionByName(longer).groupBy("child", "parent").agg(F.min("lo").alias("lo"), hi.alias("hi")))
        now = known.agg(F.count("*"), F.sum("lo"), F.sum("hi"), F.count_if(F.col("child") == F.col("parent"))).first()
        if depths and now[3]:
            on_cycle = known.where("child = parent").select("child").distinct().orderBy("child").limit(3).collect()
            raise GraphCycleError("cycle through " + ", ".join(r.child for r in on_cycle))
        if tuple(now) == state:
            return known
        state = tuple(now)


def cyclic(edges: DataFrame) -> DataFrame:
    """node of every class on a cycle."""
    return _doubling(edges, False).where("child = parent").select(F.col("child").alias("node"))


#: Up to so many edges (a schema's size) a closure is computed on the driver, which saves a dozen small jobs.
FEW = 1000


def _small(pairs: list[tuple[str, str]]) -> list[tuple]:
    """The closure of a few edges, each class after all its parents."""
    up: dict[str, list[str]] = {}
    for child, parent in pairs:
        up.setdefault(child, []).append(parent)
    done: dict[str, dict] = {}
    for start in up:
        stack = [start]
        while stack:
            at = stack[-1]
            waiting = [p for p in up.get(at, ()) if p not in done] if at not in done else []
            if loop := [p for p in waiting if p in stack]:
                raise GraphCycleError("cycle through " + ", ".join(sorted(stack[stack.index(loop[0]) :])[:3]))
            if waiting:
                stack.append(waiting[0])
                continue
            stack.pop()
            if at in done:
                continue
            far: dict[str, tuple[int, int]] = {}
            for p in up.get(at, ()):
                for q, (lo, hi) in {p: (0, 0), **done[p]}.items():
                    was = far.get(q, (lo + 1, hi + 1))
                    far[q] = min(was[0], lo + 1), max(was[1], hi + 1)
            done[at] = far
    return [(c, p, lo, hi) for c, far in done.items() for p, (lo, hi) in far.items()]


def closure(edges: DataFrame) -> DataFrame:
    """child, parent (any ancestor), lo and hi: the fewest and most edges between them."""
    few = edges.where("child is not null and parent is not null").select("child", "parent").distinct().limit(FEW + 1).collect()
    if len(few) <= FEW:
        return edges.sparkSession.createDataFrame(_small([tuple(r) for r in few]), "child string, parent string, lo int, hi int")
    return _doubling(edges, True)


def roots(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes without a parent."""
    return classes.select("iri").distinct().join(edges.select(F.col("child").alias("iri")), "iri", "left_anti")


def depths(classes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """iri, min_depth (from the nearest root), max_depth (longest path from a root); roots have 0."""
    known = closure(edges) if known is None else known
    top = roots(classes, edges).withColumnRenamed("iri", "parent")
    below = known.join(top, "parent").groupBy(F.col("child").alias("iri")).agg(F.min("lo").alias("min_depth"), F.max("hi").alias("max_depth"))
    return classes.select("iri").distinct().join(below, "iri", "left").select("iri", F.coalesce("min_depth", F.lit(0)).alias("min_depth"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"))


def topological(classes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """iri, level: the longest path from a leaf, so that children come before parents in the order of (level, iri)."""
    known = closure(edges) if known is None else known
    height = known.groupBy(F.col("parent").alias("iri")).agg(F.max("hi").alias("level"))
    return classes.select("iri").distinct().join(height, "iri", "left").select("iri", F.coalesce("level", F.lit(0)).alias("level"))


def children_of(edges: DataFrame) -> DataFrame:
    """iri, children (sorted)."""
    return edges.groupBy(F.col("parent").alias("iri")).agg(F.array_sort(F.collect_set("child")).alias("children"))


def parents_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("child").alias("iri")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def reflexive(classes: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("child", "parent").unionByName(classes.select(F.col("iri").alias("child"), F.col("iri").alias("parent"))).distinct()


def is_subclass(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs (child, parent) with is_subclass: equal, or the parent is an ancestor."""
    hit = known.select("child", "parent", F.lit(True).alias("_hit"))
    return pairs.join(hit, ["child", "parent"], "left").withColumn("is_subclass", F.coalesce("_hit", F.col("child") == F.col("parent"))).drop("_hit")


def symmetric(pairs: DataFrame) -> DataFrame:
    """Disjointness (a, b) in both directions."""
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def disjointness(pairs: DataFrame, classes: DataFrame, known: DataFrame, disjoint: DataFrame) -> DataFrame:
    """pairs (a, b) with relation: Disjoint (themselves or ancestors), Overlapping (one is above the other or equal), else Unknown."""
    upward = reflexive(classes, known)
    up_a, up_b = upward.toDF("a", "above_a"), upward.toDF("b", "above_b")
    apart = pairs.join(up_a, "a").join(symmetric(disjoint).toDF("above_a", "above_b"), "above_a").join(up_b, ["b", "above_b"]).select("a", "b", F.lit(True).alias("_apart")).distinct()
    either = known.select(F.col("child").alias("a"), F.col("parent").alias("b"))
    over = either.unionByName(either.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("_over", F.lit(True))
    joined = pairs.join(apart, ["a", "b"], "left").join(over, ["a", "b"], "left")
    return joined.select("a", "b", F.when(F.col("_apart"), "Disjoint").when(F.col("_over") | (F.col("a") == F.col("b")), "Overlapping").otherwise("Unknown").alias("relation"))


def inherited(classes: DataFrame, known: DataFrame, class_props: DataFrame) -> DataFrame:
    """iri, prop_iri, from_class: properties of ancestors that a class has not itself; the nearest ancestor (then the smaller IRI) gives it.

    On hierarchies where a class has one parent this is the order of the ordered walk; where paths join, see
    ontology.effective_properties.
    """
    rows = known.join(class_props.select(F.col("class_iri").alias("parent"), "prop_iri"), "parent").select(F.col("child").alias("iri"), "prop_iri", F.struct("lo", "parent").alias("near"))
    nearest = rows.groupBy("iri", "prop_iri").agg(F.min("near")["parent"].alias("from_class"))
    return nearest.join(class_props.select(F.col("class_iri").alias("iri"), "prop_iri"), ["iri", "prop_iri"], "left_anti")


def paths(classes: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """iri, path (from a root down): one row for each path; for prompts that repeat a class under each of its parents."""
    found = roots(classes, edges).select("iri", F.array("iri").alias("path"))
    out, step = found, edges.select(F.col("parent").alias("iri"), F.col("child").alias("next"))
    for _ in range(limit):
        found = cut(found.join(step, "iri").select(F.col("next").alias("iri"), F.concat("path", F.array("next")).alias("path")))
        if not found.limit(1).count():
            return out
        out = out.unionByName(found)
    raise GraphCycleError(f"a path of more than {limit} classes")
