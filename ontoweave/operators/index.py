"""The knowledge index: a table of units keyed by IRI.

UNIT: iri, label, definition, properties and inherited (arrays of structs that begin with prop_iri), children, parents.
Combining indexes is a union and one aggregation by IRI.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.functions.text import estimate_tokens

UNIVERSAL = "urn:x-ontology:UniversalProperties"


def longest(c: str) -> Column:
    """The longest of a group's strings, of equal lengths the first in order."""
    return F.min(F.struct((-F.length(c)).alias("n"), F.col(c).alias("x")))["x"]


def _merged(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def _by_iri(c: str) -> Column:
    """All properties once, sorted by IRI; of one IRI the least row, which does not depend on the order of rows."""
    every = F.array_sort(F.flatten(F.collect_list(c)))
    return F.filter(every, lambda x, i: (i == 0) | (F.get(every, i - 1)["prop_iri"] != x["prop_iri"]))


def combine(*indexes: DataFrame) -> DataFrame:
    """One index of several; units of one IRI are merged."""
    rows = reduce(DataFrame.unionByName, indexes)
    merged = {"label": longest("label"), "definition": longest("definition")}
    merged |= {c: _merged(c) for c in ("children", "parents") if c in rows.columns} | {c: _by_iri(c) for c in ("properties", "inherited") if c in rows.columns}
    return rows.groupBy("iri").agg(*(merged[c].alias(c) for c in rows.columns if c in merged)).select(*rows.columns)


def from_units(spark: SparkSession, units: list[tuple], schema: str) -> DataFrame:
    """An index of rows (the first column is the IRI); units of one IRI are merged.  No units make an empty index."""
    return combine(spark.createDataFrame(units, schema))


def get(index: DataFrame, iri: str) -> DataFrame:
    return index.where(F.col("iri") == iri)


def has(index: DataFrame, iri: str) -> bool:
    return get(index, iri).limit(1).count() > 0


def keys(index: DataFrame) -> DataFrame:
    """IRIs in order, which is the order of units and of properties."""
    return index.select("iri").orderBy("iri")


def size(index: DataFrame) -> int:
    return index.count()


def where(index: DataFrame, condition: Column) -> DataFrame:
    return index.where(condition)


def with_columns(index: DataFrame, **columns: Column) -> DataFrame:
    """The index with columns of each unit replaced; its key stays."""
    return index.withColumns({k: v for k, v in columns.items() if k != "iri"})


def stats(index: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """total_units, total_properties, total_inherited, avg_properties, and max_depth (longest path, in classes) given depths."""
    n, k = F.size("properties"), F.size("inherited")
    out = index.agg(F.count("*").alias("total_units"), F.coalesce(F.sum(n), F.lit(0)).alias("total_properties"), F.coalesce(F.sum(k), F.lit(0)).alias("total_inherited"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_properties"))
    return out if depths is None else out.crossJoin(depths.agg((F.coalesce(F.max("max_depth"), F.lit(-1)) + 1).alias("max_depth")))  # one row each


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """iri, label, change: kept, removed or added."""
    b, a = before.select("iri", F.col("label").alias("_b"), F.lit(1).alias("_in_b")), after.select("iri", F.col("label").alias("_a"), F.lit(1).alias("_in_a"))
    change = F.when(F.col("_in_a").isNull(), "removed").when(F.col("_in_b").isNull(), "added").otherwise("kept")
    return b.join(a, "iri", "full").select("iri", F.coalesce("_b", "_a").alias("label"), change.alias("change"))


def render_diff(changes: DataFrame) -> str:
    """Text of a diff; labels are listed for up to twenty units."""
    counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    lines = ["Index Diff:", *(f"  {k.capitalize()}: {counts.get(k, 0)} units" for k in ("kept", "removed", "added"))]
    for kind, sign in (("removed", "-"), ("added", "+")):
        if 0 < counts.get(kind, 0) <= 20:
            lines += [f"\n{kind.capitalize()} IRIs:", *(f"  {sign} {r.label}" for r in changes.where(F.col("change") == kind).orderBy("iri").collect())]
    return "\n".join(lines)


def overlay(first: DataFrame, second: DataFrame, key: str = "iri") -> DataFrame:
    """Rows of second, and those of first whose key second lacks."""
    return second.unionByName(first.join(second.select(key), key, "left_anti"))


def universal_unit(universal: DataFrame) -> DataFrame:
    """The unit that holds an ontology's universal properties (no row without any)."""
    line = F.concat(F.lit("  - "), F.coalesce("c.label", "c.prop_iri"))
    rows = universal.groupBy().agg(F.array_sort(F.collect_list("c")).alias("properties"), F.array_sort(F.collect_list(line)).alias("_lines")).where(F.size("properties") > 0)
    none = F.array().cast("array<string>")
    return rows.select(F.lit(UNIVERSAL).alias("iri"), F.lit("Universal Properties").alias("label"), F.concat(F.lit("Universal Properties (apply to all classes):\n"), F.array_join("_lines", "\n")).alias("definition"), "properties", F.slice("properties", 1, 0).alias("inherited"), none.alias("children"), none.alias("parents"))


def token_stats(index: DataFrame) -> DataFrame:
    """total_tokens, avg_tokens, max_tokens, cost of all definitions."""
    t = estimate_tokens(F.col("definition"))
    out = index.agg(F.coalesce(F.sum(t), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg(t), F.lit(0.0)).alias("avg_tokens"), F.coalesce(F.max(t), F.lit(0)).alias("max_tokens"))
    return out.withColumn("cost", F.col("total_tokens") / 1000 * 0.03)
