"""Summaries of an index and flat data for plots, tables and cost reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.text import depth_band, estimate_tokens, namespace
from ontoweave.operators import closure as C

#: Dollars for a million tokens in and out.
PRICING = {
    "claude-3-5-sonnet-20241022": (3.0, 15.0),
    "claude-3-5-haiku-20241022": (0.8, 4.0),
    "claude-3-opus-20240229": (15.0, 75.0),
    "gpt-4o": (2.5, 10.0),
    "gpt-4o-mini": (0.15, 0.6),
    "gpt-4-turbo": (10.0, 30.0),
    "gemini-2.0-flash": (0.1, 0.4),
    "gemini-1.5-pro": (1.25, 5.0),
    "gemini-1.5-flash": (0.075, 0.3),
}


def call_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of a call; 0 for an unknown model."""
    price = lambda i: F.coalesce(F.create_map(*(F.lit(x) for m, p in PRICING.items() for x in (m, p[i])))[model], F.lit(0.0))
    return tokens_in / 1e6 * price(0) + tokens_out / 1e6 * price(1)


def cost_by_model(calls: DataFrame) -> DataFrame:
    """model, input_tokens, output_tokens, cost."""
    cost = call_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return calls.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 6).alias("cost"))


def class_summaries(index: DataFrame, depths: DataFrame) -> DataFrame:
    """iri, label, depth, counts of properties, parents and children, and estimated tokens of each unit."""
    def prop_tokens(c):
        line = lambda p: F.concat(F.coalesce(p["label"], F.lit("")), F.lit(": "), F.coalesce(F.get(p["ranges"], F.lit(0)), F.lit("")))
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, p: a + estimate_tokens(line(p)))

    tokens = estimate_tokens(F.col("definition")) + prop_tokens(F.col("properties")) + prop_tokens(F.col("inherited"))
    sizes = {n: F.size(c) for n, c in (("direct_properties", "properties"), ("inherited_properties", "inherited"), ("parents_count", "parents"), ("children_count", "children"))}
    out = index.select("iri", "label", *(c.alias(n) for n, c in sizes.items()), tokens.alias("estimated_tokens"))
    return out.join(depths.select("iri", F.col("min_depth").alias("depth")), "iri", "left").withColumn("total_properties", F.col("direct_properties") + F.col("inherited_properties"))


def dependency_graph(index: DataFrame, edges: DataFrame, depths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (iri, label, depth, property_count) and edges (source, target)."""
    nodes = index.join(depths, "iri", "left").select("iri", "label", F.col("min_depth").alias("depth"), F.size("properties").alias("property_count"))
    return nodes, edges.select(F.col("child").alias("source"), F.col("parent").alias("target"))


def plot_nodes(depths: DataFrame) -> DataFrame:
    return depths.select(F.col("iri").alias("id"), F.concat(F.lit("depth-"), F.col("min_depth").cast("string")).alias("grp"))


def hierarchy(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """iri, parent: a tree in which every class stands once, under the first of its parents (null: a root)."""
    one = edges.groupBy(F.col("child").alias("iri")).agg(F.min("parent").alias("parent"))
    return classes.select("iri").distinct().join(one, "iri", "left")


def hierarchy_json(tree: DataFrame) -> str:
    """A tree (a schema's size) as nested JSON; several roots get a common one."""
    below: dict = {}
    for r in tree.orderBy("iri").collect():
        below.setdefault(r.parent, []).append(r.iri)

    def node(iri):
        out = {"name": iri}
        return out | {"children": [node(c) for c in below[iri]]} if iri in below else out

    tops = [node(r) for r in below.get(None, [])]
    return json.dumps(tops[0] if len(tops) == 1 else {"name": "Ontology", "children": tops})


def token_points(summaries: DataFrame) -> DataFrame:
    return summaries.select("iri", "label", F.col("estimated_tokens").alias("tokens"), "depth").orderBy(F.desc("tokens"), "iri")


def bands(depths: DataFrame) -> DataFrame:
    """iri, band: how near a class is to the roots."""
    most = depths.agg(F.max("min_depth").alias("most"))  # one row
    return depths.crossJoin(most).select("iri", depth_band(F.col("min_depth"), F.col("most")).alias("band"))


def summary_markdown(row: dict) -> str:
    lines = [f"# {row['label']}", "", f"**IRI:** `{row['iri']}`", f"**Depth:** {row['depth']}", "", "## Properties"]
    lines += [f"- Direct: {row['direct_properties']}", f"- Inherited: {row['inherited_properties']}", f"- Total: {row['total_properties']}", "", "## Relationships"]
    return "\n".join([*lines, f"- Parents: {row['parents_count']}", f"- Children: {row['children_count']}", "", "## Token Estimate", f"- {row['estimated_tokens']} tokens"])


def metadata_json(summaries: DataFrame) -> DataFrame:
    return summaries.select("iri", F.to_json(F.struct("*")).alias("json"))


def strategy_report(sizes: DataFrame) -> DataFrame:
    """strategy, classes, tokens and the percentage saved against strategy Full, from strategy, iri, tokens rows."""
    per = sizes.groupBy("strategy").agg(F.count("*").alias("classes"), F.sum("tokens").alias("tokens"))
    full = per.where("strategy = 'Full'").select(F.col("tokens").alias("_full"))  # one row
    return per.crossJoin(full).withColumn("reduction_percent", F.when(F.col("_full") == 0, 0.0).otherwise((1 - F.col("tokens") / F.col("_full")) * 100)).drop("_full")


def prefix_map(iris: DataFrame) -> DataFrame:
    """ns, n, prefix of namespaces that several distinct IRIs share."""
    n = iris.select("iri").distinct().groupBy(namespace(F.col("iri")).alias("ns")).agg(F.count("*").alias("n")).where("n > 1")
    return n.withColumn("prefix", F.regexp_replace(F.regexp_extract("ns", r"([A-Za-z][\w-]*)[#/]*$", 1), "[^A-Za-z0-9]", ""))


def page(rows: DataFrame, number: int, size: int = 10, order=None, contains: tuple[str, str] | None = None) -> DataFrame:
    """Page number (from 1) of a table, filtered by a part of a column (case aside) and sorted."""
    if contains:
        rows = rows.where(F.contains(F.lower(F.col(contains[0]).cast("string")), F.lit(contains[1].lower())))
    return rows.orderBy(*(order or rows.columns)).offset((number - 1) * size).limit(size)


def class_table(index: DataFrame) -> DataFrame:
    return index.select("iri", "label", F.size("properties").alias("properties"), F.size("parents").alias("parents"), F.size("children").alias("children"))


def property_table(class_props: DataFrame, universal: DataFrame) -> DataFrame:
    """A row for each class and property, and for universal properties."""
    columns = lambda c: [F.col("c.prop_iri").alias("iri"), F.col("c.label").alias("label"), F.array_join("c.ranges", ", ").alias("range"), F.col("c.min_card").alias("min_card"), F.col("c.max_card").alias("max_card")]
    return class_props.select(F.col("class_iri").alias("domain"), *columns("c")).unionByName(universal.select(F.lit("(universal)").alias("domain"), *columns("c")))


def ontology_triples(classes: DataFrame, edges: DataFrame, props: DataFrame) -> DataFrame:
    """An ontology as subject, predicate, object rows for display."""
    return classes.select(F.col("iri").alias("subject"), F.lit("rdf:type").alias("predicate"), F.lit("owl:Class").alias("object")).unionByName(classes.select(F.col("iri").alias("subject"), F.lit("rdfs:label").alias("predicate"), F.col("label").alias("object"))).unionByName(edges.select(F.col("child").alias("subject"), F.lit("rdfs:subClassOf").alias("predicate"), F.col("parent").alias("object"))).unionByName(props.select(F.col("c.prop_iri").alias("subject"), F.lit("rdfs:domain").alias("predicate"), F.col("class_iri").alias("object")))


def trace_summary(spans: DataFrame) -> DataFrame:
    """name, calls, average milliseconds and tokens of spans (name, duration_ms, tokens)."""
    return spans.groupBy("name").agg(F.count("*").alias("calls"), F.avg("duration_ms").alias("avg_ms"), F.sum("tokens").alias("tokens"))


def batch_report(runs: DataFrame) -> DataFrame:
    """total, passed, pass_rate, triples and seconds of runs (ok, triples, seconds)."""
    return runs.agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), (F.count_if("ok") / F.count("*") * 100).alias("pass_rate"), F.sum("triples").alias("triples"), F.sum("seconds").alias("seconds"))


def depths_of(classes: DataFrame, edges: DataFrame) -> DataFrame:
    return C.depths(classes, edges)
