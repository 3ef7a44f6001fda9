"""An ontology's tables from its quads: classes, edges, property constraints, disjointness; and the unit index.

Ontologies are schemas (thousands of rows at most), but every table is a plain query over quads, so many ontologies can be
built at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoweave.errors import InheritanceError
from ontoweave.functions.text import OWL, RDF, RDFS, XSD, extract_label
from ontoweave.operators import closure as C
from ontoweave.operators.lattice import Constraint, Hierarchy, fold

CONSTRAINT = "struct<prop_iri:string,label:string,annotations:array<string>,ranges:array<string>,min_card:int,max_card:int,allowed_values:array<string>,source:string,is_symmetric:boolean,is_transitive:boolean,is_inverse_functional:boolean>"
FIELDS = [f.split(":")[0] for f in CONSTRAINT[7:-1].replace("array<string>", "a").split(",")]


@dataclass
class Ontology:
    classes: DataFrame  # iri, label, expressions
    class_edges: DataFrame  # child, parent
    class_props: DataFrame  # class_iri, ord, c
    universal_props: DataFrame  # ord, c
    disjoint: DataFrame  # a, b (both directions)
    prop_edges: DataFrame  # child, parent


def _first(quads: DataFrame, p: str) -> DataFrame:
    return quads.where(F.col("p") == p).groupBy("s").agg(F.min("o").alias("o"))


def _label(iri, label):
    after = F.get(F.split(iri, "#"), F.lit(1))
    return F.coalesce(label, F.when(after != "", after), iri)


def rdf_lists(quads: DataFrame) -> DataFrame:
    """head, items (in order) of every well-formed list; cyclic or broken lists are left out."""
    cells = quads.where(F.col("p") == RDF + "first").select("s", F.col("o").alias("item")).join(quads.where(F.col("p") == RDF + "rest").select("s", F.col("o").alias("rest")), "s")
    inner = quads.where(F.col("p") == RDF + "rest").select(F.col("o").alias("s"))
    heads = cells.join(inner, "s", "left_anti").select(F.col("s").alias("head"), "rest", F.array("item").alias("items"))
    step, done = cells.select(F.col("s").alias("rest"), "item", F.col("rest").alias("next")), None
    while True:
        ended = heads.where(F.col("rest") == RDF + "nil").select("head", "items")
        done = ended if done is None else done.unionByName(ended)
        heads = C.cut(heads.where(F.col("rest") != RDF + "nil").join(step, "rest").select("head", F.col("next").alias("rest"), F.concat("items", F.array("item")).alias("items")))
        if not heads.limit(1).count():
            return done


def _restrictions(quads: DataFrame) -> DataFrame:
    """node, c: restrictions as constraints."""
    nodes = quads.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Restriction")).select("s").distinct()
    named = {k: OWL + k for k in ("onProperty", "someValuesFrom", "allValuesFrom", "minCardinality", "maxCardinality", "cardinality", "hasValue")}
    rows = quads.join(nodes, "s").groupBy(F.col("s").alias("node")).agg(*(F.min(F.when(F.col("p") == v, F.col("o"))).alias(k) for k, v in named.items()), F.min(F.when(F.col("p") == RDFS + "label", F.col("o"))).alias("label"))
    n = lambda c: F.col(c).try_cast("int")
    has = F.col("hasValue").isNotNull()
    low = F.greatest(F.coalesce(n("minCardinality"), F.lit(0)), F.when(F.col("someValuesFrom").isNotNull(), 1).otherwise(0))
    low = F.when(has, 1).otherwise(F.coalesce(n("cardinality"), low))
    high = F.when(has, 1).otherwise(F.coalesce(n("cardinality"), n("maxCardinality")))
    ranges = F.array_compact(F.array_distinct(F.array("someValuesFrom", "allValuesFrom")))
    c = _constraint(F.col("onProperty"), extract_label(F.col("onProperty")), F.array_compact(F.array("label")), ranges, low, high, F.when(has, F.array("hasValue")).otherwise(F.array().cast("array<string>")), "restriction", F.lit(False), F.lit(False), F.lit(False))
    return rows.where("onProperty is not null").select("node", c.alias("c"))


def _constraint(iri, label, annotations, ranges, low, high, allowed, source, *flags):
    values = [iri, label, annotations, ranges, low.cast("int"), high.cast("int"), allowed, F.lit(source), *flags]
    return F.struct(*(v.alias(k) for k, v in zip(FIELDS, values, strict=True))).cast(CONSTRAINT)


def build(quads: DataFrame) -> Ontology:
    """All tables of the ontology that the quads hold."""
    quads = quads.select("s", "s_kind", "p", "o", "o_kind").distinct()
    types = quads.where(F.col("p") == RDF + "type").select("s", "o")
    labels = _first(quads, RDFS + "label").withColumnRenamed("o", "label")
    none = F.array().cast("array<string>")

    iris = types.where(F.col("o") == OWL + "Class").select("s").distinct()
    lists = rdf_lists(quads)
    parts = quads.where(F.col("p").isin(OWL + "unionOf", OWL + "intersectionOf", OWL + "complementOf"))
    tag = F.initcap(F.substring_index("p", "#", -1))
    tag = F.when(F.col("p") == OWL + "unionOf", "UnionOf").when(F.col("p") == OWL + "intersectionOf", "IntersectionOf").otherwise("ComplementOf")
    members = parts.join(lists.withColumnRenamed("head", "o"), "o", "left").select("s", tag.alias("tag"), F.when(F.col("p") == OWL + "complementOf", F.array("o")).otherwise(F.col("items")).alias("classes")).where("classes is not null")
    expressions = members.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("tag", "classes"))).alias("expressions"))
    classes = iris.join(labels, "s", "left").join(expressions, "s", "left").select(F.col("s").alias("iri"), _label(F.col("s"), F.col("label")).alias("label"), F.coalesce("expressions", F.array().cast("array<struct<tag:string,classes:array<string>>>")).alias("expressions"))

    above = quads.where(F.col("p") == RDFS + "subClassOf")
    known = classes.select("iri")
    edges = above.where("o_kind = 'iri'").select(F.col("s").alias("child"), F.col("o").alias("parent")).join(known.toDF("child"), "child", "left_semi").join(known.toDF("parent"), "parent", "left_semi").select("child", "parent").distinct()

    kinds = types.where(F.col("o").isin(OWL + "ObjectProperty", OWL + "DatatypeProperty")).select(F.col("s").alias("prop"), (F.col("o") == OWL + "DatatypeProperty").cast("int").alias("scan"))
    prop_edges = quads.where(F.col("p") == RDFS + "subPropertyOf").select(F.col("s").alias("child"), F.col("o").alias("parent")).where("child <> parent").distinct()
    prop_above = C._doubling(prop_edges, False).where("child <> parent").select("child", "parent", "lo")
    flag = lambda k: F.bool_or(F.col("o") == OWL + k).alias(k)
    flags = types.groupBy(F.col("s").alias("prop")).agg(flag("FunctionalProperty"), flag("SymmetricProperty"), flag("TransitiveProperty"), flag("InverseFunctionalProperty"))
    domains = quads.where(F.col("p") == RDFS + "domain").select(F.col("s").alias("prop"), F.col("o").alias("domain"))
    every_domain = domains.unionByName(prop_above.join(domains.withColumnRenamed("prop", "parent"), "parent").select(F.col("child").alias("prop"), "domain")).distinct()
    own_range = _first(quads, RDFS + "range").toDF("prop", "own")
    up_range = prop_above.join(own_range.toDF("parent", "up"), "parent").groupBy(F.col("child").alias("prop")).agg(F.min(F.struct("lo", "parent", "up"))["up"].alias("up"))
    props = kinds.join(flags, "prop", "left").join(own_range, "prop", "left").join(up_range, "prop", "left").join(labels.withColumnRenamed("s", "prop"), "prop", "left")
    c = _constraint(F.col("prop"), _label(F.col("prop"), F.col("label")), none, F.array(F.coalesce("own", "up", F.lit(XSD + "string"))), F.lit(0), F.when(F.col("FunctionalProperty"), 1), none, "domain", *(F.coalesce(f, F.lit(False)) for f in ("SymmetricProperty", "TransitiveProperty", "InverseFunctionalProperty")))
    props = props.select("prop", "scan", c.alias("c"))
    by_domain = props.join(every_domain, "prop").join(known.toDF("domain"), "domain", "left_semi").select(F.col("domain").alias("class_iri"), "scan", F.col("c"))
    restricted = above.where("o_kind = 'bnode'").select(F.col("s").alias("class_iri"), F.col("o").alias("node")).join(known.toDF("class_iri"), "class_iri", "left_semi").join(_restrictions(quads), "node").select("class_iri", F.lit(2).alias("scan"), "c")
    order = Window.partitionBy("class_iri").orderBy("scan", F.col("c.prop_iri"), F.to_json("c"))
    class_props = by_domain.unionByName(restricted).select("class_iri", (F.row_number().over(order) - 1).alias("ord"), "c")
    universal = props.join(every_domain, "prop", "left_anti")
    universal = universal.select((F.row_number().over(Window.orderBy("scan", "prop")) - 1).alias("ord"), "c")  # a schema's properties
    pairs = quads.where(F.col("p") == OWL + "disjointWith").select(F.col("s").alias("a"), F.col("o").alias("b"))
    return Ontology(classes, edges, class_props, universal, C.symmetric(pairs), prop_edges)


def hierarchy(o: Ontology) -> Hierarchy:
    """The class hierarchy in memory (a schema's size), for ordered folds in tasks."""
    known = C.closure(o.class_edges).groupBy("child").agg(F.collect_set("parent").alias("up")).collect()
    return Hierarchy({r.child: frozenset(r.up) for r in known}, frozenset((r.a, r.b) for r in o.disjoint.collect()))


def ancestor_order(edges: dict[str, list[str]], node: str) -> list[str]:
    """Ancestors of a class, the farthest first: each after all that it inherits from, in the order of a walk by sorted parents."""
    out: dict[str, None] = {}
    stack = [(node, iter(edges.get(node, ())))]
    while stack:
        at, more = stack[-1]
        parent = next(more, None)
        if parent is None:
            stack.pop()
            if at != node:
                out[at] = None
        elif parent not in out:
            if any(parent == x for x, _ in stack):
                raise InheritanceError(f"{parent} inherits from itself")
            stack.append((parent, iter(edges.get(parent, ()))))
    return list(out)


def effective_properties(o: Ontology) -> DataFrame:
    """class_iri, c, own: a class's properties, those of ancestors included.

    Later ancestors of the ordered walk replace earlier ones; a class's own constraints on a property are met in order with what it
    inherits.
    """
    h = hierarchy(o)
    edges: dict[str, list[str]] = {}
    for r in o.class_edges.orderBy("child", "parent").collect():
        edges.setdefault(r.child, []).append(r.parent)
    props: dict[str, list[Constraint]] = {}
    for r in o.class_props.orderBy("class_iri", "ord").collect():
        d = r.c.asDict()
        props.setdefault(r.class_iri, []).append(Constraint(**{k: tuple(v or ()) if isinstance(v, list) else v for k, v in d.items()}))

    def run(batches):
        for batch in batches:
            rows = []
            for iri in batch["iri"]:
                found: dict[str, Constraint] = {}
                for up in ancestor_order(edges, iri):
                    found |= {c.prop_iri: c for c in props.get(up, ())}
                mine = {c.prop_iri for c in props.get(iri, ())}
                for c in props.get(iri, ()):
                    found[c.prop_iri] = fold([found[c.prop_iri], c], h) if c.prop_iri in found else c
                rows += [(iri, {k: list(v) if isinstance(v, tuple) else v for k, v in vars(found[p]).items()}, p in mine) for p in sorted(found)]
            yield pd.DataFrame(rows, columns=["class_iri", "c", "own"])

    return o.classes.select("iri").mapInPandas(run, f"class_iri string, c {CONSTRAINT}, own boolean")


def property_line(c):
    return F.concat(F.lit("  - "), F.coalesce(c["label"], c["prop_iri"]), F.lit(" ("), extract_label(F.coalesce(F.get(c["ranges"], F.lit(0)), F.lit(""))), F.lit(")"))


def units(o: Ontology, enriched: bool = True) -> DataFrame:
    """The index: a unit for each class, with inherited properties if enriched."""
    props = o.class_props.groupBy(F.col("class_iri").alias("iri")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "c"))), lambda x: x["c"]).alias("properties"))
    out = o.classes.select("iri", "label").join(props, "iri", "left").join(C.children_of(o.class_edges), "iri", "left").join(C.parents_of(o.class_edges), "iri", "left")
    empty, no_props = F.array().cast("array<string>"), F.array().cast(f"array<{CONSTRAINT}>")
    own = F.coalesce("properties", no_props)
    lines = F.when(F.size(own) == 0, "  (no properties)").otherwise(F.array_join(F.transform(own, property_line), "\n"))
    out = out.select("iri", "label", F.concat(F.lit("Class: "), "label", F.lit("\nProperties:\n"), lines).alias("definition"), own.alias("properties"), F.coalesce("children", empty).alias("children"), F.coalesce("parents", empty).alias("parents"))
    if not enriched:
        return out.withColumn("inherited", no_props)
    more = effective_properties(o).where("not own").groupBy(F.col("class_iri").alias("iri")).agg(F.array_sort(F.collect_list("c")).alias("inherited"))
    return out.join(more, "iri", "left").withColumn("inherited", F.coalesce("inherited", no_props))


def vocabulary(o: Ontology) -> tuple[DataFrame, DataFrame]:
    """Class IRIs, and property IRIs of classes and universal ones."""
    props = o.class_props.select(F.col("c.prop_iri").alias("iri")).unionByName(o.universal_props.select(F.col("c.prop_iri").alias("iri")))
    return o.classes.select("iri").distinct(), props.distinct()


def vocabulary_of_units(index: DataFrame, universal: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same of a pruned index; without any property the universal ones, if there are fewer than a hundred."""
    props = index.select(F.explode(F.concat("properties", "inherited")).alias("c")).select(F.col("c.prop_iri").alias("iri")).distinct()
    if universal is not None and not props.limit(1).count() and universal.limit(100).count() < 100:
        props = universal.select(F.col("c.prop_iri").alias("iri")).distinct()
    return index.select("iri").distinct(), props


def inspect(o: Ontology) -> DataFrame:
    """One row: counts of classes, properties with a domain, and universal ones."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(o.classes, "classes").crossJoin(count(o.class_props.where("c.source = 'domain'"), "domain_properties")).crossJoin(count(o.universal_props, "universal_properties"))
