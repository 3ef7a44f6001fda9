"""Shapes from class properties, and validation of quads against them as joins.

A class's own property has one expected type: its first range, an XSD type (datatype) or a class.  VIOLATION: focus_node, path,
severity, message, category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.text import RDF, RDFS, XSD, trim

#: Lexical forms of XSD types that have one.
LEXICAL = {
    "boolean": r"^(true|false|0|1)$",
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$",
    "double": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "date": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "dateTime": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
}


def valid_iri(c):
    """Begins with a letter or digit and has a colon or slash."""
    return trim(c).rlike(r"^[A-Za-z0-9].*[:/]|^[A-Za-z0-9]*[:/]")


def property_shapes(class_props: DataFrame) -> DataFrame:
    """class_iri, prop_iri, name, kind ('datatype', 'class' or null), expected from class_iri, prop_iri, label, ranges."""
    first = F.get("ranges", F.lit(0))
    expected = F.when(first.startswith("xsd:"), F.concat(F.lit(XSD), F.substring(first, 5, 1 << 20))).otherwise(first)
    rows = class_props.where(valid_iri(F.col("class_iri")) & valid_iri(F.col("prop_iri")))
    kind = F.when(first.isNull() | ~valid_iri(expected), None).when(expected.startswith(XSD), "datatype").otherwise("class")
    return rows.select("class_iri", "prop_iri", F.coalesce("label", "prop_iri").alias("name"), kind.alias("kind"), expected.alias("expected"))


def shapes_turtle(shapes: DataFrame) -> DataFrame:
    """class_iri, value: a node shape for each class as Turtle."""
    name = F.regexp_replace(F.regexp_replace("name", r"\\", r"\\\\"), '"', '\\\\"')
    kind = F.when(F.col("kind") == "datatype", F.concat(F.lit(" sh:datatype <"), "expected", F.lit("> ;"))).when(F.col("kind") == "class", F.concat(F.lit(" sh:class <"), "expected", F.lit("> ;"))).otherwise("")
    prop = F.concat(F.lit("    sh:property [ sh:path <"), "prop_iri", F.lit('> ; sh:name "'), name, F.lit('" ;'), kind, F.lit(" ]"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prop_iri", prop.alias("t")))), lambda x: x["t"]), " ;\n")
    head = F.concat(F.lit("<"), "class_iri", F.lit("Shape> a sh:NodeShape ;\n    sh:targetClass <"), "class_iri", F.lit("> ;\n"))
    return shapes.groupBy("class_iri").agg(body.alias("body")).select("class_iri", F.concat(head, "body", F.lit(" .")).alias("value"))


def instances(quads: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """s, class_iri: types of nodes, and with a closure (child, parent) their superclasses."""
    own = quads.where(F.col("p") == RDF + "type").select("s", F.col("o").alias("class_iri")).distinct()
    if closure is None:
        return own
    up = own.join(closure.select(F.col("child").alias("class_iri"), "parent"), "class_iri").select("s", F.col("parent").alias("class_iri"))
    return own.unionByName(up).distinct()


def _violations(rows: DataFrame, message, category: str) -> DataFrame:
    return rows.select(F.col("s").alias("focus_node"), F.col("prop_iri").alias("path"), F.lit("Violation").alias("severity"), message.alias("message"), F.lit(category).alias("category"))


def _targets(quads: DataFrame, shapes: DataFrame, types: DataFrame) -> DataFrame:
    values = quads.where(F.col("p") != RDF + "type").select("s", F.col("p").alias("prop_iri"), "o", "o_kind", "o_datatype")
    return values.join(types.join(shapes, "class_iri").select("s", "prop_iri", "kind", "expected").distinct(), ["s", "prop_iri"])


def datatype_violations(quads: DataFrame, shapes: DataFrame, types: DataFrame) -> DataFrame:
    rows = _targets(quads, shapes.where("kind = 'datatype'"), types)
    well_formed = F.lit(True)
    for name, pattern in LEXICAL.items():
        well_formed = F.when(F.col("expected") == XSD + name, F.col("o").rlike(pattern)).otherwise(well_formed)
    good = (F.col("o_kind") == "literal") & (F.col("o_datatype") == F.col("expected")) & well_formed
    return _violations(rows.where(~F.coalesce(good, F.lit(False))), F.concat(F.lit("Value does not have datatype "), "expected"), "Datatype")


def class_violations(quads: DataFrame, shapes: DataFrame, types: DataFrame) -> DataFrame:
    rows = _targets(quads, shapes.where("kind = 'class'"), types)
    typed = types.select(F.col("s").alias("o"), F.col("class_iri").alias("expected"))
    literal = rows.where("o_kind = 'literal'").select(*rows.columns)
    untyped = rows.where("o_kind <> 'literal'").join(typed, ["o", "expected"], "left_anti").select(*rows.columns)
    return _violations(literal.unionByName(untyped), F.concat(F.lit("Value does not have class "), "expected"), "DomainRange")


def cardinality_violations(quads: DataFrame, bounds: DataFrame, types: DataFrame) -> DataFrame:
    """Nodes with fewer or more values than class_iri, prop_iri, min_card, max_card allow."""
    counts = quads.groupBy("s", F.col("p").alias("prop_iri")).agg(F.countDistinct("o", "o_kind", "o_datatype").alias("n"))
    wanted = types.join(bounds, "class_iri").groupBy("s", "prop_iri").agg(F.max("min_card").alias("min_card"), F.min("max_card").alias("max_card"))
    n = F.coalesce(F.col("n"), F.lit(0))
    rows = wanted.join(counts, ["s", "prop_iri"], "left").withColumn("n", n)
    low, high = F.col("n") < F.col("min_card"), F.coalesce(F.col("n") > F.col("max_card"), F.lit(False))
    message = F.when(low, F.concat(F.lit("minCount "), F.col("min_card").cast("string"), F.lit(", found "), F.col("n").cast("string"))).otherwise(F.concat(F.lit("maxCount "), F.col("max_card").cast("string"), F.lit(", found "), F.col("n").cast("string")))
    return _violations(rows.where(low | high), message, "Cardinality")


def value_violations(quads: DataFrame, allowed: DataFrame, types: DataFrame) -> DataFrame:
    """Values outside class_iri, prop_iri, allowed_values."""
    rows = quads.select("s", F.col("p").alias("prop_iri"), "o").join(types.join(allowed.where(F.size("allowed_values") > 0), "class_iri").select("s", "prop_iri", "allowed_values"), ["s", "prop_iri"])
    return _violations(rows.where(~F.array_contains("allowed_values", F.col("o"))), F.concat(F.lit("Value is not allowed: "), "o"), "Other")


def disjoint_violations(types: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Nodes of two classes that exclude each other."""
    b = types.select("s", F.col("class_iri").alias("b"))
    rows = types.withColumnRenamed("class_iri", "a").join(b, "s").where("a < b")
    both = disjoint.select("a", "b").unionByName(disjoint.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    rows = rows.join(both, ["a", "b"]).withColumn("prop_iri", F.lit(RDF + "type"))
    return _violations(rows, F.concat(F.lit("Disjoint classes "), "a", F.lit(" and "), "b"), "Disjointness")


def validate(quads: DataFrame, class_props: DataFrame) -> DataFrame:
    """Violations of datatypes and classes; a graph conforms if there is none.  Superclasses come from subclass quads of the data."""
    from ontoweave.operators.closure import closure

    edges = quads.where(F.col("p") == RDFS + "subClassOf").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    types = instances(quads, closure(edges) if edges.limit(1).count() else None)
    shapes = property_shapes(class_props)
    return datatype_violations(quads, shapes, types).unionByName(class_violations(quads, shapes, types))


#: Parts of a message, or of a path, that decide its category; the first that fits.
CATEGORY_WORDS = [
    ("Cardinality", ["mincount", "maxcount", "exactly", "cardinality"], []),
    ("DomainRange", ["class", "nodekind", "range", "domain"], ["class", "range"]),
    ("Disjointness", ["disjoint", "alldisjointclasses"], []),
    ("Datatype", ["datatype", "pattern", "minlength", "maxlength"], ["datatype"]),
]


def categorize(message, path):
    m, p, out = F.lower(message), F.lower(F.coalesce(path, F.lit(""))), F.lit("Other")
    for name, in_message, in_path in reversed(CATEGORY_WORDS):
        out = F.when(m.rlike("|".join(in_message)) | (p.rlike("|".join(in_path)) if in_path else F.lit(False)), name).otherwise(out)
    return out


def constraint_metrics(violations: DataFrame, total_triples: int) -> DataFrame:
    """Counts by category, valid triples and the share of valid ones (1 of none)."""
    category = categorize(F.col("message"), F.col("path"))
    severe = F.count_if(F.col("severity") == "Violation")
    out = violations.withColumn("_c", category).agg(F.count("*").alias("total_violations"), severe.alias("_severe"), *(F.count_if(F.col("_c") == c).alias(n) for c, n in (("Cardinality", "cardinality"), ("DomainRange", "domain_range"), ("Disjointness", "disjointness"), ("Datatype", "datatype"), ("Other", "other"))))
    valid = F.greatest(F.lit(0), F.lit(total_triples) - F.col("_severe"))
    return out.withColumns({"valid_triples": valid, "constraint_rate": F.lit(1.0) if not total_triples else valid / total_triples}).drop("_severe")


CATEGORIES = ["cardinality", "domain_range", "disjointness", "datatype", "other"]


def constraint_totals(metrics: DataFrame) -> DataFrame:
    """Sums of violations, valid triples and categories over the entries' metrics, and the mean of their rates (1 of no entries)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_violations", "valid_triples", *CATEGORIES)]
    return metrics.agg(*sums, F.coalesce(F.avg("constraint_rate"), F.lit(1.0)).alias("constraint_rate"))
