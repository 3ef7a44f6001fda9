"""Quads from extracted graphs, datatype inference, and Turtle / N-Triples text.

QUAD: graph_id, s, s_kind ('iri', 'bnode'), p, o, o_kind ('iri', 'bnode', 'literal'), o_datatype, o_lang.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.text import RDF, RDFS, XSD, generate_iri, trim

#: XSD types with a priority; a property of several ranges takes the first of this order.
XSD_PRIORITY = ["boolean", "integer", "decimal", "double", "date", "dateTime", "string"]
COLUMNS = ["graph_id", "s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"]


def _kind(c):
    return F.when(c.startswith("_:"), "bnode").otherwise("iri")


def normalize_range(c):
    return F.when(c.startswith("xsd:"), F.concat(F.lit(XSD), F.substring(c, 5, 1 << 20))).otherwise(c)


def infer_datatypes(class_ranges: DataFrame, universal_ranges: DataFrame | None = None) -> DataFrame:
    """prop_iri, datatype from class_iri, prop_iri, range rows (and prop_iri, range rows of universal properties).

    The first class (by IRI) with an XSD range for the property decides, else the universal property; of several ranges the one of
    highest priority.
    """
    xsd = F.col("range").startswith(XSD)
    order = F.coalesce(F.nullif(F.array_position(F.lit([XSD + x for x in XSD_PRIORITY]), F.col("range")), F.lit(0).cast("long")), F.lit(99))
    rows = class_ranges.select("prop_iri", F.concat(F.lit("0"), F.col("class_iri")).alias("owner"), normalize_range(F.col("range")).alias("range"))
    if universal_ranges is not None:
        rows = rows.unionByName(universal_ranges.select("prop_iri", F.lit("1").alias("owner"), normalize_range(F.col("range")).alias("range")))
    return rows.where(xsd).groupBy("prop_iri").agg(F.min(F.struct("owner", order.alias("order"), "range"))["range"].alias("datatype"))


def entities_to_quads(entities: DataFrame, datatypes: DataFrame | None = None) -> DataFrame:
    """Quads from graph_id, id, type, properties array<struct<predicate, lit, ref>>: a type quad and one for each property."""
    head = entities.select("graph_id", F.col("id").alias("s"), F.lit(RDF + "type").alias("p"), F.col("type").alias("o"), F.lit("iri").alias("o_kind"))
    rows = entities.select("graph_id", F.col("id").alias("s"), F.inline("properties"))
    body = rows.select("graph_id", "s", F.col("predicate").alias("p"), F.coalesce("ref", trim(F.col("lit"))).alias("o"), F.when(F.col("ref").isNull(), "literal").otherwise(_kind(F.col("ref"))).alias("o_kind"))
    return _finish(head.unionByName(body), datatypes)


def triples_to_quads(triples: DataFrame, datatypes: DataFrame | None = None, base: str = "http://example.org/") -> DataFrame:
    """Quads from graph_id, subject, subject_type, predicate, object struct<value, type>.

    Each triple gives the subject's type and label and the statement; an object with a type is a reference and gets a type and a
    label too.
    """
    def fact(s, p, o, kind):
        return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))

    value, kind = F.col("object.value"), F.col("object.type")
    # IRIs are made once, below the five facts that have them
    iris = [generate_iri(F.col("subject"), base).alias("_s"), F.when(kind.isNotNull(), generate_iri(value, base)).alias("_o")]
    triples = triples.select("graph_id", "subject", "subject_type", "predicate", "object", *iris)
    s, o = F.col("_s"), F.col("_o")
    is_type, is_label = F.lit(RDF + "type"), F.lit(RDFS + "label")
    own = [fact(s, is_type, F.col("subject_type"), "iri"), fact(s, is_label, F.col("subject"), "literal")]
    to_ref = F.array(*own, fact(s, F.col("predicate"), o, "iri"), fact(o, is_type, kind, "iri"), fact(o, is_label, value, "literal"))
    to_literal = F.array(*own, fact(s, F.col("predicate"), trim(value), "literal"))
    # outer, though no array is empty, since Spark would put a filter on its size below and build it once more
    return _finish(triples.select("graph_id", F.inline_outer(F.when(kind.isNull(), to_literal).otherwise(to_ref))), datatypes)


def _finish(facts: DataFrame, datatypes: DataFrame | None) -> DataFrame:
    literal = F.col("o_kind") == "literal"
    if datatypes is not None:  # one row for each property of an ontology; Spark broadcasts it while small
        facts = facts.join(datatypes.withColumnRenamed("prop_iri", "p"), "p", "left")
    else:
        facts = facts.withColumn("datatype", F.lit(None).cast("string"))
    kind = F.when(literal, F.coalesce("datatype", F.lit(XSD + "string")))
    name = lambda c: F.when(c.startswith("_:"), F.substring(c, 3, 1 << 30)).otherwise(c)
    s, o = name(F.col("s")), F.when(F.col("o_kind") == "bnode", name(F.col("o"))).otherwise(F.col("o"))
    return facts.select("graph_id", s.alias("s"), _kind(F.col("s")).alias("s_kind"), "p", o.alias("o"), "o_kind", kind.alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")).dropDuplicates()


def _escape(c):
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _term(value, kind, datatype=None, lang=None):
    out = F.when(kind == "bnode", F.concat(F.lit("_:"), value)).when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">")))
    if datatype is None:
        return out
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNull() | (datatype == XSD + "string"), "").otherwise(F.concat(F.lit("^^<"), datatype, F.lit(">")))
    return out.otherwise(F.concat(F.lit('"'), _escape(value), F.lit('"'), tail))


def to_ntriples(quads: DataFrame) -> DataFrame:
    """graph_id, value: a line for each quad; the parallel form of output."""
    line = F.concat_ws(" ", _term(F.col("s"), F.col("s_kind")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), _term(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang")), F.lit("."))
    return quads.select("graph_id", line.alias("value"))


def to_turtle(quads: DataFrame) -> DataFrame:
    """graph_id, s, value: a block of Turtle for each subject, predicates and objects in order."""
    o = _term(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang"))
    by_p = quads.groupBy("graph_id", "s", "s_kind", "p").agg(F.concat_ws(", ", F.array_sort(F.collect_set(o))).alias("os"))
    line = F.concat(F.when(F.col("p") == RDF + "type", "a").otherwise(F.concat(F.lit("<"), F.col("p"), F.lit(">"))), F.lit(" "), F.col("os"))
    blocks = by_p.groupBy("graph_id", "s", "s_kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", line.alias("line")))), lambda x: x["line"]), " ;\n    ").alias("body"))
    return blocks.select("graph_id", "s", F.concat(_term(F.col("s"), F.col("s_kind")), F.lit(" "), "body", F.lit(" .")).alias("value"))
