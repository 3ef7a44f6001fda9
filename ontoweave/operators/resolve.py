"""Entity resolution by label, and the entity registry.

Blank nodes get their graph's prefix, so that graphs can be one table; entities whose normalised labels are equal get one IRI: the
smallest named one, else the smallest blank.  The map is joined to subjects and objects; one pass, without chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.text import RDFS, normalize_label
from ontoweave.operators.closure import cut


def skolemize(quads: DataFrame) -> DataFrame:
    """Blank nodes renamed by their graph; equal names in two graphs are two nodes."""
    named = lambda c, kind: F.when(F.col(kind) == "bnode", F.concat(F.lit("chunk_"), F.col("graph_id").cast("string"), F.lit("_"), F.col(c))).otherwise(F.col(c))
    return quads.withColumns({"s": named("s", "s_kind"), "o": named("o", "o_kind")})


def labelled_entities(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("p") == RDFS + "label").select("s", "s_kind", normalize_label(F.col("o")).alias("norm_label"))


def resolution_map(entities: DataFrame) -> DataFrame:
    """iri, canonical, canonical_kind for the entities of labels that several share; an IRI of two labels follows the larger one."""
    named = F.struct((F.col("s_kind") == "bnode").alias("blank"), F.col("s").alias("iri"), F.col("s_kind").alias("kind"))
    groups = entities.groupBy("norm_label").agg(F.min(named).alias("best"), F.max(named).alias("other")).where("best <> other").select("norm_label", "best")
    mapped = entities.join(groups, "norm_label").groupBy(F.col("s").alias("iri")).agg(F.max_by("best", "norm_label").alias("best"))
    return mapped.where("iri <> best.iri").select("iri", F.col("best.iri").alias("canonical"), F.col("best.kind").alias("canonical_kind"))


def rewrite(quads: DataFrame, mapping: DataFrame) -> DataFrame:
    """Subjects and objects (not predicates, not literals) replaced by the map; equal quads once."""
    m = mapping.select("iri", "canonical", "canonical_kind")
    s = m.toDF("s", "_s", "_sk")
    o = m.select(F.col("iri").alias("_o_iri"), F.col("canonical").alias("_o"), F.col("canonical_kind").alias("_ok"))
    out = quads.join(s, "s", "left").join(o, (F.col("o_kind") != "literal") & (F.col("o") == F.col("_o_iri")), "left")
    columns = {"s": F.coalesce("_s", "s"), "s_kind": F.coalesce("_sk", "s_kind"), "o": F.coalesce("_o", "o"), "o_kind": F.coalesce("_ok", "o_kind")}
    return out.select(*(columns.get(c, F.col(c)).alias(c) for c in quads.columns)).drop("graph_id").dropDuplicates()


def merge_graphs(quads: DataFrame) -> DataFrame:
    """One resolved graph from the quads of many.

    Once blank nodes have their names, what many graphs say is one quad.  Quads and map are written, as both are read twice.
    """
    apart = cut(skolemize(quads).drop("graph_id").dropDuplicates())
    return rewrite(apart, cut(resolution_map(labelled_entities(apart).distinct())))


def entities_of_triples(triples: DataFrame, base: str = "http://example.org/") -> DataFrame:
    """run_id, norm_label, iri, label, types, found_in_chunk, confidence: each name at its first place (subjects before objects)."""
    from ontoweave.functions.text import generate_iri

    place = ["run_id", "chunk_idx", "ord"]
    subjects = triples.select(*place, F.lit(0).alias("role"), F.col("subject").alias("label"), F.col("subject_type").alias("type"))
    objects = triples.where("object.type is not null").select(*place, F.lit(1).alias("role"), F.col("object.value").alias("label"), F.col("object.type").alias("type"))
    first = subjects.unionByName(objects).groupBy("run_id", "chunk_idx", "label").agg(F.min(F.struct("ord", "role", "type")).alias("first"))
    name = F.col("label")
    return first.select("run_id", normalize_label(name).alias("norm_label"), generate_iri(name, base).alias("iri"), "label", F.array("first.type").alias("types"), F.col("chunk_idx").alias("found_in_chunk"), F.lit(1.0).alias("confidence"), F.col("first.ord").alias("ord"))


def last_write(entities: DataFrame, *order: str) -> DataFrame:
    """The registry's state: of each run and normalised label the entity written last."""
    keys = ["run_id", "norm_label"]
    rest = [c for c in entities.columns if c not in keys]
    return entities.groupBy(*keys).agg(F.max(F.struct(F.struct(*order).alias("_at"), *rest)).alias("e")).select(*keys, *(F.col("e")[c].alias(c) for c in rest))


def registry_fragment(entities: DataFrame) -> DataFrame:
    """run_id, lines: the prompt's list of known entities, by label."""
    line = F.concat(F.lit("- "), "label", F.lit(": "), "iri", F.lit(" ("), F.array_join("types", ", "), F.lit(")"))
    heads = F.array(F.lit("### Known Entities"), F.lit("We have already identified the following entities:"))
    return entities.groupBy("run_id").agg(F.concat(heads, F.transform(F.array_sort(F.collect_list(F.struct("label", line.alias("line")))), lambda x: x["line"])).alias("lines"))


def registry_to_json(entities: DataFrame) -> DataFrame:
    """run_id, json: entries of [key, entity], by key."""
    entry = F.struct("norm_label", F.struct("iri", "label", F.col("found_in_chunk").alias("foundInChunk"), "confidence", "types").alias("entity"))
    return entities.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("json"))


def registry_from_json(rows: DataFrame) -> DataFrame:
    kind = "array<struct<norm_label:string,entity:struct<iri:string,label:string,foundInChunk:int,confidence:double,types:array<string>>>>"
    entries = rows.select("run_id", F.inline(F.from_json("json", kind)))
    return entries.select("run_id", "norm_label", "entity.iri", "entity.label", "entity.types", F.col("entity.foundInChunk").alias("found_in_chunk"), "entity.confidence")
