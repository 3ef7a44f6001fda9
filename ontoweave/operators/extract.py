"""Extraction of triples from chunks: a pluggable extractor run over partitions, and the vocabulary it must keep to.

An extractor is any object with ``entities(text, classes)`` and ``triples(text, entities, properties)``; a model behind a network
is one, and Phrases is a deterministic one.  Repartition chunks to bound how many run at once.  Phrases without a time limit are
built-in functions; what a caller plugs in runs in Python.
"""

from __future__ import annotations

import re
import threading
import time
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.errors import EmptyVocabularyError, ExtractionError
from ontoweave.functions.text import RDFS, XSD

#: Properties that any extraction may use.
CORE_ANNOTATIONS = [
    RDFS + "label",
    RDFS + "comment",
    RDFS + "seeAlso",
    "http://www.w3.org/2002/07/owl#sameAs",
    "http://purl.org/dc/terms/identifier",
    "http://purl.org/dc/terms/source",
    "http://www.w3.org/2004/02/skos/core#prefLabel",
    "http://www.w3.org/2004/02/skos/core#altLabel",
]
TRIPLE = "run_id string, chunk_idx int, ord int, subject string, subject_type string, predicate string, object struct<value:string,type:string>, error string"
_OBJECT = pa.struct([("value", pa.string()), ("type", pa.string())])
_ARROW = pa.schema([("run_id", pa.string()), ("chunk_idx", pa.int32()), ("ord", pa.int32()), ("subject", pa.string()), ("subject_type", pa.string()), ("predicate", pa.string()), ("object", _OBJECT), ("error", pa.string())])


@cache
def _java_word() -> str:
    r"""Python's \w as a Java class: letters, numbers and _, and what this Python's Unicode has beyond the tables of an older Java."""
    first, gap = 0x870, (0xD800, 0xE000)  # below it, the two agree since Java 17
    every = "".join([*map(chr, range(first, gap[0])), " " * (gap[1] - gap[0]), *map(chr, range(gap[1], 0x110000))])
    spans = [(m.start() + first, m.end() - 1 + first) for m in re.finditer(r"\w+", every)]
    return rf"[\p{{L}}\p{{N}}_[\x{{{first:X}}}-\x{{10FFFF}}&&[{''.join(rf'\x{{{a:X}}}-\x{{{b:X}}}' for a, b in spans)}]]]"


@dataclass(frozen=True)
class Phrases:
    """Capitalised phrases of a text as entities of one class; each is related to the next."""

    entity_class: str = "http://example.org/Entity"
    predicate: str = "http://example.org/mentionedWith"

    def entities(self, text: str, classes: list[str]) -> list[tuple[str, str]]:
        kind = self.entity_class if self.entity_class in classes or not classes else classes[0]
        found = re.findall(r"[A-ZÀ-ÖØ-Þ]\w+(?: [A-ZÀ-ÖØ-Þ]\w+)*", text)
        return [(name, kind) for name in dict.fromkeys(found)]

    def triples(self, text: str, entities: list[tuple[str, str]], properties: list[str]) -> list[tuple]:
        p = self.predicate if self.predicate in properties or not properties else properties[0]
        return [(a, ta, p, b, tb) for (a, ta), (b, tb) in zip(entities, entities[1:], strict=False)]

    def names(self, text: Column) -> Column:
        """The names of entities() as a column.  Possessive: a word never ends inside a word, and long runs of words need no stack."""
        word = _java_word()
        return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"[A-ZÀ-ÖØ-Þ]{word}++(?: [A-ZÀ-ÖØ-Þ]{word}++)*+"), F.lit(0)))


def _within(seconds: float | None, call, *args):
    """call(*args), or a TimeoutError after so many seconds (its thread is left to end by itself)."""
    if seconds is None:
        return call(*args)
    out: list = []

    def run():
        try:
            out.append((call(*args), None))
        except Exception as e:  # noqa: BLE001  raised below
            out.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise TimeoutError(f"no answer within {seconds} s")
    if out[0][1] is not None:
        raise out[0][1]
    return out[0][0]


def extract(chunks: DataFrame, extractor=None, classes: list[str] | None = None, properties: list[str] | None = None, retries: int = 2, pause: float = 2.0, seconds: float | None = None, stages: int = 2) -> DataFrame:
    """TRIPLE rows of chunks (run_id, chunk_idx, text) in two stages: entities, then triples among them and of their types only.

    With one stage the extractor is asked for triples without a list of entities, and any names of the classes count.  A stage that
    takes over ``seconds`` fails.  A chunk that fails after its retries gives one row with the error.  Rows outside the vocabulary
    are dropped.
    """
    extractor, classes, properties = extractor or Phrases(), list(classes or []), list(properties or [])
    allowed = {*properties, *CORE_ANNOTATIONS}

    def one(text):
        for turn in range(retries + 1):
            try:
                entities = _within(seconds, extractor.entities, text, classes) if stages == 2 else []
                entities = [e for e in entities if not classes or e[1] in classes]
                names, kinds = {e[0] for e in entities}, {e[1] for e in entities} if stages == 2 else set(classes)
                found = _within(seconds, extractor.triples, text, entities, properties)
                named = lambda name, kind: (stages == 1 or name in names) and (kind in kinds or not kinds)
                return [t for t in found if named(t[0], t[1]) and (t[4] is None or named(t[3], t[4])) and (not properties or t[2] in allowed)], None
            except Exception as e:  # noqa: BLE001  an extractor's failures are data
                if turn == retries:
                    return [], f"{type(e).__name__}: {e}"
                time.sleep(pause * 2**turn)

    def run(batches):
        for batch in batches:
            rows = []
            for run_id, idx, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found, error = one(text or "")
                rows += [(run_id, idx, k, s, st, p, (("value", o), ("type", ot)), None) for k, (s, st, p, o, ot) in enumerate(found)]
                if error:
                    rows.append((run_id, idx, -1, None, None, None, None, error))
            columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
            columns = [[dict(x) if x else None for x in c] if f.name == "object" else list(c) for c, f in zip(columns, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    chunks = chunks.select(F.col("run_id").cast("string").alias("run_id"), F.col("chunk_idx").cast("int").alias("chunk_idx"), "text")
    if type(extractor) is Phrases and seconds is None:
        return _phrases(chunks, extractor, classes, properties, stages)
    return chunks.mapInArrow(run, TRIPLE)


def _phrases(chunks: DataFrame, extractor: Phrases, classes: list[str], properties: list[str], stages: int) -> DataFrame:
    """extract() by built-in functions."""
    kind = F.lit(extractor.entity_class if extractor.entity_class in classes or not classes else classes[0])
    predicate = F.lit(extractor.predicate if extractor.predicate in properties or not properties else properties[0])
    names = chunks.select("run_id", "chunk_idx", extractor.names(F.coalesce("text", F.lit(""))).alias("_n"))
    most = F.greatest(F.size("_n") - 1, F.lit(0)) if stages == 2 else F.lit(0)
    pairs = F.arrays_zip(F.slice("_n", 1, most).alias("a"), F.slice("_n", 2, most).alias("b"))
    # outer, since Spark would put a filter on the size below the names and find them once more for it
    rows = names.select("run_id", "chunk_idx", F.posexplode_outer(pairs).alias("ord", "_p")).where("_p is not null")
    of = F.struct(F.col("_p.b").alias("value"), kind.alias("type"))
    return rows.select("run_id", "chunk_idx", "ord", F.col("_p.a").alias("subject"), kind.alias("subject_type"), predicate.alias("predicate"), of.alias("object"), F.lit(None).cast("string").alias("error"))


def entity_json(triples: DataFrame) -> DataFrame:
    """run_id, chunk_idx, json: the answer of a chunk as a list of entities with their properties, by name."""
    value = F.when(F.col("object.type").isNull(), F.to_json(F.struct(F.col("object.value").alias("v")))).otherwise(F.to_json(F.struct(F.struct(F.col("object.value").alias("@id")).alias("v"))))
    prop = F.struct("predicate", F.get_json_object(value, "$.v").alias("object"), F.col("object.type").isNotNull().alias("reference"))
    entities = triples.where("error is null").groupBy("run_id", "chunk_idx", "subject").agg(F.min("subject_type").alias("kind"), F.array_sort(F.collect_list(F.struct("ord", prop.alias("p")))).alias("ps"))
    entity = F.struct(F.col("subject").alias("@id"), F.col("kind").alias("@type"), F.transform("ps", lambda x: x["p"]).alias("properties"))
    return entities.groupBy("run_id", "chunk_idx").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entity)).alias("entities"))).alias("json"))


def within_vocabulary(triples: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Triples whose types and predicates are in the vocabulary (tables of iri); core annotations always are."""
    if not classes.limit(1).count():
        raise EmptyVocabularyError("no classes")
    core = properties.sparkSession.createDataFrame([(x,) for x in CORE_ANNOTATIONS], "iri string")
    kept = triples.join(properties.select("iri").unionByName(core).distinct().withColumnRenamed("iri", "predicate"), "predicate", "left_semi")
    kept = kept.join(classes.select(F.col("iri").alias("subject_type")).distinct(), "subject_type", "left_semi")
    kind = classes.select(F.col("iri").alias("_type")).distinct()
    typed = kept.where("object.type is not null").join(kind, F.col("object.type") == F.col("_type"), "left_semi")
    return typed.unionByName(kept.where("object.type is null"))


def json_schema(classes: list[str], properties: list[str], strict_ranges: dict[str, list[str]] | None = None) -> dict:
    """The JSON schema of an answer: enums are the vocabulary; with ranges, each property's object is a value or a reference."""
    if not classes or not properties:
        raise EmptyVocabularyError("an answer's schema needs classes and properties")
    names = [*dict.fromkeys([*properties, *CORE_ANNOTATIONS])]
    text, ref = {"type": "string"}, {"type": "object", "properties": {"@id": {"type": "string"}}, "required": ["@id"]}

    def prop(name, value):
        return {"type": "object", "properties": {"predicate": name, "object": value}, "required": ["predicate", "object"]}

    if strict_ranges is None:
        item = prop({"type": "string", "enum": names}, {"anyOf": [text, ref]})
    else:
        literal = lambda p: not strict_ranges.get(p) or any(r.startswith((XSD, "xsd:")) for r in strict_ranges[p])
        item = {"anyOf": [prop({"const": p}, text if literal(p) else ref) for p in names]}
    entity = {"type": "object", "properties": {"@id": {"type": "string"}, "@type": {"type": "string", "enum": classes}, "properties": {"type": "array", "items": item}}, "required": ["@id", "@type", "properties"]}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "properties": {"entities": {"type": "array", "items": entity}}, "required": ["entities"]}


def dereference(schema: dict) -> dict:
    """A schema without $ref; a reference within itself is marked."""
    defs = schema.get("$defs", schema.get("definitions", {}))

    def walk(x, inside):
        if isinstance(x, list):
            return [walk(y, inside) for y in x]
        if not isinstance(x, dict):
            return x
        if "$ref" in x:
            name = x["$ref"].rpartition("/")[2]
            if name in inside:
                return {"$circular": name}
            if name not in defs:
                raise ExtractionError(f"unknown reference {x['$ref']}")
            return walk(defs[name], inside | {name})
        return {k: walk(v, inside) for k, v in x.items() if k not in ("$defs", "definitions")}

    return walk(schema, frozenset())


def schema_stats(schema: dict) -> dict:
    """Numbers of classes and properties, size in characters, and depth of a schema."""
    import json

    enums, depth = [], 0
    stack = [(schema, 1)]
    while stack:
        x, d = stack.pop()
        depth = max(depth, d)
        if isinstance(x, dict):
            if isinstance(x.get("enum"), list):
                enums.append(x["enum"])
            stack += [(v, d + 1) for v in x.values()]
        elif isinstance(x, list):
            stack += [(v, d + 1) for v in x]
    core = [len(e) for e in enums if CORE_ANNOTATIONS[0] in e]
    return {"class_count": sum(len(e) for e in enums if CORE_ANNOTATIONS[0] not in e), "property_count": sum(core), "total_size": len(json.dumps(schema)), "complexity": depth}
