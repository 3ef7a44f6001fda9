"""End-to-end plans: documents and an ontology to a resolved, validated graph, and datasets to scores."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.errors import ExtractionError
from ontoweave.operators import chunking, closure, evaluate, extract, focus, ontology, rdf, render, resolve, search, shacl
from ontoweave.operators.ontology import Ontology

#: Providers of models with the names of their settings and the default model.
PROVIDERS = {
    "anthropic": ("ANTHROPIC_API_KEY", "claude-3-5-sonnet-20241022"),
    "openai": ("OPENAI_API_KEY", "gpt-4o"),
    "gemini": ("GEMINI_API_KEY", "gemini-2.0-flash"),
    "openrouter": ("OPENROUTER_API_KEY", "anthropic/claude-3.5-sonnet"),
}


@dataclass(frozen=True)
class Provider:
    """Which model an extractor should ask; the engine itself opens no connection."""

    name: str
    model: str
    key: str


def provider(name: str | None = None, env: dict | None = None) -> Provider:
    """Settings from the environment: VITE_X before X before the default."""
    env = os.environ if env is None else env
    get = lambda k, other=None: env.get(f"VITE_{k}") or env.get(k) or other
    name = name or get("LLM_PROVIDER", "anthropic")
    if name not in PROVIDERS:
        raise ExtractionError(f"unknown provider: {name}")
    setting, model = PROVIDERS[name]
    key = get(setting)
    if not key:
        raise ExtractionError(f"{setting} is not set")
    return Provider(name, get(f"{name.upper()}_MODEL", model), key)


@dataclass
class Extraction:
    """The tables of a run; triples and graph are written once, the others lazy."""

    chunks: DataFrame
    triples: DataFrame
    quads: DataFrame
    graph: DataFrame
    violations: DataFrame
    prompt: render.Prompt = field(default_factory=render.Prompt)

    def events(self) -> DataFrame:
        """kind, run_id, chunk_idx, count, detail: what happened, chunk by chunk and at the end."""
        none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
        thinking = self.chunks.select(F.lit("LLMThinking").alias("kind"), "run_id", "chunk_idx", zero.alias("count"), none.alias("detail"))
        parsed = self.triples.groupBy("run_id", "chunk_idx").agg(F.count_if(F.col("error").isNull()).alias("count"), F.max("error").alias("detail")).select(F.lit("JSONParsed").alias("kind"), "run_id", "chunk_idx", "count", "detail")
        built = self.graph.agg(F.count("*").alias("count")).select(F.lit("RDFConstructed").alias("kind"), none.alias("run_id"), F.lit(None).cast("int").alias("chunk_idx"), "count", none.alias("detail"))
        checked = self.violations.agg(F.count("*").alias("count")).select(F.lit("ValidationComplete").alias("kind"), none.alias("run_id"), F.lit(None).cast("int").alias("chunk_idx"), "count", F.when(F.col("count") == 0, "conforms").otherwise("violations").alias("detail"))
        return thinking.unionByName(parsed).unionByName(built).unionByName(checked)


def _datatypes(o: Ontology) -> DataFrame:
    ranges = o.class_props.select("class_iri", F.col("c.prop_iri").alias("prop_iri"), F.explode("c.ranges").alias("range"))
    free = o.universal_props.select(F.col("c.prop_iri").alias("prop_iri"), F.explode("c.ranges").alias("range"))
    return rdf.infer_datatypes(ranges, free)


def shape_rows(o: Ontology) -> DataFrame:
    return o.class_props.select("class_iri", F.col("c.prop_iri").alias("prop_iri"), F.col("c.label").alias("label"), F.col("c.ranges").alias("ranges"))


def focus_on(index: DataFrame, texts: DataFrame, known: DataFrame, most: int = 50) -> DataFrame:
    """The units that texts (query_id, text) are most similar to, with all their ancestors."""
    best = search.similar_documents(texts, focus.index_documents(index), most).select(F.col("id").alias("iri")).distinct()
    return index.join(focus.focused_iris(best, known), "iri", "left_semi")


def run(docs: DataFrame, o: Ontology, extractor=None, how: chunking.Chunking = chunking.PIPELINE, strategy: str = "Full", focus_iris: list[str] | None = None) -> Extraction:
    """docs (doc_id, text) through windows, a pruned vocabulary, extraction, quads, resolution and validation.

    The extractor must keep to the vocabulary of the selected units (their classes and properties).
    """
    spark = docs.sparkSession
    index = ontology.units(o)
    if strategy != "Full":
        start = spark.createDataFrame([(x,) for x in focus_iris or []], "iri string")
        index = focus.select_context(index, start, closure.closure(o.class_edges), strategy)
    classes, props = ontology.vocabulary_of_units(index, o.universal_props)
    if strategy == "Full":
        classes, props = ontology.vocabulary(o)
    class_list = [r.iri for r in classes.orderBy("iri").collect()]  # a schema's size
    prop_list = [r.iri for r in props.orderBy("iri").collect()]
    chunks = chunking.chunk(docs, how).select(F.col("doc_id").cast("string").alias("run_id"), F.col("idx").cast("int").alias("chunk_idx"), "text")
    triples = closure.cut(extract.extract(chunks, extractor, class_list, prop_list))  # an answer is asked for once
    good = triples.where("error is null").withColumn("graph_id", F.concat_ws("_", "run_id", F.col("chunk_idx").cast("string")))
    quads = rdf.triples_to_quads(good, _datatypes(o))
    graph = closure.cut(resolve.merge_graphs(quads))
    depths = closure.depths(o.classes, o.class_edges)
    return Extraction(chunks, triples, quads, graph, shacl.validate(graph, shape_rows(o)), render.structured_prompt(index, "topological", depths))


def evaluate_entries(entries: DataFrame, o: Ontology, extractor=None, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(metrics of each entry, their means) of extraction over entries (entry_id, text, triples); a failed entry scores zero."""
    chunks = entries.select(F.col("entry_id").alias("run_id"), F.lit(0).alias("chunk_idx"), "text")
    classes, props = ontology.vocabulary(o)
    triples = closure.cut(extract.extract(chunks, extractor, [r.iri for r in classes.collect()], [r.iri for r in props.collect()]))
    pred = triples.where("error is null").select(F.col("run_id").alias("entry_id"), F.col("ord").alias("idx"), F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object.value").alias("o"))
    gold = entries.select(F.col("entry_id").cast("string").alias("entry_id"), F.posexplode("triples").alias("idx", "t")).select("entry_id", "idx", "t.s", "t.p", "t.o")
    metrics = evaluate.entry_metrics(evaluate.semantic_only(pred), gold, mode)
    errors = triples.where("error is not null").select(F.col("run_id").alias("entry_id"), "error").distinct()
    metrics = metrics.join(errors, "entry_id", "left")
    return metrics, evaluate.macro(metrics)
