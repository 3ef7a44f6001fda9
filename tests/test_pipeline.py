"""End-to-end plans and the command line."""

import pytest

from ontoweave.errors import ExtractionError
from ontoweave.operators import chunking, extract, ontology
from ontoweave.plans import pipeline
from ontoweave.sources import turtle

TTL = """@prefix : <http://example.org/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:Entity a owl:Class . :Person a owl:Class ; rdfs:subClassOf :Entity . :Place a owl:Class ; rdfs:subClassOf :Entity .
:mentionedWith a owl:ObjectProperty ; rdfs:domain :Entity ; rdfs:range :Place ."""


@pytest.fixture(scope="module")
def onto(spark):
    return ontology.build(turtle.turtle_quads(spark, TTL).cache())


def test_documents_to_graph(spark, onto):
    docs = spark.createDataFrame([("d1", "Ann Lee met Bob. Later Bob saw ANN LEE."), ("d2", "Bob left Rome.")], "doc_id string, text string")
    out = pipeline.run(docs, onto, how=chunking.semantic(1, 0))
    labels = {r.o for r in out.graph.collect() if r.p.endswith("label")}
    assert {"Ann Lee", "Bob", "Rome"} <= labels
    assert out.violations.where("category = 'DomainRange'").count() > 0
    kinds = {r.kind for r in out.events().collect()}
    assert kinds == {"LLMThinking", "JSONParsed", "RDFConstructed", "ValidationComplete"}
    assert out.prompt.system[0].startswith("Class: http")
    few = pipeline.run(docs, onto, strategy="Focused", focus_iris=["http://example.org/Place"])
    assert len(few.prompt.system) == 2


def test_evaluation(spark, onto, monkeypatch):
    rows = [("e1", "Ann met Bob.", [("Ann", "http://example.org/mentionedWith", "bob")]), ("e2", "x", [("A", "b", "C")])]
    entries = spark.createDataFrame(rows, "entry_id string, text string, triples array<struct<s:string,p:string,o:string>>")
    metrics, mean = pipeline.evaluate_entries(entries, onto)
    assert {r.entry_id: r.f1 for r in metrics.collect()} == {"e1": 1.0, "e2": 0.0} and mean.first().f1 == 0.5

    class Broken(extract.Phrases):
        def entities(self, text, classes):
            raise TimeoutError("late")

    monkeypatch.setattr(extract.time, "sleep", lambda s: None)
    metrics, _ = pipeline.evaluate_entries(entries, onto, Broken())
    assert metrics.where("error like 'TimeoutError%'").count() == 2



def test_provider():
    assert pipeline.provider("openai", {"VITE_OPENAI_API_KEY": "a", "OPENAI_API_KEY": "b"}).key == "a"
    with pytest.raises(ExtractionError):
        pipeline.provider("openai", {})
