"""Single-stage extraction, timeouts, look-ups, reports, run versions and merged batches."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ontoweave.errors import RunError
from ontoweave.operators import evaluate, extract, index, shacl
from ontoweave.streaming.runs import Runs, content_hash

CHUNKS = "run_id string, chunk_idx int, text string"


def test_stages(spark):
    class Slow(extract.Phrases):
        def entities(self, text, classes):
            time.sleep(5 if "late" in text else 0)
            return super().entities(text, classes)

    class OneStage(extract.Phrases):
        def triples(self, text, entities, properties):
            return [("Ann", "urn:P", "urn:knows", "Bob", "urn:P"), ("Ann", "urn:P", "urn:age", "7", None), ("Ann", "urn:X", "urn:knows", "Bob", "urn:P")]

    chunks = spark.createDataFrame([("r", 0, "Ann met Bob"), ("r", 1, "late Ann met Bob")], CHUNKS)
    rows = extract.extract(chunks, Slow(), retries=0, seconds=1.0).collect()
    assert [r.error is None for r in sorted(rows, key=lambda r: r.chunk_idx)] == [True, False] and "TimeoutError" in rows[1].error
    one = extract.extract(chunks.where("chunk_idx = 0"), OneStage(), classes=["urn:P"], properties=["urn:knows", "urn:age"], stages=1)
    assert {(r.subject_type, r.predicate) for r in one.collect()} == {("urn:P", "urn:knows"), ("urn:P", "urn:age")}
    answer = json.loads(extract.entity_json(one).first().json)["entities"]
    assert [e["@id"] for e in answer] == ["Ann"] and [p["predicate"] for p in answer[0]["properties"]] == ["urn:knows", "urn:age"]
    assert extract.entity_json(one.limit(0)).count() == 0


def test_index_lookups(spark):
    schema = "iri string, label string, definition string, children array<string>, parents array<string>"
    units = index.from_units(spark, [("urn:a", "A", "x", [], []), ("urn:b", "B", "y", ["urn:a"], []), ("urn:a", "Aa", "x", ["urn:c"], [])], schema)
    assert index.size(units) == 2 and index.has(units, "urn:a") and not index.has(units, "urn:z")
    assert [r.iri for r in index.keys(units).collect()] == ["urn:a", "urn:b"]
    assert index.where(units, F.col("label") == "Aa").first().children == ["urn:c"]
    assert index.with_columns(units, iri=F.lit("no"), label=F.lower("label")).where("iri = 'urn:b'").first().label == "b"
    assert index.size(index.from_units(spark, [], schema)) == 0


def test_totals_and_reports(spark):
    columns = "total_violations long, cardinality long, domain_range long, disjointness long, datatype long, other long, valid_triples long, constraint_rate double"
    rows = spark.createDataFrame([(3, 1, 1, 0, 1, 0, 7, 0.7), (0, 0, 0, 0, 0, 0, 5, 1.0)], columns)
    total = shacl.constraint_totals(rows).first()
    assert (total.total_violations, total.valid_triples, total.datatype, total.constraint_rate) == (3, 12, 1, 0.85)
    assert shacl.constraint_totals(rows.limit(0)).first().constraint_rate == 1.0
    triple = "entry_id string, idx int, s string, p string, o string"
    gold = spark.createDataFrame([("e", 0, "a", "http://x/p", "b"), ("e", 1, "a", "http://x/q", None)], triple)
    pred = spark.createDataFrame([("e", 0, "A", "p", "b"), ("f", 0, "a", "p|r", "c")], triple)
    metrics = evaluate.entry_metrics(pred, gold)
    assert {r.entry_id: (r.tp, r.fp, r.fn) for r in metrics.collect()} == {"e": (1, 0, 1), "f": (0, 1, 0)}
    text = evaluate.report(metrics, evaluate.top_missed(pred, gold), evaluate.top_missed(pred, gold, side="wrong"))
    assert "| e | 1 | 0 | 1 | 1.000 | 0.500 | 0.667 |" in text and "## Wrong predicates" in text


def test_runs_of_two_writers(spark, tmp_path):
    log = Runs(spark, f"file://{tmp_path}/runs")
    run = log.create("text", "h")
    assert log.update(run, 0, status="running") == 1
    assert log._claim(run, 2) and not log._claim(run, 2)
    with pytest.raises(RunError):
        log.update(run, 1, status="completed")  # another writer has the version
    quad = "graph_id string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"
    label = "http://www.w3.org/2000/01/rdf-schema#label"
    for k, name in enumerate(("one", "two")):
        log.save_batch(run, k, spark.createDataFrame([("g", "b0", "bnode", label, name, "literal", None, None)], quad))
    merged = log.merge(run, 2).collect()
    assert len({r.s for r in merged}) == 2 and log.batch(run, 1).first().o == "two"
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert content_hash(rows) == content_hash(rows.orderBy(F.desc("k"))) != content_hash(rows.limit(1))
