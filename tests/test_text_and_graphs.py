"""Chunks, names, quads, resolution, search, scoring, datasets and runs."""

import json

import pytest
from pyspark.sql import functions as F

from ontoweave.errors import ChunkingError, CheckpointError, EmptyVocabularyError, NlpError, RunError
from ontoweave.functions import text as X
from ontoweave.operators import chunking, evaluate, extract, metadata, rdf, resolve, search
from ontoweave.sources import datasets, turtle
from ontoweave.streaming import runs


def test_windows_match_the_loop(spark):
    texts = [(n, "".join(chr(97 + k % 26) for k in range(n))) for n in range(0, 25)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    for w, o in ((1, 0), (4, 1), (5, 4), (7, 0)):
        want = set()
        for n, t in texts:
            at = idx = 0
            while n:
                want.add((n, idx, t[at : at + w], at, min(at + w, n)))
                if at + w >= n:
                    break
                at, idx = at + w - o, idx + 1
        assert {tuple(r) for r in chunking.chunk_characters(docs, chunking.character(w, o)).collect()} == want
    with pytest.raises(ChunkingError):
        chunking.character(3, 3)


def test_sentences(spark):
    docs = spark.createDataFrame([(1, "One. Two!  Three? Four"), (2, ""), (3, None)], "doc_id int, text string")
    got = [tuple(r) for r in chunking.chunk_sentences(docs, chunking.PIPELINE).orderBy("idx").collect()]
    assert got == [(1, 0, "One. Two! Three?", 0, 2), (1, 1, "Three? Four", 2, 3)]


def test_names(spark):
    names = ["Stanford University", "Alice & Bob", "  Bob  ", "", "Zürich 田"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(X.sanitize_name(F.col("n"))).collect()] == ["stanford_university", "alice__bob", "bob", "", "zrich_"]
    iris = spark.createDataFrame([("http://a/b#c",), ("http://xmlns.com/foaf/0.1/Person",), ("plain",), ("urn:x/birthPlace",)], "i string")
    rows = iris.select(X.local_name(F.col("i")), X.abbreviate_iri(F.col("i")), X.label_from_iri(F.col("i")), X.extract_label(F.col("i"))).collect()
    assert [tuple(r) for r in rows] == [("c", "http://a/b#c", "c", "c"), ("Person", "foaf:Person", "Person", "Person"), ("plain", "plain", "plain", "plain"), ("urn:x/birthPlace", "urn:x/birthPlace", "birth Place", "birthPlace")]


def _graph(spark, k, text):
    return turtle.turtle_quads(spark, "@prefix : <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . " + text, str(k))


def test_resolution(spark):
    quads = _graph(spark, 0, ':j rdfs:label "John Doe" ; :age 5 . _:x rdfs:label "Alice" ; :knows :j .').union(_graph(spark, 1, '_:x rdfs:label "john doe!" ; :city "X" . :a rdfs:label " ALICE " . :z rdfs:label "Zed" .'))
    got = {(r.s, r.p, r.o) for r in resolve.merge_graphs(quads).collect()}
    assert ("http://e/j", "http://e/city", "X") in got and ("http://e/a", "http://e/knows", "http://e/j") in got
    assert {s for s, _, _ in got} == {"http://e/j", "http://e/a", "http://e/z"}


def test_registry(spark):
    obj = lambda v, t: {"value": v, "type": t}
    rows = [("r", 0, 0, "Ann", "T", "p", obj("Bob", "U")), ("r", 0, 1, "Bob", "V", "p", obj("lit", None)), ("r", 2, 0, "ANN", "W", "p", obj("x", None))]
    triples = spark.createDataFrame(rows, "run_id string, chunk_idx int, ord int, subject string, subject_type string, predicate string, object struct<value:string,type:string>")
    state = resolve.last_write(resolve.entities_of_triples(triples), "found_in_chunk", "ord")
    got = {r.norm_label: (r.label, r.types, r.found_in_chunk) for r in state.collect()}
    assert got == {"ann": ("ANN", ["W"], 2), "bob": ("Bob", ["U"], 0)}
    back = resolve.registry_from_json(resolve.registry_to_json(state))
    assert {r.norm_label for r in back.collect()} == {"ann", "bob"} and back.count() == 2
    assert resolve.registry_fragment(state).first().lines[2] == "- ANN: http://example.org/ann (W)"


def test_turtle_round_trip(spark):
    quads = _graph(spark, 0, ':a a :T ; :p "q\\"\\\\\\n" , "x"@en , 5 , _:b . _:b :p :a .')
    text = "\n".join(r.value for r in rdf.to_turtle(quads).collect())
    lines = "\n".join(r.value for r in rdf.to_ntriples(quads).collect())
    want = {tuple(r)[1:] for r in quads.collect()}
    assert set(turtle.parse_turtle(text)) == want == set(turtle.parse_turtle(lines))


def test_bm25(spark):
    docs = spark.createDataFrame([("a", "cats chase mice"), ("b", "dogs chase cats and dogs"), ("c", "birds sing"), ("d", "mice eat cheese")], "id string, text string")
    got = search.Bm25(docs).search(spark.createDataFrame([(1, "dogs and mice"), (2, "zebra")], "query_id int, text string"), most=2)
    assert [r.id for r in got.orderBy("rank").collect()][0] == "b" and got.count() == 2
    with pytest.raises(NlpError):
        search.Bm25(docs.limit(2))


def _score(pred, gold, mode):
    def norm(x):
        import re

        if "://" in x:
            x = x.rpartition("#" if "#" in x else "/")[2]
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", x.replace("_", " ").lower().strip()))

    def sim(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, last = [i], prev
            for j, y in enumerate(b, 1):
                prev.append(min(last[j] + 1, prev[-1] + 1, last[j - 1] + (x != y)))
        return 1 - prev[-1] / max(len(a), len(b)) if a or b else 1.0

    hit = set()
    for p in pred:
        best = None
        for g in gold:
            c = 1.0 * all(norm(x) == norm(y) for x, y in zip(p, g, strict=True)) if mode == "strict" else sum(sim(norm(x), norm(y)) for x, y in zip(p, g, strict=True)) / 3
            if c >= 0.8 and (best is None or c > best[0]):
                best = (c, gold.index(g))
        if best:
            hit.add(best[1])
    return len(hit), len(pred) - len(hit), len(gold) - len(hit)


def test_scoring_matches_the_loop(spark):
    import random

    rng = random.Random(3)
    words = ["http://e/John_Doe", "john doe", "Jon Doe", "x#y", "knows", "Knows!", "loves", "Bob"]
    some = lambda: [tuple(rng.choice(words) for _ in range(3)) for _ in range(rng.randint(0, 6))]
    entries = {k: (some(), some()) for k in range(40)}
    frame = lambda side: spark.createDataFrame([(k, i, *t) for k, e in entries.items() for i, t in enumerate(e[side])], "entry_id int, idx int, s string, p string, o string")
    for mode in ("strict", "relaxed"):
        got = {r.entry_id: (r.tp, r.fp, r.fn) for r in evaluate.entry_metrics(frame(0), frame(1), mode).collect()}
        assert got == {k: _score(*e, mode) for k, e in entries.items() if e[0] or e[1]}
    reasons = evaluate.mismatch_reasons(frame(0), frame(1))
    assert reasons.where("reason is null").count() == 0


def test_datasets(spark, tmp_path):
    (tmp_path / "w.xml").write_text('<benchmark><entries><entry eid="Id1" category="C"><modifiedtripleset><mtriple>A | b | C d</mtriple><mtriple>bad</mtriple></modifiedtripleset><lex>One.</lex><lex>Two.</lex></entry><entry eid="Id2" category="C"><modifiedtripleset><mtriple>x | y</mtriple></modifiedtripleset><lex>t</lex></entry></entries></benchmark>')
    row = datasets.load(spark, "webnlg", str(tmp_path / "w.xml")).collect()
    assert [(r.entry_id, r.text, [tuple(t) for t in r.triples]) for r in row] == [("Id1", "One. Two.", [("A", "b", "C d")])]
    (tmp_path / "r.jsonl").write_text('{"id":"k","text":"t","triplets":[{"subject":"a","predicate":"b","object":"c"}]}\n\n{"text":"u","triplets":[]}\n')
    assert [r.entry_id for r in datasets.load(spark, "rebel", str(tmp_path / "r.jsonl")).collect()] == ["k", "rebel-1"]
    (tmp_path / "d.json").write_text(json.dumps([{"title": "T", "sents": [["a", "b"], ["c"]], "vertexSet": [[{"name": "A"}, {"name": "x"}], [{"name": "B"}]], "labels": [{"r": "P1", "h": 0, "t": 1}, {"r": "P2", "h": 1, "t": 5}]}]))
    rel = spark.createDataFrame([("P1", "capital")], "code string, name string")
    got = datasets.read_docred(spark, str(tmp_path / "d.json"), rel).first()
    assert got.text == "a b c" and [tuple(t) for t in got.triples] == [("A", "capital", "B"), ("B", "P2", "Entity5")]
    (tmp_path / "s.json").write_text('{"doc_key":"d","sentences":[["a","b"],["c","d"]],"relations":[[[0,1,3,3,"USED"]],[]]}\n')
    got = datasets.load(spark, "scierc", str(tmp_path / "s.json"))
    assert [tuple(t) for t in got.first().triples] == [("a b", "USED", "d")] and datasets.gold(got).count() == 1


def test_extraction(spark):
    chunks = spark.createDataFrame([("r", 0, "Alice Smith met Bob in Paris."), ("r", 1, None)], "run_id string, chunk_idx int, text string")
    got = extract.extract(chunks)
    assert [(r.subject, r.object.value) for r in got.orderBy("ord").collect()] == [("Alice Smith", "Bob"), ("Bob", "Paris")]

    class Broken(extract.Phrases):
        def triples(self, text, entities, properties):
            raise ValueError("no answer")

    assert extract.extract(chunks, Broken(), retries=0).where("error like 'ValueError%'").count() == 2
    vocabulary = spark.createDataFrame([("http://example.org/Entity",)], "iri string")
    assert extract.within_vocabulary(got, vocabulary, vocabulary).count() == 0
    schema = extract.json_schema(["C1", "C2"], ["p"])
    assert extract.schema_stats(schema)["class_count"] == 2
    with pytest.raises(EmptyVocabularyError):
        extract.json_schema([], [])
    assert extract.dereference({"$defs": {"A": {"x": {"$ref": "#/$defs/A"}}}, "y": {"$ref": "#/$defs/A"}}) == {"y": {"x": {"$circular": "A"}}}


def test_costs(spark):
    df = spark.createDataFrame([("gpt-4o", 1_000_000, 2_000_000), ("other", 5, 5)], "model string, input_tokens long, output_tokens long")
    assert {r.model: r.cost for r in metadata.cost_by_model(df).collect()} == {"gpt-4o": 22.5, "other": 0.0}


def test_runs(spark, tmp_path):
    log = runs.Runs(spark, "file://" + str(tmp_path))
    run = log.create("some text", "h", "run1")
    assert log.artifact(run, "input_text") == "some text" and log.state(run).status == "queued"
    with pytest.raises(RunError):
        log.create("again", "h", "run1")
    with pytest.raises(RunError):
        log.update(run, expected_version=7, status="running")
    chunks = spark.createDataFrame([(k, f"Name{k} Person{k % 2}. Other") for k in range(5)], "idx int, text string")
    seen = []

    def process(batch):
        seen.append(batch.count())
        if len(seen) == 2 and fail:
            raise ValueError("executor lost")
        triples = extract.extract(batch.select(F.lit(run).alias("run_id"), F.col("idx").alias("chunk_idx"), "text"))
        return rdf.triples_to_quads(triples.withColumn("graph_id", F.col("chunk_idx").cast("string")))

    fail = False
    merged = log.run(run, chunks, process, batch_size=2)
    assert seen == [2, 2, 1] and log.state(run).status == "completed" and merged.count() > 0
    assert log.run(run, chunks, process, batch_size=2).count() == merged.count() and len(seen) == 3
    with pytest.raises(CheckpointError):
        log.merge(run, 9)
    seen, fail = [], True
    second = log.create("t", "h", "run2")
    with pytest.raises(ValueError):
        log.run(second, chunks, process, batch_size=2)
    assert log.state(second).status == "failed" and log.completed_batches(second) == [0]
    log.delete_artifacts(run)
    assert log.artifact(second, "input_text") == "t" and log.artifact(run, "input_text") is None
