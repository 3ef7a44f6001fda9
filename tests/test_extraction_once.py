"""The rule's extraction by built-in functions, and one extraction for all that resolution reads."""

from ontoweave.operators import extract, rdf, resolve

TEXTS = [
    "Ann Lee met Bob. Later Bob saw ANN LEE  Bob and Ann Lee.",
    "École Élan; Été_1 Ünal² Þor ÐÆ x A B1 Ćd Dá E٣ Ⅷ Fⅷ",
    "Xࡰy Y࢏ Zꟑ Q\U0001e7e0r W\U00031350 \U00010400a K\U0001d7d8",  # letters that older tables lack, and beyond 16 bits
    "Aa " * 20_000 + "Bb" + " Cc" * 3 + ", Dd",
    "One",
    "",
    None,
]


def test_rule_by_functions_is_the_rule(spark):
    class Same(extract.Phrases):
        """Phrases as an extractor of a caller's own, which runs in Python."""

    chunks = spark.createDataFrame([("r", i, t) for i, t in enumerate(TEXTS)], "run_id string, chunk_idx int, text string")
    for how in ({}, {"classes": ["urn:B", "urn:A"], "properties": ["urn:p", "urn:q"]}, {"classes": ["http://example.org/Entity"]}, {"stages": 1}):
        here, there = extract.extract(chunks, **how), extract.extract(chunks, Same(), **how)
        assert here.schema.simpleString() == there.schema.simpleString()
        assert sorted(here.drop("error").collect(), key=str) == sorted(there.drop("error").collect(), key=str)
        assert here.where("error is not null").count() == 0
        plan = here._jdf.queryExecution().toString()
        assert "MapInPandas" not in plan and "MapInArrow" not in plan
    assert extract.extract(chunks).count() > 10


def test_extraction_is_asked_for_once(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counted(extract.Phrases):
        def entities(self, text, classes):
            calls.add(1)
            return extract.Phrases.entities(self, text, classes)

    chunks = spark.createDataFrame([("r", i, f"Ann met Bob {i}. Bob saw ann. Ann {i} saw Élan.") for i in range(20)], "run_id string, chunk_idx int, text string")
    triples = extract.extract(chunks, Counted()).withColumnRenamed("run_id", "graph_id")
    graph = {(r.s, r.p, r.o) for r in resolve.merge_graphs(rdf.triples_to_quads(triples)).collect()}
    assert calls.value == 20
    assert ("http://example.org/ann", "http://example.org/mentionedWith", "http://example.org/bob") in {(s, p, o[:22]) for s, p, o in graph}
