"""Turtle, ontology tables, hierarchy and lattice."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoweave.errors import GraphCycleError, MeetError, ParseError
from ontoweave.functions.text import OWL, RDF, RDFS, XSD
from ontoweave.operators import closure, focus, index, lattice, metadata, ontology, render, shacl
from ontoweave.operators.lattice import Constraint, Hierarchy, meet, refines
from ontoweave.sources import turtle

ZOO = """
@prefix : <http://zoo.org/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:Thing a owl:Class ; rdfs:label "Thing" .
:Animal a owl:Class ; rdfs:subClassOf :Thing .
:Pet a owl:Class ; rdfs:subClassOf :Thing ; owl:disjointWith :Wild .
:Wild a owl:Class ; rdfs:subClassOf :Animal .
:Dog a owl:Class ; rdfs:label "Dog"@en ; rdfs:subClassOf :Animal , :Pet , [ a owl:Restriction ; owl:onProperty :owner ; owl:minCardinality 1 ] .
:Wolf a owl:Class ; rdfs:subClassOf :Wild ; owl:unionOf ( :Dog :Wild ) .
:owner a owl:ObjectProperty ; rdfs:domain :Pet ; rdfs:range :Person .
:name a owl:DatatypeProperty , owl:FunctionalProperty ; rdfs:domain :Thing ; rdfs:range xsd:string .
:nick a owl:DatatypeProperty ; rdfs:subPropertyOf :name .
:free a owl:ObjectProperty , owl:SymmetricProperty .
"""
Z = "http://zoo.org/"


@pytest.fixture(scope="module")
def zoo(spark):
    return ontology.build(turtle.turtle_quads(spark, ZOO).cache())


def test_turtle_terms():
    text = """PREFIX e: <http://e/> @base <http://b/x/> .
    e:a a e:T ; e:p "x\\n\\"y\\"" , 'z'@en-GB , 1 , -2.5 , 1e3 , true , "5"^^e:d ; e:q [ e:r ( 1 e:b ) ] ; . # note
    <rel> e:p \"\"\"long "quoted"
text\"\"\" . _:n1 e:p _:n1 . [] e:p () ."""
    rows = turtle.parse_turtle(text)
    objects = {(r[3], r[5], r[6]) for r in rows if r[2] == "http://e/p"}
    assert {('x\n"y"', XSD + "string", None), ("z", RDF + "langString", "en-GB"), ("1", XSD + "integer", None), ("-2.5", XSD + "decimal", None), ("1e3", XSD + "double", None), ("true", XSD + "boolean", None), ("5", "http://e/d", None), ('long "quoted"\ntext', XSD + "string", None), (RDF + "nil", None, None)} <= objects
    assert ("http://b/x/rel", "iri") in {r[:2] for r in rows} and sum(r[2] == RDF + "first" for r in rows) == 2
    for bad in ("e:a e:b e:c .", "<a> <b> .", '<a> <b> "x', "<a> <b> <c>", "?", '"lit" <p> <o> .'):
        with pytest.raises(ParseError):
            turtle.parse_turtle(bad)


def test_turtle_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.ttl").write_text(f"<http://e/{k}> <http://e/p> <http://e/o> .")
    assert turtle.read_turtle(spark, str(tmp_path)).count() == 3
    spark.dataSource.register(turtle.TurtleSource)
    assert spark.read.format("turtle").load(str(tmp_path)).select("graph_id").distinct().count() == 3


def test_tables(zoo):
    assert {r.iri: r.label for r in zoo.classes.collect()} == {Z + k: {"Thing": "Thing", "Dog": "Dog"}.get(k, Z + k) for k in ("Thing", "Animal", "Pet", "Wild", "Dog", "Wolf")}
    assert zoo.class_edges.count() == 6 and zoo.disjoint.count() == 2
    props = {(r.class_iri.removeprefix(Z), r.c.prop_iri.removeprefix(Z), r.c.source) for r in zoo.class_props.collect()}
    assert props == {("Pet", "owner", "domain"), ("Thing", "name", "domain"), ("Thing", "nick", "domain"), ("Dog", "owner", "restriction")}
    name = zoo.class_props.where(F.col("c.prop_iri") == Z + "name").first().c
    assert (name.max_card, name.ranges) == (1, [XSD + "string"])
    free = zoo.universal_props.collect()
    assert [r.c.prop_iri for r in free] == [Z + "free"] and free[0].c.is_symmetric
    assert [tuple(e) for e in zoo.classes.where(F.col("iri") == Z + "Wolf").first().expressions] == [("UnionOf", [Z + "Dog", Z + "Wild"])]
    assert tuple(ontology.inspect(zoo).first()) == (6, 3, 1)


def test_effective_properties(zoo):
    got = {(r.class_iri.removeprefix(Z), r.c.prop_iri.removeprefix(Z)): (r.own, r.c.min_card, r.c.ranges) for r in ontology.effective_properties(zoo).collect()}
    assert got["Dog", "owner"] == (True, 1, [Z + "Person"]) and got["Wolf", "name"] == (False, 0, [XSD + "string"])
    assert ("Animal", "owner") not in got
    units = {r.iri.removeprefix(Z): r for r in ontology.units(zoo).collect()}
    assert [c.prop_iri for c in units["Dog"].inherited] == [Z + "name", Z + "nick"] and units["Thing"].children == [Z + "Animal", Z + "Pet"]
    assert units["Wild"].definition.endswith("(no properties)")


def test_ancestor_order_is_nearest_last():
    assert ontology.ancestor_order({"D": ["B", "C"], "B": ["E"], "C": ["A"]}, "D") == ["E", "B", "A", "C"]


@pytest.mark.parametrize("few", [0, 1000])
def test_closure_of_chains_diamonds_and_cycles(spark, monkeypatch, few):
    monkeypatch.setattr(closure, "FEW", few)
    chain = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(99)], "child string, parent string")
    known = closure.closure(chain)
    assert known.count() == 99 * 100 // 2 and known.where("child = 'n000'").agg(F.max("hi")).first()[0] == 99
    diamond = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "x"), ("x", "a")], "child string, parent string")
    row = closure.closure(diamond).where("child = 'd' and parent = 'a'").first()
    assert (row.lo, row.hi) == (2, 3)
    classes = spark.createDataFrame([(x,) for x in "abcdx"], "iri string")
    paths = {tuple(r.path) for r in closure.paths(classes, diamond).collect()}
    assert ("a", "b", "d") in paths and ("a", "x", "c", "d") in paths and len(paths) == 6
    prompts = {r.iri: r.system for r in render.path_prompts(closure.paths(classes, diamond), classes.selectExpr("iri", "iri as definition")).collect()}
    assert prompts["a"].count("d") == 2 and prompts["a"][0] == "a"
    with pytest.raises(GraphCycleError):
        closure.closure(diamond.union(spark.createDataFrame([("a", "d")], "child string, parent string")))


def test_disjointness(spark, zoo):
    known = closure.closure(zoo.class_edges)
    pairs = spark.createDataFrame([(Z + a, Z + b) for a, b in (("Dog", "Wolf"), ("Dog", "Pet"), ("Animal", "Pet"), ("Dog", "Dog"))], "a string, b string")
    got = {(r.a.removeprefix(Z), r.b.removeprefix(Z)): r.relation for r in closure.disjointness(pairs, zoo.classes, known, zoo.disjoint).collect()}
    assert got == {("Dog", "Wolf"): "Disjoint", ("Dog", "Pet"): "Overlapping", ("Animal", "Pet"): "Unknown", ("Dog", "Dog"): "Overlapping"}
    h = ontology.hierarchy(zoo)
    assert h.relation(Z + "Dog", Z + "Wolf") == "Disjoint" and h.subclass(Z + "Wolf", Z + "Thing")


H = Hierarchy({"Dog": frozenset({"Animal", "Thing"}), "Cat": frozenset({"Animal", "Thing"}), "Animal": frozenset({"Thing"}), "Person": frozenset({"Thing"}), "Employee": frozenset({"Person", "Thing"})}, frozenset({("Animal", "Person"), ("Dog", "Cat")}))
CLASSES = ["Thing", "Animal", "Dog", "Cat", "Person", "Employee"]


@st.composite
def constraints(draw):
    low = draw(st.integers(0, 4))
    high = draw(st.one_of(st.none(), st.integers(low, 8)))
    return Constraint("p", "p", (), tuple(draw(st.sets(st.sampled_from(CLASSES), max_size=2))), low, high, tuple(draw(st.sets(st.sampled_from("xyz"), max_size=2))))


@settings(max_examples=300, deadline=None)
@given(constraints(), constraints())
def test_lattice_laws(a, b):
    assert meet(a, a, H).meaning() == a.meaning()
    both = meet(a, b, H)
    assert both.meaning() == meet(b, a, H).meaning() or both.is_bottom == meet(b, a, H).is_bottom
    assert meet(a, lattice.top("p"), H).meaning() == a.meaning()
    assert meet(a, lattice.bottom("p"), H).is_bottom
    if not both.is_bottom:
        assert both.min_card == max(a.min_card, b.min_card) and both.max_card == lattice.least_bound(a.max_card, b.max_card)
    assert refines(a, a, H) and refines(a, lattice.top("p"), H) and refines(lattice.bottom("p"), a, H)


def test_lattice_cases():
    c = lambda *r, **k: Constraint("p", ranges=r, **k)
    assert meet(c("Animal"), c("Dog"), H).ranges == ("Dog",)
    assert meet(c("Animal"), c("Person"), H).is_bottom
    assert meet(c(min_card=2), c(max_card=1), H).is_bottom
    assert meet(c(allowed_values=("a", "b")), c(allowed_values=("b", "c")), H).allowed_values == ("b",)
    with pytest.raises(MeetError):
        meet(c(), Constraint("q"), H)


def test_index_laws(spark):
    rng = random.Random(0)
    kind = f"iri string, label string, definition string, properties array<{ontology.CONSTRAINT}>, inherited array<{ontology.CONSTRAINT}>, children array<string>, parents array<string>"

    def some():
        rows = []
        for iri in rng.sample("abcdef", 3):
            c = [(p, p, [], [], rng.randint(0, 2), None, [], "domain", False, False, False) for p in rng.sample("pqr", 2)]
            rows.append((iri, rng.choice(["x", "yy", "zz"]), rng.choice(["d", "dd"]), c, [], sorted(rng.sample("uvw", 2)), []))
        return spark.createDataFrame(rows, kind)

    canon = lambda df: sorted(map(str, df.collect()))
    a, b, c = some(), some(), some()
    assert canon(index.combine(index.combine(a, b), c)) == canon(index.combine(a, index.combine(b, c))) == canon(index.combine(c, b, a))
    assert canon(index.combine(a, a)) == canon(index.combine(a))
    assert index.combine(a, a.limit(0)).count() == a.count()
    text = index.render_diff(index.diff(a, b))
    assert text.startswith("Index Diff:\n  Kept: ")


def test_focus_and_metadata(spark, zoo):
    units = ontology.units(zoo).cache()
    known = closure.closure(zoo.class_edges)
    dog = spark.createDataFrame([(Z + "Dog",)], "iri string")
    size = lambda s, **k: focus.select_context(units, dog, known, s, **k).count()
    assert (size("Full"), size("Focused"), size("Neighborhood"), size("Focused", max_ancestor_depth=1)) == (6, 4, 4, 3)
    ranges = zoo.class_props.select("class_iri", F.explode("c.ranges").alias("range"))
    assert focus.select_minimal(units, dog, known, ranges).count() == 4
    depths = closure.depths(zoo.classes, zoo.class_edges)
    assert {r.iri.removeprefix(Z): (r.min_depth, r.max_depth) for r in depths.collect()}["Wolf"] == (3, 3)
    assert index.stats(units, depths).first().max_depth == 4
    rows = metadata.class_summaries(units, depths).collect()
    assert len(rows) == 6 and metadata.summary_markdown(rows[0].asDict()).startswith("# ")
    assert metadata.bands(depths).where("band = 'Root'").count() == 1
    pieces = render.fragments(units, depths)
    assert render.fragment_stats(pieces).where("fragment_type = 'class_definition'").first().n == 6
    prompt = render.structured_prompt(units, "topological", depths, context=["known"])
    text = render.render_extraction_prompt(prompt + render.Prompt(examples=["e"]), "Some text")
    assert text.startswith("=== SYSTEM INSTRUCTIONS ===\nClass: Thing") and "=== CONTEXT ===\nknown" in text and text.endswith("relationships.")
    assert metadata.hierarchy_json(metadata.hierarchy(zoo.classes, zoo.class_edges)).count("Dog") == 1
    classes, props = ontology.vocabulary(zoo)
    assert (classes.count(), props.count()) == (6, 4)


def test_constraint_text(spark):
    c = [("http://x#p", "p", [], ["http://x#Dog", "http://x#Cat"], 1, 2, ["a"], "domain", True, False, False), ("http://x/q", None, [], [], 0, None, [], "domain", False, False, False), ("r", "r", [], [], 1, 0, [], "refined", False, False, False), ("s", "s", [], [], 2, 2, [], "domain", False, False, False)]
    df = spark.createDataFrame([(x,) for x in c], f"c {ontology.CONSTRAINT}")
    got = [r[0] for r in df.select(render.property_line(F.col("c"))).collect()]
    assert got == ["  - p: Dog AND Cat (required, at least 1 value, at most 2 values; symmetric; allowed values: a)", "  - q: (any type, unconstrained)", "  - r: ⊥ UNSATISFIABLE (contradictory constraints)", "  - s: any (required exactly 2 values)"]


def test_shapes_and_validation(spark, zoo):
    props = zoo.class_props.select("class_iri", F.col("c.prop_iri").alias("prop_iri"), F.col("c.label").alias("label"), F.col("c.ranges").alias("ranges"))
    text = "\n".join(r.value for r in shacl.shapes_turtle(shacl.property_shapes(props)).collect())
    assert f"sh:datatype <{XSD}string>" in text and f"sh:class <{Z}Person>" in text
    quads = turtle.turtle_quads(spark, "@prefix : <http://zoo.org/> . :rex a :Pet , :Wild ; :owner :ann , :bob , \"x\" . :ann a :Person . :t a :Thing ; :name 5 , \"ok\" .")
    got = {(r.focus_node.removeprefix(Z), r.path.removeprefix(Z), r.category) for r in shacl.validate(quads, props).collect()}
    assert got == {("rex", "owner", "DomainRange"), ("t", "name", "Datatype")}
    types = shacl.instances(quads)
    assert [r.category for r in shacl.disjoint_violations(types, zoo.disjoint).collect()] == ["Disjointness"]
    metrics = shacl.constraint_metrics(shacl.validate(quads, props), 10).first()
    assert (metrics.total_violations, metrics.valid_triples, metrics.constraint_rate) == (3, 7, 0.7)
    bounds = spark.createDataFrame([(Z + "Thing", Z + "name", 0, 1)], "class_iri string, prop_iri string, min_card int, max_card int")
    assert shacl.cardinality_violations(quads, bounds, types).count() == 1


def test_rdf_constants():
    assert (OWL, RDFS) == ("http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#")
    assert len(list(itertools.chain(lattice.simplify(["Dog", "Animal"], H)))) == 1
