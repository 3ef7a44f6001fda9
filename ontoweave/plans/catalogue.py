"""Queries over the driver's tables, each an operator applied to a stand-in of its input, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.functions import text as X
from ontoweave.operators import chunking, closure, evaluate, extract, focus, index, lattice, metadata, ontology, rdf, render, resolve, search, shacl
from ontoweave.streaming import registry, runs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- chunks and tokens

_SENT = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


def _starts(n: str, w: int, o: int) -> str:
    step = max(1, w - o)
    return f"CASE WHEN {n} > 0 THEN range(0, (ceil(greatest({n} - {w}, 0) / {step}.0))::INT + 1) ELSE [] END"


@query(f"""WITH s AS (SELECT doc_id, text, unnest({_starts('length(text)', 1000, 200)})::INT AS idx FROM documents)
    SELECT doc_id, idx, substr(text, idx * 800 + 1, 1000) AS text, idx * 800 AS start_pos, least(idx * 800 + 1000, length(text))::INT AS end_pos FROM s""")
def chunk_char(spark, sf_dir):
    return chunking.chunk_characters(table(spark, sf_dir, "documents"))


@query(f"""WITH s AS (SELECT doc_id, {_SENT} AS l FROM documents), k AS (SELECT doc_id, l, unnest({_starts('len(l)', 3, 1)})::INT AS idx FROM s)
    SELECT doc_id, idx, array_to_string(l[idx * 2 + 1:idx * 2 + 3], ' ') AS text, idx * 2 AS sent_start, (least(idx * 2 + 3, len(l)) - 1)::INT AS sent_end FROM k""")
def chunk_sentence(spark, sf_dir):
    return chunking.chunk_sentences(table(spark, sf_dir, "documents"), chunking.PIPELINE)


@query(f"""WITH s AS (SELECT doc_id, lang, text, unnest({_starts('length(text)', 1000, 200)})::INT AS idx FROM documents), c AS (SELECT lang, length(substr(text, idx * 800 + 1, 1000)) AS n FROM s)
    SELECT lang, count(*) AS total_chunks, round(avg(n))::BIGINT AS avg_length, sum(n)::BIGINT AS total_length FROM c GROUP BY lang""")
def chunk_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.chunk_characters(docs.withColumn("key", F.struct("doc_id", "lang")), id_column="key")
    return chunking.coverage(chunks.withColumn("lang", F.col("key.lang")), "lang")


@query("""SELECT doc_id, CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 200) / 800.0) END::BIGINT AS by_characters,
    CASE WHEN greatest(1, length(text) // 100) <= 5 THEN 1 ELSE ceil((greatest(1, length(text) // 100) - 2) / 3.0) END::BIGINT AS by_sentences FROM documents""")
def chunk_estimate(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", chunking.estimate_chunks(n, chunking.character()).alias("by_characters"), chunking.estimate_chunks(n, chunking.semantic()).alias("by_sentences"))


@query(f"""WITH s AS (SELECT doc_id, text, unnest({_starts('length(text)', 1000, 200)})::INT AS idx FROM documents)
    SELECT doc_id, (idx // 10)::INT AS batch_index, count(*) AS chunks FROM s GROUP BY ALL""")
def chunk_batches(spark, sf_dir):
    chunks = chunking.chunk_characters(table(spark, sf_dir, "documents"))
    return chunking.batches(chunks, 10).groupBy("doc_id", "batch_index").agg(F.count("*").alias("chunks"))


@query(r"""SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, (ceil(length(text) / 4.0) + len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS token_count FROM documents""")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"), X.estimate_token_count(F.col("text")).alias("token_count"))


@query("""SELECT lang, sum(t)::BIGINT AS total_tokens, avg(t) AS avg_tokens, max(t)::BIGINT AS max_tokens, sum(t) / 1000 * 0.03 AS cost FROM (SELECT lang, ceil(length(text) / 4.0)::BIGINT AS t FROM documents) GROUP BY lang""")
def token_stats_by_lang(spark, sf_dir):
    t = X.estimate_tokens(F.col("text"))
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(t).alias("total_tokens"), F.avg(t).alias("avg_tokens"), F.max(t).alias("max_tokens"))
    return out.withColumn("cost", F.col("total_tokens") / 1000 * 0.03)


@query("SELECT sum(t)::BIGINT AS total_tokens, avg(t) AS avg_tokens, max(t)::BIGINT AS max_tokens, sum(t) / 1000 * 0.03 AS cost FROM (SELECT ceil(length(text) / 4.0)::BIGINT AS t FROM documents)")
def token_stats(spark, sf_dir):
    return index.token_stats(table(spark, sf_dir, "documents").select(F.col("text").alias("definition")))


# ---- labels and IRIs

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_NORM = r"regexp_replace(regexp_replace(" + _TRIM.format("lower({0})") + r", '[^\w\s]', '', 'g'), '\s+', ' ', 'g')"
_IRI = r"'http://example.org/' || lower(regexp_replace(regexp_replace(" + _TRIM.format("{0}") + r", '\s+', '_', 'g'), '[^a-zA-Z0-9_-]', '', 'g'))"


@query(f"SELECT p_partkey, {_NORM.format('p_name')} AS norm, {_IRI.format('p_name')} AS iri FROM part")
def entity_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_label(F.col("p_name")).alias("norm"), X.generate_iri(F.col("p_name")).alias("iri"))


@query(r"""SELECT page_id, CASE WHEN contains(url, '://') AND contains(url, '#') THEN split_part(url, '#', -1) WHEN contains(url, '://') THEN split_part(url, '/', -1) ELSE url END AS local,
    CASE WHEN contains(url, '#') THEN regexp_extract(url, '^(.*#)', 1) WHEN contains(url, '/') THEN regexp_extract(url, '^(.*/)', 1) ELSE '' END AS ns FROM pages""")
def iri_localname(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.local_name(F.col("url")).alias("local"), X.namespace(F.col("url")).alias("ns"))


@query(r"""SELECT ns, count(*) AS n FROM (SELECT CASE WHEN contains(url, '#') THEN regexp_extract(url, '^(.*#)', 1) WHEN contains(url, '/') THEN regexp_extract(url, '^(.*/)', 1) ELSE '' END AS ns FROM (SELECT DISTINCT url FROM pages)) GROUP BY ns HAVING count(*) > 1""")
def namespace_prefix_map(spark, sf_dir):
    return metadata.prefix_map(table(spark, sf_dir, "pages").select(F.col("url").alias("iri"))).select("ns", "n")


# ---- quads

_NATION_TRIPLES = """SELECT 'g' AS graph_id, n_name AS subject, 'urn:Nation' AS subject_type, 'urn:inRegion' AS predicate, r_name AS value, 'urn:Region' AS type FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'g', c_name, 'urn:Customer', 'urn:segment', c_mktsegment, NULL FROM customer"""
_QUADS = f"""WITH t AS ({_NATION_TRIPLES}), i AS (SELECT *, {_IRI.format('subject')} AS s, {_IRI.format('value')} AS r FROM t)
    SELECT DISTINCT * FROM (
        SELECT graph_id, s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, subject_type AS o, 'iri' AS o_kind FROM i
        UNION ALL SELECT graph_id, s, 'http://www.w3.org/2000/01/rdf-schema#label', subject, 'literal' FROM i
        UNION ALL SELECT graph_id, s, predicate, CASE WHEN type IS NULL THEN value ELSE r END, CASE WHEN type IS NULL THEN 'literal' ELSE 'iri' END FROM i
        UNION ALL SELECT graph_id, r, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', type, 'iri' FROM i WHERE type IS NOT NULL
        UNION ALL SELECT graph_id, r, 'http://www.w3.org/2000/01/rdf-schema#label', value, 'literal' FROM i WHERE type IS NOT NULL)"""


def _triples(spark, sf_dir) -> DataFrame:
    n, r, c = (table(spark, sf_dir, x) for x in ("nation", "region", "customer"))
    ref = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit("g").alias("graph_id"), F.col("n_name").alias("subject"), F.lit("urn:Nation").alias("subject_type"), F.lit("urn:inRegion").alias("predicate"), F.struct(F.col("r_name").alias("value"), F.lit("urn:Region").alias("type")).alias("object"))
    lit = c.select(F.lit("g").alias("graph_id"), F.col("c_name").alias("subject"), F.lit("urn:Customer").alias("subject_type"), F.lit("urn:segment").alias("predicate"), F.struct(F.col("c_mktsegment").alias("value"), F.lit(None).cast("string").alias("type")).alias("object"))
    return ref.unionByName(lit)


@query(f"SELECT graph_id, s, p, o, o_kind, CASE WHEN o_kind = 'literal' THEN 'http://www.w3.org/2001/XMLSchema#string' END AS o_datatype FROM ({_QUADS})")
def quads_from_triples(spark, sf_dir):
    return rdf.triples_to_quads(_triples(spark, sf_dir)).select("graph_id", "s", "p", "o", "o_kind", "o_datatype")


@query("""SELECT 'o' AS graph_id, 'urn:o' || o_orderkey AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'urn:Order' AS o, 'iri' AS o_kind, NULL AS o_datatype FROM orders
    UNION ALL SELECT 'o', 'urn:o' || o_orderkey, 'urn:status', o_orderstatus, 'literal', 'http://www.w3.org/2001/XMLSchema#string' FROM orders
    UNION ALL SELECT 'o', 'urn:o' || o_orderkey, 'urn:by', 'urn:c' || o_custkey, 'iri', NULL FROM orders""")
def quads_from_rows(spark, sf_dir):
    none = F.lit(None).cast("string")
    prop = lambda p, lit, ref: F.struct(F.lit(p).alias("predicate"), lit.alias("lit"), ref.alias("ref"))
    rows = table(spark, sf_dir, "orders").select(F.lit("o").alias("graph_id"), F.concat(F.lit("urn:o"), "o_orderkey").alias("id"), F.lit("urn:Order").alias("type"), F.array(prop("urn:status", F.col("o_orderstatus"), none), prop("urn:by", none, F.concat(F.lit("urn:c"), "o_custkey"))).alias("properties"))
    return rdf.entities_to_quads(rows).select("graph_id", "s", "p", "o", "o_kind", "o_datatype")


@query(f"""SELECT graph_id, '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE '"' || o || '"' END || ' .' AS value FROM ({_QUADS})""")
def ntriples_export(spark, sf_dir):
    return rdf.to_ntriples(rdf.triples_to_quads(_triples(spark, sf_dir)))


@query()
def turtle_export(spark, sf_dir):
    return rdf.to_turtle(rdf.triples_to_quads(_triples(spark, sf_dir)))


@query("""WITH r(class_iri, prop_iri, range) AS (SELECT DISTINCT 'urn:' || p_brand, 'urn:size' || (p_size % 7), CASE p_size % 5 WHEN 0 THEN 'xsd:integer' WHEN 1 THEN 'http://www.w3.org/2001/XMLSchema#decimal' WHEN 2 THEN 'urn:Thing' WHEN 3 THEN 'xsd:boolean' ELSE 'xsd:string' END FROM part),
    n AS (SELECT class_iri, prop_iri, replace(range, 'xsd:', 'http://www.w3.org/2001/XMLSchema#') AS range FROM r),
    p AS (SELECT *, list_position(['boolean', 'integer', 'decimal', 'double', 'date', 'dateTime', 'string'], split_part(range, '#', 2)) AS k FROM n WHERE contains(range, 'XMLSchema#'))
    SELECT prop_iri, range AS datatype FROM (SELECT *, row_number() OVER (PARTITION BY prop_iri ORDER BY class_iri, k, range) AS rn FROM p) WHERE rn = 1""")
def datatype_infer(spark, sf_dir):
    size = F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ["xsd:integer", X.XSD + "decimal", "urn:Thing", "xsd:boolean", "xsd:string"])), (size % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("urn:"), "p_brand").alias("class_iri"), F.concat(F.lit("urn:size"), (size % 7).cast("string")).alias("prop_iri"), kind.alias("range"))
    return rdf.infer_datatypes(rows.distinct())


# ---- hierarchy

_E = "(SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"
_V = "(SELECT 'C' || c_custkey AS iri FROM customer UNION ALL SELECT 'N' || n_nationkey FROM nation UNION ALL SELECT 'R' || r_regionkey FROM region)"
_K = f"WITH RECURSIVE e AS {_E}, v AS {_V}, w(child, parent, d) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT w.child, e.parent, d + 1 FROM w JOIN e ON w.parent = e.child), k AS (SELECT child, parent, min(d)::INT AS lo, max(d)::INT AS hi FROM w GROUP BY ALL)"


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    edges = c.select(key("C", "c_custkey").alias("child"), key("N", "c_nationkey").alias("parent")).union(n.select(key("N", "n_nationkey"), key("R", "n_regionkey")))
    classes = c.select(key("C", "c_custkey").alias("iri")).union(n.select(key("N", "n_nationkey"))).union(r.select(key("R", "r_regionkey")))
    return classes, edges


@query(_K + " SELECT * FROM k")
def class_closure(spark, sf_dir):
    return closure.closure(_graph(spark, sf_dir)[1])


@query(_K + " SELECT iri FROM v WHERE iri NOT IN (SELECT child FROM e)")
def class_roots(spark, sf_dir):
    return closure.roots(*_graph(spark, sf_dir))


@query(_K + ", r AS (SELECT iri FROM v WHERE iri NOT IN (SELECT child FROM e)) SELECT iri, coalesce(min(lo), 0)::INT AS min_depth, coalesce(max(hi), 0)::INT AS max_depth FROM v LEFT JOIN (SELECT k.* FROM k JOIN r ON parent = r.iri) ON child = iri GROUP BY iri")
def class_depths(spark, sf_dir):
    return closure.depths(*_graph(spark, sf_dir))


@query(_K + " SELECT iri, coalesce(max(hi), 0)::INT AS level FROM v LEFT JOIN k ON parent = iri GROUP BY iri")
def topo_level(spark, sf_dir):
    return closure.topological(*_graph(spark, sf_dir))


@query(_K + ", f AS (SELECT iri FROM v WHERE iri IN ('N3', 'N7', 'C11')) SELECT iri FROM f UNION SELECT parent FROM k WHERE child IN (SELECT iri FROM f)")
def focused_context(spark, sf_dir):
    classes, edges = _graph(spark, sf_dir)
    return focus.focused_iris(classes.where(F.col("iri").isin("N3", "N7", "C11")), closure.closure(edges))


@query(_K + ", f AS (SELECT iri FROM v WHERE iri IN ('N3', 'N7', 'C11')) SELECT iri FROM f UNION SELECT parent FROM k WHERE child IN (SELECT iri FROM f) UNION SELECT child FROM k WHERE lo = 1 AND parent IN (SELECT iri FROM f)")
def neighborhood_context(spark, sf_dir):
    classes, edges = _graph(spark, sf_dir)
    return focus.neighborhood_iris(classes.where(F.col("iri").isin("N3", "N7", "C11")), closure.closure(edges))


@query(_K + """, q AS (SELECT 'C' || c_custkey AS child, 'R' || (c_custkey % 5) AS parent FROM customer) SELECT child, parent, EXISTS (SELECT 1 FROM k WHERE k.child = q.child AND k.parent = q.parent) OR child = parent AS is_subclass FROM q""")
def is_subclass(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("child"), F.concat(F.lit("R"), (F.col("c_custkey") % 5).cast("string")).alias("parent"))
    return closure.is_subclass(pairs, closure.closure(_graph(spark, sf_dir)[1]))


@query(_K + """, q AS (SELECT a.iri AS a, b.iri AS b FROM v a, v b WHERE b.iri IN (SELECT 'R' || r_regionkey FROM region)), up AS (SELECT child, parent FROM k UNION SELECT iri, iri FROM v),
    x AS (SELECT DISTINCT p.child AS a, s.child AS b FROM up p, up s WHERE (p.parent = 'R0' AND s.parent = 'R1') OR (p.parent = 'R1' AND s.parent = 'R0')), y AS (SELECT child AS a, parent AS b FROM k UNION SELECT parent, child FROM k)
    SELECT a, b, CASE WHEN x.a IS NOT NULL THEN 'Disjoint' WHEN a = b OR y.a IS NOT NULL THEN 'Overlapping' ELSE 'Unknown' END AS relation FROM q LEFT JOIN x USING (a, b) LEFT JOIN y USING (a, b)""")
def disjoint_check(spark, sf_dir):
    classes, edges = _graph(spark, sf_dir)
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("b"))
    pairs = classes.select(F.col("iri").alias("a")).crossJoin(F.broadcast(regions))  # every class with the five regions
    return closure.disjointness(pairs, classes, closure.closure(edges), spark.createDataFrame([("R0", "R1")], "a string, b string"))


_P = "(SELECT 'R' || r_regionkey AS class_iri, 'urn:p' || (r_regionkey % 2) AS prop_iri FROM region UNION ALL SELECT 'N' || n_nationkey, 'urn:p' || (n_nationkey % 3) FROM nation)"


def _props(spark, sf_dir) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    row = lambda df, p, k, m: df.select(F.concat(F.lit(p), k).alias("class_iri"), F.concat(F.lit("urn:p"), (F.col(k) % m).cast("string")).alias("prop_iri"))
    return row(r, "R", "r_regionkey", 2).unionByName(row(n, "N", "n_nationkey", 3))


@query(_K + f""", p AS {_P}, u AS (SELECT k.child AS iri, prop_iri, k.parent AS from_class, row_number() OVER (PARTITION BY k.child, prop_iri ORDER BY lo, k.parent) AS rn FROM k JOIN p ON k.parent = p.class_iri)
    SELECT iri, prop_iri, from_class FROM u WHERE rn = 1 AND (iri, prop_iri) NOT IN (SELECT (class_iri, prop_iri) FROM p)""")
def inherited_props(spark, sf_dir):
    classes, edges = _graph(spark, sf_dir)
    return closure.inherited(classes, closure.closure(edges), _props(spark, sf_dir))


@query("SELECT l_partkey, coalesce(max(lo), 0) AS min_card, min(hi) AS max_card, coalesce(max(lo) > min(hi), false) AS is_bottom FROM (SELECT l_partkey, l_linenumber AS lo, CASE WHEN l_quantity > 10 THEN l_quantity::INT END AS hi FROM lineitem) GROUP BY l_partkey")
def lattice_meet_card(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").alias("min_card"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int")).alias("max_card"))
    return lattice.meet_bounds(rows, "l_partkey")


@query("""WITH a AS (SELECT l_partkey, max(l_linenumber) AS a_min, min(l_quantity) AS a_max FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey AS l_partkey, max(l_linenumber) AS b_min, min(l_quantity) AS b_max FROM lineitem GROUP BY ALL)
    SELECT l_partkey, coalesce(a_min >= b_min AND (b_max IS NULL OR a_max <= b_max), false) AS refines FROM a JOIN b USING (l_partkey)""")
def lattice_refines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a = lines.groupBy("l_partkey").agg(F.max("l_linenumber").alias("a_min"), F.min("l_quantity").alias("a_max"))
    b = lines.groupBy(F.col("l_suppkey").alias("l_partkey")).agg(F.max("l_linenumber").alias("b_min"), F.min("l_quantity").alias("b_max"))
    return a.join(b, "l_partkey").select("l_partkey", lattice.bounds_refine().alias("refines"))


# ---- ontologies from quads

_CLASSES = "(SELECT 'R' || r_regionkey AS iri, r_name AS label FROM region UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'C' || c_custkey, 'C' || c_custkey FROM customer)"
_BRANDS = "(SELECT DISTINCT p_brand AS prop, split_part(p_brand, '#', 2) AS label, split_part(p_brand, '#', 2)::INT AS k FROM part)"
_DOMAIN_PROPS = f"SELECT 'N' || (k % 30) AS class_iri, k % 2 AS scan, prop AS prop_iri, label, CASE WHEN k % 2 = 0 THEN 'R' || (k % 5) ELSE 'http://www.w3.org/2001/XMLSchema#string' END AS range, 0 AS min_card, CASE WHEN k % 5 = 0 THEN 1 END AS max_card, 'domain' AS source FROM {_BRANDS} WHERE k % 3 <> 0 AND k % 30 < 25"
_RESTRICTED = "SELECT 'N' || n_nationkey, 2, 'urn:in/Region', 'Region', 'R' || n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END, n_nationkey % 4, 'restriction' FROM nation"


def _ontology_quads(spark, sf_dir) -> DataFrame:
    """Regions, nations and customers as classes, brands as properties, a restriction for each nation, a list of nations for each region."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    cat = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    fact = lambda p, o, kind="iri": F.struct(F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o"), F.lit(kind).alias("o_kind"))
    facts = lambda df, s, kind, *fs: df.select(s.alias("s"), F.lit(kind).alias("s_kind"), F.inline(F.array_compact(F.array(*fs))))
    kind, label, above = X.RDF + "type", X.RDFS + "label", X.RDFS + "subClassOf"
    region, nation = cat("R", F.col("r_regionkey")), cat("N", F.col("n_nationkey"))
    blank = cat("b", F.col("n_nationkey"))
    k = F.split("p_brand", "#")[1].cast("int")
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    below = n.select(F.struct("n_nationkey").alias("at"), "n_regionkey").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("at.n_nationkey")).alias("ns")).select("n_regionkey", F.size("ns").alias("size"), F.posexplode("ns").alias("i", "n"))
    cell = lambda i: cat("l", F.col("n_regionkey"), "-", i)
    return (
        facts(r, region, "iri", fact(kind, X.OWL + "Class"), fact(label, F.col("r_name"), "literal"), fact(X.OWL + "unionOf", cat("l", F.col("r_regionkey"), "-0"), "bnode"), fact(X.OWL + "disjointWith", cat("R", (F.col("r_regionkey") + 1) % 5)))
        .union(facts(n, nation, "iri", fact(kind, X.OWL + "Class"), fact(label, F.col("n_name"), "literal"), fact(above, cat("R", F.col("n_regionkey"))), fact(above, blank, "bnode")))
        .union(facts(n, blank, "bnode", fact(kind, X.OWL + "Restriction"), fact(X.OWL + "onProperty", "urn:in/Region"), F.when(F.col("n_nationkey") % 2 == 0, fact(X.OWL + "someValuesFrom", cat("R", F.col("n_regionkey")))).otherwise(fact(X.OWL + "allValuesFrom", cat("R", F.col("n_regionkey")))), fact(X.OWL + "maxCardinality", cat(F.col("n_nationkey") % 4), "literal")))
        .union(facts(c, cat("C", F.col("c_custkey")), "iri", fact(kind, X.OWL + "Class"), fact(above, cat("N", F.col("c_nationkey"))), fact(above, cat("Nowhere"))))
        .union(facts(brands, F.col("p_brand"), "iri", F.when(k % 2 == 0, fact(kind, X.OWL + "ObjectProperty")).otherwise(fact(kind, X.OWL + "DatatypeProperty")), F.when(k % 5 == 0, fact(kind, X.OWL + "FunctionalProperty")), F.when(k % 3 != 0, fact(X.RDFS + "domain", cat("N", k % 30))), F.when(k % 2 == 0, fact(X.RDFS + "range", cat("R", k % 5)))))
        .union(facts(below, cell(F.col("i")), "bnode", fact(X.RDF + "first", cat("N", F.col("n"))), F.when(F.col("i") + 1 < F.col("size"), fact(X.RDF + "rest", cell(F.col("i") + 1), "bnode")).otherwise(fact(X.RDF + "rest", X.RDF + "nil"))))
    )


@query(f"SELECT * FROM {_CLASSES}")
def ontology_classes(spark, sf_dir):
    return ontology.build(_ontology_quads(spark, sf_dir)).classes.select("iri", "label")


@query("SELECT 'R' || n_regionkey AS iri, 'UnionOf' AS tag, string_agg('N' || n_nationkey, ' ' ORDER BY n_nationkey) AS members FROM nation GROUP BY n_regionkey")
def ontology_expressions(spark, sf_dir):
    return ontology.build(_ontology_quads(spark, sf_dir)).classes.select("iri", F.inline("expressions")).select("iri", "tag", F.array_join("classes", " ").alias("members"))


@query(f"SELECT child, parent FROM {_E}")
def ontology_edges(spark, sf_dir):
    return ontology.build(_ontology_quads(spark, sf_dir)).class_edges


@query(f"""WITH p AS ({_DOMAIN_PROPS} UNION ALL {_RESTRICTED})
    SELECT class_iri, (row_number() OVER (PARTITION BY class_iri ORDER BY scan, prop_iri) - 1)::INT AS ord, prop_iri, label, range, min_card::INT AS min_card, coalesce(max_card, -1)::INT AS max_card, source FROM p""")
def ontology_properties(spark, sf_dir):
    props = ontology.build(_ontology_quads(spark, sf_dir)).class_props
    return props.select("class_iri", F.col("ord").cast("int").alias("ord"), "c.prop_iri", "c.label", F.col("c.ranges")[0].alias("range"), "c.min_card", F.coalesce("c.max_card", F.lit(-1)).alias("max_card"), "c.source")


@query(f"SELECT (row_number() OVER (ORDER BY k % 2, prop) - 1)::INT AS ord, prop AS prop_iri, label FROM {_BRANDS} WHERE k % 3 = 0")
def ontology_universal(spark, sf_dir):
    return ontology.build(_ontology_quads(spark, sf_dir)).universal_props.select(F.col("ord").cast("int").alias("ord"), "c.prop_iri", "c.label")


@query("WITH d AS (SELECT 'R' || r_regionkey AS a, 'R' || ((r_regionkey + 1) % 5) AS b FROM region) SELECT a, b FROM d UNION SELECT b, a FROM d")
def ontology_disjoint(spark, sf_dir):
    return ontology.build(_ontology_quads(spark, sf_dir)).disjoint


@query(f"SELECT (SELECT count(*) FROM {_CLASSES}) AS classes, (SELECT count(*) FROM ({_DOMAIN_PROPS})) AS domain_properties, (SELECT count(*) FROM {_BRANDS} WHERE k % 3 = 0) AS universal_properties")
def ontology_inspect(spark, sf_dir):
    return ontology.inspect(ontology.build(_ontology_quads(spark, sf_dir)))


@query(_K + ", f AS (SELECT iri FROM v WHERE iri IN ('N3', 'N7', 'C11')), g AS (SELECT 'R' || ((n_regionkey + 1) % 5) AS iri FROM nation WHERE 'N' || n_nationkey IN (SELECT iri FROM f)), h AS (SELECT iri FROM f UNION SELECT iri FROM g) SELECT iri FROM h UNION SELECT parent FROM k WHERE child IN (SELECT iri FROM h)")
def dependency_context(spark, sf_dir):
    classes, edges = _graph(spark, sf_dir)
    ranges = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("class_iri"), F.concat(F.lit("R"), ((F.col("n_regionkey") + 1) % 5).cast("string")).alias("range"))
    return focus.dependency_iris(classes.where(F.col("iri").isin("N3", "N7", "C11")), closure.closure(edges), ranges, classes)


@query("""WITH e AS (SELECT 'chunk_' || (n_nationkey % 3) || '_b' || (n_nationkey // 3) AS iri, true AS blank, lower(substr(n_name, 1, 1)) AS k FROM nation UNION ALL SELECT 'urn:r' || r_regionkey, false, lower(substr(r_name, 1, 1)) FROM region),
    m AS (SELECT k, arg_min((blank, iri), (blank, iri)) AS best FROM e GROUP BY k) SELECT e.iri, best[2] AS canonical, CASE WHEN best[1] THEN 'bnode' ELSE 'iri' END AS canonical_kind FROM e JOIN m USING (k) WHERE e.iri <> best[2]""")
def entity_resolution_blank(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = lambda df, g, s, kind, name: df.select(g.alias("graph_id"), s.alias("s"), F.lit(kind).alias("s_kind"), F.lit(X.RDFS + "label").alias("p"), F.substring(name, 1, 1).alias("o"), F.lit("literal").alias("o_kind"))
    quads = row(n, (F.col("n_nationkey") % 3).cast("string"), F.concat(F.lit("b"), F.floor(F.col("n_nationkey") / 3).cast("string")), "bnode", "n_name").unionByName(row(r, F.lit("0"), F.concat(F.lit("urn:r"), "r_regionkey"), "iri", "r_name"))
    return resolve.resolution_map(resolve.labelled_entities(resolve.skolemize(quads)))


@query("""SELECT l_orderkey AS entry_id, 0::BIGINT AS tp, 0::BIGINT AS fp, count(*) AS fn, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1, any_value(o_orderstatus) AS error
    FROM lineitem JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def eval_failed(spark, sf_dir):
    errors = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderstatus").alias("error"))
    return evaluate.failed_entry(_gold_pred(spark, sf_dir)[0], errors)


# ---- the index

def _half(spark, sf_dir, which: int) -> DataFrame:
    part = table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 != which)
    return part.select(F.col("p_brand").alias("iri"), F.col("p_type").alias("label"), F.col("p_name").alias("definition"), F.array("p_type").alias("children"), F.array(F.col("p_size").cast("string")).alias("parents"))


@query("""WITH h AS (SELECT * FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT * FROM part WHERE p_partkey % 3 <> 1)
    SELECT p_brand AS iri, (list(p_type ORDER BY -length(p_type), p_type))[1] AS label, (list(p_name ORDER BY -length(p_name), p_name))[1] AS definition,
    array_to_string(list_sort(list_distinct(list(p_type))), '|') AS children, array_to_string(list_sort(list_distinct(list(p_size::VARCHAR))), '|') AS parents FROM h GROUP BY p_brand""")
def index_combine(spark, sf_dir):
    out = index.combine(_half(spark, sf_dir, 0), _half(spark, sf_dir, 1))
    return out.withColumns({c: F.array_join(c, "|") for c in ("children", "parents")})


@query("""SELECT coalesce(b.p_partkey, a.p_partkey)::VARCHAR AS iri, coalesce(b.p_name, a.p_name) AS label, CASE WHEN a.p_partkey IS NULL THEN 'removed' WHEN b.p_partkey IS NULL THEN 'added' ELSE 'kept' END AS change
    FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) b FULL JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 1) a USING (p_partkey)""")
def index_diff(spark, sf_dir):
    unit = lambda k: table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 != k).select(F.col("p_partkey").cast("string").alias("iri"), F.col("p_name").alias("label"))
    return index.diff(unit(0), unit(1))


@query("""SELECT n AS full_size, f AS focused_size, CASE WHEN n = 0 THEN 0.0 ELSE (n - f)::DOUBLE / n * 100 END AS reduction_percent, (n - f) * 50 AS estimated_token_savings FROM (SELECT count(*) AS n, count(*) FILTER (WHERE p_size < 10) AS f FROM part)""")
def context_reduction(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return focus.analyze_reduction(part, part.where("p_size < 10"))


# ---- resolution

_NAMED = "(SELECT 'urn:p' || p_partkey AS s, p_type AS label FROM part UNION ALL SELECT 'urn:q' || p_partkey, upper(p_type) || '!' FROM part)"


def _label_quads(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(F.concat(F.lit("urn:p"), "p_partkey").alias("s"), F.col("p_type").alias("o")).union(part.select(F.concat(F.lit("urn:q"), "p_partkey"), F.concat(F.upper("p_type"), F.lit("!"))))
    none = F.lit(None).cast("string")
    return rows.select(F.lit("0").alias("graph_id"), "s", F.lit("iri").alias("s_kind"), F.lit(X.RDFS + "label").alias("p"), "o", F.lit("literal").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))


@query(f"WITH n AS (SELECT s, {_NORM.format('label')} AS k FROM {_NAMED}), m AS (SELECT k, min(s) AS canonical FROM n GROUP BY k) SELECT s AS iri, canonical FROM n JOIN m USING (k) WHERE s <> canonical")
def entity_resolution_map(spark, sf_dir):
    return resolve.resolution_map(resolve.labelled_entities(_label_quads(spark, sf_dir))).select("iri", "canonical")


@query(f"WITH n AS (SELECT s, label, {_NORM.format('label')} AS k FROM {_NAMED}), m AS (SELECT k, min(s) AS canonical FROM n GROUP BY k) SELECT DISTINCT canonical AS s, label AS o FROM n JOIN m USING (k)")
def entity_resolution_rewrite(spark, sf_dir):
    return resolve.merge_graphs(_label_quads(spark, sf_dir)).select("s", "o")


@query(f"WITH c AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS label FROM conversations) SELECT conv_id::VARCHAR AS run_id, {_NORM.format('label')} AS norm_label, max(turn)::INT AS found_in_chunk FROM c GROUP BY ALL")
def entity_cache_last_write(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("run_id"), X.normalize_label(F.substring_index("text", " ", 1)).alias("norm_label"), F.col("turn").cast("int").alias("found_in_chunk"))
    return resolve.last_write(rows, "found_in_chunk")


# ---- search

_TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + "], w))"


@query(f"""WITH d AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
    p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM benchmark),
    s AS (SELECT query_id, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.Bm25(docs).search(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(f"""WITH d AS (SELECT doc_id AS id, list_distinct(list_filter({_TOK.format('text')}, lambda w: length(w) > 2)) AS w FROM documents), q AS (SELECT item_id AS query_id, list_distinct(list_filter({_TOK.format('text')}, lambda w: length(w) > 2)) AS w FROM benchmark),
    dt AS (SELECT id, len(w) AS nd, unnest(w) AS t FROM d), qt AS (SELECT query_id, len(w) AS nq, unnest(w) AS t FROM q),
    s AS (SELECT query_id, id, round(count(*)::DOUBLE / (nq + nd - count(*)), 6) AS score FROM qt JOIN dt USING (t) GROUP BY query_id, id, nq, nd),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 10""")
def jaccard_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.similar_documents(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), docs)


@query(r"""WITH t AS (SELECT doc_id AS id, lower(text) AS x, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_A-Z]+'), lambda w: length(w) > 2) AS w FROM documents),
    p(prop_iri, j, l) AS (VALUES ('http://example.org/theOther', 'theother', ['the', 'other']), ('http://example.org/wasHere', 'washere', ['was', 'here']), ('http://example.org/que', 'que', ['que']), ('http://example.org/noMatchAtAll', 'nomatchatall', ['match', 'all'])),
    s AS (SELECT id, prop_iri, (CASE WHEN contains(x, j) THEN 15.0 ELSE 0.0 END + CASE WHEN list_has_any(l, w) THEN 14.0 ELSE 0.0 END)::DOUBLE AS score FROM t, p)
    SELECT id, prop_iri, score, (row_number() OVER (PARTITION BY id ORDER BY score DESC, prop_iri))::INT AS rank FROM s WHERE score > 0""")
def property_filter(spark, sf_dir):
    props = spark.createDataFrame([(f"http://example.org/{x}",) for x in ("theOther", "wasHere", "que", "noMatchAtAll")], "prop_iri string")
    return focus.filter_properties(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), props)


# ---- validation

def _order_quads(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = F.concat(F.lit("urn:o"), "o_orderkey")
    fact = lambda p, v, kind, datatype=None: F.struct(F.lit(p).alias("p"), v.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"))
    facts = F.array(fact(X.RDF + "type", F.lit("urn:Order"), "iri"), fact("urn:priority", F.col("o_orderpriority"), "literal", X.XSD + "string"), fact("urn:status", F.col("o_orderstatus"), "literal", X.XSD + "string"), fact("urn:by", F.concat(F.lit("urn:c"), "o_custkey"), "iri"))
    quads = o.select(F.lit("0").alias("graph_id"), s.alias("s"), F.lit("iri").alias("s_kind"), F.inline(facts))
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    typed = c.select(F.lit("0").alias("graph_id"), F.concat(F.lit("urn:c"), "c_custkey").alias("s"), F.lit("iri").alias("s_kind"), F.lit(X.RDF + "type").alias("p"), F.lit("urn:Customer").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
    return quads.unionByName(typed)


def _order_shapes(spark) -> DataFrame:
    return spark.createDataFrame([("urn:Order", "urn:priority", None, ["xsd:integer"]), ("urn:Order", "urn:status", None, ["xsd:string"]), ("urn:Order", "urn:by", None, ["urn:Customer"])], "class_iri string, prop_iri string, label string, ranges array<string>")


@query("""SELECT 'urn:o' || o_orderkey AS focus_node, 'urn:priority' AS path, 'Datatype' AS category FROM orders UNION ALL SELECT 'urn:o' || o_orderkey, 'urn:by', 'DomainRange' FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey WHERE c_custkey IS NULL""")
def shacl_validate(spark, sf_dir):
    return shacl.validate(_order_quads(spark, sf_dir), _order_shapes(spark)).select("focus_node", "path", "category")


@query("""WITH n AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL) SELECT 'urn:o' || l_orderkey AS focus_node, CASE WHEN n < 2 THEN 'minCount 2, found ' || n ELSE 'maxCount 5, found ' || n END AS message FROM n WHERE n < 2 OR n > 5""")
def cardinality_violations(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    s = F.concat(F.lit("urn:o"), "l_orderkey")
    quads = line.select(s.alias("s"), F.lit("urn:part").alias("p"), F.col("l_partkey").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit("").alias("o_datatype"))
    types = line.select(s.alias("s"), F.lit("urn:Order").alias("class_iri")).distinct()
    bounds = spark.createDataFrame([("urn:Order", "urn:part", 2, 5)], "class_iri string, prop_iri string, min_card int, max_card int")
    return shacl.cardinality_violations(quads, bounds, types).select("focus_node", "message")


@query("""WITH v AS (SELECT count(*) AS d FROM orders), c AS (SELECT count(*) AS r FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey WHERE c_custkey IS NULL)
    SELECT d + r AS total_violations, 0::BIGINT AS cardinality, r AS domain_range, 0::BIGINT AS disjointness, d AS datatype, 0::BIGINT AS other, greatest(0, 1000000 - d - r) AS valid_triples, greatest(0, 1000000 - d - r) / 1000000 AS constraint_rate FROM v, c""")
def violation_summary(spark, sf_dir):
    return shacl.constraint_metrics(shacl.validate(_order_quads(spark, sf_dir), _order_shapes(spark)), 1_000_000)


# ---- scoring

_GOLD = "(SELECT l_orderkey AS entry_id, l_linenumber AS idx, 'http://e.org/Order_' || l_orderkey AS s, 'http://e.org/has' || l_returnflag AS p, 'Part ' || l_partkey AS o FROM lineitem)"
_PRED = "(SELECT l_orderkey AS entry_id, l_linenumber AS idx, 'order ' || l_orderkey AS s, CASE WHEN l_linenumber % 4 = 0 THEN 'other' ELSE 'http://e.org/x#HAS' || l_returnflag END AS p, 'part ' || (l_partkey + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) AS o FROM lineitem WHERE l_linenumber <> 5)"
_N = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(CASE WHEN contains({0}, '://') AND contains({0}, '#') THEN split_part({0}, '#', -1) WHEN contains({0}, '://') THEN split_part({0}, '/', -1) ELSE {0} END, '_', ' ', 'g')), '^\s+|\s+$', '', 'g'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')"
_NORMED = "SELECT entry_id, idx, s, p, o, " + ", ".join(f"{_N.format(c)} AS n_{c}" for c in "spo")
_STRICT = f"""WITH g AS ({_NORMED} FROM {_GOLD}), q AS ({_NORMED} FROM {_PRED}), raw AS (SELECT entry_id, s, p, o, min(idx) AS first_idx FROM g GROUP BY ALL),
    b AS (SELECT q.entry_id, q.idx, arg_min(first_idx, g.idx) AS hit FROM q JOIN g USING (entry_id, n_s, n_p, n_o) JOIN raw ON raw.entry_id = g.entry_id AND raw.s = g.s AND raw.p = g.p AND raw.o = g.o GROUP BY ALL),
    c AS (SELECT e.entry_id, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, ng - coalesce(tp, 0) AS fn FROM (SELECT entry_id, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng FROM (SELECT entry_id, count(*) AS ng FROM g GROUP BY ALL) FULL JOIN (SELECT entry_id, count(*) AS np FROM q GROUP BY ALL) USING (entry_id)) e LEFT JOIN (SELECT entry_id, count(DISTINCT hit) AS tp FROM b GROUP BY ALL) USING (entry_id)),
    r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c),
    m AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)"""


def _gold_pred(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem")
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    keys = [F.col("l_orderkey").alias("entry_id"), n.alias("idx")]
    gold = line.select(*keys, F.concat(F.lit("http://e.org/Order_"), "l_orderkey").alias("s"), F.concat(F.lit("http://e.org/has"), "l_returnflag").alias("p"), F.concat(F.lit("Part "), part).alias("o"))
    pred = line.where(n != 5).select(*keys, F.concat(F.lit("order "), "l_orderkey").alias("s"), F.when(n % 4 == 0, "other").otherwise(F.concat(F.lit("http://e.org/x#HAS"), "l_returnflag")).alias("p"), F.concat(F.lit("part "), part + F.when(n % 3 == 0, 1).otherwise(0)).alias("o"))
    return gold, pred


@query(_STRICT + " SELECT * FROM m")
def eval_strict(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    return evaluate.entry_metrics(pred, gold)


@query(_STRICT + " SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) AS entries FROM m")
def eval_macro(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    out = evaluate.macro(evaluate.entry_metrics(pred, gold))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


_SIM = "(CASE WHEN greatest(length(q.n_{0}), length(g.n_{0})) = 0 THEN 1.0 ELSE 1 - levenshtein(q.n_{0}, g.n_{0})::DOUBLE / greatest(length(q.n_{0}), length(g.n_{0})) END)"


@query(_STRICT.split("b AS (")[0] + f"""x AS (SELECT q.entry_id, q.idx, g.idx AS gi, first_idx, ({_SIM.format('s')} + {_SIM.format('p')} + {_SIM.format('o')}) / 3 AS conf FROM q JOIN g USING (entry_id) JOIN raw ON raw.entry_id = g.entry_id AND raw.s = g.s AND raw.p = g.p AND raw.o = g.o),
    y AS (SELECT *, row_number() OVER (PARTITION BY entry_id, idx ORDER BY conf DESC, gi) AS rn FROM x WHERE conf >= 0.8) SELECT entry_id, count(DISTINCT first_idx) AS tp FROM y WHERE rn = 1 GROUP BY entry_id""")
def eval_relaxed(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    return evaluate.best_matches(pred, gold, "relaxed").groupBy("entry_id").agg(F.countDistinct("gold_idx").alias("tp"))


@query(_STRICT + " SELECT split_part(p, '/', -1) AS predicate, count(*) AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.entry_id = g.entry_id AND q.n_s = g.n_s AND q.n_p = g.n_p AND q.n_o = g.n_o) GROUP BY 1 ORDER BY n DESC, predicate LIMIT 10")
def eval_top_missed(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    return evaluate.top_missed(pred, gold)


# ---- costs, runs, plots

@query("""WITH c AS (SELECT CASE event_type WHEN 'click' THEN 'gpt-4o' WHEN 'view' THEN 'gpt-4o-mini' WHEN 'purchase' THEN 'gemini-1.5-pro' ELSE event_type END AS model, user_id AS i, event_id % 1000 AS o FROM events), p(model, pi, po) AS (VALUES ('gpt-4o', 2.5, 10.0), ('gpt-4o-mini', 0.15, 0.6), ('gemini-1.5-pro', 1.25, 5.0))
    SELECT model, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(i / 1e6 * coalesce(pi, 0)::DOUBLE + o / 1e6 * coalesce(po, 0)::DOUBLE), 6) AS cost FROM c LEFT JOIN p USING (model) GROUP BY model""")
def cost_by_model(spark, sf_dir):
    model = F.when(F.col("event_type") == "click", "gpt-4o").when(F.col("event_type") == "view", "gpt-4o-mini").when(F.col("event_type") == "purchase", "gemini-1.5-pro").otherwise(F.col("event_type"))
    calls = table(spark, sf_dir, "events").select(model.alias("model"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 1000).alias("output_tokens"))
    return metadata.cost_by_model(calls)


@query("""SELECT 'run' || o_custkey AS run_id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS status_version FROM orders GROUP BY ALL""")
def run_latest_state(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.concat(F.lit("run"), "o_custkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("status_version"))
    return runs.latest(log)


@query("SELECT 'run' || l_orderkey AS run_id, max(l_linenumber) AS batch_index FROM lineitem GROUP BY ALL")
def last_checkpoint(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("run"), "l_orderkey").alias("run_id"), F.col("l_linenumber").alias("batch_index"))
    return runs.last_checkpoints(rows)


@query("SELECT sha256(text) AS hash, min(doc_id) AS batch_index FROM documents GROUP BY 1")
def batch_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("batch_index"), F.col("text").alias("content"))
    return runs.dedupe_batches(rows).select("hash", "batch_index")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    return registry.windowed_events(spark, f"{sf_dir}/events.parquet").withColumn("total", F.round("total", 6))


@query("SELECT user_id::VARCHAR AS run_id, event_type AS norm_label, max(event_id) AS last_seq, count(*) AS n FROM events GROUP BY ALL")
def stream_registry(spark, sf_dir):
    return registry.registry_of_stream(spark, f"{sf_dir}/events.parquet")


@query(_K + ", r AS (SELECT iri FROM v WHERE iri NOT IN (SELECT child FROM e)), d AS (SELECT iri, coalesce(min(lo), 0) AS depth FROM v LEFT JOIN (SELECT k.* FROM k JOIN r ON parent = r.iri) ON child = iri GROUP BY iri) SELECT iri AS id, 'depth-' || depth AS grp FROM d")
def plot_nodes(spark, sf_dir):
    classes, edges = _graph(spark, sf_dir)
    return metadata.plot_nodes(closure.depths(classes, edges))


@query(_K + ", t AS (SELECT child, min(parent) AS parent FROM e GROUP BY child) SELECT iri, parent FROM v LEFT JOIN t ON child = iri")
def hierarchy_rows(spark, sf_dir):
    return metadata.hierarchy(*_graph(spark, sf_dir)).select("iri", "parent")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'high') ORDER BY o_orderpriority DESC, o_orderkey LIMIT 10 OFFSET 20")
def ui_pagination(spark, sf_dir):
    return metadata.page(table(spark, sf_dir, "orders"), 3, 10, order=[F.desc("o_orderpriority"), "o_orderkey"], contains=("o_orderpriority", "high")).select("o_orderkey", "o_orderpriority")


@query("SELECT p_brand, array_to_string(list('- ' || p_name ORDER BY p_name, p_partkey), chr(10)) AS prompt FROM part GROUP BY p_brand")
def prompt_render(spark, sf_dir):
    return render.bullet_sections(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey", "prompt")


# ---- end to end

@query()
def extract_end_to_end(spark, sf_dir):
    return entry(spark, sf_dir)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to resolved quads: sentence windows, a deterministic extractor, quads, resolution; quads by predicate."""
    chunks = chunking.chunk_sentences(table(spark, sf_dir, "documents"), chunking.PIPELINE)
    triples = extract.extract(chunks.select(F.col("doc_id").alias("run_id"), F.col("idx").alias("chunk_idx"), "text")).where("error is null")
    # the extractor names no blank nodes, so that graphs need not be told apart: what many chunks say is one triple
    said = triples.select("subject", "subject_type", "predicate", "object").distinct().withColumn("graph_id", F.lit("all"))
    return resolve.merge_graphs(rdf.triples_to_quads(said)).groupBy("p").agg(F.count("*").alias("n"))
