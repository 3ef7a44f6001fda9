"""Gold datasets: entries (entry_id, text, triples array<struct<s, p, o>>) from four formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.errors import LoadError
from ontoweave.functions.text import trim

TRIPLES = "array<struct<s:string,p:string,o:string>>"


def parse_triple(c):
    """struct<s, p, o> of "s | p | o"; null unless there are three parts."""
    parts = F.transform(F.split(c, r"\|"), trim)
    return F.when(F.size(parts) == 3, F.struct(F.get(parts, F.lit(0)).alias("s"), F.get(parts, F.lit(1)).alias("p"), F.get(parts, F.lit(2)).alias("o")))


def read_webnlg(spark: SparkSession, path: str) -> DataFrame:
    """XML entries: all lexicalisations as text; entries without text or triples are left out."""
    kind = "_eid string, _category string, modifiedtripleset struct<mtriple:array<string>>, lex array<string>"
    try:
        rows = spark.read.format("xml").option("rowTag", "entry").option("valueTag", "_VALUE").schema(kind.replace("lex array<string>", "lex array<struct<_VALUE:string>>")).load(path)
    except Exception as e:
        raise LoadError(f"{path}: {e}") from e
    text = trim(F.array_join(F.transform("lex", lambda x: x["_VALUE"]), " "))
    triples = F.filter(F.transform("modifiedtripleset.mtriple", parse_triple), lambda t: t.isNotNull())
    return rows.select(F.col("_eid").alias("entry_id"), F.col("_category").alias("category"), text.alias("text"), triples.alias("triples")).where((F.col("text") != "") & (F.size("triples") > 0))


def read_rebel(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; an entry without id is rebel-{its line}."""
    kind = "id string, text string, triplets array<struct<subject:string,predicate:string,object:string>>"
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: trim(x) != "")).alias("line", "value"))
    rows = lines.select("line", F.from_json("value", kind).alias("r")).select("line", "r.*")
    triples = F.transform("triplets", lambda t: F.struct(t["subject"].alias("s"), t["predicate"].alias("p"), t["object"].alias("o")))
    return rows.select(F.coalesce("id", F.concat(F.lit("rebel-"), F.col("line").cast("string"))).alias("entry_id"), "text", triples.alias("triples"))


def read_docred(spark: SparkSession, path: str, relations: DataFrame | None = None) -> DataFrame:
    """A JSON array of documents; names are those of an entity's first mention, relations (code, name) give predicates."""
    kind = "title string, sents array<array<string>>, vertexSet array<array<struct<name:string>>>, labels array<struct<r:string,h:int,t:int>>"
    docs = spark.read.schema(kind).option("multiLine", True).json(path).withColumn("entry_id", F.col("title"))

    def name(i):
        return F.coalesce(F.get(F.get("vertexSet", i), F.lit(0))["name"], F.concat(F.lit("Entity"), i.cast("string")))

    rows = docs.select("entry_id", F.array_join(F.flatten("sents"), " ").alias("text"), "vertexSet", F.posexplode_outer("labels").alias("ord", "l"))
    rows = rows.select("entry_id", "text", "ord", name(F.col("l.h")).alias("s"), F.col("l.r").alias("code"), name(F.col("l.t")).alias("o"))
    if relations is not None:
        rows = rows.join(relations.select("code", "name"), "code", "left").withColumn("p", F.coalesce("name", "code"))
    else:
        rows = rows.withColumn("p", F.col("code"))
    each = F.when(F.col("ord").isNotNull(), F.struct("ord", F.struct("s", "p", "o").alias("t")))
    return rows.groupBy("entry_id", "text").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]).alias("triples"))


def read_scierc(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; spans are word places (ends included) over all sentences of a document."""
    kind = "doc_key string, sentences array<array<string>>, relations array<array<array<string>>>"
    rows = spark.read.schema(kind).json(path).select("doc_key", F.flatten("sentences").alias("w"), F.flatten("relations").alias("r"))

    def span(r, i):
        a, b = r[i].cast("int"), r[i + 1].cast("int")
        return F.array_join(F.slice("w", a + 1, b - a + 1), " ")

    triples = F.transform("r", lambda r: F.struct(span(r, 0).alias("s"), r[4].alias("p"), span(r, 2).alias("o")))
    return rows.select(F.col("doc_key").alias("entry_id"), F.array_join("w", " ").alias("text"), triples.alias("triples"))


READERS = {"webnlg": read_webnlg, "rebel": read_rebel, "docred": read_docred, "scierc": read_scierc}
#: Names of splits where a dataset has its own.
SPLITS = {"rebel": {"dev": "val"}}


def load(spark: SparkSession, dataset: str, path: str, sample: int | None = None, seed: int | None = None) -> DataFrame:
    """Entries of a dataset; a sample takes the first by id, or with a seed random ones."""
    if dataset not in READERS:
        raise LoadError(f"unknown dataset: {dataset}")
    rows = READERS[dataset](spark, path)
    if sample is None:
        return rows
    return rows.orderBy(F.rand(seed) if seed is not None else F.col("entry_id")).limit(sample)


def gold(entries: DataFrame) -> DataFrame:
    """entry_id, idx, s, p, o."""
    return entries.select("entry_id", F.posexplode("triples").alias("idx", "t")).select("entry_id", "idx", "t.s", "t.p", "t.o")


def read_results(spark: SparkSession, path: str, newest: int = 15) -> DataFrame:
    """The newest result files: file, modified and content."""
    rows = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as file", "_metadata.file_modification_time as modified", "value")
    return rows.orderBy(F.desc("modified"), "file").limit(newest)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Spans of trace files: trace_id, span_id, name, start, duration_ms and a map of tags."""
    kind = "data array<struct<traceID:string,spans:array<struct<spanID:string,operationName:string,startTime:bigint,duration:bigint,tags:array<struct<key:string,value:string>>>>>>"
    spans = spark.read.schema(kind).option("multiLine", True).json(path).select(F.inline("data")).select("traceID", F.inline("spans"))
    return spans.select(F.col("traceID").alias("trace_id"), F.col("spanID").alias("span_id"), F.col("operationName").alias("name"), F.timestamp_micros("startTime").alias("start"), (F.col("duration") / 1000).alias("duration_ms"), F.map_from_entries(F.transform("tags", lambda t: F.struct(t["key"], t["value"]))).alias("tags"))
