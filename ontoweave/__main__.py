"""python -m ontoweave extract TEXT --ontology TTL [--output FILE] | inspect TTL"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ontoweave.operators import chunking, closure, ontology, rdf
from ontoweave.plans import pipeline
from ontoweave.sources.turtle import read_turtle


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ontoweave")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("extract", help="text files to a resolved graph")
    one.add_argument("text")
    one.add_argument("--ontology", required=True)
    one.add_argument("--output", help="folder for Turtle; else it is printed")
    one.add_argument("--window", type=int, default=chunking.PIPELINE.window)
    one.add_argument("--overlap", type=int, default=chunking.PIPELINE.overlap)
    commands.add_parser("inspect", help="what an ontology holds").add_argument("ontology")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("ontoweave").getOrCreate()
    o = ontology.build(read_turtle(spark, a.ontology).cache())
    if a.command == "inspect":
        ontology.inspect(o).show()
        closure.topological(o.classes, o.class_edges).orderBy("level", "iri").show(1000, truncate=False)
        return
    docs = spark.read.text(a.text, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    found = pipeline.run(docs, o, how=chunking.semantic(a.window, a.overlap))
    turtle = rdf.to_turtle(found.graph.withColumn("graph_id", F.lit("graph"))).select("value")
    if a.output:
        turtle.write.mode("overwrite").text(a.output)
    else:
        for row in turtle.orderBy("value").toLocalIterator():
            print(row.value)


if __name__ == "__main__":
    main()
