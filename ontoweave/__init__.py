"""Ontology-guided knowledge-graph analytics expressed as Spark DataFrames."""
