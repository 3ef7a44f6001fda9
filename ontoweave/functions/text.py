"""Column expressions over labels, IRIs and texts.  All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces and their usual prefixes.
PREFIXES = {
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
    "http://www.w3.org/2000/01/rdf-schema#": "rdfs",
    "http://www.w3.org/2002/07/owl#": "owl",
    "http://www.w3.org/2001/XMLSchema#": "xsd",
    "http://xmlns.com/foaf/0.1/": "foaf",
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://purl.org/dc/terms/": "dcterms",
    "http://www.w3.org/2004/02/skos/core#": "skos",
    "http://schema.org/": "schema",
}
RDF, RDFS, OWL, XSD = (next(n for n, p in PREFIXES.items() if p == k) for k in ("rdf", "rdfs", "owl", "xsd"))


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends (Spark's own trim takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_label(c: Column) -> Column:
    """Lower case, trimmed, without punctuation, white space collapsed: the key of entity resolution."""
    return F.regexp_replace(F.regexp_replace(trim(F.lower(c)), r"[^\w\s]", ""), r"\s+", " ")


def local_name(c: Column) -> Column:
    """Of a full IRI what follows the last # or else the last /; other text is itself."""
    return F.when(c.contains("://") & c.contains("#"), F.substring_index(c, "#", -1)).when(c.contains("://"), F.substring_index(c, "/", -1)).otherwise(c)


def normalize_term(c: Column) -> Column:
    """Local name, underscores as blanks, lower case, without punctuation: the form in which triples are matched."""
    plain = trim(F.lower(F.regexp_replace(local_name(c), "_", " ")))
    return F.regexp_replace(F.regexp_replace(plain, r"[^\w\s]", ""), r"\s+", " ")


def sanitize_name(c: Column) -> Column:
    """A name as the last part of an IRI."""
    return F.lower(F.regexp_replace(F.regexp_replace(trim(c), r"\s+", "_"), r"[^a-zA-Z0-9_-]", ""))


def generate_iri(c: Column, base: str = "http://example.org/") -> Column:
    return F.concat(F.lit(base), sanitize_name(c))


def namespace(c: Column) -> Column:
    """Up to and with the last # or else the last /."""
    return F.when(c.contains("#"), F.regexp_extract(c, r"^(.*#)", 1)).when(c.contains("/"), F.regexp_extract(c, r"^(.*/)", 1)).otherwise(F.lit(""))


def extract_label(c: Column) -> Column:
    """What follows the first #, else the last path segment, else the IRI."""
    part, last = F.get(F.split(c, "#"), F.lit(1)), F.substring_index(c, "/", -1)
    return F.coalesce(F.when(part != "", part), F.when(last != "", last), c)


def label_from_iri(c: Column) -> Column:
    """Local name with camel case parted."""
    return F.regexp_replace(F.regexp_extract(c, r"([^#/]*)$", 1), r"([a-z])([A-Z])", "$1 $2")


def abbreviate_iri(c: Column, prefixes: dict[str, str] | None = None) -> Column:
    out = c
    for ns, prefix in sorted((PREFIXES | (prefixes or {})).items(), key=lambda x: len(x[0])):
        out = F.when(c.startswith(ns) & (F.length(c) > len(ns)), F.concat(F.lit(prefix + ":"), F.substring(c, len(ns) + 1, 1 << 20))).otherwise(out)
    return out


def is_iri(c: Column) -> Column:
    return c.rlike(r"^(https?://|urn:)")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def estimate_token_count(c: Column) -> Column:
    """A quarter of the characters plus the words."""
    return (F.ceil(F.length(c) / 4) + F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))).cast("long")


def sentences(c: Column) -> Column:
    """Parts between sentence ends (. ! ?) and the white space after them, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), trim), lambda s: s != "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty strings."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def depth_band(depth: Column, most: Column) -> Column:
    ratio = depth / most
    return F.when(most == 0, "Root").when(ratio < 0.25, "Root").when(ratio < 0.5, "Near Root").when(ratio < 0.75, "Mid-Depth").otherwise("Leaf")
