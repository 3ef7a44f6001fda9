"""Prompt text from units and constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.text import estimate_token_count, extract_label


def cardinality(c):
    low, high = c["min_card"], c["max_card"]
    required = F.when(low >= 1, "required").otherwise("optional")
    exact = F.when(low == 0, "not allowed").when(low == 1, F.concat(required, F.lit(" exactly 1 value"))).otherwise(F.concat(required, F.lit(" exactly "), low.cast("string"), F.lit(" values")))
    at_least = F.when(low == 1, "at least 1 value").when(low > 1, F.concat(F.lit("at least "), low.cast("string"), F.lit(" values")))
    at_most = F.when(high == 1, "at most 1 value").when(high.isNotNull(), F.concat(F.lit("at most "), high.cast("string"), F.lit(" values")))
    return F.when(low == high, exact).otherwise(F.concat_ws(", ", required, at_least, at_most))


def characteristics(c):
    return F.concat_ws(", ", F.when(c["max_card"] == 1, "functional"), F.when(c["is_symmetric"], "symmetric"), F.when(c["is_transitive"], "transitive"), F.when(c["is_inverse_functional"], "inverse-functional"))


def constraint(c):
    """A constraint in words: range and, in brackets, cardinality, characteristics and allowed values."""
    bottom, none = c["min_card"] > c["max_card"], F.size(c["ranges"]) == 0
    top = none & (c["min_card"] == 0) & c["max_card"].isNull() & (F.size(c["allowed_values"]) == 0)
    ranges = F.when(none, "any").otherwise(F.array_join(F.transform(c["ranges"], extract_label), " AND "))
    more = characteristics(c)
    allowed = F.when(F.size(c["allowed_values"]) > 0, F.concat(F.lit("allowed values: "), F.array_join(c["allowed_values"], ", ")))
    details = F.concat_ws("; ", cardinality(c), F.when(more != "", more), allowed)
    text = F.concat(ranges, F.lit(" ("), details, F.lit(")"))
    return F.when(bottom, "⊥ UNSATISFIABLE (contradictory constraints)").when(top, "(any type, unconstrained)").otherwise(text)


def property_line(c):
    return F.concat(F.lit("  - "), F.coalesce(c["label"], extract_label(c["prop_iri"])), F.lit(": "), constraint(c))


def source_note(c):
    return F.when(c["source"] == "restriction", " [from restriction]").when(c["source"] == "refined", " [refined from parent]").otherwise("")


def unit_text(inherited: bool = True, meta: bool = False):
    """Column: a unit's text."""
    line = lambda p: F.concat(F.lit("  - "), F.coalesce(p["label"], p["prop_iri"]), F.lit(" ("), extract_label(F.coalesce(F.get(p["ranges"], F.lit(0)), F.lit(""))), F.lit(") [inherited]"))
    parts = [F.concat(F.lit("IRI: "), "iri")] if meta else []
    parts.append(F.col("definition"))
    if inherited:
        parts.append(F.when(F.size("inherited") > 0, F.concat(F.lit("\nInherited Properties:\n"), F.array_join(F.transform("inherited", line), "\n"))))
    if meta:
        parts += [F.when(F.size("parents") > 0, F.concat(F.lit("\nParents: "), F.size("parents").cast("string"))), F.when(F.size("children") > 0, F.concat(F.lit("Children: "), F.size("children").cast("string")))]
    return F.concat_ws("\n", *parts)


def order(index: DataFrame, strategy: str = "topological", depths: DataFrame | None = None) -> DataFrame:
    """index with ord: by depth (parents first) and label, by label, or by IRI."""
    keys = {"topological": ["max_depth", "label", "iri"], "alphabetical": ["label", "iri"], "none": ["iri"]}[strategy]
    if strategy == "topological":
        index = index.join(depths.select("iri", "max_depth"), "iri", "left")
    return index.withColumn("ord", F.struct(*(F.coalesce(k, F.lit(0)).alias(k) if k == "max_depth" else F.collate(k, "UNICODE").alias(k) if k == "label" else F.col(k) for k in keys)))


@dataclass
class Prompt:
    """Parts of a prompt; + joins two."""

    system: list[str] = field(default_factory=list)
    user: list[str] = field(default_factory=list)
    examples: list[str] = field(default_factory=list)
    context: list[str] = field(default_factory=list)

    def __add__(self, other: "Prompt") -> "Prompt":
        return Prompt(self.system + other.system, self.user + other.user, self.examples + other.examples, self.context + other.context)


def structured_prompt(index: DataFrame, strategy: str = "topological", depths: DataFrame | None = None, context: list[str] | None = None, **options) -> Prompt:
    """A prompt of an index (a schema's size) in order; known entities go to its context."""
    rows = order(index, strategy, depths).select("ord", unit_text(**options).alias("text")).orderBy("ord").collect()
    return Prompt(system=[r.text for r in rows], context=list(context or []))


def header(title: str) -> str:
    return f"=== {title} ==="


def bullet_list(items, bullet: str = "-") -> str:
    return "\n".join(f"{bullet} {x}" for x in items)


def numbered_list(items) -> str:
    return "\n".join(f"{k}. {x}" for k, x in enumerate(items, 1))


def section(title: str, items) -> str:
    return "\n".join([header(title), *items, ""])


def render_prompt(p: Prompt) -> str:
    """System instructions, context (known entities included) and examples; empty parts are left out."""
    parts = [("SYSTEM INSTRUCTIONS", "\n\n".join(p.system)), ("CONTEXT", "\n".join(p.user + p.context)), ("EXAMPLES", "\n\n".join(p.examples))]
    return "\n".join(section(t, [x]) for t, x in parts if x)


def render_extraction_prompt(p: Prompt, text: str) -> str:
    task = "\n".join([header("TASK"), "Extract knowledge graph from the following text:", "", text, "", "Return a valid JSON object matching the schema with all extracted entities and their relationships."])
    before = render_prompt(p)
    return f"{before}\n{task}" if before else task


def fragments(index: DataFrame, depths: DataFrame) -> DataFrame:
    """ord, fragment_type, text, source_iri, tokens: an index's prompt in pieces that know where they come from."""
    lines = lambda c, kind: F.transform(c, lambda p: F.struct(F.lit(kind).alias("fragment_type"), property_line(p).alias("text"), p["prop_iri"].alias("property_iri")))
    head = F.array(F.struct(F.lit("class_definition").alias("fragment_type"), F.concat(F.lit("Class: "), "label").alias("text"), F.lit(None).cast("string").alias("property_iri")))
    rows = order(index, "topological", depths).select("ord", F.col("iri").alias("source_iri"), F.posexplode(F.concat(head, lines("properties", "property"), lines("inherited", "inherited_property"))).alias("k", "f"))
    return rows.select("ord", "k", "source_iri", "f.*", estimate_token_count(F.col("f.text")).alias("tokens"))


def fragment_stats(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("fragment_type").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def path_prompts(paths: DataFrame, definitions: DataFrame) -> DataFrame:
    """iri, system: a class's definition before those of all its descendants, once for each path that leads to them."""
    steps = paths.select(F.col("path"), F.posexplode("path").alias("k", "iri"))
    below = steps.select("iri", F.slice("path", F.col("k") + 1, F.size("path")).alias("sub"), F.element_at("path", -1).alias("leaf")).distinct()
    rows = below.join(definitions.select(F.col("iri").alias("leaf"), "definition"), "leaf")
    return rows.groupBy("iri").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub", "definition"))), lambda x: x["definition"]).alias("system"))


def bullet_sections(rows: DataFrame, by: str, text: str, tie: str, name: str = "prompt") -> DataFrame:
    """by and its rows' texts as a bullet list in order."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(text).alias("t"), F.col(tie)))), lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias(name))
