"""Scoring of extracted triples against gold triples.

gold and pred: entry_id, idx, s, p, o.  A prediction counts for its best gold triple only; so true positives of an entry are its
distinct best gold triples, and no sequential matching is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.errors import EvaluationError
from ontoweave.functions.text import local_name, normalize_term, similarity

PARTS = ["s", "p", "o"]


def _normal(df: DataFrame) -> DataFrame:
    return df.withColumns({f"n_{c}": normalize_term(F.col(c)) for c in PARTS})


def _key():
    """The three normalised parts as one string; never null, so that no plan asks for its nulls apart from its value."""
    return F.coalesce(F.concat(*(x for c in PARTS for x in (normalize_term(F.col(c)), F.lit("\0")))), F.lit(""))


def _keyed(df: DataFrame, *columns: str) -> DataFrame:
    """entry_id, columns and key of rows without a null part."""
    return df.where(" and ".join(f"{c} is not null" for c in PARTS)).select("entry_id", *columns, _key().alias("key"))


def _by_key(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """entry_id, key (null for rows with a null part), gold and pred (the two sides' rows: idx, p).

    Both sides are dealt by entry once, before the keys are made; no later step of an entry needs another exchange.
    """
    sides = [df.select("entry_id", "idx", *PARTS, F.lit(g).alias("g")) for df, g in ((pred, 0), (gold, 1))]
    rows = sides[0].unionByName(sides[1]).repartition("entry_id")
    whole = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
    rows = rows.select("entry_id", F.when(whole, _key()).alias("key"), "g", F.struct("idx", "p").alias("row"))
    return rows.groupBy("entry_id", "key").agg(*(F.collect_list(F.when(F.col("g") == g, F.col("row"))).alias(n) for n, g in (("pred", 0), ("gold", 1))))


def semantic_only(pred: DataFrame) -> DataFrame:
    """Predictions but for types, labels and comments."""
    generic = F.lit(False)
    for mark in ("rdf-syntax-ns#type", "rdf-schema#label", "rdf-schema#comment"):
        generic = generic | F.contains("p", F.lit(mark))
    return pred.where(~generic)


def best_matches(pred: DataFrame, gold: DataFrame, mode: str = "strict", least: float = 0.8) -> DataFrame:
    """entry_id, idx, gold_idx, confidence: of each prediction the best gold triple of its entry (first of equals).

    Strict mode joins on the three normalised parts; relaxed mode compares within an entry, by the mean of three similarities.  Equal
    gold triples score equally, so the first of them is the one that is found.
    """
    if mode == "strict":
        first = _keyed(gold, "idx").groupBy("entry_id", "key").agg(F.min("idx").alias("gold_idx"))
        found = _keyed(pred, "idx").join(first, ["entry_id", "key"]).groupBy("entry_id", "idx").agg(F.min("gold_idx").alias("gold_idx"))
        return found.withColumn("confidence", F.lit(1.0))
    p = _normal(pred.repartition("entry_id")).select("entry_id", "idx", *(f"n_{c}" for c in PARTS))
    g = _normal(gold.repartition("entry_id")).select("entry_id", F.col("idx").alias("gold_idx"), *(F.col(f"n_{c}").alias(f"g_{c}") for c in PARTS))
    confidence = sum(similarity(F.col(f"n_{c}"), F.col(f"g_{c}")) for c in PARTS) / 3
    best = p.join(g, "entry_id").groupBy("entry_id", "idx").agg(F.min(F.struct((-confidence).alias("c"), "gold_idx")).alias("b")).where(F.col("b.c") <= -least)
    return best.select("entry_id", "idx", F.col("b.gold_idx").alias("gold_idx"), (-F.col("b.c")).alias("confidence"))


def _ratio(a, b):
    return F.when(b == 0, 0.0).otherwise(a / b)


def entry_metrics(pred: DataFrame, gold: DataFrame, mode: str = "strict") -> DataFrame:
    """entry_id, tp, fp, fn, precision, recall, f1 of every entry of either side."""
    if mode == "strict":  # an entry's triples are few: pairs of a prediction and the first gold triple of its key, as an array
        first = F.when(F.col("key").isNotNull(), F.array_min(F.transform("gold", lambda x: x["idx"])))
        pairs = F.when(first.isNotNull(), F.transform("pred", lambda x: F.struct(x["idx"].alias("idx"), first.alias("hit"))))
        rows = _by_key(pred, gold).select("entry_id", F.size("pred").alias("np"), F.size("gold").alias("ng"), pairs.alias("pairs"))
        rows = rows.groupBy("entry_id").agg(F.sum("np").alias("_np"), F.sum("ng").alias("_ng"), F.array_sort(F.flatten(F.collect_list("pairs"))).alias("pairs"))
        best = F.filter("pairs", lambda x, i: (i == 0) | (F.get("pairs", i - 1)["idx"] != x["idx"]))
        rows = rows.select("entry_id", "_np", "_ng", F.size(F.array_distinct(F.transform(best, lambda x: x["hit"]))).cast("long").alias("tp"))
    else:
        tp = best_matches(pred, gold, mode).groupBy("entry_id").agg(F.countDistinct("gold_idx").alias("tp"))
        n = pred.groupBy("entry_id").agg(F.count("*").alias("_np")).join(gold.groupBy("entry_id").agg(F.count("*").alias("_ng")), "entry_id", "full")
        rows = n.join(tp, "entry_id", "left").na.fill(0, ["_np", "_ng", "tp"])
    rows = rows.select("entry_id", "tp", (F.col("_np") - F.col("tp")).alias("fp"), (F.col("_ng") - F.col("tp")).alias("fn"))
    return _scores(rows)


def _scores(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(metrics: DataFrame) -> DataFrame:
    """Means of precision, recall and f1 over entries; sums of counts."""
    return metrics.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count("*").alias("entries"))


def micro(metrics: DataFrame) -> DataFrame:
    return _scores(metrics.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def top_missed(pred: DataFrame, gold: DataFrame, most: int = 10, side: str = "missed") -> DataFrame:
    """predicate, n: the most frequent predicates of gold triples without a strict match (or of predictions without one, side 'wrong')."""
    own, other = ("gold", "pred") if side == "missed" else ("pred", "gold")
    lost = _by_key(pred, gold).where(F.col("key").isNull() | (F.size(other) == 0)).select(F.explode(own).alias("row"))
    return lost.groupBy(local_name(F.col("row.p")).alias("predicate")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(most)


def fuzzy_match(a: str = "pred", b: str = "gold"):
    """Column: each part of one contains the other's (empty parts match nothing, a departure)."""
    def part(c):
        x, y = F.col(f"{a}_{c}"), F.col(f"{b}_{c}")
        return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))

    return part("s") & part("p") & part("o")


def mismatch_reasons(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """entry_id, idx, reason: why a prediction has no match."""
    p = _normal(pred)
    g = _normal(gold).select("entry_id", F.col("idx").alias("gold_idx"), F.col("s").alias("gs"), F.col("p").alias("gp"), F.col("o").alias("go"), *(F.col(f"n_{c}").alias(f"g_{c}") for c in PARTS))
    lost = p.join(g.select("entry_id", *(F.col(f"g_{c}").alias(f"n_{c}") for c in PARTS)), ["entry_id", "n_s", "n_p", "n_o"], "left_anti")
    share = lambda x, y: F.contains(x, y) | F.contains(y, x)
    sub, obj = share(F.col("n_s"), F.col("g_s")), share(F.col("n_o"), F.col("g_o"))
    why = F.when(sub & obj, F.concat(F.lit('Wrong predicate: used "'), local_name(F.col("p")), F.lit('" instead of "'), F.col("gp"), F.lit('"'))).when(sub, F.concat(F.lit('Subject matches "'), "gs", F.lit('", but object "'), "o", F.lit('" != "'), "go", F.lit('"')))
    generic = F.contains("p", F.lit("rdfs#")) | F.contains("p", F.lit("rdf-schema"))
    none = F.when(generic, F.concat(F.lit("Used generic RDFS predicate: "), local_name(F.col("p")))).otherwise("No partial match found in gold set")
    found = lost.join(g, "entry_id", "left").groupBy("entry_id", "idx", "p").agg(F.array_sort(F.collect_list(F.when(why.isNotNull(), F.struct("gold_idx", why.alias("why"))))).alias("whys"))
    return found.select("entry_id", "idx", F.when(F.size("whys") > 0, F.array_join(F.transform("whys", lambda x: x["why"]), "; ")).otherwise(none).alias("reason"))


def failed_entry(gold: DataFrame, errors: DataFrame) -> DataFrame:
    """Zero rows (all gold triples missed) with the error text, for entries whose extraction failed."""
    return gold.groupBy("entry_id").agg(F.count("*").alias("fn")).join(errors, "entry_id").select("entry_id", F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "fn", F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("f1"), "error")


def markdown_table(rows: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small table (aggregates; more than ``most`` rows are an error) as Markdown."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise EvaluationError(f"a report has at most {most} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [rows.columns, ["-"] * len(rows.columns), *([show(v) for v in r] for r in found)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def report(metrics: DataFrame, missed: DataFrame, wrong: DataFrame) -> str:
    """Scores over all entries, the worst entries, and the predicates that are missed and wrong most often, as Markdown."""
    worst = metrics.orderBy("f1", "entry_id").limit(10)
    parts = [("Scores", macro(metrics)), ("Lowest entries", worst), ("Missed predicates", missed), ("Wrong predicates", wrong)]
    return "\n\n".join(f"## {title}\n\n{markdown_table(rows)}" for title, rows in parts) + "\n"


def write_json(rows: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    rows.write.mode("overwrite").json(path)
