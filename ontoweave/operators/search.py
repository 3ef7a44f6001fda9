"""Keyword search: an inverted index ranked by BM25, and keyword overlap by Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoweave.errors import NlpError
from ontoweave.operators.closure import cut

#: Words that carry no topic.
STOP_WORDS = "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()


def tokens(c):
    """Words of a text in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def prepared(c):
    return F.filter(tokens(c), lambda w: ~w.isin(STOP_WORDS))


def keywords(c):
    """Distinct words that carry a topic; stands in for a tagger's nouns, which a caller may plug in."""
    return F.array_distinct(F.filter(prepared(c), lambda w: F.length(w) > 2))


def verbs(c):
    """Words with a verb's ending, as a stand-in for a tagger."""
    return F.array_distinct(F.filter(prepared(c), lambda w: w.rlike("(ed|ing|ize|ise|ify|ates?)$")))


def lemmas(c):
    """Words without the commonest endings."""
    return F.array_distinct(F.transform(prepared(c), lambda w: F.regexp_replace(F.regexp_replace(w, "ies$", "y"), "(?<=[a-z]{3})(ing|ed|es|s)$", "")))


def named_entities(c):
    """Runs of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{Lu}[\p{L}]+(?: \p{Lu}[\p{L}]+)*)"), 1))


#: Query terms that are sent to all tasks; more are joined by shuffle.
MOST_TERMS = 200_000


def _asked(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """words (with a column term) of the wanted terms only."""
    terms = wanted.select("term").distinct()
    return words.join(F.broadcast(terms) if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS else terms, "term")


class Bm25:
    """An index over documents (id, text): their words, written once, and n and avgdl.

    idf is ln(k + (n - df + 0.5) / (df + 0.5)).
    """

    def __init__(self, docs: DataFrame, k1: float = 1.2, b: float = 0.75, k: float = 1.0):
        self.words = cut(docs.select("id", prepared(F.col("text")).alias("w")))
        totals = self.words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl")).first()
        if totals.n < 3:
            raise NlpError("an index needs at least three documents")
        self.n, self.avgdl, self.k1, self.b, self.k = totals.n, totals.avgdl, k1, b, k

    @property
    def postings(self) -> DataFrame:
        """term, id, dl, tf of all documents."""
        return self._of(self.words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")))

    @staticmethod
    def _of(words: DataFrame) -> DataFrame:
        return words.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))

    def search(self, queries: DataFrame, most: int = 10) -> DataFrame:
        """query_id, id, score (6 digits), rank from queries (query_id, text); each distinct word of a query counts once."""
        wanted = queries.select("query_id", F.explode(F.array_distinct(prepared(F.col("text")))).alias("term"))
        # only words that are asked for are counted and written; they serve df and scores
        asked = cut(self._of(_asked(self.words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")), wanted)))
        df = asked.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.ln(F.lit(self.k) + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / self.avgdl)
        part = idf * F.col("tf") * (self.k1 + 1) / norm
        scored = asked.join(df, "term").select("term", "id", part.alias("part")).join(wanted, "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def similar_documents(queries: DataFrame, docs: DataFrame, most: int = 10, words=keywords) -> DataFrame:
    """query_id, id, score, rank by the Jaccard similarity of keyword sets, above 0; pairs are found by common words."""
    q = queries.select("query_id", words(F.col("text")).alias("w")).select("query_id", F.size("w").alias("nq"), F.explode("w").alias("term"))
    d = docs.select("id", words(F.col("text")).alias("w")).select("id", F.size("w").alias("nd"), F.explode("w").alias("term"))
    common = _asked(d, q).join(q, "term").groupBy("query_id", "id", "nq", "nd").agg(F.count("*").alias("c"))
    scored = common.select("query_id", "id", F.round(F.col("c") / (F.col("nq") + F.col("nd") - F.col("c")), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
