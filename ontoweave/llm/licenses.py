"""License scans by diagonal voting.

Words are lower-case runs of letters and digits (anything beyond ASCII counts as one).  The hashes of all rolling word k-grams of a text
are joined to the positions of the same k-grams in license templates; a match at document word p and template word q votes
for the diagonal p - q.  Votes are counted by document, template and diagonal; diagonals up to two apart are merged, as an
inserted or lost word shifts the rest; and a merged span is verified on the words themselves: the share of the template's words
that stand at their place on one of its diagonals must reach ``least`` (phrases: all words, on one diagonal, so each place of a
phrase is one diagonal).

Templates are a constant of this module, so the broadcast side of the join has a fixed size.  Texts are read once: votes are
written, with a row for each document, which carries its words if some gram of it is in a template.  There is no shuffle of
k-grams without a match.

Nulls: a null text has no words.  Null ids are kept.  Rows that repeat an id are told apart by their text; equal rows get
equal results, once each.  Other columns are ignored, and an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, run_hashes, steps, utf8, word_hashes, word_spans, written

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Openings of licenses, license notices and whole short licenses, by label.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "rights-reserved": "all rights reserved unauthorized copying is prohibited",
}
PHRASE_GRAM, TEMPLATE_GRAM, APART = 2, 4, 2
#: The gram of a document's own row, where n2 is -1.
OWN = 0


def _grams(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, count for each row) of the k-grams within each row."""
    n = np.maximum(np.diff(rows) - k + 1, 0)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(rows[:-1], n)
    return run_hashes(words, k)[at] if len(at) else np.zeros(0, np.uint64), n


def _positions() -> list[tuple]:
    """(hash, label, base, q, words) of the template at word q, for all templates."""
    rows = []
    for base, templates in ((True, {v: k for k, v in PHRASES.items()}), (False, TEMPLATES)):
        for label, text in templates.items():
            data = np.frombuffer(text.encode(), np.uint8)
            spans, starts, ends = word_spans(data, np.array([0, len(data)]), NOT_ALNUM)
            hashes, _ = _grams(word_hashes(data, starts, ends), spans, PHRASE_GRAM if base else TEMPLATE_GRAM)
            rows += [(int(h), label, base, q, text.split(" ")) for q, h in enumerate(hashes.view(np.int64))]
    return rows


ROW = "doc_id long, t long, n_words long, n2 int, grams array<long>, words string"


def _scan(known: np.ndarray):
    """Two rows for each document: its grams (runs of two words, then of four), and its words if a gram is one of known."""
    names = ["doc_id", "t", "n_words", "n2", "grams", "words"]

    def run(batches):
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            for i, j in steps(offsets):
                part = LOWER[data[offsets[i] : offsets[j]]]
                rows, starts, ends = word_spans(part, offsets[i : j + 1] - offsets[i], NOT_ALNUM)
                words = word_hashes(part, starts, ends)
                (two, n2), (four, n4) = _grams(words, rows, PHRASE_GRAM), _grams(words, rows, TEMPLATE_GRAM)
                first2, first4 = np.cumsum(n2) - n2, np.cumsum(n4) - n4
                total = np.concatenate([[0], np.cumsum(n2 + n4)])
                both = np.empty(total[-1], np.uint64)
                both[np.repeat(total[:-1] - first2, n2) + np.arange(len(two))] = two
                both[np.repeat(total[:-1] + n2 - first4, n4) + np.arange(len(four))] = four
                grams = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(both.view(np.int64)))
                hit = np.zeros(j - i, bool)
                hit[np.searchsorted(total, np.flatnonzero(np.isin(both, known)), "right") - 1] = True
                shown = [" ".join(part[s:e].tobytes().decode() for s, e in zip(starts[rows[r] : rows[r + 1]], ends[rows[r] : rows[r + 1]], strict=True)) if h else None for r, h in enumerate(hit.tolist())]
                ids, t, n = batch.column("doc_id").slice(i, j - i), batch.column("t").slice(i, j - i), pa.array(np.diff(rows).astype(np.int64))
                own = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1), pa.int32()), pa.array(np.full(j - i, OWN)))
                yield pa.record_batch([ids, t, n, pa.array(n2.astype(np.int32)), grams, pa.nulls(j - i, pa.string())], names)
                yield pa.record_batch([ids, t, n, pa.array(np.full(j - i, -1, np.int32)), own, pa.array(shown, pa.string())], names)

    return run


def _votes(docs: DataFrame) -> DataFrame:
    """A row for each document (label null, with its words if needed), and the votes, written."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    positions = _positions()
    known = np.array(sorted({p[0] for p in positions}), np.int64).view(np.uint64)
    table = spark.createDataFrame([*positions, (OWN, None, None, None, None)], "h long, label string, base boolean, q int, template array<string>")
    rows = texts.mapInArrow(_scan(known), ROW).select("doc_id", "t", "n_words", "n2", "words", F.posexplode("grams").alias("at", "h"))
    votes = rows.join(F.broadcast(table), "h")  # the table is a constant of this module
    votes = votes.where(F.when(F.col("n2") < 0, F.col("label").isNull()).otherwise(F.col("base") == (F.col("at") < F.col("n2"))))
    word = F.when(F.col("base"), F.col("at")).otherwise(F.col("at") - F.col("n2"))
    return written(votes.select("doc_id", "t", "n_words", "words", "label", "base", "template", "q", (word - F.col("q")).alias("diagonal")), "license-votes")


def _spans(votes: DataFrame, least: float) -> DataFrame:
    key = ["doc_id", "t", "label", "base", "template"]
    lines = votes.where("label is not null").groupBy(*key, "diagonal").agg(F.min("q").alias("q"), F.count_distinct("q").alias("n"))
    phrases = lines.where(F.col("base") & (F.col("n") == F.size("template") - (PHRASE_GRAM - 1))).select(*key, F.array("diagonal").alias("diagonals"), F.col("diagonal").alias("first_word"))
    order = Window.partitionBy("doc_id", "t", "label").orderBy("diagonal")
    merged = lines.where(~F.col("base")).withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > APART, F.lit(True)).cast("int"))
    merged = merged.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*key, "span").agg(F.collect_list("diagonal").alias("diagonals"), F.min(F.col("diagonal") + F.col("q")).alias("first_word")).drop("span")
    texts = votes.where("label is null and words is not null").dropDuplicates(["doc_id", "t"]).select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), F.split("words", " ").alias("words"))
    found = phrases.unionByName(merged).join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t")))
    at = lambda q, d: F.get("words", (q + d).cast("int"))
    places = F.sequence(F.lit(0), F.size("template") - 1)
    right = F.filter(places, lambda q: F.exists("diagonals", lambda d: (q + d >= 0) & (at(q, d) == F.get("template", q))))
    share = F.size(right) / F.size("template")
    return found.select("doc_id", "t", "label", "base", "first_word", share.alias("similarity")).where(F.col("similarity") >= F.when(F.col("base"), 1.0).otherwise(least))


def license_spans(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, t (hash of the text), label, base, first_word, similarity: every verified span."""
    return _spans(_votes(docs), least)


def license_scan(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    votes = _votes(docs)
    base = F.col("base")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    found = _spans(votes, least).groupBy(F.col("doc_id").alias("_doc"), F.col("t").alias("_t")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("similarity").alias("score"),
    )
    texts = votes.where("label is null").select("doc_id", "t", "n_words")
    out = texts.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("t").eqNullSafe(F.col("_t")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def oracle_sql(least: float = 0.8) -> str:
    """The query's rows in SQL over the table documents: every run of words against every template, word by word."""
    values = ", ".join(f"('{label}', {str(base).lower()}, '{text}')" for base, of in ((True, {v: k for k, v in PHRASES.items()}), (False, TEMPLATES)) for label, text in of.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT label, base, string_split(text, ' ') AS tw, CASE WHEN base THEN {PHRASE_GRAM} ELSE {TEMPLATE_GRAM} END AS k FROM (VALUES {values}) AS x(label, base, text)),
        tg AS (SELECT label, base, k, q, array_to_string(tw[q + 1:q + k], ' ') AS g FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS q FROM t)),
        dg AS (SELECT r, p, k, array_to_string(w[p + 1:p + k], ' ') AS g FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM t))),
        lines AS (SELECT r, label, base, p - q AS diagonal, count(DISTINCT q) AS n, min(q) AS q FROM dg JOIN tg USING (k, g) GROUP BY ALL),
        phrases AS (SELECT r, label, [diagonal] AS diagonals, diagonal AS first_word FROM lines JOIN t USING (label) WHERE lines.base AND n = len(tw) - k + 1),
        news AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, label ORDER BY diagonal) > {APART}, true)::INT AS new FROM lines WHERE NOT base),
        spans AS (SELECT *, sum(new) OVER (PARTITION BY r, label ORDER BY diagonal) AS span FROM news),
        merged AS (SELECT r, label, list(diagonal) AS diagonals, min(diagonal + q) AS first_word FROM spans GROUP BY r, label, span),
        found AS (SELECT r, label, t.base, first_word,
            len(list_filter(range(0, len(tw)), lambda q: len(list_filter(diagonals, lambda d: q + d >= 0 AND w[q + d + 1] = tw[q + 1])) > 0)) / len(tw) AS similarity
            FROM (SELECT * FROM phrases UNION ALL SELECT * FROM merged) JOIN t USING (label) JOIN d USING (r)),
        good AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(first_word) FILTER (WHERE base) AS first_word, max(first_word) FILTER (WHERE base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(similarity) AS score
            FROM found WHERE similarity >= CASE WHEN base THEN 1 ELSE {least} END GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
            coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score
        FROM d LEFT JOIN good USING (r)"""
