"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased and cut into words of letters and digits; its features are the character n-grams (3 to 6, with the word's
ends marked) of all its words, hashed into buckets.  A bucket has an embedding; a bag's embeddings are averaged and a linear
softmax gives the class.  Embeddings and softmax are trained together, so a misspelling that training never saw shares
the vectors of the n-grams it has in common with known words.

Training goes from whole texts to parts of them.  In the first epochs a bag is a whole document (its distinct n-grams, averaged).
Then a bag is a stretch of ``WINDOW`` words, and a document is as toxic as its worst stretch, so one insult in a long text is not
averaged away: the gradient goes to the stretch that scores highest (and for clean documents to several).  Scores are those of the
worst stretch.  All vectors start at random.

Training rows are labelled rows outside the held-out fold (crc32 of the id as text, modulo 3, is 1), at most ``rows`` of each
class and of at most ``chars`` characters, in the order of a hash of their id; that bounds what the driver collects.  Inputs
are the texts alone.  Scoring is a table of one number for each bucket (the model is linear in the average), sent to the tasks, and reads
whole texts.  Training runs in a fixed order from a fixed seed, so a model depends on the table only.

Nulls: a null or wordless text is a bag without features and gets the score of the bias; null ids are never training rows and
not held out.  Null labels are no labels; an id labelled twice counts as its larger label.  Without rows of both classes
all scores are the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_column, forget, steps, utf8

BUCKETS, DIM, SIZES, WINDOW = 1 << 18, 8, (3, 4, 5, 6), 4
SEPARATOR = 32
_ALNUM = np.array([chr(c).isalnum() and not 0xD800 <= c < 0xE000 for c in range(1 << 16)])


def features(texts: list[str]):
    """For the n-grams of texts: (bag of each, bucket of each, text of each bag)."""
    lowered = [t.lower() for t in texts]
    raw = "\n".join(lowered).encode("utf-32-le", "replace")
    code = np.frombuffer(raw, np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    alnum = _ALNUM[np.minimum(code, (1 << 16) - 1)]
    keep = alnum.copy()
    keep[1:] |= alnum[:-1]
    at = np.flatnonzero(keep)
    alnum = alnum[at]
    text = np.searchsorted(ends, at, "right")
    code = np.where(alnum, code[at], SEPARATOR).astype(np.uint64)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(texts))
    code, alnum, text = np.concatenate([[np.uint64(SEPARATOR)], code, [np.uint64(SEPARATOR)]]), np.concatenate([[False], alnum, [False]]), np.concatenate([text[:1], text, text[-1:]])
    begins = alnum & ~np.append(False, alnum[:-1])
    word = np.cumsum(begins)
    first = np.searchsorted(text[begins], np.arange(len(texts)))  # words before each text
    n_words = np.diff(np.append(first, begins.sum()))
    bags = np.maximum(1, -(-n_words // WINDOW))
    first_bag = np.cumsum(bags) - bags
    bag = first_bag[text] + np.minimum(np.maximum(word - 1 - first[text], 0) // WINDOW, bags[text] - 1)
    blanks = np.concatenate([[0], np.cumsum(~alnum)])
    hashed, out, where = code, [], []
    for n in range(2, max(SIZES) + 1):
        if len(code) < n:
            break
        hashed = hashed[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in SIZES:
            i = np.flatnonzero(blanks[n - 1 : len(code)] == blanks[1 : len(code) - n + 2])
            mixed = hashed[i] ^ (hashed[i] >> np.uint64(29))
            out.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int64))
            where.append(bag[i + 1])
    return np.concatenate(where), np.concatenate(out), np.repeat(np.arange(len(texts)), bags)


def _bags(texts: list[str]):
    """A function of a text's number: (cuts of its stretches, their distinct buckets, how often each occurs).

    All texts' numbers are in three long arrays, which go back to the system as a whole; in many small ones, a driver would keep their
    memory after training.
    """
    chars = [len(t.lower()) + 2 for t in texts]  # at least the n-grams of one size; what is not written takes no memory
    ends, used = np.zeros((len(texts) + 1, 2), np.int64), np.zeros(2, np.int64)
    held = [np.empty(sum(chars) + len(texts), np.int32), *(np.empty(len(SIZES) * sum(chars), kind) for kind in (np.int32, np.float32))]
    for d, text in enumerate(texts):
        bag, bucket, of = features([text])
        key, n = np.unique(bag * BUCKETS + bucket, return_counts=True)
        got = np.searchsorted(key // BUCKETS, np.arange(len(of) + 1)), key % BUCKETS, n
        for k, x in enumerate(got):
            at = int(used[min(k, 1)])
            held[k][at : at + len(x)] = x
        used += len(got[0]), len(got[1])
        ends[d + 1] = used

    def of_text(d: int):
        (c, i), (e, j) = ends[d], ends[d + 1]
        return held[0][c:e].astype(np.int64), held[1][i:j], held[2][i:j]

    return of_text


class Model:
    """Buckets' embeddings, softmax weights and bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embeddings = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / (5 * DIM)
        self.weights = (rng.random((DIM, 2), np.float32) - 0.5) * 2
        self.bias = np.zeros(2, np.float32)

    def fit(self, texts: list[str], labels: list[int], whole: int = 3, epochs: int = 6, rate: float = 0.3, seed: int = 7) -> "Model":
        """Trains for ``whole`` epochs on whole documents, then for ``epochs`` on their worst stretches."""
        rng = np.random.default_rng(seed)
        docs = _bags(texts)
        self.weight = len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))
        self.squares = np.full(BUCKETS, 1e-3, np.float32)
        self.w_squares, self.b_squares = np.full((DIM, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32)
        for epoch in range(whole + epochs):
            for d in rng.permutation(len(texts)):
                cuts, bucket, n = docs(d)
                if epoch < whole:
                    bucket = np.unique(bucket)
                    self._learn(bucket, np.ones(len(bucket), np.float32), labels[d], rate)
                    continue
                # the worst stretch, and for clean texts others at random
                chosen = {int(self._margins(cuts, bucket, n).argmax())} | (set(rng.integers(len(cuts) - 1, size=2).tolist()) if not labels[d] else set())
                for i in sorted(chosen):
                    self._learn(bucket[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]], labels[d], rate)
        return self

    def _learn(self, bucket: np.ndarray, n: np.ndarray, label: int, rate: float) -> None:
        """One step for a bag: the embeddings' average goes into the softmax, the gradient to both."""
        if not len(bucket):
            return
        share = n / n.sum()
        mean = share @ self.embeddings[bucket]
        logits = mean @ self.weights + self.bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        g = (p * self.weight[label]).astype(np.float32)
        back = self.weights @ g
        w_grad = np.outer(mean, g)
        self.w_squares += w_grad**2
        self.b_squares += g**2
        self.weights -= rate * 0.1 * w_grad / np.sqrt(self.w_squares)
        self.bias -= rate * 0.1 * g / np.sqrt(self.b_squares)
        self.squares[bucket] += share**2 * (back @ back)
        self.embeddings[bucket] -= (rate * share / np.sqrt(self.squares[bucket]))[:, None] * back

    def _margins(self, cuts, bucket, n):
        got = np.append(n * (self.embeddings[bucket] @ (self.weights[:, 1] - self.weights[:, 0])), 0)
        at = np.minimum(cuts[:-1], len(got) - 1)
        return np.where(cuts[:-1] == cuts[1:], 0, np.add.reduceat(got, at) / np.maximum(1, np.add.reduceat(np.append(n, 0), at)))

    def scalars(self) -> tuple[np.ndarray, float]:
        """One number for each bucket and a bias: a bag's logit is the mean of its buckets' numbers plus the bias."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def score_texts(texts: list[str], values: np.ndarray, bias: float) -> np.ndarray:
    bag, bucket, of = features(texts)
    n = np.bincount(bag, minlength=len(of))
    logit = np.bincount(bag, values[bucket], len(of)) / np.maximum(n, 1) + bias
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, of, logit)
    return 1 / (1 + np.exp(-np.clip(worst, -50, 50)))


def held_out():
    return F.coalesce(crc32_column("doc_id") % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 1500, chars: int = 20_000) -> tuple[np.ndarray, float]:
    """(numbers of buckets, bias) from at most ``rows`` labelled rows of each class."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= chars)
    # the rows are chosen without their texts, which would have to be dealt out for the join; then few ids fetch theirs
    known = texts.select("doc_id", F.xxhash64("text").alias("t")).join(marks, "doc_id")
    best = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(rows).collect() for y in (0, 1)]
    wanted = {(r.doc_id, r.t): r.toxic for chosen in best for r in chosen}
    found = texts.where(F.col("doc_id").isin([i for i, _ in wanted])).select("doc_id", F.xxhash64("text").alias("t"), "text").collect() if wanted else []
    texts_of = {(r.doc_id, r.t): r.text for r in found if (r.doc_id, r.t) in wanted}
    both = [[(texts_of[k], y) for k, label in wanted.items() if label == y] for y in (0, 1)]
    if not all(both):
        share = len(both[1]) / max(1, len(both[0]) + len(both[1]))
        return np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    sample = [r for rows_of in both for r in rows_of]
    return Model().fit([text for text, _ in sample], [y for _, y in sample]).scalars()


def score(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.7, new: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with a score and the predicted class; these columns replace others of their names."""
    values = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the corpus
    names = [c for c in docs.columns if c not in new]
    docs = docs.select(*names)

    def run(batches):
        forget()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            offsets, _ = utf8(column)
            parts = [score_texts([x or "" for x in column.slice(i, j - i).to_pylist()], *values.value) for i, j in steps(offsets, 1 << 19)]
            found = np.concatenate(parts) if parts else np.zeros(0)
            arrays = [*batch.columns, pa.array(found), pa.array((found >= least).astype(np.int32))]
            yield pa.record_batch(arrays, [*batch.schema.names, *new])

    kind = T.StructType([*docs.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.IntegerType())])
    return docs.mapInArrow(run, kind)


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(texts, train(docs, labels), least).select("doc_id", "held_out", "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """docs without those predicted toxic."""
    scored = score(docs.withColumn("text", F.col("text").cast("string")), train(docs, labels), least, ("__ow_score", "__ow_toxic"))
    return scored.where("__ow_toxic = 0").select(*docs.columns)
