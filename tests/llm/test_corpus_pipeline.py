"""The pipeline and the queries' SQL on the driver's smallest tables."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def _plain_score(text, values, bias):
    """score_texts in plain Python: the worst stretch of four words."""
    import math

    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum() and ord(c) < 1 << 16:
            word += c
        elif word:
            words.append(word)
            word = ""
    worst = -math.inf
    for k in range(0, max(1, len(words)), 4):
        found = []
        for w in words[k : k + 4]:
            code = [32, *map(ord, w), 32]
            for n in (3, 4, 5, 6):
                for a in range(len(code) - n + 1):
                    h = code[a]
                    for c in code[a + 1 : a + n]:
                        h = (h * 0x9E3779B97F4A7C15 + c) % (1 << 64)
                    found.append(values[((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 46])
        worst = max(worst, sum(map(float, found)) / max(1, len(found)) + bias)
    return 1 / (1 + math.exp(-max(-50, min(50, worst))))


def _lines_kept(rows, words=50):
    """Texts after line dedup: later occurrences of three lines, of shorter runs of many words, and of whole short documents go."""
    size = lambda x: len(re.findall(r"[^ \t\r\f\x0b\n]+", x))
    places = {}
    for i, t in rows:
        h = t.split("\n")
        runs = [(s, n, "run") for n in (1, 2, 3) for s in range(len(h) - n + 1) if n == 3 or sum(map(size, h[s : s + n])) >= words]
        runs += [(0, len(h), "whole")] if len(h) < 3 and any(map(size, h)) else []
        for s, n, kind in runs:
            places.setdefault((kind, n, tuple(h[s : s + n])), []).append((i, s))
    gone = {}
    for (_, n, _), found in places.items():
        for i, s in found:
            if (i, s) != min(found):
                gone.setdefault(i, set()).update(range(s, s + n))
    kept = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in rows if len(gone.get(i, ())) < len(t.split("\n"))]
    return kept


def _classes(rows):
    """The smallest id of each class of similar texts."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

    def shingles(t):
        w = t.encode().translate(low).split()
        return {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return set(least.values())


def _contaminated(t, items):
    shingles = lambda x: [tuple(w[k : k + 5]) for w in [re.sub(r"[\W_]+", " ", x.lower()).split()] for k in range(len(w) - 4)]
    s = shingles(t)
    every = set(s)
    for c in items:
        if c and len(every.intersection(c)) * 5 >= 2 * len(set(c)):  # else no window can be similar
            for k in range(len(s)):
                w = s[k : k + len(c)]
                both = sum((Counter(w) & Counter(c)).values())
                if both / (len(w) + len(c) - both) >= 0.8:
                    return True
    return False


def test_pipeline_is_that_of_plain_python(spark):
    import corpus_pipeline as p
    from ontoweave.llm import toxicity
    from ontoweave.llm.queries import tokenizer_path

    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    values, bias = toxicity.train(docs, labels)  # the model itself is tested by its held-out accuracy
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [(i, t) for i, t in rows if _plain_score(t, values, bias) < 0.7]
    rows = _lines_kept(rows)
    kept = _classes(rows)
    rows = [(i, t) for i, t in rows if i in kept]
    items = [[tuple(w[k : k + 5]) for w in [re.sub(r"[\W_]+", " ", r.text.lower()).split()] for k in range(len(w) - 4)] for r in bench.collect()]
    rows = [(i, t) for i, t in rows if not _contaminated(t, items)]

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    ids = {i: [*e.ids, 0] for (i, _), e in zip(rows, tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)}
    got, placed, fill = p.run(spark, SF).collect(), {}, {}
    assert {r.doc_id for r in got} == set(ids)
    for r in got:
        mine = ids[r.doc_id]
        assert r.doc_tokens == len(mine) and r.ids_crc32 == zlib.crc32(np.array(mine[r.start : r.start + r.length], "<u4").tobytes())
        placed.setdefault(r.doc_id, []).append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, ends in [*((x, len(ids[i])) for i, x in placed.items()), *((x, None) for x in fill.values())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == ends if ends is not None else at <= 1024


def test_stages_return_the_columns_of_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "x"), (None, "", "x"), (1, "a b", "y"), (1, "a b", "y"), (2, "a b", "y"), (-3, "other words", None)], "doc_id long, text string, h string")
    for frame in (docs, odd, odd.limit(0)):
        here = frame
        for _, stage in p.STAGES[:-1]:
            here = stage(spark, here, SF)
            assert here.columns == frame.columns
            here = here.cache()
            here.count()
        if frame is odd:
            assert sorted((r.doc_id for r in here.collect()), key=repr) == [-3, 1, None, None]
        n = p.STAGES[-1][1](spark, here, SF).count()
        assert (n > 0) == (here.count() > 0)


def test_sql(spark):
    import duckdb

    from ontoweave.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in SQL.items():
        found = con.execute(sql)
        columns, want = [c[0] for c in found.description], found.fetchall()
        got = QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr), name
