"""The training-data operators against plain Python on a small corpus with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ontoweave.llm import chat, decontaminate, licenses, line_dedup, near_duplicates, packing, simhash, substring_dedup, token_files, tokens, topk, toxicity
from ontoweave.llm.queries import tokenizer_path

NO_ID = (1 << 63) - 1
SCHEMA = "doc_id long, text string, lang string, n_chars long, b int, t long, score string, predicted int, n_lines int, id string, key long"


def _corpus():
    rng = random.Random(5)
    words = [a + b for a in ("ka", "lo", "mi", "ru", "te", "é") for b in ("na", "shi", "do", "pe", "v")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, lines = say(70), [say(6) for _ in range(5)]
    texts = []
    for k in range(40):
        kind = k % 8
        body = say(rng.randint(1, 90))
        texts.append({0: body, 1: f"{body} {passage} {say(9)}", 2: "\n".join([body, *lines, say(4)]), 3: "", 4: body + "\n" + "\n".join(lines[1:4]), 5: f"{say(3)}\n{passage}", 6: passage + " " + passage, 7: body}[kind])
    rows = [(100 + 3 * (k * 7 % 40), t) for k, t in enumerate(texts)]
    rows += [(1, passage), (2, passage), (3, None), (4, "  \n \t"), (5, say(4000)), (6, "a\n" * 30), (7, texts[0]), (8, texts[0]), (9, "Ti"), (10, "Ti wh"), (None, passage), (None, texts[1]), (11, "same\nrow\nhere\nnow"), (11, "same\nrow\nhere\nnow")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", len(t or ""), 1, 2, "s", 5, 6, "i", 7) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _count(got):
    return sorted(map(tuple, got), key=repr)


def _without_repeats(rows, window=50):
    """Rows of substring_dedup, by looking at all windows."""
    first = {}
    for i, t in sorted(rows, key=lambda r: NO_ID if r[0] is None else r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), NO_ID if i is None else i)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (NO_ID if i is None else i):
                gone[k : k + window] = [True] * window
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return want


@pytest.mark.parametrize("limit", [substring_dedup.LIMIT, 3])
def test_substring_dedup(docs, rows, empty, limit):
    want = _without_repeats(rows)
    assert any(x[2] for x in want)
    assert _count(substring_dedup.substring_dedup(docs, limit=limit).collect()) == _count(want)
    spans = substring_dedup.substring_dedup(docs, spans=True, limit=limit).where("doc_id = 2").first()
    assert spans.removed_spans == [[0, 70]] and spans.kept == ""
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("limit", [substring_dedup.LIMIT, 0])
def test_substrings_of_few_words_and_of_long_texts(spark, limit):
    rng = random.Random(41)
    few = lambda n: " ".join(rng.choice(("a", "b", "abcdefghi", "abcdefgh")) for _ in range(n))
    runs = [few(60), "x " * 70, "x y " * 40, " ".join(_told(rng, 20))]
    rows = [(k, " ".join(rng.choice([few(rng.randint(1, 40)), rng.choice(runs)]) for _ in range(4))) for k in range(40)]
    say = " ".join(_told(rng, 300))
    long = [" ".join(_told(rng, 170_000)) for _ in range(2)]  # over a step, and all of them over a batch
    rows += [(100, f"{long[0]} {say}"), (101, f"{say}\n{long[1]} {say[: len(say) // 2]}"), (102, long[0][-2000:]), (99, say[:700])]
    odd = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))  # its polynomial hash is that of its complement
    rows += [(200, "so " * 49 + odd), (201, "so " * 49 + odd.translate(str.maketrans("ab", "ba")))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.substring_dedup(frame, limit=limit)
    assert _count(got.collect()) == _count(_without_repeats(rows))


def test_trees_have_nodes_of_all_depths():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (300, 12))
    order, common = substring_dedup.sorted_suffixes(rows)
    assert sorted(map(tuple, rows)) == [tuple(r) for r in rows[order]]
    for depth in (1, 5, 12):
        node = substring_dedup._nodes(order, common, depth)
        groups = {}
        for r, x in zip(rows[:, :depth].tolist(), node.tolist(), strict=True):
            groups.setdefault(x, set()).add(tuple(r))
        assert all(len(x) == 1 for x in groups.values()) and len(groups) == len({tuple(r) for r in rows[:, :depth].tolist()})


def test_line_dedup(docs, rows, empty):
    def place(i, t, k):
        return (NO_ID if i is None else i, t, k)

    seen = {}
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        for k in range(len(lines) - 2):
            seen.setdefault(tuple(lines[k : k + 3]), []).append(place(i, t, k))
    first = {k: min(p, key=lambda x: (x[0], x[2])) for k, p in seen.items()}
    want = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = [False] * len(lines)
        for k in range(len(lines) - 2):
            at, mine = first[tuple(lines[k : k + 3])], place(i, t, k)
            if (at[0], at[2]) < (mine[0], mine[2]):
                gone[k : k + 3] = [True] * 3
        want.append((i, len(lines), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(lines, gone, strict=True) if not g).encode()).hexdigest()))
    got = _count(line_dedup.digest(docs).collect())
    named = lambda x: [r for r in x if r[0] is not None]  # noqa: E731  rows without id that differ in text have no order by id
    assert named(got) == named(_count(want)) and len(got) == len(want)
    assert any(x[2] for x in want)
    assert line_dedup.line_dedup(empty).count() == 0
    kept = line_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    assert {r.n_lines for r in kept.collect()} == {6}
    assert kept.where("text is null").count() == 1 and all(r.n_chars == len(r.text or "") for r in kept.collect())


def _brute_print(t):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    w = (t or "").encode().translate(low).split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _brute_classes(prints):
    group = list(range(len(prints)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return [root(k) for k in range(len(prints))]


def test_simhash_classes(docs, rows, empty):
    prints = [_brute_print(t) for _, t in rows]
    roots = _brute_classes(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True)]
    assert _count(simhash.simhash_classes(docs).collect()) == _count(want)
    assert simhash.simhash_classes(empty).count() == 0
    kept = simhash.keep_one(docs)
    named = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert named == sorted({least[r] for (i, _), r in zip(rows, roots, strict=True) if i is not None})
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2


def test_links_of_long_lists_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(32, rng.integers(0, 5), replace=False)) for _ in range(3000)], np.uint64)
    fps = np.unique((centres[0] & ~np.uint64(0xFFFFFFFF)) | (centres[1] & np.uint64(0xFF)) ^ flips)
    out = []
    simhash._links(fps, (0, 1, 2, 3), out)
    at = {int(f): k for k, f in enumerate(fps)}
    group = list(range(len(fps)))

    def root(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for u, v in out:
        assert (np.bitwise_count(u ^ v) <= 3).all()
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            group[root(at[a])] = root(at[b])
    got = [root(k) for k in range(len(fps))]
    for k in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 3)
        assert len({got[j] for j in near}) == 1


def test_links_by_flipped_bits_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 20, 400, dtype=np.uint64))
    want = {(int(a), int(b)) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 3}
    out = []
    simhash._links_by_flips(fps, (0, 1, 2), out)
    assert {p for u, v in out for p in zip(u.tolist(), v.tolist(), strict=True)} == want
    monkeypatch.setattr(simhash, "VERY_LONG_LIST", 10)
    out = []
    simhash._links(fps, (0, 1, 2), out)
    assert {p for u, v in out for p in zip(u.tolist(), v.tolist(), strict=True)} == want


def test_other_texts_of_one_id_are_kept(spark):
    rng = random.Random(77)
    a, b = (" ".join(_told(rng, 40)) for _ in range(2))
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b), (None, a), (4, None), (5, ""), (6, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for keep in (simhash.keep_one, near_duplicates.keep_one):
        assert _count(keep(frame).collect()) == _count([(1, a), (1, b), (None, a), (4, None), (6, "x")])


def test_components_of_chains_and_hubs(spark):
    pairs = [(k, k + 1) for k in range(50)] + [(100, 200 + k) for k in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in [100, *range(200, 230)]}


def test_decontaminate(spark, docs, rows, empty):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(n))
    items = [(k, say(rng.randint(12, 40))) for k in range(12)] + [(50, None), (51, "too few words"), (52, "")]
    texts = list(rows)
    for k, t in items[:12]:
        w = t.split()
        texts.append((1000 + k, f"{say(30)} {t.upper()}, {say(8)}"))
        half = w[: len(w) // 2] + [say(1)] * (len(w) - len(w) // 2)
        texts.append((2000 + k, " ".join(half)))
        texts.append((3000 + k, f"{say(5)} {' '.join(w[:-1])}"))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda s: re.sub(r"[\W_]+", " ", (s or "").lower()).split()
    from collections import Counter

    def shingles(w):
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    want = {}
    for i, t in texts:
        s = shingles(words(t))
        for j, item in items:
            c = shingles(words(item))
            for k in range(len(s)):
                w = s[k : k + len(c)]
                both = sum((Counter(w) & Counter(c)).values())
                if c and both / (len(w) + len(c) - both) >= 0.8:
                    want[i, j] = max(want.get((i, j), 0), both / (len(w) + len(c) - both))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame, bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert {1000 + k for k in range(12)} <= {i for i, _ in got}
    left = {r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()}
    assert left == {i for i, _ in texts} - {i for i, _ in want}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def _best_windows(texts, items, least=0.8):
    """Similarity of the best item-sized window of every contaminated text and item, by looking at all windows."""
    shingles = lambda t: [tuple(w[k : k + 5]) for w in [re.sub(r"[\W_]+", " ", t.lower()).split()] for k in range(len(w) - 4)]
    found = {}
    for i, t in texts:
        s = shingles(t)
        for j, item in items:
            c = shingles(item)
            for k in range(len(s)):
                w = s[k : k + len(c)]
                both = sum((Counter(w) & Counter(c)).values())
                similar = both / (len(w) + len(c) - both)
                if similar >= least:
                    found[i, j] = max(found.get((i, j), 0), similar)
    return found


def _told(rng, n):
    return [f"{rng.randrange(1 << 30):x}" for _ in range(n)]


def _contaminated_pairs(spark, texts, items):
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame, bench).collect()}


def test_near_duplicates_of_similarity(spark, docs, rows, empty):
    rng = random.Random(31)
    texts, k = [], 0
    for n in (6, 9, 12, 30, 60, 200, 700):
        for _ in range(4):
            w = _told(rng, n)
            texts.append((k, " ".join(w)))
            for changed in {1, max(1, n // 60), max(1, n // 48), max(1, n // 40), max(1, n // 25)}:
                copy = list(w)
                for at in rng.sample(range(n), changed):
                    copy[at] = "changed"
                texts.append((k + changed, " ".join(copy).upper() + " "))
                texts.append((k + 40 + changed, " ".join(w[: n - changed * 4])))
            k += 100
    hot = _told(rng, 60)
    texts += [(k + j, " ".join(_told(rng, 40) + hot)) for j in range(30)]
    texts += [(k + 100 + j, " ".join(hot[:j] + ["x"] + hot[j + 1 :])) for j in range(60)]
    texts += [(0, "another text of the first id"), (0, texts[0][1]), (None, texts[0][1]), (None, "b"), *rows]

    def shingles(t):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
        w = (t or "").encode().translate(low).split()
        return {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()

    named = sorted({(i, t) for i, t in texts if i is not None}, key=repr)
    sets = [shingles(t) for _, t in named]
    group = list(range(len(named)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    far = 0
    for a in range(len(named)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
                far += (_brute_print(named[a][1]) ^ _brute_print(named[b][1])).bit_count() > 3
    least = {}
    for x, (i, _) in enumerate(named):
        least[root(x)] = min(i, least.get(root(x), i))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kept = near_duplicates.keep_one(frame)
    assert far > 100 and kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(least.values())
    assert kept.where("doc_id is null").count() == sum(i is None for i, _ in texts)
    assert near_duplicates.keep_one(docs).columns == docs.columns
    assert near_duplicates.keep_one(empty).count() == 0


def test_items_cut_at_the_end_of_a_document(spark):
    rng = random.Random(21)
    items, texts = [], []
    for k in range(8):
        w = _told(rng, 40)
        items.append((k, " ".join(w)))
        for cut in (4, 5, 6, 7, 8):
            texts.append((1000 * cut + k, " ".join(_told(rng, 20) + w[:-cut])))
            texts.append((1000 * cut + 100 + k, " ".join(w[:-cut])))
    want = _best_windows(texts, items)
    got = _contaminated_pairs(spark, texts, items)
    assert {i // 1000 for i, _ in want} == {4, 5, 6, 7}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_similar_windows_of_distant_fingerprints(spark):
    rng = random.Random(22)
    items, texts = [], []
    for k in range(600):
        w = _told(rng, 9)
        items.append((k, " ".join(w)))
        texts.append((k, " ".join(w[:-1])))
    got = _contaminated_pairs(spark, texts, items)
    assert got == {(k, k): 0.8 for k in range(600)}


def test_clean_texts_of_a_contaminated_id_stay(spark):
    rng = random.Random(23)
    item = " ".join(_told(rng, 20))
    texts = [(None, item), (None, "a clean text"), (1, f"so {item}"), (1, "another clean text"), (2, "clean")]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(0, item), (None, item)], "item_id long, text string")
    left = decontaminate.decontaminate(frame, bench).collect()
    assert _count(left) == _count([x for x in texts if item not in x[1]])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()} == {(i, j) for i in (None, 1) for j in (0, None)}


def test_repeats_of_fewer_lines_than_the_window(spark):
    rng = random.Random(24)
    say = lambda n: " ".join(_told(rng, n))
    one, half, rest, short = say(50), say(25), say(30), say(49)
    texts = [(1, one), (2, one), (3, f"x\n{one}\ny\nz"), (4, f"{half}\n{rest}"), (5, f"a\n{half}\n{rest}\nb"), (6, f"{half}\nc"), (7, short), (8, f"{short}\nd"), (9, short), (10, f"{one}\n{one}"), (10, f"{one}\n{one}"), (None, f"e\n{one}"), (11, ""), (12, ""), (13, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = _count(line_dedup.without_repeats(frame).collect())
    assert got == _count([(1, one), (3, "x\ny\nz"), (4, f"{half}\n{rest}"), (5, "a\nb"), (6, f"{half}\nc"), (7, short), (8, f"{short}\nd"), (None, "e"), (11, ""), (12, ""), (13, None)])
    assert _count(line_dedup.without_repeats(frame, words=None).collect()) == _count(texts)


def _ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)]


def test_tokens_of_pieces_are_those_of_whole_texts():
    rng = random.Random(1)
    texts = ["", " a  b ", "a\n\nb", "x\t y z", "don't\n I'll \x1c q", "\0 a b\0", "<|endoftext|> a", "日本 語 テキスト　x", "x² 5½ ٣٤", "it 's 8_9 __ ' s."]
    texts += ["".join(rng.choice("ab \n\t' \x1cs1,._é²\0") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    e = tokens.Encoder(tokenizer_path())
    for _ in range(2):
        cuts, ids = e.encode(texts)
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:z].tolist() for a, z in zip(cuts, cuts[1:], strict=False)] == want


def test_packing(docs, rows, empty, spark):
    ids = {}
    for (i, t), x in zip(rows, _ids(rows), strict=True):
        ids.setdefault((i, len(x)), []).append(x)
    got = packing.pack(docs, tokenizer_path(), size=64).collect()
    fill, covered = {}, {}
    for r in got:
        raws = [zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[r.doc_id, r.doc_tokens]]
        assert r.ids_crc32 in raws
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered[r.doc_id, r.doc_tokens] = covered.get((r.doc_id, r.doc_tokens), 0) + r.length
    assert covered == {k: sum(map(len, x)) for k, x in ids.items()}
    waste = 0
    for parts in fill.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 64
        waste += 64 - end
    assert waste <= 64 * 4
    assert packing.pack(empty, tokenizer_path()).count() == 0
    few = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    seqs = packing.sequences(few, tokenizer_path(), size=16).collect()
    assert sum(r.n_tokens for r in seqs) == 4 + 2 and all(len(r.input_ids) in (1, 2, 4, 8, 16) for r in seqs)


def test_packed_sequences_hold_all_documents(spark):
    rng = random.Random(6)
    few = [(1, "one two three"), (1, "one two three"), (1, "another text"), (None, "no id"), (None, "no id"), (None, None), (2, ""), (3, " ".join(_told(rng, 30)))]
    frame = spark.createDataFrame(few, "doc_id long, text string").repartition(3)
    seqs = packing.sequences(frame, tokenizer_path(), size=16).collect()
    want = sorted(i for x in _ids(few) for i in x)
    assert sorted(i for r in seqs for i in r.input_ids[: r.n_tokens]) == want
    assert all(len(r.input_ids) in (1, 2, 4, 8, 16) and set(r.input_ids[r.n_tokens :]) <= {0} for r in seqs)
    assert packing.sequences(frame.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("lengths", [[700], [513], [1023], [5000], [1, 700, 900], "mixed"])
def test_patterns_leave_little_padding(lengths):
    rng = np.random.default_rng(8)
    n = np.concatenate([rng.integers(1, 3000, 3000), rng.integers(500, 1024, 1000), rng.integers(1, 60, 1500)]) if lengths == "mixed" else np.resize(lengths, 4000)
    row, start, length = packing.cut(n, 1024, np.zeros(1025, np.int64))
    for i in range(0, len(n), 37):
        mine = row == i
        assert start[mine].tolist() == (np.cumsum(length[mine]) - length[mine]).tolist() and length[mine].sum() == n[i] and length[mine].max() <= 1024
    slots = packing.plan(dict(Counter(length.tolist())), 1024)
    fill, placed = {}, Counter()
    for size, _, each, offset, first, times in slots:
        placed[size] += each * times
        for s in range(first, first + times):
            fill.setdefault(s, []).append((offset, each * size))
    assert placed == Counter(length.tolist())
    for parts in fill.values():
        ends = np.cumsum([0, *(k for _, k in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 1024
    assert len(fill) * 1024 <= 1.005 * n.sum() + 1024


def test_column_generation_reaches_the_bound():
    lengths, demand = np.array([3, 5, 7]), np.array([40.0, 30, 20])
    patterns, amounts = packing.column_generation(lengths, demand, 15)
    assert np.allclose(patterns.T @ amounts, demand) and (patterns @ lengths <= 15).all()
    assert amounts.sum() <= (lengths * demand).sum() / 15 * 1.01 + 1


def test_token_files(docs, rows, empty):
    manifest = token_files.write_token_shards(docs, tokenizer_path())
    got = sorted(token_files.read_token_shards(manifest).collect(), key=lambda r: r.start)
    want = sorted(((NO_ID if i is None else i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, _ids(rows), strict=True))
    assert sorted((NO_ID if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    known = [NO_ID if r.doc_id is None else r.doc_id for r in got]
    assert known == sorted(known)
    shard = next(token_files.Shard(r.path) for r in manifest.collect() if r.first_id <= 5 <= r.last_id)
    assert shard.get(5).tolist() == next(x for (i, _), x in zip(rows, _ids(rows), strict=True) if i == 5)
    assert shard.get(-12345) is None
    assert token_files.read_token_shards(token_files.write_token_shards(empty, tokenizer_path())).count() == 0


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 100, 5000):
        keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
        slots = token_files.mph_slots(keys, token_files.build_mph(keys))
        assert sorted(slots) == list(range(len(keys)))


def test_license_scan(spark, docs, rows, empty):
    extra = [(900, "MIT License and the mit\nlicense; GNU General Public License"), (901, licenses.TEMPLATES["mit-grant"].replace("person", "people")), (902, "Licensed under the Apache License, Version 2.0."), (903, "licensed under é cc by-nc 4.0"), (904, "license mit")]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {}
    for r in licenses.license_scan(frame).collect():
        got.setdefault(r.doc_id, []).append(r)
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    assert sum(map(len, got.values())) == len(rows) + len(extra)
    for i, t in [*rows, *extra]:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(low))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.encode().split()]
        want = (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[i]]
    assert got[901][0].labels == "mit-grant" and 0.8 <= got[901][0].score < 1
    assert got[902][0].labels == "apache,apache-notice" and got[900][0].score == 1 and got[904][0].score == 0
    assert licenses.license_scan(empty).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("ab#\\<>/ turn:\n é") for _ in range(n))
    convs = {k: [(rng.choice(["user", "assistant", "system", "Odd: role", ""]), say(rng.randint(0, 20))) for _ in range(rng.randint(1, 6))] for k in range(60)}
    convs[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    rows = [(k, n, r, t) for k, turns in convs.items() for n, (r, t) in enumerate(turns)]
    rows += [(None, 0, None, None), (None, 1, "assistant", None), (None, None, "user", "no turn")]
    convs[None] = [("user", "no turn"), ("", ""), ("assistant", "")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    examples = chat.format_chats(frame)
    got = {r.conv_id: r for r in chat.read_back(chat.write_chats(frame)).collect()}
    size = {r.conv_id: r.n for r in examples.selectExpr("conv_id", "length(text) as n").groupBy("conv_id").sum("n").toDF("conv_id", "n").collect()}
    for k, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert tuple(got[k]) == (k, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size[k])
    assert examples.where("loss_start is not null").count() == sum(r == "assistant" for t in convs.values() for r, _ in t)
    assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(k, rng.normal(size=6).tolist()) for k in range(900)]
    vectors += [(900 + k, vectors[50][1]) for k in range(40)] + [(1000, None), (1001, [float("nan")] * 6), (1002, [None] * 6), (1003, [1.0]), (1050, [2.0]), (1100, []), (None, vectors[0][1]), (50, vectors[3][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(frame, "vec_id", "embedding")
    got = [tuple(r) for r in topk.top_k(v.where("id % 50 = 0"), v, block=200).collect()]
    good = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in vectors if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = set()
    for i in {i for i, _ in good if i % 50 == 0 and i != 50}:
        q = next(e for j, e in good if j == i)
        found = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), j) for j, e in good if j != i and len(e) == len(q))[:5]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(found)}
    assert {g for g in got if g[0] != 50} == want
    big = spark.createDataFrame([(0, [1e9, 2.0]), (1, [3e9, -1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    b = topk.integer_vectors(big, "vec_id", "embedding")
    assert [r.vec_id for r in topk.top_k(b.where("id = 0"), b).orderBy("rank").collect()] == [1, 2]
    assert topk.top_k(v.limit(0), v).count() == 0


def _labelled(n, seed, insults):
    rng = random.Random(seed)
    words = [a + b + c for a in ("ka", "lo", "mi", "ru") for b in ("na", "shi", "do", "pe") for c in ("", "v", "s")]
    out = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(10, 120))]
        toxic = int(k % 4 == 0)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        out.append((k, " ".join(w), toxic))
    return out


def test_toxicity(spark, docs, rows, empty):
    data = _labelled(600, 1, ["grobbish", "fulnork"])
    frame = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame, labels).collect()}
    truth = {i: y for i, _, y in data}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.7) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    model = toxicity.train(frame, labels)
    odd, clean = toxicity.score_texts(["kana shi grobishh grobbishes fulnorkk", "kanav lodo mishi rupe"], *model)
    assert odd > 0.7 > clean
    # held-out labels are no input
    flipped = labels.withColumn("toxic", labels.toxic.cast("int")).where("doc_id is not null").selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert np.array_equal(toxicity.train(frame, flipped)[0], model[0])
    out = toxicity.reject_toxic(docs, labels)
    assert out.columns == docs.columns and {r.predicted for r in out.collect()} <= {5}
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.toxicity(empty, labels).count() == 0


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


def test_toxicity_scores_are_those_of_plain_python(rows):
    rng = np.random.default_rng(12)
    values, bias = rng.normal(size=toxicity.BUCKETS).astype(np.float32) * 3, -0.3
    say = random.Random(3)
    texts = [t or "" for _, t in rows] + ["", "a", "É É", "Ünder_score 9x\U0001F600 b", "x" * 3000, " ".join(_told(say, 30_000)), "ok " * 200_000]
    got = np.concatenate([toxicity.score_texts(texts[i : i + 9], values, bias) for i in range(0, len(texts), 9)])
    assert np.allclose(got, [_plain_score(t, values, bias) for t in texts], atol=1e-9)
