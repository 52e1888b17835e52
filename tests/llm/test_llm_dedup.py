import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import minhash, simhash, substring
from parlance.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def variants(seed, groups=12, words=60):
    """Texts with copies and near copies of every degree, ties and junk between."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "one", "one", "ONE", "one two three", "one  two\nthree"]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, words))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            new = list(base)
            for _ in range(rng.randrange(3)):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n"]).join(new) + rng.choice(["", " tail"]))
    return texts


def shingle_set(text, size):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_classes(rows, size, percent=80):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if None not in (i, j) and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), None if i is None else find(i)) for i, s in sets if i is not None)


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 5), (3, 3)])
def test_classes_equal_brute_force(docs_of, with_clashes, seed, size):
    texts = variants(seed)
    random.Random(seed).shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[3])]
    how = minhash.MinMax(words=size)
    got = minhash.near_duplicates(with_clashes(docs_of(*rows)), how=how).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_null_ids_and_repeated_ids(docs_of):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = minhash.near_duplicates(docs_of((None, a), (None, a), (5, a), (7, b), (7, a), (9, b))).collect()
    classes = sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None)
    assert classes == [(5, 5), (7, 5), (7, 5), (9, 5)]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_chain_and_large_group(docs_of):
    """Near copies linked only through others, and a large group, are one class each."""
    base = [f"c{i}" for i in range(100)]
    chain = []
    for step in range(8):
        chain.append(" ".join([f"n{i}" for i in range(step * 2)] + base[step * 2 :]))
    rng = random.Random(4)
    group = []
    for _ in range(150):
        words = [f"g{i}" for i in range(120)]
        words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        group.append(" ".join(words))
    rows = list(enumerate(chain + group))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(*rows)).collect()}
    assert got == {i: c for i, _, c in brute_classes(rows, 5)}
    assert {got[i] for i in range(8)} == {0} and {got[i] for i in range(8, 158)} == {8}


def test_empty_tables(docs_of, spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    assert substring.remove_repeats(empty).collect() == []
    assert simhash.compared_documents(empty).collect() == []


def test_min_and_max_estimate_similarity():
    a = pa.array([" ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(25, 125))])
    values, first = minhash.shingles(a, 1)
    how = minhash.MinMax(words=1, permutations=400, band_values=1)
    keys = minhash.band_keys(values, first, how)
    agree = (keys[0] == keys[1]).mean()
    assert keys.shape == (2, 800) and abs(agree - 75 / 125) < 0.06


def test_components_on_random_graphs(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {v: find(v) for p in pairs for v in p if find(v) != v}


def brute_removed(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, ws in words:
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            first[w] = min(first.get(w, float("inf")), order(i))
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < order(i):
                gone |= set(range(k, k + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, window, anchor", [(1, 12, 3), (2, 9, 8), (3, 10, 10)])
def test_removed_words_equal_brute_force(docs_of, with_clashes, seed, window, anchor):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(40)}" for _ in range(rng.randrange(window - 2, 3 * window))] for _ in range(6)]
    texts = [None, "", " ".join(["a"] * 40), " ".join(["a"] * 30)]
    for _ in range(40):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20))] + rng.choice(passages)
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    texts += texts[10:14]
    rows = list(enumerate(texts)) + [(20, texts[20]), (None, texts[12]), (None, texts[5])]
    how = substring.Repeats(window=window, anchor=anchor)
    got = substring.remove_repeats(with_clashes(docs_of(*rows)), how=how).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_removed(rows, window)


def test_full_sketch_loses_nothing(docs_of):
    """A sketch far too small lets more through, and the result is the same."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(400))) for i in range(60)]
    rows += [(100 + i, rows[i][1][50:900]) for i in range(20)]
    small = substring.Repeats(window=10, anchor=4, min_bits=16, max_bits=16)
    got = substring.remove_repeats(docs_of(*rows), how=small).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_removed(rows, 10)


def test_documents_meet_the_next_one(docs_of, with_clashes):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd é😀\n") for _ in range(rng.randrange(80))) for _ in range(60)]
    texts[5], texts[6] = None, texts[7]
    rows = [(i * 7 % 61 + 100, t) for i, t in enumerate(texts)]
    got = {r.id: r for r in simhash.compared_documents(with_clashes(docs_of(*rows))).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert sorted(got) == [i for i, _ in order]
    prints = {}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        new = simhash.edited(text, after)
        assert new == text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        if new == text:
            assert got[i].near_edited == 1
        assert 0 <= got[i].near_next <= 1


def test_one_document_is_its_own_next(docs_of):
    row = simhash.compared_documents(docs_of((1, "abcdefgh"))).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1


def test_likeness_follows_edits():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    how = simhash.SimHash()
    base = [" ".join(rng.choices(words, k=200)) for _ in range(60)]
    changed = [simhash.edited(a, b) for a, b in zip(base, base[1:] + base[:1], strict=True)]
    a, b, c = (simhash.fingerprints(pa.array(x), how) for x in (base, changed, base[1:] + base[:1]))
    near, far = simhash.likeness(a, b), simhash.likeness(a, c)
    assert near.min() > far.max() and abs(near.mean() - 0.75) < 0.1


@pytest.mark.parametrize("radius, blocks", [(3, 6), (2, 4), (0, 2)])
def test_block_tables_find_every_near_fingerprint(spark, radius, blocks):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 256, (20, 16), dtype=np.uint8)
    prints = [s for s in seeds]
    for s in seeds:
        for flips in range(6):
            bits = np.unpackbits(s)
            at = rng.choice(128, flips, replace=False)
            bits[at] ^= 1
            prints.append(np.packbits(bits))
    hexes = [p.tobytes().hex() for p in prints] * 2
    table = spark.createDataFrame([(h,) for h in hexes], "fingerprint string")
    queries = spark.createDataFrame([(s.tobytes().hex(),) for s in seeds], "fingerprint string")
    how = simhash.SimHash(radius=radius, blocks=blocks)
    got = {(r["query"], r.fingerprint, r.apart) for r in simhash.near_fingerprints(queries, table, how).collect()}
    want = set()
    for s in seeds:
        for p in prints:
            apart = int(np.bitwise_count(s ^ p).sum())
            if 0 < apart <= radius:
                want.add((s.tobytes().hex(), p.tobytes().hex(), apart))
    assert got == want


def test_edited_texts_are_found(docs_of, tmp_path, spark):
    """Near copies at Jaccard 0.8 and exact copies of query documents, by the query itself."""
    from parlance.llm.queries import QUERIES

    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        words = rng.choices(vocabulary, k=200)
        new = list(words)
        for at in rng.sample(range(200), 6):
            new[at] = rng.choice(vocabulary)
        rows += [(50 * i, " ".join(words)), (50 * i + 1, " ".join(words)), (50 * i + 2, " ".join(new)), (50 * i + 3, " ".join(rng.choices(vocabulary, k=200)))]
    rows.append((5000, rows[0][1]))
    docs_of(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all((got[50 * i + 1].near_queries, got[50 * i + 1].near_ids) == (1 + (i == 0), [50 * i]) for i in range(40))
    assert sum(got[50 * i + 2].near_ids == [50 * i] for i in range(40)) >= 38
    assert all(got[50 * i + 3].near_ids == [] and got[50 * i + 3].near_queries == 0 for i in range(40))
    assert (got[0].near_queries, got[5000].near_queries, got[50].near_queries) == (1, 1, 0)


@pytest.mark.parametrize("radius, blocks", [(26, 9), (3, 2), (20, 7)])
def test_wide_radius_finds_every_near_fingerprint(spark, radius, blocks):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 256, (8, 16), dtype=np.uint8)
    prints = [s for s in seeds]
    for s in seeds:
        for flips in range(0, radius + 4):
            bits = np.unpackbits(s)
            bits[rng.choice(128, flips, replace=False)] ^= 1
            prints.append(np.packbits(bits))
    table = spark.createDataFrame([(p.tobytes().hex(),) for p in prints], "fingerprint string")
    queries = spark.createDataFrame([(s.tobytes().hex(),) for s in seeds], "fingerprint string")
    how = simhash.SimHash(radius=radius, blocks=blocks)
    got = [(r["query"], r.fingerprint, r.apart) for r in simhash.near_fingerprints(queries, table, how).collect()]
    want = {
        (s.tobytes().hex(), p.tobytes().hex(), int(np.bitwise_count(s ^ p).sum()))
        for s in seeds for p in prints if 0 < np.bitwise_count(s ^ p).sum() <= radius
    }
    assert len(got) == len(set(got)) and set(got) == want
