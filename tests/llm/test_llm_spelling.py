"""Spelling variants against a plain version over the masked forms of each word."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from parlance.llm import spelling
from parlance.llm.queries import QUERIES
from parlance.llm.spelling import Variants

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs, least=7):
    counts = Counter()
    for name, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_near(words):
    masked, near = defaultdict(set), {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            masked[w[:i], w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_variants(docs):
    words = plain_words(docs)
    near, form, rows = plain_near(words), {}, set()
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return rows


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def near_pairs(spark, words, how):
    df = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long").repartition(4)
    rows = [(r.a, r.b) for r in spelling.near_words(df, how).collect()]
    assert len(rows) == len({frozenset(r) for r in rows})
    return {frozenset(r) for r in rows}


@pytest.mark.parametrize("how", [
    Variants(), Variants(max_list=1), Variants(max_list=3, max_frequent=5),
    Variants(shortest=3, longest=6), Variants(shortest=1, longest=3, max_list=2),
])
def test_no_pair_is_lost(spark, how):
    rng = random.Random(9)
    words = {"a" * n for n in range(7, 14)} | {"ab" * n for n in range(4, 9)}
    for _ in range(250):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 10)))
        at = rng.randrange(len(word))
        words |= {word, word[:at] + word[at + 1 :], word[:at] + "ö" + word[at:], word[:at] + "é" + word[at + 1 :]}
    # Around the lengths where grams grow longer.
    for size in (63, 64, 127, 128, 300):
        word = "".join(rng.choice("abcdefgh") for _ in range(size))
        words |= {word, word[:-1], word[1:], word[:30] + word[31:], word[:30] + "z" + word[30:], "z" + word[1:]}
    words = {w for w in words if len(w) >= 7}
    near = plain_near(words)
    assert near_pairs(spark, words, how) == {frozenset((w, o)) for w in words for o in near[w]}


def test_forms_and_roots_follow_to_the_last(spark, docs_of):
    chain = ["wonderfull", "wonderful", "wonderfol", "wonderfal"]
    text = " ".join([chain[0]] * 2 + [chain[1]] * 30 + [chain[2]] * 400 + [chain[3]] * 400)
    docs = [(1, text), (2, "Ünder-WONDERFUL ×÷abcdef ünder"), (3, None), (4, ""), (None, text), (1, text)]
    found = rows_of(spelling.spelling_variants(docs_of(*docs)))
    assert found == plain_variants(docs) and any(r[1] for r in found)


def test_places_leave_only_grams_that_do_not_touch_them():
    frequent = frozenset(("ab", "bc", "abc"))
    word = "abcabcdabcx"
    for gap in (False, True):
        covered = []
        for flag, left, right, first, last in spelling.places(word, 0, frequent, frozenset(g[::-1] for g in frequent), Variants()):
            if flag == gap:
                assert left <= first and right >= last + (0 if gap else 1)
                covered += range(first, last + 1)
        assert covered == list(range(len(word) + gap))


def test_frequent_grams_are_fewer_than_the_bound(spark):
    df = spark.createDataFrame([(f"{a}{b}common{a}", 1) for a in "abcdefgh" for b in "xyz"], "word string, n long")
    found = spelling.frequent_grams(df, Variants(max_frequent=20))
    assert "om" in found and len(found) < 20
    assert spelling.frequent_grams(df.limit(0)) == frozenset()


def test_long_runs_empty_table_and_clashing_columns(spark, docs_of, with_clashes):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghij") for _ in range(20_000))
    docs = [(1, f"{long} {long}"), (2, f"{long[:-1]} {long[:-1]} {long[1:]} {long[1:]}")]
    found = rows_of(spelling.spelling_variants(with_clashes(docs_of(*docs))))
    assert found == plain_variants(docs) and {r[4] for r in found} >= {2}
    assert rows_of(spelling.spelling_variants(docs_of((1, "x")).limit(0))) == set()


def test_query_over_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_gram_list_variants"](spark, SF)) == plain_variants(docs)
