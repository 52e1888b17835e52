"""Token counts against the library that the vocabulary is written for."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parlance.llm import token_counts
from parlance.llm.queries import QUERIES
from parlance.llm.token_counts import Counter, Vocabulary

SF = "/root/testdata/sf0.001"
ALPHABET = (
    "aabcdethingsro  \n\t'sXYZ0123.,!?-_éÉßİΣςσ²½ªµ́̀̈\xa0\x85\x1c\x1f  K"
    "가가漢字😀👍🏽‍#<|>\x00"
)
TEXTS = [
    "", " ", "\n\n", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|>x", "<|ENDOFTEXT|>",
    "don't we'll I'D x", "a" * 5000, "ab" * 3000, "漢" * 2000, "é ́a", "word " * 3000,
]


def library_counts(name, texts):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name,drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_counts_equal_the_library(name, drops_space):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    with open(public_tokenizers.path(name)) as file:
        counter = Counter(file.read(), drops_space)
    assert [counter.count(t.encode()) for t in texts] == library_counts(name, texts)


def test_what_is_remembered_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_REMEMBERED", 3)
    with open(public_tokenizers.path("word_bpe_49k.json")) as file:
        counter = Counter(file.read(), True)
    texts = ["one two three four five six seven", "one seven three nine ten one"] * 3
    assert [counter.count(t.encode()) for t in texts] == library_counts("word_bpe_49k.json", texts)
    assert len(counter.fields) <= 3 and len(counter.fields.older) <= 3


def test_rows_nulls_repeats_and_clashing_columns(spark, docs_of, with_clashes):
    vocabulary = Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    long = "some words, " * 1500
    docs = docs_of((1, "Hello there."), (1, "Hello there."), (2, None), (3, ""), (None, "x"), (4, long))
    for table in (docs, with_clashes(docs)):
        rows = token_counts.token_counts(table, vocabulary).collect()
        found = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
        assert found == [
            (False, 1, 12, 3, False), (False, 1, 12, 3, False), (False, 2, 0, 0, False), (False, 3, 0, 0, False),
            (False, 4, len(long), 4500, True), (True, 0, 1, 1, False),
        ]
    assert token_counts.token_counts(docs.limit(0), vocabulary).count() == 0


def test_query_over_whole_table(spark):
    rows = {r.doc_id: r for r in QUERIES["op11_pair_heap_tokens"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    counts = library_counts("word_bpe_49k.json", [d.text or "" for d in docs])
    for doc, n in zip(docs, counts, strict=True):
        got = rows[doc.doc_id]
        assert (got.n_tokens, got.over_limit) == (n, n > 2048)
        assert got.n_bytes == len((doc.text or "").encode())


def test_unfit_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.PairRanks({"type": "Unigram"})
    with pytest.raises(ValueError):
        token_counts.PairRanks({"type": "BPE", "vocab": {"a": 0}, "merges": []}).count("ab")
