import random
import re

import numpy as np
import pyarrow as pa

from parlance.llm.common import hashes_of, slices, words_of
from parlance.llm.runs import run_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spelled(words):
    return [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]


def test_words_are_runs_without_the_six_spaces():
    rng = random.Random(1)
    chars = "ab \t\n\x0b\x0c\r\x1c\u00a0\u2003é😀"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(12))) for _ in range(500)]
    texts[7] = None
    array = pa.array(texts)
    words = words_of(array)
    want = [WORD.findall(t or "") for t in texts]
    assert spelled(words) == [w for ws in want for w in ws]
    assert np.diff(words.first).tolist() == [len(w) for w in want]
    part = words_of(array.slice(100, 50))
    assert np.diff(part.first).tolist() == [len(w) for w in want[100:150]]


def test_equal_words_and_only_those_have_equal_hashes():
    texts = pa.array(["a b A", "b a", "ab c", "A"])
    words = words_of(texts)
    for lower in (False, True):
        fold = (lambda w: w.lower()) if lower else (lambda w: w)
        by_word = {}
        for word, h in zip(spelled(words), hashes_of(words, lower), strict=True):
            by_word.setdefault(fold(word), set()).add(int(h))
        assert all(len(v) == 1 for v in by_word.values())
        assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)


def test_run_hashes_tell_order_and_place():
    hashes = hashes_of(words_of(pa.array(["a b c a b c b a"])))
    found = run_hashes(hashes, np.arange(7), 2, 0xD6E8FEB86659FD93)
    assert found[0] == found[3] and found[0] != found[6] and len(set(found.tolist())) == 5


def test_slices_cover_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 9, 5 << 20, 1, 3 << 20, 2 << 20)])], ["t"])
    parts = list(slices(batch, "t"))
    assert sum(p.num_rows for p in parts) == 6 and len(parts) > 1
    assert [t for p in parts for t in p["t"].to_pylist()] == batch["t"].to_pylist()
    assert not list(slices(batch.slice(0, 0), "t"))
