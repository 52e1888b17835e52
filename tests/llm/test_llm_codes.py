"""Vector codes against a plain version that compares every part with every entry."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from parlance.llm import vector_codes
from parlance.llm.vector_codes import Codes, NearestEntries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, how):
    kept = [
        (i, [math.floor(how.scale * x) for x in v], label) for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // how.parts
    parts = [[ints[p * width : (p + 1) * width] for p in range(how.parts)] for _, ints, _ in kept]
    books = [[row[p] for row in parts[: how.entries]] for p in range(how.parts)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(books[p]))

    for _ in range(how.rounds):
        for p in range(how.parts):
            chosen = [nearest(row[p], p)[1] for row in parts]
            for e in range(len(books[p])):
                mine = [row[p] for row, c in zip(parts, chosen) if c == e]
                if mine:
                    books[p][e] = [sum(xs) // len(mine) for xs in zip(*mine)]
    coded = []
    for (i, _, label), row in zip(kept, parts):
        hits = [nearest(part, p) for p, part in enumerate(row)]
        coded.append((i, "".join(f"{e:02x}" for _, e in hits), sum(d for d, _ in hits), label))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return coded, sha256(text.encode()).hexdigest()


def vectors(rng, n, dim, spread=1.0):
    return [
        (i, [float(np.float32(rng.gauss(0, 1) * spread)) for _ in range(dim)], rng.choice([None, 0, 1]))
        for i in range(n)
    ]


def found_codes(df, how):
    coded, books = vector_codes.vector_codes(df, how=how)
    rows = vector_codes.with_label_error(coded).collect()
    return rows, vector_codes.digest(books)


@pytest.mark.parametrize("cell", [1, 64, 4096])
def test_codes_equal_a_plain_version(spark, cell):
    rng = random.Random(cell)
    how = Codes(parts=4, entries=5, rounds=3, cell=cell, max_cells=20)
    rows = vectors(rng, 60, 8, 0.2)
    rows += [rows[3], rows[3], (70, rows[5][1], 1)]
    rows += [
        (80, None, 1), (81, [None] + [0.1] * 7, 0), (82, [math.inf] + [0.0] * 7, 0),
        (83, [math.nan] * 8, None), (84, [0.5] * 4, 1), (None, [0.25] * 8, None),
    ]
    found, digest = found_codes(spark.createDataFrame(rows, SCHEMA).repartition(5), how)
    want, wanted_digest = plain_codes([r for r in rows if r[0] != 84], how)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in found) == sorted(
        (i is None, i or 0, code, error) for i, code, error, _ in want
    )
    assert digest == wanted_digest
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    assert all(r.label_error == sums[r.label] for r in found)


def test_cells_never_decide(spark):
    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (16, 4))
    entries[7] = entries[2]
    nearest = NearestEntries(entries, Codes(cell=32, max_cells=50))
    for _ in range(4):
        points = rng.integers(-320, 320, (700, 4))
        points[:40] = entries[rng.integers(0, 16, 40)]
        all_of_them = ((points[:, None] - entries[None]) ** 2).sum(2)
        best, distance = nearest.find(points)
        assert (best == all_of_them.argmin(1)).all() and (distance == all_of_them.min(1)).all()
    assert 0 < len(nearest.hashes) <= 50
    pruned = nearest._undominated(points >> nearest.shift)
    assert pruned.any(1).all() and pruned.mean() < 0.6


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "mixed", lambda x: x & np.uint64(3))
    rng = np.random.default_rng(4)
    entries = rng.integers(-300, 300, (9, 3))
    nearest = NearestEntries(entries, Codes(cell=16))
    for _ in range(3):
        points = rng.integers(-320, 320, (200, 3))
        assert (nearest.find(points)[0] == ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()


def test_few_no_and_unfit_vectors(spark):
    few = spark.createDataFrame([(5, [0.5] * 8, 1), (2, [-0.5] * 8, 1)], SCHEMA)
    rows, _ = found_codes(few, Codes(parts=4))
    assert sorted((r.vec_id, r.code, r.error) for r in rows) == [(2, "00000000", 0), (5, "01010101", 0)]
    assert found_codes(few.limit(0), Codes()) == ([], sha256(b"").hexdigest())
    with pytest.raises(ValueError):
        vector_codes.vector_codes(few, how=Codes(parts=3))
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA), how=Codes(parts=4))


def test_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(vectors(random.Random(1), 20, 8), SCHEMA)
    more = df.withColumns({c: F.lit("own") for c in ("id", "code", "error", "ints", "length", "peak", "vector", "_of")})
    assert found_codes(more, Codes()) == found_codes(df, Codes())
