import itertools
import random

import numpy as np
import pytest

from parlance.llm import mixing, packing, quality_model


def brute_padding(tops, counts, buckets):
    best = float("inf")
    n = len(tops)
    for k in range(1, min(buckets, n) + 1):
        for cuts in itertools.combinations(range(1, n), k - 1):
            ends = [*cuts, n]
            cost = start = 0
            for end in ends:
                cost += tops[end - 1] * sum(counts[start:end])
                start = end
            best = min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_give_the_least_padding(seed):
    rng = random.Random(seed)
    tops = sorted(rng.sample(range(200), rng.randrange(1, 9)))
    counts = [rng.randrange(1, 50) for _ in tops]
    for buckets in (1, 2, 3, 20):
        ends = packing.best_boundaries(tops, counts, buckets)
        assert len(ends) <= buckets and ends == sorted(set(ends)) and ends[-1] == tops[-1]
        cost = sum(min(e for e in ends if e >= t) * c for t, c in zip(tops, counts, strict=True))
        assert cost == brute_padding(tops, counts, buckets)


def test_length_bins_grow_with_the_length(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 70_000).withColumn("bin", packing.length_bin(F.col("id"), 12)).collect()
    bins = [r.bin for r in sorted(rows)]
    assert bins == sorted(bins) and bins[:4096] == list(range(4096)) and len(set(bins)) < 4500


def test_batches(docs_of, with_clashes):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 41, 300]))) for i in range(400)]
    rows += [(1000, None), (1001, "w " * 5000), (7, rows[7][1])]
    how = packing.Buckets(buckets=4, budget=600, block_rows=50)
    got = packing.pack(with_clashes(docs_of(*rows)), how=how).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    sizes = {i: len((t or "").split()) for i, t in rows}
    batches = {}
    for r in got:
        assert r.length == sizes[r.doc_id] and r.padding == r.bucket_len - r.length >= 0
        batches.setdefault((r.bucket_len, r.block, r.batch), []).append(r.slot)
    for (top, _, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) == 1 or len(slots) * top <= how.budget or top == 0
    assert len({b[0] for b in batches}) <= 4
    again = packing.pack(docs_of(*rows), how=how).select("doc_id", "block", "batch").collect()
    assert sorted(again) == sorted((r.doc_id, r.block, r.batch) for r in got)


def test_given_lengths(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "x", None), (3, "x", -4)], "doc_id long, text string, n int")
    assert sorted((r.doc_id, r.length) for r in packing.pack(df, length="n").collect()) == [(1, 5), (2, 0), (3, 0)]


def test_targets():
    goals = mixing.targets({"a": 100, "b": 100, "c": 10, None: 90}, mixing.Mix())
    assert goals == {"a": 187.5, "b": 62.5, "c": 20, None: 180} and sum(goals.values()) == 450
    assert mixing.targets({}, mixing.Mix()) == {} and mixing.targets({"a": 0}, mixing.Mix()) == {"a": 0}


def brute_flow(patterns, quotas, repeats):
    """Most words that can be given, and the least cost for them, over all integer flows."""
    edges = [(i, s) for i, (members, _) in enumerate(patterns) for s in sorted(members)]
    best = (-1, 0)
    for amounts in itertools.product(*(range(min(repeats * patterns[i][1], quotas[s]) + 1) for i, s in edges)):
        given, taken = [0] * len(patterns), dict.fromkeys(quotas, 0)
        for (i, s), a in zip(edges, amounts, strict=True):
            given[i] += a
            taken[s] += a
        if any(g > repeats * size for g, (_, size) in zip(given, patterns, strict=True)) or any(
            taken[s] > q for s, q in quotas.items()
        ):
            continue
        cost = sum(sum(min(max(g - k * size, 0), size) * (k + 1) for k in range(repeats))
                   for g, (_, size) in zip(given, patterns, strict=True))
        best = max(best, (sum(given), -cost))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_largest_and_cheapest(seed):
    rng = random.Random(seed)
    sources = "abc"
    patterns = [(frozenset(rng.sample(sources, rng.randrange(1, 3))), rng.randrange(3)) for _ in range(3)]
    quotas = {s: rng.randrange(5) for s in sources}
    flow = mixing.min_cost_flow(patterns, quotas, 2)
    given = [sum(f.values()) for f in flow]
    taken = {s: sum(f.get(s, 0) for f in flow) for s in sources}
    assert all(v >= 0 for f in flow for v in f.values()) and all(taken[s] <= quotas[s] for s in sources)
    cost = sum(min(g, size) + 2 * max(g - size, 0) for g, (_, size) in zip(given, patterns, strict=True))
    assert (sum(given), -cost) == brute_flow(patterns, quotas, 2)


def test_mix_comes_near_its_targets(docs_of, with_clashes):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(200), rng.choice(["a", "b", "c", None])) for i in range(600)]
    rows += [(1000, None, "a"), (3, rows[3][1], rows[3][2])]
    taken, words, goals = mixing.mix_sources(with_clashes(docs_of(*rows)))
    out = taken.collect()
    assert len(out) == len(rows) and all(0 <= r.times <= 2 for r in out)
    for s, goal in goals.items():
        mine = [r for r in out if r.pattern == ("[null]" if s is None else f'["{s}"]')]
        assert words[s] == sum(r.size for r in mine)
        assert abs(sum(r.times * r.size for r in mine) - goal) <= 200
    again = {(r.id, r.size): r.times for r in mixing.mix_sources(docs_of(*rows))[0].collect()}
    assert again == {(r.id, r.size): r.times for r in out}
    mixed = mixing.mixed_documents(docs_of(*rows))
    assert mixed.columns == docs_of(*rows).columns
    assert mixed.count() == sum(r.times for r in out)


def test_documents_that_do_not_fit_are_set_aside(docs_of, tmp_path, spark):
    from parlance.llm.queries import QUERIES

    rows = [(i, "w " * 5, "a\x0b") for i in range(300)] + [(1000 + i, "w " * 4000, "a\x0b") for i in range(3)]
    docs = docs_of(*rows)
    for seed in (1, 2):
        taken, _, goals = mixing.mix_sources(docs, mix=mixing.Mix(weights=(1,), percent=40, seed=seed))
        out = taken.agg({"id": "count"}).first()[0], sum(r.times * r.size for r in taken.collect())
        assert out[0] == 303 and abs(out[1] - sum(goals.values())) <= 5
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op7_source_mix"](spark, str(tmp_path)).count() == 303


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate([["a"], ["a", "b"], ["b", "a"], ["b"], [], None, ["a", "a"]] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    taken, words, goals = mixing.mix_sources(docs, mix=mixing.Mix(weights=(1,), percent=50))
    assert words == {"a": 800, "b": 600}
    out = taken.collect()
    assert all(r.times == 0 for r in out if r.pattern == "[]")
    assert sum(r.times * r.size for r in out) == pytest.approx(sum(goals.values()), abs=20)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    taken, words, goals = mixing.mix_sources(empty)
    assert taken.collect() == [] and words == {} and goals == {}
    assert mixing.mixed_documents(empty).collect() == [] and packing.pack(empty).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.train(empty, labels)
    assert quality_model.scored(empty, model).collect() == []


def test_gam_learns_shapes_and_interactions():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (np.abs(x[:, 2]) > 0.9)).astype(float)
    model = quality_model.fit(x[:3000], y[:3000])
    right = ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean()
    assert right > 0.9
    alone = quality_model.fit(x[:3000], y[:3000], quality_model.Gam(pairs=0))
    assert ((alone.scores(x[3000:]) > 0.5) == y[3000:]).mean() < right


def test_held_out_quality(spark):
    from parlance.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality_gam"](spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)


def test_scores_of_odd_texts(docs_of, with_clashes, spark):
    docs = with_clashes(docs_of((1, None), (2, ""), (3, "a " * 50_000), (4, "é"), (4, "é"), (None, "x")))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (9, 1), (None, 1)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    out = quality_model.scored(docs, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    same = [r.score for r in out if r.doc_id in (1, 2)]
    assert same[0] == same[1]
    assert quality_model.scored(docs, quality_model.train(docs, labels.where("quality = 1"))).first().score > 0.5
