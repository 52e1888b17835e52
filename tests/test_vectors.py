import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tests.helpers import plan_of

from parlance.operators import documents, search, vectors
from parlance.sources.storage import write_vectors


def table(spark, matrix, ids=None, name="conv_id"):
    ids = ids or [f"d{i:04d}" for i in range(len(matrix))]
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"{name} string, embedding array<float>")


def brute(ids, matrix, query, k):
    matrix, query = np.float32(matrix).astype(float), np.float32(query).astype(float)
    best = {}
    for name, v in zip(ids, matrix):
        norm = np.linalg.norm(v) * np.linalg.norm(query)
        score = round(float(v @ query / norm), 9) if norm else 0.0
        best[name] = max(score, best.get(name, -2))
    return sorted(best.items(), key=lambda h: (-h[1], h[0]))[:k]


def hits(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["conv_id"], pytest.approx(r["similarity"], abs=1e-8)))
    return found


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(5)
    matrix = draw.normal(size=(600, 16))
    matrix[200:400] = matrix[200]  # a third of the documents are copies
    matrix[10] = 0
    return matrix, draw.normal(size=(4, 16))


def test_topk_is_exact(spark, data):
    matrix, asked = data
    asked = np.vstack([asked, matrix[200]])
    names = [f"q{i}" for i in range(len(asked))]
    docs = table(spark, matrix).repartition(5)
    found = hits(search.semantic_topk(docs, table(spark, asked, names, "query_id"), k=20))
    ids = [f"d{i:04d}" for i in range(len(matrix))]
    for name, query in zip(names, asked):
        assert [(i, s) for i, s in found[name]] == brute(ids, matrix, query, 20)


def test_parts_count_once(spark, data):
    matrix, asked = data
    ids = [f"d{i // 7:04d}" for i in range(len(matrix))]
    found = hits(search.semantic_topk(
        table(spark, matrix, ids).repartition(3), table(spark, asked[:1], ["q"], "query_id"), k=10))
    assert found["q"] == brute(ids, matrix, asked[0], 10)


def exchanges(plan):
    return plan.split("\n\n(1)")[0].count("Exchange")


def test_no_pairs_are_joined(spark, data, tmp_path):
    """One scan of the documents for any number of queries; queries are never collected."""
    matrix, asked = data
    docs = write_vectors(table(spark, matrix), str(tmp_path / "docs"))
    queries = write_vectors(table(spark, np.repeat(asked, 500, axis=0), [f"q{i}" for i in range(2000)], "query_id"),
                            str(tmp_path / "queries"))
    few, many = (plan_of(search.semantic_topk(docs, q)) for q in (queries.limit(1), queries))
    for plan in (few, many):
        assert "FlatMapCoGroupsInArrow" in plan and "WindowGroupLimit" in plan
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "LocalTableScan" not in plan
    assert many.count("Scan parquet") == 2 * 2  # a line in the tree, and one that describes it
    assert exchanges(few) == exchanges(many) + 1  # the limit


def test_limits(spark, data, monkeypatch):
    matrix, asked = data
    docs, queries = table(spark, matrix), table(spark, asked, list("abcd"), "query_id")
    for k in (0, 21):
        with pytest.raises(ValueError):
            search.semantic_topk(docs, queries, k=k)
    whole = hits(search.semantic_topk(docs, queries, k=7))
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "SLICE_BYTES", 16 * 4 * 100)
    monkeypatch.setattr(search, "SCORES", 150)
    assert hits(search.semantic_topk(docs, queries, k=7)) == whole
    assert search.semantic_topk(docs, queries.limit(0)).count() == 0
    assert search.semantic_topk(docs.limit(0), queries.limit(1)).count() == 0


def listed(spark, matrix, lists=12, ids=None, **how):
    docs = table(spark, matrix, ids)
    model = search.train_lists(docs, lists=lists, parts=4, entries=16, **how)
    return search.with_lists(docs, model), model


@pytest.mark.parametrize("slice_rows,block", [(10_000, 10_000), (40, 3)])
def test_all_lists_without_slack_lost_are_exact(spark, data, monkeypatch, slice_rows, block):
    matrix, asked = data
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "SLICE_BYTES", 16 * 4 * slice_rows)
    queries = table(spark, np.vstack([asked, matrix[200]]), list("abcde"), "query_id")
    for ids in (None, [f"d{i // 3:04d}" for i in range(len(matrix))]):
        docs, model = listed(spark, matrix, ids=ids)
        exact = hits(search.semantic_topk(docs, queries, k=10))
        assert hits(search.semantic_topk_approx(docs, queries, model, k=10, probes=12, slack=1.0)) == exact


def test_only_the_best_of_a_cell_leave_it(spark, data, monkeypatch):
    """However many documents may be among the best, a list sends k hits a query."""
    matrix, asked = data
    docs, model = listed(spark, matrix)
    sent, ranked = [], search._ranked
    monkeypatch.setattr(search, "_ranked", lambda hits, *rest: sent.append(hits) or ranked(hits, *rest))
    queries = table(spark, asked, list("abcd"), "query_id")
    assert search.semantic_topk_approx(docs, queries, model, k=1, probes=12, slack=1.0).count() == 4
    assert sent[0].count() <= 4 * 12


def test_recall_of_clustered_vectors(spark):
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(20, 16))
    matrix = centres[draw.integers(0, 20, 3000)] + 0.4 * draw.normal(size=(3000, 16))
    queries = table(spark, matrix[::50], [f"q{i}" for i in range(60)], "query_id")
    docs, model = listed(spark, matrix, lists=20)
    exact = hits(search.semantic_topk(docs, queries, k=10))
    near = hits(search.semantic_topk_approx(docs, queries, model, k=10, probes=4))
    recall = np.mean([len({i for i, _ in near[q]} & {i for i, _ in exact[q]}) / 10 for q in exact])
    assert recall >= 0.95
    scored = search.probed_lists(docs, queries, model, k=10, probes=4).groupBy("query_id").sum("rows").collect()
    assert len(scored) == 60 and np.mean([r[1] for r in scored]) < 0.4 * len(matrix)


def test_codes_tell_how_far_they_are_off(spark, data):
    matrix, _ = data
    docs, model = listed(spark, matrix)
    for r in docs.collect():
        unit = search._unit(np.array([r["embedding"]], dtype=float))[0]
        parts = [model.books[p][c] for p, c in enumerate(r["code"])]
        away = np.linalg.norm(unit - model.centroids[r["list"]] - np.concatenate(parts))
        assert away <= r["code_error"] + 1e-6
        assert r["list"] == np.linalg.norm(model.centroids - unit, axis=1).argmin()


def test_many_queries(spark, data):
    matrix, _ = data
    asked = np.random.default_rng(8).normal(size=(20_000, 16))
    queries = table(spark, asked, [f"q{i}" for i in range(20_000)], "query_id")
    rows = search.semantic_topk(table(spark, matrix), queries, k=2).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["conv_id"], pytest.approx(r["similarity"], abs=1e-8)))
    assert len(found) == 20_000 and all(len(v) == 2 for v in found.values())
    ids = [f"d{i:04d}" for i in range(len(matrix))]
    for i in range(0, 20_000, 400):
        assert found[f"q{i}"] == brute(ids, matrix, asked[i], 2)


def test_approx_finds_k_whenever_k_match(spark, data):
    matrix, asked = data
    queries = table(spark, asked, list("abcd"), "query_id")
    docs, model = listed(spark, matrix)
    docs = docs.selectExpr("*", "CASE WHEN conv_id < 'd0010' THEN 1 ELSE 0 END AS escalation_flag")
    found = hits(search.semantic_topk_approx(docs, queries, model, k=10, probes=1, escalation=True))
    assert all(len(v) == 10 for v in found.values()) and len(found) == 4
    few = hits(search.semantic_topk_approx(docs, queries, model, k=20, probes=1, escalation=True))
    assert few == hits(search.semantic_topk(docs, queries, k=20, escalation=True))
    none = search.semantic_topk_approx(docs, queries, model, k=5, topic="x") if "topic" in docs.columns else None
    assert none is None and search.semantic_topk_approx(docs.limit(0), queries, model).count() == 0
    assert search.semantic_topk_approx(docs, queries.limit(0), model).count() == 0


def test_lists_are_read_by_partition_and_nothing_is_cross_joined(spark, data, tmp_path):
    matrix, asked = data
    docs, model = listed(spark, matrix)
    stored = write_vectors(docs, str(tmp_path / "v"))
    plan = plan_of(search.semantic_topk_approx(stored, table(spark, asked, list("abcd"), "query_id"), model))
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert "partitionfilters" in plan_of(stored.where("list = 3")).lower()


def test_training_takes_a_bounded_sample(spark, data):
    matrix, _ = data
    docs = table(spark, matrix)
    a, b = (search.train_lists(docs, lists=5, parts=2, entries=8, sample=100, seed=s) for s in (1, 1))
    assert (a.centroids == b.centroids).all() and a.centroids.shape == (5, 16) and a.books.shape == (2, 8, 8)
    few = search.train_lists(table(spark, matrix[:3]), lists=8, parts=2, entries=8)
    assert len(few.centroids) == 3
    with pytest.raises(ValueError):
        search.train_lists(docs.limit(0))


def test_one_vector_per_conversation_at_every_length(spark, turns_of):
    words = ["app crash again", "refund my order", "please help", "app works now"]
    rows = [{"conv_id": c, "turn_index": t * step, "text_clean": words[(t + n) % 4], "language": "en"}
            for n, (c, step) in enumerate([("near", 1), ("far", 5000), ("farther", 70000)]) for t in range(4)]
    rows.append({"conv_id": "other", "turn_index": 0, "text_clean": "nothing", "language": "en"})
    docs = documents.vector_documents(turns_of(*rows))
    assert docs.count() > 4
    whole = documents.vector_documents(turns_of(*[{**r, "turn_index": i} for i, r in enumerate(rows)]))
    assert whole.count() == 4
    model = vectors.fit_embedder(docs)
    assert np.allclose(model.stages[2].idf.toArray(), vectors.fit_embedder(whole).stages[2].idf.toArray())
    got = {r["conv_id"]: r for r in vectors.embed_documents(docs, model).collect()}
    want = {r["conv_id"]: r for r in vectors.embed_documents(whole, model).collect()}
    assert sorted(got) == sorted(want) == ["far", "farther", "near", "other"]
    for name in got:
        assert got[name]["embedding"] == pytest.approx(want[name]["embedding"], abs=1e-6)
    counts = np.zeros(256)
    for word in " ".join(f"[customer] {words[(t + 1) % 4]}" for t in range(4)).split():
        counts[model.stages[1].indexOf(word)] += 1
    weighted = counts * model.stages[2].idf.toArray()
    assert got["far"]["embedding"] == pytest.approx(weighted / np.linalg.norm(weighted), abs=1e-6)


def test_parts_are_averaged_by_length(spark):
    docs = spark.createDataFrame(
        [("a", 5, "xxxx"), ("a", 2, "yy"), ("b", 0, "x")], "conv_id string, part long, document string")
    embed = lambda texts: np.array([[1.0, 0.0] if "x" in t else [0.0, 1.0] for t in texts])
    got = {r["conv_id"]: r for r in vectors.embed_documents(docs, embed).collect()}
    assert got["a"]["embedding"] == pytest.approx([2 / 5**0.5, 1 / 5**0.5], abs=1e-6)
    assert got["a"]["document"] == "yy" and got["b"]["embedding"] == [1.0, 0.0]


def test_details_without_a_first_part(spark):
    docs = spark.createDataFrame(
        [("a", 3, [1.0, 0.0], "late"), ("a", 4, [0.9, 0.1], "later"), ("b", 0, [0.0, 1.0], "first")],
        "conv_id string, part long, embedding array<float>, document string")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    rows = search.semantic_topk(docs, asked, k=2, details=["document"]).orderBy("rank").collect()
    assert [(r["conv_id"], r["document"]) for r in rows] == [("a", "late"), ("b", "first")]


def test_search_of_documents(spark, turns_of):
    turns = turns_of(
        {"conv_id": "c1", "turn_index": 0, "text_clean": "my app crash again", "language": "hi",
         "is_escalation": 1, "sentiment_score": -0.5},
        {"conv_id": "c2", "turn_index": 0, "text_clean": "refund my order please", "language": "en"},
        {"conv_id": "c3", "turn_index": 0, "text_clean": "app crash", "language": "en",
         "sentiment_score": 0.5},
    )
    docs = documents.vector_documents(turns)
    model = vectors.fit_embedder(docs)
    stored = vectors.embed_documents(docs, model)
    norms = [np.linalg.norm(r["embedding"]) for r in stored.collect()]
    assert norms == [pytest.approx(1.0, abs=1e-5)] * 3
    asked = vectors.embed_documents(
        spark.createDataFrame([("q", "app crash")], "query_id string, document string"), model)
    found = search.semantic_topk(stored, asked, k=2, details=["document", "metadata.language"])
    rows = sorted(found.collect(), key=lambda r: r["rank"])
    assert [r["conv_id"] for r in rows] == ["c3", "c1"] and rows[0]["language"] == "en"
    said = search.semantic_search(
        stored, spark.createDataFrame([("q", "app crash")], "query_id string, query string"), model, k=1)
    assert said.columns == [
        "query_id", "rank", "conv_id", "similarity", "document_excerpt", "topic", "agent_name",
        "customer_sentiment_overall", "language", "escalation_flag"]
    assert said.first()["document_excerpt"] == "[customer] app crash"
    for options, first in (
        ({"language": "en"}, "c3"), ({"escalation": True}, "c1"), ({"sentiment_max": -0.1}, "c1"),
        ({"sentiment_min": -0.1, "sentiment_max": 0.1}, "c2"),
    ):
        hit = search.semantic_topk(stored, asked, k=1, **options).first()
        assert hit["conv_id"] == first


def test_a_text_is_asked_once(spark, monkeypatch):
    """Queries that repeat a text get its hits; only different texts are searched for."""
    docs = spark.createDataFrame(
        [("a", "one", [1.0, 0.0]), ("b", "two", [0.0, 1.0])],
        "conv_id string, document string, embedding array<float>",
    ).selectExpr("*", "named_struct('topic', 't', 'agent_name', 'g', 'customer_sentiment_overall', 0D,"
                 " 'language', 'en', 'escalation_flag', 0) AS metadata")
    searched, exact = [], search.semantic_topk
    monkeypatch.setattr(
        search, "semantic_topk", lambda docs, asked, *a, **b: searched.append(asked) or exact(docs, asked, *a, **b))
    embed = lambda texts: np.array([[float("x" in t), float("y" in t)] for t in texts])
    queries = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(400)], "query_id long, query string")
    rows = search.semantic_search(docs, queries, embed, k=2).collect()
    assert searched[0].count() == 2
    assert sorted((r["query_id"], r["rank"], r["conv_id"]) for r in rows) == [
        (i, rank, "abba"[i % 2 * 2 + rank - 1]) for i in range(400) for rank in (1, 2)]


def test_a_cell_takes_bounded_memory(spark):
    """Neither the scores of a cell nor its queries are held whole in several copies."""
    draw = np.random.default_rng(2)

    def rows(n, name):
        vectors = draw.normal(size=(n, 16)).astype("float32")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * n + 1, 16), pa.int32()), pa.array(vectors.ravel()))
        return pa.table({name: pa.array(np.arange(n)), "embedding": lists})

    docs, queries = rows(60_000, "conv_id"), rows(2_000, "query_id")
    schema = T.StructType.fromDDL("query_id long, conv_id long, similarity double")
    tracemalloc.start()
    found = search._best_in_cell(10, "conv_id", "query_id", schema)(docs, queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 20_000 and peak < 80e6


def test_a_cell_reads_vectors_where_they_are():
    """Arrow's chunks are not joined or sorted into copies, and what is found does not depend on them."""
    draw, n, dim = np.random.default_rng(3), 60_000, 64
    vectors, ids = draw.normal(size=(n, dim)).astype("float32"), draw.permutation(n)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, dim * n + 1, dim), pa.int32()), pa.array(vectors.ravel()))
    whole = pa.table({"conv_id": pa.array(ids), "embedding": lists})
    docs = pa.Table.from_batches(whole.to_batches(max_chunksize=7_000))
    held = pa.total_allocated_bytes()
    cell = search._Cell(docs, "conv_id", 5)
    assert pa.total_allocated_bytes() - held < 4e6
    asked = search._unit(draw.normal(size=(3, dim)))
    query, document, similarity = cell.best(asked)
    scores = asked @ search._unit(vectors).T
    for q in range(3):
        best = np.argsort(-scores[q])[:5]
        assert cell.ids.to_numpy()[document[query == q]].tolist() == ids[best].tolist()
        assert np.allclose(similarity[query == q], scores[q][best], atol=1e-9)


def test_supplied_embedder(spark):
    def embed(texts):
        assert len(texts) <= vectors.EMBED_BATCH
        return np.array([[len(t), 1.0] for t in texts])

    docs = spark.createDataFrame([(str(i), "x" * i) for i in range(200)], "conv_id string, document string")
    rows = vectors.embed_documents(docs, embed).collect()
    for r in rows:
        n = len(r["document"])
        assert r["embedding"] == pytest.approx(list(np.array([n, 1.0]) / np.hypot(n, 1)), abs=1e-6)


def test_long_texts_are_embedded_few_at_a_time(spark):
    """Texts of any length meet the function in bounded bytes, each once and in order."""
    asked = []

    def embed(texts):
        asked.append(texts)
        return np.array([[len(t or ""), 1] for t in texts])

    texts = [c * n for c, n in zip("abcdefgh" * 25, [3 << 20, 0, 5, 700_000, 900_000, 1 << 20, 40, 2] * 25)]
    texts[1] = None
    found = vectors._unit_vectors(embed, vectors.EMBED_BATCH).func(pa.array(texts))
    assert [t for few in asked for t in few] == texts
    assert max(sum(len(t or "") for t in few) for few in asked if len(few) > 1) <= 2 << 20
    want = np.array([[len(t or ""), 1] for t in texts])
    assert np.allclose(found.to_pylist(), want / np.linalg.norm(want, axis=1, keepdims=True))
    asked.clear()
    assert len(vectors._unit_vectors(embed, 64).func(pa.array(["x"] * 130))) == 130
    assert [len(few) for few in asked] == [64, 64, 2]


@pytest.mark.parametrize("part", [[], [0]])
def test_supplied_vectors_are_rounded_once(spark, part):
    """Counts over their norm, rounded to single precision from double."""
    counts = np.random.default_rng(3).integers(0, 120, (500, 26))
    docs = spark.createDataFrame(
        [(str(i), *part, " ".join(map(str, c.tolist()))) for i, c in enumerate(counts)],
        "conv_id string, " + "part long, " * len(part) + "document string")
    embed = lambda texts: np.array([list(map(int, t.split())) for t in texts])
    got = {int(r["conv_id"]): r["embedding"] for r in vectors.embed_documents(docs, embed).collect()}
    want = np.float32(counts / np.sqrt((counts * counts).sum(1, keepdims=True)))
    assert (np.float32([got[i] for i in range(500)]) == want).all()


def test_slices_of_short_vectors_are_bounded_in_rows(spark):
    """Rows cost memory too: short vectors don't make a slice of hundreds of thousands of them."""
    assert search._slice_rows(table(spark, np.ones((3, 2)))) <= 65_536
    docs = spark.range(150_000).selectExpr("id AS conv_id", "array(float(id % 7), 1F) AS embedding")
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<float>")
    found = search.semantic_topk(docs, asked, k=5).orderBy("rank").collect()
    assert [r["conv_id"] for r in found] == [0, 7, 14, 21, 28]
