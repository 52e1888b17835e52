"""Cosine search over stored vectors, exact or by inverted lists.

Queries are a table, and stay one. Documents and queries meet in the cells of a
grid: documents are dealt into slices of bounded bytes, queries into blocks of
bounded rows, and a cell is one slice with one block. A cell is scored by matrix
products and keeps k hits a query; hits of all cells are merged by rank. What a cell
sends and holds grows with its rows, never with the pairs that it scores.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parlance import constants as C
from parlance.functions.text import doc_excerpt
from parlance.operators.conversations import check_range
from parlance.operators.keyed import lookup_join, with_digest
from parlance.operators.vectors import embed_documents, filter_documents

# A slice holds documents of about so many bytes and so many rows, a block so many queries.
SLICE_BYTES = 16 << 20
SLICE_ROWS = 65_536
QUERY_BLOCK = 16_384

# So many scores are worked on at once, and so many vectors in double precision.
SCORES = 1 << 21
VECTORS = 8_192

# Queries that are joined to their lists at once.
PROBE_BATCH = 1_024

# So many rows give one score to the estimate of the k-th best.
GROUP = 32

# Similarities are ranked at this precision, so that equal vectors tie and the
# id decides, whatever the order of the sums in a task.
RANK_DIGITS = 9

# Errors of scores of single precision; candidates are kept within it.
TOLERANCE = 1e-5

# What a search hit tells about a conversation, besides id, similarity and excerpt.
SEARCH_FIELDS = (
    "topic", "agent_name", "customer_sentiment_overall", "language", "escalation_flag",
)

CELL = ("_list", "_slice", "_block")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, a row each."""
    whole = column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype("float64")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


class _Vectors:
    """The vectors of a column in an order of its rows, read where Arrow holds them: none is copied."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray):
        self.chunks = [_matrix(pa.chunked_array([c])) for c in column.chunks if len(c)]
        self.ends = np.cumsum([len(c) for c in self.chunks])
        self.order, self.width = order, self.chunks[0].shape[1]

    def unit(self, rows: np.ndarray | slice) -> np.ndarray:
        """Unit vectors of double precision of some rows."""
        rows = self.order[rows]
        out, chunk = np.empty((len(rows), self.width)), np.searchsorted(self.ends, rows, "right")
        for c, matrix in enumerate(self.chunks):
            own = chunk == c
            out[own] = matrix[rows[own] - (self.ends[c] - len(matrix))]
        return _unit(out)

    def single(self) -> np.ndarray:
        """Unit vectors of single precision of all rows."""
        out = np.empty((len(self.order), self.width), "float32")
        for at in range(0, len(out), VECTORS):
            out[at : at + VECTORS] = self.unit(slice(at, at + VECTORS))
        return out


def _slot(id: str, n: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(n)).cast("int")


def _blocks(queries: DataFrame) -> int:
    return max(1, -(-queries.count() // QUERY_BLOCK))


def _slice_rows(vectors: DataFrame) -> int:
    one = vectors.select(F.size("embedding")).first()
    return max(1, min(SLICE_ROWS, SLICE_BYTES // (4 * max(1, one[0])))) if one else 1


def _met(docs: DataFrame, queries: DataFrame, score, schema: T.StructType) -> DataFrame:
    """Score each cell of the grid; both sides are keyed by CELL, and no cell is unbounded."""
    return docs.groupBy(*CELL).cogroup(queries.groupBy(*CELL)).applyInArrow(score, schema)


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of the k best of each row of scores, the earlier place on ties."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k, None]
        above, level = scores > least, scores == least
        level &= np.cumsum(level, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)
        return np.nonzero((above | level) & (scores > -np.inf))
    return np.nonzero(scores > -np.inf)


def _by_document(ids: pa.ChunkedArray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The ascending order of the rows by their ids, the ids in it, and where the rows of each document begin."""
    ids = ids.combine_chunks()
    order = pc.sort_indices(ids)
    names = ids.take(order)
    other = pc.fill_null(pc.not_equal(names[1:], names[:-1]), True).to_numpy(zero_copy_only=False)
    return order, names, np.flatnonzero(np.concatenate(([True], other)))


def _of_documents(scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A document of several rows counts with its best one."""
    return scores if len(starts) == len(scores) else np.maximum.reduceat(scores, starts, axis=0)


def _reached(scores: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """For each query (column) a score that at least k documents reach, near the k-th best.

    It is the k-th best of the best ones of groups of documents, so that few scores are put in order.
    """
    scores = _of_documents(scores, starts)
    if len(scores) <= k:
        return np.full(scores.shape[1], -np.inf, scores.dtype)
    size = max(1, min(GROUP, len(scores) // (8 * k)))
    groups = len(scores) // size
    best = scores[: groups * size].reshape(groups, size, -1).max(axis=1)
    return np.partition(best, -k, axis=0)[-k]


class _Cell:
    """The documents of a cell, and their k best for each query."""

    def __init__(self, docs: pa.Table, doc_id: str, k: int):
        self.order, names, self.starts = _by_document(docs[doc_id])
        self.ids, self.k = names.take(pa.array(self.starts)), k
        self.document = np.repeat(np.arange(len(self.starts)), np.diff(self.starts, append=docs.num_rows))
        self.vectors = _Vectors(docs["embedding"], self.order.to_numpy().astype(np.int64))
        self.single = self.vectors.single()
        self.tolerance = max(TOLERANCE, self.vectors.width * 1.2e-7)

    def best(self, asked: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, similarity) among the kept pairs (row, query).

        Single precision tells which pairs may be among the best, and these are scored in double
        precision. Where these are many, as with copies, all are.
        """
        scores = self.single @ asked.astype("float32").T
        if kept is not None:
            scores[~kept] = -2
        least = np.maximum(_reached(scores, self.starts, self.k) - 2 * self.tolerance, -1.5)
        row, query = np.divmod(np.flatnonzero(scores >= least), scores.shape[1])
        if len(row) * self.vectors.width > 2 * SCORES:
            return self._best_of_all(asked, kept)
        similarity = np.empty(len(row))
        for at in range(0, len(row), VECTORS):
            few = slice(at, at + VECTORS)
            similarity[few] = np.einsum("ij,ij->i", self.vectors.unit(row[few]), asked[query[few]])
        similarity, document = np.round(similarity, RANK_DIGITS), self.document[row]
        order = np.lexsort((-similarity, document, query))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(document[order]) != 0) | (np.diff(query[order]) != 0)
        order = order[new]
        order = order[np.lexsort((document[order], -similarity[order], query[order]))]
        first = np.searchsorted(query[order], np.arange(len(asked)))
        order = order[np.arange(len(order)) - first[query[order]] < self.k]
        return query[order], document[order], similarity[order]

    def _best_of_all(self, asked, kept):
        scores = np.empty((len(self.single), len(asked)))
        for at in range(0, len(scores), VECTORS):
            few = slice(at, at + VECTORS)
            scores[few] = self.vectors.unit(few) @ asked.T
        np.round(scores, RANK_DIGITS, out=scores)
        if kept is not None:
            scores[~kept] = -np.inf
        scores = _of_documents(scores, self.starts).T
        query, document = _top(scores, self.k)
        return query, document, scores[query, document]

    def hits(self, queries: pa.Table, query_id: str, schema: pa.Schema, kept=None) -> pa.Table:
        """The hits of all queries; kept(asked), if given, tells the pairs that are scored."""
        matrix, found = _matrix(queries["embedding"]), []
        step = max(1, SCORES // max(matrix.shape[1], len(self.single)))
        for at in range(0, len(matrix), step):
            asked = _unit(matrix[at : at + step])
            query, document, similarity = self.best(asked, kept and kept(asked))
            found.append((query + at, document, similarity))
        query, document, similarity = (np.concatenate(c) for c in zip(*found))
        return pa.Table.from_arrays(
            [
                queries[query_id].combine_chunks().take(pa.array(query)),
                self.ids.take(pa.array(document)), pa.array(similarity),
            ],
            schema=schema,
        )


def _best_in_cell(k: int, doc_id: str, query_id: str, schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def score(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            return arrow.empty_table()
        return _Cell(docs, doc_id, k).hits(queries, query_id, arrow)

    return score


def _ranked(hits: DataFrame, k: int, doc_id: str, query_id: str) -> DataFrame:
    """The k best documents per query of hits that may name a document several times."""
    best = hits.groupBy(query_id, doc_id).agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), doc_id)
    return (
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select(query_id, "rank", doc_id, "similarity")
    )


def semantic_topk(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 5,
    doc_id: str = "conv_id",
    query_id: str = "query_id",
    details: Sequence[str] = (),
    **filters,
) -> DataFrame:
    """The k most similar documents per query vector: query_id, rank, doc_id, similarity.

    Exact cosine search with one scan of the documents, however many queries there
    are. Only ids and vectors are shuffled; every query goes to every slice, and a
    slice to as many blocks as the queries fill. Filters are those of
    filter_documents and come before any scoring. A document of several rows counts
    with its best one. `details` names columns to add, of its first row.
    """
    check_range("k", k, 1, C.MAX_K)
    kept = filter_documents(docs, **filters)
    vectors = kept.select(doc_id, "embedding").where("embedding IS NOT NULL")
    slices = max(1, -(-vectors.count() // _slice_rows(vectors)))
    asked, blocks = _asked(queries, query_id)
    of_docs = vectors.withColumns({
        "_list": F.lit(0), "_slice": F.pmod(F.xxhash64(doc_id, "embedding"), F.lit(slices)).cast("int"),
        "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
    })
    of_queries = asked.withColumns({
        "_list": F.lit(0), "_block": _slot(query_id, blocks),
        "_slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1))),
    })
    schema = _hit_schema(kept, queries, doc_id, query_id)
    hits = _met(of_docs, of_queries, _best_in_cell(k, doc_id, query_id, schema), schema)
    return _with_details(kept, _ranked(hits, k, doc_id, query_id), doc_id, query_id, details)


def _asked(queries: DataFrame, query_id: str) -> tuple[DataFrame, int]:
    asked = queries.select(query_id, "embedding").where("embedding IS NOT NULL")
    return asked, _blocks(asked)


def _hit_schema(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str) -> T.StructType:
    return T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(doc_id, docs.schema[doc_id].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])


def _with_details(kept, hits, doc_id, query_id, details) -> DataFrame:
    if not details:
        return hits
    names = [d.split(".")[-1] for d in details]
    fields = [F.col(d).alias(n) for d, n in zip(details, names, strict=True)]
    if "part" in kept.columns:
        found = kept.join(hits.select(doc_id).distinct(), doc_id, "left_semi")
        least = found.groupBy(doc_id).agg(F.min("part").alias("part"))
        rows = found.join(least, [doc_id, "part"], "left_semi").select(doc_id, *fields)
    else:
        rows = kept.select(doc_id, *fields)
    return rows.join(hits, doc_id).select(query_id, "rank", doc_id, "similarity", *names)


def semantic_search(
    docs: DataFrame,
    queries: DataFrame,
    embedder: PipelineModel | Callable[[list[str]], np.ndarray],
    k: int = 5,
    query: str = "query",
    query_id: str = "query_id",
    **filters,
) -> DataFrame:
    """Search embedded conversations by text: ids, similarity, excerpt and metadata.

    `queries` has an id and a text each; texts are embedded with the embedder that
    embedded the conversations. A text is asked once, however many queries have it:
    texts are told apart by 128 bits, and a text's hits, one row, are joined to its queries.
    """
    named = with_digest(queries.select(query_id, F.col(query).alias("document")), "document")
    texts = named.groupBy("_d1", "_d2").agg(F.first("document").alias("document"))
    asked = embed_documents(
        texts.select(F.concat_ws(":", "_d1", "_d2").alias("_text"), "document"), embedder
    )
    details = ["document", *(f"metadata.{f}" for f in SEARCH_FIELDS)]
    hits = semantic_topk(docs, asked, k, query_id="_text", details=details, **filters)
    told = F.struct(
        "rank", "conv_id", "similarity",
        doc_excerpt(F.col("document")).alias("document_excerpt"), *SEARCH_FIELDS,
    )
    lists = hits.groupBy("_text").agg(F.collect_list(told).alias("_hits"))
    ids = named.select(query_id, F.concat_ws(":", "_d1", "_d2").alias("_text"))
    found = lookup_join(ids, lists, ["_text"], "inner")
    return found.select(query_id, F.explode("_hits").alias("_hit")).select(query_id, "_hit.*")


@dataclass(frozen=True)
class InvertedLists:
    """Coarse centroids, one list each, and the codebooks of the parts of what is left of a
    unit vector after its centroid is taken off."""

    centroids: np.ndarray  # (list, component)
    books: np.ndarray      # (part, entry, component)

    def assigned(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors, self.centroids)

    def coded(self, vectors: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A byte a part, and how far the coded vector is from the true one."""
        rest = vectors - self.centroids[lists]
        codes = np.empty((len(vectors), len(self.books)), np.uint8)
        parts = rest.reshape(len(vectors), len(self.books), -1)
        error = np.zeros(len(vectors))
        for p, book in enumerate(self.books):
            codes[:, p] = _nearest(parts[:, p], book)
            error += ((parts[:, p] - book[codes[:, p]]) ** 2).sum(1)
        return codes, np.sqrt(error)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - (centres * centres).sum(1) / 2).argmax(1)


def _means(points: np.ndarray, n: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's rounds from distinct points; a centre without points is a new draw."""
    points = points[draw.permutation(len(points))]
    distinct = np.unique(np.round(points, 6), axis=0, return_index=True)[1]
    centres = points[np.sort(distinct)[:n]].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = points[draw.integers(0, len(points), len(empty))]
    return centres


def train_lists(
    docs: DataFrame, lists: int = 64, parts: int = 8, entries: int = 256, doc_id: str = "conv_id",
    sample: int = 20_000, rounds: int = 12, seed: int = 7,
) -> InvertedLists:
    """Fit the centroids and codebooks on a seeded sample of at most `sample` vectors.

    Only the fit uses the sample. Use some square root of the number of documents
    as `lists`; a centroid wants some forty vectors of the sample.
    """
    check_range("lists", lists, 1, 65_536)
    check_range("entries", entries, 1, 256)
    known = docs.where("embedding IS NOT NULL").select("embedding", F.xxhash64(F.lit(seed), doc_id).alias("_h"))
    # A little more than enough by hash first, so that few rows are sorted.
    share = min(1.0, 1.2 * sample / max(1, known.count()))
    bound = int((1 << 63) * (2 * share - 1)) - (0 if share < 1 else 1)
    drawn = known.where(F.col("_h") <= bound).orderBy("_h", "embedding").limit(sample).collect()
    vectors = _unit(np.array([r["embedding"] for r in drawn], dtype="float64"))
    if not len(vectors) or vectors.shape[1] % parts:
        raise ValueError(f"no vectors, or not of a length that can be cut into {parts} parts")
    draw = np.random.default_rng(seed)
    centroids = _means(vectors, lists, rounds, draw)
    rest = vectors - centroids[_nearest(vectors, centroids)]
    pieces = rest.reshape(len(rest), parts, -1)
    books = [_means(pieces[:, p], entries, rounds, draw) for p in range(parts)]
    size = max(map(len, books))
    return InvertedLists(centroids, np.stack([np.resize(b, (size, b.shape[1])) for b in books]))


def with_lists(docs: DataFrame, model: InvertedLists) -> DataFrame:
    """Add `list`, `code` and `code_error` to every document that has a vector.

    Write the result partitioned by `list`, and a search reads the probed lists only.
    """
    schema = "list int, code binary, code_error float"

    @F.arrow_udf(schema)
    def index(column: pa.Array) -> pa.Array:
        vectors = _unit(_matrix(pa.chunked_array([column])))
        lists = model.assigned(vectors)
        codes, error = model.coded(vectors, lists)
        return pa.StructArray.from_arrays(
            [
                pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array(np.nextafter(error.astype("float32"), np.float32(np.inf)), pa.float32()),
            ],
            names=["list", "code", "code_error"],
        )

    known = docs.where("embedding IS NOT NULL").withColumn("_index", index("embedding"))
    return known.select(*docs.columns, "_index.list", "_index.code", "_index.code_error")


def probed_lists(
    docs: DataFrame, queries: DataFrame, model: InvertedLists, k: int = 5, probes: int = 16,
    doc_id: str = "conv_id", query_id: str = "query_id",
) -> DataFrame:
    """(query_id, embedding, list, rows, slices): the lists that each query goes to.

    The `probes` lists whose centroids are nearest and hold documents; further ones
    until they hold k documents, so that no query has to ask again. `rows` is how many
    documents of a list are scored. To the driver comes one row a list, its size.
    """
    per_slice = _slice_rows(docs)
    sizes = sorted(tuple(r) for r in docs.groupBy("list").agg(F.count("*")).collect())
    lists, rows = (np.array([s[c] for s in sizes], dtype=np.int64) for c in (0, 1))
    asked = queries.select(query_id, "embedding").where("embedding IS NOT NULL")

    def near(batches):
        for batch in batches:
            if not batch.num_rows or not len(lists):
                continue
            # A query goes to many lists, so few queries at a time.
            for few in (batch.slice(at, PROBE_BATCH) for at in range(0, batch.num_rows, PROBE_BATCH)):
                vectors = _unit(_matrix(pa.chunked_array([few["embedding"]])))
                centres = model.centroids[lists]
                order = np.argsort((centres * centres).sum(1) - 2 * vectors @ centres.T, axis=1, kind="stable")
                before = np.cumsum(rows[order], axis=1) - rows[order]
                query, at = np.nonzero((np.arange(len(lists)) < probes) | (before < k))
                chosen, row = order[query, at], pa.array(query)
                yield pa.RecordBatch.from_arrays(
                    [
                        few[query_id].take(row), few["embedding"].take(row), pa.array(lists[chosen], pa.int32()),
                        pa.array(rows[chosen]), pa.array(-(-rows[chosen] // per_slice), pa.int32()),
                    ],
                    [query_id, "embedding", "list", "rows", "slices"],
                )

    kind, vector = (queries.schema[c].dataType.simpleString() for c in (query_id, "embedding"))
    return asked.mapInArrow(near, f"{query_id} {kind}, embedding {vector}, list int, rows long, slices int")


def _coded_best_in_cell(k: int, slack: float, model: InvertedLists, doc_id: str, query_id: str, schema: T.StructType):
    """The k best of a cell among the documents whose coded similarity may be among its k best.

    The coded similarity is off by at most `code_error`; with a slack of 1 every
    document that can be among the k best is scored by its vector, with less those that are likely to be.
    """
    arrow = to_arrow_schema(schema)

    def score(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            return arrow.empty_table()
        cell = _Cell(docs, doc_id, k)
        codes = np.frombuffer(b"".join(docs["code"].take(cell.order).to_pylist()), np.uint8).reshape(docs.num_rows, -1)
        codes = np.ascontiguousarray(codes.T).astype(np.intp)
        margin = (slack * docs["code_error"].take(cell.order).to_numpy() + cell.tolerance).astype("float32")[:, None]
        centre = model.centroids[docs["_list"][0].as_py()]
        parts, _, width = model.books.shape

        def likely(asked: np.ndarray) -> np.ndarray:
            """A table of part products a query, looked up by the codes."""
            pieces = asked.reshape(len(asked), parts, width)
            coded = np.repeat((asked @ centre).astype("float32")[None], docs.num_rows, axis=0)
            for p in range(parts):
                coded += np.take((model.books[p] @ pieces[:, p].T).astype("float32"), codes[p], axis=0)
            coded += margin
            return coded >= _reached(coded - 2 * margin, cell.starts, k)

        return cell.hits(queries, query_id, arrow, likely)

    return score


def semantic_topk_approx(
    docs: DataFrame,
    queries: DataFrame,
    model: InvertedLists,
    k: int = 5,
    probes: int = 16,
    slack: float = 0.25,
    doc_id: str = "conv_id",
    query_id: str = "query_id",
    details: Sequence[str] = (),
    **filters,
) -> DataFrame:
    """semantic_topk over the lists nearest to each query only.

    `docs` comes from with_lists with the same model, best read from a table
    partitioned by `list`. Each query is joined to the lists it probes, a list of many
    documents in slices. Codes are scored by one table of part products per query, and
    documents that may be among the k best of their slice, within `slack` times the error of
    their code, are scored again by their vectors in the same place: these are some share of
    all pairs, so no pair but the k best of a slice leaves it.
    A slack of 1 loses none of the k best of the probed lists, so probing all lists
    with it is exact. A query gets k hits whenever k documents pass the filters.
    """
    check_range("k", k, 1, C.MAX_K)
    kept = filter_documents(docs, **filters)
    asked, blocks = _asked(queries, query_id)
    probed = probed_lists(kept, asked, model, k, probes, doc_id, query_id)
    per_slice = _slice_rows(kept)
    sizes = kept.groupBy("list").agg(F.ceil(F.count("*") / F.lit(per_slice)).cast("int").alias("_slices"))
    coded = kept.select(doc_id, "code", "code_error", "list", "embedding")
    # One row a list; a list of the model has its centroid in every task already.
    of_docs = coded.join(F.broadcast(sizes), "list").select(
        doc_id, "code", "code_error", "embedding", F.col("list").alias("_list"),
        F.pmod(F.xxhash64(doc_id, "embedding"), "_slices").cast("int").alias("_slice"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
    )
    of_queries = probed.select(
        query_id, "embedding", F.col("list").alias("_list"), _slot(query_id, blocks).alias("_block"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("_slice"),
    )
    schema = _hit_schema(kept, queries, doc_id, query_id)
    hits = _met(of_docs, of_queries, _coded_best_in_cell(k, slack, model, doc_id, query_id, schema), schema)
    return _with_details(kept, _ranked(hits, k, doc_id, query_id), doc_id, query_id, details)
