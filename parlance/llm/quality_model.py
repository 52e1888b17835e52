"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is binned; shallow trees, boosted in turns over the features, add up
to one lookup table per feature. Pairs that explain most of what is left get
tables of their own in the same way. A score is a sum of table entries, added up
for all texts of a batch at once.

Training takes a bounded sample of labelled documents to the driver; features and
scores are computed where the documents are. Defined results: a null text counts
as empty and is scored as such; without labels, or with one kind only, the score
is the smoothed share of label 1; an empty table gives an empty result; other
columns than id and text are never read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import by_slices, hashes_of, words_of
from parlance.llm.runs import run_hashes


@dataclass(frozen=True)
class Gam:
    """Training takes at most `max_labelled` labelled documents, by a hash of the id."""

    max_labelled: int = 20_000
    bins: int = 32
    rounds: int = 120
    leaves: int = 4
    rate: float = 0.1
    pairs: int = 6
    pair_bins: int = 8
    pair_rounds: int = 40
    ridge: float = 5.0
    seed: int = 17


def _chars(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


LETTERS_UP, LETTERS_LOW, DIGITS = (_chars(c) for c in (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
))
SHARES = {
    "symbols": _chars("#*$%&<>@^~=+_"), "bars": _chars("|"), "shouts": _chars("!"), "digits": DIGITS,
    "stops": _chars(".?"), "commas": _chars(",;:"), "slashes": _chars("/\\"), "capitals": LETTERS_UP,
    "foreign": np.arange(256) >= 128, "lines": _chars("\n"),
}
FEATURES = (
    "words", "word_length", "capital_share", *SHARES, "same_as_before", "distinct_words",
    "distinct_threes", "short_words", "long_words", "words_a_line",
)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; shares of an empty text are 0."""
    words = words_of(texts)
    hashes = hashes_of(words)
    n = np.diff(words.first).astype(float)
    n_bytes = np.diff(words.bounds).astype(float)

    def per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    counts = {name: per_text(table[words.data], words.bounds) for name, table in SHARES.items()}
    small = per_text(LETTERS_LOW[words.data], words.bounds)
    lengths = words.ends - words.starts
    of = np.repeat(np.arange(len(n)), n.astype(np.int64))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    threes = np.maximum(n - 2, 0).astype(np.int64)
    of_three = np.repeat(np.arange(len(n)), threes)
    starts = words.first[:-1][of_three] + np.arange(len(of_three)) - (np.cumsum(threes) - threes)[of_three]
    three = run_hashes(hashes, starts, 3, 0x8EBC6AF09C88C6E3) if len(starts) else np.empty(0, np.uint64)
    columns = [
        np.log1p(n), share(per_text(lengths, words.first), n), share(counts["capitals"], counts["capitals"] + small),
        *(share(c, n_bytes) for c in counts.values()),
        share(per_text(same, words.first), n), share(_distinct(of, hashes, len(n)), n),
        share(_distinct(of_three, three, len(n)), threes), share(per_text(lengths <= 3, words.first), n),
        share(per_text(lengths >= 12, words.first), n), share(n, counts["lines"] + 1),
    ]
    return np.stack(columns, axis=1)


def _distinct(of: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    order = np.lexsort((hashes, of))
    a, h = of[order], hashes[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
    return np.bincount(a[new], minlength=size).astype(float)


@dataclass
class Model:
    """Bin edges and lookup tables; a score is the logistic of their sum."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, table in self.pairs:
            total += table[_bins(self.pair_edges[i], x[:, i]), _bins(self.pair_edges[j], x[:, j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _bins(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values, per bin, of a tree that splits the bins where it gains most."""
    parts = [(0, len(grad))]
    g, h = (np.concatenate(([0.0], np.cumsum(v))) for v in (grad, hess))

    def best(part):
        a, b = part
        if b - a < 2:
            return 0.0, None
        cut = np.arange(a + 1, b)
        fit = lambda lo, hi: (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + ridge)
        gains = fit(a, cut) + fit(cut, b) - fit(a, b)
        k = int(gains.argmax())
        return float(gains[k]), int(cut[k])

    while len(parts) < leaves:
        options = [(*best(p), p) for p in parts]
        gain, cut, part = max(options, key=lambda o: o[0])
        if cut is None or gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    values = np.zeros(len(grad))
    for a, b in parts:
        values[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return values


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cut on one axis followed by one on the other each side."""
    best = (-1.0, np.zeros_like(grad))
    for flip in (False, True):
        g, h = (grad.T, hess.T) if flip else (grad, hess)
        for cut in range(1, g.shape[0]):
            values, gain = np.zeros_like(g), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                gr, hr = g[rows].sum(axis=0), h[rows].sum(axis=0)
                leaf = _tree(gr, hr, 2, ridge)
                gain += float((leaf * gr).sum())
                values[rows] = leaf
            if gain > best[0]:
                best = (gain, values.T if flip else values)
    return best


def fit(x: np.ndarray, y: np.ndarray, how: Gam = Gam()) -> Model:
    """Boost lookup tables over the features in turns, then tables of chosen pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, j], how.bins) if len(x) else np.empty(0) for j in range(x.shape[1])]
    pair_edges = [_edges(x[:, j], how.pair_bins) if len(x) else np.empty(0) for j in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(np.unique(y)) < 2:
        return Model(base, edges, tables, pair_edges, [])
    binned = [_bins(e, x[:, j]) for j, e in enumerate(edges)]
    total = np.full(len(y), base)
    for _ in range(how.rounds):
        for j, b in enumerate(binned):
            p = 1 / (1 + np.exp(-total))
            size = len(tables[j])
            grad, hess = np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size)
            step = how.rate * _tree(grad, hess, how.leaves, how.ridge)
            tables[j] += step
            total += step[b]
    coarse = [_bins(e, x[:, j]) for j, e in enumerate(pair_edges)]

    def cells(i: int, j: int):
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        at = coarse[i] * shape[1] + coarse[j]
        p = 1 / (1 + np.exp(-total))
        size = shape[0] * shape[1]
        return at, np.bincount(at, y - p, size).reshape(shape), np.bincount(at, p * (1 - p), size).reshape(shape)

    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            _, grad, hess = cells(i, j)
            gains.append((_pair_tree(grad, hess, how.ridge)[0], i, j))
    pairs = [(i, j, np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)))
             for _, i, j in sorted(gains, key=lambda g: (-g[0], g[1:]))[: how.pairs]]
    for _ in range(how.pair_rounds):
        for i, j, table in pairs:
            at, grad, hess = cells(i, j)
            step = how.rate * _pair_tree(grad, hess, how.ridge)[1]
            table += step
            total += step.ravel()[at]
    return Model(base, edges, tables, pair_edges, pairs)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id",
          label: str = "quality", how: Gam = Gam()) -> Model:
    """Fit to labelled documents; `labels` has (id, label 0 or 1).

    Their number is bounded, so the ids are broadcast and the features collected.
    """
    sample = (
        labels.select(F.col(id).alias("id"), F.col(label).cast("double").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .orderBy(F.xxhash64(F.lit(how.seed), "id"), "id", "label").limit(how.max_labelled)
    )
    known = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = features(batch["text"])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1])
        return pa.RecordBatch.from_arrays(
            [batch["id"].cast(pa.int64()), batch["label"], lists.cast(pa.list_(pa.float64()))], ["id", "label", "x"]
        )

    found = by_slices(known, "text", "id long, label double, x array<double>", work).collect()
    found.sort(key=lambda r: (r["id"], r["label"], r["x"]))
    x = np.array([r["x"] for r in found], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in found], float), how)


def scored(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document: id and score."""
    kind = docs.schema[id].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(model.scores(features(batch["text"])))], ["id", "score"]
        )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return by_slices(rows, "text", f"id {kind}, score double", work).withColumnRenamed("id", id)
