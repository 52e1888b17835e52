"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingles gives two values, the smallest and the
largest hash, so a signature of 2 * permutations values costs half the hash
evaluations. Bands of the signature are bucket keys. Candidates from the buckets
are confirmed on the full shingle sets, and the confirmed links make classes.

Documents with the same set are one node, so copies never meet in pairs. Within
a bucket, members are compared with the bucket's smallest document first, and
where classes are still apart, with its most central one. A pair across such
classes is compared only if counts do not rule it out: a document most of whose
edits nobody else has cannot be linked to anyone. A large group of near copies
thus costs about as many comparisons as it has members, and no link is lost.

Defined results: a text without words, or a null one, has an empty set and is
linked with nothing; a text of fewer words than a shingle is one shingle; a row
with a null id is linked with nothing; rows that repeat an id are one document;
an empty table gives an empty result.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import by_slices, hashes_of, mixed, stored, words_of
from parlance.llm.components import components


@dataclass(frozen=True)
class MinMax:
    """Two sets are linked when 100 * intersection >= percent * union.

    With 64 permutations in groups of 4 there are 32 bands of 4 values; a pair at
    similarity 0.8 is missed with probability (1 - 0.8 ** 4) ** 32, below 1e-7.
    """

    words: int = 5
    percent: int = 80
    permutations: int = 64
    band_values: int = 4
    seed: int = 7


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the texts' offsets in them."""
    words = words_of(texts)
    hashes = hashes_of(words, lower=True)
    counts = np.diff(words.first)
    n_windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), n_windows)
    first = np.concatenate(([0], np.cumsum(n_windows)))
    start = words.first[:-1][text] + np.arange(first[-1]) - first[:-1][text]
    long = counts[text] >= size
    length = np.where(long, size, counts[text])
    value = length.astype(np.uint64)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    for step in range(size):
        word = padded[start + step]
        value = np.where(step < length, mixed(value + word) * np.uint64(0x9E3779B97F4A7C15), value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))


def band_keys(values: np.ndarray, first: np.ndarray, how: MinMax) -> np.ndarray:
    """One 64-bit key per band for each set that is not empty, as a matrix.

    A band holds the smallest values of a group of permutations, the next one
    the largest values of the same group.
    """
    starts = first[:-1]
    rng = np.random.default_rng(how.seed)
    keys = []
    for group in range(how.permutations // how.band_values):
        low = np.full(len(starts), 2 * group, np.uint64)
        high = low + np.uint64(1)
        for _ in range(how.band_values):
            times, plus = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
            ranked = values * (times * np.uint64(2) + np.uint64(1)) + plus
            ranked >>= np.uint64(24)
            low = mixed(low) + np.minimum.reduceat(ranked, starts)
            high = mixed(high) + np.maximum.reduceat(ranked, starts)
        keys += [mixed(low), mixed(high)]
    return np.stack(keys, axis=1) if len(starts) else np.empty((0, len(keys)), np.uint64)


def signatures(docs: DataFrame, text: str, id: str, how: MinMax) -> DataFrame:
    """Per row: id, n_shingles, a 128-bit digest of the set (s1, s2) and its band keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, first = shingles(batch["text"], how.words)
        sizes = np.diff(first)
        full = np.flatnonzero(sizes)
        bounds = np.append(first[:-1][full], len(values))
        keys = band_keys(values, bounds, how)
        digests = []
        for salt in (0x51ED270B, 0x2545F491):
            sums = np.zeros(len(sizes), np.uint64)
            if len(full):
                sums[full] = np.add.reduceat(mixed(values + np.uint64(salt)), bounds[:-1])
            digests.append(pa.array(sums.view(np.int64)))
        ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, keys.shape[1], 0))))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(sizes, pa.int64()), *digests, lists],
            ["id", "n_shingles", "s1", "s2", "bands"],
        )

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return by_slices(
        rows, "text", "id long, n_shingles long, s1 long, s2 long, bands array<long>", work
    )


def overlaps(pairs: DataFrame, texts: DataFrame, how: MinMax) -> DataFrame:
    """(a, b, shared, na, nb): the sizes of the pairs' full shingle sets and what they share."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        # A document that meets many others has its set made once a slice.
        coded = pa.concat_arrays([batch["text_a"], batch["text_b"]]).dictionary_encode()
        values, first = shingles(coded.dictionary, how.words)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        half = len(codes) // 2
        shared = np.zeros(half, np.int64)
        for at, (i, j) in enumerate(zip(codes[:half], codes[half:], strict=True)):
            x, y = values[first[i] : first[i + 1]], values[first[j] : first[j + 1]]
            if len(x) and len(y):
                found = np.searchsorted(x, y)
                shared[at] = (x[np.minimum(found, len(x) - 1)] == y).sum()
        sizes = np.diff(first)
        return pa.RecordBatch.from_arrays(
            [batch["a"], batch["b"], *(pa.array(v, pa.int64()) for v in (shared, sizes[codes[:half]], sizes[codes[half:]]))],
            ["a", "b", "shared", "na", "nb"],
        )

    joined = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return by_slices(joined, "text_b", "a long, b long, shared long, na long, nb long", work)


def _linked(how: MinMax, shared: str | Column = "shared", na: str = "na", nb: str = "nb") -> Column:
    """100 * intersection >= percent * union; or whether that is still possible, with a bound."""
    both = F.col(shared) if isinstance(shared, str) else shared
    return (100 + how.percent) * both >= how.percent * (F.col(na) + F.col(nb))


def _links(pairs: DataFrame, texts: DataFrame, how: MinMax) -> DataFrame:
    return stored(overlaps(pairs, texts, how).where(_linked(how)).select("a", "b").distinct())


def _similar_sizes(a: str, b: str, how: MinMax) -> Column:
    return (100 * F.least(a, b)) >= how.percent * F.greatest(a, b)


def _labelled(nodes: DataFrame, classes: DataFrame | None, node: str, into: str) -> DataFrame:
    """Add the class that a node is in so far."""
    if classes is None:
        return nodes.withColumn(into, F.col(node))
    found = classes.select(F.col("node").alias(node), F.col("component").alias("_c"))
    return nodes.join(found, node, "left").withColumn(into, F.coalesce("_c", node)).drop("_c")


def _joined_classes(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes after more links between them."""
    if classes is None:
        return components(links, "a", "b")
    between = _labelled(_labelled(links, classes, "a", "ca"), classes, "b", "cb")
    merged = components(between, "ca", "cb").select(
        F.col("node").alias("component"), F.col("component").alias("_to")
    )
    moved = classes.join(merged, "component", "left").select(
        "node", F.coalesce("_to", "component").alias("component")
    )
    return stored(moved.unionByName(
        merged.select(F.col("component").alias("node"), F.col("_to").alias("component"))
    ).distinct())


def near_duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", how: MinMax = MinMax()
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id of its class), kept.

    Bucket members, pairs and links are stored between the rounds. What is
    aggregated per bucket is stored before it is joined back to the members: it is
    broadcast if it is small, and else the members of a hot bucket can be split.
    """
    signed = stored(signatures(docs, text, id, how))
    usable = signed.where("n_shingles > 0 AND id IS NOT NULL")
    smallest = stored(
        usable.groupBy("s1", "s2")
        .agg(F.min(F.struct("id", "n_shingles", "bands")).alias("row"))
        .select("s1", "s2", F.col("row.id").alias("node"), F.col("row.n_shingles").alias("n"), "row.bands")
    )
    sets = smallest.select("s1", "s2", "node")
    members = smallest.select("node", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("_most"))
    leaders = stored(shared.where("leader < _most").drop("_most"))
    buckets = stored(members.join(leaders, "key"))
    sizes = buckets.where("leader = node").select("leader", F.col("n").alias("leader_n")).distinct()
    led = stored(
        buckets.where("leader <> node").select("leader", "node", "n").distinct()
        .join(sizes, "leader").where(_similar_sizes("n", "leader_n", how))
        .select(F.col("leader").alias("a"), F.col("node").alias("b"))
    )
    texts = stored(
        docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
        .join(buckets.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
        .where(F.col("text").isNotNull())
    )

    # First the smallest leader of each document, then its other leaders.
    first = stored(led.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    ids = _ids_with_several_sets(usable, sets)
    classes = components(_links(first, texts, how).unionByName(ids), "a", "b")
    rest = led.join(first, ["a", "b"], "left_anti")
    apart = _labelled(_labelled(rest, classes, "a", "ca"), classes, "b", "cb").where("ca <> cb")
    second = stored(apart.select("a", "b"))
    classes = _joined_classes(classes, _links(second, texts, how))

    # Then what could still be linked across the classes that meet in a bucket.
    left = stored(_open(_labelled(buckets, classes, "node", "c")).select("key", "node", "n", "c"))
    placed = _placed_by_centre(left, texts, how)
    classes = _joined_classes(classes, stored(
        placed.where(_linked(how, "shared", "n", "centre_n"))
        .select(F.col("node").alias("a"), F.col("centre").alias("b")).where("a <> b").distinct()
    ))
    across = stored(_across(_labelled(placed.drop("c"), classes, "node", "c"), how))
    classes = _joined_classes(classes, _links(across, texts, how))

    found = signed.select("id", "n_shingles", "s1", "s2").join(sets, ["s1", "s2"], "left")
    return _labelled(found, classes, "node", "c").select(
        F.col("id").alias(id),
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("id"))
        .otherwise(F.when(F.col("id").isNotNull(), F.col("c"))).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def _open(members: DataFrame) -> DataFrame:
    """Bucket members (key, c, ...) of the buckets in which several classes meet."""
    split = members.groupBy("key").agg(F.min("c").alias("_least"), F.max("c").alias("_most"))
    return members.join(stored(split.where("_least < _most").select("key")), "key", "left_semi")


def _placed_by_centre(members: DataFrame, texts: DataFrame, how: MinMax) -> DataFrame:
    """Bucket members with what they share with their bucket's most central document.

    `common` counts a document's shingles that any other of these documents has. Below
    `percent` of its set, nothing can be linked to it, and it goes. The centre is
    the document whose shingles the others have most often.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, first = shingles(batch["text"], how.words)
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch["id"], lists], ["node", "values"])

    nodes = members.select(F.col("node").alias("id")).distinct()
    held = by_slices(
        texts.join(nodes, "id", "left_semi").select("id", "text"), "text", "node long, values array<long>", work
    ).select("node", F.explode("values").alias("s")).distinct()
    several = held.groupBy("s").agg(F.count("*").alias("times")).where("times > 1")
    known = stored(
        held.join(several, "s").groupBy("node")
        .agg(F.count("*").alias("common"), F.sum("times").alias("weight"))
    )
    alive = stored(_open(
        members.join(known, "node").where(100 * F.col("common") >= how.percent * F.col("n"))
    ))
    centre = F.max(F.struct((F.col("weight") / F.col("n")).alias("w"), "node", F.col("n").alias("centre_n")))
    centres = stored(alive.groupBy("key").agg(centre.alias("at")).select(
        "key", F.col("at.node").alias("centre"), "at.centre_n"
    ))
    met = stored(alive.join(centres, "key"))
    pairs = met.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    shared = overlaps(pairs, texts, how).groupBy(F.col("a").alias("centre"), F.col("b").alias("node")).agg(
        F.max("shared").alias("shared")
    )
    return stored(met.join(shared, ["centre", "node"]).drop("weight"))


def _across(members: DataFrame, how: MinMax) -> DataFrame:
    """The pairs (a, b) across the classes of a bucket that may be linked.

    Two documents share at most the lesser of what each shares with the centre,
    and outside the centre the lesser of the shingles that each has in common with
    any other document. Where that is too little the pair is ruled out unseen.
    """
    own = F.col("common") - F.col("shared")
    members = stored(_open(members.withColumn("own", own)))
    bounds = stored(members.groupBy("key").agg(
        F.min("n").alias("least_n"), F.max("own").alias("most_own"), F.mode("c").alias("main")
    ))
    keys = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    able = members.join(bounds, "key").where(
        _linked(how, F.col("shared") + F.least("own", "most_own"), "n", "least_n")
    ).join(keys, "node")
    sides = [
        able.where("c <> main" if outside else "true").select(
            "key", *(F.col(x).alias(x + i) for x in ("node", "n", "c", "shared", "own", "keys"))
        )
        for i, outside in (("1", True), ("2", False))
    ]
    most = F.least("shared1", "shared2") + F.least("own1", "own2")
    # Of the buckets that two documents share, the first one brings them together.
    here = F.col("key") == F.array_min(F.array_intersect("keys1", "keys2"))
    return (
        sides[0].join(sides[1], "key")
        .where(
            (F.col("c1") != F.col("c2")) & _similar_sizes("n1", "n2", how)
            & _linked(how, most, "n1", "n2") & here
        )
        .select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
    )


def _ids_with_several_sets(usable: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the nodes of an id that comes with different texts."""
    several = usable.groupBy("id").agg(
        F.min("s1").alias("x"), F.max("s1").alias("y"), F.min("s2").alias("z"), F.max("s2").alias("w")
    ).where("x <> y OR z <> w").select("id")
    return (
        usable.join(several, "id", "left_semi").join(sets, ["s1", "s2"])
        .select(F.col("node").alias("a"), F.col("id").alias("b")).distinct()
    )
