"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they are in).
A flow routes word capacity from patterns to source quotas; each repetition of a
pattern's words costs more than the one before, so the flow repeats as little as
it can and as evenly as it can. Documents are then selected by a seeded hash, so
that the words taken from each pattern come to its flow.

Only the patterns, their sizes and the sources reach the driver: they are a
matter of configuration and do not grow with the documents.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a document without sources is not taken; a document of size 0 is
taken 0 words; rows with equal id, text and sources are selected together; an
empty table gives an empty result.
"""

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import packed, stored, unpacked
from parlance.llm.sizes import with_word_counts


@dataclass(frozen=True)
class Mix:
    """Weights are dealt to the sources in order, and repeat; the sources share
    `percent` of all words; no document is taken more than `repeats` times."""

    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    repeats: int = 2
    seed: int = 11


# Selection narrows down the hash of the last document by so many bits a level.
LEVEL_BITS, LEVELS = 16, 2


def targets(sizes: dict[str | None, int], mix: Mix) -> dict[str | None, float]:
    """Words that each source should give: shares by weight, at most `repeats` times its
    size, what is above shared out again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(order)}
    found: dict[str | None, float] = {}
    left = mix.percent * sum(sizes.values()) / 100
    open_ = list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > mix.repeats * sizes[s]]
        if not full:
            found |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            found[s] = float(mix.repeats * sizes[s])
        left -= sum(mix.repeats * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return found


def min_cost_flow(
    patterns: Sequence[tuple[frozenset, int]], quotas: dict, repeats: int
) -> list[dict]:
    """Words that each pattern gives to each source, by successive cheapest paths.

    The k-th repetition of a pattern's words costs k, so costs are convex. A path
    leads from a pattern that may give more, over sources and the patterns that
    feed them, to a source whose quota is open; only patterns at the lowest
    repetition start paths, which makes each one a cheapest path.
    """
    flow: list[dict] = [dict.fromkeys(members, 0) for members, _ in patterns]
    need = dict(quotas)
    feeds = {s: [i for i, (members, _) in enumerate(patterns) if s in members] for s in quotas}
    for round_ in range(1, repeats + 1):
        room = [round_ * size - sum(f.values()) for (_, size), f in zip(patterns, flow, strict=True)]
        while path := _open_path(patterns, flow, room, need, feeds):
            start, steps = path
            end = steps[-1][1]
            amount = min([room[start], need[end], *(flow[i][s] for _, _, i, s in steps[1:])])
            for giver, source, moved, old in steps:
                flow[giver][source] += amount
                if moved is not None:
                    flow[moved][old] -= amount
            room[start] -= amount
            need[end] -= amount
    return flow


def _open_path(patterns, flow, room, need, feeds):
    """The shortest chain (giver, source, rerouted pattern, its old source) to an open quota."""
    came: dict = {}
    reached = [(i, ()) for i in range(len(patterns)) if room[i] > 0]
    seen = {i for i, _ in reached}
    while reached:
        further = []
        for i, steps in reached:
            start = came.get(i, i)
            for s in flow[i]:
                step = steps + ((i, s),)
                if need[s] > 0:
                    return start, _spelled(step)
                for j in feeds[s]:
                    if j not in seen and flow[j][s] > 0:
                        seen.add(j)
                        came[j] = start
                        further.append((j, step))
        reached = further
    return None


def _spelled(step):
    """Each giver and its source, with the pattern rerouted from the source before it."""
    out = []
    for at, (giver, source) in enumerate(step):
        out.append((giver, source, giver if at else None, step[at - 1][1] if at else None))
    return out


def _level(hash: Column, level: int) -> Column:
    shift = 64 - LEVEL_BITS * (level + 1)
    return F.shiftrightunsigned(hash, shift).bitwiseAND((1 << LEVEL_BITS) - 1)


def _selected(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents of each pattern whose sizes come to what is wanted, as (pattern, hash, taken).

    `wanted` has (pattern, want). Documents are taken down the hash order; one that
    exceeds what is lacking is set aside. Each round takes those up to the first
    that doesn't fit and then the largest that does, until nothing fits; in the
    end the one that comes nearest closes the gap. Rows with equal hash are one.
    """
    units = stored(
        sized.groupBy("pattern", "hash").agg(F.sum("size").alias("size"))
        .withColumn("taken", F.lit(False))
    )
    while True:
        lacking = _lacking(units, wanted)
        if units.where("NOT taken AND size > 0").join(F.broadcast(lacking), "pattern").where("size <= gap").isEmpty():
            return _closer(units, lacking, last=True)
        units = _swept(units, lacking)
        units = _closer(units, _lacking(units, wanted), last=False)


def _lacking(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, gap) of the patterns that lack words."""
    given = units.groupBy("pattern").agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("given"))
    return stored(
        given.join(F.broadcast(wanted), "pattern")
        .select("pattern", (F.col("want") - F.col("given")).alias("gap")).where("gap > 0")
    )


def _swept(units: DataFrame, lacking: DataFrame) -> DataFrame:
    """Take the documents that fit, in hash order, up to the first that exceeds what is lacking.

    Sizes are summed per hash cell, the cells whose running sum stays within the
    gap are taken whole, and the cell after them is split again.
    """
    rows = units.join(F.broadcast(lacking), "pattern", "left").withColumn(
        "fits", ~F.col("taken") & F.coalesce(F.col("size") <= F.col("gap"), F.lit(False))
    )
    prefix: list[str] = []
    cells = []
    for level in range(LEVELS):
        into = f"c{level}"
        rows = rows.withColumn(into, _level(F.col("hash"), level))
        open_rows = rows.where("fits")
        if cells:
            open_rows = open_rows.drop("gap").join(
                cells[-1].where("edge").select("pattern", *prefix, F.col("missing").alias("gap")), ["pattern", *prefix]
            )
        running = F.sum("words").over(
            Window.partitionBy("pattern").orderBy(into).rowsBetween(Window.unboundedPreceding, 0)
        )
        prefix = [*prefix, into]
        summed = (
            open_rows.groupBy("pattern", *prefix)
            .agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
            .withColumn("upto", running)
            .withColumn("whole", F.col("upto") <= F.col("gap"))
            .withColumn("missing", F.col("gap") - (F.col("upto") - F.col("words")))
            .withColumn("edge", (F.col("missing") >= 0) & ~F.col("whole"))
            .where("whole OR edge")
        )
        cells.append(stored(summed.select("pattern", *prefix, "whole", "edge", "missing")))
    taken = F.lit(False)
    for level, found in enumerate(cells):
        keys = ["pattern", *prefix[: level + 1]]
        rows = rows.join(found.where("whole").select(*keys, F.lit(True).alias(f"t{level}")), keys, "left")
        taken = taken | F.coalesce(f"t{level}", F.lit(False))
    return stored(rows.select("pattern", "hash", "size", (F.col("taken") | (F.col("fits") & taken)).alias("taken")))


def _closer(units: DataFrame, lacking: DataFrame, last: bool) -> DataFrame:
    """Take one more document of each pattern: the largest that fits into what is lacking,
    or in the end the one that comes nearest to it."""
    off = F.abs(F.col("size") - F.col("gap"))
    better = off < F.col("gap") if last else F.col("size") <= F.col("gap")
    best = (
        units.where("NOT taken AND size > 0").join(F.broadcast(lacking), "pattern").where(better)
        .groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "hash")).alias("best"))
        .select("pattern", F.col("best.hash").alias("hash"), F.lit(True).alias("extra"))
    )
    return stored(
        units.join(F.broadcast(best), ["pattern", "hash"], "left")
        .select("pattern", "hash", "size", (F.col("taken") | F.coalesce("extra", F.lit(False))).alias("taken"))
    )


def mix_sources(
    docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", mix: Mix = Mix()
) -> tuple[DataFrame, dict, dict]:
    """Per document: id, key, pattern (its sources), size and the times it is taken; and
    the words and the target of each source.

    `source` holds one source, or an array of them for overlapping sources; a
    document in several sources counts as part of each.
    """
    rows = docs.select(
        F.col(id).alias("id"), row_key(docs, text, id, source).alias("key"),
        _pattern(docs, source).alias("pattern"), F.col(text).alias("text"),
    )
    sized = stored(
        with_word_counts(rows, "text", "size").withColumn("hash", F.xxhash64(F.lit(mix.seed), "key"))
    )
    found = sized.groupBy("pattern").agg(F.sum("size").alias("size")).collect()
    patterns = sorted(
        ((r["pattern"], json.loads(r["pattern"]), r["size"]) for r in found),
        key=lambda p: [(s is None, s or "") for s in p[1]],
    )
    words: dict[str | None, int] = {}
    for _, members, size in patterns:
        for s in members:
            words[s] = words.get(s, 0) + size
    goals = targets(words, mix)
    flow = min_cost_flow(
        [(frozenset(members), size) for _, members, size in patterns],
        {s: round(t) for s, t in goals.items()}, mix.repeats,
    )
    given = [
        (pattern, *(divmod(sum(f.values()), size) if size else (0, 0)))
        for (pattern, _, size), f in zip(patterns, flow, strict=True)
    ]
    wanted = docs.sparkSession.createDataFrame(given, "pattern string, base long, want long")
    units = _selected(sized, wanted.select("pattern", "want"))
    chosen = sized.join(units.drop("size"), ["pattern", "hash"])
    taken = chosen.join(F.broadcast(wanted.drop("want")), "pattern").select(
        "id", "key", "pattern", "size",
        (F.col("base") + F.col("taken").cast("long")).alias("times"),
    )
    return taken, words, goals


def _pattern(docs: DataFrame, source: str) -> Column:
    """The set of a document's sources, as JSON."""
    if docs.schema[source].dataType.typeName() == "array":
        members = F.array_sort(F.array_distinct(F.coalesce(source, F.array())))
    else:
        members = F.array(source)
    return F.to_json(members)


def row_key(docs: DataFrame, text: str, id: str, source: str) -> Column:
    """What tells a document from others: its id, text and sources, hashed."""
    return F.xxhash64(F.col(id), F.col(text), _pattern(docs, source))


def mixed_documents(
    docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", mix: Mix = Mix()
) -> DataFrame:
    """The documents of the mix: each as often as it is taken."""
    taken, _, _ = mix_sources(docs, text, id, source, mix)
    times = taken.where("times > 0").groupBy("key").agg(F.max("times").alias("times"))
    repeated = packed(docs, key=row_key(docs, text, id, source)).join(times, "key").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    )
    return unpacked(repeated, docs.columns, [])
