"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Words are parted into grams of variable length. A gram begins with a few code
points and is extended while the dictionary of frequent grams holds it, so a
common run takes a longer gram than a rare one. A gram depends on its own letters
alone. Words are parted from both ends, so one edit affects only the grams around
its place: the j grams before it and the k grams behind it must all be found in a
partner. For each place in a word these bounds are worked out, and the lists of
those grams are merged as one, under a hash of all of them. Places with the same
unaffected grams share one list. Members of a list are verified by edit distance.

A list of more than `max_list` words is split by the exact place of the edit; the
words of such a part differ in one code point there, so all its pairs are results.
No pair is lost and no list makes more pairs than members times `max_list`.

Defined results: a null text has no words; a null id counts as an empty one; rows
that repeat count each; an empty table gives an empty result; of other columns
none is used, whatever their names. Of several forms the first in code-point order
is taken. A run of letters may be as long as a text: longer words have longer
grams, some forty at most.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import slices, stored


@dataclass(frozen=True)
class Variants:
    """Words have `min_chars` code points and `min_count` occurrences or more. A form occurs
    `ratio` times as often as its variant, at least.

    A gram is frequent if more than one in `max_frequent` of all grams is it, so there are
    fewer frequent grams than that. `thinned`: of so many runs of a document one loses a
    code point.
    """

    min_chars: int = 7
    min_count: int = 2
    ratio: int = 10
    shortest: int = 2
    longest: int = 4
    max_frequent: int = 500
    max_list: int = 64
    thinned: int = 31


# Words up to so many code points have the shortest grams; twice as long ones, grams twice as long.
PLAIN_CHARS = 64
# Counts are handed on when a task holds so many different ones.
HELD = 200_000

# A-Z as a-z, other bytes as they are; U+00C0 to U+00FF are the bytes C3 80 to C3 BF.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _counted(counts: Counter, name: str) -> pa.RecordBatch:
    keys = pa.array(list(counts.keys()))
    return pa.RecordBatch.from_arrays(
        [keys.cast(pa.string()), pa.array(list(counts.values()), pa.int64())], [name, "n"]
    )


def _one_lost(run: bytes, at: int) -> bytes:
    word = run.decode()
    return (word[:at] + word[at + 1 :]).encode()


def word_counts(docs: DataFrame, text: str = "text", id: str = "doc_id", how: Variants = Variants()) -> DataFrame:
    """(word, n) of the words of all texts; a task adds up what it has before it is shuffled."""
    rows = docs.select(
        F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").alias("text")
    ).where("text IS NOT NULL")
    least, thinned = how.min_chars, how.thinned
    runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part["text"].cast(pa.large_binary())
                for name, found in zip(part["id"].to_pylist(), texts, strict=True):
                    seed = zlib.crc32(name.encode() + b":")
                    for word, n in Counter(runs.findall(found.as_py().translate(LOWER))).items():
                        h = zlib.crc32(word, seed)
                        if h % thinned == 0:
                            length = len(word) - word.count(0xC3)
                            if length == least:
                                continue
                            word = _one_lost(word, h % length)
                        counts[word] += n
                if len(counts) >= HELD:
                    yield _counted(counts, "word")
                    counts.clear()
        if counts:
            yield _counted(counts, "word")

    partial = rows.mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= how.min_count)


def frequent_grams(words: DataFrame, how: Variants = Variants()) -> frozenset[str]:
    """The dictionary of grams that are extended: each is more than one in `max_frequent` of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch["word"].to_pylist():
                for size in range(how.shortest, how.longest):
                    counts.update([word[at : at + size] for at in range(len(word) - size + 1)])
                if len(counts) >= HELD:
                    yield _counted(counts, "gram")
                    counts.clear()
        if counts:
            yield _counted(counts, "gram")

    counts = stored(
        words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * how.max_frequent > total).select("gram").collect()
    return frozenset(r["gram"] for r in found)


def _ends(word: str, shortest: int, longest: int, frequent: frozenset[str]) -> list[int]:
    """Where the grams of a word end, from its beginning; 0 first. A last stretch that the
    end of the word cuts off is no gram."""
    ends, start, size = [0], 0, len(word)
    while True:
        end = start + shortest
        while end <= size and end < start + longest and word[start:end] in frequent:
            end += 1
        if end > size:
            return ends
        ends.append(end)
        start = end


def _level(length: int) -> int:
    return max(0, (length // PLAIN_CHARS).bit_length())


def places(word: str, level: int, frequent: frozenset[str], backward: frozenset[str], how: Variants):
    """(gap, left, right, first, last): edits at the places from first to last leave the grams
    before `left` and those from `right` on. With `gap`, a place is before a code point, where
    one may be inserted; without, it is the code point that is replaced or deleted."""
    shortest, longest = how.shortest << level, how.longest << level
    size = len(word)
    before = _ends(word, shortest, longest, frequent)
    behind = [size - end for end in _ends(word[::-1], shortest, longest, backward)]
    for gap in (False, True):
        # Going right, the next place where something changes is that of a boundary.
        lefts, rights = iter(before[1:]), behind[::-1]
        left, following = 0, next(lefts, size + 1)
        at, first = 0, 0
        last_place = size if gap else size - 1
        while first <= last_place:
            while following <= first:
                left, following = following, next(lefts, size + 1)
            needed = first if gap else first + 1
            while rights[at] < needed:
                at += 1
            right = rights[at]
            last = min(following - 1, right if gap else right - 1, last_place)
            yield gap, left, right, first, last
            first = last + 1


def gram_lists(words: DataFrame, frequent: frozenset[str], how: Variants = Variants()) -> DataFrame:
    """(key, gap, word, n, first, last): the list a word is in for edits at these places."""
    backward = frozenset(g[::-1] for g in frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, level, found = [], [], []
            for at, word in enumerate(batch["word"].to_pylist()):
                # A word and one that is a code point shorter go by the shorter one's level.
                for size in {_level(len(word)), _level(len(word) - 1)}:
                    for place in places(word, size, frequent, backward, how):
                        row.append(at)
                        level.append(size)
                        found.append(place)
            gap, left, right, first, last = zip(*found) if found else ((),) * 5
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["word"].take(rows), batch["n"].take(rows), pa.array(level, pa.int32()),
                    pa.array(gap, pa.bool_()),
                    *(pa.array(c, pa.int32()) for c in (left, right, first, last)),
                ],
                ["word", "n", "level", "gap", "left", "right", "first", "last"],
            )

    placed = words.select("word", "n").mapInArrow(
        run, "word string, n long, level int, gap boolean, left int, right int, first int, last int"
    )
    return placed.select(
        F.xxhash64("level", F.expr("left(word, left)"), F.lit("|"), F.expr("substr(word, right + 1)")).alias("key"),
        "gap", "word", "n", "first", "last",
    )


def _by_exact_place(lists: DataFrame) -> DataFrame:
    """The same words in lists of one place each: all the rest of the word is the key."""
    split = lists.withColumn("at", F.explode(F.sequence("first", "last")))
    rest = F.expr("substr(word, at + IF(gap, 1, 2))")
    return split.select(
        F.xxhash64(F.expr("left(word, at)"), F.lit("|"), rest).alias("key"), "gap", "word", "n"
    )


def _pairs(lists: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of the lists at an edit distance of one."""
    a = lists.where("NOT gap").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = lists.select("key", "gap", F.col("word").alias("b"), F.col("n").alias("n_b"))
    longer = F.length("a") - F.length("b")
    replaced = ~F.col("gap") & (longer == 0) & (F.col("a") < F.col("b"))
    deleted = F.col("gap") & (longer == 1)
    return (
        a.join(b, "key").where((replaced | deleted) & (F.levenshtein("a", "b", 1) == 1))
        .select("a", "n_a", "b", "n_b")
    )


def near_words(words: DataFrame, how: Variants = Variants()) -> DataFrame:
    """(a, n_a, b, n_b) of all words one edit apart, each pair once."""
    lists = stored(gram_lists(words, frequent_grams(words, how), how))
    long = stored(
        lists.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > how.max_list).select("key")
    )
    short = _pairs(lists.join(long, "key", "left_anti"))
    split = _pairs(_by_exact_place(lists.join(long, "key", "left_semi")))
    return short.unionByName(split).distinct()


def _roots(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) of each word with a form, by following twice as many forms each time."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    done = 1
    while done < hops:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(
            now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        )
        done *= 2
    return now


def spelling_variants(
    docs: DataFrame, text: str = "text", id: str = "doc_id", how: Variants = Variants()
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    A form has `ratio` times the occurrences of its word, so the longest chain of
    forms has as many hops as the largest count has digits, to that base.
    """
    words = stored(word_counts(docs, text, id, how))
    pairs = stored(near_words(words, how))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    is_form = -F.col("best.less") >= how.ratio * F.col("n")
    judged = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
        )
    )
    largest = words.agg(F.max("n")).first()[0] or 0
    hops = 0
    while how.min_count * how.ratio ** (hops + 1) <= largest:
        hops += 1
    roots = _roots(judged.where("form IS NOT NULL"), hops)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
