"""Cleaning of turn text against a lexicon of known words.

A lexicon of bounded size is held by the workers, and texts are cleaned in place, in
Arrow batches and one pass over each text. With a larger one words are joined to it;
places of gibberish words are gathered per text and joined to the rows by a digest of
the text. In neither way is a text shuffled as a key.
"""

import re
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance import constants as C
from parlance.functions.text import tidy_spaces, truncate_last_terminator
from parlance.operators.keyed import fits_broadcast, lookup_join, with_digest

# A lexicon of up to so many words is held by every Python worker.
HELD_WORDS = 500_000

# So many gibberish words leave a Python worker at once.
TOKENS_AT_ONCE = 20_000


def _words(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per word token: keys, pos (0 for the first word), token, word.

    A word token starts with a letter, so the numbers that count as known are
    never among them.
    """
    tokens = F.regexp_extract_all(F.col(text), F.lit(f"({C.WORD_PATTERN})"), F.lit(1))
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token")).withColumn(
        "word", F.lower("token")
    )


def _without_words(df: DataFrame, text: str, positions: str, into: str) -> DataFrame:
    """Add a text without some of its word tokens.

    Words and the stretches between them take turns, so the n-th word is piece
    2n, or 2n + 1 if the text does not start with a letter. The pieces are a
    column of their own, so that they are cut once and not per element.
    """
    pieces = F.regexp_extract_all(
        F.col(text), F.lit(f"({C.WORD_PATTERN}|[^A-Za-z]+)"), F.lit(1)
    )
    first = F.when(F.col(text).rlike("^[A-Za-z]"), F.lit(0)).otherwise(F.lit(1))
    dropped = F.transform(positions, lambda n: n * 2 + F.col("_first"))
    every = F.sequence(F.lit(0), F.size("_pieces") - 1)
    return (
        df.withColumns({"_pieces": pieces, "_first": first})
        .withColumn("_kept", F.array_except(every, dropped))
        .withColumn(
            into,
            F.array_join(F.transform("_kept", lambda n: F.get(F.col("_pieces"), n)), ""),
        )
        .drop("_pieces", "_first", "_kept")
    )


def _known_words(
    lexicon: DataFrame, allow: DataFrame | Sequence[str], threshold: float
) -> DataFrame:
    """Words that are frequent enough in some language, or allowed.

    `lexicon` has `token, zipf`, one row per token and language.
    """
    frequent = lexicon.where(F.col("zipf") >= threshold).select(F.lower("token").alias("word"))
    if not isinstance(allow, DataFrame):
        allow = lexicon.sparkSession.createDataFrame([(w,) for w in allow], "token string")
    return frequent.union(allow.select(F.lower("token"))).distinct()


def _held_words(
    lexicon: DataFrame, allow: DataFrame | Sequence[str], threshold: float
) -> Broadcast | None:
    """The known words, sent to the workers; None if there are more than they hold.

    To the driver come no more words than that.
    """
    known = _known_words(lexicon, allow, threshold).limit(HELD_WORDS + 1).collect()
    if len(known) > HELD_WORDS:
        return None
    return lexicon.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in known))


def _stripped(held: Broadcast):
    """A text without the words that are not held."""
    pattern = re.compile(C.WORD_PATTERN)

    @F.arrow_udf("string")
    def strip(texts: pa.Array) -> pa.Array:
        known = held.value

        def kept(word: re.Match) -> str:
            return word[0] if word[0].lower() in known else ""

        # Texts are written one behind the other, so that a batch is not held as a list of them besides.
        whole, ends = bytearray(), array("i", [0])
        for text in texts:
            if text.is_valid:
                whole += pattern.sub(kept, text.as_py()).encode()
            ends.append(len(whole))
        valid = pc.is_valid(texts).buffers()[1] if texts.null_count else None
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(whole), valid, texts.null_count)

    return strip


def _words_counted(held: Broadcast):
    """(bad, words): how many words of a text are not held, and how many words it has."""
    pattern = re.compile(C.WORD_PATTERN)

    @F.arrow_udf("bad int, words int")
    def count(texts: pa.Array) -> pa.Array:
        known = held.value
        bad, words = array("i"), array("i")
        for text in texts:
            n = unknown = 0
            for word in pattern.finditer(text.as_py()) if text.is_valid else ():
                n += 1
                unknown += word[0].lower() not in known
            bad.append(unknown)
            words.append(n)
        return pa.StructArray.from_arrays([pa.array(bad, pa.int32()), pa.array(words, pa.int32())], ["bad", "words"])

    return count


def _unheld_tokens(held: Broadcast, keys: Sequence[str]):
    """Batches of keys, pos and token: the words that are not held, a bounded number at a time."""
    pattern, names = re.compile(C.WORD_PATTERN), [*keys, "pos", "token"]

    def rows(batch: pa.RecordBatch, at: array, pos: array, tokens: list[str]) -> pa.RecordBatch:
        row = pa.array(at, pa.int32())
        columns = [batch.column(c).take(row) for c in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(pos, pa.int32()), pa.array(tokens, pa.string())], names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            at, pos, tokens = array("i"), array("i"), []
            for i, t in enumerate(batch.column(len(keys))):
                for n, word in enumerate(pattern.finditer(t.as_py()) if t.is_valid else ()):
                    if word[0].lower() not in known:
                        at.append(i)
                        pos.append(n)
                        tokens.append(word[0])
                        if len(tokens) == TOKENS_AT_ONCE:
                            yield rows(batch, at, pos, tokens)
                            at, pos, tokens = array("i"), array("i"), []
            if tokens:
                yield rows(batch, at, pos, tokens)

    return find


def _gibberish_rows(
    df: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame,
    allow: DataFrame | Sequence[str], threshold: float,
) -> DataFrame:
    """Word tokens that are not known words.

    A lexicon measured to be small is broadcast, and no token is shuffled; only
    the lexicon is read for that, not the texts. A larger one is compared with
    the distinct words first.
    """
    words = _words(df, keys, text)
    known = _known_words(lexicon, allow, threshold)
    if fits_broadcast(lexicon):
        return words.join(F.broadcast(known), "word", "left_anti")
    unknown = words.select("word").distinct().join(known, "word", "left_anti")
    return lookup_join(words, unknown, ["word"], "left_semi")


def gibberish_tokens(
    df: DataFrame,
    text: str,
    lexicon: DataFrame,
    keys: Sequence[str],
    allow: DataFrame | Sequence[str] = C.DOMAIN_ALLOWLIST,
    threshold: float = C.ZIPF_THRESHOLD,
) -> DataFrame:
    """Gibberish word tokens of each row: keys, pos (among the text's words), token."""
    held = _held_words(lexicon, allow, threshold)
    if held is None:
        rows = _gibberish_rows(df, keys, text, lexicon, allow, threshold)
        return rows.select(*keys, "pos", "token")
    asked = df.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*asked.schema.fields[:-1], *T.StructType.fromDDL("pos int, token string")])
    return asked.mapInArrow(_unheld_tokens(held, keys), schema)


def _positions(
    keyed: DataFrame, text: str, lexicon: DataFrame,
    allow: DataFrame | Sequence[str], threshold: float,
) -> DataFrame:
    """(digest, positions) of each text that holds gibberish.

    No text is shuffled: what is grouped are the digests and places of gibberish words,
    and a text that repeats sends its places once per task.
    """
    rows = _gibberish_rows(
        keyed.where(F.col(text).isNotNull()), ["_d1", "_d2"], text, lexicon, allow, threshold
    )
    return rows.groupBy("_d1", "_d2").agg(F.collect_set("pos").alias("_positions"))


def strip_gibberish(
    df: DataFrame,
    text: str,
    lexicon: DataFrame,
    allow: DataFrame | Sequence[str] = C.DOMAIN_ALLOWLIST,
    threshold: float = C.ZIPF_THRESHOLD,
    into: str = "stripped",
) -> DataFrame:
    """Add the text without its gibberish words, white space tidied.

    With a large lexicon only digests and positions are joined to the rows; a text is
    rebuilt where it is.
    """
    others = [c for c in df.columns if c != into]
    held = _held_words(lexicon, allow, threshold)
    if held is not None:
        return df.select(*others, tidy_spaces(_stripped(held)(F.col(text))).alias(into))
    keyed = with_digest(df, text)
    found = lookup_join(
        keyed, _positions(keyed, text, lexicon, allow, threshold), ["_d1", "_d2"]
    )
    kept = F.when(F.col("_positions").isNull(), F.col(text)).otherwise(F.col("_rebuilt"))
    return (
        _without_words(found, text, "_positions", "_rebuilt")
        .withColumn(into, tidy_spaces(kept))
        .select(*others, into)
    )


def gibberish_ratio(
    df: DataFrame,
    text: str,
    lexicon: DataFrame,
    allow: DataFrame | Sequence[str] = C.DOMAIN_ALLOWLIST,
    threshold: float = C.ZIPF_THRESHOLD,
    into: str = "gibberish_ratio",
) -> DataFrame:
    """Add the share of word tokens that are gibberish; 0.0 without words."""
    held = _held_words(lexicon, allow, threshold)
    if held is not None:
        share = F.try_divide(F.col("_found.bad").cast("double"), F.col("_found.words").cast("double"))
        found = df.withColumn("_found", _words_counted(held)(F.col(text)))
        return found.select(
            *[c for c in df.columns if c != into], F.coalesce(share, F.lit(0.0)).alias(into)
        )
    keyed = with_digest(df, text)
    found = _positions(keyed, text, lexicon, allow, threshold).select(
        "_d1", "_d2", F.size("_positions").alias("_bad")
    )
    n_words = F.regexp_count(F.col(text), F.lit(C.WORD_PATTERN))
    ratio = F.try_divide(F.col("_bad").cast("double"), n_words.cast("double"))
    return (
        lookup_join(keyed, found, ["_d1", "_d2"])
        .withColumn(into, F.when(F.col("_bad").isNull(), 0.0).otherwise(F.coalesce(ratio, F.lit(0.0))))
        .select(*[c for c in df.columns if c != into], into)
    )


def word_frequencies(df: DataFrame, text: str, digits: int = 2) -> DataFrame:
    """A lexicon (token, zipf) from a corpus: the logarithm of a word's count per 10^9 words.

    The number of words is counted when this is called.
    """
    words = _words(df, [], text).groupBy(F.col("word").alias("token")).agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 1
    zipf = F.log10(F.col("n") * F.lit(1e9) / F.lit(total))
    return words.select("token", F.round(zipf, digits).alias("zipf"))


def clean_turns(
    turns: DataFrame,
    lexicon: DataFrame | None = None,
    allow: DataFrame | Sequence[str] = C.DOMAIN_ALLOWLIST,
    threshold: float = C.ZIPF_THRESHOLD,
) -> DataFrame:
    """Add text_clean: cut after the last terminator, then strip gibberish.

    Without a lexicon only the cut and the tidying are done, with no shuffle.
    """
    cut = turns.withColumn("_cut", truncate_last_terminator(F.col("text_raw")))
    if lexicon is None:
        return cut.withColumn("text_clean", tidy_spaces(F.col("_cut"))).drop("_cut")
    stripped = strip_gibberish(
        cut.drop("text_clean"), "_cut", lexicon, allow, threshold, into="text_clean"
    )
    return stripped.drop("_cut")


def cleaning_counts(turns: DataFrame) -> DataFrame:
    """Turns in all, and turns whose cleaned text is empty."""
    return turns.agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("text_clean") == "").alias("empty_texts"),
    )
