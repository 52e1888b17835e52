"""Line dedup by distinct-site spread: lines found on many sites are taken out as boilerplate.

Each line hash gets HyperLogLog sketches of the sites and of the distinct texts it
is in; partial sketches merge by aggregation. A line with an estimate near the
threshold gets exact distinct counts. A line must be on many sites in as many
distinct texts: those of one text that is copied to many sites are left to
near-dedup. Spread lines leave every text, however much of it they are.

Only DataFrame functions are used. Defined results: a null text stays null and
has no lines; a text of spread lines only is left empty, or with its blank lines;
a null site, and a text on none, counts for no line; lines without a word are kept;
repeated rows are treated alike; an empty table gives an empty result; extra
columns are kept under any name, but one named like an added one is replaced.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import packed, settled, stored, text_key, unpacked
from parlance.llm.lines import all_lines, has_word, line_hashes, without_lines


@dataclass(frozen=True)
class Spread:
    """A line on `min_sites` sites or more, in as many distinct texts, is boilerplate.

    Estimates within `margin` of that are settled by exact counts; sketches have
    2 ** lg_k registers, a standard error of 1.04 / 2 ** (lg_k / 2).
    """

    min_sites: int = 10
    lg_k: int = 8
    margin: float = 0.35


def text_lines(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """(site, key, check, line) for each distinct line of each text."""
    return docs.where(F.col(text).isNotNull()).select(
        F.col(site).alias("site"), *text_key(F.col(text)), F.explode(line_hashes(F.col(text))).alias("line")
    )


def spread_lines(lines: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """(line): hashes of the lines on `min_sites` sites or more, in as many distinct texts."""
    placed = lines.where("site IS NOT NULL").select("line", "site", "key", "check")
    estimated = stored(
        placed.groupBy("line").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", spread.lg_k)).alias("sites"),
            F.hll_sketch_estimate(F.hll_sketch_agg("key", spread.lg_k)).alias("texts"),
        )
        .withColumn("fewer", F.least("sites", "texts"))
        .where(F.col("fewer") >= spread.min_sites * (1 - spread.margin))
    )
    near = F.col("fewer") <= spread.min_sites * (1 + spread.margin)
    exact = (
        placed.join(estimated.where(near).select("line"), "line", "left_semi")
        .groupBy("line").agg(
            F.count_distinct("site").alias("sites"), F.count_distinct("key", "check").alias("texts")
        )
        .where(F.least("sites", "texts") >= spread.min_sites)
    )
    return estimated.where(~near).select("line").unionByName(exact.select("line"))


def line_dedup(
    docs: DataFrame, text: str = "text", site: str = "source", spread: Spread = Spread()
) -> DataFrame:
    """Add n_lines, n_removed and left_text, the text without boilerplate lines.

    Line hashes are made once and stored; the lines to remove are found once for
    each distinct text. Only these stay stored, which leaves the rows' own shuffle
    free to be split where one text is hot. They grow with the texts, so rows meet
    them by a shuffle at every size.
    """

    def found() -> DataFrame:
        lines = stored(text_lines(docs, text, site))
        flagged = stored(spread_lines(lines, spread))
        return (
            lines.join(flagged, "line", "left_semi")
            .groupBy("key", "check").agg(F.collect_set("line").alias("hits"))
        )

    hits = settled(docs.sparkSession, found)
    key, check = text_key(F.col(text))
    rows = packed(docs, text=text, key=key, check=check)
    done = rows.join(hits.hint("merge"), ["key", "check"], "left").withColumn(
        "left_text",
        F.when(F.col("hits").isNotNull(), without_lines(F.col("text"), F.col("hits"))).otherwise(F.col("text")),
    ).withColumn("n_lines", _n_lines("text")).withColumn(
        "n_removed", F.col("n_lines") - _n_lines("left_text")
    )
    return unpacked(done, docs.columns, ["n_lines", "n_removed", "left_text"])


def _n_lines(text: str) -> Column:
    return F.size(F.filter(all_lines(F.col(text)), has_word)).cast("long")
