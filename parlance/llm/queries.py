"""The corpus queries: each applies one operator to its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (
    html_extract,
    line_dedup,
    minhash,
    mixing,
    packing,
    quality_model,
    quality_rules,
    simhash,
    spelling,
    substring,
    token_counts,
    url_filter,
    vector_codes,
)
from parlance.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality_model.train(docs, labels.where(fold != 0))
    return quality_model.scored(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


URL_RULES = (
    url_filter.Rule("net", "/", block=True),
    url_filter.Rule("example.net", "/en/", block=False),
    url_filter.Rule("example.com", "/de/", block=True),
    url_filter.Rule("org", "/fr/", block=False),
)


@query
def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged_urls(pages, rules=URL_RULES).drop("url")


@query
def op5_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = minhash.MinMax(words=4)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), how=how)


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query documents are those whose id is divisible by 50. `near_queries` counts the other
    ones within the search radius, copies too; `near_ids` names the first query document of each
    fingerprint among them and the document's own, so copies share an id."""
    prints = stored(
        simhash.compared_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    )
    is_query = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    asked = stored(
        prints.where(is_query).groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("near_id"))
    )
    same = asked.select(F.col("fingerprint").alias("query"), "fingerprint")
    # Stored, so that the joins can be split where a fingerprint is hot.
    pairs = stored(simhash.near_fingerprints(asked, prints).select("query", "fingerprint").unionByName(same))
    near = stored(
        pairs.join(asked.withColumnRenamed("fingerprint", "query"), "query").groupBy("fingerprint")
        .agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("near_id")).alias("near_ids"))
    )
    return prints.join(near, "fingerprint", "left").select(
        *prints.columns, (F.coalesce("n", F.lit(0)) - is_query.cast("long")).alias("near_queries"),
        F.coalesce("near_ids", F.array().cast("array<long>")).alias("near_ids"),
    )


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, words, goals = mixing.mix_sources(table(spark, sf_dir, "documents"))
    per_source = spark.createDataFrame(
        [([s], words[s], goals[s]) for s in words], "pattern array<string>, source_size long, target double"
    ).withColumn("pattern", F.to_json("pattern"))
    return taken.join(F.broadcast(per_source), "pattern").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("times") * F.col("size")).alias("taken"),
    )


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.SIGNALS, "base_failed", *quality_rules.LEFT, "kept")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word, how many were removed, and a digest of what is left of the text."""
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_lines", "n_removed",
        F.length("left_text").cast("long").alias("n_chars"),
        F.sha2("left_text", 256).alias("left_sha256"),
    )


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query
def op11_pair_heap_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = token_counts.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary)


@query
def op12_grid_cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")
    )


@query
def op13_gram_list_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
