"""Every operator as a query over the driver's whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures as fx
from parlance.functions.openers import extract_slot
from parlance.functions.text import doc_excerpt, redact_pii, truncate_last_terminator
from parlance.operators import (
    cleaning,
    conversations as conv,
    documents,
    labelling,
    profile,
    rollups,
    scoring,
    search,
    sessions,
    topics,
    vectors,
)
from parlance.plans import questions, update
from parlance.plans.build import Asking
from parlance.plans.build import label_pending as label_run
from parlance.schema import LABELS
from parlance.sources import storage
from parlance.sources.turns import latest_turns, read_turns_csv, read_turns_csv_split, upsert_turns

DIGITS = 9
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its function's name."""
    QUERIES[fn.__name__] = fn
    return fn


def query_named(name: str) -> Callable[[Query], Query]:
    """Register a query under a name that an import here already has."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns in types that compare well: long, rounded double, string."""

    def column(field: T.StructField):
        c, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(kind, (T.IntegerType, T.BooleanType)):
            c = c.cast("long")
        elif kind == T.ArrayType(T.StringType()):
            c = F.array_join(c, "|")
        elif kind == T.ArrayType(T.DoubleType()):
            c = F.array_join(F.transform(c, lambda x: F.round(x * 1000).cast("long")), ",")
        elif isinstance(kind, T.ArrayType) and kind.elementType.names[:2] == ["topic", "n"]:
            c = F.array_join(F.transform(c, lambda x: F.concat(x["topic"], F.lit(":"), x["n"])), ",")
        return c.alias(field.name)

    return df.select(*[column(f) for f in df.schema.fields])


def flat_turns(df: DataFrame, *drop: str) -> DataFrame:
    """One row per turn of nested trajectories or transcripts."""
    rest = [c for c in df.columns if c not in ("turns", *drop)]
    return df.select(*rest, F.explode("turns").alias("turn")).select(*rest, "turn.*")


# Sources and sinks.


@query_named("read_turns_csv")
def read_turns(spark, sf):
    path = fx.scratch(spark, "turns-csv")
    turns = fx.chat_turns(spark, sf)
    turns.selectExpr(
        "conv_id", "turn_index", "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss\") AS timestamp",
        "role", "text_raw AS text", "customer_name", "agent_name",
    ).write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return plain(read_turns_csv(spark, path).drop("row_order"))


@query_named("read_turns_csv_split")
def read_turns_in_stretches(spark, sf):
    """Files with line breaks and quotes in fields, cut into stretches."""
    path = fx.scratch(spark, "turns-csv")
    turns = fx.chat_turns(spark, sf)
    turns.selectExpr(
        "conv_id", "turn_index", "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss\") AS timestamp",
        "role", "concat(text_raw, '\\n\"', role, '\",\\n', text_raw) AS text", "customer_name", "agent_name",
    ).write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return plain(read_turns_csv_split(spark, path, 1 << 16).drop("row_order"))


@query_named("latest_turns")
def latest_turns_of_files(spark, sf):
    """Turns in two files, of which the later one counts; a row repeats within a file."""
    path = fx.scratch(spark, "turns-csv")
    turns = fx.chat_turns(spark, sf)
    old = turns.withColumn("text_raw", F.lit("first try."))
    new = turns.withColumn("text_raw", F.explode(F.array(F.lit("then this."), F.col("text_raw"))))
    for name, rows in (("a", old), ("b", new)):
        rows.selectExpr(
            "conv_id", "turn_index", "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss\") AS timestamp",
            "role", "text_raw AS text", "customer_name", "agent_name",
        ).write.csv(f"{path}/{name}", header=True, quote='"', escape='"', quoteAll=True)
    found = latest_turns(read_turns_csv(spark, f"{path}/*"), "row_order")
    return plain(found.select("conv_id", "turn_index", "role", "text_raw"))


@query_named("upsert_turns")
def upserted_turns(spark, sf):
    turns = fx.chat_turns(spark, sf)
    mine = turns.where("role = 'customer'")
    first = mine.withColumn("seq", F.lit(1)).withColumn("text_raw", F.lit("first try."))
    last = mine.withColumn("seq", F.lit(2)).withColumn("text_raw", F.concat("text_raw", F.lit(" again.")))
    late = mine.withColumn("seq", F.lit(3)).withColumn("turn_index", F.col("turn_index") + 100)
    stored = upsert_turns(turns, first.unionByName(last).unionByName(late), "seq")
    return plain(stored.select(
        "conv_id", "turn_index", "role", "text_raw", "sentiment_label", "intent", "classified_at"
    ))


@query
def materialize(spark, sf):
    events = topics.distinct_openers(fx.event_turns(spark, sf))
    chats = topics.distinct_openers(fx.chat_turns(spark, sf))
    kept, rebuilt = fx.scratch(spark, "kept"), fx.scratch(spark, "rebuilt")
    storage.materialize(events, kept)
    skipped = storage.materialize(chats, kept)
    storage.materialize(events, rebuilt)
    forced = storage.materialize(chats, rebuilt, force=True)
    return skipped.withColumn("stage", F.lit("skipped")).unionByName(
        forced.withColumn("stage", F.lit("forced")))


@query
def write_rollups(spark, sf):
    stored, agents = storage.write_rollups(
        fx.chat_conversations(spark, sf), fx.chat_turns(spark, sf), fx.scratch(spark, "rollups"))
    by_month = stored.groupBy(F.date_format("start_ts", "yyyy-MM").alias("part")).agg(
        F.count("*").alias("n"), F.sum("turn_count").alias("total")
    )
    return by_month.unionByName(agents.agg(
        F.lit("agents").alias("part"), F.count("*").alias("n"), F.sum("conv_count").alias("total")
    ))


@query
def taxonomy_tables(spark, sf):
    found = fx.topics(spark)
    slot, _ = extract_slot(F.col("text_clean"))
    seen = fx.chat_turns(spark, sf).where("role = 'customer'").select(slot.alias("slot"))
    counts = seen.where("slot IS NOT NULL").groupBy("slot").agg(F.count("*").alias("n_turns"))
    return (
        found.slots.join(counts, "slot", "left")
        .join(found.categories.withColumnRenamed("id", "category"), "category")
        .select("slot", "category", "label", "description",
                F.coalesce("n_turns", F.lit(0)).alias("n_turns"))
    )


@query
def write_vectors(spark, sf):
    path = fx.scratch(spark, "vectors")
    stored = storage.write_vectors(fx.labelled_vectors(spark, sf), path)
    return plain(stored.groupBy("topic").agg(
        F.count("*").alias("n"), F.sum(F.size("embedding")).alias("n_values"),
        F.max(F.col("conv_id")).alias("last_id"),
    ))


@query
def write_eval_results(spark, sf):
    path = fx.scratch(spark, "eval")
    scored = scoring.score_answers(fx.eval_answers(spark, sf), fx.eval_specs(spark, sf))
    storage.write_eval_results(scored, scoring.eval_summary(scored), path)
    back = spark.read.json(f"{path}/results")
    return plain(back.groupBy("status").agg(
        F.count("*").alias("n"), F.sum(F.size("coverage_missed")).alias("n_missed")
    ))


# Text.


@query_named("truncate_last_terminator")
def truncate_terminator(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select(
        "doc_id", truncate_last_terminator(F.col("text")).alias("text_clean"),
        truncate_last_terminator(F.concat("lang", F.lit(" "), "source")).alias("none_found"),
    )


@query
def gibberish_tokens(spark, sf):
    docs = fx.table(spark, sf, "documents")
    found = cleaning.gibberish_tokens(docs, "text", fx.lexicon(spark, sf), ["doc_id"])
    return plain(found.groupBy("doc_id", "token").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    ))


@query
def strip_gibberish(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    found = cleaning.strip_gibberish(docs, "text", fx.lexicon(spark, sf))
    return found.select("doc_id", "stripped")


@query
def gibberish_ratio(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    found = cleaning.gibberish_ratio(docs, "text", fx.lexicon(spark, sf), threshold=5.5)
    return plain(found.select("doc_id", "gibberish_ratio"))


@query
def clean_turns(spark, sf):
    turns = fx.chat_turns(spark, sf).drop("text_clean")
    found = cleaning.clean_turns(turns, fx.lexicon(spark, sf))
    return plain(found.select("conv_id", "turn_index", "text_clean"))


@query
def cleaning_counts(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("text").alias("text_raw"))
    return cleaning.cleaning_counts(cleaning.clean_turns(docs))


@query_named("extract_slot")
def extracted_slots(spark, sf):
    slot, template = extract_slot(F.col("text_clean"))
    turns = fx.chat_turns(spark, sf).where("role = 'customer'")
    return plain(turns.select("conv_id", "turn_index", slot.alias("slot"),
                              template.alias("template")))


@query
def match_no_slot(spark, sf):
    turns = fx.chat_turns(spark, sf)
    openers = topics.distinct_openers(
        turns.withColumn("text_clean", F.translate("text_clean", "'", "’"))
    )
    return topics.match_no_slot(openers, "text_clean", fx.topics(spark))


@query
def resolve_topic(spark, sf):
    openers = topics.distinct_openers(fx.chat_turns(spark, sf))
    return topics.resolve_topic(openers, "text_clean", fx.topics(spark))


@query
def distinct_openers(spark, sf):
    return topics.distinct_openers(fx.event_turns(spark, sf))


@query
def taxonomy_coverage(spark, sf):
    found = fx.topics(spark)
    extra = fx.customer_topics(spark, sf).slots.where("category IN ('n1', 'n2')")
    widened = topics.Topics(found.categories, found.slots.unionByName(extra), found.openers)
    return topics.taxonomy_coverage(fx.chat_turns(spark, sf), widened)


@query
def category_slot_counts(spark, sf):
    return topics.category_slot_counts(fx.customer_topics(spark, sf))


@query_named("redact_pii")
def redacted_documents(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", redact_pii(F.col("text")).alias("redacted"))


@query_named("doc_excerpt")
def document_excerpts(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", doc_excerpt(F.col("text")).alias("excerpt"))


# Labels.


@query
def pending_texts(spark, sf):
    return labelling.pending_texts(fx.event_turns(spark, sf), fx.event_labels(spark, sf))


@query
def label_texts(spark, sf):
    docs = fx.table(spark, sf, "documents")
    pending = docs.selectExpr(
        "text AS text_clean", "CASE WHEN doc_id % 2 = 0 THEN 'agent' ELSE 'customer' END AS role"
    ).distinct()
    return plain(labelling.label_texts(pending).withColumn("text_clean", F.md5("text_clean")).drop("text_en"))


def number_labeller(calls_to_fail=0):
    """Labels by the number in a text; a task's first calls fail."""
    calls = []

    def by_number(frame):
        calls.append(None)
        if len(calls) <= calls_to_fail:
            raise RuntimeError("busy")
        odd = frame["text_clean"].str.extract(r"(\d+)")[0].astype(int) % 2 == 1
        return frame.assign(
            sentiment_label=odd.map({True: "neg", False: "neu"}), sentiment_score=odd * -1.0,
            intent="other", empathy_signal="na", is_escalation=0, contains_pii=0, language="en",
            text_en=frame["text_clean"],
        )

    return by_number


@query
def label_texts_by_function(spark, sf):
    pending = labelling.pending_texts(fx.event_turns(spark, sf), fx.event_labels(spark, sf))
    return plain(labelling.label_texts(pending, number_labeller(), partitions=4).groupBy(
        "role", "sentiment_label").agg(F.count("*").alias("n")))


@query
def label_pending(spark, sf):
    """A run by chunks, with batches that fail at first, goes on after the rules labelled some texts."""
    path, turns = fx.scratch(spark, "labelling"), fx.event_turns(spark, sf)
    seen = turns.where("text_clean LIKE 'purchase %' OR text_clean LIKE 'error %'")
    label_run(seen, path, fx.LABELLED_AT)
    labels, _ = label_run(
        turns, path, fx.LABELLED_AT, number_labeller(1), asking=Asking(wait=0.0, chunk_rows=5000))
    texts = seen.select("text_clean").distinct()
    return plain(labels.join(texts, "text_clean", "left_anti").groupBy(
        "role", "sentiment_label").agg(F.count("*").alias("n")))


@query
def validate_labels(spark, sf):
    accepted, _ = labelling.validate_labels(fx.document_answers(spark, sf), fx.LABELLED_AT)
    return plain(accepted)


@query
def validate_labels_rejected(spark, sf):
    _, rejected = labelling.validate_labels(fx.document_answers(spark, sf), fx.LABELLED_AT)
    return plain(rejected.select("text_clean", "role", "error"))


@query
def upsert_labels(spark, sf):
    accepted, _ = labelling.validate_labels(fx.document_answers(spark, sf), fx.LABELLED_AT)
    old = accepted.where("role = 'customer'").withColumn("model", F.lit("old"))
    new = accepted.where("intent = 'query' AND language <> 'mixed'")
    return plain(labelling.upsert_labels(old.dropDuplicates(["text_clean"]), new))


@query
def propagate_labels(spark, sf):
    none = spark.createDataFrame([], LABELS)
    labels = storage.materialize(
        labelling.upsert_labels(none, fx.event_labels(spark, sf)), fx.scratch(spark, "labels"))
    labelled = labelling.propagate_labels(fx.unlabelled_event_turns(spark, sf), labels)
    return plain(labelled.select(
        "conv_id", "turn_index", "text_clean", "sentiment_label", "sentiment_score", "intent",
        "empathy_signal", "is_escalation", "contains_pii", "language", "text_clean_en",
        "classified_at",
    ))


@query
def unlabelled_gate(spark, sf):
    found = labelling.unlabelled_gate(fx.unlabelled_event_turns(spark, sf))
    return spark.createDataFrame([(found,)], "n_unlabelled long")


@query
def require_labelled(spark, sf):
    return labelling.require_labelled(fx.event_turns(spark, sf)).groupBy("role").agg(
        F.count("*").alias("n"))


# Rollups.


@query
def conversation_rollup(spark, sf):
    return plain(fx.chat_conversations(spark, sf))


@query
def conversation_rollup_events(spark, sf):
    return plain(fx.event_conversations(spark, sf))


@query
def conversation_rollup_far(spark, sf):
    """The same conversations with turn indexes far apart."""
    turns = fx.chat_turns(spark, sf).withColumn("turn_index", F.col("turn_index") * 70_000)
    return plain(rollups.conversation_rollup(turns, fx.topics(spark)))


@query
def sentiment_trajectory_parts(spark, sf):
    return plain(rollups.sentiment_trajectory_parts(fx.event_turns(spark, sf), block=2))


@query
def agent_rollup(spark, sf):
    return plain(fx.chat_agents(spark, sf))


@query
def agent_rollup_events(spark, sf):
    turns = fx.event_turns(spark, sf)
    return plain(rollups.agent_rollup(rollups.conversation_rollup(turns, fx.topics(spark)), turns))


def updated_store(spark, sf):
    """A store built from a part of the turns, wrong in places, and brought up to date."""
    turns, topics = fx.chat_turns(spark, sf), fx.topics(spark)
    number = F.substring("conv_id", 2, 7).cast("int")
    wrong = turns.withColumns({
        "agent_name": F.when(number % 5 == 0, F.lit("Agent900")).otherwise(F.col("agent_name")),
        "sentiment_score": F.when(number % 7 == 0, F.lit(0.9)).otherwise(F.col("sentiment_score")),
    })
    store = update.rollup_store(spark, fx.scratch(spark, "buckets"), buckets=16)
    update.update_rollups(store, wrong.where((number % 3 != 0) & (F.col("turn_index") < 4)), topics)
    late = turns.where((number % 3 == 0) | (number % 5 == 0) | (number % 7 == 0) | (F.col("turn_index") >= 4))
    update.update_rollups(store, late.withColumn("seq", F.lit(1)).unionByName(
        late.where("turn_index = 5").withColumns({"role": F.lit("system"), "seq": F.lit(0)})), topics, "seq")
    return store


@query
def updated_conversations(spark, sf):
    """Rollups after updates equal those of a rebuild."""
    return plain(updated_store(spark, sf).read("conversations"))


@query
def updated_agents(spark, sf):
    return plain(updated_store(spark, sf).read("agents"))


@query
def updated_turns(spark, sf):
    return plain(updated_store(spark, sf).read("turns").select(
        "conv_id", "turn_index", "role", "agent_name", "sentiment_score", "text_clean"))


# Documents and vectors.


@query
def conversation_document(spark, sf):
    return documents.conversation_document(fx.chat_turns(spark, sf))


@query
def conversation_document_parts(spark, sf):
    return documents.conversation_document(fx.event_turns(spark, sf), block=3)


@query
def majority_language(spark, sf):
    return documents.majority_language(fx.event_turns(spark, sf))


@query
def document_metadata(spark, sf):
    return plain(documents.document_metadata(
        fx.chat_turns(spark, sf), fx.chat_conversations(spark, sf)))


@query
def document_metadata_from_turns(spark, sf):
    return plain(documents.document_metadata(fx.event_turns(spark, sf)))


@query
def vector_documents(spark, sf):
    return plain(fx.chat_documents(spark, sf).select(
        "conv_id", "part", F.length("document").alias("n_chars"), "metadata.topic",
        "metadata.language", "metadata.customer_sentiment_overall"))


@query
def embed_documents(spark, sf):
    docs = vectors.embed_documents(fx.chat_documents(spark, sf))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return plain(docs.select(
        "conv_id", F.size("embedding").alias("dim"), F.round(F.sqrt(squares), 4).alias("norm")))


@query
def embed_documents_far(spark, sf):
    """Vectors of conversations in many parts against those of the same in one part."""
    turns = fx.chat_turns(spark, sf)
    near = documents.vector_documents(turns)
    far = documents.vector_documents(turns.withColumn("turn_index", F.col("turn_index") * 5_000))
    model = vectors.fit_embedder(far)
    one = vectors.embed_documents(near, model).select("conv_id", F.col("embedding").alias("a"))
    many = vectors.embed_documents(far, model).select("conv_id", F.col("embedding").alias("b"))
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return plain(one.join(many, "conv_id", "full").select(
        "conv_id", F.round(product, 4).alias("cosine")))


def letters(texts):
    """Counts of a to z in each text."""
    import numpy as np

    return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts])


@query
def embed_documents_by_function(spark, sf):
    """Vectors of letter counts, from a function over batches of texts."""
    docs = vectors.embed_documents(fx.chat_documents(spark, sf), letters)
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double") * 10_000).cast("long").cast("string"))
    return docs.select("conv_id", F.array_join(rounded, ",").alias("vector"))


@query
def semantic_topk(spark, sf):
    return plain(search.semantic_topk(
        fx.labelled_vectors(spark, sf), fx.label_queries(spark, sf), k=10,
        details=["topic", "escalation_flag"]))


@query
def semantic_topk_filtered(spark, sf):
    return plain(search.semantic_topk(
        fx.labelled_vectors(spark, sf), fx.label_queries(spark, sf), k=5, language="hi",
        escalation=True, sentiment_max=0.2, sentiment_min=-0.4, details=["topic"]))


@query
def semantic_topk_of_documents(spark, sf):
    """The documents whose id is divisible by 50 ask for their neighbours."""
    return plain(search.semantic_topk(fx.labelled_vectors(spark, sf), fx.vector_queries(spark, sf), k=10))


# The vectors of the table have no clusters, so a query's neighbours are spread over many lists.
LISTS, PROBES = 64, 48


def listed_vectors(spark, sf):
    """The vectors in inverted lists, stored by list."""
    docs = fx.labelled_vectors(spark, sf)
    model = search.train_lists(docs, lists=LISTS)
    return storage.write_vectors(search.with_lists(docs, model), fx.scratch(spark, "lists")), model


@query
def semantic_topk_approx(spark, sf):
    docs, model = listed_vectors(spark, sf)
    return plain(search.semantic_topk_approx(docs, fx.vector_queries(spark, sf), model, k=10, probes=PROBES))


@query
def semantic_topk_recall(spark, sf):
    """Does the approximate search find 95 % of the exact hits, and score fewer documents?"""
    docs, model = listed_vectors(spark, sf)
    asked = fx.vector_queries(spark, sf)
    exact = search.semantic_topk(docs, asked, k=10).select("query_id", "conv_id")
    near = search.semantic_topk_approx(docs, asked, model, k=10, probes=PROBES)
    probed = search.probed_lists(docs, asked, model, k=10, probes=PROBES)
    hits = exact.join(near.select("query_id", "conv_id", F.lit(1).alias("hit")), ["query_id", "conv_id"], "left")
    counts = hits.selectExpr("1 AS wanted", "hit", "0 AS scored", "0 AS asked").unionAll(
        probed.selectExpr("0", "0", "rows", "0")).unionAll(
        asked.selectExpr("0", "0", "0", "1"))
    n_docs = docs.count()
    return plain(counts.agg(*(F.sum(c).alias(c) for c in counts.columns)).select(
        F.col("asked").alias("n_queries"), (F.col("hit") >= 0.95 * F.col("wanted")).alias("enough_found"),
        (F.col("scored") < F.col("asked") * n_docs).alias("fewer_scored")))


@query
def semantic_topk_all_cells(spark, sf):
    """The lists are all probed, and no candidate is left out: the exact result."""
    docs, model = listed_vectors(spark, sf)
    return plain(search.semantic_topk_approx(
        docs, fx.label_queries(spark, sf), model, k=10, probes=LISTS, slack=1.0,
        details=["topic", "escalation_flag"]))


@query
def semantic_search_documents(spark, sf):
    """Search of the chat documents for the text of each customer's opening turn."""
    docs = fx.chat_documents(spark, sf)
    model = vectors.fit_embedder(docs)
    stored = storage.write_vectors(
        vectors.embed_documents(docs, model), fx.scratch(spark, "vectors"))
    asked = fx.chat_turns(spark, sf).where("role = 'customer'").groupBy(
        F.col("conv_id").alias("query_id")).agg(F.min_by("text_clean", "turn_index").alias("query"))
    return plain(search.semantic_search(stored, asked, model, k=3, language="en"))


def letter_vectors(spark, sf):
    docs = vectors.embed_documents(fx.chat_documents(spark, sf), letters)
    return storage.write_vectors(docs, fx.scratch(spark, "letters"))


# The function's vectors have single precision, so their similarities are compared to 6 digits.
HIT = ("rank", "conv_id", "round(similarity, 6) AS similarity", "topic", "language")


@query
def app_crashes_in_language(spark, sf):
    hits, _ = questions.app_crashes_in_language(
        letter_vectors(spark, sf), letters, fx.chat_conversations(spark, sf), fx.chat_turns(spark, sf))
    return plain(hits.selectExpr(*HIT))


@query
def app_crashes_transcript(spark, sf):
    _, transcript = questions.app_crashes_in_language(
        letter_vectors(spark, sf), letters, fx.chat_conversations(spark, sf), fx.chat_turns(spark, sf))
    return plain(transcript.select("conv_id", "topic", F.size("turns").alias("n_turns")))


@query
def billing_and_refund_problems(spark, sf):
    return plain(questions.billing_and_refund_problems(letter_vectors(spark, sf), letters).selectExpr(*HIT))


@query
def frustrated_after_escalation(spark, sf):
    return plain(questions.frustrated_after_escalation(
        letter_vectors(spark, sf), letters, fx.chat_conversations(spark, sf)).selectExpr(*HIT))


# Queries.


@query
def filter_conversations(spark, sf):
    return plain(conv.filter_conversations(
        fx.chat_conversations(spark, sf), fx.chat_turns(spark, sf), date_from="2025-08-15",
        date_to="2025-11-30", sentiment_min=-0.6, sentiment_max=0.4, escalation=False,
        language="hi").select("conv_id", "start_ts", "topic", "customer_sentiment_overall"))


@query
def filter_conversations_by_agent(spark, sf):
    return plain(conv.filter_conversations(
        fx.event_conversations(spark, sf), month="2024-01", agent="Agent007", resolution=True,
        topic="unknown").select("conv_id", "start_ts", "agent_name", "resolution_flag"))


@query
def list_conversations(spark, sf):
    return plain(conv.list_conversations(
        fx.chat_conversations(spark, sf), "customer_sentiment_overall", "asc", 50))


@query
def list_conversations_by_start(spark, sf):
    return plain(conv.list_conversations(fx.event_conversations(spark, sf), "no_such_column",
                                         limit=100))


ALL_METRICS = ("count", "avg_sentiment", "avg_empathy", "escalation_rate", "resolution_rate")


@query
def aggregate_conversations(spark, sf):
    return plain(conv.aggregate_conversations(
        fx.chat_conversations(spark, sf), "topic", ALL_METRICS, round_digits=DIGITS, limit=100))


@query
def aggregate_conversations_by_agent(spark, sf):
    return plain(conv.aggregate_conversations(
        fx.event_conversations(spark, sf), "agent_name", ("resolution_rate", "count"),
        order_by="count", order="asc", round_digits=DIGITS, limit=20))


@query
def aggregate_conversations_by_month(spark, sf):
    return plain(conv.aggregate_conversations(
        fx.chat_conversations(spark, sf), "month", ("avg_sentiment", "avg_empathy"),
        order_by="avg_empathy", round_digits=DIGITS))


@query
def aggregate_conversations_by_language(spark, sf):
    return plain(conv.aggregate_conversations(
        fx.event_conversations(spark, sf), "language", ("count", "avg_sentiment"),
        round_digits=DIGITS, turns=fx.event_turns(spark, sf)))


@query
def rank_agents(spark, sf):
    return plain(conv.rank_agents(fx.chat_agents(spark, sf), 3, "resolution_rate", "desc", 15))


@query
def conversation_trajectory(spark, sf):
    found = conv.conversation_trajectory(
        fx.chat_conversations(spark, sf), fx.chat_turns(spark, sf))
    return plain(flat_turns(plain_arc(found)))


def plain_arc(df):
    arc = F.transform("customer_arc", lambda x: F.round(x * 1000).cast("long"))
    return df.withColumn("customer_arc", F.array_join(arc, ","))


@query
def conversation_transcript(spark, sf):
    return plain(flat_turns(conv.conversation_transcript(
        fx.chat_conversations(spark, sf), fx.chat_turns(spark, sf))))


@query
def conversation_transcript_translated(spark, sf):
    turns = fx.event_turns(spark, sf)
    found = conv.conversation_transcript(
        rollups.conversation_rollup(turns, fx.topics(spark)), turns, include_translation=True)
    return plain(flat_turns(found).select(
        "conv_id", "agent_name", "turn_index", "text_clean", "text_clean_en", "language"))


@query
def topic_counts(spark, sf):
    return conv.topic_counts(fx.chat_conversations(spark, sf), fx.topics(spark))


@query
def topic_example(spark, sf):
    return conv.topic_example(fx.chat_conversations(spark, sf))


@query
def list_topics(spark, sf):
    return conv.list_topics(fx.chat_conversations(spark, sf), fx.topics(spark), True)


# Analyst questions.


@query
def top_negative_topics_in_month(spark, sf):
    return plain(questions.top_negative_topics_in_month(
        fx.chat_conversations(spark, sf), "2025-11", round_digits=DIGITS))


@query
def highest_escalation_topic(spark, sf):
    return plain(questions.highest_escalation_topic(fx.chat_conversations(spark, sf), DIGITS))


@query
def resolved_vs_unresolved(spark, sf):
    return plain(questions.resolved_vs_unresolved(fx.event_conversations(spark, sf)))


@query
def low_empathy_agents_with_quote(spark, sf):
    return plain(questions.low_empathy_agents_with_quote(
        fx.chat_agents(spark, sf), fx.chat_turns(spark, sf), min_conv_count=2))


@query
def compare_agents(spark, sf):
    return plain(questions.compare_agents(fx.chat_agents(spark, sf), ["Agent007", "Agent014"]))


@query
def sentiment_arc(spark, sf):
    return plain(questions.sentiment_arc(fx.chat_conversations(spark, sf), fx.chat_turns(spark, sf)))


@query
def sentiment_inflections(spark, sf):
    return plain(questions.sentiment_inflections(fx.event_turns(spark, sf)))


@query
def severity_ranking_with_example(spark, sf):
    return plain(questions.severity_ranking_with_example(fx.chat_conversations(spark, sf), DIGITS))


@query
def high_volume_low_resolution(spark, sf):
    return plain(questions.high_volume_low_resolution(fx.chat_conversations(spark, sf), DIGITS))


@query
def urgent_turns_by_language(spark, sf):
    return plain(questions.urgent_turns_by_language(fx.chat_turns(spark, sf), "hi"))


@query
def agent_drilldown(spark, sf):
    turns = fx.chat_turns(spark, sf)
    rolled = rollups.conversation_rollup(turns, fx.topics(spark))
    found = questions.agent_drilldown(
        rollups.agent_rollup(rolled, turns), rolled, turns, ["Agent007"])
    return plain(flat_turns(found).select(
        "agent_name", "conv_count", "empathy_mean", "conv_id", "turn_index", "role", "text_clean"))


@query
def escalated_not_resolved(spark, sf):
    return plain(questions.escalated_not_resolved(
        fx.chat_conversations(spark, sf), fx.chat_turns(spark, sf), "billing_refunds"))


# Sessions.


@query
def append_sessions(spark, sf):
    stored = sessions.append_sessions(
        fx.session_history(spark, sf), fx.session_news(spark, sf), fx.NOW, 48)
    return plain(stored.select(
        "session_id", "turn_idx", "created_at", "expires_at", "question",
        F.get_json_object("answer_json", "$.answer").alias("answer"),
        F.get_json_object("answer_json", "$.evidence[0]").alias("evidence"),
        F.when(F.try_parse_json("answer_json").isNull(), F.col("answer_json")).alias("broken"),
    ))


@query
def purge_expired(spark, sf):
    return plain(sessions.purge_expired(fx.session_history(spark, sf), fx.NOW).select(
        "session_id", "turn_idx", "expires_at", "question"))


@query
def recent_turns(spark, sf):
    found = sessions.recent_turns(fx.session_history(spark, sf), fx.NOW, n=5)
    return found.select(
        "session_id", "turn_idx", "question",
        F.get_json_object("answer_json", "$.answer").alias("answer"))


# Evaluation.


def scored_answers(spark, sf):
    return scoring.score_answers(fx.eval_answers(spark, sf), fx.eval_specs(spark, sf))


@query
def tool_selection(spark, sf):
    asked = fx.eval_answers(spark, sf).join(fx.eval_specs(spark, sf), "id")
    return plain(scoring.tool_selection(asked).select("id", "tool_selection_pass"))


@query
def keyword_coverage(spark, sf):
    asked = fx.eval_answers(spark, sf).join(fx.eval_specs(spark, sf), "id")
    return plain(scoring.keyword_coverage(asked).select(
        "id", "coverage", "coverage_matched", "coverage_missed"))


@query
def evidence_pass(spark, sf):
    asked = fx.eval_answers(spark, sf).join(fx.eval_specs(spark, sf), "id")
    return plain(scoring.evidence_pass(asked).select("id", "evidence_pass"))


@query
def eval_status(spark, sf):
    return plain(scored_answers(spark, sf).select(
        "id", "tool_selection_pass", "coverage", "evidence_pass", "status", "latency_s"))


@query
def eval_summary(spark, sf):
    return plain(scoring.eval_summary(scored_answers(spark, sf)))


@query
def pass_rate_by_category(spark, sf):
    return plain(scoring.pass_rate_by(scored_answers(spark, sf), "category"))


@query
def pass_rate_by_language(spark, sf):
    return plain(scoring.pass_rate_by(scored_answers(spark, sf), "language"))


# Profile.


@query
def table_counts(spark, sf):
    return profile.table_counts(fx.event_turns(spark, sf), fx.event_conversations(spark, sf))


@query
def label_distribution(spark, sf):
    return profile.label_distribution(fx.unlabelled_event_turns(spark, sf))


@query
def agent_empathy_distribution(spark, sf):
    return profile.agent_empathy_distribution(fx.event_turns(spark, sf))


@query
def date_range(spark, sf):
    return plain(profile.date_range(fx.chat_conversations(spark, sf)))


@query
def agents_by_conv_count(spark, sf):
    return profile.agents_by_conv_count(fx.event_turns(spark, sf))
