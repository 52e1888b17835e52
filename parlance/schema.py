"""Column layouts of the tables this package reads and writes."""

from pyspark.sql import types as T

CSV_COLUMNS = (
    "conv_id", "turn_index", "timestamp", "role", "text", "customer_name", "agent_name",
)

LABEL_COLUMNS = (
    "sentiment_label", "sentiment_score", "intent", "empathy_signal", "is_escalation",
    "contains_pii", "language", "text_clean_en", "classified_at",
)

TURNS = T.StructType([
    T.StructField("conv_id", T.StringType(), False),
    T.StructField("turn_index", T.IntegerType(), False),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("role", T.StringType()),
    T.StructField("text_raw", T.StringType()),
    T.StructField("text_clean", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("agent_name", T.StringType()),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("intent", T.StringType()),
    T.StructField("empathy_signal", T.StringType()),
    T.StructField("is_escalation", T.IntegerType()),
    T.StructField("contains_pii", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("text_clean_en", T.StringType()),
    T.StructField("classified_at", T.TimestampType()),
])

# What a labeller returns for each (text_clean, role), before validation.
RAW_LABELS = T.StructType([
    T.StructField("text_clean", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("intent", T.StringType()),
    T.StructField("empathy_signal", T.StringType()),
    T.StructField("is_escalation", T.IntegerType()),
    T.StructField("contains_pii", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("text_en", T.StringType()),
])

# The same, with the error of a batch that got no answer.
ANSWERS = T.StructType([*RAW_LABELS, T.StructField("failure", T.StringType())])

LABELS = T.StructType([
    T.StructField("text_clean", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("intent", T.StringType()),
    T.StructField("empathy_signal", T.StringType()),
    T.StructField("is_escalation", T.IntegerType()),
    T.StructField("contains_pii", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("text_clean_en", T.StringType()),
    T.StructField("classified_at", T.TimestampType()),
    T.StructField("model", T.StringType()),
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("turn_idx", T.LongType(), False),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("expires_at", T.TimestampType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer_json", T.StringType()),
])

# A turn block holds at most this many turn indexes of one conversation. Rows
# that gather turns are keyed by (conv_id, part), so no row grows without bound.
TURN_BLOCK = 4096
