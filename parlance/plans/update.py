"""Rollups that follow new turns without a full rebuild.

Turns, conversations and agents are kept in a bucket store. Beside the rollups it keeps
what agents are summed up from: per conversation and agent, the sum and number of empathy
scores. New turns touch some conversations; only those are rolled up again, from their
buckets alone, and only the agents that they had before or have now are summed again,
from conversation rows and sums rather than from turns.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.scores import empathy_score
from parlance.operators.labelling import require_labelled
from parlance.operators.rollups import agent_rollup_from, conversation_rollup
from parlance.operators.topics import Topics
from parlance.sources.bucket_store import BUCKETS, BucketStore
from parlance.sources.scratch import stored
from parlance.sources.turns import latest_turns

KEYS = {"turns": "conv_id", "conversations": "conv_id", "empathy": "conv_id", "agents": "agent_name"}


def rollup_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(spark, path, KEYS, buckets)


def empathy_sums(turns: DataFrame) -> DataFrame:
    """(conv_id, agent_name, total, n): the empathy scores of each agent in each conversation."""
    score = empathy_score(F.col("empathy_signal"))
    return (
        turns.where("role = 'agent' AND agent_name IS NOT NULL")
        .groupBy("conv_id", "agent_name").agg(F.sum(score).alias("total"), F.count(score).alias("n"))
    )


def update_rollups(store: BucketStore, new: DataFrame, topics: Topics, seq: str | None = None) -> int:
    """Insert or replace labelled turns and bring the rollups up to date; the version published.

    Of several new rows of a turn the one with the highest `seq` counts. All four tables
    are published at once: an update that is lost on the way leaves none of its work, and
    can be run again.
    """
    latest = latest_turns(new, seq)
    fresh = stored(require_labelled(latest.drop(seq) if seq else latest))
    convs = stored(fresh.select("conv_id").distinct())
    touched = store.buckets_of("turns", convs)

    def replaced(table: str, rows: DataFrame, gone: DataFrame, on: list[str], buckets: frozenset[int]):
        before = store.read(table, buckets)
        if before is not None:
            rows = before.join(gone, on, "left_anti").unionByName(rows.select(*before.columns))
        return store.stage(table, rows, None if before is None else buckets)

    turn = ["conv_id", "turn_index"]
    turns = replaced("turns", fresh, fresh.select(*turn), turn, touched)
    again = store.staged_rows(turns).join(convs, "conv_id", "left_semi")
    conversations = replaced("conversations", conversation_rollup(again, topics), convs, ["conv_id"], touched)
    empathy = replaced("empathy", empathy_sums(again), convs, ["conv_id"], touched)

    # Agents of the touched conversations, as they were and as they are.
    sides = [store.staged_rows(conversations), store.staged_rows(empathy)]
    sides += [t for t in (store.read("conversations", touched), store.read("empathy", touched)) if t is not None]
    named = [
        side.join(convs, "conv_id", "left_semi").where("agent_name IS NOT NULL").select("agent_name") for side in sides
    ]
    agents = named[0]
    for side in named[1:]:
        agents = agents.unionByName(side)
    agents = stored(agents.distinct())

    def now(table: str, staged) -> DataFrame:
        """All buckets of a table as they will be: the untouched ones and the staged ones."""
        rows = store.staged_rows(staged)
        others = store.read(table, frozenset(range(store.buckets)) - staged.touched)
        return rows if others is None else others.unionByName(rows.select(*others.columns))

    theirs = [now(*t).join(agents, "agent_name", "left_semi") for t in (("conversations", conversations), ("empathy", empathy))]
    summed = replaced(
        "agents", agent_rollup_from(*theirs), agents, ["agent_name"], store.buckets_of("agents", agents)
    )
    return store.publish(turns, conversations, empathy, summed)
