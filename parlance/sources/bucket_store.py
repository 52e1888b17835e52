"""Tables in hash buckets of a key, under one manifest.

A bucket of a table is a folder of files. The manifest says which folder holds each
bucket; it is a table of its own, of which the highest version counts, and a version
is one file. An update writes new folders for the buckets that it touches, for as many
tables as it needs, and then the next version of the manifest: readers see all of an
update or nothing of it. Folders that no manifest names are leftovers of lost updates.

There is one writer at a time. A manifest has one row for each bucket of each table,
so reading it at the driver is bounded by the number of buckets.
"""

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
MANIFEST = "version long, table string, bucket int, folder string, schema string"


@dataclass(frozen=True)
class Staged:
    """Buckets of a table that are written and not yet published."""

    table: str
    folder: str
    touched: frozenset[int]
    filled: frozenset[int]
    schema: str


@dataclass(frozen=True)
class BucketStore:
    """`keys` gives the key column of each table."""

    spark: SparkSession
    path: str
    keys: dict[str, str]
    buckets: int = BUCKETS

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(self.keys[table]), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The version that is published; 0 before the first."""
        return max((r["version"] for r in self._manifest()), default=0)

    def _manifest(self) -> list:
        """The rows of the highest version, which are no more than there are buckets in all."""
        try:
            manifests = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        top = manifests.orderBy(F.desc("version")).limit(self.buckets * len(self.keys)).collect()
        return [r for r in top if r["version"] == top[0]["version"]]

    def buckets_of(self, table: str, rows: DataFrame) -> frozenset[int]:
        """The buckets that some rows, or keys, of a table belong to."""
        return frozenset(r[0] for r in rows.select(self.bucket(table)).distinct().collect())

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The published rows of a table, or of some of its buckets; None if it was never written."""
        entries = [r for r in self._manifest() if r["table"] == table]
        if not entries:
            return None
        wanted = None if buckets is None else frozenset(buckets)
        folders = sorted(
            f"{self.path}/data/{r['folder']}/_bucket={r['bucket']}" for r in entries
            if r["folder"] is not None and (wanted is None or r["bucket"] in wanted)
        )
        return self._files(entries[0]["schema"], folders)

    def _files(self, schema: str, folders: list[str]) -> DataFrame:
        kinds = T.StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*folders)

    def read_keys(self, table: str, keys: DataFrame) -> DataFrame | None:
        """The rows of some keys, from their buckets only."""
        found = self.read(table, self.buckets_of(table, keys))
        key = self.keys[table]
        return found if found is None else found.join(keys.select(key).distinct(), key, "left_semi")

    def stage(self, table: str, rows: DataFrame, touched: Iterable[int] | None = None) -> Staged:
        """Write the rows that the touched buckets shall hold (all buckets if not given).

        Files are sized by an adaptive rebalance, which also splits a bucket with a hot
        key; they are sorted by key, so their statistics tell where a key is.
        """
        folder = f"{table}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self.bucket(table)).hint("rebalance", "_bucket")
        dealt.sortWithinPartitions("_bucket", self.keys[table]).write.partitionBy("_bucket").parquet(
            f"{self.path}/data/{folder}"
        )
        written = self.spark.read.schema("_bucket int").parquet(f"{self.path}/data/{folder}")
        filled = frozenset(r[0] for r in written.select("_bucket").distinct().collect())
        every = frozenset(range(self.buckets)) if touched is None else frozenset(touched)
        return Staged(table, folder, every, filled, rows.schema.json())

    def staged_rows(self, staged: Staged) -> DataFrame:
        folders = [f"{self.path}/data/{staged.folder}/_bucket={b}" for b in sorted(staged.filled)]
        return self._files(staged.schema, folders)

    def publish(self, *staged: Staged) -> int:
        """Make staged buckets of any tables the ones that count, all at once."""
        published = self._manifest()
        held = {(r["table"], r["bucket"]): (r["folder"], r["schema"]) for r in published}
        for s in staged:
            for b in s.touched:
                held[s.table, b] = (s.folder if b in s.filled else None, s.schema)
        version = max((r["version"] for r in published), default=0) + 1
        rows = [(version, table, b, folder, schema) for (table, b), (folder, schema) in sorted(held.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return version

