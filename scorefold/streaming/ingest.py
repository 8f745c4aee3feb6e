"""Streaming ingest of append-only response logs.

Every micro-batch writes a folder of its own below the target and then commits it. A commit is a small numbered file that lists the live folders and the last
batch; it is written aside and renamed to the next number, which fails if another writer took that number first - then the commit is made anew on top of the
other one. So readers always see one complete list, a repeated batch changes nothing, and a compaction may run beside the ingest: it replaces the folders it
has read by one, and folders that were added meanwhile stay in the list.

Which row counts for a (model, arm, item) - the first success, else the last failure - is settled when the live folders are read or compacted.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorefold.operators.cohort import dedupe_success, pending_jobs

KEY = ("model", "arm", "item_id")
#: Commits that are kept behind the newest one.
KEEP = 20


class Live:
    """The commits of a target folder, on whatever file system the cluster names it."""

    def __init__(self, spark: SparkSession, target: str):
        jvm, self.spark, self.target = spark._jvm, spark, target
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        self._folder = f"{target}/_live"
        self._fs.mkdirs(self._path(self._folder))

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self._folder))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def read(self) -> dict:
        """version, folders (names below the target) and last_batch of the newest commit."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "folders": [], "last_batch": -1}
        stream = self._fs.open(self._path(f"{self._folder}/{versions[-1]}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {"version": versions[-1], **json.loads(text)}

    def commit(self, change: Callable[[dict], dict]) -> dict:
        """Apply change to the newest commit and publish it; again on top of a newer one if another writer was first."""
        while True:
            now = self.read()
            new = {**change({"folders": list(now["folders"]), "last_batch": now["last_batch"]})}
            aside = self._path(f"{self._folder}/.{uuid.uuid4().hex}")
            out = self._fs.create(aside, False)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            final = self._path(f"{self._folder}/{now['version'] + 1}.json")
            if self._rename(aside, final):
                for v in self._versions()[: -KEEP - 1]:
                    self._fs.delete(self._path(f"{self._folder}/{v}.json"), False)
                return {"version": now["version"] + 1, **new}
            self._fs.delete(aside, False)

    def _rename(self, source, final) -> bool:
        """Rename that never replaces: false if the name is taken."""
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, final, options)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise

    def rows(self) -> DataFrame | None:
        folders = self.read()["folders"]
        return self.spark.read.parquet(*[f"{self.target}/{f}" for f in folders]) if folders else None


def store_batch(target: str) -> Callable[[DataFrame, int], None]:
    """The writer of a micro-batch: its own folder, then the commit. A batch that is already in (also as part of a compaction) is left out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        live = Live(batch.sparkSession, target)
        if batch_id <= live.read()["last_batch"]:
            return
        folder = f"batch-{batch_id}"
        dedupe_success(batch, KEY, "seq", F.col("error").isNotNull()).write.mode("overwrite").parquet(f"{target}/{folder}")
        live.commit(lambda c: c if batch_id <= c["last_batch"] else {"folders": [*c["folders"], folder], "last_batch": batch_id})

    return write


def ingest_responses(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, files_per_batch: int = 1000):
    """Start the ingest over line-JSON files; it stops when the files there are read (``availableNow``)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return rows.writeStream.foreachBatch(store_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """One row per (model, arm, item) over the live folders."""
    rows = Live(spark, target).rows()
    if rows is None:
        raise ValueError(f"nothing was ingested below {target}")
    return dedupe_success(rows, KEY, "seq", F.col("error").isNotNull())


def compact(spark: SparkSession, target: str) -> None:
    """Replace the live folders by one of settled rows. Their files stay on disk for readers that have begun; no later reader opens them."""
    live = Live(spark, target)
    read = set(live.read()["folders"])
    if len(read) < 2:
        return
    folder = f"compact-{uuid.uuid4().hex}"
    rows = spark.read.parquet(*[f"{target}/{f}" for f in sorted(read)])
    dedupe_success(rows, KEY, "seq", F.col("error").isNotNull()).write.parquet(f"{target}/{folder}")
    live.commit(lambda c: {"folders": [folder, *(f for f in c["folders"] if f not in read)], "last_batch": c["last_batch"]} if read <= set(c["folders"]) else c)


def pending(spark: SparkSession, target: str, expected: DataFrame) -> DataFrame:
    """Expected (model, arm, item) without a success yet."""
    return pending_jobs(expected, current(spark, target).where(F.col("error").isNull()), KEY)
