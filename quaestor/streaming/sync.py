"""Periodic snapshot sync as a stream: every micro-batch is upserted into a versioned snapshot.

Offers arrive as files; each run takes what is new (``availableNow``), upserts it batch by
batch and writes the new snapshot beside the old one, so readers see whole versions only. A
batch that is run again after a failure finds its version written and skips it.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators.cdc import newest_per_key, upsert
from quaestor.runtime import checkpoint_dir

KEYS = ["consultation_id", "org_acronyme"]
COLUMNS = [*KEYS, "objet", "categorie", "date_limite", "first_seen_at", "ingested_at", "swept_at"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def sync_offers(spark: SparkSession, source: str, target: str, files_per_batch: int = 4) -> DataFrame:
    """Sync the Parquet files that match ``source`` into ``target``; returns the newest snapshot."""
    schema = spark.read.parquet(source).schema
    spark.conf.set("spark.sql.streaming.schemaInference", "false")
    latest = {"version": -1}

    def apply(batch: DataFrame, number: int) -> None:
        path = f"{target}/v{number}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            rows = newest_per_key(batch.select(*COLUMNS), KEYS, ["ingested_at", "objet"])
            before = f"{target}/v{number - 1}"
            if number > 0 and _exists(spark, before):
                rows = upsert(spark.read.parquet(before), rows, KEYS, ["first_seen_at"])
            # withdrawn offers stay as marks, so that an older delivery met later cannot bring them back
            rows.write.mode("overwrite").parquet(path)
        latest["version"] = number

    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{target}/_progress")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    if latest["version"] < 0:  # nothing new: the newest version on record
        known = 0
        while _exists(spark, f"{target}/v{known + 1}/_SUCCESS"):
            known += 1
        latest["version"] = known
    return spark.read.parquet(f"{target}/v{latest['version']}")


def ready(spark: SparkSession, target: str) -> bool:
    """Whether a first whole snapshot is there to be read."""
    return _exists(spark, f"{target}/v0/_SUCCESS")


def sync_periodically(spark: SparkSession, source: str, target: str, interval: float, rounds: int | None = None, report: Callable[[Exception], None] = print) -> None:
    """Sync again and again, each time ``interval`` seconds after the last sync ended, so that late rounds do not pile up.

    A round that fails is reported and tried again with the next one; ``rounds`` ends the loop.
    """
    done = 0
    while rounds is None or done < rounds:
        try:
            sync_offers(spark, source, target)
        except Exception as problem:  # noqa: BLE001
            report(problem)
        done += 1
        if rounds is None or done < rounds:
            time.sleep(interval)


def sync_stream(spark: SparkSession, root: str) -> DataFrame:
    """The offers of ``root`` synced from scratch into the shared folder, without those withdrawn since."""
    import uuid

    target = os.path.join(checkpoint_dir(spark), f"sync-{uuid.uuid4().hex}")
    return sync_offers(spark, os.path.join(root, "offer[s].parquet"), target).where("swept_at IS NULL").select(*KEYS, F.col("objet"), F.col("date_limite"))
