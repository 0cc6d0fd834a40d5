"""Snapshots and changes: upsert, sweep, hash-diff, cascade, retention. All joins are equi-joins on keys.

Snapshots are immutable: each operator returns the new one, to be written beside the old.
Null key parts are matched null-safely, so a null key is one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; an aggregate that combines map-side, no window."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*rows.columns)


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], preserved: list[str]) -> DataFrame:
    """Old snapshot with the batch's rows put in; ``preserved`` columns keep their first value.

    All other columns are overwritten even by nulls, as a delivery states them.
    """
    o, n = old.alias("o"), batch.alias("n")
    present = F.coalesce(F.col("n._in"), F.lit(False))
    on = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    joined = old.withColumn("_in", F.lit(True)).alias("o").join(batch.withColumn("_in", F.lit(True)).alias("n"), on, "full_outer")

    def pick(c: str) -> Column:
        mine, theirs = F.col(f"n.{c}"), F.col(f"o.{c}")
        if c in preserved:
            return F.when(F.col("o._in"), theirs).otherwise(mine).alias(c)
        return F.when(present, mine).otherwise(theirs).alias(c)

    return joined.select(*[pick(c) for c in old.columns])


def sweep(snapshot: DataFrame, run: Column | str, column: str = "last_seen_run_id") -> DataFrame:
    """Rows last seen by the completed run; null marks are swept."""
    value = F.lit(run) if isinstance(run, str) else run
    return snapshot.where(F.col(column).eqNullSafe(value))


def diff_actions(current: DataFrame, index: DataFrame, keys: list[str], hash_column: str = "hash") -> DataFrame:
    """(keys, action): insert, update, skip or delete, by comparing hashes."""
    c = current.select(*keys, F.col(hash_column).alias("_new"), F.lit(True).alias("_c"))
    i = index.select(*[F.col(k).alias(f"_i_{k}") for k in keys], F.col(hash_column).alias("_old"), F.lit(True).alias("_i"))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_i_{k}")) for k in keys))
    action = (
        F.when(F.col("_i").isNull(), "insert")
        .when(F.col("_c").isNull(), "delete")
        .when(F.col("_new").eqNullSafe(F.col("_old")), "skip")
        .otherwise("update")
    )
    return c.join(i, on, "full_outer").select(
        *[F.when(F.col("_c").isNotNull(), F.col(k)).otherwise(F.col(f"_i_{k}")).alias(k) for k in keys], action.alias("action")
    )


def stale(known: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Known keys that are active no more."""
    return known.select(*keys).distinct().join(active.select(*keys).distinct(), keys, "left_anti")


def cascade(children: DataFrame, survivors: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose parent survived."""
    return children.join(survivors.select(*keys).distinct(), keys, "left_semi")


def replace_partition(rows: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with every partition that the batch touches replaced by the batch's rows."""
    return rows.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def retain(rows: DataFrame, group: list[str], newest: int, order: list[Column], expired: Column) -> DataFrame:
    """The newest rows of each group that are not expired."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.where(~F.coalesce(expired, F.lit(False))).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= newest).drop("_rank")


def pruned(rows: DataFrame, key: str, created: str, finished: str, oldest: Column, newest: int) -> DataFrame:
    """Rows without finished ones that ended before ``oldest`` or are not among the ``newest`` created.

    The newest are told by a limited sort, so no window over all rows is planned; ties go to the lower key.
    """
    kept = rows.orderBy(F.desc(created), key).limit(newest).select(F.col(key).alias("_kept"))
    marked = rows.join(F.broadcast(kept), F.col(key) == F.col("_kept"), "left")  # at most ``newest`` keys
    stale = F.col(finished).isNotNull() & ((F.col(finished) < oldest) | F.col("_kept").isNull())
    return marked.where(~stale).drop("_kept")


def retry_due(attempted: Column, error: Column, now: str, wait_seconds: int = 900) -> Column:
    """Never attempted, or no error recorded, or the last attempt is long enough ago."""
    at = F.try_to_timestamp(attempted, F.lit("yyyy-MM-dd HH:mm:ss"))
    return at.isNull() | error.isNull() | (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(at) >= wait_seconds)


def fresh(checked: Column, now: str, ttl_seconds: int = 21600) -> Column:
    """Checked less than the time to live ago; unreadable stamps are stale."""
    at = F.try_to_timestamp(checked, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(at) < ttl_seconds, F.lit(False))


def applied(index: DataFrame, current: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """The index after the actions: deleted and updated rows go, inserted and updated ones come from ``current``."""
    chosen = actions.select(*[F.col(k).alias(f"_a_{k}") for k in keys], "action")

    def of(rows: DataFrame, wanted: list[str]) -> DataFrame:
        on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_a_{k}")) for k in keys))
        return rows.join(chosen.where(F.col("action").isin(*wanted)), on, "left_semi")

    return of(index, ["skip"]).unionByName(of(current, ["insert", "update"]))


#: States of a run that is gone on with; any other begins anew.
RESUMED = ("running", "failed", "paused")


def resumed(states: DataFrame, new_run: Column) -> DataFrame:
    """(run_id, last_page, status) to go on with: an unfinished run after its last whole page, else a new one from the start."""
    goes_on = F.coalesce(F.col("status").isin(*RESUMED), F.lit(False)) & F.col("run_id").isNotNull()
    return states.select(
        *[c for c in states.columns if c not in ("run_id", "last_page", "status")],
        F.when(goes_on, F.col("run_id")).otherwise(new_run).alias("run_id"),
        F.when(goes_on, F.coalesce("last_page", F.lit(0))).otherwise(0).alias("last_page"),
        F.lit("running").alias("status"),
    )
