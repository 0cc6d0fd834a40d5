"""Orphan references: records whose target is absent, withdrawn or came later.

The tracker keeps, per relation:

* ``pending``: the references that are orphans now, the only state that is rewritten;
* runs: for each batch the records and the parents it brought, folded and written once. A
  run holds ``(record_id, first_at, last_at, swept, pkey)`` or, for parents, ``(pkey,
  first_at, last_at, swept)``; older runs are read by key and never rewritten.

In each batch new or changed references probe the parents, arriving parents resolve the
references that wait for them, and withdrawals reopen them: only records of the batch and
records that refer to its parents are looked at, found in older runs by semi-joins on the
batch's keys. All others keep their place in or out of ``pending``. Folding is associative
and commutative, so any cut of the history into batches ends in the same state.
``snapshot`` counts the open cases.

Defined results: null or blank parts of a reference make it no reference; rows without
``ingested_at`` or without an id are not records and are ignored;
rows of one record with equal ``ingested_at`` are ordered by (withdrawn last, reference)
so that the outcome does not depend on input order; empty tables give no cases; extra
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators.skew import hot_keys, salted_left_join
from quaestor.runtime import table, written

ABSENT, WITHDRAWN, LATE = "absent", "withdrawn", "late"


def joined_key(*parts: Column) -> Column:
    """One string from the parts of a reference; null if any part is null or blank."""
    usable = [F.when(F.trim(p.cast("string")) != "", p.cast("string")) for p in parts]
    missing = usable[0].isNull()
    for p in usable[1:]:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat_ws("\x1f", *usable))


def organisation(col: Column) -> Column:
    """``org_acronyme`` as it is compared: without case and outer blanks."""
    return F.upper(F.trim(col))


@dataclass(frozen=True)
class Relation:
    """A child table that refers to a parent table by key expressions."""

    name: str
    record_id: Column
    reference: Column
    parent_key: Column


def fold_children(rows: DataFrame, relation: Relation) -> DataFrame:
    """One row per record of a batch: arrival, and the fields of its current row."""
    newest = F.struct(
        F.col("ingested_at").alias("last_at"),
        F.col("swept_at").isNotNull().alias("swept"),
        F.coalesce(relation.reference, F.lit("")).alias("ref"),
    )
    return (
        rows.where(relation.record_id.isNotNull() & F.col("ingested_at").isNotNull())
        .groupBy(relation.record_id.alias("record_id"))
        .agg(F.min("ingested_at").alias("first_at"), F.max(newest).alias("cur"))
        .select("record_id", "first_at", "cur.last_at", "cur.swept", F.expr("nullif(cur.ref, '')").alias("pkey"))
    )


def fold_parents(rows: DataFrame, relation: Relation) -> DataFrame:
    """One row per parent key of a batch: first arrival and the state of the newest row."""
    newest = F.struct(F.col("ingested_at").alias("last_at"), F.col("swept_at").isNotNull().alias("swept"))
    return (
        rows.select(relation.parent_key.alias("pkey"), "ingested_at", "swept_at")
        .where(F.col("pkey").isNotNull() & F.col("ingested_at").isNotNull())
        .groupBy("pkey")
        .agg(F.min("ingested_at").alias("first_at"), F.max(newest).alias("cur"))
        .select("pkey", "first_at", "cur.last_at", "cur.swept")
    )


def _together(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def _merge_parents(runs: DataFrame) -> DataFrame:
    return (
        runs.groupBy("pkey")
        .agg(F.min("first_at").alias("first_at"), F.max(F.struct("last_at", "swept")).alias("cur"))
        .select("pkey", "first_at", "cur.last_at", "cur.swept")
    )


def _merge_children(runs: DataFrame) -> DataFrame:
    pick = F.max(F.struct("last_at", "swept", F.coalesce("pkey", F.lit("")).alias("ref")))
    return (
        runs.groupBy("record_id")
        .agg(F.min("first_at").alias("first_at"), pick.alias("cur"))
        .select("record_id", "first_at", "cur.last_at", "cur.swept", F.expr("nullif(cur.ref, '')").alias("pkey"))
    )


def _orphans(children: DataFrame, parents: DataFrame, hot: list[str]) -> DataFrame:
    """(record_id, first_at, status) of the references that have no valid target; hot parents are split."""
    index = parents.select("pkey", F.col("first_at").alias("_p_first"), F.col("swept").alias("_p_swept"))
    referring = children.where(~F.col("swept") & F.col("pkey").isNotNull())
    joined = salted_left_join(referring, index, "pkey", "record_id", hot)
    status = (
        F.when(F.col("_p_first").isNull(), F.lit(ABSENT))
        .when(F.col("_p_swept"), F.lit(WITHDRAWN))
        .when(F.col("_p_first") > F.col("first_at"), F.lit(LATE))
    )
    return joined.select("record_id", "first_at", status.alias("status")).where(F.col("status").isNotNull())


class OrphanTracker:
    """Pending-orphan state of one relation, advanced batch by batch."""

    def __init__(self, relation: Relation):
        self.relation = relation
        self.records: list[DataFrame] = []
        self.parents: list[DataFrame] = []
        self.pending: DataFrame | None = None
        self.hot: set[str] = set()
        self.batches = 0

    def advance(self, child_rows: DataFrame, parent_rows: DataFrame) -> "OrphanTracker":
        """Fold one batch in; what it brought and the new pending state go to the shared folder."""
        fresh = written(fold_children(child_rows, self.relation))
        arrived = written(fold_parents(parent_rows, self.relation))
        self.hot |= set(hot_keys(fresh, "pkey"))
        if self.pending is None:
            self.pending = written(_orphans(fresh, arrived, sorted(self.hot)))
        else:
            known = _together(self.records)
            waiting = known.join(arrived.select("pkey"), "pkey", "left_semi").select("record_id")
            touched = written(fresh.select("record_id").unionByName(waiting).distinct())
            current = written(_merge_children(known.join(touched, "record_id", "left_semi").unionByName(fresh)))
            wanted = current.select("pkey").where(F.col("pkey").isNotNull()).distinct()
            index = _merge_parents(_together([*self.parents, arrived]).join(wanted, "pkey", "left_semi"))
            kept = self.pending.join(touched, "record_id", "left_anti")
            self.pending = written(kept.unionByName(_orphans(current, index, sorted(self.hot))))
        self.records.append(fresh)
        self.parents.append(arrived)
        self.batches += 1
        return self

    def cases(self) -> DataFrame:
        """Open cases: current references, not withdrawn themselves, that have no valid target."""
        return self.pending.select(
            F.lit(self.relation.name).alias("table_name"),
            "record_id",
            F.date_format(F.to_utc_timestamp("first_at", F.current_timezone()), "yyyy-MM").alias("period"),
            "status",
        )

    def snapshot(self) -> DataFrame:
        """Counts of open cases per table, period and reason."""
        return self.cases().groupBy("table_name", "period", "status").agg(F.count("*").alias("orphans"))


def document_relations() -> tuple[Relation, Relation]:
    """Files to offer documents, and offer documents to offers."""
    offer_key = joined_key(F.col("consultation_id"), organisation(F.col("org_acronyme")))
    files = Relation("offer_files", F.col("id"), F.col("offer_document_id").cast("string"), F.col("id").cast("string"))
    documents = Relation("offer_documents", F.col("id"), offer_key, offer_key)
    return files, documents


def _slices(rows: DataFrame, cuts: list[str]) -> Iterable[DataFrame]:
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = rows
        if lo is not None:
            part = part.where(F.col("ingested_at") >= F.to_timestamp(F.lit(lo)))
        if hi is not None:
            part = part.where(F.col("ingested_at") < F.to_timestamp(F.lit(hi)))
        yield part


def track_documents(spark: SparkSession, root: str, cuts: list[str] | None = None) -> Iterable[OrphanTracker]:
    """Both relations of ``root`` folded in batches cut at the instants ``cuts`` (UTC).

    Yields the tracker of a relation after each of its batches; ``tracker.batches`` counts them.
    """
    child_cols = ["id", "ingested_at", "swept_at"]
    tables = {
        "offers": table(spark, root, "offers").select("consultation_id", "org_acronyme", "ingested_at", "swept_at"),
        "offer_documents": table(spark, root, "offer_documents").select("consultation_id", "org_acronyme", *child_cols),
        "offer_files": table(spark, root, "offer_files").select("offer_document_id", *child_cols),
    }
    files, documents = document_relations()
    cuts = cuts or []
    for relation, child, parent in ((files, "offer_files", "offer_documents"), (documents, "offer_documents", "offers")):
        tracker = OrphanTracker(relation)
        for children, parents in zip(_slices(tables[child], cuts), _slices(tables[parent], cuts)):
            yield tracker.advance(children, parents)


#: The history is folded in two batches: an initial load and what came after it.
HISTORY_CUTS = ["2025-07-01T00:00:00Z"]


def orphan_references(spark: SparkSession, root: str, cuts: list[str] | None = None) -> DataFrame:
    """Every orphan reference as (table_name, record_id, period)."""
    cuts = HISTORY_CUTS if cuts is None else cuts
    done = [t for t in track_documents(spark, root, cuts) if t.batches == len(cuts) + 1]
    first, second = (t.cases().select("table_name", "record_id", "period") for t in done)
    return first.unionByName(second)


def orphan_snapshots(spark: SparkSession, root: str, cuts: list[str] | None = None) -> DataFrame:
    """Counts per table, period and reason after each batch (``batch`` from 1)."""
    out = None
    for t in track_documents(spark, root, HISTORY_CUTS if cuts is None else cuts):
        part = t.snapshot().select(F.lit(t.batches).alias("batch"), "table_name", "period", "status", "orphans")
        out = part if out is None else out.unionByName(part)
    return out
