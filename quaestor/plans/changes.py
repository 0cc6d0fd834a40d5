"""Queries of the snapshot and change operators on the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.ids import content_hash
from quaestor.operators import cdc
from quaestor.runtime import table

CUT, NOW = "2025-07-01 00:00:00", "2026-01-15 12:00:00"
KEY = ["consultation_id", "org_acronyme"]
FIELDS = ["objet", "categorie", "lieu_execution", "date_limite", "last_seen_run_id", "first_seen_at"]


def _snapshot(spark: SparkSession, root: str, late: bool | None) -> DataFrame:
    rows = table(spark, root, "offers").select(*KEY, *FIELDS, "ingested_at", "offer_row", "swept_at")
    if late is not None:
        rows = rows.where(F.col("ingested_at") >= F.lit(CUT).cast("timestamp") if late else F.col("ingested_at") < F.lit(CUT).cast("timestamp"))
    return cdc.newest_per_key(rows, KEY, ["ingested_at", "offer_row"])


def upsert_snapshot(spark: SparkSession, root: str) -> DataFrame:
    old, new = (_snapshot(spark, root, late).select(*KEY, *FIELDS) for late in (False, True))
    return cdc.upsert(old, new, KEY, ["first_seen_at"])


def mark_and_sweep(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot after the run that delivered last has completed: what it did not see is gone."""
    snapshot = upsert_snapshot(spark, root)
    # run ids say nothing of their order
    last = table(spark, root, "offers").agg(F.max_by("last_seen_run_id", F.struct("ingested_at", "last_seen_run_id")).alias("run"))
    return cdc.sweep(snapshot, last.select("run").scalar()).select(*KEY, "last_seen_run_id")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, content_hash(F.col("objet"), F.col("categorie"), F.col("lieu_execution"), F.col("date_limite")).alias("hash"))


def hash_diff_sync(spark: SparkSession, root: str) -> DataFrame:
    now = _snapshot(spark, root, None).where("swept_at IS NULL AND trim(objet) <> ''")
    return cdc.diff_actions(_hashed(now), _hashed(_snapshot(spark, root, False)), KEY)


def sync_counts(spark: SparkSession, root: str) -> DataFrame:
    return hash_diff_sync(spark, root).groupBy("action").agg(F.count("*").alias("n"))


def stale_ids(spark: SparkSession, root: str) -> DataFrame:
    return cdc.stale(_snapshot(spark, root, False), _snapshot(spark, root, None).where("swept_at IS NULL"), KEY)


def cascade_delete(spark: SparkSession, root: str) -> DataFrame:
    alive = _snapshot(spark, root, None).where("swept_at IS NULL")
    documents = cdc.cascade(table(spark, root, "offer_documents").select("id", *KEY).distinct(), alive, KEY)
    files = table(spark, root, "offer_files").select(F.col("id").alias("file_id"), F.col("offer_document_id").alias("id")).distinct()
    return cdc.cascade(files, documents, ["id"]).select("file_id", F.col("id").alias("document_id"))


def document_cache_diff(spark: SparkSession, root: str) -> DataFrame:
    """What the documents of each offer, by address, become from the early deliveries to all of them."""
    keys = [*KEY, "url"]
    rows = table(spark, root, "offer_documents").select(*keys, "name", "file_type", "ingested_at", "swept_at")
    early = cdc.newest_per_key(rows.where(F.col("ingested_at") < F.lit(CUT).cast("timestamp")), keys, ["ingested_at"])
    whole = cdc.newest_per_key(rows, keys, ["ingested_at"]).where("swept_at IS NULL")
    hashed = [x.select(*keys, F.sha2(F.concat_ws("\x1f", F.coalesce("name", F.lit("")), F.coalesce("file_type", F.lit(""))), 256).alias("hash")) for x in (whole, early)]
    return cdc.diff_actions(hashed[0], hashed[1], keys)


def retention_prune(spark: SparkSession, root: str) -> DataFrame:
    rows = cdc.newest_per_key(table(spark, root, "offer_files").select("id", "org_acronyme", "ingested_at", "swept_at"), ["id"], ["ingested_at"])
    kept = cdc.retain(rows, ["org_acronyme"], 20, [F.desc("ingested_at"), F.col("id")], F.col("swept_at").isNotNull())
    return kept.select("id", "org_acronyme")


def retry_due(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "offer_documents")
    return d.where(cdc.retry_due(F.col("download_attempted_at"), F.col("download_error"), NOW)).select("id").distinct()


def cache_fresh(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "offer_documents")
    return d.select("id", "ingested_at", cdc.fresh(F.col("download_attempted_at"), "2026-01-15 12:00:00", 30 * 86400).alias("fresh"))


def live_counts(spark: SparkSession, root: str) -> DataFrame:
    return _snapshot(spark, root, None).groupBy((F.col("swept_at").isNull()).alias("live")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (upsert_snapshot, mark_and_sweep, hash_diff_sync, sync_counts, stale_ids, cascade_delete, document_cache_diff, retention_prune, retry_due, cache_fresh, live_counts)
}

_EARLY, _LATE = f"ingested_at < TIMESTAMPTZ '{CUT}+00'", f"ingested_at >= TIMESTAMPTZ '{CUT}+00'"


def _newest(where: str) -> str:
    return f"(SELECT * FROM offers WHERE {where} QUALIFY row_number() OVER (PARTITION BY consultation_id, org_acronyme ORDER BY ingested_at DESC, offer_row DESC) = 1)"


_HASH = "sha256('1' || chr(31) || coalesce(objet, '') || chr(31) || coalesce(categorie, '') || chr(31) || coalesce(lieu_execution, '') || chr(31) || coalesce(date_limite, ''))"
_UPSERT = f"""
    SELECT coalesce(n.consultation_id, o.consultation_id) AS consultation_id, coalesce(n.org_acronyme, o.org_acronyme) AS org_acronyme,
           {", ".join(f"CASE WHEN n.offer_row IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in FIELDS[:-1])},
           CASE WHEN o.offer_row IS NOT NULL THEN o.first_seen_at ELSE n.first_seen_at END AS first_seen_at
    FROM {_newest(_EARLY)} o FULL JOIN {_newest(_LATE)} n ON o.consultation_id IS NOT DISTINCT FROM n.consultation_id AND o.org_acronyme IS NOT DISTINCT FROM n.org_acronyme
"""
_SYNC = f"""
    SELECT CASE WHEN c.c THEN c.consultation_id ELSE i.consultation_id END AS consultation_id, CASE WHEN c.c THEN c.org_acronyme ELSE i.org_acronyme END AS org_acronyme,
           CASE WHEN i.i IS NULL THEN 'insert' WHEN c.c IS NULL THEN 'delete' WHEN c.h = i.h THEN 'skip' ELSE 'update' END AS action
    FROM (SELECT consultation_id, org_acronyme, {_HASH} AS h, true AS c FROM {_newest('true')} WHERE swept_at IS NULL AND trim(objet) <> '') c
    FULL JOIN (SELECT consultation_id, org_acronyme, {_HASH} AS h, true AS i FROM {_newest(_EARLY)}) i
    ON c.consultation_id IS NOT DISTINCT FROM i.consultation_id AND c.org_acronyme IS NOT DISTINCT FROM i.org_acronyme
"""

ORACLES = {
    "upsert_snapshot": _UPSERT,
    "mark_and_sweep": f"WITH u AS ({_UPSERT}) SELECT consultation_id, org_acronyme, last_seen_run_id FROM u WHERE last_seen_run_id = (SELECT last_seen_run_id FROM offers WHERE last_seen_run_id IS NOT NULL ORDER BY ingested_at DESC, last_seen_run_id DESC LIMIT 1)",
    "hash_diff_sync": _SYNC,
    "sync_counts": f"SELECT action, count(*) AS n FROM ({_SYNC}) GROUP BY 1",
    "stale_ids": f"SELECT DISTINCT consultation_id, org_acronyme FROM {_newest(_EARLY)} k WHERE NOT EXISTS (SELECT 1 FROM {_newest('true')} a WHERE a.swept_at IS NULL AND a.consultation_id = k.consultation_id AND a.org_acronyme = k.org_acronyme)",
    "cascade_delete": f"""
        WITH alive AS (SELECT consultation_id, org_acronyme FROM {_newest('true')} WHERE swept_at IS NULL),
        d AS (SELECT DISTINCT id FROM offer_documents WHERE (consultation_id, org_acronyme) IN (SELECT (consultation_id, org_acronyme) FROM alive))
        SELECT DISTINCT id AS file_id, offer_document_id AS document_id FROM offer_files WHERE offer_document_id IN (SELECT id FROM d)
    """,
    "document_cache_diff": f"""
        WITH r AS (SELECT consultation_id AS c, org_acronyme AS o, url AS u, sha256(coalesce(name, '') || chr(31) || coalesce(file_type, '')) AS h, ingested_at, swept_at FROM offer_documents),
        e AS (SELECT c, o, u, arg_max(h, ingested_at) AS h, true AS e FROM r WHERE {_EARLY} GROUP BY 1, 2, 3),
        w AS (SELECT c, o, u, arg_max(h, ingested_at) AS h, true AS w FROM r GROUP BY 1, 2, 3 HAVING arg_max(swept_at IS NULL, ingested_at))
        SELECT CASE WHEN w THEN w.c ELSE e.c END AS consultation_id, CASE WHEN w THEN w.o ELSE e.o END AS org_acronyme, CASE WHEN w THEN w.u ELSE e.u END AS url,
               CASE WHEN e IS NULL THEN 'insert' WHEN w IS NULL THEN 'delete' WHEN w.h = e.h THEN 'skip' ELSE 'update' END AS action
        FROM w FULL JOIN e ON w.c IS NOT DISTINCT FROM e.c AND w.o IS NOT DISTINCT FROM e.o AND w.u IS NOT DISTINCT FROM e.u
    """,
    "retention_prune": """
        WITH r AS (SELECT * FROM offer_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)
        SELECT id, org_acronyme FROM r WHERE swept_at IS NULL QUALIFY row_number() OVER (PARTITION BY org_acronyme ORDER BY ingested_at DESC, id) <= 20
    """,
    "retry_due": f"""
        SELECT DISTINCT id FROM offer_documents WHERE try_strptime(download_attempted_at, '%Y-%m-%d %H:%M:%S') IS NULL OR download_error IS NULL
            OR date_diff('second', try_strptime(download_attempted_at, '%Y-%m-%d %H:%M:%S'), TIMESTAMP '{NOW}') >= 900
    """,
    "cache_fresh": "SELECT id, ingested_at, coalesce(date_diff('second', try_strptime(download_attempted_at, '%Y-%m-%d %H:%M:%S'), TIMESTAMP '2026-01-15 12:00:00') < 2592000, false) AS fresh FROM offer_documents",
    "live_counts": f"SELECT swept_at IS NULL AS live, count(*) AS n FROM {_newest('true')} GROUP BY 1",
}
