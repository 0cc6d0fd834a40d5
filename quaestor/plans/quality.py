"""Queries on references and timestamps of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import instants, orphans
from quaestor.runtime import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_references(spark, root)


def p2_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_snapshots(spark, root)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return instants.timestamp_cases(table(spark, root, "offers"))


def p5_instants(spark: SparkSession, root: str) -> DataFrame:
    """Every value of the timestamp fields as one UTC instant."""
    done = instants.normalised_fields(table(spark, root, "offers"))
    return done.select("offer_row", "field", instants.instant_text(F.col("utc")).alias("utc"), "clock")


QUERIES = {f.__name__: f for f in (p2_found, p2_snapshots, p5_found, p5_instants)}



def _orphans(where: str) -> str:
    """SQL of the open cases of what arrived under a condition, with their status."""
    return f"""
        WITH f AS (
            SELECT id, min(ingested_at) AS arrived, arg_max(swept_at IS NOT NULL, ingested_at) AS swept,
                   arg_max(coalesce(offer_document_id, -1), ingested_at) AS ref
            FROM offer_files WHERE {where} GROUP BY id
        ), d AS (
            SELECT id, min(ingested_at) AS arrived, arg_max(swept_at IS NOT NULL, ingested_at) AS swept,
                   arg_max(coalesce(consultation_id, ''), ingested_at) AS cid,
                   arg_max(upper(trim(coalesce(org_acronyme, ''))), ingested_at) AS org
            FROM offer_documents WHERE {where} GROUP BY id
        ), o AS (
            SELECT consultation_id AS cid, upper(trim(org_acronyme)) AS org, min(ingested_at) AS arrived,
                   arg_max(swept_at IS NOT NULL, ingested_at) AS swept
            FROM offers WHERE trim(consultation_id) <> '' AND trim(org_acronyme) <> '' AND {where} GROUP BY 1, 2
        )
        SELECT 'offer_files' AS table_name, f.id AS record_id, strftime(f.arrived AT TIME ZONE 'UTC', '%Y-%m') AS period,
               CASE WHEN d.id IS NULL THEN 'absent' WHEN d.swept THEN 'withdrawn' ELSE 'late' END AS status
        FROM f LEFT JOIN d ON f.ref = d.id
        WHERE f.ref <> -1 AND NOT f.swept AND (d.id IS NULL OR d.swept OR d.arrived > f.arrived)
        UNION ALL
        SELECT 'offer_documents', d.id, strftime(d.arrived AT TIME ZONE 'UTC', '%Y-%m'), CASE WHEN o.cid IS NULL THEN 'absent' WHEN o.swept THEN 'withdrawn' ELSE 'late' END
        FROM d LEFT JOIN o ON d.cid = o.cid AND d.org = o.org
        WHERE trim(d.cid) <> '' AND d.org <> '' AND NOT d.swept AND (o.cid IS NULL OR o.swept OR o.arrived > d.arrived)
    """


_CUT = orphans.HISTORY_CUTS[0].rstrip("Z").replace("T", " ")
_COUNTS = "SELECT {0} AS batch, table_name, period, status, count(*) AS orphans FROM ({1}) GROUP BY ALL"

ORACLES = {
    "p2_found": f"SELECT table_name, record_id, period FROM ({_orphans('true')})",
    "p2_snapshots": _COUNTS.format(1, _orphans(f"ingested_at < TIMESTAMPTZ '{_CUT}+00'")) + " UNION ALL " + _COUNTS.format(2, _orphans("true")),
}
