"""Queries of the block operators on the parsed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.operators import blocks as op
from quaestor.runtime import table


def section_paths(spark: SparkSession, root: str) -> DataFrame:
    return op.section_paths(op.distinct_blocks(spark, root)).select("doc_id", "id", F.array_join("path", "§").alias("path"))


def markdown_spans(spark: SparkSession, root: str) -> DataFrame:
    return op.markdown_spans(op.distinct_blocks(spark, root)).select("doc_id", "id", "span_start", "span_end")


def render_markdown(spark: SparkSession, root: str) -> DataFrame:
    return op.render_markdown(op.distinct_blocks(spark, root)).select("doc_id", F.md5("markdown").alias("digest"))


def repeated_margin_texts(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "doc_pages")
    return op.repeated_keys(op.banded(op.distinct_blocks(spark, root), pages), pages)


def strip_furniture(spark: SparkSession, root: str) -> DataFrame:
    return op.strip_furniture(op.distinct_blocks(spark, root), table(spark, root, "doc_pages")).select("doc_id", "id")


def strip_furniture_families(spark: SparkSession, root: str) -> DataFrame:
    return op.strip_furniture_families(op.distinct_blocks(spark, root), table(spark, root, "doc_pages")).select("doc_id", "id")


def margin_families(spark: SparkSession, root: str) -> DataFrame:
    return op.margin_families(op.banded(op.distinct_blocks(spark, root), table(spark, root, "doc_pages")))


def table_islands(spark: SparkSession, root: str) -> DataFrame:
    return op.table_islands(op.distinct_blocks(spark, root), table(spark, root, "doc_pages"))


#: How far the boxes of neighbours are widened to meet, in points.
NEAR = 10.0


def overlapping_blocks(spark: SparkSession, root: str) -> DataFrame:
    """How much the boxes of one page overlap once they are widened, so that neighbours do."""
    b = op.distinct_blocks(spark, root)
    return op.overlapping(b.withColumns({c: F.col(c) + (NEAR if c[1] == "1" else -NEAR) for c in ("x0", "y0", "x1", "y1")}), least=0.0)


def blocks_per_page(spark: SparkSession, root: str) -> DataFrame:
    return op.distinct_blocks(spark, root).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def renumbered(spark: SparkSession, root: str) -> DataFrame:
    kept = op.distinct_blocks(spark, root).where(~F.col("is_furniture"))
    return kept.select("doc_id", "id", (F.row_number().over(op._reading()) - 1).alias("position"))


def document_flags(spark: SparkSession, root: str) -> DataFrame:
    letters = op.distinct_blocks(spark, root).groupBy("doc_id").agg(
        F.sum(text.arabic_letters(F.col("text"))).alias("arabic"), F.sum(text.latin_letters(F.col("text"))).alias("latin"), F.count("*").alias("n_blocks")
    )
    pages = table(spark, root, "doc_pages").groupBy("doc_id").agg(
        (F.sum(F.coalesce(F.col("is_scanned"), F.lit(False)).cast("int")) > F.count("*") / 2).alias("scanned"), F.count("*").alias("n_pages")
    )
    return letters.join(pages, "doc_id").select("doc_id", text.script_language(F.col("arabic"), F.col("latin")).alias("language"), "scanned", "n_blocks", "n_pages")


def softmax_top(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = v.withColumn("top", F.array_max("v"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    return v.select("vec_id", F.array_position("v", F.col("top")).alias("best"), F.round(1 / total, 6).alias("p"))


QUERIES = {
    f.__name__: f
    for f in (section_paths, markdown_spans, render_markdown, repeated_margin_texts, strip_furniture, strip_furniture_families, margin_families, table_islands,
              overlapping_blocks, blocks_per_page, renumbered, document_flags, softmax_top)
}

_B = "b AS (SELECT doc_id, id, type, page, ord, coalesce(text, '') AS text, level, coalesce(is_furniture, false) AS is_furniture, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM (SELECT DISTINCT ON (doc_id, id) * FROM blocks))"
_W = "PARTITION BY doc_id ORDER BY page, ord, id"
_P = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CHUNK = _STRIP.format("CASE WHEN type = 'title' THEN repeat('#', coalesce(level, 3)) || ' ' || text ELSE text END")
_CHUNKS = f"c AS (SELECT * FROM (SELECT *, {_CHUNK} AS chunk FROM b WHERE NOT is_furniture) WHERE chunk <> '')"
_KEY = r"lower(regexp_replace(" + _STRIP.format("text") + r", '\s+', ' ', 'g'))"
_TYPES = "('paragraph', 'title', 'header', 'footer', 'page_number', 'reference', 'other')"
_BANDS = f"""
    h AS (SELECT doc_id, page, max(height) AS height FROM doc_pages GROUP BY 1, 2),
    band AS (SELECT b.*, {_KEY} AS key FROM b JOIN h USING (doc_id, page) WHERE height > 0 AND (y0 < height * 0.12 OR y1 > height * (1 - 0.12))),
    np AS (SELECT doc_id, count(DISTINCT page) AS n FROM doc_pages GROUP BY 1),
    rep AS (SELECT doc_id, key, n_pages FROM (SELECT doc_id, key, count(DISTINCT page) AS n_pages FROM band WHERE type IN {_TYPES} AND key <> '' AND length(key) <= 120 GROUP BY 1, 2)
            JOIN np USING (doc_id) WHERE n >= 2 AND n_pages >= greatest(2, round_even(n * 0.3, 0)::INT))
"""
_PAGE_NO = r"(trim(text) <> '' AND length(trim(text)) <= 24 AND regexp_matches(trim(text), '(?i)^(page|p\.?|pg\.?)?\s*[\[\(\-–—]*\s*[\divxlcdm]+\s*(/|sur|of|de)?\s*[\divxlcdm]*\s*[\]\)\-–—.]*$'))"

ORACLES = {
    "section_paths": f"""
        WITH {_B}, n AS (SELECT *, row_number() OVER ({_W}) AS n, type = 'title' AND text <> '' AND NOT is_furniture AS t, least(greatest(coalesce(level, 3), 1), 3) AS l FROM b),
        p AS (SELECT *, {", ".join(f"last_value(CASE WHEN t AND l = {k} THEN {{'n': n, 't': text}} END IGNORE NULLS) OVER ({_W} {_P}) AS p{k}" for k in (1, 2, 3))} FROM n),
        q AS (SELECT doc_id, id, CASE WHEN t THEN l ELSE 4 END AS top, p1.t AS t1, p2.t AS t2, p3.t AS t3, coalesce(p1.n, -1) AS n1, coalesce(p2.n, -1) AS n2, coalesce(p3.n, -1) AS n3 FROM p)
        SELECT doc_id, id, concat_ws('§', CASE WHEN top > 1 THEN t1 END, CASE WHEN top > 2 AND n2 > n1 THEN t2 END, CASE WHEN top > 3 AND n3 > greatest(n1, n2) THEN t3 END) AS path FROM q
    """,
    "markdown_spans": f"""
        WITH {_B}, {_CHUNKS}
        SELECT doc_id, id, s AS span_start, s + length(chunk) AS span_end FROM (SELECT *, coalesce(sum(length(chunk) + 2) OVER ({_W} {_P}), 0)::BIGINT AS s FROM c)
    """,
    "render_markdown": f"WITH {_B}, {_CHUNKS} SELECT doc_id, md5(string_agg(chunk, chr(10) || chr(10) ORDER BY page, ord, id) || chr(10)) AS digest FROM c GROUP BY 1",
    "repeated_margin_texts": f"WITH {_B}, {_BANDS} SELECT * FROM rep",
    "strip_furniture": f"""
        WITH {_B}, {_BANDS} SELECT doc_id, id FROM b WHERE NOT is_furniture AND (doc_id, id) NOT IN (
            SELECT (doc_id, id) FROM band WHERE type IN {_TYPES} AND ({_PAGE_NO} OR (doc_id, key) IN (SELECT (doc_id, key) FROM rep)))
    """,
    "overlapping_blocks": f"""
        WITH {_B}, g AS (SELECT doc_id, page, id, x0 - 10 AS x0, y0 - 10 AS y0, x1 + 10 AS x1, y1 + 10 AS y1 FROM b), i AS (SELECT a.doc_id, a.page, a.id AS a, c.id AS b, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i,
            (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s FROM g a JOIN g c ON a.doc_id = c.doc_id AND a.page = c.page AND a.id < c.id)
        SELECT doc_id, page, a, b, round(i / nullif(s - i, 0), 6) AS iou FROM i WHERE round(i / nullif(s - i, 0), 6) > 0
    """,
    "blocks_per_page": f"WITH {_B} SELECT doc_id, page, count(*) AS n FROM b GROUP BY 1, 2",
    "renumbered": f"WITH {_B} SELECT doc_id, id, row_number() OVER ({_W}) - 1 AS position FROM b WHERE NOT is_furniture",
    "document_flags": rf"""
        WITH {_B}, l AS (SELECT doc_id, count(*) AS n_blocks,
            sum(length(regexp_replace(regexp_replace(text, '[^\x{{600}}-\x{{6FF}}\x{{750}}-\x{{77F}}\x{{8A0}}-\x{{8FF}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]', '', 'g'), '[^\p{{L}}]', '', 'g'))) AS arabic,
            sum(length(regexp_replace(regexp_replace(text, '[^\p{{Latin}}]', '', 'g'), '[^\p{{L}}]', '', 'g'))) AS latin FROM b GROUP BY 1),
        p AS (SELECT doc_id, sum(coalesce(is_scanned, false)::INT) > count(*) / 2 AS scanned, count(*) AS n_pages FROM doc_pages GROUP BY 1)
        SELECT doc_id, CASE WHEN arabic + latin = 0 THEN 'fr' WHEN arabic / (arabic + latin) > 0.85 THEN 'ar' WHEN arabic / (arabic + latin) < 0.15 THEN 'fr' ELSE 'mixed' END AS language, scanned, n_blocks, n_pages
        FROM l JOIN p USING (doc_id)
    """,
    "softmax_top": """
        SELECT vec_id, list_position(v, list_max(v))::BIGINT AS best, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS p
        FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    """,
}
