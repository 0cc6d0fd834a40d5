"""Queries of the sources, the tables and the stream. Pages, archives and split tables are literal, as no test table has any."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import blocks as bl
from quaestor.operators import tables as tb
from quaestor.runtime import table
from quaestor.sources import archives, html
from quaestor.streaming.sync import sync_stream

PAGE = """<html><body><a id="dce" href="/telechargement?f=1&amp;org=A"> Dossier  de consultation </a>
<a href="https://other.example/download">elsewhere</a><div style="display: none"><a href="/download?hidden=1">hidden</a></div>
<a href="https://www.marchespublics.gov.ma/reglement.pdf" title=" - Règlement - "></a><a href="/telechargement?f=1&amp;org=A">again</a></body></html>"""
TABLE = """<table><thead><tr><th rowspan=2>N</th><th colspan="2">Prix</th></tr><tr><th>HT</th><th>TTC</th></tr></thead>
<tr><td>1<td>10<td colspan="0">12<tr><td>2</td><td>20</td><td>24|5</td></tr></table>"""

FRAGMENTS = [
    "<table><tr><th>Lot<th>Article<th>Prix<tr><td rowspan=2>1<td>a<td>1<tr><td>b<td>2</table>",
    "<table><tr><td>LOT <td>article<td>PRIX<tr><td><td>c<td>3<tr><td><td>d<td>4<tr><td>2<td>e<td>5<tr><td><td>f<td>6</table>",
]


def html_documents(spark: SparkSession, root: str) -> DataFrame:
    pages = spark.createDataFrame([(1, "https://www.marchespublics.gov.ma/detail?id=1", PAGE), (2, "https://www.marchespublics.gov.ma/", None)], "page_id bigint, url string, html string")
    return html.download_documents(pages)


def html_forms(spark: SparkSession, root: str) -> DataFrame:
    form = "<form><input type=hidden name=state value='x y'><input name=q><input type=checkbox name=off><input type=radio name=r value=2 checked><select name=s><option value=a><option value=b selected></select><input type=submit name=go></form>"
    return html.forms(spark.createDataFrame([(1, form), (2, None)], "page_id bigint, html string"))


def html_tables(spark: SparkSession, root: str) -> DataFrame:
    return tb.laid_out(html.raw_cells(spark.createDataFrame([(1, TABLE), (2, "")], "table_id bigint, html string")))


def html_table_texts(spark: SparkSession, root: str) -> DataFrame:
    """Markdown and markup of the same tables."""
    cells = html_tables(spark, root)
    return tb.markdown(cells, "table_id").join(tb.html_text(cells, "table_id"), "table_id")


def fused_tables(spark: SparkSession, root: str) -> DataFrame:
    """Grid of a table whose header is reprinted and whose row span is cut by a page break."""
    parts = spark.createDataFrame(list(enumerate(FRAGMENTS)), "table_id bigint, html string")
    cells = tb.laid_out(html.raw_cells(parts)).withColumn("fragment", F.col("table_id").cast("int")).withColumn("table_id", F.lit(7))
    return tb.grid_rows(tb.fused(cells), "table_id").select("table_id", "r", F.array_join("texts", "§").alias("texts"))


def split_tables(spark: SparkSession, root: str) -> DataFrame:
    """Islands of the planted pages below: two fragments that go on, one that does not."""
    rows = [
        (1, "a", "table", 1, 0, 50.0, 300.0, 550.0, 780.0, "| x | y |"), (1, "f", "footer", 1, 1, 50.0, 785.0, 550.0, 795.0, "1"), (1, "b", "table", 2, 2, 52.0, 20.0, 549.0, 200.0, "| x | z |"),
        (1, "p", "paragraph", 2, 3, 50.0, 300.0, 550.0, 320.0, "text"), (1, "c", "table", 2, 4, 50.0, 700.0, 550.0, 790.0, "| x | y |"), (1, "d", "table", 3, 5, 50.0, 30.0, 550.0, 90.0, "| x | y | z |"),
    ]
    given = spark.createDataFrame(rows, "doc_id bigint, id string, type string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string")
    sizes = spark.createDataFrame([(1, p, 600.0, 800.0) for p in (1, 2, 3)], "doc_id bigint, page int, width double, height double")
    return bl.table_islands(given.withColumn("is_furniture", F.col("type") == "footer"), sizes).select("doc_id", "id", F.col("island").cast("int").alias("island"))


def swept_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Boxes of a sweep that no known box of the page covers: overlaps of 0.6, 0.25 and none."""
    box = "doc_id bigint, page int, id string, x0 double, y0 double, x1 double, y1 double"
    found = spark.createDataFrame([(1, 1, "s0", 0.0, 0.0, 10.0, 8.0), (1, 1, "s1", 0.0, 0.0, 4.0, 10.0), (1, 2, "s2", 0.0, 0.0, 10.0, 8.0)], box)
    known = spark.createDataFrame([(1, 1, "p0", 0.0, 0.0, 10.0, 10.0), (1, 1, "p1", 3.0, 0.0, 13.0, 10.0)], box)
    return bl.not_overlapping(found, known).select("doc_id", "page", "id")


def table_extents(spark: SparkSession, root: str) -> DataFrame:
    """Rows and columns of every table block of the documents."""
    return tb.extents(tb.pipe_cells(table(spark, root, "blocks").dropDuplicates(["doc_id", "id"])), "doc_id", "id")


def table_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Digest of every table block read into cells and written again."""
    cells = tb.pipe_cells(table(spark, root, "blocks").dropDuplicates(["doc_id", "id"]))
    return tb.markdown(cells, "doc_id", "id").select("doc_id", "id", F.md5("markdown").alias("digest"))


def archive_members(spark: SparkSession, root: str) -> DataFrame:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("lot 1/cps.txt", "cahier")
        z.writestr("rc.txt", "reglement")
    return archives.members(spark.createDataFrame([("a.zip", held.getvalue()), ("b.zip", b"none")], "path string, content binary"))


QUERIES = {f.__name__: f for f in (html_documents, html_forms, html_tables, html_table_texts, fused_tables, split_tables, swept_candidates, table_extents, table_markdown, archive_members, sync_stream)}

_LINES = r"""x AS (SELECT doc_id, id, list_filter(string_split(text, chr(10)), lambda v: trim(v) <> '' AND NOT regexp_full_match(v, '[\s|:-]+')) AS ls FROM (SELECT DISTINCT ON (doc_id, id) * FROM blocks) WHERE type = 'table'),
        l AS (SELECT doc_id, id, r, string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|') AS cells FROM (SELECT doc_id, id, unnest(ls) AS line, unnest(range(0, len(ls))) AS r FROM x))"""

ORACLES = {
    "html_documents": """SELECT * FROM (VALUES
        (1::BIGINT, 'https://www.marchespublics.gov.ma/telechargement?f=1&org=A', 'Dossier de consultation', 'dossier'),
        (1, 'https://www.marchespublics.gov.ma/reglement.pdf', 'Règlement', 'regulation')) AS t(page_id, url, name, file_type)""",
    "html_forms": "SELECT * FROM (VALUES (1::BIGINT, 'state', 'x y'), (1, 'q', ''), (1, 'r', '2'), (1, 's', 'b')) AS t(page_id, name, value)",
    "html_tables": """SELECT * FROM (VALUES (1::BIGINT, 0, 0, 2, 1, 'N', true), (1, 0, 1, 1, 2, 'Prix', true), (1, 1, 1, 1, 1, 'HT', true), (1, 1, 2, 1, 1, 'TTC', true),
        (1, 2, 0, 1, 1, '1', false), (1, 2, 1, 1, 1, '10', false), (1, 2, 2, 1, 1, '12', false), (1, 3, 0, 1, 1, '2', false), (1, 3, 1, 1, 1, '20', false), (1, 3, 2, 1, 1, '24|5', false)
        ) AS t(table_id, row, col, row_span, col_span, text, is_header)""",
    "html_table_texts": """SELECT * FROM (VALUES (1::BIGINT,
        '| N | Prix | Prix |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| N | HT | TTC |' || chr(10) || '| 1 | 10 | 12 |' || chr(10) || '| 2 | 20 | 24\\|5 |',
        '<table><tr><th rowspan="2">N</th><th colspan="2">Prix</th></tr><tr><th>HT</th><th>TTC</th></tr><tr><td>1</td><td>10</td><td>12</td></tr><tr><td>2</td><td>20</td><td>24|5</td></tr></table>'
        )) AS t(table_id, markdown, html)""",
    "fused_tables": """SELECT 7 AS table_id, * FROM (VALUES (0, 'Lot§Article§Prix'), (1, '1§a§1'), (2, '1§b§2'), (3, '1§c§3'), (4, '1§d§4'), (5, '2§e§5'), (6, '§f§6')) AS t(r, texts)""",
    "split_tables": "SELECT * FROM (VALUES (1::BIGINT, 'a', 1), (1, 'b', 1)) AS t(doc_id, id, island)",
    "swept_candidates": "SELECT * FROM (VALUES (1::BIGINT, 2, 's2')) AS t(doc_id, page, id)",
    "table_extents": rf"""WITH {_LINES}
        SELECT doc_id, id, (max(r) + 1)::INT AS n_rows, max(len(cells))::INT AS n_cols FROM l GROUP BY 1, 2""",
    "table_markdown": rf"""WITH {_LINES}, w AS (SELECT doc_id, id, max(len(cells)) AS n FROM l GROUP BY 1, 2),
        p AS (SELECT doc_id, id, r, n, '| ' || array_to_string([trim(coalesce(cells[k], '')) FOR k IN range(1, n + 1)], ' | ') || ' |' AS line FROM l JOIN w USING (doc_id, id))
        SELECT doc_id, id, md5(string_agg(CASE WHEN r = 0 THEN line || chr(10) || '| ' || array_to_string(['---' FOR k IN range(0, n)], ' | ') || ' |' ELSE line END, chr(10) ORDER BY r)) AS digest FROM p GROUP BY 1, 2""",
    "archive_members": """SELECT * FROM (VALUES ('a.zip', 'lot 1/cps.txt', 6::BIGINT, sha256('cahier'), NULL::VARCHAR), ('a.zip', 'rc.txt', 9, sha256('reglement'), NULL), ('b.zip', NULL, NULL, NULL, 'not an archive')
        ) AS t(archive, path, size, sha256, problem)""",
    "sync_stream": "SELECT consultation_id, org_acronyme, objet, date_limite FROM (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY consultation_id, org_acronyme ORDER BY ingested_at DESC, offer_row DESC) = 1) WHERE swept_at IS NULL",
}
