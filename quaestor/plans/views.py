"""Queries of views, lookups, index updates, layout regions and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.functions import dates, ids, text
from quaestor.operators import blocks as bl
from quaestor.operators import cdc, figures, layout
from quaestor.plans.changes import _EARLY, _HASH, KEY, _hashed, _newest, _snapshot
from quaestor.plans.scalars import _POINT_HASH, _UUID, SPACES, SQL_DEADLINE, sql_normal
from quaestor.plans.scalars import ORACLES as SCALARS
from quaestor.runtime import table

PORTAL_MARK = "EntrepriseDemandeTelechargement"


def _active(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "offers").drop("last_seen_run_id", "first_seen_at")
    current = cdc.newest_per_key(rows, KEY, ["ingested_at", "offer_row"]).where("swept_at IS NULL AND trim(objet) <> ''")
    return current.withColumn("seconds", dates.parse_deadline(F.col("date_limite"))).where(dates.active(F.col("seconds"))).withColumn("offer_id", ids.point_id(F.col("consultation_id"), F.col("org_acronyme")))


def offer_details(spark: SparkSession, root: str) -> DataFrame:
    """Public fields of the active offers that documents refer to, looked up by identifier."""
    wanted = table(spark, root, "offer_documents").select(ids.point_id(F.col("consultation_id"), F.col("org_acronyme")).alias("offer_id")).distinct()
    return _active(spark, root).join(wanted, "offer_id", "left_semi").select(
        F.col("offer_id").alias("id"), "reference", F.col("objet").alias("object"), F.coalesce(F.nullif("categorie", F.lit("")), F.lit("")).alias("category"), F.col("acheteur_public").alias("buyer"), "procedure",
        F.col("lieu_execution").alias("location"), F.col("date_publication").alias("publication_date"), F.col("date_limite").alias("deadline"), "source_url",
    )


def offer_points(spark: SparkSession, root: str) -> DataFrame:
    """Each delivered offer as the row of the search index that it becomes."""
    o = table(spark, root, "offers").withColumn("deadline", dates.parse_deadline(F.col("date_limite")))
    return o.select(
        "offer_row", ids.point_id(F.col("consultation_id"), F.col("org_acronyme")).alias("point_id"), text.normalize_text(F.col("categorie")).alias("category"),
        F.array_join(text.normalize_locations(F.col("lieu_execution")), "§").alias("locations"), "deadline",
        ids.content_hash(F.col("objet"), F.col("categorie"), F.col("lieu_execution"), ids.epoch_text(F.col("deadline"))).alias("hash"),
    )


def _newest_documents(spark: SparkSession, root: str) -> DataFrame:
    return cdc.newest_per_key(table(spark, root, "offer_documents").select("id", *KEY, "name", "url", "file_type", "ingested_at", "swept_at"), ["id"], ["ingested_at"])


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return _newest_documents(spark, root).where("swept_at IS NULL")


def offer_document_views(spark: SparkSession, root: str) -> DataFrame:
    """Documents of the active offers in order, with their address, whether the portal must be visited, and their files by name."""
    offers = _active(spark, root).select("offer_id", *KEY)
    files = cdc.newest_per_key(table(spark, root, "offer_files").select("id", F.col("offer_document_id").alias("document_id"), "name", "size", "ingested_at", "swept_at"), ["id"], ["ingested_at"])
    held = files.where("swept_at IS NULL AND document_id IS NOT NULL").groupBy("document_id").agg(
        F.count("*").alias("n_files"), F.sort_array(F.collect_list(F.struct(F.lower("name").alias("l"), "id", "name"))).alias("held")
    )
    shown = offers.join(_documents(spark, root), KEY).join(held, F.col("id") == F.col("document_id"), "left")
    return shown.select(
        "offer_id", "id", "name", "file_type", F.col("url").alias("portal_url"), F.coalesce(F.col("url").contains(PORTAL_MARK), F.lit(False)).alias("requires_portal"),
        F.row_number().over(Window.partitionBy("offer_id").orderBy("id")).alias("position"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.array_join(F.transform("held", lambda f: F.coalesce(f["name"], F.lit(""))), "§").alias("files"),
    )


def public_enterprises(spark: SparkSession, root: str) -> DataFrame:
    """Profiles as they are shown: lists stored as JSON and read again, consent as a truth value."""
    e = table(spark, root, "enterprises").dropDuplicates(["id"])
    stored = e.withColumns({c: F.to_json(F.coalesce(c, F.array().cast("array<string>"))) for c in ("keywords", "categories", "locations")})
    lists = [F.array_join(F.from_json(c, "array<string>"), "§", "").alias(c) for c in ("keywords", "categories", "locations")]
    return stored.select("id", "enterprise_name", text.optional_text(F.col("description")).alias("description"), *lists, F.coalesce("portal_download_consent", F.lit(False)).alias("portal_download_consent"))


def file_labels(spark: SparkSession, root: str) -> DataFrame:
    f = cdc.newest_per_key(table(spark, root, "offer_files").select("id", "media_type", "name", "size", "offer_document_id", "ingested_at"), ["id"], ["ingested_at"])
    d = _documents(spark, root).select(F.col("id").alias("document_id"), "file_type", F.col("url").contains(PORTAL_MARK).alias("portal"))
    joined = f.join(d, F.col("offer_document_id") == F.col("document_id"), "left")
    return joined.select("id", text.file_type_label(F.col("media_type"), F.col("file_type"), F.col("name"), F.col("size"), F.coalesce("portal", F.lit(False))).alias("label"))


def download_errors(spark: SparkSession, root: str) -> DataFrame:
    """Recorded errors cut to length, blank ones as none, and whether they speak of a device."""
    d = table(spark, root, "offer_documents").select("id", "download_error", "file_type").distinct()
    return d.select("id", "file_type", text.error_text(F.coalesce("file_type", F.lit("Error")), text.optional_text(F.col("download_error"))).alias("error"), text.holds_marker(F.col("download_error")).alias("of_device"))


def place_lists(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "offers").select("offer_row", F.array_join(text.comma_list(F.col("lieu_execution")), "§").alias("places"), text.e_mail(F.col("source_url")).alias("address"), ids.detail_address(F.col("consultation_id"), F.col("org_acronyme")).alias("detail"))


def text_layers(spark: SparkSession, root: str) -> DataFrame:
    """Pages whose blocks together hold too little text to be a text layer."""
    pages = bl.distinct_blocks(spark, root).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id", "text"))), lambda x: x["text"]), "").alias("whole"))
    return pages.select("doc_id", "page", text.without_text_layer(F.col("whole")).alias("scanned"))


def document_results(spark: SparkSession, root: str) -> DataFrame:
    """What a parse returns of each document, as JSON."""
    blocks = bl.distinct_blocks(spark, root).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))
    pages = table(spark, root, "doc_pages").groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"), F.coalesce(F.max("is_scanned"), F.lit(False)).alias("is_scanned"))
    return blocks.join(pages, "doc_id").select("doc_id", F.to_json(F.struct("n_pages", "n_blocks", "n_chars", "is_scanned")).alias("result"))


def synced_index(spark: SparkSession, root: str) -> DataFrame:
    """The index after inserts, updates and deletes by hash."""
    now, before = _hashed(_snapshot(spark, root, None).where("swept_at IS NULL AND trim(objet) <> ''")), _hashed(_snapshot(spark, root, False))
    return cdc.applied(before, now, cdc.diff_actions(now, before, KEY), KEY)


def replaced_files(spark: SparkSession, root: str) -> DataFrame:
    """Files with those of every document that a later delivery touches replaced by that delivery's."""
    f = table(spark, root, "offer_files").where("offer_document_id IS NOT NULL").select("id", "offer_document_id", "name", "ingested_at").distinct()
    cut = F.lit("2025-07-01 00:00:00").cast("timestamp")
    return cdc.replace_partition(f.where(F.col("ingested_at") < cut), f.where(F.col("ingested_at") >= cut), ["offer_document_id"]).select("id", "offer_document_id", "name")


def orphan_folders(spark: SparkSession, root: str) -> DataFrame:
    """Storage folders of files whose offer is in the snapshot no more."""
    key = ids.storage_key(F.col("consultation_id"), F.col("org_acronyme")).alias("folder")
    alive = _snapshot(spark, root, None).where("swept_at IS NULL").select(key)
    return table(spark, root, "offer_files").select(key).distinct().join(alive, "folder", "left_anti")


def resumed_runs(spark: SparkSession, root: str) -> DataFrame:
    states = spark.createDataFrame([(1, "r1", "running", 4), (2, "r2", "failed", 7), (3, "r3", "paused", None), (4, "r4", "completed", 9), (5, None, None, None)], "id int, run_id string, status string, last_page int")
    return cdc.resumed(states, F.concat(F.lit("new"), F.col("id").cast("string")))


REGION = "doc_id bigint, page int, ord int, label string, content string, x0 double, y0 double, x1 double, y1 double, confidence double, scale double, page_width double, page_height double"
REGIONS = [
    (1, 1, 0, "doc_title", " Avis ", 100.0, 100.0, 500.0, 140.0, 0.9, 2.0, 1200.0, 1600.0), (1, 1, 1, "image", "", 10.0, 10.0, 30.0, 200.0, 0.8, 2.0, 1200.0, 1600.0), (1, 1, 2, "text", "corps", 100.0, 200.0, 500.0, 300.0, 0.7, 2.0, 1200.0, 1600.0),
    (1, 1, 3, "figure", None, 1180.4, 10.0, 1400.0, 200.0, 0.6, 2.0, 1200.0, 1600.0), (1, 1, 4, "stamp?", "x", 1.0, 2.0, 3.0, 4.0, None, 2.0, 1200.0, 1600.0), (1, 2, 0, "seal", "", 0.0, 0.0, 100.0, 100.0, 0.5, 1.0, 600.0, 800.0), (1, 2, 1, "number", "2", 0.0, 0.0, 10.0, 10.0, 0.5, 1.0, 600.0, 800.0),
]


def layout_blocks(spark: SparkSession, root: str) -> DataFrame:
    return layout.page_blocks(spark.createDataFrame(REGIONS, REGION)).select("id", "type", "ord", "x0", "y1", "text", "level", "is_furniture")


def region_scores(spark: SparkSession, root: str) -> DataFrame:
    seen = spark.createDataFrame([(1, 1, "figure", 1180.0, 10.0, 1400.0, 200.0, 0.66), (1, 1, "text", 100.0, 200.0, 500.0, 301.0, 0.9), (1, 2, "number", 0.4, 0.0, 10.0, 10.0, 0.3)], "doc_id bigint, page int, label string, x0 double, y0 double, x1 double, y1 double, score double")
    found = figures.scored(spark.createDataFrame(REGIONS, REGION), seen)
    return found.where(F.col("score").isNotNull()).select("page", "ord", "score")


def sweep(spark: SparkSession, root: str) -> DataFrame:
    """Detections of a sweep: covered by a known figure, too small, too weak, no picture, and two that stay."""
    box = "label string, x0 double, y0 double, x1 double, y1 double, score double"
    rows = [(1, 1, 0, "image", 0.0, 0.0, 100.0, 100.0, 0.9), (1, 1, 1, "image", 400.0, 0.0, 420.0, 90.0, 0.9), (1, 1, 2, "chart", 400.0, 400.0, 500.0, 500.0, 0.2), (1, 1, 3, "image", 600.0, 400.0, 700.0, 500.0, 0.1), (1, 1, 4, "text", 600.0, 400.0, 700.0, 500.0, 0.9), (1, 1, 5, "figure", 800.0, 800.0, 900.0, 900.0, 0.15)]
    seen = spark.createDataFrame(rows, f"doc_id bigint, page int, ord int, {box}").withColumns({"scale": F.lit(2.0), "page_width": F.lit(1200.0), "page_height": F.lit(1600.0)})
    known = spark.createDataFrame([(1, 1, 0.0, 0.0, 40.0, 50.0)], "doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double")
    return figures.swept(seen, known).select("id", "label", "x0", "y1", "score")


def pruned_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents without withdrawn ones that went long ago or are not among the newest."""
    rows = _newest_documents(spark, root)
    return cdc.pruned(rows, "id", "ingested_at", "swept_at", F.lit("2025-10-01 00:00:00").cast("timestamp"), 300).select("id")


FIGURES = [
    (1, 1, "p1_b3", "stamp", 0.2, False), (1, 2, "p2_s0", "signature", 0.71239, True), (1, 2, "p2_s1", "signature", 0.4, True), (1, 2, "p2_b0", "bar_chart", None, False), (2, 1, "p1_s0", "photograph", 0.9, True), (2, 1, "p1_b0", "logo", 0.9, False),
]
FIGURE = "doc_id bigint, page int, id string, figure_class string, confidence double, swept boolean"


def routed_figures(spark: SparkSession, root: str) -> DataFrame:
    found = figures.routed(spark.createDataFrame(FIGURES, FIGURE)).withColumn("caption", figures.caption_line(F.col("figure_class"), F.when(F.col("to_describe"), "vu")))
    return found.select("doc_id", "id", "is_signature", "kept", "to_describe", "caption")


def signatures(spark: SparkSession, root: str) -> DataFrame:
    found = figures.evidence(spark.createDataFrame(FIGURES, FIGURE))
    return found.select("doc_id", "is_signed", F.to_json("evidence").alias("evidence"))


def parsed_documents(spark: SparkSession, root: str) -> DataFrame:
    """The whole pipeline over the parsed pages: counts and digest of each document's Markdown."""
    _, documents = layout.parse_blocks(bl.distinct_blocks(spark, root), table(spark, root, "doc_pages"))
    return documents.select("doc_id", "n_blocks", "n_tokens", "n_pages", F.md5("markdown").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (offer_points, offer_details, offer_document_views, public_enterprises, file_labels, download_errors, place_lists, text_layers, document_results, synced_index, replaced_files, orphan_folders, resumed_runs,
              layout_blocks, region_scores, sweep, pruned_documents, routed_figures, signatures, parsed_documents)
}

_ACTIVE = f"""a0 AS (SELECT *, {SQL_DEADLINE} AS seconds, {_POINT_HASH} AS h FROM {_newest("true")} WHERE swept_at IS NULL AND trim(objet) <> ''),
    act AS (SELECT *, {_UUID} AS offer_id FROM a0 WHERE seconds > {dates.now_seconds()})"""
_DOCS = "docs AS (SELECT * FROM (SELECT * FROM offer_documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1) WHERE swept_at IS NULL)"
_FILES = "fs AS (SELECT * FROM offer_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"
_SIZE = "CASE WHEN size IS NULL THEN '' WHEN size < 1048576 THEN greatest(1, floor(size / 1024 + 0.5)::BIGINT) || ' Ko' ELSE printf('%.1f', size / 1048576) || ' Mo' END"

ORACLES = {
    "offer_points": f"""
        SELECT offer_row, point_id, {sql_normal("categorie")} AS category, locations, deadline, hash FROM offers JOIN ({SCALARS["point_ids"]}) USING (offer_row) JOIN ({SCALARS["normalize_locations"]}) USING (offer_row)
        JOIN ({SCALARS["parse_deadline"]}) USING (offer_row) JOIN ({SCALARS["content_hash"]}) USING (offer_row)
    """,
    "offer_details": f"""
        WITH {_ACTIVE}, w AS (SELECT DISTINCT {_UUID} AS offer_id FROM (SELECT {_POINT_HASH} AS h FROM offer_documents))
        SELECT offer_id AS id, reference, objet AS object, coalesce(categorie, '') AS category, acheteur_public AS buyer, procedure, lieu_execution AS location, date_publication AS publication_date, date_limite AS deadline, source_url
        FROM act WHERE offer_id IN (SELECT offer_id FROM w)
    """,
    "offer_document_views": f"""
        WITH {_ACTIVE}, {_DOCS}, {_FILES}, h AS (SELECT offer_document_id AS document_id, count(*) AS n_files, string_agg(coalesce(name, ''), '§' ORDER BY lower(name) NULLS FIRST, id) AS files FROM fs WHERE swept_at IS NULL AND offer_document_id IS NOT NULL GROUP BY 1)
        SELECT a.offer_id, d.id, d.name, d.file_type, d.url AS portal_url, coalesce(contains(d.url, '{PORTAL_MARK}'), false) AS requires_portal, row_number() OVER (PARTITION BY a.offer_id ORDER BY d.id) AS position, coalesce(n_files, 0) AS n_files, files
        FROM act a JOIN docs d ON a.consultation_id = d.consultation_id AND a.org_acronyme = d.org_acronyme LEFT JOIN h ON h.document_id = d.id
    """,
    "public_enterprises": f"""
        SELECT id, enterprise_name, nullif(trim(regexp_replace(description, '{SPACES}', ' ', 'g')), '') AS description,
               {", ".join(f"array_to_string([coalesce(x, '') FOR x IN coalesce({c}, [])], '§') AS {c}" for c in ("keywords", "categories", "locations"))}, coalesce(portal_download_consent, false) AS portal_download_consent
        FROM (SELECT DISTINCT ON (id) * FROM enterprises)
    """,
    "file_labels": f"""
        WITH {_DOCS}, {_FILES}, j AS (SELECT f.id, f.media_type, f.name, f.size, d.file_type, coalesce(contains(d.url, '{PORTAL_MARK}'), false) AS portal, {_SIZE} AS s, string_split(coalesce(f.name, ''), '.')[-1] AS ext FROM fs f LEFT JOIN docs d ON f.offer_document_id = d.id)
        SELECT id, CASE WHEN portal THEN 'Dossier protégé — téléchargement officiel' WHEN media_type = 'application/pdf' THEN 'PDF · ' || s WHEN starts_with(media_type, 'image/') THEN 'Image · ' || s WHEN starts_with(media_type, 'text/') THEN 'Texte · ' || s
            WHEN file_type = 'dossier' THEN 'Dossier de consultation' WHEN file_type = 'notice' THEN 'Avis de publicité' WHEN size IS NOT NULL THEN upper(CASE WHEN ext <> '' AND ext <> name THEN ext ELSE 'Fichier' END) || ' · ' || s
            ELSE upper(coalesce(nullif(file_type, ''), nullif(media_type, ''), 'Document')) END AS label FROM j
    """,
    "download_errors": f"""
        SELECT id, file_type, substr(coalesce(file_type, 'Error') || ': ' || nullif(trim(regexp_replace(download_error, '{SPACES}', ' ', 'g')), ''), 1, 500) AS error, coalesce(regexp_matches(lower(download_error), 'cuda|cudnn|cublas|memory|device|vram'), false) AS of_device
        FROM (SELECT DISTINCT id, download_error, file_type FROM offer_documents)
    """,
    "place_lists": r"""
        WITH p AS (SELECT offer_row, trim(unnest(string_split(lieu_execution, ','))) AS v, unnest(range(0, len(string_split(lieu_execution, ',')))) AS n FROM offers),
        f AS (SELECT offer_row, v, min(n) AS n FROM p WHERE v <> '' GROUP BY 1, 2), g AS (SELECT offer_row, string_agg(v, '§' ORDER BY n) AS places FROM f GROUP BY 1)
        SELECT o.offer_row, coalesce(places, '') AS places, lower(trim(source_url)) AS address, 'https://www.marchespublics.gov.ma/index.php?page=entreprise.EntrepriseDetailConsultation&refConsultation='
            || replace(url_encode(coalesce(consultation_id, '')), '%20', '+') || '&orgAcronyme=' || replace(url_encode(coalesce(org_acronyme, '')), '%20', '+') AS detail
        FROM offers o LEFT JOIN g USING (offer_row)
    """,
    "text_layers": r"""
        SELECT doc_id, page, length(regexp_replace(string_agg(coalesce(text, ''), '' ORDER BY ord, id), '^\s+|\s+$', '', 'g')) < 100 AS scanned FROM (SELECT DISTINCT ON (doc_id, id) * FROM blocks) GROUP BY 1, 2
    """,
    "document_results": """
        WITH b AS (SELECT doc_id, count(*) AS n_blocks, sum(length(coalesce(text, ''))) AS n_chars FROM (SELECT DISTINCT ON (doc_id, id) * FROM blocks) GROUP BY 1),
        p AS (SELECT doc_id, count(DISTINCT page) AS n_pages, coalesce(bool_or(is_scanned), false) AS s FROM doc_pages GROUP BY 1)
        SELECT doc_id, '{"n_pages":' || n_pages || ',"n_blocks":' || n_blocks || ',"n_chars":' || n_chars || ',"is_scanned":' || s || '}' AS result FROM b JOIN p USING (doc_id)
    """,
    "synced_index": f"SELECT consultation_id, org_acronyme, {_HASH} AS hash FROM {_newest('true')} WHERE swept_at IS NULL AND trim(objet) <> ''",
    "replaced_files": f"""
        WITH f AS (SELECT DISTINCT id, offer_document_id, name, ingested_at FROM offer_files WHERE offer_document_id IS NOT NULL), late AS (SELECT * FROM f WHERE NOT {_EARLY})
        SELECT id, offer_document_id, name FROM late UNION ALL SELECT id, offer_document_id, name FROM f WHERE {_EARLY} AND offer_document_id NOT IN (SELECT offer_document_id FROM late)
    """,
    "orphan_folders": f"""
        WITH k AS (SELECT DISTINCT coalesce(consultation_id, '') AS c, coalesce(org_acronyme, '') AS o FROM offer_files), a AS (SELECT DISTINCT coalesce(consultation_id, '') AS c, coalesce(org_acronyme, '') AS o FROM {_newest('true')} WHERE swept_at IS NULL)
        SELECT substr(sha256(encode(c) || unhex('00') || encode(o)), 1, 24) AS folder FROM k WHERE (c, o) NOT IN (SELECT (c, o) FROM a)
    """,
    "resumed_runs": "SELECT * FROM (VALUES (1, 'r1', 4, 'running'), (2, 'r2', 7, 'running'), (3, 'r3', 0, 'running'), (4, 'new4', 0, 'running'), (5, 'new5', 0, 'running')) AS t(id, run_id, last_page, status)",
    "layout_blocks": """SELECT * FROM (VALUES ('p1_b0', 'title', 0, 50.0::DOUBLE, 70.0::DOUBLE, 'Avis', 1, false), ('p1_b1', 'paragraph', 2, 50.0, 150.0, 'corps', NULL, false), ('p1_b2', 'other', 4, 0.5, 2.0, 'x', NULL, false),
        ('p2_b0', 'image', 5, 0.0, 100.0, '', NULL, false), ('p2_b1', 'page_number', 6, 0.0, 10.0, '2', NULL, true)) AS t(id, type, ord, x0, y1, text, level, is_furniture)""",
    "region_scores": "SELECT * FROM (VALUES (1, 3, 0.66::DOUBLE), (2, 1, 0.3)) AS t(page, ord, score)",
    "sweep": "SELECT * FROM (VALUES ('p1_s0', 'chart', 200.0::DOUBLE, 250.0::DOUBLE, 0.2::DOUBLE), ('p1_s1', 'figure', 400.0, 450.0, 0.15)) AS t(id, label, x0, y1, score)",
    "pruned_documents": """
        WITH r AS (SELECT * FROM offer_documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)
        SELECT id FROM r WHERE NOT (swept_at IS NOT NULL AND (swept_at < TIMESTAMPTZ '2025-10-01 00:00:00+00' OR id NOT IN (SELECT id FROM r ORDER BY ingested_at DESC, id LIMIT 300)))
    """,
    "routed_figures": """SELECT * FROM (VALUES (1::BIGINT, 'p1_b3', true, true, false, ''), (1, 'p2_s0', true, true, false, ''), (1, 'p2_s1', false, false, false, ''), (1, 'p2_b0', false, true, true, '*[bar chart]* vu'),
        (2, 'p1_s0', false, false, false, ''), (2, 'p1_b0', false, true, false, '')) AS t(doc_id, id, is_signature, kept, to_describe, caption)""",
    "signatures": """SELECT * FROM (VALUES (1::BIGINT, true, '[{"page":1,"id":"p1_b3","figure_class":"stamp","confidence":0.2,"found_by":"layout"},{"page":2,"id":"p2_s0","figure_class":"signature","confidence":0.7124,"found_by":"sweep"}]'),
        (2, false, '[]')) AS t(doc_id, is_signed, evidence)""",
}
