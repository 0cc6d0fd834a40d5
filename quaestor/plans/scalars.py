"""Queries of the scalar functions, each over its whole table."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import dates, ids, text
from quaestor.runtime import table


def q_normalize_text(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "offers")
    return o.select("offer_row", *[text.normalize_text(F.col(c)).alias(f"n_{c}") for c in ("objet", "acheteur_public", "procedure")])


def q_normalize_locations(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "offers")
    return o.select("offer_row", F.array_join(text.normalize_locations(F.col("lieu_execution")), "§").alias("locations"))


def q_document_type(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "offer_documents")
    kind = text.document_type(F.concat_ws(" ", "name", "url"), F.col("url"))
    return d.select("id", kind.alias("kind")).distinct()


def q_slugify(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "offer_documents")
    return d.select("id", text.slug(F.col("name")).alias("file_name")).distinct()


def q_collapse(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return d.select("doc_id", F.md5(text.collapse(F.col("text"))).alias("digest"))


def q_clean_cell(spark: SparkSession, root: str) -> DataFrame:
    b = table(spark, root, "blocks").where("type = 'table'").select("doc_id", "id", F.posexplode(F.split("text", r"\|")).alias("n", "cell")).distinct()
    return b.select("doc_id", "id", "n", text.clean_cell(F.col("cell")).alias("cell"))


def q_script_language(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select("doc_id", text.arabic_letters(F.col("text")).alias("arabic"), text.latin_letters(F.col("text")).alias("latin"))
    return d.withColumn("language", text.script_language(F.col("arabic"), F.col("latin")))


def q_token_estimate(spark: SparkSession, root: str) -> DataFrame:
    b = table(spark, root, "blocks").dropDuplicates(["doc_id", "id"])
    return b.select("doc_id", "id", F.coalesce(text.estimate_tokens(F.col("text")), F.lit(0)).alias("tokens"))


def q_keyword_lists(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "enterprises").dropDuplicates(["id"])
    return e.select("id", F.array_join(text.keep_first(F.col("keywords")), "§").alias("keywords"))


def q_page_numbers(spark: SparkSession, root: str) -> DataFrame:
    b = table(spark, root, "blocks").dropDuplicates(["doc_id", "id"])
    return b.where(text.is_page_number(F.col("text"))).select("doc_id", "id")


def q_block_types(spark: SparkSession, root: str) -> DataFrame:
    labels = spark.createDataFrame([(x,) for x in [*text.BLOCK_TYPE_OF_LABEL, "algorithm", "aside_text", "unheard"]], "label string")
    return labels.select("label", text.block_type(F.col("label")).alias("type"), text.title_level(F.col("label")).alias("level"), F.col("label").isin(*text.FURNITURE_LABELS).alias("is_furniture"))


def q_size_labels(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "offer_files").dropDuplicates(["id"])
    return f.select("id", text.size_label(F.col("size")).alias("label"))


def q_point_ids(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "offers")
    return o.select("offer_row", ids.point_id(F.col("consultation_id"), F.col("org_acronyme")).alias("point_id"))


def q_content_hash(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "offers").withColumn("deadline", dates.parse_deadline(F.col("date_limite")))
    return o.select("offer_row", ids.content_hash(F.col("objet"), F.col("categorie"), F.col("lieu_execution"), ids.epoch_text(F.col("deadline"))).alias("hash"))


def q_storage_keys(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "offer_documents")
    return d.select("consultation_id", "org_acronyme").distinct().select("*", ids.storage_key(F.col("consultation_id"), F.col("org_acronyme")).alias("storage_key"))


def q_allowed_urls(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "offers")
    # the test tables' addresses are on a host of their own
    return o.select("offer_row", ids.allowed_url(F.col("source_url"), (*ids.ALLOWED_HOSTS, "portail.example")).alias("allowed"))


def q_media_types(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "offer_files").dropDuplicates(["id"])
    guessed = ids.media_type(F.col("relative_path"))
    inline = guessed.rlike("^(application/pdf$|image/|text/)") & (guessed != "text/html")
    return f.select("id", guessed.alias("guessed"), inline.alias("inline"), (guessed == F.col("media_type")).alias("as_told"))


def q_parse_deadline(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "offers")
    return o.select("offer_row", dates.parse_deadline(F.col("date_limite")).alias("deadline"))


def q_deadline_urgency(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "offers").withColumn("shown", dates.shown_deadline(F.col("date_limite"))).withColumn("days", dates.days_left(F.col("shown")))
    return o.select("offer_row", "shown", "days", dates.urgency(F.col("days")).alias("urgency"), dates.urgency_detail(F.col("days")).alias("detail"), dates.tone(F.col("days")).alias("tone"))


def q_active_offers(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "offers").where(F.trim("objet") != "").withColumn("deadline", dates.parse_deadline(F.col("date_limite")))
    return o.where(dates.active(F.col("deadline"))).select("offer_row", "objet", "deadline")


def q_offer_payload(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "offers").where(F.trim("objet") != "")
    return o.select(
        "offer_row",
        ids.point_id(F.col("consultation_id"), F.col("org_acronyme")).alias("offer_id"),
        text.normalize_text(F.col("categorie")).alias("category"),
        F.coalesce(F.nullif(F.trim("categorie"), F.lit("")), F.lit("autre")).alias("category_display"),
        F.col("acheteur_public").alias("buyer"),
        F.col("lieu_execution").alias("location_display"),
        text.collapse(F.col("objet")).alias("search_text"),
    )


def q_block_json(spark: SparkSession, root: str) -> DataFrame:
    b = table(spark, root, "blocks").dropDuplicates(["doc_id", "id"])
    return b.select("doc_id", "id", F.to_json(F.struct("id", "type", "page", "level")).alias("json"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}


# ---------------------------------------------------------------- SQL


def _compat() -> tuple[str, str]:
    pairs = []
    for lo, hi in text.FOLDED_BLOCKS:
        for code in range(lo, hi + 1):
            ch = chr(code)
            if unicodedata.decomposition(ch).startswith("<") and len(out := text.fold_char(ch)) == 1:
                pairs.append((ch, out))
    return "".join(a for a, _ in pairs).replace("'", "''"), "".join(b for _, b in pairs).replace("'", "''")


def sql_normal(expr: str) -> str:
    """The normal form in DuckDB: compatibility characters, then accents and case."""
    source, target = _compat()
    out = f"coalesce({expr}, '')"
    for ch in text.LETTER_GROUPS:
        folded = text.fold_char(ch)
        if len(folded) > 1:
            out = f"replace({out}, '{ch}', '{folded}')"
    return f"trim(regexp_replace(strip_accents(lower(translate({out}, '{source}', '{target}'))), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


SPACES = r"[\s\x{B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_LOCAL = r"""coalesce(
    CASE WHEN regexp_full_match(trim(date_limite), '\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}') THEN try_strptime(trim(date_limite), '%d/%m/%Y %H:%M') END,
    CASE WHEN regexp_full_match(trim(date_limite), '\d{1,2}/\d{1,2}/\d{4}') THEN try_strptime(trim(date_limite), '%d/%m/%Y') END)"""
# DuckDB takes the later of two instants with one local time; the earlier one is meant
SQL_DEADLINE = f"""(CASE WHEN (({_LOCAL} AT TIME ZONE 'Africa/Casablanca') - INTERVAL 1 HOUR) AT TIME ZONE 'Africa/Casablanca' = {_LOCAL}
    THEN epoch(({_LOCAL} AT TIME ZONE 'Africa/Casablanca') - INTERVAL 1 HOUR) ELSE epoch({_LOCAL} AT TIME ZONE 'Africa/Casablanca') END)::BIGINT"""
_NOW = dates.now_seconds()
_UUID = """lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
    CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '1' THEN '9' WHEN '2' THEN 'a' WHEN '3' THEN 'b' WHEN '4' THEN '8' WHEN '5' THEN '9' WHEN '6' THEN 'a' WHEN '7' THEN 'b'
    WHEN '8' THEN '8' WHEN '9' THEN '9' WHEN 'a' THEN 'a' WHEN 'b' THEN 'b' WHEN 'c' THEN '8' WHEN 'd' THEN '9' WHEN 'e' THEN 'a' ELSE 'b' END
    || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""
_POINT_HASH = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('marchespublics.ma:' || coalesce(consultation_id, '') || ':' || coalesce(org_acronyme, '')))"
_B = "(SELECT DISTINCT ON (doc_id, id) * FROM blocks)"

ORACLES = {
    "normalize_text": f"SELECT offer_row, {sql_normal('objet')} AS n_objet, {sql_normal('acheteur_public')} AS n_acheteur_public, {sql_normal('procedure')} AS n_procedure FROM offers",
    "normalize_locations": f"""
        WITH p AS (
            SELECT offer_row, unnest(list_concat([lieu_execution], regexp_split_to_array(lieu_execution, '[,;/|\\-–—]'))) AS part,
                   unnest(range(0, len(regexp_split_to_array(lieu_execution, '[,;/|\\-–—]')) + 1)) AS n
            FROM offers WHERE lieu_execution IS NOT NULL
        ), x AS (SELECT offer_row, n, regexp_replace({sql_normal('part')}, '^(region|prefecture|province)\\s+(de|d'')\\s+', '') AS v FROM p),
        y AS (SELECT offer_row, v, min(n) AS n FROM x WHERE v NOT IN ('', 'maroc') GROUP BY 1, 2)
        SELECT o.offer_row, coalesce(string_agg(v, '§' ORDER BY n), '') AS locations FROM offers o LEFT JOIN y USING (offer_row) GROUP BY 1
    """,
    "document_type": f"""
        SELECT DISTINCT id, CASE WHEN contains(s, 'reglement') THEN 'regulation' WHEN contains(s, 'complement') THEN 'complement' WHEN contains(s, 'avis') THEN 'notice'
            WHEN contains(s, 'dce') OR contains(s, 'dossier') THEN 'dossier'
            WHEN contains(p, '.') THEN lower(regexp_extract(p, '\\.([^.]*)$', 1)) ELSE 'document' END AS kind
        FROM (SELECT id, {sql_normal("concat_ws(' ', name, url)")} AS s, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM offer_documents)
    """,
    "slugify": r"""
        SELECT DISTINCT id, CASE WHEN length(f) <= 150 THEN f ELSE substr(f, 1, 146) || '.pdf' END AS file_name FROM (
            SELECT id, CASE WHEN ends_with(lower(n), '.pdf') THEN n ELSE n || '.pdf' END AS f FROM (
                SELECT id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(name, ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'document') AS n FROM offer_documents))
    """,
    "collapse": f"SELECT doc_id, md5(trim(regexp_replace(text, '{SPACES}', ' ', 'g'))) AS digest FROM documents",
    "clean_cell": f"""
        SELECT doc_id, id, n, trim(regexp_replace(regexp_replace(regexp_replace(replace(cell, chr(10), ' '), '\\$\\s*\\\\times\\s*\\$', 'x', 'g'), '\\$\\s*([^$]*?)\\s*\\$', '\\1', 'g'), '{SPACES}', ' ', 'g')) AS cell FROM (
            SELECT doc_id, id, unnest(string_split(text, '|')) AS cell, unnest(range(0, len(string_split(text, '|'))))::INT AS n FROM {_B} WHERE type = 'table')
    """,
    "script_language": r"""
        SELECT doc_id, arabic, latin, CASE WHEN arabic + latin = 0 THEN 'fr' WHEN arabic / (arabic + latin) > 0.85 THEN 'ar' WHEN arabic / (arabic + latin) < 0.15 THEN 'fr' ELSE 'mixed' END AS language
        FROM (SELECT doc_id, coalesce(length(regexp_replace(regexp_replace(text, '[^\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]', '', 'g'), '[^\p{L}]', '', 'g')), 0)::INT AS arabic,
                     coalesce(length(regexp_replace(regexp_replace(text, '[^\p{Latin}]', '', 'g'), '[^\p{L}]', '', 'g')), 0)::INT AS latin FROM documents)
    """,
    "token_estimate": f"SELECT doc_id, id, CASE WHEN length(text) > 0 THEN greatest(1, round(length(text) / 3.5)::INT) ELSE 0 END AS tokens FROM {_B}",
    "keyword_lists": f"""
        WITH k AS (SELECT id, unnest(keywords) AS w, unnest(range(0, len(keywords))) AS n FROM (SELECT DISTINCT ON (id) * FROM enterprises) WHERE keywords IS NOT NULL),
        c AS (SELECT id, n, trim(regexp_replace(w, '{SPACES}', ' ', 'g')) AS w FROM k),
        r AS (SELECT *, row_number() OVER (PARTITION BY id, lower(w) ORDER BY n) AS rn FROM c WHERE w <> '')
        SELECT e.id, coalesce(string_agg(w, '§' ORDER BY n), '') AS keywords FROM (SELECT DISTINCT id FROM enterprises) e LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (id) GROUP BY 1
    """,
    "page_numbers": rf"""
        SELECT doc_id, id FROM {_B} WHERE trim(text) <> '' AND length(trim(text)) <= 24 AND regexp_matches(trim(text), '(?i)^(page|p\.?|pg\.?)?\s*[\[\(\-–—]*\s*[\divxlcdm]+\s*(/|sur|of|de)?\s*[\divxlcdm]*\s*[\]\)\-–—.]*$')
    """,
    "block_types": "SELECT * FROM (VALUES " + ", ".join(
        f"('{x}', '{text.BLOCK_TYPE_OF_LABEL.get(x, 'other')}', {text.TITLE_LEVEL_OF_LABEL.get(x, 3) if text.BLOCK_TYPE_OF_LABEL.get(x) == 'title' else 'NULL'}, {x in text.FURNITURE_LABELS})"
        for x in [*text.BLOCK_TYPE_OF_LABEL, "algorithm", "aside_text", "unheard"]
    ) + ") AS t(label, type, level, is_furniture)",
    "size_labels": """
        SELECT id, CASE WHEN size IS NULL THEN '' WHEN size < 1048576 THEN greatest(1, floor(size / 1024 + 0.5)::BIGINT) || ' Ko'
            ELSE printf('%.1f', size / 1048576) || ' Mo' END AS label FROM (SELECT DISTINCT ON (id) * FROM offer_files)
    """,
    "point_ids": f"SELECT offer_row, {_UUID} AS point_id FROM (SELECT offer_row, {_POINT_HASH} AS h FROM offers)",
    "content_hash": f"""
        SELECT offer_row, sha256('1' || chr(31) || coalesce(objet, '') || chr(31) || coalesce(categorie, '') || chr(31) || coalesce(lieu_execution, '') || chr(31) || coalesce(d || '.0', '')) AS hash
        FROM (SELECT *, {SQL_DEADLINE} AS d FROM offers)
    """,
    "storage_keys": "SELECT *, substr(sha256(encode(coalesce(consultation_id, '')) || unhex('00') || encode(coalesce(org_acronyme, ''))), 1, 24) AS storage_key FROM (SELECT DISTINCT consultation_id, org_acronyme FROM offer_documents)",
    "allowed_urls": "SELECT offer_row, coalesce(regexp_full_match(source_url, 'https://(www\\.)?(marchespublics\\.gov\\.ma|portail\\.example)([/?#:].*)?') AND NOT starts_with(source_url, 'https://www.portail'), false) AS allowed FROM offers",
    "media_types": "WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ids.MEDIA_TYPES.items()) + """) AS t(ext, kind))
        SELECT id, coalesce(kind, 'application/octet-stream') AS guessed,
               (coalesce(kind, '') = 'application/pdf' OR starts_with(coalesce(kind, ''), 'image/') OR (starts_with(coalesce(kind, ''), 'text/') AND kind <> 'text/html')) AS inline,
               coalesce(kind, 'application/octet-stream') = media_type AS as_told
        FROM (SELECT DISTINCT ON (id) * FROM offer_files) f LEFT JOIN m ON m.ext = lower(regexp_extract(relative_path, '\\.([A-Za-z0-9]+)$', 1))
    """,
    "parse_deadline": f"SELECT offer_row, {SQL_DEADLINE} AS deadline FROM offers",
    "deadline_urgency": rf"""
        WITH m AS (SELECT offer_row, regexp_extract(date_limite, '(\d{{2}})/(\d{{2}})/(\d{{4}})(?:\s+(\d{{2}}):(\d{{2}}))?', ['d', 'm', 'y', 'h', 'i']) AS p FROM offers),
        g AS (SELECT offer_row, CASE WHEN p.y <> '' THEN epoch(make_date(nullif(p.y, '')::INT, 1, 1)::TIMESTAMP + to_months(nullif(p.m, '')::INT - 1) + to_days(nullif(p.d, '')::INT - 1))::BIGINT
                + coalesce(nullif(p.h, '')::INT, 23) * 3600 + coalesce(nullif(p.i, '')::INT, 59) * 60 END AS g FROM m),
        s AS (SELECT offer_row, 2 * g - epoch(to_timestamp(g) AT TIME ZONE 'Africa/Casablanca')::BIGINT AS shown FROM g),
        x AS (SELECT *, ceil((shown - {_NOW}) / 86400.0)::INT AS days FROM s)
        SELECT offer_row, shown, days, CASE WHEN days <= 1 THEN 'Dernier jour' WHEN days <= 30 THEN days || ' jours restants' ELSE '' END AS urgency,
               CASE WHEN days IS NULL THEN '' WHEN days <= 1 THEN 'Dernier jour' WHEN days <= 30 THEN days || ' jours restants' ELSE 'Offre active' END AS detail,
               CASE WHEN days <= 1 THEN 'chip-error' WHEN days <= 7 THEN 'chip-warning' WHEN days IS NOT NULL THEN 'chip-neutral' END AS tone FROM x
    """,
    "active_offers": f"SELECT * FROM (SELECT offer_row, objet, {SQL_DEADLINE} AS deadline FROM offers WHERE trim(objet) <> '') WHERE deadline > {_NOW}",
    "offer_payload": f"""
        SELECT offer_row, {_UUID} AS offer_id, {sql_normal('categorie')} AS category, coalesce(nullif(trim(categorie), ''), 'autre') AS category_display,
               acheteur_public AS buyer, lieu_execution AS location_display, trim(regexp_replace(objet, '{SPACES}', ' ', 'g')) AS search_text
        FROM (SELECT *, {_POINT_HASH} AS h FROM offers WHERE trim(objet) <> '')
    """,
    "block_json": f"""
        SELECT doc_id, id, '{{"id":"' || id || '","type":"' || type || '","page":' || page || CASE WHEN level IS NULL THEN '' ELSE ',"level":' || level END || '}}' AS json FROM {_B}
    """,
}
