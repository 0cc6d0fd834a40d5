"""Queries of retrieval: over the documents and vectors, and enterprises against offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.functions import dates, ids, text
from quaestor.functions.text import normalize_locations, normalize_text
from quaestor.operators import bags, cdc
from quaestor.operators import retrieval as r
from quaestor.plans.scalars import ORACLES as ORACLES_OF_SCALARS
from quaestor.plans.scalars import SQL_DEADLINE, sql_normal
from quaestor.runtime import spread, table, written


#: Searches take every row whose id is divisible by this as a query, against all rows.
QUERY_STEP = 20


def bm25_statistics(spark: SparkSession, root: str) -> DataFrame:
    """(term, df, tf, most) of the documents."""
    tokens = table(spark, root, "documents").select("doc_id", r.terms(F.col("text")).alias("t"))
    posts = tokens.select("doc_id", F.explode("t").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("most"))


def _lexical(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", r.terms(F.col("text")).alias("terms"))
    queries = docs.where(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("query_id"), F.array_distinct("terms").alias("terms"))
    return bags.search(docs, queries, "doc_id", "query_id")


def _dense(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    queries = vectors.where((F.col("doc_id") % QUERY_STEP == 0) & F.col("vector").isNotNull()).withColumnRenamed("doc_id", "query_id")
    return r.search(spread(vectors, "doc_id", rows_per_task=r.ROWS_PER_TASK), queries, "doc_id", "query_id")


def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    """The best documents for every twentieth document's text, itself among them."""
    return _lexical(spark, root).select("query_id", "doc_id", "score", "rank")


def cosine_topk(spark: SparkSession, root: str) -> DataFrame:
    """The nearest vectors of every twentieth vector."""
    return _dense(spark, root).select("query_id", "doc_id", "score", "rank")


def hybrid_documents(spark: SparkSession, root: str) -> DataFrame:
    """Both legs fused; vectors belong to documents by ``vec_id = doc_id``."""
    return r.fuse(_lexical(spark, root).unionByName(_dense(spark, root)), "query_id", "doc_id").select("query_id", "doc_id", "score", "rank")


def _offers(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "offers").select("consultation_id", "org_acronyme", "offer_row", "objet", "categorie", "lieu_execution", "date_limite", "acheteur_public", "reference", "date_publication", "source_url", "ingested_at", "swept_at")
    current = cdc.newest_per_key(rows, ["consultation_id", "org_acronyme"], ["ingested_at", "offer_row"])
    return current.where("swept_at IS NULL AND trim(objet) <> ''").withColumn("deadline", dates.parse_deadline(F.col("date_limite"))).where(dates.active(F.col("deadline")))


def _profiles(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "enterprises").dropDuplicates(["id"]).where(F.size("keywords") > 0).select(
        "id", "keywords", F.transform("keywords", normalize_text).alias("plain_keywords"),
        F.array_distinct(r.terms(F.array_join("keywords", " "))).alias("terms"),
        F.transform("categories", normalize_text).alias("wanted"),
        F.array_distinct(F.flatten(F.transform("locations", normalize_locations))).alias("near"),
    )


def top_matches(spark: SparkSession, root: str) -> DataFrame:
    """Flagship: up to ten active offers per enterprise, by both legs, location filter first, then without it, with reasons.

    The current offers are written once; the search and what is shown are read from there.
    Vectors come from the built-in encoder, as no trained one is at hand.
    """
    offers = written(
        _offers(spark, root).select(
            "offer_row", "objet", "reference", "acheteur_public", "lieu_execution", "deadline", "date_publication", "date_limite", "source_url", "consultation_id", "org_acronyme", "categorie",
            normalize_text(F.col("categorie")).alias("category"),
            normalize_locations(F.col("lieu_execution")).alias("places"),
            normalize_text(F.col("objet")).alias("plain_objet"),
        )
    )
    profiles = written(_profiles(spark, root))
    docs = spread(offers.select("offer_row", r.terms(F.col("objet")).alias("terms"), "category", "places"), "offer_row", rows_per_task=r.ROWS_PER_TASK)
    found = r.search(docs, profiles.select("id", "terms", "wanted", "near"), "offer_row", "id", encode=r.hashed_trigrams)
    best = r.tiered(r.fuse(found, "id", "offer_row"), "id", "offer_row")
    shown = best.join(profiles.drop("terms"), "id").join(offers, "offer_row")
    why = r.reasons_of(*[F.col(c) for c in ("keywords", "plain_keywords", "wanted", "near", "plain_objet", "category", "places")])
    return shown.select(
        "id", "offer_row", "position", "tier", "score", F.array_join(why, "§").alias("reasons"), "reference", "category", "deadline",
        ids.point_id(F.col("consultation_id"), F.col("org_acronyme")).alias("offer_id"), "objet", F.col("acheteur_public").alias("buyer"), F.col("lieu_execution").alias("location"), "date_publication", "source_url",
    )


def match_dashboard(spark: SparkSession, root: str) -> DataFrame:
    """The matches as an enterprise looks through them: without dismissed ones, saved ones first, deadlines ahead.

    Dismissed are offers withdrawn before, saved those with documents. The rank of the match
    is kept; positions are given for both orders, equal deadlines by rank, missing ones last.
    """
    matches = top_matches(spark, root)
    key = ["consultation_id", "org_acronyme"]
    by_offer = table(spark, root, "offers").select("offer_row", *key, "swept_at")
    dismissed = by_offer.join(by_offer.where("swept_at IS NOT NULL").select(*key).distinct(), key, "left_semi").select("offer_row")
    saved = by_offer.join(table(spark, root, "offer_documents").select(*key).distinct(), key, "left_semi").select("offer_row", F.lit(True).alias("saved"))
    kept = matches.join(dismissed, "offer_row", "left_anti").join(saved, "offer_row", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))
    shown = kept.withColumn("days", dates.days_left(F.col("deadline"))).withColumnRenamed("position", "original_rank")
    by_deadline = F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("deadline"), "original_rank"))
    by_saved = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("saved"), "original_rank"))
    return shown.select("id", "offer_row", "original_rank", "saved", by_deadline.alias("deadline_position"), by_saved.alias("saved_position"), dates.urgency(F.col("days")).alias("urgency"), text.translated_reasons(F.col("reasons")).alias("reasons_shown"))


def offer_dashboard(spark: SparkSession, root: str) -> DataFrame:
    """Offers of a category that hold a word, with the key they are shown by: the deadline, missing last."""
    o = table(spark, root, "offers").withColumn("deadline", dates.parse_deadline(F.col("date_limite")))
    hay = normalize_text(F.concat_ws(" ", "objet", "acheteur_public", "reference"))
    kept = o.where((normalize_text(F.col("categorie")) == "travaux") & hay.contains("renovation"))
    return kept.select("offer_row", "deadline", F.coalesce("deadline", F.lit(1 << 40)).alias("sort_key"))


QUERIES = {f.__name__: f for f in (top_matches, match_dashboard, bm25_statistics, bm25_topk, cosine_topk, hybrid_documents, offer_dashboard)}

_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
_WEIGHT = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 256.0))"
_DOC_POSTINGS = f"""
    t AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents),
    p AS (SELECT doc_id, term, length, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t) GROUP BY ALL)
"""
_BM25 = f"""
    {_DOC_POSTINGS}, q AS (SELECT DISTINCT doc_id AS query_id, term FROM p WHERE doc_id % 20 = 0),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM documents WHERE doc_id IS NOT NULL),
    s AS (SELECT query_id, doc_id, round(sum({_WEIGHT}), 6) AS score FROM p JOIN d USING (term) JOIN q USING (term), n GROUP BY 1, 2),
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s QUALIFY rank < 50)
"""
_COSINE = """
    c AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
          FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q),
    vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM c QUALIFY rank < 50)
"""


def _sql_places(source: str, key: str, value: str) -> str:
    """(key, place) of the normalised parts of a value."""
    return f"""(SELECT DISTINCT {key}, regexp_replace({sql_normal('part')}, '^(region|prefecture|province)\\s+(de|d'')\\s+', '') AS place
        FROM (SELECT {key}, unnest(list_concat([{value}], regexp_split_to_array({value}, '[,;/|\\-–—]'))) AS part FROM {source} WHERE {value} IS NOT NULL))"""


_MATCHES = f"""
    WITH o0 AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY consultation_id, org_acronyme ORDER BY ingested_at DESC, offer_row DESC) = 1),
    o AS (SELECT *, {sql_normal('categorie')} AS category FROM (SELECT *, {SQL_DEADLINE} AS deadline FROM o0 WHERE swept_at IS NULL AND trim(objet) <> '') WHERE deadline > {dates.now_seconds()}),
    e AS (SELECT DISTINCT ON (id) * FROM enterprises WHERE len(keywords) > 0),
    t AS (SELECT offer_row, {_TOKENS.format('objet')} AS w FROM o),
    p AS (SELECT offer_row, term, length, count(*) AS tf FROM (SELECT offer_row, len(w) AS length, unnest(w) AS term FROM t) GROUP BY ALL),
    q AS (SELECT DISTINCT id, unnest({_TOKENS.format("array_to_string(keywords, ' ')")}) AS term FROM e),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM o),
    s AS (SELECT id, offer_row, round(sum({_WEIGHT}), 6) AS score FROM p JOIN d USING (term) JOIN q USING (term), n GROUP BY 1, 2),
    cats AS (SELECT id, {sql_normal('c')} AS category FROM (SELECT id, unnest(categories) AS c FROM e)),
    near AS (SELECT DISTINCT id, place FROM {_sql_places("(SELECT id, unnest(locations) AS v FROM e)", "id", "v")} WHERE place NOT IN ('', 'maroc')),
    places AS (SELECT offer_row, place FROM {_sql_places("o", "offer_row", "lieu_execution")} WHERE place NOT IN ('', 'maroc')),
    common AS (SELECT n.id, p.offer_row, min(place) AS place FROM near n JOIN places p USING (place) GROUP BY 1, 2),
    g AS (SELECT DISTINCT term, unnest([substr('^' || term || '$', k, 3) FOR k IN range(1, length(term) + 1)]) AS gram, unnest(range(1, length(term) + 1)) AS at FROM (SELECT unnest(w) AS term FROM t UNION SELECT term FROM q)),
    h AS (SELECT term, ('0x' || substr(md5(gram), 1, 4))::INT % 256 AS dim, CASE WHEN substr(md5(gram), 5, 1) < '8' THEN 1 ELSE -1 END AS sign FROM g),
    ov AS (SELECT offer_row, dim, sum(sign) AS v FROM (SELECT DISTINCT offer_row, term FROM p) JOIN h USING (term) GROUP BY 1, 2),
    ev AS (SELECT id, dim, sum(sign) AS v FROM q JOIN h USING (term) GROUP BY 1, 2),
    o_norm AS (SELECT offer_row, sqrt(sum(v * v)) AS n FROM ov GROUP BY 1 HAVING sum(v * v) > 0), e_norm AS (SELECT id, sqrt(sum(v * v)) AS n FROM ev GROUP BY 1 HAVING sum(v * v) > 0),
    dots AS (SELECT id, offer_row, sum(ev.v * ov.v) AS dot FROM ev JOIN ov USING (dim) GROUP BY 1, 2),
    dense AS (SELECT e.id, o.offer_row, round(coalesce(dot, 0) / (e.n * o.n), 6) AS score FROM e_norm e CROSS JOIN o_norm o LEFT JOIN dots USING (id, offer_row)),
    legs AS (SELECT 'lexical' AS leg, * FROM s UNION ALL SELECT 'dense', * FROM dense),
    f AS (SELECT s.*, o.category, EXISTS (SELECT 1 FROM near WHERE near.id = s.id) AS has_near, c.place
          FROM legs s JOIN o USING (offer_row) LEFT JOIN common c ON c.id = s.id AND c.offer_row = s.offer_row
          WHERE NOT EXISTS (SELECT 1 FROM cats WHERE cats.id = s.id) OR (s.id, o.category) IN (SELECT (id, category) FROM cats)),
    tiers AS (SELECT *, 0 AS tier FROM f WHERE NOT has_near OR place IS NOT NULL UNION ALL SELECT *, 1 FROM f WHERE has_near),
    top50 AS (SELECT *, row_number() OVER (PARTITION BY id, leg, tier ORDER BY score DESC, offer_row) - 1 AS r FROM tiers QUALIFY r < 50),
    rrf AS (SELECT id, tier, offer_row, any_value(category) AS category, any_value(place) AS place, round(sum(1.0::DOUBLE / (2 + r)), 6) AS score FROM top50 GROUP BY 1, 2, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id, tier ORDER BY score DESC, offer_row) - 1 AS rank FROM rrf QUALIFY rank < 10),
    best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY id, offer_row ORDER BY tier, rank) = 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, rank) AS position FROM best QUALIFY position <= 10),
    kw AS (SELECT b.id, b.offer_row, k.n, k.w FROM placed b JOIN o USING (offer_row)
           JOIN (SELECT id, unnest(keywords) AS w, unnest(range(0, len(keywords))) AS n FROM e) k ON k.id = b.id
           WHERE contains({sql_normal('o.objet')}, {sql_normal('k.w')}) QUALIFY row_number() OVER (PARTITION BY b.id, b.offer_row ORDER BY k.n) <= 3),
    kws AS (SELECT id, offer_row, string_agg('Matched keyword: ' || w, '§' ORDER BY n) AS words FROM kw GROUP BY 1, 2)
    SELECT b.id, b.offer_row, b.position, b.tier, b.score,
           coalesce(nullif(concat_ws('§', k.words, CASE WHEN (b.id, b.category) IN (SELECT (id, category) FROM cats) THEN 'Matched category: ' || b.category END,
               CASE WHEN b.place IS NOT NULL THEN 'Matched location: ' || b.place END), ''), 'Semantic similarity with enterprise keywords') AS reasons,
           o.reference, b.category, o.deadline, x.point_id AS offer_id, o.objet, o.acheteur_public AS buyer, o.lieu_execution AS location, o.date_publication, o.source_url
    FROM placed b JOIN o USING (offer_row) LEFT JOIN kws k ON k.id = b.id AND k.offer_row = b.offer_row JOIN (__POINTS__) x ON x.offer_row = b.offer_row
""".replace("__POINTS__", ORACLES_OF_SCALARS["point_ids"])

_TRANSLATED = "reasons"
for _english, _french in text.REASON_WORDS:
    _TRANSLATED = f"regexp_replace({_TRANSLATED}, '(^|§){_english}', '\\1{_french}', 'gi')"

ORACLES = {
    "top_matches": _MATCHES,
    "match_dashboard": f"""
        WITH m AS ({_MATCHES}), gone AS (SELECT offer_row FROM offers WHERE (consultation_id, org_acronyme) IN (SELECT (consultation_id, org_acronyme) FROM offers WHERE swept_at IS NOT NULL AND consultation_id IS NOT NULL AND org_acronyme IS NOT NULL)),
        kept AS (SELECT offer_row FROM offers WHERE (consultation_id, org_acronyme) IN (SELECT (consultation_id, org_acronyme) FROM offer_documents WHERE consultation_id IS NOT NULL AND org_acronyme IS NOT NULL)),
        x AS (SELECT *, offer_row IN (SELECT offer_row FROM kept) AS saved, ceil((deadline - {dates.now_seconds()}) / 86400.0)::INT AS days FROM m WHERE offer_row NOT IN (SELECT offer_row FROM gone))
        SELECT id, offer_row, position AS original_rank, saved, row_number() OVER (PARTITION BY id ORDER BY deadline NULLS LAST, position) AS deadline_position,
               row_number() OVER (PARTITION BY id ORDER BY saved DESC, position) AS saved_position,
               CASE WHEN days <= 1 THEN 'Dernier jour' WHEN days <= 30 THEN days || ' jours restants' ELSE '' END AS urgency, {_TRANSLATED} AS reasons_shown FROM x
    """,
    "bm25_statistics": f"WITH {_DOC_POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(tf) AS most FROM p GROUP BY 1",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM lex",
    "cosine_topk": f"WITH {_COSINE} SELECT query_id, doc_id, score, rank FROM vec",
    "hybrid_documents": f"""
        WITH {_BM25}, {_COSINE}, u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (2 + rank) AS part FROM lex UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (2 + rank) FROM vec),
        g AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM u GROUP BY 1, 2)
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM g QUALIFY rank < 10
    """,
    "offer_dashboard": f"""
        SELECT offer_row, deadline, coalesce(deadline, 1099511627776) AS sort_key FROM (SELECT *, {SQL_DEADLINE} AS deadline FROM offers)
        WHERE {sql_normal('categorie')} = 'travaux' AND contains({sql_normal("concat_ws(' ', objet, acheteur_public, reference)")}, 'renovation')
    """,
}
