import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quaestor.runtime import ship_package  # noqa: E402

SCHEMAS = {
    "offers": "offer_row bigint, consultation_id string, org_acronyme string, reference string, objet string, procedure string, categorie string, acheteur_public string, lieu_execution string, date_publication string, date_limite string, source_url string, last_seen_run_id string, first_seen_at string, ingested_at timestamp, swept_at timestamp",
    "offer_documents": "id bigint, consultation_id string, org_acronyme string, name string, url string, file_type string, download_attempted_at string, download_error string, ingested_at timestamp, swept_at timestamp",
    "offer_files": "id bigint, offer_document_id bigint, consultation_id string, org_acronyme string, name string, relative_path string, media_type string, size bigint, sha256 string, created_at string, ingested_at timestamp, swept_at timestamp",
    "enterprises": "id string, enterprise_name string, description string, keywords array<string>, categories array<string>, locations array<string>, portal_download_consent boolean, created_at string",
    "doc_pages": "doc_id bigint, page int, width double, height double, is_scanned boolean, language_hint string, n_blocks int",
    "blocks": "doc_id bigint, id string, type string, page int, ord int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string, level int, is_furniture boolean, section_path array<string>, token_estimate int, confidence double",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, doc_type string, consultation_id string, org_acronyme string, fetched_at timestamp",
    "places": "place_id bigint, name string, name_ar string, kind string, region string",
    "held_out": "item_id bigint, text string, lang string, task string",
}
#: Names that operators use inside; every fixture table carries them as well.
CLASHING = "word string, key string, shape string, utc string, zone string, year int, piece_no int, normal string, n int, score double, head string, rank int"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def make_root(spark, tmp_path):
    """make_root(offers=[{...}], ...) -> folder with all tables; those not given are empty."""

    def build(**tables):
        for name, schema in SCHEMAS.items():
            own = {c.split()[0] for c in schema.split(", ")}
            extra = [c for c in CLASHING.split(", ") if c.split()[0] not in own]
            kind = spark.createDataFrame([], ", ".join([schema, *extra])).schema
            columns = [f.name for f in kind.fields]
            known = set(columns)
            rows = []
            for given in tables.get(name, []):
                assert set(given) <= known, set(given) - known
                rows.append(tuple(given.get(c) for c in columns))
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return build


def at(text):
    return dt.datetime.fromisoformat(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
