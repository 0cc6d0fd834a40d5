"""Identifiers, hashes and addresses as Column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_VERSION = "1"
# Hosts that addresses may name.
ALLOWED_HOSTS = ("marchespublics.gov.ma", "www.marchespublics.gov.ma")

# Media types by extension.
MEDIA_TYPES = {
    "pdf": "application/pdf", "zip": "application/zip", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "txt": "text/plain", "csv": "text/csv", "html": "text/html",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "dwg": "image/vnd.dwg", "rar": "application/vnd.rar", "7z": "application/x-7z-compressed",
}


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """RFC 4122 version 5 identifier of a name, from SHA-1 in the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def point_id(consultation_id: Column, organisation: Column) -> Column:
    """Identifier of an offer in the search index."""
    return uuid5(F.concat_ws(":", F.lit("marchespublics.ma"), F.coalesce(consultation_id, F.lit("")), F.coalesce(organisation, F.lit(""))))


def epoch_text(seconds: Column) -> Column:
    """Whole seconds as a decimal number with one zero; '' for null."""
    return F.coalesce(F.concat(seconds.cast("long").cast("string"), F.lit(".0")), F.lit(""))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, nulls as '', joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", F.lit(INDEX_VERSION), *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def storage_key(consultation_id: Column, organisation: Column) -> Column:
    """First 24 hexadecimal digits of the key's SHA-256."""
    return F.substring(F.sha2(F.concat(F.coalesce(consultation_id, F.lit("")), F.lit("\0"), F.coalesce(organisation, F.lit(""))), 256), 1, 24)


def allowed_url(url: Column, hosts: tuple[str, ...] = ALLOWED_HOSTS) -> Column:
    """Whether an address is https on one of the hosts; null and garbage are not."""
    return F.coalesce(
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts), F.lit(False)
    )


def media_type(path: Column) -> Column:
    """Media type by the extension of a path."""
    pairs = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.element_at(pairs, extension), F.lit("application/octet-stream"))


def archive_like(content: Column, content_type: Column) -> Column:
    """Whether bytes begin as a ZIP archive or are said to be one."""
    return F.coalesce(F.substring(F.hex(F.substring(content, 1, 2)), 1, 4) == "504B", F.lit(False)) | F.coalesce(F.lower(content_type).contains("zip"), F.lit(False))


def pdf_like(content: Column) -> Column:
    """Whether bytes begin as a PDF file."""
    return F.coalesce(F.hex(F.substring(content, 1, 5)) == "255044462D", F.lit(False))


def detail_address(consultation_id: Column, organisation: Column) -> Column:
    """Address of an offer's page, its parts encoded."""
    return F.concat(
        F.lit("https://www.marchespublics.gov.ma/index.php?page=entreprise.EntrepriseDetailConsultation&refConsultation="),
        F.url_encode(F.coalesce(consultation_id, F.lit(""))), F.lit("&orgAcronyme="), F.url_encode(F.coalesce(organisation, F.lit(""))),
    )
