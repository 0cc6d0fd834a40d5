"""Members of ZIP archives read as rows, with guards."""

from __future__ import annotations

import hashlib
import io
import posixpath
import stat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MOST_MEMBERS, MOST_BYTES = 1000, 250 * 1024 * 1024
MEMBER = "archive string, path string, size bigint, sha256 string, problem string"


def safe_path(path: str) -> str | None:
    """The normalised relative path, or None for absolute and climbing ones."""
    plain = path.replace("\\", "/")
    if plain.startswith("/") or (len(plain) > 1 and plain[1] == ":"):
        return None
    parts = [p for p in plain.split("/") if p not in ("", ".")]
    return None if not parts or ".." in parts else posixpath.join(*parts)


def read_members(name: str, content: bytes, most: int = MOST_MEMBERS, most_bytes: int = MOST_BYTES) -> list[tuple]:
    """(archive, path, size, sha256, problem) of each file; an archive that breaks a guard is one row with the problem."""

    def refuse(problem: str) -> list[tuple]:
        return [(name, None, None, None, problem)]

    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return refuse("not an archive")
    infos = [i for i in archive.infolist() if not i.is_dir()]
    if not infos:
        return refuse("empty")
    if len(infos) > most:
        return refuse("too many members")
    if sum(i.file_size for i in infos) > most_bytes:
        return refuse("too large")
    seen: set[str] = set()
    out, total = [], 0
    for info in infos:
        path = safe_path(info.filename)
        if path is None:
            return refuse("unsafe path")
        if stat.S_ISLNK(info.external_attr >> 16):
            return refuse("symbolic link")
        if path.casefold() in seen:
            return refuse("duplicate path")
        seen.add(path.casefold())
        digest, size = hashlib.sha256(), 0
        with archive.open(info) as member:
            while part := member.read(1 << 20):
                size += len(part)
                total += len(part)
                if total > most_bytes:  # stated sizes may lie
                    return refuse("too large")
                digest.update(part)
        out.append((name, path, size, digest.hexdigest(), None))
    return out


def members(archives: DataFrame, most: int = MOST_MEMBERS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of ``archives`` (path, content), as ``spark.read.format('binaryFile')`` gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [x for n, c in batch.itertuples(index=False) for x in read_members(n, bytes(c), most, most_bytes)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBER.split(", ")])

    return archives.select("path", "content").mapInPandas(run, MEMBER)
