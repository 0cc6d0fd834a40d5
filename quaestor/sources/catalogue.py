"""A paged HTML catalogue as a Spark data source: one partition per page file.

``spark.dataSource.register(CatalogueSource)``, then
``spark.read.format("catalogue").option("path", folder).load()``. Each file is one result
page; its rows are the rows of the results table that name an offer. A page that states a
number other than its place in the folder fails the read, as a resumed scan must not skip
pages; so does a page without results table, offers or pager, and a folder with fewer pages
than its pager counts unless ``pages`` asks for fewer. ``after`` is the last page of an
earlier scan: those up to it are not read again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quaestor.sources.html import VOID

FIELDS = ("consultation_id", "org_acronyme", "reference", "objet", "procedure", "categorie", "acheteur_public", "lieu_execution", "date_publication", "date_limite", "source_url")
SCHEMA = "page int, pos int, " + ", ".join(f"{f} string" for f in FIELDS)

# How the catalogue marks its parts.
RESULTS, PAGE_NUMBER, PAGE_COUNT = "table-results", "ctl0_CONTENU_PAGE_resultSearch_numPageTop", "ctl0_CONTENU_PAGE_resultSearch_nombrePageTop"
KEYS = {"consultation_id": "$refCons", "org_acronyme": "$orgCons"}
#: field: (cell, part of an element's id)
MARKS = {
    "reference": (2, "_reference"), "objet": (2, "infosBullesObjet"), "acheteur_public": (2, "panelBlocDenomination"), "procedure": (1, "panelBlocTypesProc"),
    "categorie": (1, "panelBlocCategorie"), "lieu_execution": (3, "infosLieuExecution"),
}
IN_CHILD = ("objet", "lieu_execution")
CLOSING_CELL, CLOSING_CLASS, LEAST_CELLS = 4, "cloture-line", 6
ADDRESS, DETAIL = "https://www.marchespublics.gov.ma/index.php?", "entreprise.EntrepriseDetailConsultation"

_DATE, _TIME = re.compile(r"\d{2}/\d{2}/\d{4}"), re.compile(r"\d{2}:\d{2}")


class _Results(HTMLParser):
    """Texts of the marked elements of each row of the results table, as they stand open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.number: str | None = None
        self.count: list[str] | None = None
        self.found = False
        self.open: list[tuple[str, list[list[str]]]] = []
        self.table_at: int | None = None
        self.row: dict | None = None
        self.row_at = 0

    def _parts(self, tag: str, given: dict[str, str | None]) -> list[list[str]]:
        """The texts that what stands inside this element belongs to."""
        name, row = given.get("id") or "", self.row
        if name == PAGE_COUNT:
            self.count = []
            return [self.count]
        if row is None:
            return []
        if tag == "td" and len(self.open) == self.row_at + 1:
            row["cells"].append([])
            return [row["cells"][-1]]
        cell, parts = len(row["cells"]) - 1, []
        for field, (at, mark) in MARKS.items():
            if cell == at and mark in name and field not in row["texts"]:
                row["texts"][field] = []
                row["within"][len(self.open)] = field
                parts.append(row["texts"][field])
        # of some elements the first division inside counts, if there is one
        above = row["within"].get(len(self.open) - 1)
        if tag == "div" and above in IN_CHILD and above not in row["inner"]:
            row["inner"][above] = []
            parts.append(row["inner"][above])
        if cell == CLOSING_CELL and CLOSING_CLASS in (given.get("class") or "").split() and row["closing"] is None:
            row["closing"] = []
            parts.append(row["closing"])
        return parts

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag == "table" and not self.found and RESULTS in (given.get("class") or "").split():
            self.found, self.table_at = True, len(self.open)
        if tag == "tr" and self.table_at is not None and self.row is None:
            self.row, self.row_at = {"keys": {}, "cells": [], "texts": {}, "inner": {}, "within": {}, "closing": None}, len(self.open)
        if tag == "input":
            if given.get("id") == PAGE_NUMBER:
                self.number = given.get("value")
            for field, ending in KEYS.items():
                if self.row is not None and (given.get("name") or "").endswith(ending):
                    self.row["keys"].setdefault(field, (given.get("value") or "").strip())
        if tag not in VOID:
            self.open.append((tag, self._parts(tag, given)))

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is None:
            return
        del self.open[at:]
        if self.row is not None:
            self.row["within"] = {k: f for k, f in self.row["within"].items() if k < at}
            if at <= self.row_at:
                self.rows.append(self.row)
                self.row = None
        if self.table_at is not None and at <= self.table_at:
            self.table_at = None

    def handle_data(self, data: str) -> None:
        for _, parts in self.open:
            for part in parts:
                part.append(data)


def _plain(parts: list[str] | None) -> str:
    return " ".join("".join(parts or ()).split())


def _record(row: dict) -> dict[str, str]:
    if len(row["cells"]) < LEAST_CELLS:
        raise ValueError("offer row has too few columns")
    out = {f: row["keys"].get(f, "") for f in KEYS}
    if not all(out.values()):
        raise ValueError("offer without its key")
    out |= {f: _plain(row["inner"].get(f, row["texts"].get(f))) for f in MARKS}
    out["acheteur_public"] = re.sub(r"^Acheteur public\s*:\s*", "", out["acheteur_public"])
    first = lambda pattern, text: (pattern.search(text) or [""])[0]
    closing = _plain(row["closing"])
    out["date_publication"] = first(_DATE, _plain(row["cells"][1]))
    out["date_limite"] = " ".join(x for x in (first(_DATE, closing), first(_TIME, closing)) if x)
    out["source_url"] = ADDRESS + urlencode({"page": DETAIL, "refConsultation": out["consultation_id"], "orgAcronyme": out["org_acronyme"]})
    return out


def parse_page(html: str, expected: int | None = None) -> tuple[list[tuple], int, int]:
    """(rows in the order of ``SCHEMA``, page number, number of pages) of one result page."""
    reader = _Results()
    reader.feed(html)
    reader.close()
    offers = [r for r in reader.rows if r["keys"].get("consultation_id")]
    if not reader.found or not offers:
        raise ValueError("page without results" if reader.found else "page without a results table")
    if reader.number is None or reader.count is None:
        raise ValueError("page without a pager")
    number, count = int(reader.number), int(_plain(reader.count))
    if expected is not None and number != expected:
        raise ValueError(f"page {number} where {expected} was due")
    return [(number, pos, *(r[f] for f in FIELDS)) for pos, r in enumerate(map(_record, offers))], number, count


class _Page(InputPartition):
    def __init__(self, path: str, number: int, last: int | None):
        super().__init__(number)
        self.path, self.number, self.last = path, number, last


class _Reader(DataSourceReader):
    def __init__(self, folder: str, limit: int | None, after: int):
        names = sorted(n for n in os.listdir(folder) if n.endswith(".html"))
        stop = None if limit is None else after + limit
        self.pages = [_Page(os.path.join(folder, n), k, len(names) if limit is None else None) for k, n in enumerate(names, start=1)][after:stop]

    def partitions(self) -> list[_Page]:
        return self.pages

    def read(self, partition: _Page) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as page:
            rows, _, count = parse_page(page.read(), partition.number)
        if partition.last is not None and count != partition.last:
            raise ValueError(f"{partition.last} pages of {count}")
        yield from rows


class CatalogueSource(DataSource):
    """Options: ``path`` (a folder all executors see), ``pages`` (stop after so many), ``after`` (go on after that page)."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        limit = self.options.get("pages")
        return _Reader(self.options["path"], int(limit) if limit else None, int(self.options.get("after", 0)))
