import io
import stat
import zipfile

import pytest
from conftest import rows

from pyspark.sql import functions as F

from quaestor.operators import blocks as op
from quaestor.operators import tables as tb
from quaestor.runtime import table
from quaestor.sources import archives, html
from quaestor.sources.catalogue import CatalogueSource, parse_page


def block(doc, n, type="paragraph", text="text", page=1, level=None, y0=200.0, y1=300.0, x0=50.0, x1=500.0, furniture=None):
    return dict(doc_id=doc, id=f"b{n}", type=type, page=page, ord=n, bbox=(x0, y0, x1, y1), text=text, level=level, is_furniture=furniture)


def test_section_paths_follow_a_stack(spark, make_root):
    import random

    rng, given = random.Random(3), []
    for doc in range(20):
        for n in range(30):
            kind = rng.choice(["title", "paragraph"])
            given.append(block(doc, n, kind, rng.choice([f"t{n}", "", None]), level=rng.choice([1, 2, 3, None]), furniture=rng.random() < 0.1))
    root = make_root(blocks=given + given[:5])
    got = {(r.doc_id, r.id): r.path for r in op.section_paths(op.distinct_blocks(spark, root)).collect()}
    for doc in range(20):
        above = []
        for b in (g for g in given if g["doc_id"] == doc):
            titled = b["type"] == "title" and b["text"] and not b["is_furniture"]
            if titled:
                above = [x for x in above if x[0] < (b["level"] or 3)]
            assert got[doc, b["id"]] == [t for _, t in above]
            if titled:
                above.append((b["level"] or 3, b["text"]))


def test_markdown(spark, make_root):
    root = make_root(blocks=[block(1, 0, "title", " Objet ", level=2), block(1, 1, text="  "), block(1, 2, text="corps\n"), block(1, 3, text="12", furniture=True), block(2, 0, text=None)])
    b = op.distinct_blocks(spark, root)
    text = op.render_markdown(b).collect()[0].markdown
    assert text == "##  Objet\n\ncorps\n"
    assert all(text[r.span_start : r.span_end] == r.chunk for r in op.markdown_spans(b).collect())


def test_furniture_and_families(spark, make_root):
    pages = [dict(doc_id=1, page=p, width=600.0, height=800.0) for p in range(1, 5)] + [dict(doc_id=1, page=5)]
    top = [block(1, p, "header", f"CPS  12/2025 - page {p}", page=p, y0=20.0, y1=35.0) for p in range(1, 5)]
    same = [block(1, 10 + p, text="Commune de X", page=p, y0=40.0, y1=50.0) for p in (1, 2)]
    body = [block(1, 20, text="Commune de X", page=3), block(1, 21, text="4", page=4, y0=780.0, y1=795.0), block(1, 22, "table", "5", page=4, y0=780.0, y1=795.0)]
    root = make_root(doc_pages=pages, blocks=top + same + body)
    b, p = op.distinct_blocks(spark, root), table(spark, root, "doc_pages")
    assert {r.id for r in op.strip_furniture(b, p).collect()} == {"b1", "b2", "b3", "b4", "b20", "b22"}
    family = {r.key: r.family for r in op.margin_families(op.banded(b, p)).collect()}
    assert len({family[f"cps 12/2025 - page {n}"] for n in range(1, 5)}) == 1 and family["commune de x"] != family["cps 12/2025 - page 1"]


def test_furniture_families_match_brute_force(spark, make_root):
    import random
    from difflib import SequenceMatcher

    rng, pages, given = random.Random(11), [], []
    for doc in range(12):
        n = rng.choice([1, 2, 4, 5, 10, 11])
        pages += [dict(doc_id=doc, page=p, width=600.0, height=800.0) for p in range(1, n + 1)]
        for i in range(4 * n):
            page = rng.randint(1, n)
            text = rng.choice([f"CPS  n° {doc}/2025 - Page {page}/{n}", f"cps n° {doc}/2025 / version 2 p. {page}", "Commune  de X", f"lot {rng.randint(1, 500)}", f"n° {rng.randint(1, 99)}", str(page), f"Ouvrage {rng.random()}", "y" * 119 + str(page), "z" * 121])
            y = rng.choice([20.0, 400.0, 780.0])
            given.append(block(doc, i, rng.choice(["paragraph", "header", "footer", "table"]), text, page=page, y0=y, y1=y + 12))
    root = make_root(doc_pages=pages, blocks=given)
    b, p = op.distinct_blocks(spark, root), table(spark, root, "doc_pages")
    want = set()
    for doc in range(12):
        own, n = [g for g in given if g["doc_id"] == doc], sum(x["doc_id"] == doc for x in pages)
        own.sort(key=lambda g: (g["page"], g["ord"], g["id"]))
        margin = [g for g in own if g["bbox"][1] != 400.0 and g["type"] != "table"]
        key = lambda g: " ".join(g["text"].split()).lower()
        on = {}
        for g in margin:
            if len(key(g)) <= 120:
                on.setdefault(key(g), set()).add(g["page"])
        group = {k: {k} for k in on}
        for i, a in enumerate(on):
            for c in list(on)[i + 1 :]:
                if min(len(a), len(c)) / max(len(a), len(c)) >= 0.6 and SequenceMatcher(None, a, c, autojunk=False).ratio() >= 0.8:
                    joined = group[a] | group[c]
                    for k in joined:
                        group[k] = joined
        enough = max(2, round(n * 0.3))
        gone = {k for k in on if n >= 2 and (len(on[k]) >= enough or len(group[k]) > 1 and len(set().union(*(on[x] for x in group[k]))) >= enough)}
        want |= {(doc, g["id"]) for g in own if g not in margin or not (key(g) in gone or key(g).isdigit())}
    assert {(r.doc_id, r.id) for r in op.strip_furniture_families(b, p).collect()} == want
    assert len(want) < op.strip_furniture(b, p).count()


def test_tables_over_pages(spark, make_root):
    pages = [dict(doc_id=1, page=p, width=600.0, height=800.0) for p in (1, 2, 3)]
    t = lambda n, page, y0, y1, cols=2: block(1, n, "table", "| " + " | ".join("ab"[:cols]) + " |\n| --- |", page=page, y0=y0, y1=y1)
    root = make_root(doc_pages=pages, blocks=[t(0, 1, 500.0, 780.0), t(1, 2, 20.0, 780.0), block(1, 2, "footer", "2", page=2, y0=785.0, y1=795.0, furniture=True), t(3, 3, 20.0, 300.0), block(1, 4, text="end", page=3, y0=400.0, y1=420.0)])
    got = rows(op.table_islands(op.distinct_blocks(spark, root), table(spark, root, "doc_pages")))
    assert [r[1] for r in got] == ["b0", "b1", "b3"] and len({r[2] for r in got}) == 1


def test_overlaps_match_all_pairs(spark, make_root):
    import random

    rng = random.Random(5)
    given = [block(1, n, x0=(x := rng.uniform(0, 500)), x1=x + rng.uniform(5, 200), y0=(y := rng.uniform(0, 500)), y1=y + rng.uniform(5, 200)) for n in range(25)]
    got = {(r.a, r.b): r.iou for r in op.overlapping(op.distinct_blocks(spark, make_root(blocks=given)), 0.1).collect()}
    want = {}
    for a in given:
        for b in given:
            if a["id"] < b["id"]:
                (ax, ay, au, av), (bx, by, bu, bv) = a["bbox"], b["bbox"]
                inter = max(min(au, bu) - max(ax, bx), 0) * max(min(av, bv) - max(ay, by), 0)
                iou = round(inter / ((au - ax) * (av - ay) + (bu - bx) * (bv - by) - inter), 6)
                if iou > 0.1:
                    want[a["id"], b["id"]] = iou
    assert got == want


def test_components(spark):
    from quaestor.operators.components import component_labels

    chain = [(1, f"{k:03}", f"{k + 1:03}") for k in range(40)] + [(2, "b", "a"), (2, "c", "b"), (3, "x", "x")]
    got = rows(component_labels(spark.createDataFrame(chain, "g int, a string, b string"), "g", "a", "b"))
    assert got == sorted([(1, f"{k:03}", "000") for k in range(41)] + [(2, x, "a") for x in "abc"] + [(3, "x", "x")], key=repr)


def brute_layout(raw):
    """(row, col) of each cell in turn, on an explicit grid of marks."""
    marks, out = set(), []
    for r in sorted({x[0] for x in raw}):
        c = 0
        for _, _, _, down, across, _ in (x for x in raw if x[0] == r):
            while (r, c) in marks:
                c += 1
            out.append((r, c))
            marks |= {(r + i, c + j) for i in range(down) for j in range(across)}
            c += across
    return out


def test_layout_matches_brute_force(spark):
    import random

    rng, given = random.Random(1), []
    for t in range(30):
        given.append((t, "<table>" + "".join("<tr>" + "".join(f"<td rowspan={rng.choice([0, 1, 1, 2, 3])} colspan={rng.choice(['x', 1, 1, 2])}>{rng.random()}</td>" for _ in range(rng.randint(0, 4))) + "</tr>" for _ in range(rng.randint(0, 6))) + "</table>"))
    raw = html.raw_cells(spark.createDataFrame(given, "table_id long, html string"))
    got = {}
    for r in tb.laid_out(raw).collect():
        got.setdefault(r.table_id, []).append((r.row, r.col))
    assert {t: sorted(x) for t, x in got.items()} == {t: sorted(brute_layout(html.cells_of(h))) for t, h in given if html.cells_of(h)}


def cells_of(spark, *tables):
    return tb.laid_out(html.raw_cells(spark.createDataFrame(list(enumerate(tables)), "table_id long, html string")))


def test_table_texts(spark):
    one = "<table><thead><tr><th>N<th>Prix &amp; $ \\times $</thead><tr><td rowspan=2>1<td>a|b<tr></tr><tr><td>3 $ 4 $<td>\"d\"</table>"
    cells = cells_of(spark, one, "", None)
    assert rows(tb.extents(cells, "table_id")) == [(0, 4, 2)]
    assert [r.texts for r in sorted(tb.grid_rows(cells, "table_id").collect(), key=lambda r: r.r)] == [["N", "Prix & x"], ["1", "a|b"], ["1", ""], ["3 4", '"d"']]
    assert rows(tb.markdown(cells, "table_id")) == [(0, '| N | Prix & x |\n| --- | --- |\n| 1 | a\\|b |\n| 1 |  |\n| 3 4 | "d" |')]
    again = tb.html_text(cells, "table_id").collect()[0].html
    assert again.startswith("<table><tr><th>N</th><th>Prix &amp; x</th></tr><tr><td rowspan=\"2\">1</td>") and "<tr></tr>" in again and "&quot;d&quot;" in again
    assert rows(cells_of(spark, again).drop("table_id")) == rows(cells.drop("table_id"))


def test_fusion_over_page_breaks(spark):
    parts = [
        "<table><tr><th>Lot<th>Article<th>Prix<tr><td rowspan=2>1<td>a<td>1<tr><td>b<td>2</table>",
        "<table><tr><td>LOT <td>article<td>Montant<tr><td><td>c<td>3<tr><td><td><td>4<tr><td>2<td>d<td>5<tr><td><td>e<td>6</table>",
        "<table><tr><td colspan=2><td>7<tr><td><td>f<td>8</table>",
    ]
    cells = cells_of(spark, *parts).withColumn("fragment", F.col("table_id").cast("int")).withColumn("table_id", F.lit(0))
    got = [r.texts for r in sorted(tb.grid_rows(tb.fused(cells), "table_id").collect(), key=lambda r: r.r)]
    # two of three header cells are no reprint at 0.7; the lot is carried on below the seam, and no further than the next value
    assert got == [["Lot", "Article", "Prix"], ["1", "a", "1"], ["1", "b", "2"], ["LOT", "article", "Montant"], ["", "c", "3"], ["", "", "4"], ["2", "d", "5"], ["", "e", "6"], ["", "", "7"], ["", "f", "8"]]
    parts[1] = parts[1].replace("Montant", "PRIX")
    cells = cells_of(spark, *parts).withColumn("fragment", F.col("table_id").cast("int")).withColumn("table_id", F.lit(0))
    assert rows(tb.reprinted_rows(cells)) == [(0, 0, 3, 0), (0, 1, 5, 1), (0, 2, 2, 0)]
    got = [r.texts for r in sorted(tb.grid_rows(tb.fused(cells), "table_id").collect(), key=lambda r: r.r)]
    assert got == [["Lot", "Article", "Prix"], ["1", "a", "1"], ["1", "b", "2"], ["1", "c", "3"], ["1", "", "4"], ["2", "d", "5"], ["", "e", "6"], ["", "", "7"], ["", "f", "8"]]
    assert rows(tb.fused(cells.limit(0))) == []


def test_forms():
    assert html.form_values('<input type=hidden name=a value=1><input type=checkbox name=b><input type=radio name=c value=x checked><select name=d><option value=1><option value=2 selected></select><input type=submit name=e>') == {"a": "1", "c": "x", "d": "2"}


def _zip(*members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, content, mode in members:
            info = zipfile.ZipInfo(name)
            info.external_attr = mode << 16
            z.writestr(info, content)
    return held.getvalue()


@pytest.mark.parametrize(
    "content, limits, problem",
    [(_zip(("a.txt", b"x", 0), ("A.TXT", b"y", 0)), {}, "duplicate path"), (_zip(("l", b"x", stat.S_IFLNK)), {}, "symbolic link"), (_zip(("../s", b"x", 0)), {}, "unsafe path"),
     (_zip(("..\\s", b"x", 0)), {}, "unsafe path"), (_zip(("/s", b"x", 0)), {}, "unsafe path"), (_zip(("a", b"x", 0), ("b", b"x", 0)), {"most": 1}, "too many members"),
     (_zip(("a", b"xxxx", 0)), {"most_bytes": 3}, "too large"), (_zip(), {}, "empty"), (b"no", {}, "not an archive")],
)
def test_archive_guards(content, limits, problem):
    assert archives.read_members("z", content, **limits) == [("z", None, None, None, problem)]


ROW = """<tr><td><input type="hidden" name="ctl$row{n}$refCons" value=" {n} "><input type="hidden" name="ctl$row{n}$orgCons" value="ORG"></td>
<td><div id="x_panelBlocTypesProc">AO  ouvert</div><div id="x_panelBlocCategorie">Travaux</div><span>01/02/2026</span> 02/02/2026</td>
<td><span id="x_reference">R{n}</span><div id="x_infosBullesObjet"><div>Objet {n} &amp; suite</div><div>bulle</div></div><div id="x_panelBlocDenomination"><b>Acheteur public :</b> Commune</div></td>
<td><div id="x_infosLieuExecution">Rabat</div></td><td><div class="a cloture-line">le 03/03/2026 <br> 10:00</div><div class="cloture-line">04/04/2026</div></td><td></td></tr>"""
PAGE = """<div><input id="ctl0_CONTENU_PAGE_resultSearch_numPageTop" value="{n}"> / <span id="ctl0_CONTENU_PAGE_resultSearch_nombrePageTop"> {total} </span></div>
<table><tr><td>other</td></tr></table><table class="x table-results"><tr><th>head</th></tr>{rows}</table><table class="table-results">{rows}</table>"""


def test_catalogue(spark, tmp_path):
    for n in (1, 2, 3):
        (tmp_path / f"p{n}.html").write_text(PAGE.format(n=n, total=3, rows=ROW.format(n=n) + ROW.format(n=n + 10)), encoding="utf-8")
    spark.dataSource.register(CatalogueSource)
    read = spark.read.format("catalogue").option("path", str(tmp_path))
    got = rows(read.load())
    address = "https://www.marchespublics.gov.ma/index.php?page=entreprise.EntrepriseDetailConsultation&refConsultation=2&orgAcronyme=ORG"
    assert got[2] == (2, 0, "2", "ORG", "R2", "Objet 2 & suite", "AO ouvert", "Travaux", "Commune", "Rabat", "01/02/2026", "03/03/2026 10:00", address) and len(got) == 6
    assert read.option("pages", 1).load().count() == 2
    assert {r.page for r in spark.read.format("catalogue").option("path", str(tmp_path)).option("after", 1).load().collect()} == {2, 3}


@pytest.mark.parametrize(
    "page, problem",
    [(PAGE.format(n=3, total=3, rows=ROW), "page 3"), ("<p>none</p>", "without a results table"), (PAGE.format(n=2, total=3, rows=""), "without results"), (PAGE.format(n=2, total=3, rows=ROW).replace("numPageTop", ""), "without a pager"),
     (PAGE.format(n=2, total=3, rows=ROW.replace('value="ORG"', "")), "without its key"), (PAGE.format(n=2, total=3, rows="<tr><td><input name=a$refCons value=1></tr>"), "too few columns")],
)
def test_catalogue_pages_that_fail(page, problem):
    with pytest.raises(ValueError, match=problem):
        parse_page(page, 2)


def test_parsing_whole_documents(spark, make_root, tmp_path):
    from quaestor.operators import layout

    blank = block(1, 5, "image", " ", page=2)
    given = [block(1, 0, "title", "Titre", level=1), block(1, 1, text="corps un"), block(1, 2, "footer", "p. 1", y0=790.0, y1=799.0), block(1, 3, text="corps deux", page=2), block(1, 4, "footer", "p. 2", page=2, y0=790.0, y1=799.0), blank]
    root = make_root(blocks=given + given[:2], doc_pages=[dict(doc_id=1, page=p, height=800.0, width=600.0) for p in (1, 2)])
    blocks, documents = layout.parse_blocks(op.distinct_blocks(spark, root), table(spark, root, "doc_pages"))
    assert [(r.id, r.ord, r.path, r.token_estimate) for r in blocks.orderBy("ord").collect()] == [("b0", 0, [], 1), ("b1", 1, ["Titre"], 2), ("b3", 2, ["Titre"], 3)]
    assert rows(documents) == [(1, 3, 6, 2, "# Titre\n\ncorps un\n\ncorps deux\n")]
    layout.write_documents(blocks, documents, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "markdown")).collect()[0].markdown.startswith("# Titre")
    assert '"section_path":["Titre"]' in spark.read.parquet(str(tmp_path / "out" / "json")).collect()[0].value
    empty = make_root()
    assert layout.parse_blocks(op.distinct_blocks(spark, empty), table(spark, empty, "doc_pages"))[1].count() == 0
