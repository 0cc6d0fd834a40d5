"""Table structure: cells laid out around spans, grids, Markdown and HTML text, fusion over page breaks.

Raw cells come as ``(table_id, row, pos, text, row_span, col_span, is_header)``: the order of
the markup, spans as stated. Cells have ``col`` in place of ``pos``. Everything is an ordered
aggregation, an explode or a window per table or column; no rows meet beyond one table.

Defined results: tables without cells give no rows; null texts are empty; where cells overlap
the later one shows; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A row reprints another if this share of its cells, and one at least, are equal.
REPRINTED = 0.7
CELL = ["row", "col", "row_span", "col_span", "text", "is_header"]


def _width(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0), lambda acc, x: acc + x["col_span"])


def laid_out(raw: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells with their columns: each takes the first column that is free in its row.

    A fold over the cells of a table keeps, for every column, the first row in which it is
    free again. The spans added up bound the number of columns.
    """
    own = F.struct("row", "pos", "row_span", "col_span", F.coalesce("text", F.lit("")).alias("text"), "is_header")
    per_table = raw.groupBy(key).agg(F.sort_array(F.collect_list(own)).alias("cells")).withColumn("width", _width(F.col("cells")))
    start = F.struct(F.array_repeat(F.lit(0), F.col("width")).alias("free"), F.lit(-1).alias("row"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cols"))

    def place(acc: Column, x: Column) -> Column:
        begin = F.when(acc["row"] == x["row"], acc["at"]).otherwise(F.lit(0))
        first = F.filter(F.sequence(begin, F.col("width") - 1), lambda c: F.get(acc["free"], c) <= x["row"])
        return F.element_at(
            F.transform(
                F.slice(first, 1, 1),
                lambda c: F.struct(
                    F.transform(acc["free"], lambda row, i: F.when((i >= c) & (i < c + x["col_span"]), x["row"] + x["row_span"]).otherwise(row)).alias("free"),
                    x["row"].alias("row"),
                    (c + x["col_span"]).alias("at"),
                    F.concat(acc["cols"], F.array(c)).alias("cols"),
                ),
            ),
            1,
        )

    placed = per_table.withColumn("cols", F.aggregate("cells", start, place)["cols"])
    return placed.select(key, F.explode(F.arrays_zip("cells", "cols")).alias("z")).select(key, "z.cells.row", F.col("z.cols").alias("col"), *[f"z.cells.{c}" for c in CELL[2:]])


def extents(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_rows, n_cols) of each table."""
    return cells.groupBy(*keys).agg(F.max(F.col("row") + F.col("row_span")).alias("n_rows"), F.max(F.col("col") + F.col("col_span")).alias("n_cols"))


def spots(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, r, c, text, merged) of every place of the grid that a cell covers."""
    covered = cells.withColumn("r", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)))
    covered = covered.withColumn("c", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)))
    shown = F.struct("text", ((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("merged"))
    return covered.groupBy(*keys, "r", "c").agg(F.max_by(shown, F.struct("row", "col")).alias("s")).select(*keys, "r", "c", "s.*")


def full_grid(cells: DataFrame, *keys: str) -> DataFrame:
    """Every place of the grid, those no cell covers with null text."""
    whole = extents(cells, *keys).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    whole = whole.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    return whole.select(*keys, "r", "c").join(spots(cells, *keys), [*keys, "r", "c"], "left")


def grid_rows(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, r, texts): dense rows; a merged value stands in every place it covers."""
    line = F.sort_array(F.collect_list(F.struct("c", F.coalesce("text", F.lit("")).alias("text"))))
    return full_grid(cells, *keys).groupBy(*keys, "r").agg(F.transform(line, lambda x: x["text"]).alias("texts"))


def markdown(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, markdown): pipe table with pipes escaped; the first row with a header cell heads it, else row 0."""
    head = cells.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("is_header"), F.col("row"))), F.lit(0)).alias("head"))
    piped = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    rows = grid_rows(cells, *keys).join(head, list(keys))
    line = piped(F.transform("texts", lambda t: F.replace(t, F.lit("|"), F.lit("\\|"))))
    rule = piped(F.array_repeat(F.lit("---"), F.size("texts")))
    rows = rows.withColumn("line", F.when(F.col("r") == F.col("head"), F.concat_ws("\n", line, rule)).otherwise(line))
    ordered = F.sort_array(F.collect_list(F.struct((F.col("r") != F.col("head")).alias("body"), "r", "line")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("markdown"))


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def html_text(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, html): table markup with spans, texts escaped, rows without cells of their own empty."""
    tag = F.when(F.col("is_header"), F.lit("th")).otherwise(F.lit("td"))
    span = lambda name, n: F.when(F.col(n) > 1, F.concat(F.lit(f' {name}="'), F.col(n).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    one = F.concat(F.lit("<"), tag, span("colspan", "col_span"), span("rowspan", "row_span"), F.lit(">"), _escaped(F.col("text")), F.lit("</"), tag, F.lit(">"))
    own = cells.withColumn("one", one).groupBy(*keys, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "one"))), lambda x: x["one"]), "").alias("line"))
    every = extents(cells, *keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))
    rows = every.join(own, [*keys, "row"], "left").withColumn("line", F.concat(F.lit("<tr>"), F.coalesce("line", F.lit("")), F.lit("</tr>")))
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), ""), F.lit("</table>")).alias("html"))


def reprinted_rows(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, fragment, n_rows, skip): how many leading rows of each fragment reprint the first one's header."""
    first = Window.partitionBy(key)
    marked = cells.withColumn("_first", F.col("fragment") == F.min("fragment").over(first))
    heads = marked.where("_first").groupBy(key).agg(F.collect_set(F.when(F.col("is_header"), F.col("row"))).alias("h"))
    # header rows are counted from the top; without one in row 0, that row is the header by convention
    run = F.filter(F.sequence(F.lit(0), F.size("h")), lambda r: ~F.array_contains("h", r))[0]
    depth = heads.select(key, F.when(F.array_contains("h", 0), run).otherwise(1).alias("depth"))
    grids = grid_rows(cells, key, "fragment").join(depth, key).where(F.col("r") < F.col("depth"))
    least = F.min("fragment").over(first)
    grids = grids.withColumn("_first", F.col("fragment") == least)
    head = grids.where("_first").select(key, "r", F.col("texts").alias("head"))
    plain = lambda t: F.lower(F.trim(t))
    equal = F.size(F.filter(F.zip_with("texts", "head", lambda a, b: F.coalesce(plain(a) == plain(b), F.lit(False))), lambda x: x))
    same = (F.size("texts") == F.size("head")) & (equal >= F.greatest(F.lit(1.0), REPRINTED * F.size("head")))
    met = grids.where(~F.col("_first")).join(head, [key, "r"], "left").withColumn("same", F.coalesce(same, F.lit(False)))
    skips = met.groupBy(key, "fragment").agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("r"))), F.count("*").cast("int")).alias("skip"))
    return extents(cells, key, "fragment").select(key, "fragment", "n_rows").join(skips, [key, "fragment"], "left").withColumn("skip", F.coalesce("skip", F.lit(0)))


def fused(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells of one table per ``key`` from its numbered fragments (column ``fragment``).

    A header reprinted at the top of a fragment is dropped, rows are shifted by what came
    before, spans are clipped, and values cut off by a page break are carried on below it.
    """
    kept = reprinted_rows(cells, key)
    before = Window.partitionBy(key).orderBy("fragment").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("offset", F.coalesce(F.sum(F.col("n_rows") - F.col("skip")).over(before), F.lit(0)).cast("int"))
    kept = kept.withColumn("seam", F.row_number().over(Window.partitionBy(key).orderBy("fragment")) > 1)
    end = F.col("row") + F.col("row_span")
    moved = cells.join(kept, [key, "fragment"]).where(end > F.col("skip")).select(
        key,
        (F.greatest(F.col("row") - F.col("skip"), F.lit(0)) + F.col("offset")).alias("row"),
        "col",
        F.least("row_span", end - F.col("skip")).alias("row_span"),
        "col_span",
        "text",
        (F.col("is_header") & ~F.col("seam")).alias("is_header"),
    )
    seams = kept.where("seam").select(key, F.col("offset").alias("_seam"))
    return carried_on(moved, seams, key)


def carried_on(cells: DataFrame, seams: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells with the blanks below each seam filled from the value right above it.

    Only columns that a row span of one column uses somewhere are filled, downwards until the
    column has a value of its own or a merged blank cell.
    """
    spanning = cells.where((F.col("row_span") > 1) & (F.col("col_span") == 1)).select(key, F.col("col").alias("c")).distinct()
    grid = full_grid(cells, key).join(spanning, [key, "c"], "left_semi")
    down = Window.partitionBy(key, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    marked = grid.withColumn("blank", blank).withColumn("stop", blank & F.coalesce("merged", F.lit(False)))
    last = lambda c: F.last(c, ignorenulls=True).over(down)
    marked = marked.withColumn("_value", last(F.when(~F.col("blank"), F.struct("r", F.trim("text").alias("text"))))).withColumn("_stop", last(F.when(F.col("stop"), F.col("r"))))
    open_ = marked.where(F.col("blank") & F.col("_value").isNotNull() & (F.coalesce("_stop", F.lit(-1)) < F.col("_value.r")))
    filled = open_.withColumn("_seam", F.col("_value.r") + 1).join(seams.where(F.col("_seam") > 0), [key, "_seam"]).select(
        key, F.col("r").alias("row"), F.col("c").alias("col"), F.col("_value.text").alias("_text")
    )
    both = cells.withColumn("_own", F.lit(True)).join(filled, [key, "row", "col"], "full_outer")
    made = both["_own"].isNull()
    return both.select(
        key, "row", "col",
        F.when(made, 1).otherwise(F.col("row_span")).alias("row_span"), F.when(made, 1).otherwise(F.col("col_span")).alias("col_span"),
        F.coalesce("_text", "text").alias("text"), F.coalesce("is_header", F.lit(False)).alias("is_header"),
    )


def pipe_cells(blocks: DataFrame) -> DataFrame:
    """Cells of table blocks whose text is a pipe table: (doc_id, id) and the columns of a cell; row 0 is the header."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[\s|:-]+$"))
    rows = blocks.where(F.col("type") == "table").select("doc_id", "id", F.posexplode(lines).alias("row", "line"))
    bare = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    cells = rows.select("doc_id", "id", "row", F.posexplode(F.split(bare, r"\|")).alias("col", "text"))
    return cells.select("doc_id", "id", "row", "col", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.trim("text").alias("text"), (F.col("row") == 0).alias("is_header"))
