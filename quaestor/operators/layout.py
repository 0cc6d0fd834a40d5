"""From layout regions to typed blocks, and from blocks to finished documents.

Regions are ``(doc_id, page, ord, label, content, x0, y0, x1, y1, confidence, scale, page_width,
page_height)``, boxes and page sizes in pixels. Repeated regions of one key count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.text import FURNITURE_LABELS, block_type, estimate_tokens, title_level
from quaestor.operators import blocks as bl
from quaestor.operators.figures import PICTURE_LABELS, described_blocks, in_points, large_enough


def page_blocks(regions: DataFrame) -> DataFrame:
    """Blocks in reading order: a picture that is too small takes a place in the order, but no id."""
    once = regions.dropDuplicates(["doc_id", "page", "ord"])
    placed = once.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord")) - 1)
    kept = placed.where(~F.col("label").isin(*PICTURE_LABELS) | large_enough())
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord")) - 1
    ident = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), number.cast("string"))
    return in_points(kept.withColumn("id", ident)).select(
        "doc_id", "id", block_type(F.col("label")).alias("type"), "page", F.col("position").alias("ord"), "x0", "y0", "x1", "y1",
        F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "").alias("text"), title_level(F.col("label")).alias("level"),
        F.col("label").isin(*FURNITURE_LABELS).alias("is_furniture"), "confidence", F.col("label").alias("layout_label"),
    )


def parse_blocks(blocks: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, documents) of parsed pages, in the order the steps depend on each other.

    Figures without text go, then furniture, as what follows must not see it; the rest is
    numbered anew, gets its section path and token estimate. Documents have their Markdown and counts.
    """
    kept = bl.strip_furniture_families(described_blocks(blocks), pages)
    numbered = kept.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord", "id")) - 1)
    finished = bl.section_paths(numbered.withColumn("ord", F.col("_n").cast("int")).drop("_n")).withColumn("token_estimate", estimate_tokens(F.col("text")))
    counts = finished.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum("token_estimate").alias("n_tokens"))
    sizes = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    documents = counts.join(sizes, "doc_id", "left").join(bl.render_markdown(finished), "doc_id", "left")
    return finished, documents


def write_documents(blocks: DataFrame, documents: DataFrame, folder: str) -> None:
    """One Markdown and one JSON row per document under ``folder``, each a table split by nothing.

    Nulls are left out of the JSON; what is there already is replaced.
    """
    documents.select("doc_id", F.coalesce("markdown", F.lit("")).alias("markdown")).write.mode("overwrite").parquet(f"{folder}/markdown")
    own = F.sort_array(F.collect_list(F.struct("ord", F.struct("id", "type", "page", "ord", "text", "level", F.col("path").alias("section_path"), "token_estimate").alias("b"))))
    whole = blocks.groupBy("doc_id").agg(F.transform(own, lambda x: x["b"]).alias("blocks")).join(documents.drop("markdown"), "doc_id")
    whole.select("doc_id", F.to_json(F.struct("doc_id", "n_pages", "n_blocks", "n_tokens", "blocks")).alias("value")).write.mode("overwrite").parquet(f"{folder}/json")
