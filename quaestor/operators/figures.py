"""Figures of parsed pages: boxes in points, too small ones, scores, classes, evidence of a signature.

Regions are ``(doc_id, page, ord, label, x0, y0, x1, y1)`` in pixels with the page's ``scale``
(pixels a point) and size. Null confidences count as 0; ties of evidence go by page and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.blocks import not_overlapping

BOX = ("x0", "y0", "x1", "y1")
# Classes whose figures are described, and those that are evidence of a signature.
DESCRIBED = (
    "flow_chart", "geographical_map", "topographical_map", "screenshot_from_computer", "screenshot_from_manual", "other", "bar_chart", "line_chart",
    "pie_chart", "scatter_plot", "box_plot", "engineering_drawing", "photograph", "full_page_image",
)
SIGNED = ("signature", "stamp")
# Labels of regions that are cut out as pictures.
PICTURE_LABELS = ("image", "chart", "figure", "header_image", "footer_image")
LEAST_PIXELS = 32
#: Score from which a sweep's detection is looked at, and how much it may overlap a known figure.
SWEEP_SCORE, SWEEP_OVERLAP = 0.15, 0.3
#: Confidence from which a class is trusted: of regions of the layout, and of those a sweep found below its threshold.
LAYOUT_FLOOR, SWEEP_FLOOR = 0.0, 0.5


def in_points(regions: DataFrame) -> DataFrame:
    """Boxes in points in place of pixels."""
    return regions.withColumns({c: F.col(c) / F.col("scale") for c in BOX})


def large_enough(least: int = LEAST_PIXELS) -> Column:
    """Whether the box in pixels, rounded to even and cut to its page, is no mere rule or speck."""
    x0, y0 = (F.greatest(F.lit(0), F.bround(c)) for c in ("x0", "y0"))
    x1, y1 = F.least("page_width", F.bround("x1")), F.least("page_height", F.bround("y1"))
    return (x1 - x0 >= least) & (y1 - y0 >= least)


def scored(regions: DataFrame, detections: DataFrame) -> DataFrame:
    """Regions with the score of the detection of the same label and rounded box; null without one."""
    rounded = [F.bround(c).cast("int").alias(f"_{c}") for c in BOX]
    best = detections.select("doc_id", "page", "label", *rounded, "score").groupBy("doc_id", "page", "label", *[f"_{c}" for c in BOX]).agg(F.max("score").alias("score"))
    return regions.select("*", *rounded).join(best, ["doc_id", "page", "label", *[f"_{c}" for c in BOX]], "left").drop(*[f"_{c}" for c in BOX])


def swept(detections: DataFrame, known: DataFrame) -> DataFrame:
    """Picture detections that no known figure (in points) covers, large enough, with ids of their own, boxes in points."""
    wanted = in_points(detections.where(F.col("label").isin(*PICTURE_LABELS) & (F.col("score") >= SWEEP_SCORE) & large_enough()))
    found = not_overlapping(wanted, known, SWEEP_OVERLAP)
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord")) - 1
    return found.withColumn("id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_s"), number.cast("string")))


def routed(figures: DataFrame) -> DataFrame:
    """Adds ``is_signature``, ``kept`` and ``to_describe`` to (id, figure_class, confidence, swept) rows.

    A swept region counts only if its class is sure, is kept only as a signature, and is never described.
    """
    sure = F.coalesce("confidence", F.lit(0.0)) >= F.when(F.col("swept"), SWEEP_FLOOR).otherwise(LAYOUT_FLOOR)
    signature = F.coalesce(F.col("figure_class").isin(*SIGNED) & sure, F.lit(False))
    described = F.coalesce(F.col("figure_class").isin(*DESCRIBED), F.lit(False))
    return figures.withColumn("is_signature", signature).withColumn("kept", ~F.col("swept") | F.col("is_signature")).withColumn("to_describe", ~F.col("swept") & described)


def evidence(figures: DataFrame) -> DataFrame:
    """(doc_id, is_signed, evidence): the signatures of each document in reading order."""
    one = F.struct("page", "id", "figure_class", F.round("confidence", 4).alias("confidence"), F.when(F.col("swept"), "sweep").otherwise("layout").alias("found_by"))
    found = routed(figures).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("is_signature"), one))).alias("evidence"))
    return found.select("doc_id", (F.size("evidence") > 0).alias("is_signed"), "evidence")


def described_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks without figures that nothing describes."""
    return blocks.where((F.col("type") != "image") | (F.trim(F.coalesce("text", F.lit(""))) != ""))


def caption_line(figure_class: Column, caption: Column) -> Column:
    """Markdown of a figure: its class and caption; empty without one."""
    return F.when(F.length(caption) > 0, F.concat(F.lit("*["), F.replace(figure_class, F.lit("_"), F.lit(" ")), F.lit("]* "), caption)).otherwise("")
