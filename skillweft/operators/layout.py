"""Reading order of positioned words on pages of one or two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gutters(boxes: DataFrame, gap: float = 0.06) -> DataFrame:
    """``doc, page, gutter``: the middle of the free band between two columns of each page that has one.

    ``boxes``: ``doc, page, width`` (of the page), ``x0, x1, top, text``. Boxes are swept from left to right; where the next one begins right of all
    before it, there is a free band. It is a gutter if it holds the page's middle with half of ``gap * width`` on both sides. Text on both sides follows from that. A sweep is over
    one page. Boxes without text or place are none.
    """
    w = Window.partitionBy("doc", "page").orderBy("x0", "x1")
    swept = _placed(boxes).withColumn("end", F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    half, band = F.col("width") / 2, F.col("width") * gap / 2
    free = swept.where((F.col("width") > 0) & (F.col("end") <= half - band) & (F.col("x0") >= half + band))
    return free.groupBy("doc", "page").agg(((F.max("end") + F.min("x0")) / 2).alias("gutter"))


def _placed(boxes: DataFrame) -> DataFrame:
    return boxes.where("doc is not null and page is not null and x0 is not null and x1 is not null and top is not null and trim(text) <> ''").select("doc", "page", "width", "x0", "x1", "top", "text")


def reading_order(boxes: DataFrame, gap: float = 0.06, line: float = 3.0) -> DataFrame:
    """The boxes with ``column, line, place``: on a page with a gutter the left column comes first, from top to bottom, then the right one.

    A line ends where the next box lies more than ``line`` below the one before; within a line boxes go from left to right.
    """
    found = gutters(boxes, gap)
    rows = _placed(boxes).join(found, ["doc", "page"], "left").withColumn("column", F.coalesce((F.col("x0") >= F.col("gutter")).cast("int"), F.lit(0)))
    column = Window.partitionBy("doc", "page", "column").orderBy("top", "x0", "text")
    begins = (F.col("top") - F.lag("top").over(column) > line).cast("int")
    rows = rows.withColumn("_b", F.coalesce(begins, F.lit(0))).withColumn("line", F.sum("_b").over(column.rowsBetween(Window.unboundedPreceding, 0)))
    page = Window.partitionBy("doc", "page").orderBy("column", "line", "x0", "text")
    return rows.withColumn("place", F.row_number().over(page)).drop("_b")


def reflowed(boxes: DataFrame, gap: float = 0.06, line: float = 3.0) -> DataFrame:
    """``doc, two_column, text`` of every document: its words in reading order, lines and pages by line breaks.

    ``two_column``: any of its pages has a gutter. Only a page's words, and then a document's pages, are put together in a row.
    """
    rows = reading_order(boxes, gap, line)
    lines = rows.groupBy("doc", "page", "column", "line").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("w"), F.max(F.col("gutter").isNotNull()).alias("two"))
    lines = lines.select("doc", "page", "column", "line", "two", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("t"))
    each = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "column", "line", "t"))).alias("l"), F.max("two").alias("two_column"))
    return each.select("doc", "two_column", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))
