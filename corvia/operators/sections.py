"""Sections, lines and the units in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvia.functions.text import heading_key


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, line, start``: the lines of each text and their offsets; line feeds belong to no line."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def is_short_heading(line: Column, most_words: int = 2) -> Column:
    return (F.length(F.trim(line)) > 0) & (F.size(F.split(F.trim(line), r"\s+")) <= most_words)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heading=is_short_heading, default: str = "all") -> DataFrame:
    """``doc_id, section_no, name, start, end``: headings cut each text into a tiling of sections; what stands before the first is the default section."""
    marked = lines(docs, id_col, text_col).withColumn("head", heading(F.col("line")))
    order = Window.partitionBy(id_col).orderBy("line_no")
    grouped = marked.withColumn("section_no", F.sum(F.col("head").cast("int")).over(order).cast("int"))
    found = grouped.groupBy(id_col, "section_no").agg(F.max(F.when(F.col("head"), heading_key(F.col("line")))).alias("name"), F.min("start").alias("start"), F.max(F.col("start") + F.length("line")).alias("last"))
    after = F.lead("start").over(Window.partitionBy(id_col).orderBy("section_no"))
    return found.select(id_col, "section_no", F.coalesce("name", F.lit(default)).alias("name"), "start", F.coalesce(after, F.col("last")).cast("int").alias("end"))


def label_units(docs: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", reach: int = 600) -> DataFrame:
    """``doc_id, line_no, unit``: each line that matches ``label``, with the next line as its body if it is nothing but the label and the body starts within ``reach`` code points."""
    rows = lines(docs, id_col, text_col)
    order = Window.partitionBy(id_col).orderBy("line_no")
    with_next = rows.withColumn("next", F.lead("line").over(order)).where(F.col("line").rlike(label))
    alone = F.trim(F.regexp_replace("line", label, "")) == ""
    unit = F.when(alone & F.col("next").isNotNull() & (F.length("line") < reach), F.concat_ws("\n", "line", "next")).otherwise(F.col("line"))
    return with_next.select(id_col, "line_no", unit.alias("unit"))
