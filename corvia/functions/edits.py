"""Masks that keep track of a span: ordered edit lists whose prefix sums move it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvia.functions.text import IDENTIFIERS
from corvia.operators.spans import spans

#: Masks in their order: pattern and what stands in its place, which may hold ``$1``.
LABELLED = r"(?i)((?:contact|author|name)\s*:\s*)[^\s,;.]+"
MASKS: tuple[tuple[str, str], ...] = ((r"https?://[^\s\"<>]+", "[url]"), *((p, f"[{k}]") for k, p in IDENTIFIERS.items()), (LABELLED, "$1[name]"))


def edits(text: Column, pattern: str, new: str) -> Column:
    """``start, end, by, size`` of each replacement, in order: where it is, how much longer the text is after it than before it, and how long what stands there then is."""

    def one(m: Column) -> Column:
        size = F.length(F.regexp_replace(m["txt"], pattern, new)) if "$" in new else F.lit(len(new))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), (size - (m["end"] - m["start"])).alias("by"), size.alias("size"))

    return F.transform(spans(text, pattern), one)


def moved(done: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A span after the edits: it moves by those before it; an end within one goes to that edit's start or end."""

    def shift(at: Column) -> Column:
        return F.aggregate(F.filter(done, lambda e: e["end"] <= at), F.lit(0), lambda s, e: s + e["by"])

    def within(at: Column) -> Column:
        return F.get(F.filter(done, lambda e: (e["start"] < at) & (at < e["end"])), 0)

    first, last = within(start), within(end)
    new_start = shift(start) + F.when(first.isNull(), start).otherwise(first["start"])
    new_end = shift(end) + F.when(last.isNull(), end).otherwise(last["start"] + last["size"])
    return new_start, new_end


def masked_with_span(df, text_col: str, start_col: str, end_col: str, masks: tuple[tuple[str, str], ...] = MASKS):
    """``df`` with the text masked and the span where it is then: a span within a mask becomes the mask. One projection a mask, no shuffle."""
    for pattern, new in masks:
        done = df.withColumn("_edits", edits(F.col(text_col), pattern, new))
        start, end = moved(F.col("_edits"), F.col(start_col), F.col(end_col))
        df = done.withColumns({start_col: start.cast("int"), end_col: end.cast("int"), text_col: F.regexp_replace(text_col, pattern, new)}).drop("_edits")
    return df
