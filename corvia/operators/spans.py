"""Match spans as arrays on the document's own row: no shuffle, and every later range test is an array expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,txt:string>>"


def to_regex(pattern: str) -> str:
    """``re:`` patterns as they are; literals escaped, white space matches any run of it, case ignored."""
    if pattern.startswith("re:"):
        return pattern[3:]
    return "(?i)" + r"\s*".join(re.sub(r"([^\w])", r"\\\1", part, flags=re.ASCII) if part.isascii() else re.escape(part) for part in pattern.split())


def any_of(patterns: list[str] | tuple[str, ...]) -> str:
    """One expression for a list, so that a text is scanned once."""
    return "|".join(f"(?:{to_regex(p)})" for p in patterns)


def spans(text: Column, regex: str) -> Column:
    """All non-empty leftmost matches as ``(start, end, txt)`` in order, in code points.

    The pieces between the matches give the offsets, as prefix sums.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["hit"].alias("txt"))
        return F.struct(end.cast("int").alias("at"), F.when(x["hit"].isNull() | (x["hit"] == ""), s["out"]).otherwise(F.concat(s["out"], F.array(span))).alias("out"))

    pairs = F.transform(hits, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), h.alias("hit")))
    return F.when(text.rlike(regex), F.aggregate(pairs, empty, step, lambda s: s["out"])).otherwise(F.array().cast(SPAN))
