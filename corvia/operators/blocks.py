"""Nested document blocks as lines in reading order, however deep they are nested."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds of blocks. Those of text give a line, tables one a row, of the others nothing is kept but their children.
TEXT, SILENT = ("paragraph", "heading", "list"), ("image", "separator")


def table_lines(table: dict) -> list[str]:
    """A table's rows, two cells as a name and its value, with its caption above or below."""
    rows = [[c.strip() for c in row or () if c and c.strip()] for row in table.get("cells") or ()]
    lines = [": ".join(r) if len(r) == 2 else " | ".join(r) for r in rows if r]
    caption = [table["caption"]] if (table.get("caption") or "").strip() else []
    return lines + caption if table.get("captionBelow") else caption + lines


def lines_of(blocks: list[dict]) -> list[str]:
    """The lines of a list of blocks: each block's own, its note, then those of its children; a stack takes the place of recursion, so that depth costs nothing."""
    out, stack = [], list(reversed(blocks))
    while stack:
        block = stack.pop()
        kind = block.get("type")
        if kind == "table":
            out += table_lines(block.get("table") or {})
        elif kind in TEXT:
            out += [block["text"]] if (block.get("text") or "").strip() else []
        elif kind not in SILENT:
            raise ValueError(f"unknown block: {kind!r}")
        if kind not in SILENT and block.get("note"):
            out.append(f"(note: {block['note']})")
        stack += reversed(block.get("children") or ())
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lines(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda x: lines_of(json.loads(x)), na_action="ignore")


def block_lines(docs: DataFrame, id_col: str, blocks_col: str) -> DataFrame:
    """``id, line_no, line`` of documents whose blocks are a variant list, in reading order.

    A block has ``type``, ``text``, ``table`` (``cells``, ``caption``, ``captionBelow``), ``note`` and
    ``children``. A document is walked where it stands, in one pass and without a shuffle. An unknown kind
    of block is an error, so that nothing is left out unseen; a document without blocks has no lines.
    """
    lines = docs.select(F.col(id_col), _lines(F.to_json(F.col(blocks_col))).alias("_lines"))
    return lines.select(id_col, F.posexplode(F.coalesce("_lines", F.array().cast("array<string>"))).alias("line_no", "line"))
