"""Line dedup by a log-template tree of fixed depth (after Drain; He et al., 2017)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvia.llm.common import fresh, written

ANY = "<*>"
_FIELD = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_DIGIT = re.compile(rb"[0-9]").search


def parsed(line: bytes) -> list[bytes]:
    """The tokens of a line; one that holds a digit is a variable field."""
    return (line if _DIGIT(line) is None else _FIELD.sub(ANY.encode(), line)).split()


def tokens_of(line: bytes, min_tokens: int, short_lines: bool) -> list[bytes] | None:
    """The tokens of a line that goes into the tree, those of a line of under ``min_tokens`` as they are; None for one that does not."""
    found = parsed(line)
    return found if len(found) >= min_tokens else line.split() if short_lines and found else None


def _hash(tokens: bytes) -> int:
    return xxhash.xxh64_intdigest(tokens) - (1 << 63)


def leaf_of(tokens: list[bytes], depth: int) -> int:
    """The hash of the path to a line's leaf: its token count and leading tokens."""
    return _hash(b"%d " % len(tokens) + b" ".join(tokens[:depth]))


def _parsed_lines(docs: DataFrame, depth: int, min_tokens: int, short_lines: bool, full: bool) -> DataFrame:
    """``leaf, id`` or, if ``full``, ``leaf, id, whole, line``: each once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())[: 4 if full else 2]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    lines = [t for x in (text or "").encode().split(b"\n") if (t := tokens_of(x, min_tokens, short_lines)) is not None]
                    if full:
                        rows += [(leaf_of(t, depth), doc, _hash(line), line.decode()) for line, t in {b" ".join(t): t for t in lines}.items()]
                    else:
                        rows += [(leaf, doc) for leaf in {leaf_of(t, depth) for t in lines}]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["leaf", "id", "whole", "line"][: len(types)])

    return docs.mapInArrow(run, "leaf long, id long, whole long, line string" if full else "leaf long, id long")


def recurring_lines(docs: DataFrame, min_docs: int = 3, depth: int = 3, min_tokens: int = 5, min_constant: float = 0.6, short_lines: bool = False) -> DataFrame:
    """``id, whole``: the lines to drop from each document of ``docs`` (``id, text``), by the hash of the line.

    The tree's first level is the token count, the next ``depth`` levels are the leading tokens. In a
    leaf, a token stays part of the template if at least ``min_docs`` pairs of a document and a different
    line have it at that place; other places are generalised to variable fields. A line of which under
    ``min_constant`` of the tokens stay is its own template. Templates in at least ``min_docs`` documents
    recur; their lines go from all documents but that with the smallest id. Lines under ``min_tokens``
    tokens are left alone or, with ``short_lines``, are templates of their own as they stand, digits included.
    """
    leaves = _parsed_lines(docs, depth, min_tokens, short_lines, False).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    held = written(_parsed_lines(docs, depth, min_tokens, short_lines, True).join(leaves, "leaf", "left_semi"), "lines")
    distinct = held.groupBy("leaf", "whole", "line").agg(F.count(F.lit(1)).alias("n"))
    cells = distinct.select("leaf", "whole", "n", F.posexplode(F.split("line", " ")).alias("place", "token"))
    common = cells.groupBy("leaf", "place", "token").agg(F.sum("n").alias("pairs")).where(F.col("pairs") >= min_docs).select("leaf", "place", "token", F.lit(True).alias("stays"))
    kept = F.when(F.coalesce("stays", F.lit(False)) | (F.col("token") == ANY), F.col("token")).otherwise(ANY)
    cell = F.xxhash64("place", kept)
    shapes = cells.join(common, ["leaf", "place", "token"], "left").groupBy("leaf", "whole").agg(
        F.bit_xor(cell).alias("x"), F.sum(cell.cast("decimal(20,0)")).alias("y"), F.avg(F.when(F.col("stays") & (F.col("token") != ANY), 1.0).otherwise(0.0)).alias("constant"), F.count(F.lit(1)).alias("tokens")
    )
    general = (F.col("constant") >= min_constant) & (F.col("tokens") >= min_tokens)
    templates = written(shapes.select("leaf", "whole", F.xxhash64("leaf", F.when(general, F.col("x")).otherwise(F.col("whole")), F.when(general, F.col("y"))).alias("template")), "templates")  # so that the joins after it are of tables, whose hot keys Spark splits
    used = held.select("leaf", "whole", "id").join(templates, ["leaf", "whole"]).select("id", "whole", "template")
    recurring = written(used.select("template", "id").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_docs), "recurring")
    return used.join(recurring, "template").where(F.col("id") != F.col("first")).select("id", "whole").distinct()


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, depth: int = 3, min_tokens: int = 5, min_constant: float = 0.6, short_lines: bool = False) -> DataFrame:
    """``docs`` with the recurring lines (see :func:`recurring_lines`) taken out of the text, and ``n_lines``, ``n_dropped`` (long).

    Every row is returned. The lines left are joined by line feeds as they were. A null text stays null
    with no lines, an empty text has one line; rows of one id are one document; a row whose id is null is
    returned as it is; no rows give none. Columns of ``docs`` named ``n_lines`` or ``n_dropped`` are
    replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    key, listed = fresh(docs, "_id"), fresh(docs, "_drops")
    drops = recurring_lines(plain, min_docs, depth, min_tokens, min_constant, short_lines).groupBy(F.col("id").alias(key)).agg(F.collect_set("whole").alias(listed))
    kept = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = left = text.encode().split(b"\n") if text is not None else []
                if drop:
                    gone = set(drop)
                    left = [x for x in lines if (t := tokens_of(x, min_tokens, short_lines)) is None or _hash(b" ".join(t)) not in gone]
                texts.append(text if len(left) == len(lines) else b"\n".join(left).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            arrays = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], kept.names)

    joined = docs.withColumn(key, F.col(id_col).cast("long")).join(drops, key, "left")
    return joined.select(*docs.columns, listed).mapInArrow(run, kept)
