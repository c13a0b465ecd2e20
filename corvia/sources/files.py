"""Sources beyond Parquet: JSON lines, CSV of either encoding, XML, archives, partitions with a manifest."""

from __future__ import annotations

import codecs
import hashlib
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from csv import reader as csv_reader
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvia.functions.text import CREDENTIALS, IDENTIFIERS

#: Fixed value: path components that training jobs may not read.
HOLDOUT = frozenset(("holdout", "heldout", "test_split"))


def guarded(path: str) -> str:
    """``path``, unless one of its components is a holdout's."""
    if HOLDOUT & {x.lower() for x in PurePath(path).parts}:
        raise ValueError(f"a holdout path: {path}")
    return path


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines, and the lines that are no record: ``file, line``. Blank lines are none of either; keys beyond the schema are ignored."""
    kept = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").json(guarded(path)).withColumn("_file", F.input_file_name())
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = lines.withColumn("r", F.from_json("line", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}))
    return rows.where("_line is null").select(schema.names), parsed.where("r._line is not null").select("file", "line")


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines; the first line that is none fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(guarded(path))


def partition(rows: DataFrame, split: str, manifest: DataFrame, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of a split, and where they and the manifest (``id, hash``) disagree: ``id, state`` of missing, extra, changed and repeated ones."""
    own = rows.where(F.col("split") == split)
    found = own.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sha2(text, 256)).alias("found"))
    both = found.join(manifest.select("id", F.col("hash").alias("want"), F.lit(True).alias("listed")), "id", "full_outer")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("listed").isNull(), "extra").when(F.col("n") > 1, "repeated").when(~F.col("found").eqNullSafe(F.col("want")), "changed")
    return own, both.select("id", state.alias("state")).where("state is not null")


def csv(spark: SparkSession, path: str, schema: T.StructType, fallback: str = "cp949") -> DataFrame:
    """The fields of ``schema`` from CSV files, by the names in each file's own header, in whatever order and among whatever others.

    Files that are UTF-8 throughout are read as such (with or without a byte order mark), others in
    ``fallback``, whatever it cannot decode replaced: Spark takes such a file apart by its bytes, which is
    right for encodings in which commas, quotes and line ends stand for themselves alone, and its values
    are decoded then. Records are whole: quoted values may hold line breaks, so a file is read by one task. A header without one of the fields, or with one twice, is an error; empty
    files have no rows. Of each file, its name and header reach the driver.
    """
    lines = spark.read.text(guarded(path)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("no"))
    head = F.min_by(F.when(F.col("at") == 0, F.col("value").cast("binary")), F.when(F.col("at") == 0, F.col("no")))
    found = lines.groupBy("file").agg(F.every(F.is_valid_utf8("value")).alias("valid"), head.alias("head")).collect()

    @F.pandas_udf(T.StringType())
    def in_fallback(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x.encode("latin-1").decode(fallback, "replace"), na_action="ignore")

    alike: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for r in found:
        encoding = "utf-8-sig" if r.valid else fallback
        names = tuple(x.strip() for x in next(csv_reader([bytes(r.head).decode(encoding, "replace")])))
        for name in schema.names:
            if names.count(name) != 1:
                raise ValueError(f"{r.file}: the header names {name} {names.count(name)} times")
        alike.setdefault((encoding, names), []).append(r.file)
    out = spark.createDataFrame([], schema)
    for (encoding, names), same in sorted(alike.items()):
        own = T.StructType([T.StructField(f"_{i}", schema[n].dataType if n in schema.names else T.StringType()) for i, n in enumerate(names)])
        rows = spark.read.schema(own).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8" if encoding == "utf-8-sig" else "ISO-8859-1").csv(sorted(same))
        of = lambda f: F.col(f"_{names.index(f.name)}")
        out = out.unionByName(rows.select(*[(in_fallback(of(f)) if encoding == fallback and f.dataType == T.StringType() else of(f)).alias(f.name) for f in schema.fields]))
    return out


#: Marks at the start of a file, the longer ones first.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decoded(content: bytes, encoding: str | None) -> tuple[str, str]:
    """``text, encoding``: by the mark, if there is one, else as ``encoding``, else as UTF-8."""
    mark, named = next(((m, e) for m, e in MARKS if content.startswith(m)), (b"", encoding or "utf-8"))
    if mark and encoding and codecs.lookup(encoding).name.replace("_", "-") not in (named, named[:-3], f"{named}-sig"):
        raise UnicodeError(f"marked as {named}, named as {encoding}")
    return content[len(mark) :].decode(named), named


def text_files(spark: SparkSession, path: str, encoding: str | None = None, most_bytes: int = 256 << 20) -> DataFrame:
    """``file, text, encoding`` of whole text files: UTF-8, what their mark says, or a named encoding; Spark passes over empty files, so they have no row.

    A file that cannot be decoded, whose mark and named encoding differ, or of more than ``most_bytes`` is an error that names the file and the offset of the byte.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, size, content in zip(frame.path, frame.length, frame.content):
                if size > most_bytes:
                    raise ValueError(f"{file}: {size} bytes")
                try:
                    rows.append((file, *decoded(content, encoding)))
                except UnicodeDecodeError as e:
                    raise ValueError(f"{file}: byte {e.start + len(content) - len(e.object)}: {e.reason}") from e
                except UnicodeError as e:
                    raise ValueError(f"{file}: byte 0: {e}") from e
            yield pd.DataFrame(rows, columns=["file", "text", "encoding"])

    if encoding:
        codecs.lookup(encoding)  # an unknown name fails here and not in a task
    return spark.read.format("binaryFile").load(guarded(path)).select("path", "length", "content").mapInPandas(run, "file string, text string, encoding string")


def xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Elements of XML files as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(guarded(path))


def statute_articles(spark: SparkSession, path: str) -> DataFrame:
    """``statute, article, title, text`` of statutes in XML: ``<statute name><article no title>text</article></statute>``."""
    schema = T.StructType.fromDDL("_name string, article array<struct<_no:string,_title:string,_VALUE:string>>")
    rows = xml(spark, path, "statute", schema).select(F.col("_name").alias("statute"), F.explode("article").alias("a"))
    return rows.select("statute", F.col("a._no").alias("article"), F.col("a._title").alias("title"), F.trim("a._VALUE").alias("text"))


def leaf_text(spark: SparkSession, xml_rows: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """Leaves of XML strings as ``path\nvalue``, one row each that is there."""
    found = F.array_compact(F.array(*[F.when(F.xpath_string(column, F.lit(p)) != "", F.concat(F.lit(f"{p}\n"), F.xpath_string(column, F.lit(p)))) for p in paths]))
    return xml_rows.select(*[c for c in xml_rows.columns if c != column], F.explode(found).alias("leaf"))


def reports(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    """JSON reports of a folder by the pattern of their name, with ``file``."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(guarded(folder)).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def members_of(content: bytes, most_bytes: int) -> Iterator[tuple[str, int, bytes | None]]:
    """``name, size, content`` of the files in a zip or tar archive (packed or not); no content of one of more than ``most_bytes``, and of no more than that is ever unpacked."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, m.file_size, z.read(m) if m.file_size <= most_bytes else None
        return
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        for m in t:
            if m.isfile():
                yield m.name, m.size, t.extractfile(m).read() if m.size <= most_bytes else None


def archive_members(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """``archive, member, size, hash, kinds`` of the files in zip and tar archives.

    ``kinds`` are the sorted names of the secrets and identifiers that a member's bytes show as text; a
    member of more than ``most_bytes`` unpacked has neither hash nor kinds. A file that is no archive is an
    error that names it.
    """
    private = {k: re.compile(p.encode()) for k, p in {**IDENTIFIERS, **CREDENTIALS}.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame.path, frame.content):
                try:
                    rows = [
                        (archive.rpartition("/")[2], name, size, None if data is None else hashlib.sha256(data).hexdigest(), None if data is None else sorted(k for k, p in private.items() if p.search(data)))
                        for name, size, data in members_of(content, most_bytes)
                    ]
                except (tarfile.TarError, zipfile.BadZipFile) as e:
                    raise ValueError(f"{archive}: {e}") from e
                yield pd.DataFrame(rows, columns=["archive", "member", "size", "hash", "kinds"])

    return spark.read.format("binaryFile").load(guarded(path)).select("path", "content").mapInPandas(run, "archive string, member string, size long, hash string, kinds array<string>")


def member_mismatches(tree: DataFrame, members: DataFrame) -> DataFrame:
    """``member, state`` where files (``member, hash``) and an archive's members (the same) disagree: missing, extra, different."""
    both = tree.select("member", F.col("hash").alias("want")).join(members.select("member", F.col("hash").alias("have"), F.lit(True).alias("there")), "member", "full_outer")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("want").isNull(), "extra").when(~F.col("want").eqNullSafe(F.col("have")), "different")
    return both.select("member", state.alias("state")).where("state is not null")


def file_fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``n, digest`` of a set of files, whatever their order: names and contents."""
    from corvia.operators.corpus import digest

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return digest(files, F.concat_ws(":", F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)))
