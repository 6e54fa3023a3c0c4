"""Readers of exports, line files, documents and sheets."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow import schemas
from skeinflow.functions import columns as C
from skeinflow.runtime import ship


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def pages(spark: SparkSession, root: str, names: str = "*.json") -> DataFrame:
    """Messages of all JSON pages (files called ``names``) below ``root``, with the ``file`` each comes from.

    A page is a JSON array of messages. Pages that can't be read or hold something else give one
    row with ``damaged`` instead of messages, so a bad file is reported and stops nothing.
    """
    schema = T.StructType([*schemas.RAW_MESSAGE.fields, T.StructField("damaged", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "damaged").json(root)
    return raw.withColumn("file", F.col("_metadata.file_path"))


def normalised(raw: DataFrame, root: str, cutoff: str | None = None, parser: str = "1") -> DataFrame:
    """Flat messages of raw ones; those without time, or before ``cutoff``, are dropped.

    The thread is the page's folder relative to ``root``, so ids don't depend on the machine; a
    message without id gets one from its content. Embeds count as text where there is no content.
    """
    at = C.utc(F.col("timestamp"))
    folder = F.regexp_extract(F.regexp_replace("file", "^[a-z]+:/*", "/"), re.escape(re.sub("^[a-z]+:/*", "/", root.rstrip("/"))) + "/(.*)/[^/]*$", 1)
    embeds = C.joined_fields(F.transform("embeds", lambda e: F.struct(e["title"].alias("title"), e["description"].alias("description"), e["author"]["name"].alias("author"), e["provider"]["name"].alias("provider"))), ["title", "description", "author", "provider"])
    content = F.coalesce(F.nullif(F.trim("content"), F.lit("")), embeds, F.lit(""))
    bot = F.coalesce(F.col("author.bot"), F.lit(False))
    application = F.coalesce(F.col("application_id") != "", F.lit(False)) | F.coalesce(F.col("webhook_id") != "", F.lit(False))
    out = raw.where("damaged IS NULL").select(
        F.coalesce(F.nullif(F.trim("id"), F.lit("")), C.stable_id("message", F.col("file"), F.col("timestamp"), content, separator="\x1f")).alias("message_id"),
        C.stable_id("thread", folder).alias("thread_id"),
        "channel_id",
        at.alias("timestamp_utc"),
        F.col("author.id").alias("author_id"),
        F.coalesce(F.nullif("author.global_name", F.lit("")), F.col("author.username")).alias("author_name"),
        bot.alias("author_is_bot"),
        (bot | application).alias("is_bot_or_application"),
        F.coalesce("application_id", F.lit("")).alias("application_id"),
        F.coalesce("webhook_id", F.lit("")).alias("webhook_id"),
        content.alias("content_raw"),
        C.clean_text(content).alias("content_normalized"),
        F.coalesce(F.size("attachments"), F.lit(0)).alias("attachments_count"),
        F.coalesce(F.size("embeds"), F.lit(0)).alias("embeds_count"),
        C.flags(non_ascii=content.rlike(r"[^\x00-\x7F]")).alias("sensitivity_flags"),
        F.struct(F.col("file").alias("json_path"), F.lit(parser).alias("parser_version"), F.substring(F.sha2(content, 256), 1, 16).alias("content_hash")).alias("provenance"),
    )
    kept = F.col("timestamp_utc").isNotNull()
    if cutoff is not None:
        kept = kept & (F.col("timestamp_utc") >= F.lit(cutoff).cast("timestamp"))
    return out.where(kept)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON Lines table; empty where the path doesn't exist; blank lines count nothing, a damaged line fails the read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, field: str, item: T.StructType) -> DataFrame:
    """The items of the array ``field`` of JSON documents; a document without it gives none."""
    whole = T.StructType([T.StructField(field, T.ArrayType(item))])
    return spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode(field).alias("_i")).select("_i.*")


def entities(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """Entities of documents in any of three layouts (``resolved_entities``, ``entities``, ``cards``), of allowed types."""
    item = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "card_id", "canonical_name", "title", "entity_type")] + [T.StructField("aliases", T.ArrayType(T.StringType()))])
    whole = T.StructType([T.StructField(f, T.ArrayType(item)) for f in ("resolved_entities", "entities", "cards")])
    rows = spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode(F.coalesce("resolved_entities", "entities", "cards")).alias("_e")).select("_e.*")
    name = F.coalesce("canonical_name", "title")
    return rows.select(F.coalesce("entity_id", C.stable_id("entity", C.name_key(name))).alias("entity_id"), "card_id", name.alias("canonical_name"), "entity_type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).where(F.col("entity_type").isin(allowed) & name.isNotNull())


def _docx_text(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    paragraphs = []
    for p in root.iter():
        if p.tag.endswith("}p"):
            paragraphs.append("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")))
    return "\n".join(paragraphs)


def word_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of .docx files, a line for each paragraph; null text for damaged files."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([_docx_text(c) for c in b.column(1).to_pylist()], pa.string())], names=["path", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, text string")


def _cells(content: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row number, cells by header) of a workbook; the first row with cells is the header."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ET.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if t.tag.endswith("}t")))
        titles = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for title, sheet in zip(titles, sheets):
            header: dict[str, str] = {}
            for row in (r for r in ET.fromstring(z.read(sheet)).iter() if r.tag.endswith("}row")):
                found = {}
                for cell in row:
                    value = "".join(t.text or "" for t in cell.iter() if t.tag.endswith(("}v", "}t")))
                    if cell.get("t") == "s" and value:
                        value = shared[int(value)]
                    if value.strip():
                        found[re.sub(r"\d+", "", cell.get("r", ""))] = value.strip()
                if not found:
                    continue
                if not header:
                    header = {column: re.sub("[^a-z0-9]+", "_", value.lower()).strip("_") for column, value in found.items()}
                else:
                    yield title, int(row.get("r", 0)), {header[c]: v for c, v in found.items() if c in header}


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet, row, cells`` of .xlsx files: non-blank rows, cells by header name. A damaged file gives no rows."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out += [(file, *row) for row in _cells(content)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError, ValueError):
                    continue
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
            values = [list(c) for c in columns]
            values[3] = [list(m.items()) for m in values[3]]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names=["path", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row bigint, cells map<string,string>")


def looked_up(keys: DataFrame, key: str, cache: DataFrame, fetch: Callable[[str], Mapping[str, str] | None], fields: list[str]) -> DataFrame:
    """``key`` and ``fields`` for every distinct key: from ``cache`` where it is there, else from ``fetch``, once for each key.

    A key that ``fetch`` knows nothing about, or fails for, has null fields.
    """
    ship(keys.sparkSession)
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    schema = ", ".join(f"`{c}` string" for c in [key, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(0).to_pylist()
            got = []
            for k in asked:
                try:
                    got.append(fetch(k) or {})
                except Exception:
                    got.append({})
            yield pa.record_batch([pa.array(asked, pa.string()), *[pa.array([g.get(f) for g in got], pa.string()) for f in fields]], names=[key, *fields])

    fresh = wanted.join(cache.select(key), key, "left_anti").mapInArrow(run, schema)
    return wanted.join(cache.select(key, *fields), key).unionByName(fresh)
