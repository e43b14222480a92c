"""Cache indexes (one JSON object per edge), cache folders and run metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import responses
from edgetide.sources.cache_folder import CacheFolder
from edgetide.sources.versions import Versions

ENTRY = ("STRUCT<last_access: STRING, size: BIGINT, type: STRING, access_count: BIGINT, "
         "creation_time: STRING>")


#: Spaces before a key, as the edges write their indexes.
INDENT = 2


def _entries(objects: DataFrame, json: str, keep: list[str]) -> DataFrame:
    entries = F.from_json(F.col(json), f"MAP<STRING, {ENTRY}>")
    return (objects.select(*keep, F.explode(entries).alias("file_id", "e"))
            .select(*keep, "file_id", "e.*"))


def _objects(spark: SparkSession, path: str, whole_files: bool | None, indent: int) -> DataFrame:
    """(value, file): pieces of the files at ``path``, each a JSON object of entries.

    In an indented object an entry ends in a line that holds its closing brace alone, at the indent of
    the keys.  JSON texts hold no line feeds, so such a line cannot lie inside a key or a value:
    it is the record separator, files split at any offset, and the brace it took is put back.
    A file without such lines (one entry, or all on one line) is one piece.
    """
    file = F.col("_metadata.file_path").alias("file")
    if whole_files is not None:
        return spark.read.text(path, wholetext=whole_files).select("value", file)
    pieces = spark.read.text(path, lineSep="\n" + " " * indent + "},\n").select("value", file)
    body = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    opened, closed = body.startswith("{"), F.col("value").rlike(r"(\n\}|\}[\x20\t]*\})\s*$|^\s*\{\s*\}\s*$")
    whole = F.concat(F.when(opened, "").otherwise("{"), body, F.when(closed, "").otherwise("}}"))
    return pieces.filter(body != "").select(whole.alias("value"), "file")


def read_index(spark: SparkSession, path: str, whole_files: bool | None = None, indent: int = INDENT) -> DataFrame:
    """JSON objects keyed by cached path; a large indented file is read by several tasks.

    With ``whole_files`` a file in any other layout is read as one text; with it off every line is an
    object of its own.
    """
    return _entries(_objects(spark, path, whole_files, indent), "value", [])


def read_regional_indexes(spark: SparkSession, pattern: str, whole_files: bool | None = None, indent: int = INDENT
                          ) -> DataFrame:
    """Indexes named ``cache_index_<region>.json`` (files or folders), read together."""
    objects = _objects(spark, pattern, whole_files, indent).select(
        "value", F.regexp_extract("file", r"cache_index_([^/]+)\.json", 1).alias("region"))
    return _entries(objects, "value", ["region"])


def read_index_lines(spark: SparkSession, path: str) -> DataFrame:
    """The layout for large snapshots: one entry per line, so files split; the published version."""
    schema = ("region STRING, file_id STRING, last_access STRING, size BIGINT, type STRING, "
              "access_count BIGINT, creation_time STRING")
    _, manifest = Versions(spark, path).newest()
    return spark.read.schema(schema).json(f"{path}/{manifest['folders'][0]}" if manifest else path)


def write_index_lines(entries: DataFrame, path: str) -> None:
    """Publish survivors per region as the next version of the index at ``path``.

    The old version stands until the new one is whole (``sources.versions``); a writer that another one
    has overtaken is refused.
    """
    versions = Versions(entries.sparkSession, path)
    number, folder = versions.newest()[0] + 1, versions.folder("index")
    (entries.repartitionByRange("region", "file_id")
     .write.partitionBy("region").json(f"{versions.path}/{folder}"))
    versions.publish(number, {"folders": [folder]})


def read_cache_folder(spark: SparkSession, path: str, levels: int = 1) -> DataFrame:
    """Files below a cache folder: path, size, times of the last change and access, error.

    File contents are never read.  A folder on a mount is listed by the tasks, one for each folder
    ``levels`` down (``sources.cache_folder``); a file that vanished meanwhile has an ``error`` and no
    size.  On an object store Spark lists it, which knows no access times: take those from the log
    (``operators.snapshot.index_from_log``).
    """
    if re.match(r"/|file:|[^:/]+/|[^:/]+$", path):
        spark.dataSource.register(CacheFolder)
        listed = spark.read.format("cache_folder").option("levels", levels).load(path)
    else:
        listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                  .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"),
                          F.lit(None).cast("timestamp").alias("accessed_at"), F.lit(None).cast("string").alias("error")))
    return listed.select(
        "path", F.substring_index("path", "/", -1).alias("name"),
        responses.hash_of_cached_path(F.col("path")).alias("hash"), "size", "changed_at", "accessed_at", "error")


def append_metrics(metrics: DataFrame, path: str) -> None:
    """One record per run and region, appended; earlier records are not rewritten."""
    metrics.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
