"""Project files as a frame."""

from __future__ import annotations

import os
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.sources.config import Config
from codeloom.sources.parsers.registry import extensions


def _root(root: str) -> str:
    return root.rstrip("/") if "://" in root else os.path.realpath(root)


def _list(spark: SparkSession, root: str, config: Config) -> list[tuple[str, int, datetime]]:
    """(path, length, time) of the files that config includes, with paths below the root.

    Folders that are excluded aren't entered. The listing is the driver's, as with any of
    Spark's readers, and carries no content.
    """
    where = _root(root)
    entered = lambda path: not paths.glob_matches(config.exclude, path)
    wanted = lambda path: paths.is_supported(path, extensions()) and entered(path) and paths.glob_matches(config.include, path)
    out = []
    if "://" not in where:
        for folder, names, files in os.walk(where):
            below = os.path.relpath(folder, where).replace(os.sep, "/")
            at = "" if below == "." else f"{below}/"
            names[:] = [n for n in names if entered(at + n)]
            for path in filter(wanted, (at + n for n in files)):
                if os.path.isfile(full := os.path.join(where, path)):
                    found = os.stat(full)
                    out.append((path, found.st_size, datetime.fromtimestamp(found.st_mtime, timezone.utc)))
        return out
    top = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    open_ = [(top, "")]
    while open_:
        folder, at = open_.pop()
        for one in fs.listStatus(folder):
            path = at + one.getPath().getName()
            if one.isDirectory() and entered(path):
                open_.append((one.getPath(), f"{path}/"))
            elif one.isFile() and wanted(path):
                out.append((path, one.getLen(), datetime.fromtimestamp(one.getModificationTime() / 1000, timezone.utc)))
    return out


_LISTED = "path string, size long, modified_at timestamp"


def scan(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """(path, size, modified_at) of the supported files that config includes, by path.

    A file below an excluded directory is excluded whatever its own path is.
    """
    return spark.createDataFrame(_list(spark, root, config), _LISTED).orderBy(F.expr("path COLLATE UNICODE"))


def read_texts(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """scan() with text and content_hash, the SHA-256 of the text.

    Only files that config includes are read. Bytes that are not UTF-8 become replacement
    characters. Files without content, which Spark's readers pass over, have the empty text.
    """
    where, listed = _root(root), _list(spark, root, config)
    blank = spark.createDataFrame([x for x in listed if not x[1]], _LISTED).withColumn("text", F.lit(""))
    full = [re.sub(r"([{}\[\]*?\\])", r"\\\1", f"{where}/{path}") for path, size, _ in listed if size]
    if full:
        files = spark.read.format("binaryFile").load(full)
        plain = re.escape(where.removeprefix("file:").lstrip("/"))
        path = F.regexp_replace("path", f"^(file:/*|/+)?{plain}/+", "")
        read = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        blank = read.unionByName(blank)
    return blank.withColumn("content_hash", F.sha2("text", 256))
