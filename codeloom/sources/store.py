"""The graph on disk: Parquet snapshots behind a pointer that is swapped at once.

The folder belongs to a project directory of the driver's file system, as the project's
sources do; on a cluster that has to be a file system which the executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.model import SCHEMAS, Graph, empty

POINTER = "CURRENT"
#: Beside the graph's tables: what was parsed, by path and content hash.
PARSED = "parsed"
#: Snapshots that stay when a new one is written, for frames that still read them.
KEEP = 2


class NotIndexed(FileNotFoundError):
    """There is no snapshot yet."""


def current(folder: str) -> str | None:
    """The folder of the newest snapshot."""
    try:
        with open(os.path.join(folder, POINTER), encoding="utf-8") as f:
            return os.path.join(folder, f.read().strip())
    except FileNotFoundError:
        return None


def is_indexed(folder: str) -> bool:
    return current(folder) is not None


def write(tables: dict[str, DataFrame], folder: str, parsed: DataFrame | None = None) -> str:
    """Write a whole snapshot, then swap the pointer.

    Readers see the old snapshot or the new one, never a part of either. The last KEEP
    snapshots before it stay, so that frames opened on those can still be read.
    """
    name = f"snapshot-{uuid.uuid4().hex}"
    to = os.path.join(folder, name)
    os.makedirs(folder, exist_ok=True)
    for table, frame in (tables | ({} if parsed is None else {PARSED: parsed})).items():
        frame.write.parquet(os.path.join(to, table))
    fresh = os.path.join(folder, f"{POINTER}.{uuid.uuid4().hex}")
    with open(fresh, "w", encoding="utf-8") as f:
        f.write(name)
    os.replace(fresh, os.path.join(folder, POINTER))
    older = sorted((e for e in os.scandir(folder) if e.name.startswith("snapshot-") and e.name != name), key=lambda e: (e.stat().st_mtime_ns, e.name))
    for entry in older[: max(0, len(older) - KEEP)]:
        shutil.rmtree(entry.path, ignore_errors=True)
    return to


def initialize(spark: SparkSession, folder: str) -> int:
    """An empty snapshot unless there is one; the number of tables."""
    if not is_indexed(folder):
        write({name: empty(spark, name) for name in SCHEMAS}, folder)
    return len(SCHEMAS)


def read(spark: SparkSession, folder: str) -> Graph:
    at = current(folder)
    if at is None:
        raise NotIndexed(f"the project isn't indexed: no snapshot in {folder}")
    return Graph(**{name: spark.read.schema(schema).parquet(os.path.join(at, name)) for name, schema in SCHEMAS.items()})


def read_parsed(spark: SparkSession, folder: str) -> DataFrame | None:
    at = current(folder)
    return spark.read.parquet(os.path.join(at, PARSED)) if at is not None and os.path.exists(os.path.join(at, PARSED)) else None


def last_by_key(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys, the last in the order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return frame.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def delete_edges(edges: DataFrame, ends: tuple[str, str], affected: DataFrame) -> DataFrame:
    """Edges with neither end (columns of file paths) among the affected paths."""
    paths = affected.select("path").distinct()
    for end in ends:
        edges = edges.join(paths.select(F.col("path").alias(end)), end, "left_anti")
    return edges


def delete_files(graph: Graph, affected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, symbols and contains without what belongs to the affected paths."""
    paths = affected.select("path").distinct()
    files = graph.files.join(paths, "path", "left_anti")
    symbols = graph.symbols.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
    contains = graph.contains.join(paths.withColumnRenamed("path", "src_path"), "src_path", "left_anti")
    return files, symbols, contains
