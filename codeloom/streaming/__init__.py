"""An extension: keep a graph up to date from a stream of changed files.

Files arrive as rows; every micro-batch is parsed and merged into the stored parse by
path, and the graph is resolved anew, just as sync does from a directory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.plans.project import build
from codeloom.session import checkpointed
from codeloom.sources import store
from codeloom.sources.parsers.registry import parse_files

__all__ = ["merge_batch", "sync_stream"]


Aliases = Sequence[tuple[str, Sequence[str]]]


def merge_batch(batch: DataFrame, folder: str, base_url: str = ".", aliases: Aliases = ()) -> None:
    """Merge rows (path, text, modified_at) into a store; null texts remove their path.

    Of several rows of a path the latest counts. Merging a batch twice changes nothing.
    base_url and aliases are the project's, as config.compiler_paths() reads them.
    """
    spark = batch.sparkSession
    latest = checkpointed(store.last_by_key(batch.select("path", "text", "modified_at"), ["path"], ["modified_at", "text"]))
    live = latest.where("text is not null").select("path", "text", F.octet_length("text").cast("long").alias("size"), "modified_at", F.sha2("text", 256).alias("content_hash"))
    fresh = parse_files(live)
    old = store.read_parsed(spark, folder)
    parsed = checkpointed(fresh if old is None else old.join(latest, "path", "left_anti").unionByName(fresh))
    store.write(build(parsed, base_url, aliases).tables(), folder, parsed)


def sync_stream(changes: DataFrame, folder: str, checkpoint: str, base_url: str = ".", aliases: Aliases = (), every: str | None = None) -> StreamingQuery:
    """Start merging a streaming frame of rows (path, text, modified_at).

    It merges what there is and ends, or goes on in the given intervals ("30 seconds").
    """
    merged = changes.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, folder, base_url, aliases)).option("checkpointLocation", checkpoint)
    return (merged.trigger(availableNow=True) if every is None else merged.trigger(processingTime=every)).start()
