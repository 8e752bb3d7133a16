"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import checkpoint_folder, checkpointed, ship

__all__ = ["BATCH_ROWS", "checkpoint_folder", "checkpointed", "free_prefix", "hot_above", "least_keys", "local", "measured", "over_texts", "packed", "partitions", "prepare", "quoted", "spread_join", "table"]

#: Rows of one Arrow batch: whole texts are held per batch, so memory follows this.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, and make this package importable on the executors."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)


def least_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of the `rows` distinct keys with the least hashes, or of all if they are fewer.

    Null keys don't count. A first pass counts the distinct keys, within a few hundredths,
    and a cut at twice the share asked for bounds in sum what all tasks hand to the top-k;
    however often keys repeat, the result is the same set of keys.
    """
    known = df.where(F.col(key).isNotNull())
    share = 2 * rows / max(1, known.agg(F.approx_count_distinct(key, 0.02)).first()[0])
    keys = known.select(key)
    if share < 1:
        keys = keys.where(F.xxhash64(key) < F.lit(int(share * (1 << 64)) - (1 << 63)).cast("long"))
    chosen = keys.distinct().orderBy(F.xxhash64(key), key).limit(rows)
    # At most `rows` keys, so the broadcast is bounded whatever the table holds.
    return known.join(F.broadcast(chosen), key)


#: A key with more than this share of all rows is hot; there are at most 1/share of them.
HOT_SHARE = 1 / 1024


def hot_above(total: int | None) -> float:
    """The rows that a key has to exceed to be hot, of total rows in all."""
    return max(1000.0, (total or 0) * HOT_SHARE)


def local(df: DataFrame) -> DataFrame:
    """df, of a bounded number of rows, fetched once: broadcasting it takes no more tasks."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """df checkpointed, and aggregates of all its rows from there, so that df runs once."""
    out = checkpointed(df)
    return out, out.agg(*[m.alias(name) for name, m in metrics.items()]).first().asDict()


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], counts: DataFrame, size: tuple | None = None) -> DataFrame:
    """rows joined to values (one row a key) with no hot key in one task.

    counts(*keys, n) says how many rows each key has; size is its sum and maximum of n if
    those are known. The values of hot keys, 1,024 at most, are broadcast to the rows
    wherever those lie; the others meet by shuffle, none of them with more than HOT_SHARE
    of the rows. Keys are not null.
    """
    total, most = size or counts.agg(F.sum("n"), F.max("n")).first()
    above = hot_above(total)
    if (most or 0) <= above:
        return rows.join(values, keys)
    named = local(counts.where(F.col("n") > above).select(*keys))
    hot = local(values.join(F.broadcast(named), keys))
    rest = rows.join(F.broadcast(named), keys, "left_anti").join(values, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def over_texts(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: tuple[T.StructField, ...] = ()) -> DataFrame:
    """docs.mapInArrow(run), whatever the columns are called: run's batches have "text" under
    its name and the others under names of their places, and more columns come last."""
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)]
    return docs.toDF(*names).mapInArrow(run, T.StructType([*fields, *more])).toDF(*docs.columns, *[f.name for f in more])


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, whatever they are called; `name.*` unpacks them."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def free_prefix(docs: DataFrame, prefix: str) -> str:
    """prefix, lengthened until no column of docs starts with it."""
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
