"""A virtual code graph over the driver's tables, for queries that SQL can check.

File is supplier with nation and region, Symbol is part, Calls and Requires follow the
lines of an order, Extends is a binary tree over part keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.model import Graph, graph_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    path = F.concat_ws("/", F.lower("r_name"), F.lower("n_name"), F.lower("s_name"))
    where = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return where.select(path.alias("path"), F.sha2(F.col("s_name"), 256).alias("content_hash"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified_at"), F.lit(None).cast("timestamp").alias("indexed_at"), F.lit(0).cast("long").alias("node_count"), F.lit("").alias("error"), F.col("s_suppkey").alias("suppkey"))


def _count(df: DataFrame) -> int:
    return df.count()


def symbols(spark: SparkSession, sf_dir: str, suppliers: int) -> DataFrame:
    part = table(spark, sf_dir, "part")
    start = F.floor(F.col("p_partkey") / suppliers) + 1
    named = part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_type").alias("kind"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"),
        F.concat(F.lit("file"), (F.col("p_partkey") % suppliers).cast("string"), F.lit(".lua")).alias("file_path"),
        F.lit("").alias("docstring"),
        F.concat("p_type", F.lit(" "), "p_name").alias("signature"),
        start.cast("long").alias("start_line"),
        (start + F.col("p_size")).cast("long").alias("end_line"),
        F.lit(1).cast("long").alias("start_column"),
        F.lit(1).cast("long").alias("end_column"),
        (F.col("p_partkey") % 2 == 0).alias("is_local"),
        (F.col("p_partkey") % 2 == 1).alias("is_exported"),
        F.lit(False).alias("is_unresolved"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    return named


def _follows(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Pairs of keys of lines n and n + 1 of an order, each once, with the line's flag."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", "l_linenumber", F.col(key).alias("a"), F.col("l_returnflag").alias("flag"))
    b = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col(key).alias("b"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("a", "b", "flag", "l_linenumber").distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _follows(spark, sf_dir, "l_partkey").select("a", "b").distinct()
    return pairs.select(F.col("a").cast("string").alias("src_id"), F.col("b").cast("string").alias("dst_id"), (F.col("a") % 97).alias("line"), (F.col("b") % 13).alias("column"), F.lit(True).alias("is_resolved"))


def extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey > 0")
    return part.select(F.col("p_partkey").cast("string").alias("child_id"), F.floor(F.col("p_partkey") / 2).cast("long").cast("string").alias("parent_id"))


def requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines returned ('R') are unresolved and lead back to their file."""
    pairs = _follows(spark, sf_dir, "l_suppkey").select("a", "b", "flag").distinct()
    paths = files(spark, sf_dir).select("path", "suppkey")
    unresolved = F.col("flag") == "R"
    named = pairs.join(paths.select(F.col("path").alias("src_path"), F.col("suppkey").alias("a")), "a").join(paths.select(F.col("path").alias("far"), F.col("suppkey").alias("b")), "b")
    return named.select("src_path", F.when(unresolved, F.col("src_path")).otherwise(F.col("far")).alias("dst_path"), F.concat(F.lit("m"), F.col("b").cast("string")).alias("module_name"), (~unresolved).alias("is_resolved")).distinct()


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return graph_of(
        spark,
        files=files(spark, sf_dir).drop("suppkey"),
        symbols=symbols(spark, sf_dir, _count(table(spark, sf_dir, "supplier"))),
        calls=calls(spark, sf_dir),
        extends=extends(spark, sf_dir),
        requires=requires(spark, sf_dir),
    )


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol as a function or method, for the rules about scopes."""
    found = symbols(spark, sf_dir, _count(table(spark, sf_dir, "supplier")))
    return found.withColumn("kind", F.when(F.col("id").cast("long") % 3 == 0, "method").otherwise("function"))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, line): places of lines in their supplier's file."""
    suppliers = _count(table(spark, sf_dir, "supplier"))
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("file"), (F.col("l_suppkey") % suppliers).cast("string"), F.lit(".lua")).alias("file_path"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).cast("long").alias("line")).distinct()


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, line, code) of the documents' texts, a document being a file."""
    from codeloom.functions.text import lines

    return lines(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))
