"""The property graph's tables and their schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Columns of the eight stored tables. returns and assigns are declared and always empty.
SCHEMAS: dict[str, str] = {
    "files": "path string, content_hash string, size long, modified_at timestamp, indexed_at timestamp, node_count long, error string",
    "symbols": "id string, kind string, name string, qualified_name string, file_path string, docstring string, signature string, start_line long, end_line long, start_column long, end_column long, is_local boolean, is_exported boolean, is_unresolved boolean, updated_at timestamp",
    "contains": "src_path string, dst_id string",
    "calls": "src_id string, dst_id string, line long, column long, is_resolved boolean",
    "requires": "src_path string, dst_path string, module_name string, is_resolved boolean",
    "returns": "src_id string, dst_id string",
    "assigns": "src_id string, dst_id string",
    "extends": "child_id string, parent_id string",
}


@dataclass(frozen=True)
class Graph:
    files: DataFrame
    symbols: DataFrame
    contains: DataFrame
    calls: DataFrame
    requires: DataFrame
    returns: DataFrame
    assigns: DataFrame
    extends: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def graph_of(spark: SparkSession, **tables: DataFrame) -> Graph:
    """A graph from some tables; the others are empty."""
    return Graph(**{name: tables[name] if name in tables else empty(spark, name) for name in SCHEMAS})
