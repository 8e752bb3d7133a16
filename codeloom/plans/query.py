"""Filter and relation queries over the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.model import Graph
from codeloom.operators import traverse
from codeloom.plans import lang

#: Columns of result nodes and edges; what a kind of row lacks is null.
NODES = ("type", "id", "kind", "name", "qualified_name", "file_path", "start_line", "signature")
EDGES = ("kind", "source", "target", "line", "column", "module_name", "is_resolved")


@dataclass(frozen=True)
class Result:
    nodes: DataFrame
    edges: DataFrame


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.lit("Symbol").alias("type"), "id", "kind", "name", "qualified_name", "file_path", "start_line", "signature")


def file_nodes(files: DataFrame) -> DataFrame:
    path = F.col("path")
    none = F.lit(None)
    return files.select(F.lit("File").alias("type"), path.alias("id"), F.lit("file").alias("kind"), paths.basename_column(path).alias("name"), none.cast("string").alias("qualified_name"), path.alias("file_path"), none.cast("long").alias("start_line"), none.cast("string").alias("signature"))


def call_edges(calls: DataFrame) -> DataFrame:
    return calls.select(F.lit("Calls").alias("kind"), F.col("src_id").alias("source"), F.col("dst_id").alias("target"), "line", "column", F.lit(None).cast("string").alias("module_name"), "is_resolved")


def extend_edges(extends: DataFrame) -> DataFrame:
    none = F.lit(None)
    return extends.select(F.lit("Extends").alias("kind"), F.col("child_id").alias("source"), F.col("parent_id").alias("target"), none.cast("long").alias("line"), none.cast("long").alias("column"), none.cast("string").alias("module_name"), none.cast("boolean").alias("is_resolved"))


def require_edges(requires: DataFrame) -> DataFrame:
    none = F.lit(None)
    return requires.select(F.lit("Requires").alias("kind"), F.col("src_path").alias("source"), F.col("dst_path").alias("target"), none.cast("long").alias("line"), none.cast("long").alias("column"), "module_name", "is_resolved")


def named(value: str) -> Column:
    return (F.col("name") == value) | (F.col("qualified_name") == value)


def filtered_symbols(symbols: DataFrame, name: str | None, kind: str | None) -> DataFrame:
    if name is not None:
        symbols = symbols.where(named(name))
    return symbols if kind is None else symbols.where(F.col("kind") == kind)


def filtered_files(files: DataFrame, name: str | None, kind: str | None) -> DataFrame:
    """Files count without a name only for kind:file; a name is a whole path."""
    if kind not in (None, "file") or kind is None and name is None:
        return files.where(F.lit(False))
    return files if name is None else files.where(F.col("path") == name)


def methods_of(symbols: DataFrame, owner: str) -> DataFrame:
    start = F.col("qualified_name")
    return symbols.where((F.col("kind") == "method") & (start.startswith(f"{owner}:") | start.startswith(f"{owner}.")))


def seeds(symbols: DataFrame, value: str) -> DataFrame:
    return (symbols if value == "*" else symbols.where(named(value))).select("id")


def relate(graph: Graph, relation: str, value: str, depth: int, name: str | None = None, kind: str | None = None, cut: bool = True) -> Result:
    """A symbol relation; name and kind hold for the neighbour at every hop."""
    calls = relation in ("callers", "callees")
    edges = graph.calls if calls else graph.extends
    near, far = ("src_id", "dst_id") if calls else ("child_id", "parent_id")
    if relation in ("callers", "subclasses"):
        near, far = far, near
    allowed = None if name is None and kind is None else filtered_symbols(graph.symbols, name, kind)
    found = traverse.search(seeds(graph.symbols, value), edges, near, far, depth, allowed, cut)
    nodes = symbol_nodes(graph.symbols.join(found.nodes, "id", "left_semi"))
    return Result(nodes, call_edges(found.edges) if calls else extend_edges(found.edges))


def relate_files(graph: Graph, relation: str, value: str, depth: int, cut: bool = True) -> Result:
    """requires or dependents of the files that a path or a part of one names."""
    start = graph.files.where(paths.fragment_column(F.col("path"), paths.fragment_of(value, star=True))).select(F.col("path").alias("id"))
    near, far = ("src_path", "dst_path") if relation == "requires" else ("dst_path", "src_path")
    found = traverse.search(start, graph.requires, near, far, depth, None, cut)
    nodes = graph.files.join(found.nodes.select(F.col("id").alias("path")), "path", "left_semi")
    return Result(file_nodes(nodes), require_edges(found.edges))


def run(graph: Graph, expression: str | lang.Expression, depth: int = 1, cut: bool = True) -> Result:
    """Nodes and edges of a query expression, not yet ordered."""
    e = lang.parse(expression) if isinstance(expression, str) else expression
    lang.positive(depth, "depth")
    none = graph.spark.createDataFrame([], "kind string, source string, target string, line long, column long, module_name string, is_resolved boolean")
    name, kind = e.filter("name"), e.filter("kind")
    if e.relation is None:
        nodes = file_nodes(filtered_files(graph.files, name, kind)).unionByName(symbol_nodes(filtered_symbols(graph.symbols, name, kind)))
        return Result(nodes, none)
    relation, value = e.relation
    if relation == "methods":
        return Result(symbol_nodes(methods_of(graph.symbols, value)), none)
    if relation in lang.FILE_RELATIONS:
        return relate_files(graph, relation, value, depth, cut)
    return relate(graph, relation, value, depth, name, kind, cut)


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    """Files first; symbols by path, line as text, kind and name: one collated string."""
    key = F.when(F.col("type") == "File", F.concat(F.lit("0:"), "file_path")).otherwise(F.concat_ws(":", F.lit("1"), "file_path", F.col("start_line").cast("string"), "kind", "qualified_name"))
    return nodes.orderBy(F.collate(key, "UNICODE"), "id")


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("kind", F.collate("source", "UNICODE"), F.collate("target", "UNICODE"), "line", "column", "module_name")


def ordered_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy(F.collate("file_path", "UNICODE"), "start_line", F.collate("kind", "UNICODE"), F.collate("qualified_name", "UNICODE"), "id")
