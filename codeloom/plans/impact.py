"""What depends on a file or symbol: reverse calls, inheritance and requires."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.model import Graph
from codeloom.operators import traverse
from codeloom.plans import lang
from codeloom.plans.query import call_edges, extend_edges, named, require_edges, symbol_nodes


@dataclass(frozen=True)
class Impact:
    seeds: DataFrame
    nodes: DataFrame
    files: DataFrame
    edges: DataFrame
    #: Files found through requires alone: count is nodes plus these.
    require_files: DataFrame

    def count(self) -> int:
        return self.nodes.count() + self.require_files.count()


def input_files(graph: Graph, text: str, root: str | None = None) -> DataFrame:
    """Files that a path-like input names; no file for other inputs."""
    if not paths.looks_like_path(text):
        return graph.files.where(F.lit(False)).select("path")
    return graph.files.where(paths.fragment_column(F.col("path"), paths.fragment_of(text, root))).select("path")


def seed_rank():  # noqa: ANN201
    return F.struct(F.col("file_path").alias("a"), F.col("start_line").cast("long").alias("b"), F.col("kind").alias("c"), F.col("qualified_name").alias("d"))


def callers(seeds: DataFrame, calls: DataFrame, depth: int, cut: bool = True) -> traverse.Reached:
    return traverse.first_callers(seeds, calls, depth, seed_rank(), cut)


def subclasses(seeds: DataFrame, extends: DataFrame, depth: int, cut: bool = True) -> traverse.Reached:
    """Every edge met counts; a node only if it wasn't a seed."""
    found = traverse.search(seeds, extends, "parent_id", "child_id", depth, None, cut)
    return traverse.Reached(found.nodes.join(seeds.select("id"), "id", "left_anti"), found.edges)


def run(graph: Graph, text: str, depth: int = 2, root: str | None = None, cut: bool = True) -> Impact:
    """Seeds are the symbols of the files the input names, else those of its name."""
    lang.positive(depth, "depth")
    files = input_files(graph, text, root)
    by_file = not files.isEmpty()
    symbols = graph.symbols.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi") if by_file else graph.symbols.where(named(text))
    up = callers(symbols, graph.calls, depth, cut)
    down = subclasses(symbols, graph.extends, depth, cut)
    require_files, requires = traverse.dependents(files, graph.requires, depth, cut)
    nodes = symbol_nodes(graph.symbols.join(up.nodes.unionByName(down.nodes).distinct(), "id", "left_semi"))
    touched = nodes.select(F.col("file_path").alias("path")).unionByName(require_files).distinct()
    edges = call_edges(up.edges).unionByName(extend_edges(down.edges)).unionByName(require_edges(requires))
    return Impact(symbol_nodes(symbols), nodes, touched, edges, require_files)
