"""Status, sample, snippet and the graph for viewers."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import normalize, resolve_safe
from codeloom.model import Graph
from codeloom.plans import lang


def edge_counts(graph: Graph) -> DataFrame:
    """(edge, n) of every relationship table, empty ones too."""
    out = None
    for name in ("contains", "calls", "requires", "returns", "assigns", "extends"):
        one = getattr(graph, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("edge"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def kind_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


def hash_diff(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) of two frames (path, content_hash): added, removed or changed."""
    both = indexed.select("path", F.col("content_hash").alias("old")).join(current.select("path", F.col("content_hash").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def status(graph: Graph, current: DataFrame) -> dict[str, Any]:
    """Counts of the graph, and how many of the current files (path, content_hash) differ."""
    edges = edge_counts(graph).agg(F.sum("n")).first()[0]
    files = graph.files.agg(F.count("*"), F.count_if(F.col("error") != "")).first()
    kinds = {r["kind"]: r["n"] for r in kind_counts(graph.symbols).orderBy("kind").collect()}
    return {
        "fileCount": files[0],
        "symbolCount": sum(kinds.values()),
        "edgeCount": edges or 0,
        "parseErrorCount": files[1],
        "symbolKindCounts": kinds,
        "pendingSyncChangeCount": hash_diff(graph.files, current).count(),
    }


def sample(graph: Graph, limit: int = 20) -> DataFrame:
    """The first symbols by path, line, kind and name: a top-k, no full sort."""
    lang.positive(limit, "limit")
    columns = ("kind", "name", "qualified_name", "file_path", "start_line", "is_local", "signature")
    return graph.symbols.orderBy("file_path", "start_line", "kind", "name", "id").limit(limit).select(*columns)


def snippet_range(line: int, context: int, count: int) -> tuple[int, int]:
    if isinstance(line, bool) or not isinstance(line, int) or line < 1:
        raise lang.QueryError("line must be a positive integer")
    if isinstance(context, bool) or not isinstance(context, int) or context < 0:
        raise lang.QueryError("context must be a non-negative integer")
    if line > count:
        raise lang.QueryError("line is beyond the end of the file")
    return max(1, line - context), min(count, line + context)


def snippet(root: str, path: str, line: int, context: int = 0) -> dict[str, Any]:
    """Some lines of one project file."""
    relative = normalize(path)
    with open(resolve_safe(root, relative), encoding="utf-8", newline="") as f:
        found = re.split(r"\r?\n", f.read())
    if len(found) > 1 and found[-1] == "":
        found = found[:-1]
    first, last = snippet_range(line, context, len(found))
    return {"path": relative, "startLine": first, "endLine": last, "code": "\n".join(found[first - 1 : last])}


def snippets(lines: DataFrame, sites: DataFrame, context: int) -> DataFrame:
    """lines(file_path, line, code), sites(file_path, site) -> (file_path, site, start_line, end_line, code)."""
    # Every site asks for its lines by number: no site meets all lines of its file.
    asked = sites.select("file_path", "site", F.explode(F.sequence(F.col("site") - context, F.col("site") + context)).alias("line"))
    near = lines.join(asked, ["file_path", "line"])
    found = near.groupBy("file_path", "site").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sort_array(F.collect_list(F.struct("line", "code"))).alias("rows"), F.max((F.col("line") == F.col("site")).cast("int")).alias("there"))
    return found.where("there = 1").select("file_path", "site", "start_line", "end_line", F.array_join(F.transform("rows", lambda r: r["code"]), "\n").alias("code"))


def viewer_graph(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that viewers get: files, symbols, and a module node for every
    unresolved require, to which its edge then goes. Calls aren't among the edges."""
    none = F.lit(None)
    files = graph.files.select(F.col("path").alias("id"), F.lit("File").alias("type"), F.lit("file").alias("kind"), F.col("path").alias("label"), F.col("path").alias("file_path"), none.cast("long").alias("start_line"), F.lit("").alias("signature"))
    symbols = graph.symbols.select("id", F.lit("Symbol").alias("type"), "kind", F.coalesce("qualified_name", "name").alias("label"), "file_path", "start_line", F.coalesce("signature", F.lit("")).alias("signature"))
    module_id = F.concat(F.lit("module:"), "src_path", F.lit(":"), "module_name")
    modules = graph.requires.where("not is_resolved").select(module_id.alias("id"), F.lit("Module").alias("type"), F.lit("module").alias("kind"), F.col("module_name").alias("label"), F.col("src_path").alias("file_path"), none.cast("long").alias("start_line"), F.lit("unresolved require").alias("signature"))
    plain = lambda df, a, b, kind: df.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("kind"), none.cast("string").alias("module_name"), none.cast("boolean").alias("is_resolved"))
    requires = graph.requires.select(F.col("src_path").alias("source"), F.when(F.col("is_resolved"), F.col("dst_path")).otherwise(module_id).alias("target"), F.lit("Requires").alias("kind"), "module_name", "is_resolved")
    edges = plain(graph.contains, "src_path", "dst_id", "Contains").unionByName(plain(graph.extends, "child_id", "parent_id", "Extends")).unionByName(requires)
    return files.unionByName(symbols).unionByName(modules), edges


def loaded_edges(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("Contains", "Extends", "Requires")) -> DataFrame:
    """Edges of known kinds with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    some = edges.where(F.col("kind").isin(*kinds))
    return some.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)


def node_kinds(nodes: DataFrame) -> DataFrame:
    """The kinds that a viewer offers to filter by, in their order."""
    return nodes.select("kind").distinct().orderBy(F.collate("kind", "UNICODE"))


def search_nodes(nodes: DataFrame, text: str = "", kind: str | None = None) -> DataFrame:
    """The viewer's search: part of label, path or signature, whatever the case, and a kind."""
    found = nodes.where(F.lower(F.concat_ws(" ", "label", "file_path", "signature")).contains(text.strip().lower()))
    return found if kind is None else found.where(F.col("kind") == kind)
