"""A project directory: init, index, sync and what is asked of it."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.model import SCHEMAS, Graph, empty
from codeloom.operators import resolve
from codeloom.plans import explain as explain_plan
from codeloom.plans import impact as impact_plan
from codeloom.plans import lang, reports
from codeloom.plans import query as query_plan
from codeloom.session import checkpointed
from codeloom.sources import config, scan, store
from codeloom.sources.parsers.registry import parse_files

Progress = Callable[[str], None]


def _silent(_: str) -> None:
    pass


def _folder(root: str, settings: config.Config) -> str:
    return os.path.join(os.path.abspath(root), settings.databaseDir)


def _existing(root: str) -> str:
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a directory: {root}")
    return os.path.abspath(root)


def init_project(spark: SparkSession, root: str) -> dict[str, Any]:
    root = _existing(root)
    settings = config.write(root)
    os.makedirs(_folder(root, settings), exist_ok=True)
    return {"projectRoot": root, "configPath": os.path.join(root, config.CONFIG), "databaseDir": _folder(root, settings), "schemaCount": len(SCHEMAS)}


def symbols_of(parsed: DataFrame) -> DataFrame:
    """Symbols of all files; of equal ids the last stays."""
    rows = parsed.select(F.posexplode("symbols").alias("n", "s")).select("n", "s.*")
    once = store.last_by_key(rows, ["id"], ["n"])
    return once.select("id", "kind", "name", "qualified_name", "file_path", F.lit("").alias("docstring"), "signature", "start_line", "end_line", "start_column", "end_column", "is_local", "is_exported", "is_unresolved", F.current_timestamp().alias("updated_at"))


def files_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "content_hash", "size", "modified_at", F.current_timestamp().alias("indexed_at"), F.size("symbols").cast("long").alias("node_count"), "error")


def contains_of(parsed: DataFrame) -> DataFrame:
    """One edge for each declaration, even where ids collide."""
    return parsed.select(F.col("path").alias("src_path"), F.explode("symbols.id").alias("dst_id"))


def resolved(parsed: DataFrame, symbols: DataFrame, base_url: str = ".", aliases: Sequence[tuple[str, Sequence[str]]] = ()) -> dict[str, DataFrame]:
    """calls, extends and requires of what was parsed."""
    sites = lambda c: parsed.select(F.posexplode(c).alias("site", "x")).select("site", "x.*")
    return {
        "calls": resolve.resolve_calls(sites("calls"), symbols),
        "extends": resolve.resolve_extends(sites("extends"), symbols),
        "requires": resolve.resolve_requires(sites("requires"), parsed.select("path"), base_url, aliases),
    }


def build(parsed: DataFrame, base_url: str = ".", aliases: Sequence[tuple[str, Sequence[str]]] = ()) -> Graph:
    """The whole graph of parsed files."""
    symbols = symbols_of(parsed)
    spark = parsed.sparkSession
    tables = {"files": files_of(parsed), "symbols": symbols, "contains": contains_of(parsed), "returns": empty(spark, "returns"), "assigns": empty(spark, "assigns")}
    return Graph(**tables, **resolved(parsed, symbols, base_url, aliases))


def index_project(spark: SparkSession, root: str, force: bool = False, progress: Progress = _silent) -> dict[str, Any]:
    """Parse every file and write a new snapshot; force drops the whole database first."""
    root = _existing(root)
    settings = config.required(root)
    folder = _folder(root, settings)
    progress("scanning project files")
    parsed = checkpointed(parse_files(scan.read_texts(spark, root, settings)))
    n = parsed.count()
    progress(f"found {n} project files")
    if force:
        shutil.rmtree(folder, ignore_errors=True)
    progress("indexing symbols")
    store.write(build(parsed, *config.compiler_paths(root)).tables(), folder, parsed)
    graph = store.read(spark, folder)
    counts = {r["edge"]: r["n"] for r in reports.edge_counts(graph).collect()}
    out = {"fileCount": n, "symbolCount": counts["contains"], "containsCount": counts["contains"], "callsCount": counts["calls"], "extendsCount": counts["extends"], "requiresCount": counts["requires"], "databaseDir": folder}
    progress(f"done: files {n}, symbols {out['symbolCount']}, calls {out['callsCount']}, extends {out['extendsCount']}, requires {out['requiresCount']}")
    return out


def sync_project(spark: SparkSession, root: str, progress: Progress = _silent) -> dict[str, Any]:
    """Bring the snapshot up to date by content hash.

    Only changed files are parsed; what is unchanged comes from the stored parse. Edges
    are resolved anew whenever anything changed, for a name's uniqueness is global.
    """
    root = _existing(root)
    settings = config.required(root)
    folder = _folder(root, settings)
    store.initialize(spark, folder)
    progress("scanning project files")
    texts = scan.read_texts(spark, root, settings)
    hashes = checkpointed(texts.select("path", "content_hash"))
    scanned = hashes.count()
    progress(f"found {scanned} project files")
    graph = store.read(spark, folder)
    diff = checkpointed(reports.hash_diff(graph.files, hashes))
    changes = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
    removed, changed = changes.get("removed", 0), changes.get("added", 0) + changes.get("changed", 0)
    progress(f"{changed} files to refresh, {removed} to remove")
    extends = requires = 0
    if removed or changed:
        old = store.read_parsed(spark, folder)
        fresh = parse_files(texts.join(diff.where("change <> 'removed'"), "path", "left_semi"))
        parsed = fresh if old is None else store.upsert(old.join(diff, "path", "left_anti"), fresh, ["path"])
        parsed = checkpointed(parsed)
        progress("resolving calls, extends and requires")
        store.write(build(parsed, *config.compiler_paths(root)).tables(), folder, parsed)
        graph = store.read(spark, folder)
        extends, requires = graph.extends.count(), graph.requires.count()
    else:
        progress("nothing changed")
    return {"scannedFileCount": scanned, "changedFileCount": changed, "removedFileCount": removed, "symbolCount": graph.symbols.count(), "containsCount": graph.contains.count(), "extendsCount": extends, "requiresCount": requires, "databaseDir": folder}


def open_project(spark: SparkSession, root: str) -> Graph:
    return store.read(spark, _folder(root, config.required(_existing(root))))


def project_status(spark: SparkSession, root: str) -> dict[str, Any]:
    root = _existing(root)
    settings = config.required(root)
    folder = _folder(root, settings)
    base = {"databaseDir": folder, "configPath": os.path.join(root, config.CONFIG), "schemaCount": len(SCHEMAS)}
    if not store.is_indexed(folder):
        pending = scan.scan(spark, root, settings).count()
        return {"fileCount": 0, "symbolCount": 0, "edgeCount": 0, "parseErrorCount": 0, "symbolKindCounts": {}, "pendingSyncChangeCount": pending} | base
    hashes = scan.read_texts(spark, root, settings).select("path", "content_hash")
    return reports.status(store.read(spark, folder), hashes) | base


def _node(r: Any) -> dict[str, Any]:
    if r["type"] == "File":
        return {"type": "File", "id": r["id"], "kind": "file", "name": r["name"], "path": r["file_path"]}
    return {"type": "Symbol", "id": r["id"], "kind": r["kind"], "name": r["name"], "qualifiedName": r["qualified_name"], "filePath": r["file_path"], "startLine": r["start_line"], "signature": r["signature"]}


def _edge(r: Any) -> dict[str, Any]:
    out = {"kind": r["kind"], "source": r["source"], "target": r["target"]}
    if r["kind"] == "Calls":
        out |= {"line": r["line"], "column": r["column"], "isResolved": r["is_resolved"]}
    if r["kind"] == "Requires":
        out |= {"moduleName": r["module_name"], "isResolved": r["is_resolved"]}
    return out


def query_project(spark: SparkSession, root: str, expression: str, depth: int = 1) -> dict[str, Any]:
    parsed = lang.parse(expression)
    lang.positive(depth, "depth")
    found = query_plan.run(open_project(spark, root), parsed, depth)
    nodes = [_node(r) for r in query_plan.ordered_nodes(found.nodes).collect()]
    edges = [_edge(r) for r in query_plan.ordered_edges(found.edges).collect()]
    return {"projectRoot": os.path.abspath(root), "expression": parsed.source, "count": len(nodes), "nodes": nodes, "edges": edges}


def impact_project(spark: SparkSession, root: str, text: str, depth: int = 2) -> dict[str, Any]:
    found = impact_plan.run(open_project(spark, root), text, depth, os.path.abspath(root))
    nodes = [_node(r) for r in query_plan.ordered_symbols(found.nodes).collect()]
    return {
        "projectRoot": os.path.abspath(root),
        "input": text,
        "depth": depth,
        "seeds": [_node(r) for r in query_plan.ordered_symbols(found.seeds).collect()],
        "count": len(nodes) + found.require_files.count(),
        "nodes": nodes,
        "files": [r["path"] for r in found.files.orderBy(F.collate("path", "UNICODE")).collect()],
        "edges": [_edge(r) for r in query_plan.ordered_edges(found.edges).collect()],
    }


def explain_project(spark: SparkSession, root: str, text: str, depth: int = 2) -> dict[str, Any]:
    graph = open_project(spark, root)
    sources = scan.read_texts(spark, os.path.abspath(root), config.required(root)).select("path", "text")
    r = explain_plan.run(graph, sources, text, depth, os.path.abspath(root))
    return {"projectRoot": os.path.abspath(root), "input": text, "depth": depth, "target": r.target, "entrypoints": r.entrypoints, "flow": r.flow, "branches": r.branches, "dependencies": r.dependencies, "dataFlow": r.data_flow, "externalGaps": r.external_gaps}


def sample_project(spark: SparkSession, root: str, limit: int = 20) -> dict[str, Any]:
    lang.positive(limit, "limit")
    rows = reports.sample(open_project(spark, root), limit).collect()
    if not rows:
        raise LookupError("the project isn't indexed: it has no symbols")
    names = {"qualified_name": "qualifiedName", "file_path": "filePath", "start_line": "startLine", "is_local": "isLocal"}
    return {"projectRoot": os.path.abspath(root), "count": len(rows), "symbols": [{names.get(k, k): v for k, v in r.asDict().items()} for r in rows]}


def viewer_graph(spark: SparkSession, root: str) -> dict[str, Any]:
    settings = config.required(root)
    if not store.is_indexed(_folder(root, settings)):
        return {"nodes": [], "edges": []}
    nodes, edges = reports.viewer_graph(open_project(spark, root))
    shown = [{"id": r["id"], "type": r["type"], "kind": r["kind"], "label": r["label"], "filePath": r["file_path"], "startLine": r["start_line"], "signature": r["signature"]} for r in nodes.collect()]
    linked = [{k: v for k, v in (("source", r["source"]), ("target", r["target"]), ("kind", r["kind"]), ("moduleName", r["module_name"]), ("isResolved", r["is_resolved"])) if v is not None} for r in edges.collect()]
    return {"nodes": shown, "edges": linked}
