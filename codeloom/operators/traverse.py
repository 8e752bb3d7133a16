"""Bounded traversals: one join per level for the whole frontier.

Between levels the frontier and what was visited are checkpointed, so plans stay as long
as one level, and a search ends when its frontier is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import checkpointed


@dataclass(frozen=True)
class Reached:
    """nodes: (id), each once. edges: the edges met, each once, as they are stored."""

    nodes: DataFrame
    edges: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def search(seeds: DataFrame, edges: DataFrame, origin: str, far: str, depth: int, far_nodes: DataFrame | None = None, cut: bool = True) -> Reached:
    """Breadth first from seeds(id) over edges, from the origin column to the far one.

    Every edge out of the frontier is recorded and so is its far end, even one visited
    before: seeds appear only if they are reached again. Only far ends not visited go on.
    far_nodes(id), if given, are the only far ends that count, at every hop. cut=False
    keeps a short search in one plan, without a job per level.
    """
    if depth < 1:
        raise ValueError("depth must be a positive integer")
    frontier = seeds.select("id").distinct()
    visited = frontier
    met: list[DataFrame] = []
    for level in range(depth):
        # The frontier goes first: what is left of the edges is small.
        step = edges.join(frontier.select(F.col("id").alias(origin)), origin, "left_semi")
        if far_nodes is not None:
            step = step.join(far_nodes.select(F.col("id").alias(far)), far, "left_semi")
        step = step.select(*edges.columns)
        if cut:
            step = checkpointed(step)
        met.append(step)
        if level + 1 == depth:
            break
        frontier = step.select(F.col(far).alias("id")).distinct().join(visited, "id", "left_anti")
        if cut:
            frontier = checkpointed(frontier)
            if frontier.isEmpty():
                break
        visited = visited.unionByName(frontier)
    found = _union(met).distinct()
    return Reached(found.select(F.col(far).alias("id")).distinct(), found)


def first_callers(seeds: DataFrame, calls: DataFrame, depth: int, rank: Column, cut: bool = True) -> Reached:
    """Reverse call search that keeps one edge for each new caller.

    seeds is (id, ...) and rank its order at the first level; from the second on the
    frontier goes by id. A new caller's edge is the one to the first target of the
    frontier, then by line and column. Callers visited before give no edge.
    """
    if depth < 1:
        raise ValueError("depth must be a positive integer")
    frontier = seeds.select("id", rank.alias("rank")).groupBy("id").agg(F.min("rank").alias("rank"))
    visited = frontier.select("id")
    met: list[DataFrame] = []
    for level in range(depth):
        targets = frontier.select(F.col("id").alias("dst_id"), "rank")
        fresh = calls.join(targets, "dst_id").join(visited.select(F.col("id").alias("src_id")), "src_id", "left_anti")
        order = F.struct("rank", "dst_id", "line", "column")
        step = fresh.groupBy("src_id").agg(F.min_by(F.struct("dst_id", "line", "column", "is_resolved"), order).alias("e")).select("src_id", "e.*")
        if cut:
            step = checkpointed(step)
        met.append(step)
        if level + 1 == depth or cut and step.isEmpty():
            break
        found = step.select(F.col("src_id").alias("id"))
        visited = visited.unionByName(found)
        frontier = found.select("id", F.struct(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("d")).alias("rank"))
    edges = _union(met)
    return Reached(edges.select(F.col("src_id").alias("id")).distinct(), edges)


def dependents(seeds: DataFrame, requires: DataFrame, depth: int, cut: bool = True) -> tuple[DataFrame, DataFrame]:
    """Reverse require search from each seed(path) by itself: (files(path), edges).

    Searches don't see each other's visited files, so a seed may be found from another or
    through a cycle. Unresolved self-loops don't count.
    """
    if depth < 1:
        raise ValueError("depth must be a positive integer")
    usable = requires.where("src_path <> dst_path")
    frontier = seeds.select(F.col("path").alias("root"), "path").distinct()
    visited = frontier
    met: list[DataFrame] = []
    for level in range(depth):
        step = usable.join(frontier.select("root", F.col("path").alias("dst_path")), "dst_path").select("root", *requires.columns)
        if cut:
            step = checkpointed(step)
        met.append(step)
        if level + 1 == depth:
            break
        frontier = step.select("root", F.col("src_path").alias("path")).distinct().join(visited, ["root", "path"], "left_anti")
        if cut:
            frontier = checkpointed(frontier)
            if frontier.isEmpty():
                break
        visited = visited.unionByName(frontier)
    edges = _union(met).select(*requires.columns).distinct()
    return edges.select(F.col("src_path").alias("path")).distinct(), edges


def call_paths(entrypoints: DataFrame, calls: DataFrame, depth: int, cut: bool = True) -> DataFrame:
    """All call paths of at most depth edges from entrypoints(id).

    (entrypoint, depth, trail, src_id, dst_id, line, column, is_resolved): trail is an
    array of (line, column, dst_id) of the edges so far, which orders the rows as a
    depth-first walk would. A callee that is on the path already is a last row, not gone
    into. Repeated edges give repeated paths.
    """
    if depth < 1:
        raise ValueError("depth must be a positive integer")
    mark = F.struct(F.col("line"), F.col("column"), F.col("dst_id"))
    open_ = entrypoints.select(F.col("id").alias("entrypoint"), F.col("id").alias("src_id"), F.array("id").alias("on_path"), F.array().cast("array<struct<line:long,column:long,dst_id:string>>").alias("so_far"))
    out: list[DataFrame] = []
    edges = calls.select("src_id", F.col("dst_id").cast("string").alias("dst_id"), F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "is_resolved")
    for level in range(1, depth + 1):
        step = open_.join(edges, "src_id").select("entrypoint", F.lit(level).alias("depth"), F.array_append("so_far", mark).alias("trail"), "on_path", "src_id", "dst_id", "line", "column", "is_resolved")
        if cut:
            step = checkpointed(step)
        out.append(step.drop("on_path"))
        if level == depth or cut and step.isEmpty():
            break
        open_ = step.where(~F.array_contains("on_path", F.col("dst_id"))).select("entrypoint", F.col("dst_id").alias("src_id"), F.array_append("on_path", F.col("dst_id")).alias("on_path"), F.col("trail").alias("so_far"))
    return _union(out)


def neighbours(ids: DataFrame, edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Ids one edge away from ids(id), in either direction."""
    far = edges.join(ids.select(F.col("id").alias(source)), source, "left_semi").select(F.col(target).alias("id"))
    near = edges.join(ids.select(F.col("id").alias(target)), target, "left_semi").select(F.col(source).alias("id"))
    return far.unionByName(near).distinct()
