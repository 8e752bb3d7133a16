"""A report on one file or symbol: ways in, call paths, branches, data flow and gaps."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths, text
from codeloom.model import Graph
from codeloom.operators import traverse
from codeloom.operators.resolve import latest_scopes
from codeloom.plans import lang
from codeloom.plans.query import named, ordered_symbols


def external_callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, external): distinct callers from other files; symbols without any are 0."""
    home = symbols.select("id", "file_path")
    met = calls.join(home.select(F.col("id").alias("dst_id"), F.col("file_path").alias("home")), "dst_id").join(home.select(F.col("id").alias("src_id"), F.col("file_path").alias("away")), "src_id").where("home <> away")
    counts = met.groupBy(F.col("dst_id").alias("id")).agg(F.count_distinct("src_id").alias("external"))
    return home.join(counts, "id", "left").select("id", F.coalesce("external", F.lit(0)).alias("external"))


def callee_counts(calls: DataFrame) -> DataFrame:
    """(id, call_out): distinct callees of every caller."""
    return calls.groupBy(F.col("src_id").alias("id")).agg(F.count_distinct("dst_id").alias("call_out"))


def ranked_entrypoints(symbols: DataFrame, all_symbols: DataFrame, calls: DataFrame, limit: int = text.ENTRYPOINTS) -> DataFrame:
    """Functions and methods by 3 * external callers + callees; the first limit of them."""
    some = symbols.where(F.col("kind").isin("function", "method"))
    mine = calls.join(some.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    external = external_callers(all_symbols, mine)
    out = callee_counts(calls.join(some.select(F.col("id").alias("src_id")), "src_id", "left_semi"))
    scored = some.join(external, "id", "left").join(out, "id", "left").withColumn("external", F.coalesce("external", F.lit(0))).withColumn("call_out", F.coalesce("call_out", F.lit(0)))
    scored = scored.withColumn("score", 3 * F.col("external") + F.col("call_out"))
    return scored.orderBy(F.desc("score"), F.desc("external"), F.desc("call_out"), "start_line", "qualified_name", "id").limit(limit)


def is_explicit(external: Column) -> Column:
    """Called from other files, an exported function, or in JavaScript called from at most one."""
    script = F.col("file_path").rlike(r"\.(js|jsx|ts|tsx)$")
    return (external > 0) | (F.col("is_exported") & (F.col("kind") == "function")) | (script & (external <= 1))


def branches(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, line, kind, condition, function_name) of the branching lines.

    Each belongs to the scope around it that starts last, else to its file.
    """
    found = lines.withColumn("t", text.trim(F.col("code"))).withColumn("b", text.branch(F.col("t"))).where("b is not null").select("file_path", "line", "b.kind", "b.condition")
    owned = latest_scopes(found.select("file_path", "line"), symbols, ("file_path", "line"))
    return found.join(owned, ["file_path", "line"], "left").select("file_path", "line", "kind", "condition", F.coalesce("owner_name", "file_path").alias("function_name"))


def line_steps(lines: DataFrame) -> DataFrame:
    """(file_path, line, source, label): what each line does, the first form that fits."""
    t, value, name = F.col("t"), F.col("value"), F.col("name")
    trimmed = lines.select("file_path", "line", text.trim(F.col("code")).alias("t"))
    cut = trimmed.select("file_path", "line", "t", text.before(t, "=").alias("left"), text.after(t, "=").alias("value"), text.called(t).alias("called"), text.is_control(t).alias("control"), text.whole_word(t, "return").alias("returns"))
    named = cut.select("*", F.when((value != "") & ~F.col("control") & ~t.contains("=>") & ~text.is_method(F.col("called")), text.target(F.col("left"))).alias("name"))
    calls = F.col("called").isNotNull() & text.after(t, "(").contains(")") & ~F.col("control") & ~F.col("returns")
    source = F.when(name.isNotNull(), F.when(text.is_state(name), "state").otherwise("assignment")).when(calls, "call").when(F.col("returns"), "return")
    said = named.select("file_path", "line", source.alias("source"), "name", F.when(name.isNotNull(), value).when(F.col("returns"), F.substr(t, F.lit(len("return") + 1))).otherwise(t).alias("said"))
    short = said.select("file_path", "line", "source", "name", text.summary(F.col("said")).alias("said"))
    label = F.when(F.col("name").isNotNull(), F.concat("name", F.lit(" = "), "said")).when((F.col("source") == "return") & (F.col("said") == ""), "result").otherwise(F.col("said"))
    return short.select("file_path", "line", "source", F.when(F.col("source").isNotNull(), label).alias("label"))


def step_rank(source: Column) -> Column:
    out = F.lit(99)
    for name, rank in text.SOURCE_RANK.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def ordered_steps(steps: DataFrame, keys: tuple[str, ...] = (), limit: int = text.STEPS) -> DataFrame:
    """steps(*keys, seq, source, line, label): of equal ones the first, by line and source;
    the first limit, with the earliest return step as the last if none is among them."""
    part = list(keys)
    once = steps.groupBy(*part, "source", "line", "label").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy(*part).orderBy(F.coalesce("line", F.lit(0)), step_rank(F.col("source")), "seq")
    ranked = once.withColumn("n", F.row_number().over(order))
    whole = Window.partitionBy(*part)
    returns = F.col("source") == "return"
    ranked = ranked.withColumn("has_return", F.max((returns & (F.col("n") <= limit)).cast("int")).over(whole)).withColumn("first_return", F.min(F.when(returns, F.col("seq"))).over(whole))
    kept = (F.col("n") < limit) | ((F.col("n") == limit) & ((F.col("has_return") == 1) | F.col("first_return").isNull())) | ((F.col("has_return") == 0) & returns & (F.col("seq") == F.col("first_return")))
    last = ranked.where(kept)
    return last.select(*part, F.row_number().over(Window.partitionBy(*part).orderBy("n")).alias("order"), "source", "line", "label")


@dataclass
class Report:
    target: dict[str, Any]
    entrypoints: list[dict[str, Any]] = field(default_factory=list)
    flow: list[dict[str, Any]] = field(default_factory=list)
    branches: list[dict[str, Any]] = field(default_factory=list)
    dependencies: list[dict[str, Any]] = field(default_factory=list)
    data_flow: list[dict[str, Any]] = field(default_factory=list)
    external_gaps: list[str] = field(default_factory=list)


def _resolve(graph: Graph, given: str, root: str | None) -> tuple[str, dict[str, Any] | None]:
    """The file to read and, unless the target is the file, the symbol."""
    wanted = given.strip()
    if not wanted:
        raise lang.QueryError("the input is empty")
    try:
        fragment = paths.fragment_of(wanted, root)
        found = graph.files.where(paths.fragment_column(F.col("path"), fragment)).orderBy(F.collate("path", "UNICODE")).select("path").first()
    except ValueError:
        found = None
    file = found["path"] if found else None
    symbol = ordered_symbols(graph.symbols.where(named(wanted))).first()
    if paths.looks_like_path(wanted) and file is not None:
        return file, None
    if symbol is not None:
        return symbol["file_path"], symbol.asDict()
    if file is not None:
        return file, None
    raise LookupError(f"nothing to explain: {given}")


def _entrypoint(s: dict[str, Any]) -> dict[str, Any]:
    return {"name": s["name"], "qualifiedName": s["qualified_name"], "kind": s["kind"], "filePath": s["file_path"], "startLine": s["start_line"], "isExported": s["is_exported"], "externalCallCount": s["external"]}


def _owner(qualified: str) -> str:
    at = max(qualified.rfind(":"), qualified.rfind("."))
    return qualified[:at] if at > 0 else ""


def _selected(symbols: list[dict[str, Any]], explicit: set[str], target: dict[str, Any] | None) -> list[dict[str, Any]]:
    """Constructors first, or the target and its own, then the explicit ones; each once."""
    heads = {s["qualified_name"] for s in symbols if s["kind"] in ("class", "table")}
    constructors = [s for s in symbols if s["kind"] == "method" and s["name"] == "ctor" and _owner(s["qualified_name"]) in heads]
    first = constructors
    if target is not None:
        own = [s for s in symbols if s["id"] == target["id"] and s["kind"] in ("function", "method")]
        first = own + [c for c in constructors if target["kind"] in ("class", "table") and _owner(c["qualified_name"]) == target["qualified_name"]]
    chosen = {s["id"]: s for s in first + [s for s in symbols if s["id"] in explicit]}
    return list(chosen.values())[: text.ENTRYPOINTS]


def _trees(graph: Graph, heads: list[dict[str, Any]], depth: int) -> list[dict[str, Any]]:
    """Call trees from the rows of call_paths; only rows of the chosen heads are collected."""
    if not heads:
        return []
    spark = graph.spark
    starts = spark.createDataFrame([(s["id"],) for s in heads], "id string")
    walked = traverse.call_paths(starts, graph.calls, depth)
    names = graph.symbols.select("id", "qualified_name", "file_path")
    rows = walked.join(names.select(F.col("id").alias("src_id"), F.col("qualified_name").alias("src_name")), "src_id").join(names.select(F.col("id").alias("dst_id"), F.col("qualified_name").alias("dst_name"), "file_path"), "dst_id").collect()
    by_parent: dict[tuple, list] = {}
    for r in rows:
        trail = tuple((t["line"], t["column"], t["dst_id"]) for t in r["trail"])
        by_parent.setdefault((r["entrypoint"], trail[:-1]), []).append((r, trail))

    def below(entrypoint: str, trail: tuple) -> list[dict[str, Any]]:
        found = sorted(by_parent.get((entrypoint, trail), []), key=lambda x: (x[0]["line"], x[0]["column"], x[0]["dst_name"], x[0]["dst_id"]))
        return [{"from": r["src_name"], "to": r["dst_name"], "filePath": r["file_path"], "line": r["line"], "isResolved": r["is_resolved"], "calls": below(entrypoint, t)} for r, t in found]

    return [{"entrypoint": s["qualified_name"], "filePath": s["file_path"], "calls": below(s["id"], ())} for s in heads]


def flat(calls: list[dict[str, Any]]) -> list[dict[str, Any]]:
    return [x for c in calls for x in (c, *flat(c["calls"]))]


def run(graph: Graph, sources: DataFrame, given: str, depth: int = 2, root: str | None = None) -> Report:
    """Explain a file or symbol; sources is (path, text).

    Only the rows of one file reach the driver: its symbols, branches, steps and call paths.
    """
    lang.positive(depth, "depth")
    file, target = _resolve(graph, given, root)
    own = graph.symbols.where(F.col("file_path") == file)
    inbound = graph.calls.join(own.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    counted = own.join(external_callers(graph.symbols, inbound), "id").withColumn("explicit", F.col("kind").isin("function", "method") & is_explicit(F.col("external")))
    symbols = sorted((r.asDict() for r in counted.collect()), key=lambda s: (s["start_line"], s["qualified_name"], s["id"]))
    report = Report({"type": "file", "name": file.rpartition("/")[2], "filePath": file} if target is None else {"type": "symbol", "name": target["qualified_name"], "filePath": file, "startLine": target["start_line"]})
    selected = _selected(symbols, {s["id"] for s in symbols if s["explicit"]}, target)
    report.entrypoints = [_entrypoint(s) for s in selected]
    # A flow belongs to the file's first symbol of the entrypoint's name.
    firsts = {s["qualified_name"]: s for s in reversed(symbols)}
    report.flow = _trees(graph, [firsts[s["qualified_name"]] for s in selected[: text.FLOWS]], depth)
    numbered = text.lines(sources.where(F.col("path") == file))
    found = branches(numbered, own).orderBy("line", F.collate("function_name", "UNICODE")).collect()
    report.branches = [{"functionName": r["function_name"], "line": r["line"], "kind": r["kind"], "condition": r["condition"]} for r in found]
    needed = graph.requires.where(F.col("src_path") == file).orderBy(*[F.collate(c, "UNICODE") for c in ("src_path", "dst_path", "module_name")]).collect()
    report.dependencies = [{"moduleName": r["module_name"], "source": r["src_path"], "target": r["dst_path"], "isResolved": r["is_resolved"]} for r in needed]
    report.data_flow = _data_flow(graph, report, numbered, own, symbols, target, file)
    report.external_gaps = _gaps(report, file)
    return report


def _data_flow(graph: Graph, report: Report, numbered: DataFrame, own: DataFrame, symbols: list[dict[str, Any]], target: dict[str, Any] | None, file: str) -> list[dict[str, Any]]:
    if target is None:
        top = ranked_entrypoints(own, graph.symbols, graph.calls).collect()
        return [{"order": i + 1, "label": r["qualified_name"], "source": "top-method", "filePath": r["file_path"], "line": r["start_line"]} for i, r in enumerate(top)]
    first, last = target["start_line"], target["end_line"]
    body = numbered.where((F.col("line") >= first) & (F.col("line") <= last))
    header = body.where(F.col("line") < first + text.HEADER_LINES).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "code"))), lambda r: r["code"]), " ").alias("h"))
    names = header.select(text.parameters(F.col("h")).alias("p")).first()["p"] or []
    steps = [{"order": 1, "label": "input " + (", ".join(names) or target["qualified_name"]), "source": "input", "filePath": file}]
    if target["kind"] in ("function", "method"):
        steps.append({"order": 2, "label": target["qualified_name"], "source": "entrypoint", "filePath": file, "line": first})
        steps += _method_steps(graph, report, body, target, file)
    if len(steps) == 1:
        steps.append({"order": 2, "label": "result", "source": "return", "filePath": file})
    return [s | {"order": i + 1} for i, s in enumerate(steps)]


def _method_steps(graph: Graph, report: Report, body: DataFrame, target: dict[str, Any], file: str) -> list[dict[str, Any]]:
    flow = next((f for f in report.flow if f["entrypoint"] == target["qualified_name"]), None)
    called = {c["line"]: c for c in flat(flow["calls"] if flow else [])}
    rows = [(0, "branch", b["line"], b["condition"]) for b in report.branches if b["functionName"] == target["qualified_name"]]
    for r in line_steps(body).orderBy("line").collect():
        if r["source"] is not None:
            rows.append((1, r["source"], r["line"], r["label"]))
        elif r["line"] in called:
            rows.append((1, "callee", r["line"], called[r["line"]]["to"]))
    if not any(r[1] == "return" for r in rows):
        rows.append((2, "return", target["end_line"], "side effects"))
    steps = graph.spark.createDataFrame([(i, s, n, label) for i, (_, s, n, label) in enumerate(rows)], "seq long, source string, line long, label string")
    out = ordered_steps(steps).orderBy("order").collect()
    return [{"order": 0, "label": r["label"], "source": r["source"], "filePath": called[r["line"]]["filePath"] if r["source"] == "callee" else file, "line": r["line"]} for r in out]


def _gaps(report: Report, file: str) -> list[str]:
    out = set()
    for d in report.dependencies:
        if not d["isResolved"]:
            out.add(f"unresolved require/import: {d['moduleName']}")
        elif d["target"] != file:
            out.add(f"external dependency: {d['moduleName']} -> {d['target']}")
    for f in report.flow:
        out |= {f"external function: {c['to']} -> {c['filePath']}" for c in flat(f["calls"]) if c["filePath"] != file}
    return sorted(out)
