"""Results as JSON, boxed tables, trees and Markdown."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

REVERSE = ("callers", "subclasses")
RELATIONS = ("callers", "callees", "extends", "subclasses", "requires", "dependents")
#: How many rows sections of the report show, and what an empty one says.
SHOWN_ENTRYPOINTS, SHOWN_FLOWS, SHOWN_CALLS, SHOWN_BRANCHES, SHOWN_CONTRACTS, NOTHING = 20, 5, 5, 5, 10, "None"


def as_json(result: Any) -> str:
    return json.dumps(result, indent=2, ensure_ascii=False)


def table(headers: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    cells = [["" if x is None else str(x) for x in row] for row in rows]
    widths = [max(map(len, column)) for column in zip(headers, *cells)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda row: "| " + " | ".join(x.ljust(w) for x, w in zip(row, widths)) + " |"
    return "\n".join([rule, line(headers), rule, *map(line, cells), rule])


def tree(label: str, children: Sequence[tuple]) -> str:
    """children: (label, children) pairs, drawn with connectors."""
    out = [label]

    def draw(nodes: Sequence[tuple], indent: str) -> None:
        for i, (text, below) in enumerate(nodes):
            last = i + 1 == len(nodes)
            out.append(f"{indent}{'└── ' if last else '├── '}{text}")
            draw(below, indent + ("    " if last else "│   "))

    draw(children, "")
    return "\n".join(out)


def id_parts(symbol_id: str) -> tuple[str, int] | None:
    """The file and line in a symbol id."""
    head, mark, location = symbol_id.rpartition("#")
    line, colon, _ = location.partition(":")
    return (symbol_id.partition("#")[0], int(line)) if mark and colon and line.isdigit() else None


def id_name(symbol_id: str) -> str:
    parts = symbol_id.split("#")
    return parts[2] if len(parts) > 2 else symbol_id


def id_location(symbol_id: str) -> str:
    found = id_parts(symbol_id)
    return f"{found[0]}:{found[1]}" if found else symbol_id


def _relation(expression: str) -> tuple[str, str] | None:
    for token in expression.split():
        key, _, value = token.partition(":")
        if key in RELATIONS and value:
            return key, value
    return None


def _callable(name: str) -> str:
    return name if name.endswith(")") else f"{name}()"


def _symbol_key(node: dict[str, Any]) -> tuple:
    return node["filePath"].casefold(), node["startLine"], node["kind"], node["qualifiedName"].casefold()


def _symbols(nodes: Sequence[dict[str, Any]]) -> dict[str, dict[str, Any]]:
    return {n["id"]: n for n in nodes if n["type"] == "Symbol"}


def _cells(node: dict[str, Any]) -> list[Any]:
    if node["type"] == "File":
        return [node["path"], node["kind"], node["path"], "", ""]
    return [node["qualifiedName"], node["kind"], node["filePath"], node["startLine"], node["signature"]]


def _ends(relation: str, edge: dict[str, Any]) -> tuple[str, str]:
    """Where an edge starts and leads to, in a relation's direction."""
    return (edge["target"], edge["source"]) if relation in REVERSE or relation == "dependents" else (edge["source"], edge["target"])


def _roots(relation: str, nodes: dict[str, Any], edges: Sequence[dict[str, Any]]) -> list[str]:
    return sorted({_ends(relation, e)[0] for e in edges} - nodes.keys())


def _summary(value: str, roots: list[str]) -> str:
    place = id_parts(roots[0]) if roots and value != "*" else None
    return f"{value} ({place[0]}:{place[1]})" if place else value


def query_table(result: dict[str, Any]) -> str:
    found = _relation(result["expression"])
    edges = result["edges"]
    if found is None:
        rows = [_cells(n) for n in result["nodes"]]
        return f"{table(['Name', 'Kind', 'File', 'Line', 'Signature'], rows)}\n{len(rows)} rows, target: {result['expression']}"
    relation, value = found
    nodes = _symbols(result["nodes"])
    if relation in ("requires", "dependents"):
        rows = [[e["source"], e["target"], e["moduleName"], str(e["isResolved"]).lower()] for e in sorted(edges, key=lambda e: (e["source"], e["target"], e["moduleName"]))]
        return f"{table(['Requiring File', 'Required File', 'Module', 'Resolved'], rows)}\n{len(rows)} rows, target: {value}"
    target = _summary(value, _roots(relation, nodes, edges))
    if relation in ("callers", "callees"):
        pairs = sorted(((nodes[far], e) for e in edges if (far := _ends(relation, e)[1]) in nodes), key=lambda p: _symbol_key(p[0]))
        rows = [[n["qualifiedName"], n["kind"], n["filePath"], e["line"], e["column"]] for n, e in pairs]
        return f"{table(['Caller' if relation == 'callers' else 'Callee', 'Kind', 'File', 'Line', 'Col'], rows)}\n{len(rows)} rows, target: {target}"
    rows = [[id_name(e["source"]), id_name(e["target"]), id_location(e["source"]), id_location(e["target"])] for e in sorted(edges, key=lambda e: (id_name(e["source"]), id_name(e["target"]), e["source"]))]
    return f"{table(['Child', 'Parent', 'Child File', 'Parent File'], rows)}\n{len(rows)} rows, target: {target}"


def _grown(start: str, children: Callable[[str], list[tuple[str, str]]], path: frozenset[str]) -> list[tuple]:
    """Below a node: (label, id) pairs of children, gone into unless they are on the path."""
    return [(f"{label} (cycle)", []) if far in path else (label, _grown(far, children, path | {far})) for label, far in children(start)]


def query_tree(result: dict[str, Any]) -> str:
    found = _relation(result["expression"])
    if found is None:
        lines = [f"  {n['kind']} {n['path']}" if n["type"] == "File" else f"  {n['filePath']}:{n['startLine']} {n['kind']} {n['qualifiedName']} {n['signature']}" for n in result["nodes"]]
        return "\n".join([result["expression"], *lines])
    relation, value = found
    edges = result["edges"]
    if relation in ("requires", "dependents"):
        word = "requires" if relation == "requires" else "required by"
        files = lambda at: [(f"{word} {far} [{e['moduleName']}, resolved={str(e['isResolved']).lower()}]", far) for e in edges for near, far in [_ends(relation, e)] if near == at]
        return tree(value, _grown(value, files, frozenset([value])))
    nodes = _symbols(result["nodes"])
    words = {"callers": "called by", "callees": "calls", "extends": "extends", "subclasses": "subclass"}

    def children(at: str) -> list[tuple[str, str]]:
        pairs = sorted(((nodes[far], e) for e in edges for near, far in [_ends(relation, e)] if near == at and far in nodes), key=lambda p: _symbol_key(p[0]))
        return [(f"{words[relation]} {_callable(n['qualifiedName'])} [{n['filePath']}:{e['line']}]" if e["kind"] == "Calls" else f"{words[relation]} {n['qualifiedName']} [{n['filePath']}:{n['startLine']}]", n["id"]) for n, e in pairs]

    roots = _roots(relation, nodes, edges)
    head = lambda r: _callable(value) + (f"  ({p[0]}:{p[1]})" if (p := id_parts(r)) else "")
    return "\n\n".join(tree(head(r), _grown(r, children, frozenset([r]))) for r in roots) or _callable(value)


def impact_table(result: dict[str, Any]) -> str:
    headers = ["Name", "Kind", "File", "Line", "Signature"]
    parts = [f"input: {result['input']}", f"depth: {result['depth']}", f"count: {result['count']}"]
    for title, names, rows in (("seeds", headers, [_cells(n) for n in result["seeds"]]), ("affected", headers, [_cells(n) for n in result["nodes"]]), ("files", ["Path"], [[f] for f in result["files"]])):
        parts += ["", title, table(names, rows), f"{len(rows)} rows"]
    return "\n".join(parts)


def impact_tree(result: dict[str, Any]) -> str:
    nodes = _symbols([*result["seeds"], *result["nodes"]])
    edges = [e for e in result["edges"] if e["kind"] != "Requires"]

    def children(at: str) -> list[tuple[str, str]]:
        pairs = sorted(((nodes[e["source"]], e) for e in edges if e["target"] == at and e["source"] in nodes), key=lambda p: _symbol_key(p[0]))
        return [(f"called by {_callable(n['qualifiedName'])} [{n['filePath']}:{e['line']}]" if e["kind"] == "Calls" else f"subclass {n['qualifiedName']} [{n['filePath']}:{n['startLine']}]", n["id"]) for n, e in pairs]

    drawn = [tree(f"{_callable(s['qualifiedName'])}  ({s['filePath']}:{s['startLine']})", _grown(s["id"], children, frozenset([s["id"]]))) for s in sorted(result["seeds"], key=_symbol_key)]
    return "\n\n".join(drawn) or _callable(result["input"])


def _flat(calls: Sequence[dict[str, Any]]) -> list[dict[str, Any]]:
    return [x for c in calls for x in (c, *_flat(c["calls"]))]


def _unique(values: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(values))


def _reason(entrypoint: dict[str, Any], target: dict[str, Any]) -> str:
    if target["type"] == "symbol" and entrypoint["qualifiedName"] == target["name"]:
        return "selected-symbol"
    if entrypoint["externalCallCount"] > 0:
        return "external-call"
    return "exported" if entrypoint["isExported"] else "low-inbound"


def _step(step: dict[str, Any], given: str) -> str:
    label, source = step["label"], step["source"]
    if source == "input":
        return label if label.startswith("input ") else f"input {given}"
    words = {"entrypoint": "method", "top-method": "", "assignment": "assign", "branch": "branch", "state": "state/write", "call": "call", "callee": "call", "return": "return"}
    if source == "return":
        label = label.removeprefix("return ")
    return f"{words[source]} {label}".strip()


def explain_text(result: dict[str, Any]) -> str:
    target, file = result["target"], result["target"]["filePath"]
    calls = [c for f in result["flow"] for c in _flat(f["calls"])]
    names = _unique([e["qualifiedName"] for e in result["entrypoints"]] + [x for c in calls for x in (c["from"], c["to"])])
    entry = []
    for e in result["entrypoints"][:SHOWN_ENTRYPOINTS]:
        entry += [f"- {e['qualifiedName']}", f"  - reason: {_reason(e, target)}", f"  - line: {e['startLine']}"]
    if len(result["entrypoints"]) > SHOWN_ENTRYPOINTS:
        entry.append("- ...")
    logic = []
    for i, f in enumerate(result["flow"][:SHOWN_FLOWS]):
        logic += [f"{i + 1}. {f['entrypoint']}", f"   - calls: {', '.join(_unique([c['to'] for c in f['calls']])[:SHOWN_CALLS]) or NOTHING}"]
        inside = {f["entrypoint"], *(c["to"] for c in _flat(f["calls"]))}
        matched = [b for b in result["branches"] if b["functionName"] in inside][:SHOWN_BRANCHES]
        logic += ["   - branches:"] * bool(matched) + [f"     - {b['condition']} -> {b['functionName']}" for b in matched]
    whole = target["type"] == "file"
    steps = [f"- {_step(s, result['input'])}" for s in (result["dataFlow"][:SHOWN_ENTRYPOINTS] if whole else result["dataFlow"])]
    if whole and len(result["dataFlow"]) > SHOWN_ENTRYPOINTS:
        steps.append("- ...")
    contracts = _unique([f"- {d['moduleName']}\n  - reason: project-dependency" for d in result["dependencies"] if d["isResolved"] and d["target"] != file] + [f"- {c['to']}\n  - reason: cross-file-call" for c in calls if c["isResolved"] and c["filePath"] != file])
    unresolved = _unique([d["moduleName"] for d in result["dependencies"] if not d["isResolved"]] + [c["to"] for c in calls if not c["isResolved"]])
    none = f"- {NOTHING}"
    return "\n".join(
        [
            f"# Explain: {file if whole else target['name']}",
            "",
            "## Overview",
            f"- file: {file}",
            f"- symbols: {len(names)}",
            f"- calls: {len(calls)}",
            f"- requires: {len(result['dependencies'])}",
            "",
            "## Entry Points",
            "\n".join(entry) or none,
            "",
            "## Internal Logic",
            "\n".join(logic) or f"1. {NOTHING}",
            "",
            "## Top Method Flow" if whole else "## Data Flow",
            "\n".join(steps) or none,
            "",
            "## External Contracts",
            "\n".join(contracts[:SHOWN_CONTRACTS]) or none,
            "",
            "## Unresolved Runtime",
            "\n".join(f"- {n}" for n in unresolved) or none,
        ]
    )


def sample_table(result: dict[str, Any]) -> str:
    rows = [f"{s['filePath']}:{s['startLine']} {s['kind']} {s['qualifiedName']} local={str(s['isLocal']).lower()} {s['signature']}" for s in result["symbols"]]
    return "\n".join([f"projectRoot: {result['projectRoot']}", f"count: {result['count']}", *rows])


def counters(result: dict[str, Any]) -> str:
    return "\n".join(f"{k}: {v}" for k, v in result.items())


#: The renderer of each command and format.
FORMATS: dict[str, dict[str, Callable[[dict[str, Any]], str]]] = {
    "init": {"json": as_json},
    "status": {"json": as_json},
    "sample": {"json": as_json, "table": sample_table},
    "query": {"json": as_json, "table": query_table, "tree": query_tree},
    "impact": {"json": as_json, "table": impact_table, "tree": impact_tree},
    "explain": {"text": explain_text, "json": as_json},
    "index": {"json": as_json, "table": as_json},
    "sync": {"json": as_json, "table": counters},
}
