"""Whole projects: index, query, impact, explain, sync, renderers, command line, HTTP."""

import json
import urllib.error
import urllib.request

import pytest
from codeloom import cli, render, serve, streaming
from codeloom.plans import lang, reports
from codeloom.plans import project as P
from codeloom.sources import config, scan, store

FLOW = """function foo() end

M = {}
function M.foo() end

function obj:foo() end

function init()
  foo()
  M.foo()
  obj:foo()
  missing()
end
function boot()
  init()
end
"""


def project(tmp_path, files):
    for name, source in files.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(source)
    return str(tmp_path)


def indexed(spark, tmp_path, files):
    root = project(tmp_path, files)
    P.init_project(spark, root)
    return root, P.index_project(spark, root)


def names(result):
    return [n["qualifiedName"] if n["type"] == "Symbol" else n["path"] for n in result["nodes"]]


@pytest.fixture(scope="module")
def flow(spark, tmp_path_factory):
    return indexed(spark, tmp_path_factory.mktemp("flow"), {"a.lua": FLOW})[0]


def test_calls_and_filters(spark, flow):
    q = lambda e, d=1: P.query_project(spark, flow, e, d)
    assert names(q("name:init")) == ["init"]
    assert sorted(names(q("kind:function"))) == ["boot", "foo", "init"]
    assert names(q("kind:file")) == ["a.lua"] and names(q("name:a.lua")) == ["a.lua"]
    assert [(e["line"], e["column"]) for e in q("callers:init")["edges"]] == [(15, 3)]
    found = q("callees:init")
    assert sorted(names(found)) == ["M.foo", "foo", "obj:foo"] and len(found["edges"]) == 3
    assert names(q("callees:boot kind:method", 2)) == []  # the hop through init is filtered too
    assert sorted(names(q("callees:boot", 2))) == ["M.foo", "foo", "init", "obj:foo"]
    assert names(q("methods:obj")) == ["obj:foo"] and names(q("methods:M")) == ["M.foo"]
    for bad in ("", "x", "name:", "callers:a callees:b", "size:1"):
        with pytest.raises(lang.QueryError):
            q(bad)
    with pytest.raises(lang.QueryError):
        q("name:a", 0)


def test_node_order_is_by_text(spark, tmp_path):
    root, _ = indexed(spark, tmp_path, {"a.lua": "\n".join(f"function f{i}() end" for i in range(12))})
    assert [n["startLine"] for n in P.query_project(spark, root, "kind:function")["nodes"]][:4] == [1, 10, 11, 12]


def test_cycles_report_seeds(spark, tmp_path):
    root, _ = indexed(spark, tmp_path, {"a.lua": "function a()\n  b()\nend\nfunction b()\n  a()\nend\nfunction r()\n  r()\nend\n"})
    assert sorted(names(P.query_project(spark, root, "callers:a", 5))) == ["a", "b"]
    assert names(P.query_project(spark, root, "callees:r", 3)) == ["r"]
    found = P.impact_project(spark, root, "a", 3)
    assert names(found) == ["b"] and len(found["edges"]) == 1
    assert "(cycle)" in render.query_tree(P.query_project(spark, root, "callers:a", 5)) or render.query_tree(P.query_project(spark, root, "callers:a", 5)) == "a()"


CTOR = {"src/p.lua": 'Player = class("Player")\n', "src/q.lua": "function make()\n  return Player.new()\nend\n"}


def test_constructors(spark, tmp_path):
    root, counts = indexed(spark, tmp_path, CTOR)
    assert counts["callsCount"] == 1
    assert names(P.impact_project(spark, root, "Player")) == ["make"]
    (tmp_path / "src/r.lua").write_text('Player = class("Player")\n')
    P.sync_project(spark, root)  # two classes of the name: nothing resolves
    found = P.impact_project(spark, root, "Player")
    assert found["count"] == 0 and len(found["seeds"]) == 2
    (tmp_path / "src/r.lua").write_text('Player = class("Player")\nfunction own()\n  return Player.new()\nend\n')
    P.sync_project(spark, root)  # the class of the same file counts
    assert names(P.impact_project(spark, root, "Player")) == ["own"]


SELF = 'A = class("A")\nfunction A:ctor()\n  self:_init()\nend\nfunction A:_init()\nend\nB = class("B")\nfunction B:ctor()\n  self:_init()\nend\nfunction B:_init()\nend\n'


def test_self_calls_stay_in_the_class(spark, tmp_path):
    root, _ = indexed(spark, tmp_path, {"c.lua": SELF})
    report = P.explain_project(spark, root, "c.lua")
    assert [e["qualifiedName"] for e in report["entrypoints"][:2]] == ["A:ctor", "B:ctor"]
    assert [[c["to"] for c in f["calls"]] for f in report["flow"][:2]] == [["A:_init"], ["B:_init"]]


INHERIT = {"a.lua": "Base = {}\nChild = setmetatable({}, { __index = Base })\nGrandChild = setmetatable({}, { __index = Child })\nChild.__index = Child\nDyn = setmetatable({}, { __index = f() })\n"}


def test_inheritance(spark, tmp_path):
    root, counts = indexed(spark, tmp_path, INHERIT)
    q = lambda e, d=1: P.query_project(spark, root, e, d)
    assert counts["extendsCount"] == 2 and counts["symbolCount"] == 3
    assert names(q("extends:Child")) == ["Base"] and names(q("subclasses:Child")) == ["GrandChild"]
    assert q("extends:*")["edges"] == q("subclasses:*")["edges"]
    assert names(P.impact_project(spark, root, "Base")) == ["Child", "GrandChild"]
    assert "| Child | Base   | a.lua:2    | a.lua:1     |" in render.query_table(q("extends:Child"))


REQ = {"src/main.lua": 'local u = require("utils")\nlocal d = require("a" .. b)\n', "src/feature.lua": 'require("utils")\n', "src/utils.lua": "", "lib/deep/only.lua": "", "x.lua": 'require("alias.src.utils")\nrequire("only")\nrequire("src.utils.lua")\n'}


def test_requires(spark, tmp_path):
    root, _ = indexed(spark, tmp_path, REQ)
    q = lambda e, d=1: P.query_project(spark, root, e, d)
    edges = {(e["target"], e["moduleName"], e["isResolved"]) for e in q("requires:src/main.lua")["edges"]}
    assert edges == {("src/utils.lua", "utils", True), ("src/main.lua", '"a" .. b', False)}
    assert names(q("dependents:src/utils.lua")) == ["src/feature.lua", "src/main.lua", "x.lua"]
    assert {(e["target"], e["isResolved"]) for e in q("requires:./x.l")["edges"]} == {("src/utils.lua", True), ("lib/deep/only.lua", True)}
    assert len(q("requires:*")["edges"]) == 6
    found = P.impact_project(spark, root, "src/utils.lua")
    assert found["files"] == ["src/feature.lua", "src/main.lua", "x.lua"] and found["count"] == 3
    assert "(cycle)" in render.query_tree(q("requires:src/main.lua"))
    assert "| src/main.lua   | src/utils.lua | utils    | true     |" in render.query_table(q("requires:src/main.lua"))
    graph = P.viewer_graph(spark, root)
    assert [n["label"] for n in graph["nodes"] if n["type"] == "Module"] == ['"a" .. b']
    assert {e["kind"] for e in graph["edges"]} == {"Requires"}


TS = {
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}',
    "src/main.ts": 'import a from "./util";\nimport b from "./util.js";\nimport c from "./feature";\nimport d from "@/shared/helper";\nimport e from "pkg";\nimport type { T } from "./util";\n',
    "src/util.ts": "", "src/feature/index.tsx": "", "src/shared/helper.ts": "export class A { go() {} }\nexport class B extends A { go() {} }\n",
    "node_modules/pkg/index.js": "", "src/t.d.ts": "", "notes.txt": "",
}


def test_typescript_modules_and_scan(spark, tmp_path):
    root, counts = indexed(spark, tmp_path, TS)
    assert counts["fileCount"] == 4
    targets = [(e["target"], e["isResolved"]) for e in P.query_project(spark, root, "requires:src/main.ts")["edges"]]
    assert sorted(targets) == [("src/feature/index.tsx", True), ("src/main.ts", False), ("src/shared/helper.ts", True), ("src/util.ts", True), ("src/util.ts", True)]
    assert names(P.query_project(spark, root, "subclasses:A")) == ["B"]
    listed = [r["path"] for r in scan.scan(spark, root, config.required(root)).collect()]
    assert listed == ["src/feature/index.tsx", "src/main.ts", "src/shared/helper.ts", "src/util.ts"]


def test_odd_file_names(spark, tmp_path):
    root, _ = indexed(spark, tmp_path, {"a b/c+d%20é.lua": "function f() end\n"})
    assert names(P.query_project(spark, root, "kind:file")) == ["a b/c+d%20é.lua"]


CHAIN = {"src/api.lua": "function leaf() end\n\nfunction middle()\n  leaf()\nend\n", "src/app.lua": "function appBoot()\n  middle()\nend\n", "src/root.lua": "function root()\n  appBoot()\nend\n"}


def test_impact(spark, tmp_path):
    root, _ = indexed(spark, tmp_path, CHAIN)
    found = P.impact_project(spark, root, "leaf")
    assert names(found) == ["middle", "appBoot"] and found["files"] == ["src/api.lua", "src/app.lua"]
    assert len(P.impact_project(spark, root, "leaf", 1)["edges"]) == 1
    by_file = P.impact_project(spark, root, str(tmp_path / "src/api.lua"))
    assert len(by_file["seeds"]) == 2 and names(by_file) == ["appBoot", "root"]
    assert "leaf()  (src/api.lua:1)\n└── called by middle() [src/api.lua:4]" in render.impact_tree(found)
    assert "2 rows" in render.impact_table(found)
    assert P.impact_project(spark, root, "nobody")["count"] == 0


EXPLAIN = {
    "src/main.lua": 'local u = require("src.utils")\nlocal m = require("missing")\nfunction boot(flag, opts)\n  if flag then\n    helper()\n  end\n  local x = flag\n  self.state = x\n  return x\nend\n',
    "src/utils.lua": "function helper() end\n",
}


def test_explain(spark, tmp_path):
    root, _ = indexed(spark, tmp_path, EXPLAIN)
    by_file = P.explain_project(spark, root, "src/main.lua")
    assert [s["label"] for s in by_file["dataFlow"]] == ["boot"] and by_file["target"]["type"] == "file"
    assert by_file["branches"] == [{"functionName": "boot", "line": 4, "kind": "if", "condition": "flag"}]
    assert [(d["target"], d["isResolved"]) for d in by_file["dependencies"]] == [("src/main.lua", False), ("src/utils.lua", True)]
    assert len(by_file["externalGaps"]) == 3
    by_name = P.explain_project(spark, root, "boot")
    assert [(s["source"], s["label"]) for s in by_name["dataFlow"]] == [("input", "input flag, opts"), ("entrypoint", "boot"), ("branch", "flag"), ("call", "helper()"), ("assignment", "x = flag"), ("state", "self.state = x"), ("return", "x")]
    written = render.explain_text(by_name)
    assert "## Data Flow\n- input flag, opts\n- method boot\n- branch flag\n- call helper()\n- assign x = flag\n- state/write self.state = x\n- return x" in written
    assert "## Unresolved Runtime\n- missing" in written and "- reason: selected-symbol" in written
    assert "## Top Method Flow\n- boot" in render.explain_text(by_file)
    with pytest.raises(LookupError):
        P.explain_project(spark, root, "nobody")
    with pytest.raises(ValueError):
        P.explain_project(spark, root, " ")


def edges_of(spark, root):
    g = P.open_project(spark, root)
    return {n: sorted(map(str, map(tuple, df.drop("updated_at", "indexed_at", "modified_at").collect()))) for n, df in g.tables().items()}


def test_sync_equals_index(spark, tmp_path):
    root, _ = indexed(spark, tmp_path, {"a.lua": "function a()\n  b()\nend\n", "b.lua": "function b() end\n", "c.lua": "function c()\n  a()\nend\n"})
    assert P.project_status(spark, root)["pendingSyncChangeCount"] == 0
    assert P.sync_project(spark, root)["changedFileCount"] == 0
    (tmp_path / "b.lua").write_text("function b()\n  c()\nend\nfunction d() end\n")
    (tmp_path / "d.lua").write_text("function e()\n  d()\nend\n")
    (tmp_path / "c.lua").unlink()
    assert P.project_status(spark, root)["pendingSyncChangeCount"] == 3
    done = P.sync_project(spark, root)
    assert (done["changedFileCount"], done["removedFileCount"], done["symbolCount"]) == (2, 1, 4)
    assert P.project_status(spark, root)["pendingSyncChangeCount"] == 0
    after = edges_of(spark, root)
    P.index_project(spark, root, force=True)
    assert edges_of(spark, root) == after


def test_status_and_sample(spark, tmp_path):
    root = project(tmp_path, {"a.lua": 'P = class("P")\nT = {}\nfunction P:m() end\nfunction f() end\n'})
    with pytest.raises(FileNotFoundError):
        P.query_project(spark, root, "name:f")
    P.init_project(spark, root)
    assert P.project_status(spark, root)["pendingSyncChangeCount"] == 1 and P.viewer_graph(spark, root) == {"nodes": [], "edges": []}
    with pytest.raises(store.NotIndexed):
        P.query_project(spark, root, "name:f")
    P.index_project(spark, root)
    status = P.project_status(spark, root)
    assert (status["fileCount"], status["symbolCount"], status["edgeCount"], status["schemaCount"], status["parseErrorCount"]) == (1, 4, 4, 8, 0)
    assert status["symbolKindCounts"] == {"class": 1, "function": 1, "method": 1, "table": 1}
    assert [s["startLine"] for s in P.sample_project(spark, root, 2)["symbols"]] == [1, 2]
    with pytest.raises(ValueError):
        P.sample_project(spark, root, 0)


def test_snippets(tmp_path):
    root = project(tmp_path, {"a.lua": "1\r\n2\n3\n"})
    assert reports.snippet(root, "./a.lua", 2, 0)["code"] == "2"
    assert reports.snippet(root, "a.lua", 3, 5) == {"path": "a.lua", "startLine": 1, "endLine": 3, "code": "1\n2\n3"}
    for path, line, context in (("a.lua", 4, 0), ("a.lua", 0, 0), ("a.lua", 1, -1), ("../a.lua", 1, 0), ("/etc/hosts", 1, 0)):
        with pytest.raises(ValueError):
            reports.snippet(root, path, line, context)


def test_command_line(spark, flow, capsys):
    run = lambda *a: (cli.main(a, spark), capsys.readouterr())
    code, out = run("query", "callers:init", "--project-root", flow, "--format", "table")
    assert code == 0 and "| boot   | function | a.lua | 15   | 3   |" in out.out and out.out.rstrip().endswith("1 rows, target: init (a.lua:8)")
    code, out = run("query", "callees:boot", "--depth", "2", "--project-root", flow, "--format", "tree")
    assert "boot()  (a.lua:14)\n└── calls init() [a.lua:15]\n    ├── calls foo() [a.lua:9]" in out.out
    assert json.loads(run("status", flow)[1].out)["symbolCount"] == 6
    assert run("query", "nonsense", "--project-root", flow)[0] == 1
    code, out = run("sync", flow)
    assert "[sync] nothing changed" in out.err and json.loads(out.out)["changedFileCount"] == 0
    assert run("sync", flow, "--quiet")[1].out == ""
    for bad in (["query", "name:x", "--depth", "0"], ["serve", "--port", "70000"], ["sample", "--format", "xml"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


def test_http(spark, flow):
    server = serve.start(spark, flow)
    get = lambda path: urllib.request.urlopen(server.url + path)
    try:
        assert json.load(get("/api/status"))["fileCount"] == 1
        assert {n["type"] for n in json.load(get("/api/graph"))["nodes"]} == {"File", "Symbol"}
        assert json.load(get("/api/code?path=a.lua&line=8&context=1"))["startLine"] == 7
        assert get("/").headers["Content-Type"].startswith("text/html") and get("/app.js").status == 200
        for path, status in (("/api/code?path=../x&line=1", 400), ("/api/code?line=1", 400), ("/api/code?path=a.lua", 400), ("/api/code?path=a.lua&line=x", 400), ("/none", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == status
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(server.url + "/api/status", method="POST", data=b""))
        assert e.value.code == 405
    finally:
        server.close()


def test_render_empty():
    assert render.table(["A", "Bc"], []) == "+---+----+\n| A | Bc |\n+---+----+\n+---+----+"
    empty = {"expression": "callers:x", "nodes": [], "edges": []}
    assert render.query_tree(empty) == "x()" and render.query_table(empty).endswith("0 rows, target: x")
    assert render.id_name("odd") == "odd" and render.id_location("a#f#n#3:1") == "a:3" and render.id_location("odd") == "odd"
    report = {"input": "f", "target": {"type": "file", "name": "f", "filePath": "f"}, "entrypoints": [], "flow": [], "branches": [], "dependencies": [], "dataFlow": []}
    assert render.explain_text(report).count("None") == 5


def test_stream(spark, tmp_path):
    from codeloom.streaming import merge_batch, sync_stream

    folder, source = str(tmp_path / "db"), tmp_path / "in"
    source.mkdir()
    schema = "path string, text string, modified_at timestamp"
    spark.createDataFrame([("a.lua", "function a()\n  b()\nend", None), ("b.lua", "function b() end", None)], schema).write.json(str(source / "1"))
    stream = lambda: sync_stream(spark.readStream.schema(schema).json(str(source / "*")), folder, str(tmp_path / "cp")).awaitTermination()
    stream()
    assert store.read(spark, folder).calls.count() == 1
    spark.createDataFrame([("b.lua", None, None)], schema).write.json(str(source / "2"))
    stream()
    g = store.read(spark, folder)
    assert g.calls.count() == 0 and [r["path"] for r in g.files.collect()] == ["a.lua"]
    merge_batch(spark.createDataFrame([("b.lua", None, None)], schema), folder)
    assert store.read(spark, folder).files.count() == 1


def test_bad_bytes_and_parser_errors_do_not_end_a_run(spark, tmp_path):
    from codeloom.sources.parsers import registry

    def broken(path, source):
        raise KeyError(source.strip())

    (tmp_path / "node_modules/deep").mkdir(parents=True)
    (tmp_path / "node_modules/deep/x.js").write_text("export function hidden() {}")
    (tmp_path / "latin.lua").write_bytes(b"-- caf\xe9\nfunction ok() end\n")
    (tmp_path / "one.luau").write_text("boom")
    (tmp_path / "empty.lua").write_text("")
    P.init_project(spark, str(tmp_path))
    registry.register(".luau", "lua", broken)
    try:
        settings = config.required(str(tmp_path))
        object.__setattr__(settings, "include", [*settings.include, "**/*.luau"])
        files = {r["path"]: r for r in registry.parse_files(scan.read_texts(spark, str(tmp_path), settings)).collect()}
    finally:
        del registry.ADAPTERS[".luau"]
    assert set(files) == {"latin.lua", "one.luau", "empty.lua"}
    assert [s["name"] for s in files["latin.lua"]["symbols"]] == ["ok"] and files["latin.lua"]["error"] == ""
    assert files["one.luau"]["error"] == "KeyError: 'boom'" and files["empty.lua"]["symbols"] == []


def test_stream_keeps_aliases_and_open_frames(spark, tmp_path):
    rows = [("src/b.ts", 'import { a } from "@/lib/a";'), ("src/lib/a.ts", "export const a = 1;"), ("other.ts", "export function f() {}")]
    frame = lambda some: spark.createDataFrame([(p, t, None) for p, t in some], "path string, text string, modified_at timestamp")
    folder, aliases = str(tmp_path / "db"), [("@/*", ["src/*"])]
    streaming.merge_batch(frame(rows[:2]), folder, ".", aliases)
    first = store.read(spark, folder).requires
    streaming.merge_batch(frame(rows[2:]), folder, ".", aliases)
    for edges in (store.read(spark, folder).requires, first):  # the older snapshot can still be read
        assert [(r["src_path"], r["dst_path"], r["is_resolved"]) for r in edges.collect()] == [("src/b.ts", "src/lib/a.ts", True)]
    for _ in range(5):
        streaming.merge_batch(frame(rows[2:]), folder, ".", aliases)
    assert sum(p.name.startswith("snapshot-") for p in (tmp_path / "db").iterdir()) == 1 + store.KEEP
