import pytest
from codeloom.sources.parsers import ecma, lua
from codeloom.sources.parsers.registry import adapter, parse_files, parse_source, register
from hypothesis import given, settings
from hypothesis import strategies as st


def brief(p):
    return [(s["kind"], s["qualified_name"], s["start_line"], s["end_line"]) for s in p.symbols]


def test_lua_symbols_ranges_and_signatures():
    p = lua.parse("src/a.lua", 'Player = class("Player")\nConfig = {\n  x = 1,\n}\nlocal Hidden = {}\nlocal function helper(a)\n  return a\nend\nfunction Player.make() end\nfunction Player:run()\n  if self.x then\n    local function inner() end\n  end\nend\n')
    assert brief(p) == [("class", "Player", 1, 1), ("table", "Config", 2, 4), ("function", "helper", 6, 8), ("method", "Player.make", 9, 9), ("method", "Player:run", 10, 14), ("function", "inner", 12, 12)]
    by = {s["qualified_name"]: s for s in p.symbols}
    assert by["helper"]["is_local"] and not by["helper"]["is_exported"]
    assert by["Player:run"]["signature"] == "function Player:run()"
    assert by["Player:run"]["id"] == "src/a.lua#method#Player:run#10:1"
    assert by["Player"]["end_column"] == 24  # counted from 0, behind the last character
    assert by["inner"]["start_column"] == 5


def test_lua_calls_extends_and_requires():
    p = lua.parse("a.lua", 'local u = require("utils")\nlocal b = require "x.y"\nlocal c = require[==[long]==]\nlocal d = require("a" ..\n  name)\n-- require("no")\nlocal s = "require(\'no\')"\nBase = {}\nChild = setmetatable({}, { __index = Base })\nBase.__index = setmetatable(Base, {__index = Base})\nOther = class("Other", Child)\nDyn = class("Dyn", make())\nf()()\nobj:go(g())\n')
    assert [(r[1], r[2], r[3]) for r in p.requires] == [("utils", True, 1), ("x.y", True, 2), ("long", True, 3), ('"a" .. name', False, 4)]
    assert [(e[1], e[2]) for e in p.extends] == [("Child", "Base"), ("Base.__index", "Base"), ("Other", "Child")]
    assert [c[1] for c in p.calls if c[2] > 12] == ["f", "obj:go", "g"]


def test_lua_long_input():
    p = lua.parse("a.lua", "local x = 1\n" * 3000 + 'local m = require("m")\n')
    assert p.requires == [("a.lua", "m", True, 3001, 11)]


TSX = """import util from "./util";
import type { User } from "./types";
export { helper } from "./helper";
const dep = require("./dep");
const lazy = import("./lazy"), dyn = require(name);
class Base { base() {} constructor() { super(); } get x() { return 1; } }
export class Child extends lib.Base<T> implements I {
  run<K>(k: K): Promise<void> { helper(); this.go(k); return { inner() { deep(); } }; }
}
export function helper(cb: (x: number) => void) { return dep; }
const arrow = async () => new Child();
const plain = 3, view = () => <div onClick={() => click()}>Don't (call) {render(`a ${tpl(1)}`)}</div>;
interface Foo { bar(x: string): void }
"""


def test_tsx():
    p = ecma.parse("src/m.tsx", TSX)
    assert [(s["kind"], s["qualified_name"], s["is_exported"]) for s in p.symbols] == [("class", "Base", False), ("method", "Base.base", False), ("class", "Child", True), ("method", "Child.run", True), ("method", "Child.inner", True), ("function", "helper", True), ("function", "arrow", False), ("function", "view", False)]
    assert [(e[1], e[2], e[3]) for e in p.extends] == [("Child", "lib.Base", 7)]
    assert [(r[1], r[2]) for r in p.requires] == [("./util", True), ("./helper", True), ("./dep", True), ("./lazy", True), ("name", False)]
    assert [c[1] for c in p.calls] == ["require", "import", "require", "super", "helper", "go", "deep", "click", "render", "tpl", "Child"]
    by = {s["qualified_name"]: s for s in p.symbols}
    assert (by["Child"]["start_column"], by["Child"]["end_line"], by["Child"]["end_column"]) == (1, 9, 2)
    assert by["helper"]["signature"].startswith("export function helper(")


def test_regex_division_and_news():
    p = ecma.parse("a.js", "const q = a / b(1) / c;\nconst r = /x(y)/.test(s);\nnew Foo;\nnew a.B(1).run();\nif (x) { y() }\nfoo\n  .bar();\n")
    assert [c[1] for c in p.calls] == ["b", "/x(y)/.test", "new a.B(1).run", "y", "foo .bar", "Foo", "a.B"]


@pytest.mark.parametrize("parse", [lua.parse, ecma.parse])
@given(source=st.text("abc(){}[]<>=\"'`$/\\\n .:;,-", max_size=60) | st.lists(st.sampled_from("function end local if then class { } ( ) => ` ${ < > / x = return import from 'a' [[ ]] -- /* */".split()), max_size=25).map(" ".join))
@settings(max_examples=150, deadline=None)
def test_broken_code_never_raises(parse, source):
    p = parse("a.tsx", source)
    for s in p.symbols:
        assert s["start_line"] <= s["end_line"]


def test_registry(spark):
    assert adapter("x.lua")[0] == "lua" and adapter("x.tsx")[0] == "js"
    with pytest.raises(ValueError):
        adapter("x.py")
    assert parse_source("a.lua", "x = " + "(" * 5000)[2] in ("", "nested too deeply")
    rows = [("a.lua", "function f() g() end", "h", 1, None), ("b.ts", None, "h", 0, None)]
    files = spark.createDataFrame(rows, "path string, text string, content_hash string, size long, modified_at timestamp")
    found = {r["path"]: r for r in parse_files(files).collect()}
    assert found["a.lua"]["symbols"][0]["qualified_name"] == "f" and found["b.ts"]["symbols"] == []
    assert found["a.lua"]["calls"][0]["callee"] == "g"
    old = adapter(".jsx")
    register(".jsx", *old)
