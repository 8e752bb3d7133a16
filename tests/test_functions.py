import json
import os

import pytest
from codeloom.functions import paths, text
from codeloom.sources import config
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@pytest.mark.parametrize(("given_path", "expected"), [("a/b.lua", "a/b.lua"), ("./a//b/./c.ts", "a/b/c.ts"), ("a\\b.lua", "a/b.lua")])
def test_normalize(given_path, expected):
    assert paths.normalize(given_path) == expected


@pytest.mark.parametrize("bad", ["", "/a", "a/../b", "C:\\a", ".", "\\a", ".."])
def test_normalize_refuses(spark, bad):
    with pytest.raises(ValueError):
        paths.normalize(bad)
    with pytest.raises(Exception):
        spark.createDataFrame([(bad,)], "p string").select(paths.normalize_column(F.col("p"))).collect()


def test_links_out_of_the_project(tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "out"
    inside.mkdir(), outside.mkdir()
    (outside / "x.lua").write_text("x")
    os.symlink(outside / "x.lua", inside / "x.lua")
    with pytest.raises(ValueError):
        paths.resolve_safe(str(inside), "x.lua")


CASES = [
    (["node_modules/"], "a/node_modules/b.js", True),
    (["a/b/"], "a/b/c.js", True),
    (["a/b/"], "x/a/b/c.js", False),
    (["a/**"], "a", True),
    (["a*/**"], "ab/c", False),
    (["**/*.lua"], "x.lua", True),
    (["**/*.lua"], "a/b/x.lua", True),
    (["*.lua"], "a/x.lua", False),
    (["src/**/t/*.ts"], "src/t/a.ts", True),
    (["src/**/t/*.ts"], "src/a/b/t/a.ts", True),
    (["a?.js"], "ab.js", False),
    (["/a"], "a", False),
    (["**"], "any/thing", True),
]


@pytest.mark.parametrize(("patterns", "path", "expected"), CASES)
def test_globs(patterns, path, expected):
    assert paths.glob_matches(patterns, path) is expected


def _segments(pattern, path):
    """The rule itself, for patterns of segments."""
    if not pattern:
        return not path
    if pattern[0] == "**":
        return len(pattern) == 1 or any(_segments(pattern[1:], path[i:]) for i in range(len(path) + 1))
    head = pattern[0].split("*")
    if not path:
        return False
    import re

    return re.fullmatch("[^/]*".join(map(re.escape, head)), path[0]) is not None and _segments(pattern[1:], path[1:])


@given(st.lists(st.sampled_from(["a", "b", "*", "**", "a*", "*b"]), min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", "ab"]), min_size=1, max_size=4))
@settings(max_examples=300)
def test_globs_equal_the_rule(pattern, path):
    if pattern[-1] == "**" and len(pattern) > 1:
        return  # a literal base, another rule
    assert paths.glob_matches(["/".join(pattern)], "/".join(path)) == _segments(pattern, path)


def test_glob_columns(spark):
    df = spark.createDataFrame([(i, p) for i, (_, p, _) in enumerate(CASES)], "i int, path string")
    for i, (patterns, _, expected) in enumerate(CASES):
        assert df.where(F.col("i") == i).select(paths.glob_column(F.col("path"), patterns)).first()[0] is expected
    below = spark.createDataFrame([("dist/x/y.lua",)], "path string")
    assert below.select(paths.excluded_column(F.col("path"), ["*ist"])).first()[0]


@pytest.mark.parametrize(("given_path", "expected"), [("a/b/../c", "a/c"), ("a/./b//c", "a/b/c"), ("a/../../b", "../b"), ("/x/../y", "y"), ("..", "..")])
def test_fold(spark, given_path, expected):
    assert spark.createDataFrame([(given_path,)], "p string").select(paths.fold_column(F.col("p"))).first()[0] == expected


def test_fragments(spark, tmp_path):
    df = spark.createDataFrame([("Src/Main.lua",), ("lib/x.lua",)], "path string")
    hits = lambda f: [r[0] for r in df.where(paths.fragment_column(F.col("path"), f)).collect()]
    assert hits(paths.fragment_of("./src/ma")) == ["Src/Main.lua"]
    assert hits(paths.fragment_of("*", star=True)) == ["Src/Main.lua", "lib/x.lua"]
    assert hits(paths.fragment_of("/home/me/src/main.lua")) == ["Src/Main.lua"]
    assert paths.fragment_of(str(tmp_path / "a" / "b.lua"), str(tmp_path)) == "a/b.lua"
    with pytest.raises(ValueError):
        paths.fragment_of("../x", str(tmp_path))


LINES = [
    ("  if a > b then", ("if", "a > b")),
    ("elseif x then y", ("elseif", "x")),
    ("} else if (z(1)) {", ("elseif", "z(1)")),
    ("else if (q) {", ("elseif", "q")),
    ("if (q) {", ("if", "q")),
    ("switch (kind) {", ("switch", "kind")),
    ("case 'a':", ("case", "'a'")),
    ("return ok ? 1 : 2;", ("conditional", "ok")),
    ("name?: string", ("conditional", "name")),
    ("? x : y", None),
    ("plain()", None),
]


def test_branches(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "i int, code string")
    rows = df.select("i", text.branch(text.trim(F.col("code"))).alias("b")).orderBy("i").collect()
    assert [r["b"] and tuple(r["b"]) for r in rows] == [e for _, e in LINES]


def test_line_steps(spark):
    from codeloom.plans.explain import line_steps

    cases = [("local a = b;", ("assignment", "a = b")), ("self.x = 1,", ("state", "self.x = 1")), ("byId[1] = 2", ("assignment", "byId[1] = 2")), ("usersById = {}", ("state", "usersById = {}")), ("a.b(c = 1)", ("call", "a.b(c = 1)")), ("go(1);", ("call", "go(1)")), ("return x;", ("return", "x")), ("return", ("return", "result")), ("if a = b then", (None, None)), ("f = () => 1", (None, None))]
    df = spark.createDataFrame([("f", i, c) for i, (c, _) in enumerate(cases)], "file_path string, line long, code string")
    assert [(r["source"], r["label"]) for r in line_steps(df).orderBy("line").collect()] == [e for _, e in cases]


def test_config(tmp_path):
    root = str(tmp_path)
    (tmp_path / ".gitignore").write_text("# c\n\nlogs/\ndist/\n")
    made = config.write(root)
    assert made.exclude[-1] == "logs/" and made.exclude.count("dist/") == 1
    at = tmp_path / config.CONFIG
    at.write_text(json.dumps({"include": ["x/**"], "exclude": ["y/"], "databaseDir": "db"}))
    kept = config.write(root)
    assert kept.include == ("x/**",) and kept.exclude == (*config.EXCLUDE, "y/") and kept.databaseDir == "db"
    for bad in ([], {"include": []}, {"include": [""], "exclude": [], "databaseDir": "d"}, {"include": ["a"], "exclude": [], "databaseDir": " "}):
        with pytest.raises(ValueError):
            config.validate(bad)
    (tmp_path / "tsconfig.json").write_text('{ // c\n "compilerOptions": {/* x */ "baseUrl": "src", "paths": {"@/*": ["*"]}}}')
    assert config.compiler_paths(root) == ("src", [("@/*", ["*"])])
