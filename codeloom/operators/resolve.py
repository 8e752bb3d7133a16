"""Name resolution: parsed references joined to symbols and files as edges.

Inputs are frames, not files: symbols carries `language`, and names only ever resolve
within one language. Nothing here is ordered by chance: every choice has a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths

#: Spans of lines, as powers of two, that scopes are sorted into.
LEVELS = 24
#: Extensions tried for a JavaScript module, in their order.
JS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")


def with_language(frame: DataFrame, path: str = "file_path") -> DataFrame:
    return frame.withColumn("language", F.when(F.col(path).endswith(".lua"), "lua").otherwise("js"))


def _around(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every site(file_path, line, ...) with each function or method of its file around it.

    Instead of all pairs of a file, scopes are dealt into blocks of lines as long as they
    are (two at most) and sites look into one block of each size that their file has, so a
    long file stays linear.
    """
    span = F.col("end_line") - F.col("start_line")
    # The block size is the least power of two above the span.
    level = F.when(span <= 0, F.lit(0)).otherwise(F.least(F.ceil(F.log2(span + 1)).cast("int"), F.lit(LEVELS)))
    scopes = symbols.where(F.col("kind").isin("function", "method") & (span >= 0)).select(
        F.col("file_path").alias("file_path"), F.col("id").alias("scope_id"), F.col("qualified_name").alias("scope_name"), "start_line", "end_line", "start_column", level.alias("level")
    )
    blocks = F.expr("sequence(shiftright(bigint(start_line), level), shiftright(bigint(end_line), level))")
    dealt = scopes.withColumn("block", F.explode(blocks))
    sizes = scopes.select("file_path", "level").distinct()  # a handful for each file
    looks = sites.join(sizes, "file_path").withColumn("block", F.expr("shiftright(bigint(line), level)"))
    return looks.join(dealt, ["file_path", "level", "block"]).where((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line")))


def enclosing_scopes(sites: DataFrame, symbols: DataFrame, keys: Sequence[str] = ("file_path", "site")) -> DataFrame:
    """The narrowest function or method around each site(file_path, line, *keys).

    Of scopes of one file with start_line <= line <= end_line: the smallest span, then the
    latest start, then the first symbol. Sites without one are dropped.
    """
    rank = F.struct((F.col("end_line") - F.col("start_line")).alias("a"), (-F.col("start_line")).alias("b"), F.col("start_column").alias("c"), F.col("scope_id").alias("d"))
    best = _around(sites, symbols).groupBy(*keys).agg(F.min_by(F.struct("scope_id", "scope_name"), rank).alias("best"))
    return best.select(*keys, F.col("best.scope_id").alias("src_id"), F.col("best.scope_name").alias("src_name"))


def latest_scopes(sites: DataFrame, symbols: DataFrame, keys: Sequence[str] = ("file_path", "site")) -> DataFrame:
    """The other rule: the scope around each site that starts last, of those the first symbol."""
    rank = F.struct((-F.col("start_line")).alias("a"), F.col("start_column").alias("b"), F.col("scope_id").alias("c"))
    best = _around(sites, symbols).groupBy(*keys).agg(F.min_by(F.struct("scope_id", "scope_name"), rank).alias("best"))
    return best.select(*keys, F.col("best.scope_id").alias("owner_id"), F.col("best.scope_name").alias("owner_name"))


def unique_names(symbols: DataFrame) -> DataFrame:
    """(language, qualified_name, id) of names that one symbol of a language has."""
    return symbols.groupBy("language", "qualified_name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")


def single_local(symbols: DataFrame, kind: str | None = None) -> DataFrame:
    """(file_path, qualified_name, id) of names that one symbol (of a kind) of a file has."""
    some = symbols if kind is None else symbols.where(F.col("kind") == kind)
    return some.groupBy("file_path", "qualified_name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")


def _looked_up(frame: DataFrame, index: DataFrame, on: dict[str, Column], out: str) -> DataFrame:
    """Left join to an index by expressions; the id found is out."""
    named = index.select(*[F.col(k).alias(f"__{k}") for k in on], F.col("id").alias(out))
    match = F.lit(True)
    for k, e in on.items():
        match = match & (e == F.col(f"__{k}"))
    return frame.join(named, match, "left").drop(*[f"__{k}" for k in on])


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls(file_path, site, callee, line, column) -> (src_id, dst_id, line, column, is_resolved).

    Lua tries `self:m` as a method of the caller's class (in the file, then anywhere), then
    `X.new` as class X (in the file, then anywhere), then the name itself; JavaScript only
    the name. Names must be unique where they are looked up. What doesn't resolve, or
    stands in no function, gives no row.
    """
    symbols, calls = with_language(symbols), with_language(calls)
    scoped = calls.join(enclosing_scopes(calls.select("file_path", "site", "line"), symbols), ["file_path", "site"])
    lua = F.col("language") == "lua"
    method = F.regexp_extract("callee", r"^self:([A-Za-z_][A-Za-z0-9_]*)$", 1)
    owner = F.regexp_extract("src_name", r"(?s)^(.+):[^:]*$", 1)
    made = F.regexp_extract("callee", r"^([A-Za-z_][A-Za-z0-9_]*)\.new$", 1)
    keyed = scoped.withColumn("method_key", F.when(lua & (method != "") & (owner != ""), F.concat(owner, F.lit(":"), method))).withColumn("class_key", F.when(lua & (made != ""), made))
    unique = unique_names(symbols)
    classes = symbols.where("kind = 'class'").groupBy("language", "qualified_name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")
    file_path, language = F.col("file_path"), F.col("language")
    found = _looked_up(keyed, single_local(symbols, "method"), {"file_path": file_path, "qualified_name": F.col("method_key")}, "t1")
    found = _looked_up(found, unique, {"language": language, "qualified_name": F.col("method_key")}, "t2")
    found = _looked_up(found, single_local(symbols, "class"), {"file_path": file_path, "qualified_name": F.col("class_key")}, "t3")
    found = _looked_up(found, classes, {"language": language, "qualified_name": F.col("class_key")}, "t4")
    found = _looked_up(found, unique, {"language": language, "qualified_name": F.col("callee")}, "t5")
    target = F.coalesce("t1", "t2", "t3", "t4", "t5")
    return found.where(target.isNotNull()).select("src_id", target.alias("dst_id"), "line", "column", F.lit(True).alias("is_resolved"))


def resolve_extends(extends: DataFrame, symbols: DataFrame) -> DataFrame:
    """extends(file_path, site, child, parent, line) -> (child_id, parent_id).

    The child is the file's symbol of that name that starts on that line; the parent the
    file's only symbol of its name, else the language's. Missing ends and self-loops go.
    """
    symbols, extends = with_language(symbols), with_language(extends)
    heads = symbols.groupBy("file_path", "qualified_name", "start_line").agg(F.min_by("id", F.struct("start_column", "id")).alias("id"))
    found = _looked_up(extends, heads, {"file_path": F.col("file_path"), "qualified_name": F.col("child"), "start_line": F.col("line")}, "child_id")
    found = _looked_up(found, single_local(symbols), {"file_path": F.col("file_path"), "qualified_name": F.col("parent")}, "p1")
    found = _looked_up(found, unique_names(symbols), {"language": F.col("language"), "qualified_name": F.col("parent")}, "p2")
    parent = F.coalesce("p1", "p2")
    return found.where(F.col("child_id").isNotNull() & parent.isNotNull() & (F.col("child_id") != parent)).select("child_id", parent.alias("parent_id"))


def first_candidate(frame: DataFrame, files: DataFrame, candidates: Column, keys: Sequence[str], out: str = "target") -> DataFrame:
    """The first of an array of candidate paths that is a file; a column out, or null.

    frame's rows are told apart by keys, files is (path).
    """
    tried = frame.select(*keys, F.posexplode(candidates).alias("place", "path")).join(files.select("path"), "path")
    best = tried.groupBy(*keys).agg(F.min_by("path", "place").alias(out))
    return frame.join(best, list(keys), "left")


def unique_suffix(frame: DataFrame, files: DataFrame, suffixes: Column, keys: Sequence[str], out: str = "suffix_target") -> DataFrame:
    """The only file that ends with one of an array of suffixes that begin with a slash.

    Every file offers all its suffixes, so this is an equality join, not a scan of pairs.
    """
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, n, F.size(parts)), "/")))
    offers = files.where(F.col("path").contains("/")).select("path", F.explode(tails).alias("tail"))
    asked = frame.select(*keys, F.explode(suffixes).alias("tail"))
    found = asked.join(offers, "tail").groupBy(*keys).agg(F.count_distinct("path").alias("n"), F.min("path").alias(out)).where("n = 1").drop("n")
    return frame.join(found, list(keys), "left")


def lua_candidates(source: Column, module: Column) -> tuple[Column, Column]:
    """Paths tried for a Lua module, in their order, and the suffixes tried after them."""
    m = F.replace(F.regexp_replace(module, r"\.lua$", ""), F.lit("."), F.lit("/"))
    alias_free = F.regexp_extract(m, r"(?s)^[^/]*/(.*)$", 1)
    folder = paths.dirname_column(source)
    both = lambda p: F.array(F.concat(p, F.lit(".lua")), F.concat(p, F.lit("/init.lua")))
    none = F.array().cast("array<string>")
    tried = F.concat(both(m), F.when(alias_free != "", both(alias_free)).otherwise(none), F.when(folder != "", both(F.concat(folder, F.lit("/"), m))).otherwise(none))
    return tried, both(F.concat(F.lit("/"), m))


def js_candidates(source: Column, module: Column, base_url: str = ".", aliases: Sequence[tuple[str, Sequence[str]]] = ()) -> Column:
    """Paths tried for a JavaScript module: relative ones, else those that aliases map to."""
    folder = paths.dirname_column(source)
    relative = module.startswith("./") | module.startswith("../")
    here = paths.fold_column(F.concat(folder, F.lit("/"), F.replace(module, F.lit("\\"), F.lit("/"))))
    out = F.when(relative, _js_files(here)).otherwise(F.array().cast("array<string>"))
    for pattern, targets in aliases:
        head, star, tail = pattern.partition("*")
        if star:
            fits = module.startswith(head) & module.endswith(tail) & (F.length(module) >= len(head) + len(tail))
            inner = F.substr(module, F.lit(len(head) + 1), F.greatest(F.length(module) - len(head) - len(tail), F.lit(0)))
        else:
            fits, inner = module == pattern, F.lit("")
        for target in targets:
            mapped = F.replace(F.lit(target), F.lit("*"), inner)
            place = paths.fold_column(F.concat(F.lit(f"{base_url}/"), mapped))
            out = F.concat(out, F.when(~relative & fits, _js_files(place)).otherwise(F.array().cast("array<string>")))
    return out


def _js_files(path: Column) -> Column:
    """A module path with the extensions and index files that may be meant."""
    indexes = [F.concat(path, F.lit(f"/index{e}")) for e in JS_EXTENSIONS]
    known = path.rlike(r"[^/]\.(ts|tsx|js|jsx)$")
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    swapped = F.when(path.endswith(".js"), F.array(F.concat(bare, F.lit(".ts")), F.concat(bare, F.lit(".tsx")))).when(path.endswith(".jsx"), F.array(F.concat(bare, F.lit(".tsx")))).otherwise(F.array().cast("array<string>"))
    return F.when(known, F.concat(F.array(path), swapped, F.array(*indexes))).otherwise(F.array(*[F.concat(path, F.lit(e)) for e in JS_EXTENSIONS], *indexes))


def resolve_requires(requires: DataFrame, files: DataFrame, base_url: str = ".", aliases: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """requires(file_path, site, module_name, is_static), files(path) ->
    (src_path, dst_path, module_name, is_resolved).

    Within one language. A module that isn't found, or isn't named by a string, is an
    unresolved edge from the file to itself.
    """
    requires, files = with_language(requires), with_language(files, "path")
    keys = ("file_path", "site")
    static = requires.where("is_static")
    lua = static.where("language = 'lua'")
    tried, suffixes = lua_candidates(F.col("file_path"), F.col("module_name"))
    lua_files = files.where("language = 'lua'")
    lua_found = unique_suffix(first_candidate(lua, lua_files, tried, keys), lua_files, suffixes, keys).withColumn("target", F.coalesce("target", "suffix_target")).select(*keys, "target")
    js = static.where("language = 'js'")
    js_found = first_candidate(js, files.where("language = 'js'"), js_candidates(F.col("file_path"), F.col("module_name"), base_url, aliases), keys).select(*keys, "target")
    found = requires.join(lua_found.unionByName(js_found), list(keys), "left")
    return found.select(F.col("file_path").alias("src_path"), F.coalesce("target", "file_path").alias("dst_path"), "module_name", F.col("target").isNotNull().alias("is_resolved"))
