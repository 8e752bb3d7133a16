"""The reference operators over the bound tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import bindings as B
from codeloom.functions import paths, text
from codeloom.model import Graph
from codeloom.operators import resolve, traverse
from codeloom.plans import explain, impact, project, query, reports
from codeloom.session import checkpointed
from codeloom.sources import store
from codeloom.sources.parsers.registry import parse_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The bound tables in SQL.
FILES = "files AS (SELECT lower(r_name) || '/' || lower(n_name) || '/' || lower(s_name) AS path, s_suppkey AS suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SYMBOLS = "symbols AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey, p_type AS kind, p_name AS name, p_brand || '.' || p_name AS qualified_name, 'file' || (p_partkey % (SELECT count(*) FROM supplier)) || '.lua' AS file_path, p_partkey // (SELECT count(*) FROM supplier) + 1 AS start_line, p_partkey // (SELECT count(*) FROM supplier) + 1 + p_size AS end_line, p_type || ' ' || p_name AS signature FROM part)"
SCOPES = "scopes AS (SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN 'method' ELSE 'function' END AS kind) FROM symbols)"
CALLS = "calls AS (SELECT DISTINCT CAST(a.l_partkey AS VARCHAR) AS src_id, CAST(b.l_partkey AS VARCHAR) AS dst_id, a.l_partkey % 97 AS line, b.l_partkey % 13 AS \"column\", true AS is_resolved FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"
EXTENDS = "extends AS (SELECT CAST(p_partkey AS VARCHAR) AS child_id, CAST(p_partkey // 2 AS VARCHAR) AS parent_id FROM part WHERE p_partkey > 0)"
REQUIRES = "requires AS (SELECT DISTINCT f.path AS src_path, CASE WHEN flag = 'R' THEN f.path ELSE g.path END AS dst_path, 'm' || b AS module_name, flag <> 'R' AS is_resolved FROM (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b, x.l_returnflag AS flag FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1) p JOIN files f ON f.suppkey = a JOIN files g ON g.suppkey = b)"
SITES = "sites AS (SELECT DISTINCT 'file' || (l_suppkey % (SELECT count(*) FROM supplier)) || '.lua' AS file_path, l_linenumber + CAST(trunc(l_quantity) AS BIGINT) AS line FROM lineitem)"
LINES = "lines AS (SELECT CAST(doc_id AS VARCHAR) AS file_path, generate_subscripts(parts, 1) AS line, unnest(parts) AS code FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM documents))"


def offered(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _with(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


def _levels(seeds: str, edges: str, near: str, far: str, depth: int, allowed: str = "") -> str:
    """CTEs of an unrolled breadth-first search; the edges met are in `met`."""
    out = [f"f0 AS ({seeds})", "v0 AS (SELECT id FROM f0)"]
    for n in range(1, depth + 1):
        out.append(f"e{n} AS (SELECT DISTINCT e.* FROM {edges} e JOIN f{n - 1} f ON e.{near} = f.id{f' WHERE e.{far} IN ({allowed})' if allowed else ''})")
        out.append(f"f{n} AS (SELECT DISTINCT {far} AS id FROM e{n} WHERE {far} NOT IN (SELECT id FROM v{n - 1}))")
        out.append(f"v{n} AS (SELECT id FROM v{n - 1} UNION ALL SELECT id FROM f{n})")
    return ", ".join([*out, "met AS (" + " UNION ".join(f"SELECT * FROM e{n}" for n in range(1, depth + 1)) + ")"])


_NODE = "id, kind, name, qualified_name, file_path, start_line"
_SEED_NAME = "red plate"


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.symbols(spark, sf_dir, B.table(spark, sf_dir, "supplier").count())


def _node_columns(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", "name", "qualified_name", "file_path", "start_line")


# Filters and names.


@offered(_with(SYMBOLS, select=f"SELECT {_NODE} FROM symbols WHERE name = '{_SEED_NAME}' OR qualified_name = '{_SEED_NAME}'"))
def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_columns(query.symbol_nodes(query.filtered_symbols(_symbols(spark, sf_dir), _SEED_NAME, None)))


@offered(_with(SYMBOLS, select=f"SELECT {_NODE} FROM symbols WHERE (name = '{_SEED_NAME}' OR qualified_name = '{_SEED_NAME}') AND kind = 'PROMO'"))
def kind_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_columns(query.symbol_nodes(query.filtered_symbols(_symbols(spark, sf_dir), _SEED_NAME, "PROMO")))


@offered(_with(FILES, select="SELECT 'File' AS type, path AS id, 'file' AS kind, regexp_extract(path, '[^/]*$') AS name FROM files"))
def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.file_nodes(query.filtered_files(B.files(spark, sf_dir), None, "file")).select("type", "id", "kind", "name")


@offered(_with(SYMBOLS, SCOPES, select=f"SELECT {_NODE} FROM scopes WHERE kind = 'method' AND (starts_with(qualified_name, 'Brand#17:') OR starts_with(qualified_name, 'Brand#17.'))"))
def methods_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_columns(query.symbol_nodes(query.methods_of(B.scopes(spark, sf_dir), "Brand#17")))


@offered(_with(FILES, select="SELECT path FROM files WHERE contains(path, 'asia/nation_1') OR ends_with('asia/nation_1', '/' || path)"))
def path_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.files(spark, sf_dir).where(paths.fragment_column(F.col("path"), paths.fragment_of("./ASIA\\nation_1"))).select("path")


@offered(_with(FILES, select="SELECT path FROM files WHERE (path = 'asia' OR starts_with(path, 'asia/') OR regexp_full_match(path, '[^/]*/nation_1[^/]*/[^/]*') OR regexp_full_match(path, '([^/]+/)*supplier#00000000[^/]*')) AND NOT list_contains(string_split(path, '/'), 'nation_2')"))
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    wanted = paths.glob_column(path, ["asia/**", "*/nation_1*/*", "**/supplier#00000000*"])
    return B.files(spark, sf_dir).where(wanted & ~paths.excluded_column(path, ["nation_2/"])).select("path")


@offered(_with(FILES, select="SELECT path, path AS normalized, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) || '/x' AS folded FROM files"))
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    odd = F.concat(F.lit("./"), F.replace(path, F.lit("/"), F.lit("\\\\")))
    return B.files(spark, sf_dir).select("path", paths.normalize_column(odd).alias("normalized"), paths.dirname_column(path).alias("folder"), paths.fold_column(F.concat(paths.dirname_column(path), F.lit("/./../x"))).alias("folded"))


@offered(_with(SYMBOLS, select="SELECT 'lua' AS language, qualified_name, min(id) AS id FROM symbols GROUP BY qualified_name HAVING count(*) = 1"))
def unique_name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unique_names(resolve.with_language(_symbols(spark, sf_dir)))


@offered("SELECT i, id_name, id_place, owner, last FROM (SELECT p_partkey AS i, p_type AS id_name, 'file' || p_partkey || '.lua:' || p_size AS id_place, replace(p_brand, ' ', '') || '.' || p_type AS owner, replace(p_name, ' ', '_') AS last FROM part)")
def symbol_id_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = B.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    sid = F.concat(F.lit("file"), key, F.lit(".lua#function#"), F.col("p_type"), F.lit("#"), F.col("p_size").cast("string"), F.lit(":1"))
    qualified = F.concat(F.replace("p_brand", F.lit(" "), F.lit("")), F.lit("."), "p_type", F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return part.select(F.col("p_partkey").alias("i"), text.id_name(sid).alias("id_name"), text.id_location(sid).alias("id_place"), text.owner(qualified).alias("owner"), text.last_segment(qualified).alias("last"))


# Scopes and resolution.


@offered(_with(SYMBOLS, SCOPES, SITES, select="SELECT file_path, line, src_id FROM (SELECT s.file_path, s.line, c.id AS src_id, row_number() OVER (PARTITION BY s.file_path, s.line ORDER BY end_line - start_line, start_line DESC, c.id) AS n FROM sites s JOIN scopes c ON s.file_path = c.file_path AND s.line BETWEEN c.start_line AND c.end_line) WHERE n = 1"))
def scope_join_narrowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.enclosing_scopes(B.call_sites(spark, sf_dir), B.scopes(spark, sf_dir), ("file_path", "line")).select("file_path", "line", "src_id")


@offered(_with(SYMBOLS, SCOPES, SITES, select="SELECT file_path, line, owner_id FROM (SELECT s.file_path, s.line, c.id AS owner_id, row_number() OVER (PARTITION BY s.file_path, s.line ORDER BY start_line DESC, c.id) AS n FROM sites s JOIN scopes c ON s.file_path = c.file_path AND s.line BETWEEN c.start_line AND c.end_line) WHERE n = 1"))
def branch_owner_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.latest_scopes(B.call_sites(spark, sf_dir), B.scopes(spark, sf_dir), ("file_path", "line")).select("file_path", "line", "owner_id")


# Symbols with names that the resolution rules tell apart, and calls to them.
CODE = "code AS (SELECT id, file_path, start_line, end_line, 1 AS start_column, CASE p_partkey % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'class' ELSE 'function' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'C' || (p_partkey % 50) || ':m' || (p_partkey % 40) WHEN 1 THEN 'K' || (p_partkey % 300) ELSE 'f' || (p_partkey % 700) END AS qualified_name FROM symbols)"
CODE_CALLS = "code_calls AS (SELECT file_path, line, line * 7 + length(file_path) AS k, CASE (line * 7 + length(file_path)) % 3 WHEN 0 THEN 'self:m' || (line % 40) WHEN 1 THEN 'K' || (line * 5 % 300) || '.new' ELSE 'f' || (line * 11 % 700) END AS callee FROM sites)"


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id").cast("long")
    s = lambda c: c.cast("string")
    method, cls, fun = F.concat(F.lit("C"), s(key % 50), F.lit(":m"), s(key % 40)), F.concat(F.lit("K"), s(key % 300)), F.concat(F.lit("f"), s(key % 700))
    return _symbols(spark, sf_dir).withColumn("kind", F.when(key % 3 == 0, "method").when(key % 3 == 1, "class").otherwise("function")).withColumn("qualified_name", F.when(key % 3 == 0, method).when(key % 3 == 1, cls).otherwise(fun))


def _code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, s = F.col("line"), lambda c: c.cast("string")
    k = (line * 7 + F.length("file_path")) % 3
    callee = F.when(k == 0, F.concat(F.lit("self:m"), s(line % 40))).when(k == 1, F.concat(F.lit("K"), s(line * 5 % 300), F.lit(".new"))).otherwise(F.concat(F.lit("f"), s(line * 11 % 700)))
    return B.call_sites(spark, sf_dir).select("file_path", F.col("line").alias("site"), "line", F.lit(1).cast("long").alias("column"), callee.alias("callee"))


_UNIQUE = "uniq AS (SELECT qualified_name, min(id) AS id FROM code GROUP BY 1 HAVING count(*) = 1)"
_LOCAL_METHOD = "lm AS (SELECT file_path, qualified_name, min(id) AS id FROM code WHERE kind = 'method' GROUP BY 1, 2 HAVING count(*) = 1)"
_LOCAL_CLASS = "lc AS (SELECT file_path, qualified_name, min(id) AS id FROM code WHERE kind = 'class' GROUP BY 1, 2 HAVING count(*) = 1)"
_CLASS = "gc AS (SELECT qualified_name, min(id) AS id FROM code WHERE kind = 'class' GROUP BY 1 HAVING count(*) = 1)"


@offered(
    _with(
        SYMBOLS, CODE, SITES, CODE_CALLS, _UNIQUE, _LOCAL_METHOD, _LOCAL_CLASS, _CLASS,
        "scoped AS (SELECT * FROM (SELECT c.*, s.id AS src_id, s.qualified_name AS src_name, row_number() OVER (PARTITION BY c.file_path, c.line ORDER BY end_line - start_line, start_line DESC, s.id) AS n FROM code_calls c JOIN code s ON s.file_path = c.file_path AND s.kind IN ('function', 'method') AND c.line BETWEEN s.start_line AND s.end_line) WHERE n = 1)",
        "keyed AS (SELECT *, CASE WHEN starts_with(callee, 'self:') AND contains(src_name, ':') THEN regexp_extract(src_name, '^(.+):[^:]*$', 1) || ':' || substr(callee, 6) END AS mk, CASE WHEN ends_with(callee, '.new') THEN replace(callee, '.new', '') END AS ck FROM scoped)",
        select="SELECT src_id, coalesce(a.id, b.id, c.id, d.id, e.id) AS dst_id, line, true AS is_resolved FROM keyed k LEFT JOIN lm a ON a.file_path = k.file_path AND a.qualified_name = mk LEFT JOIN uniq b ON b.qualified_name = mk LEFT JOIN lc c ON c.file_path = k.file_path AND c.qualified_name = ck LEFT JOIN gc d ON d.qualified_name = ck LEFT JOIN uniq e ON e.qualified_name = callee WHERE coalesce(a.id, b.id, c.id, d.id, e.id) IS NOT NULL",
    )
)
def call_resolve_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_calls(_code_calls(spark, sf_dir), _code(spark, sf_dir)).drop("column")


@offered(
    _with(
        SYMBOLS, CODE, _UNIQUE,
        "refs AS (SELECT file_path, start_line AS line, qualified_name AS child, 'f' || ((p * 3 + 2) % 700) AS parent FROM (SELECT *, CAST(id AS BIGINT) AS p FROM code))",
        "heads AS (SELECT file_path, qualified_name, start_line, min(id) AS id FROM code GROUP BY 1, 2, 3)",
        "one AS (SELECT file_path, qualified_name, min(id) AS id FROM code GROUP BY 1, 2 HAVING count(*) = 1)",
        select="SELECT h.id AS child_id, coalesce(o.id, u.id) AS parent_id FROM refs r JOIN heads h ON h.file_path = r.file_path AND h.qualified_name = child AND h.start_line = line LEFT JOIN one o ON o.file_path = r.file_path AND o.qualified_name = parent LEFT JOIN uniq u ON u.qualified_name = parent WHERE coalesce(o.id, u.id) IS NOT NULL AND h.id <> coalesce(o.id, u.id)",
    )
)
def extends_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir)
    refs = code.select("file_path", F.col("id").alias("site"), F.col("qualified_name").alias("child"), F.concat(F.lit("f"), ((F.col("id").cast("long") * 3 + 2) % 700).cast("string")).alias("parent"), F.col("start_line").alias("line"))
    return resolve.resolve_extends(refs, code)


MODULES = "modules AS (SELECT f.suppkey AS site, f.path || '.lua' AS file_path, CASE f.suppkey % 5 WHEN 0 THEN replace(g.path, '/', '.') WHEN 1 THEN 'alias.' || replace(g.path, '/', '.') WHEN 2 THEN lower(g.s_name) WHEN 3 THEN lower(f.s_name) || '.lua' ELSE 'missing.x' END AS module_name, f.suppkey % 7 <> 0 AS is_static FROM files f JOIN files g ON g.suppkey = (f.suppkey * 13 + 5) % (SELECT count(*) FROM supplier))"
LUA_FILES = "lua_files AS (SELECT path || '.lua' AS path FROM files)"
CANDIDATES = "cands AS (SELECT site, unnest([m || '.lua', m || '/init.lua', rest || '.lua', rest || '/init.lua', dir || '/' || m || '.lua', dir || '/' || m || '/init.lua']) AS path, unnest([1, 2, 3, 4, 5, 6]) AS place FROM (SELECT *, replace(regexp_replace(module_name, '\\.lua$', ''), '.', '/') AS m, nullif(regexp_extract(replace(regexp_replace(module_name, '\\.lua$', ''), '.', '/'), '^[^/]*/(.*)$', 1), '') AS rest, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM modules))"
SUFFIXES = "sfx AS (SELECT site, min(l.path) AS path FROM (SELECT site, replace(regexp_replace(module_name, '\\.lua$', ''), '.', '/') AS m FROM modules) c JOIN lua_files l ON ends_with(l.path, '/' || m || '.lua') OR ends_with(l.path, '/' || m || '/init.lua') GROUP BY site HAVING count(DISTINCT l.path) = 1)"
FIRST = "firsts AS (SELECT site, arg_min(c.path, place) AS path FROM cands c JOIN lua_files l ON l.path = c.path GROUP BY site)"


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.files(spark, sf_dir)
    n = B.table(spark, sf_dir, "supplier").count()
    far = files.select(F.col("suppkey").alias("far"), F.col("path").alias("far_path"))
    dotted = F.replace("far_path", F.lit("/"), F.lit("."))
    k = F.col("suppkey") % 5
    module = F.when(k == 0, dotted).when(k == 1, F.concat(F.lit("alias."), dotted)).when(k == 2, paths.basename_column(F.col("far_path"))).when(k == 3, F.concat(paths.basename_column(F.col("path")), F.lit(".lua"))).otherwise("missing.x")
    return files.join(far, F.col("far") == (F.col("suppkey") * 13 + 5) % n).select(F.col("suppkey").alias("site"), F.concat("path", F.lit(".lua")).alias("file_path"), module.alias("module_name"), (F.col("suppkey") % 7 != 0).alias("is_static"))


def _lua_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.files(spark, sf_dir).select(F.concat("path", F.lit(".lua")).alias("path"))


@offered(_with(FILES, MODULES, LUA_FILES, CANDIDATES, FIRST, select="SELECT m.site, m.module_name, f.path AS target FROM modules m LEFT JOIN firsts f USING (site)"))
def module_candidates_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _modules(spark, sf_dir)
    tried, _ = resolve.lua_candidates(F.col("file_path"), F.col("module_name"))
    return resolve.first_candidate(modules, _lua_files(spark, sf_dir), tried, ["site"]).select("site", "module_name", "target")


@offered(_with(FILES, MODULES, LUA_FILES, SUFFIXES, select="SELECT m.site, s.path AS suffix_target FROM modules m LEFT JOIN sfx s USING (site)"))
def unique_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _modules(spark, sf_dir)
    _, suffixes = resolve.lua_candidates(F.col("file_path"), F.col("module_name"))
    return resolve.unique_suffix(modules, _lua_files(spark, sf_dir), suffixes, ["site"]).select("site", "suffix_target")


@offered(_with(FILES, MODULES, LUA_FILES, CANDIDATES, FIRST, SUFFIXES, select="SELECT m.file_path AS src_path, CASE WHEN is_static THEN coalesce(f.path, s.path, m.file_path) ELSE m.file_path END AS dst_path, m.module_name, is_static AND coalesce(f.path, s.path) IS NOT NULL AS is_resolved FROM modules m LEFT JOIN firsts f USING (site) LEFT JOIN sfx s USING (site)"))
def require_self_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_requires(_modules(spark, sf_dir), _lua_files(spark, sf_dir))


@offered(
    _with(
        FILES,
        "js AS (SELECT path || CASE suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.jsx' ELSE '/index.js' END AS path, path AS base, suppkey FROM files)",
        "asks AS (SELECT f.suppkey AS site, f.path || '.ts' AS file_path, g.base, CASE f.suppkey % 4 WHEN 0 THEN '../../' || g.base WHEN 1 THEN '../../' || g.base || '.js' WHEN 2 THEN '@/' || g.base ELSE 'bare' END AS module_name, f.suppkey % 4 AS k FROM files f JOIN js g ON g.suppkey = (f.suppkey * 7 + 1) % (SELECT count(*) FROM supplier))",
        "tries AS (SELECT site, unnest(CASE k WHEN 1 THEN [base || '.js', base || '.ts', base || '.tsx', base || '.js/index.ts', base || '.js/index.tsx', base || '.js/index.js', base || '.js/index.jsx'] WHEN 3 THEN [] ELSE [base || '.ts', base || '.tsx', base || '.js', base || '.jsx', base || '/index.ts', base || '/index.tsx', base || '/index.js', base || '/index.jsx'] END) AS path FROM asks)",
        select="SELECT a.site, a.module_name, t.path AS target FROM asks a LEFT JOIN (SELECT site, min(js.path) AS path FROM tries JOIN js USING (path) GROUP BY site) t USING (site)",
    )
)
def js_module_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.files(spark, sf_dir)
    n = B.table(spark, sf_dir, "supplier").count()
    k = F.col("suppkey") % 3
    js = files.select(F.concat("path", F.when(k == 0, ".ts").when(k == 1, ".jsx").otherwise("/index.js")).alias("path"))
    far = files.select(F.col("suppkey").alias("far"), F.col("path").alias("base"))
    up, kind = F.concat(F.lit("../../"), "base"), F.col("suppkey") % 4
    module = F.when(kind == 0, up).when(kind == 1, F.concat(up, F.lit(".js"))).when(kind == 2, F.concat(F.lit("@/"), "base")).otherwise("bare")
    asks = files.join(far, F.col("far") == (F.col("suppkey") * 7 + 1) % n).select(F.col("suppkey").alias("site"), F.concat("path", F.lit(".ts")).alias("file_path"), module.alias("module_name"))
    tried = resolve.js_candidates(F.col("file_path"), F.col("module_name"), ".", [("@/*", ["*"])])
    return resolve.first_candidate(asks, js, tried, ["site"]).select("site", "module_name", "target")


# Traversals.

_SEEDS = f"SELECT id FROM symbols WHERE name = '{_SEED_NAME}' OR qualified_name = '{_SEED_NAME}'"
_MET_CALLS = 'SELECT src_id AS source, dst_id AS target, line, "column" FROM met'


def _edges(found: query.Result) -> DataFrame:
    return found.edges.select("source", "target", "line", "column")


@offered(_with(SYMBOLS, CALLS, _levels(_SEEDS, "calls", "dst_id", "src_id", 1), select=_MET_CALLS))
def callers_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(query.relate(B.graph(spark, sf_dir), "callers", _SEED_NAME, 1, cut=False))


@offered(_with(SYMBOLS, CALLS, _levels(_SEEDS, "calls", "dst_id", "src_id", 2), select=f"SELECT {_NODE} FROM symbols WHERE id IN (SELECT src_id FROM met)"))
def callers_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_columns(query.relate(B.graph(spark, sf_dir), "callers", _SEED_NAME, 2, cut=False).nodes)


@offered(_with(SYMBOLS, CALLS, _levels(_SEEDS, "calls", "src_id", "dst_id", 3, "SELECT id FROM symbols WHERE kind = 'PROMO'"), select=_MET_CALLS))
def callees_filtered_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(query.relate(B.graph(spark, sf_dir), "callees", _SEED_NAME, 3, kind="PROMO", cut=False))


@offered(_with(EXTENDS, select="SELECT child_id AS source, parent_id AS target FROM extends"))
def extends_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.relate(B.graph(spark, sf_dir), "extends", "*", 1, cut=False).edges.select("source", "target")


@offered(_with(SYMBOLS, EXTENDS, _levels(_SEEDS, "extends", "parent_id", "child_id", 3), select="SELECT child_id AS source, parent_id AS target FROM met"))
def subclasses_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.relate(B.graph(spark, sf_dir), "subclasses", _SEED_NAME, 3, cut=False).edges.select("source", "target")


_FILE_SEEDS = "SELECT path AS id FROM files WHERE contains(path, 'asia/nation_1')"
_MET_REQUIRES = "SELECT src_path AS source, dst_path AS target, module_name, is_resolved FROM met"


@offered(_with(FILES, REQUIRES, _levels(_FILE_SEEDS, "requires", "src_path", "dst_path", 2), select=_MET_REQUIRES))
def requires_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.relate_files(B.graph(spark, sf_dir), "requires", "asia/nation_1", 2, cut=False).edges.select("source", "target", "module_name", "is_resolved")


@offered(_with(FILES, REQUIRES, _levels(_FILE_SEEDS, "requires", "dst_path", "src_path", 2), select="SELECT DISTINCT src_path AS path FROM met"))
def dependents_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.relate_files(B.graph(spark, sf_dir), "dependents", "asia/nation_1", 2, cut=False).nodes.select(F.col("id").alias("path"))


@offered(
    _with(
        SYMBOLS, CALLS,
        f"s AS (SELECT * FROM symbols WHERE name = '{_SEED_NAME}')",
        "l1 AS (SELECT c.src_id, arg_min(struct_pack(d := c.dst_id, l := c.line, c := c.\"column\"), (s.file_path, s.start_line, s.kind, s.qualified_name, c.dst_id, c.line, c.\"column\")) AS e FROM calls c JOIN s ON s.id = c.dst_id WHERE c.src_id NOT IN (SELECT id FROM s) GROUP BY c.src_id)",
        "l2 AS (SELECT c.src_id, arg_min(struct_pack(d := c.dst_id, l := c.line, c := c.\"column\"), (c.dst_id, c.line, c.\"column\")) AS e FROM calls c JOIN l1 ON l1.src_id = c.dst_id WHERE c.src_id NOT IN (SELECT id FROM s UNION ALL SELECT src_id FROM l1) GROUP BY c.src_id)",
        select="SELECT src_id AS source, e.d AS target, e.l AS line, e.c AS \"column\" FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2)",
    )
)
def impact_calls_first_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = B.graph(spark, sf_dir)
    seeds = g.symbols.where(query.named(_SEED_NAME))
    return query.call_edges(impact.callers(seeds, g.calls, 2, cut=False).edges).select("source", "target", "line", "column")


@offered(_with(SYMBOLS, EXTENDS, _levels(_SEEDS, "extends", "parent_id", "child_id", 2), select="SELECT child_id AS source, parent_id AS target FROM met"))
def impact_extends_all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = B.graph(spark, sf_dir)
    return query.extend_edges(impact.subclasses(g.symbols.where(query.named(_SEED_NAME)), g.extends, 2, cut=False).edges).select("source", "target")


_SOURCES = "r0 AS (SELECT path AS root, path FROM files WHERE contains(path, 'asia/nation_1')), u AS (SELECT DISTINCT * FROM requires WHERE src_path <> dst_path), r1 AS (SELECT DISTINCT root, u.* FROM u JOIN r0 ON dst_path = path), g1 AS (SELECT DISTINCT root, src_path AS path FROM r1 WHERE (root, src_path) NOT IN (SELECT (root, path) FROM r0)), r2 AS (SELECT DISTINCT root, u.* FROM u JOIN g1 ON dst_path = path), rall AS (SELECT src_path, dst_path, module_name FROM r1 UNION SELECT src_path, dst_path, module_name FROM r2)"


@offered(_with(FILES, REQUIRES, _SOURCES, select="SELECT src_path AS source, dst_path AS target, module_name FROM rall"))
def impact_dependents_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = B.graph(spark, sf_dir)
    _, edges = traverse.dependents(impact.input_files(g, "asia/nation_1"), g.requires, 2, cut=False)
    return query.require_edges(edges).select("source", "target", "module_name")


@offered(_with(FILES, REQUIRES, SYMBOLS, CALLS, _SOURCES, _levels(_SEEDS, "calls", "dst_id", "src_id", 2), select="SELECT file_path AS path FROM symbols WHERE id IN (SELECT src_id FROM met) AND name <> 'red plate' UNION SELECT src_path FROM rall"))
def impact_union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = B.graph(spark, sf_dir)
    up = impact.callers(g.symbols.where(query.named(_SEED_NAME)), g.calls, 2, cut=False)
    files, _ = traverse.dependents(impact.input_files(g, "asia/nation_1"), g.requires, 2, cut=False)
    return g.symbols.join(up.nodes, "id", "left_semi").select(F.col("file_path").alias("path")).unionByName(files).distinct()


@offered(
    _with(
        SYMBOLS, CALLS,
        "p1 AS (SELECT s.id AS entrypoint, 1 AS depth, c.src_id, c.dst_id, line, \"column\" FROM symbols s JOIN calls c ON c.src_id = s.id WHERE s.name = 'red plate')",
        "p2 AS (SELECT entrypoint, 2 AS depth, c.src_id, c.dst_id, c.line, c.\"column\" FROM p1 JOIN calls c ON c.src_id = p1.dst_id WHERE p1.dst_id <> entrypoint)",
        select="SELECT * FROM p1 UNION ALL SELECT * FROM p2",
    )
)
def call_paths_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = B.graph(spark, sf_dir)
    heads = g.symbols.where(query.named(_SEED_NAME))
    return traverse.call_paths(heads, g.calls, 2, cut=False).drop("trail", "is_resolved")


@offered(_with(SYMBOLS, CALLS, select="SELECT c.dst_id AS id FROM calls c JOIN symbols s ON s.id = c.src_id AND s.name = 'red plate' UNION SELECT c.src_id FROM calls c JOIN symbols s ON s.id = c.dst_id AND s.name = 'red plate'"))
def neighbour_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = B.graph(spark, sf_dir)
    return traverse.neighbours(g.symbols.where(query.named(_SEED_NAME)).select("id"), query.call_edges(g.calls))


# Counts, rankings and samples.

_EXTERNAL = "ext AS (SELECT c.dst_id AS id, count(DISTINCT c.src_id) AS external FROM calls c JOIN symbols a ON a.id = c.src_id JOIN symbols b ON b.id = c.dst_id WHERE a.file_path <> b.file_path GROUP BY 1)"
_OUT = "outs AS (SELECT src_id AS id, count(DISTINCT dst_id) AS call_out FROM calls GROUP BY 1)"


@offered(_with(SYMBOLS, CALLS, _EXTERNAL, select="SELECT s.id, coalesce(external, 0) AS external FROM symbols s LEFT JOIN ext USING (id)"))
def external_caller_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = B.graph(spark, sf_dir)
    return explain.external_callers(g.symbols, g.calls)


@offered(_with(CALLS, _OUT, select="SELECT * FROM outs"))
def call_out_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.callee_counts(B.calls(spark, sf_dir))


@offered(_with(SYMBOLS, SCOPES, CALLS, _EXTERNAL, _OUT, select="SELECT s.id, coalesce(external, 0) AS external, coalesce(call_out, 0) AS call_out, 3 * coalesce(external, 0) + coalesce(call_out, 0) AS score FROM scopes s LEFT JOIN ext USING (id) LEFT JOIN outs USING (id) ORDER BY score DESC, external DESC, call_out DESC, start_line, qualified_name, id LIMIT 21"))
def entrypoint_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.scopes(spark, sf_dir)
    return explain.ranked_entrypoints(found, found, B.calls(spark, sf_dir)).select("id", "external", "call_out", "score")


@offered(_with(SYMBOLS, SCOPES, CALLS, _EXTERNAL, select="SELECT s.id FROM scopes s LEFT JOIN ext USING (id) WHERE coalesce(external, 0) > 0 OR (p_partkey % 2 = 1 AND kind = 'function')"))
def explicit_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.scopes(spark, sf_dir)
    counted = found.join(explain.external_callers(found, B.calls(spark, sf_dir)), "id")
    return counted.where(explain.is_explicit(F.col("external"))).select("id")


@offered(_with(SYMBOLS, select="SELECT kind, count(*) AS n FROM symbols GROUP BY kind"))
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kind_counts(_symbols(spark, sf_dir))


@offered(_with(FILES, SYMBOLS, CALLS, EXTENDS, REQUIRES, select="SELECT 'contains' AS edge, 0 AS n UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'requires', count(*) FROM requires UNION ALL SELECT 'returns', 0 UNION ALL SELECT 'assigns', 0 UNION ALL SELECT 'extends', count(*) FROM extends"))
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.edge_counts(B.graph(spark, sf_dir))


@offered(_with(SYMBOLS, select="SELECT kind, name, qualified_name, file_path, start_line FROM symbols ORDER BY file_path, start_line, kind, name, id LIMIT 20"))
def sample_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sample(B.graph(spark, sf_dir), 20).select("kind", "name", "qualified_name", "file_path", "start_line")


# Snapshots.

_OLD = "old AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0)"
_NEW = "new AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 11 <> 0)"
_DIFF = "diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'changed' END AS change FROM old o FULL JOIN new n ON o.path = n.path)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An older and a newer state of the documents: some removed, added and changed."""
    docs = B.table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("path")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.where("doc_id % 7 <> 0").select(key, F.sha2("text", 256).alias("content_hash")), docs.where("doc_id % 11 <> 0").select(key, F.sha2(changed, 256).alias("content_hash"))


@offered(_with(_OLD, _NEW, _DIFF, select="SELECT * FROM diff WHERE change IS NOT NULL"))
def hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hash_diff(*_snapshots(spark, sf_dir))


@offered(_with(_OLD, _NEW, _DIFF, select="SELECT count(*) AS pending, count(*) FILTER (change = 'removed') AS removed FROM diff WHERE change IS NOT NULL"))
def pending_change_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hash_diff(*_snapshots(spark, sf_dir)).agg(F.count("*").alias("pending"), F.count_if(F.col("change") == "removed").alias("removed"))


@offered(_with(_OLD, _NEW, _DIFF, select="SELECT path, content_hash FROM old WHERE path NOT IN (SELECT path FROM diff WHERE change IS NOT NULL) UNION ALL SELECT path, content_hash FROM new WHERE path IN (SELECT path FROM diff WHERE change IN ('added', 'changed'))"))
def sync_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    diff = reports.hash_diff(old, new)
    fresh = new.join(diff.where("change <> 'removed'"), "path", "left_semi")
    return store.upsert(old.join(diff.where("change = 'removed'"), "path", "left_anti"), fresh, ["path"])


@offered(_with(FILES, REQUIRES, select="SELECT src_path, dst_path, module_name FROM requires WHERE NOT contains(src_path, 'asia/') AND NOT contains(dst_path, 'asia/')"))
def delete_edges_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    affected = B.files(spark, sf_dir).where(F.col("path").contains("asia/")).select("path")
    return store.delete_edges(B.requires(spark, sf_dir), ("src_path", "dst_path"), affected).select("src_path", "dst_path", "module_name")


# Source lines.


@offered(_with(LINES, "sites AS (SELECT CAST(doc_id AS VARCHAR) AS file_path, 1 + doc_id % 4 AS site FROM documents)", select="SELECT s.file_path, site, min(line) AS start_line, max(line) AS end_line, string_agg(code, chr(10) ORDER BY line) AS code FROM sites s JOIN lines l ON l.file_path = s.file_path AND line BETWEEN site - 1 AND site + 1 GROUP BY 1, 2 HAVING count(*) FILTER (line = site) > 0"))
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = B.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), (F.col("doc_id") % 4 + 1).alias("site"))
    return reports.snippets(B.source_lines(spark, sf_dir), sites, 1)


#: Texts made to look like code, by line number and length.
_FORMS = ["if {} then", "elseif {} then x", "}} else if ({}) {{", "if ({}) {{", "switch ({}) {{", "case {}:", "return {} ? a : b", "{}", "local v = {};", "self.x = {},", "go({});", "return {};", "byId.myMap = {}", "return"]
_CODE_LINE = "CASE (line + length(code)) % 14 " + " ".join(f"WHEN {i} THEN " + " || ".join(f"'{p}'" for p in [f.replace("{{", "{").replace("}}", "}").split("{}")[0]]) + (" || code || '" + f.replace("{{", "{").replace("}}", "}").split("{}", 1)[1].replace("{}", "") + "'" if "{}" in f else "") for i, f in enumerate(_FORMS)) + " END"
_MADE = f"made AS (SELECT file_path, line, trim({_CODE_LINE}, chr(32) || chr(9) || chr(11) || chr(12) || chr(13) || chr(10) || chr(160) || chr(65279)) AS t FROM lines)"


def _made_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents put into forms that code has."""
    forms = [f.replace("{{", "\1").replace("}}", "\2").partition("{}") for f in _FORMS]
    texts = lambda n: F.array(*[F.lit(f[n].replace("\1", "{").replace("\2", "}")) for f in forms])
    at = ((F.col("line") + F.length("code")) % 14 + 1).cast("int")
    numbered = B.source_lines(spark, sf_dir).withColumn("at", at)
    filled = F.when(F.element_at(texts(1), F.col("at")) == "", F.lit("")).otherwise(F.col("code"))
    return numbered.select("file_path", "line", F.concat(F.element_at(texts(0), F.col("at")), filled, F.element_at(texts(2), F.col("at"))).alias("code"))


#: The same characters, as SQL's trim takes them.
_ENDS = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13) || chr(10) || chr(160) || chr(65279)"


def _sql_trim(x: str) -> str:
    return f"trim({x}, {_ENDS})"


def _sql_form(kind: str, head: str, rest: str, close: str) -> str:
    """Of a line that begins with a head: the condition after it, up to the first or last close."""
    return f"WHEN len(regexp_extract(t, '^{head}{rest}{close}', 1)) > 0 THEN struct_pack(k := '{kind}', c := regexp_extract(t, '^{head}{rest}{close}', 1))"


_LUA, _JS = (r"[\t\n\f\r ]+(.+?)", r"[\t\n\f\r ]+then(?:\W|$)"), (r"[\t\n\f\r ]*[(](.+)", "[)]")
_BRANCH = "CASE " + " ".join([_sql_form("elseif", "elseif", *_LUA), _sql_form("if", "if", *_LUA), _sql_form("elseif", r"[}]?[\t\n\f\r ]*else[\t\n\f\r ]+if", *_JS), _sql_form("if", "if", *_JS), _sql_form("switch", "switch", *_JS), _sql_form("case", "case", r"[\t\n\f\r ]+(.+)", ":")]) + " WHEN split_part(t, '?', 1) NOT IN ('', t) AND contains(substr(t, length(split_part(t, '?', 1)) + 2), ':') THEN struct_pack(k := 'conditional', c := CASE WHEN starts_with(t, 'return ') THEN substr(split_part(t, '?', 1), 8) ELSE split_part(t, '?', 1) END) END"


@offered(_with(LINES, _MADE, select=f"SELECT file_path, line, b.k AS kind, {_sql_trim('b.c')} AS condition FROM (SELECT *, {_BRANCH} AS b FROM made) WHERE b IS NOT NULL"))
def line_regex_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _made_lines(spark, sf_dir).withColumn("t", text.trim(F.col("code"))).withColumn("b", text.branch(F.col("t")))
    return found.where("b is not null").select("file_path", "line", "b.kind", "b.condition")


def _sql_summary(x: str) -> str:
    return f"substr({_sql_trim(f"CASE WHEN right(rtrim({x}), 1) IN (';', ',') THEN left(rtrim({x}), -1) ELSE {x} END")}, 1, 140)"


# A line's words to its first sign, the signs in it, and what each kind of step asks of them.
_STEP_PARTS = """
marks AS (SELECT *, list_contains(['if', 'for', 'while', 'switch', 'case', 'function', 'elseif', 'else if', 'async function', '}'], w) AS steers FROM (SELECT m.*, (SELECT max(x) FROM (SELECT unnest(['if', 'for', 'while', 'switch', 'case', 'function', 'elseif', 'else if', 'async function', '}']) AS x) WHERE starts_with(t, x)) AS w, regexp_extract(t, '^[A-Za-z0-9_]*') AS word FROM made m)),
sides AS (SELECT *, coalesce(steers, false) OR word = 'end' AS control, strpos(t, '=') AS eq, strpos(t, '(') AS br FROM marks),
names AS (SELECT *, CASE WHEN br > 0 THEN rtrim(left(t, br - 1)) ELSE '' END AS called_name, regexp_extract(CASE WHEN eq > 0 THEN left(t, eq - 1) ELSE '' END, '^(?:(?:const|let|var|local) *)?([A-Za-z0-9_$.\\[\\]''"]+) *(?::[^({]+)?$', 1) AS target FROM sides),
parts AS (SELECT *,
  CASE WHEN NOT control AND eq > 0 AND eq < length(t) AND target <> '' AND NOT contains(t, '=>') AND NOT regexp_full_match(called_name, '[A-Za-z0-9_$.]+[:.][A-Za-z0-9_$]+') THEN target || ' = ' || SUMMARY_VALUE END AS assigned,
  CASE WHEN NOT control AND word <> 'return' AND strpos(substr(t, br + 1), ')') > 0 AND regexp_full_match(called_name, '[A-Za-z0-9_$.:]+') THEN SUMMARY_LINE END AS called,
  CASE WHEN word = 'return' THEN coalesce(nullif(SUMMARY_REST, ''), 'result') END AS back FROM names)""".replace("SUMMARY_VALUE", _sql_summary("ltrim(substr(t, eq + 1))")).replace("SUMMARY_LINE", _sql_summary("t")).replace("SUMMARY_REST", _sql_summary("ltrim(substr(t, 7))"))
_STEPS = "steps AS (SELECT file_path, line, coalesce(assigned, called, back) AS label, CASE WHEN assigned IS NOT NULL THEN CASE WHEN split_part(assigned, '.', 1) IN ('self', 'this') AND contains(assigned, '.') OR regexp_matches(regexp_extract(assigned, '^[A-Za-z0-9_]+'), '.(ById|ByKey|Map|Set)$') THEN 'state' ELSE 'assignment' END WHEN called IS NOT NULL THEN 'call' WHEN back IS NOT NULL THEN 'return' END AS source FROM parts)"


@offered(_with(LINES, _MADE, _STEP_PARTS, _STEPS, select="SELECT file_path, line, source, label FROM steps WHERE source IS NOT NULL"))
def line_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.line_steps(_made_lines(spark, sf_dir)).where("source is not null")


@offered(
    _with(
        LINES, _MADE, _STEP_PARTS, _STEPS,
        "once AS (SELECT DISTINCT file_path, source, line % 9 AS line, label FROM steps WHERE source IS NOT NULL)",
        "firsts AS (SELECT file_path, source, line % 9 AS line, label, min(steps.line) AS seq FROM steps WHERE source IS NOT NULL GROUP BY ALL)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line, CASE source WHEN 'assignment' THEN 3 WHEN 'state' THEN 4 WHEN 'call' THEN 5 ELSE 7 END, seq) AS n, min(CASE WHEN source = 'return' THEN seq END) OVER (PARTITION BY file_path) AS fr FROM firsts)",
        "shown AS (SELECT *, bool_or(source = 'return' AND n <= 16) OVER (PARTITION BY file_path) AS has FROM ranked)",
        select='SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY n) AS "order", source, line, label FROM shown WHERE n < 16 OR (n = 16 AND (has OR fr IS NULL)) OR (NOT has AND source = \'return\' AND seq = fr)',
    )
)
def step_dedup_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = explain.line_steps(_made_lines(spark, sf_dir)).where("source is not null")
    return explain.ordered_steps(steps.select("file_path", F.col("line").alias("seq"), "source", (F.col("line") % 9).alias("line"), "label"), ("file_path",)).select("file_path", "order", "source", "line", "label")


@offered("SELECT p_partkey AS i, 'a,b' || p_partkey || ',c' AS names FROM part")
def parameter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("function f(a: string, b"), F.col("p_partkey").cast("string"), F.lit(" = 1 , , c?: {x}) {"))
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.array_join(text.parameters(header), ",").alias("names"))


# The graph for viewers.


@offered(_with(FILES, REQUIRES, select="SELECT src_path AS source, CASE WHEN is_resolved THEN dst_path ELSE 'module:' || src_path || ':' || module_name END AS target, module_name, is_resolved FROM requires"))
def graph_export_module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = reports.viewer_graph(B.graph(spark, sf_dir))
    return edges.where("kind = 'Requires'").select("source", "target", "module_name", "is_resolved")


@offered(_with(FILES, SYMBOLS, REQUIRES, select="SELECT path AS id, 'file' AS kind FROM files WHERE contains(lower(path || ' ' || path || ' '), 'nation_1') UNION ALL SELECT id, kind FROM symbols WHERE contains(lower(qualified_name || ' ' || file_path || ' ' || signature), 'nation_1') UNION ALL SELECT 'module:' || src_path || ':' || module_name, 'module' FROM requires WHERE NOT is_resolved AND contains(src_path, 'nation_1')"))
def viewer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = reports.viewer_graph(B.graph(spark, sf_dir))
    return reports.search_nodes(nodes, "NATION_1").select("id", "kind")


@offered(_with(FILES, EXTENDS, REQUIRES, "parts AS (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part)", select="SELECT child_id AS source, parent_id AS target, 'Extends' AS kind FROM extends WHERE parent_id IN (SELECT id FROM parts) UNION ALL SELECT src_path, dst_path, 'Requires' FROM requires WHERE is_resolved"))
def loaded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = reports.viewer_graph(B.graph(spark, sf_dir))
    return reports.loaded_edges(edges, nodes.where("type <> 'Module'")).select("source", "target", "kind")


@offered("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))


@offered(_with(FILES, SYMBOLS, REQUIRES, select="SELECT DISTINCT kind FROM symbols UNION SELECT 'file' UNION SELECT 'module' FROM requires WHERE NOT is_resolved"))
def viewer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = reports.viewer_graph(B.graph(spark, sf_dir))
    return reports.node_kinds(nodes)


@offered(_with(LINES, select="SELECT file_path, line, array_to_string(list_filter(string_split(translate(code, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> ''), ' ') AS code FROM lines"))
def whitespace_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.source_lines(spark, sf_dir).select("file_path", "line", text.collapse(F.col("code")).alias("code"))


@offered("SELECT p_partkey AS i FROM part WHERE p_partkey % 8 IN (0, 1, 2, 3, 4)")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in (".lua", ".js", ".jsx", ".ts", ".tsx", ".d.ts", ".luac", "/js")])
    path = F.concat(F.lit("src/"), "p_name", F.element_at(ends, (F.col("p_partkey") % 8 + 1).cast("int")))
    return B.table(spark, sf_dir, "part").where(paths.supported_column(path)).select(F.col("p_partkey").alias("i"))


# Parsed sources: a Lua and a TypeScript file for each supplier n, which name those of m.

_LUA_SOURCE = """local other = require("lua.f{m}")
local Widget{n} = class("Widget{n}", Widget{m})
function Widget{n}:draw(a, b)
  self:draw(a)
  helper{m}(b)
end
local function helper{n}(x)
  return Widget{n}.new(x)
end
"""
_TS_SOURCE = """import { make{m} } from "./f{m}";
export class Shape{n} extends Shape{m} {
  area{n}(x) {
    return make{m}(x);
  }
}
export function make{n}(x) {
  return unknown{n}(x);
}
"""
#: What has to be found in them, written by hand: path, kind, name, qualified name,
#: signature, first and last line, column, local, exported.
_FOUND = [
    ("lua/f{n}.lua", "class", "Widget{n}", "Widget{n}", 'local Widget{n} = class("Widget{n}", Widget{m})', 2, 2, 1, True, False),
    ("lua/f{n}.lua", "method", "draw", "Widget{n}:draw", "function Widget{n}:draw(a, b)", 3, 6, 1, False, True),
    ("lua/f{n}.lua", "function", "helper{n}", "helper{n}", "local function helper{n}(x)", 7, 9, 1, True, False),
    ("ts/f{n}.ts", "class", "Shape{n}", "Shape{n}", "export class Shape{n} extends Shape{m} {", 2, 6, 1, False, True),
    ("ts/f{n}.ts", "method", "area{n}", "Shape{n}.area{n}", "area{n}(x) {", 3, 5, 3, False, True),
    ("ts/f{n}.ts", "function", "make{n}", "make{n}", "export function make{n}(x) {", 7, 9, 1, False, True),
]
class Sql(str):
    """An expected value that SQL works out."""


_SAID = [("lua/f{n}.lua", "require", 1, 15), ("lua/f{n}.lua", "class", 2, Sql("16 + length(CAST(n AS VARCHAR))")), ("lua/f{n}.lua", "self:draw", 4, 3), ("lua/f{n}.lua", "helper{m}", 5, 3), ("lua/f{n}.lua", "Widget{n}.new", 8, 10), ("ts/f{n}.ts", "make{m}", 4, 12), ("ts/f{n}.ts", "unknown{n}", 8, 10)]


def _sql_rows(name: str, columns: str, rows: list[tuple], where: str = "true") -> str:
    """A CTE with the rows for every supplier n and its m, both put in for their names."""
    show = lambda x: "replace(replace('" + x + "', '{n}', CAST(n AS VARCHAR)), '{m}', CAST(m AS VARCHAR))" if isinstance(x, str) and not isinstance(x, Sql) else str(x) if isinstance(x, Sql) else str(x).lower()
    one = "SELECT n, m, " + ", ".join(f"{{{i}}} AS {c}" for i, c in enumerate(columns.split(", "))) + " FROM numbered WHERE " + where
    return f"{name} AS (" + " UNION ALL ".join(one.format(*map(show, r)) for r in rows) + ")"


_NUMBERED = "numbered AS (SELECT s_suppkey AS n, s_suppkey % 10 + 1 AS m, EXISTS (SELECT 1 FROM supplier o WHERE o.s_suppkey = s.s_suppkey % 10 + 1) AS there FROM supplier s)"
_FOUND_SQL = _sql_rows("found", "file_path, kind, name, qualified_name, signature, start_line, end_line, start_column, is_local, is_exported", _FOUND)
_ID = "file_path || '#' || kind || '#' || qualified_name || '#' || start_line || ':' || start_column"
_IDS = f"ids AS (SELECT n, kind, split_part(file_path, '/', 1) AS lang, file_path, qualified_name, {_ID} AS id FROM found)"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    named = lambda t: F.replace(F.replace(F.lit(t), F.lit("{n}"), n.cast("string")), F.lit("{m}"), (n % 10 + 1).cast("string"))
    sources = [B.table(spark, sf_dir, "supplier").select(named(path).alias("path"), named(source).alias("text")) for path, source in (("lua/f{n}.lua", _LUA_SOURCE), ("ts/f{n}.ts", _TS_SOURCE))]
    files = sources[0].unionByName(sources[1])
    return parse_files(files.select("path", "text", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("timestamp").alias("modified_at")))


def _built(spark: SparkSession, sf_dir: str) -> Graph:
    return project.build(checkpointed(_parsed(spark, sf_dir)))


@offered(_with(_NUMBERED, _FOUND_SQL, select=f"SELECT {_ID} AS id, kind, name, qualified_name, file_path, signature, start_line, end_line, start_column, is_local, is_exported FROM found"))
def parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.symbols_of(_parsed(spark, sf_dir)).select("id", "kind", "name", "qualified_name", "file_path", "signature", "start_line", "end_line", "start_column", "is_local", "is_exported")


@offered(_with(_NUMBERED, _sql_rows("said", "file_path, callee, line, start_column", _SAID), select="SELECT file_path, callee, line, start_column FROM said"))
def parsed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(F.explode("calls").alias("c")).select("c.file_path", "c.callee", "c.line", F.col("c.column").alias("start_column"))


@offered(_with(_NUMBERED, _sql_rows("named", "file_path, kind, subject, object, line", [("lua/f{n}.lua", "extends", "Widget{n}", "Widget{m}", 2), ("ts/f{n}.ts", "extends", "Shape{n}", "Shape{m}", 2), ("lua/f{n}.lua", "requires", "static", "lua.f{m}", 1), ("ts/f{n}.ts", "requires", "static", "./f{m}", 1)]), select="SELECT file_path, kind, subject, object, line FROM named"))
def parsed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = checkpointed(_parsed(spark, sf_dir))
    extends = parsed.select(F.explode("extends").alias("x")).select("x.file_path", F.lit("extends").alias("kind"), F.col("x.child").alias("subject"), F.col("x.parent").alias("object"), "x.line")
    requires = parsed.select(F.explode("requires").alias("x")).select("x.file_path", F.lit("requires").alias("kind"), F.when(F.col("x.is_static"), "static").otherwise("dynamic").alias("subject"), F.col("x.module_name").alias("object"), "x.line")
    return extends.unionByName(requires)


@offered(_with(_NUMBERED, _FOUND_SQL, _IDS, select="SELECT file_path AS src_path, id AS dst_id FROM ids"))
def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.contains_of(_parsed(spark, sf_dir))


_CALLED = "called AS (SELECT a.id AS src_id, b.id AS dst_id, x.line FROM numbered s JOIN (VALUES ('Widget', ':draw', 'method', 'Widget', ':draw', 'method', true, 4), ('Widget', ':draw', 'method', 'helper', '', 'function', false, 5), ('helper', '', 'function', 'Widget', '', 'class', true, 8), ('Shape', '.area', 'method', 'make', '', 'function', false, 4)) x(a, a_end, a_kind, b, b_end, b_kind, own, line) ON true JOIN ids a ON a.n = s.n AND a.kind = a_kind AND starts_with(a.qualified_name, x.a) AND contains(a.qualified_name, a_end) JOIN ids b ON b.n = CASE WHEN own THEN s.n ELSE s.m END AND b.kind = b_kind AND starts_with(b.qualified_name, x.b))"


@offered(_with(_NUMBERED, _FOUND_SQL, _IDS, _CALLED, select="SELECT src_id, dst_id, line FROM called"))
def built_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).calls.where("is_resolved").select("src_id", "dst_id", "line")


@offered(_with(_NUMBERED, _FOUND_SQL, _IDS, select="SELECT a.id AS child_id, b.id AS parent_id FROM numbered s JOIN ids a ON a.n = s.n AND a.kind = 'class' JOIN ids b ON b.n = s.m AND b.kind = 'class' AND a.lang = b.lang"))
def built_extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).extends.select("child_id", "parent_id")


@offered(_with(_NUMBERED, select="SELECT lang || '/f' || n || '.' || lang AS src_path, lang || '/f' || CASE WHEN there THEN m ELSE n END || '.' || lang AS dst_path, there AS is_resolved FROM numbered, (VALUES ('lua'), ('ts')) x(lang)"))
def built_requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).requires.select("src_path", "dst_path", "is_resolved")


@offered(_with(_NUMBERED, _FOUND_SQL, _IDS, _CALLED, select="SELECT src_id AS source, dst_id AS target, line FROM called WHERE dst_id LIKE '%#helper3#%' UNION SELECT src_id, dst_id, line FROM called WHERE dst_id IN (SELECT src_id FROM called WHERE dst_id LIKE '%#helper3#%')"))
def query_run_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a query as users go it: expression, seeds, checkpointed levels."""
    return query.run(_built(spark, sf_dir), "callers:helper3", 2).edges.select("source", "target", "line")


@offered(_with(_NUMBERED, _FOUND_SQL, _IDS, select="SELECT id FROM ids WHERE qualified_name = 'make3'"))
def query_run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.run(_built(spark, sf_dir), "name:make3 kind:function").nodes.select("id")


@offered(_with(_NUMBERED, _FOUND_SQL, _IDS, _CALLED, select="SELECT src_id AS id FROM called WHERE dst_id LIKE 'lua/f3.lua#%' AND src_id NOT LIKE 'lua/f3.lua#%' UNION SELECT a.id FROM called c JOIN called d ON d.dst_id = c.src_id JOIN ids a ON a.id = d.src_id WHERE c.dst_id LIKE 'lua/f3.lua#%' AND d.src_id NOT LIKE 'lua/f3.lua#%' UNION SELECT a.id FROM ids a JOIN numbered s ON s.n = a.n WHERE a.kind = 'class' AND lang = 'lua' AND (s.m = 3 OR s.m IN (SELECT n FROM numbered WHERE m = 3)) AND a.n <> 3"))
def impact_run_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.run(_built(spark, sf_dir), "lua/f3.lua", 2).nodes.select("id").distinct()


@offered(_with(_NUMBERED, _FOUND_SQL, _IDS, select="SELECT row_number() OVER (ORDER BY file_path, id) - 1 AS position, id FROM ids WHERE kind = 'function'"))
def node_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = query.ordered_nodes(query.run(_built(spark, sf_dir), "kind:function").nodes)
    return ordered.select("id").coalesce(1).select(F.monotonically_increasing_id().alias("position"), "id")


@offered(_with(_NUMBERED, _FOUND_SQL, _IDS, select="SELECT id, CASE kind WHEN 'x' THEN '' ELSE qualified_name END AS label, 'Symbol' AS type FROM ids UNION ALL SELECT DISTINCT file_path, file_path, 'File' FROM ids"))
def viewer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = reports.viewer_graph(_built(spark, sf_dir))
    return nodes.where("type <> 'Module'").select("id", "label", "type")
