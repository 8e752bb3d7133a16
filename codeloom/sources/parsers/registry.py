"""Language adapters by file extension, run over a frame of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.session import ship
from codeloom.sources.parsers import ecma, lua
from codeloom.sources.parsers.ir import Parsed

#: Language and parser of each extension.
ADAPTERS: dict[str, tuple[str, Callable[[str, str], Parsed]]] = {
    ".lua": ("lua", lua.parse),
    ".js": ("js", ecma.parse),
    ".jsx": ("js", ecma.parse),
    ".ts": ("js", ecma.parse),
    ".tsx": ("js", ecma.parse),
}


def register(extension: str, language: str, parse: Callable[[str, str], Parsed]) -> None:
    """Add a language adapter, or replace one."""
    ADAPTERS[extension] = (language, parse)


def extensions() -> tuple[str, ...]:
    """The extensions that have an adapter."""
    return tuple(ADAPTERS)


def adapter(path: str, adapters: dict[str, tuple[str, Callable[[str, str], Parsed]]] | None = None) -> tuple[str, Callable[[str, str], Parsed]]:
    known = ADAPTERS if adapters is None else adapters
    for extension in sorted(known, key=len, reverse=True):
        if path.endswith(extension):
            return known[extension]
    raise ValueError(f"no parser for {path}")


_SYMBOL = pa.struct([(c, pa.string()) for c in ("id", "kind", "name", "qualified_name", "file_path", "signature")] + [(c, pa.int64()) for c in ("start_line", "start_column", "end_line", "end_column")] + [(c, pa.bool_()) for c in ("is_local", "is_exported", "is_unresolved")])
_CALL = pa.struct([("file_path", pa.string()), ("callee", pa.string()), ("line", pa.int64()), ("column", pa.int64())])
_EXTEND = pa.struct([("file_path", pa.string()), ("child", pa.string()), ("parent", pa.string()), ("line", pa.int64()), ("column", pa.int64())])
_REQUIRE = pa.struct([("file_path", pa.string()), ("module_name", pa.string()), ("is_static", pa.bool_()), ("line", pa.int64()), ("column", pa.int64())])

SCHEMA = (
    "path string, content_hash string, size long, modified_at timestamp, language string, "
    "symbols array<struct<id:string,kind:string,name:string,qualified_name:string,file_path:string,signature:string,start_line:long,start_column:long,end_line:long,end_column:long,is_local:boolean,is_exported:boolean,is_unresolved:boolean>>, "
    "calls array<struct<file_path:string,callee:string,line:long,column:long>>, "
    "extends array<struct<file_path:string,child:string,parent:string,line:long,column:long>>, "
    "requires array<struct<file_path:string,module_name:string,is_static:boolean,line:long,column:long>>, error string"
)


def parse_source(path: str, source: str, adapters: dict[str, tuple[str, Callable[[str, str], Parsed]]] | None = None) -> tuple[str, Parsed, str]:
    """Language, what was found, and an error text; one bad file never fails a run, whatever its parser raises."""
    language, parse = adapter(path, adapters)
    try:
        return language, parse(path, source), ""
    except RecursionError:
        return language, Parsed(path), "nested too deeply"
    except Exception as e:  # noqa: BLE001
        return language, Parsed(path), f"{type(e).__name__}: {e}"


def parse_files(files: DataFrame) -> DataFrame:
    """files(path, text, content_hash, size, modified_at) -> one row a file, of SCHEMA.

    The only Python on the data path: Arrow batches in, nested rows out.
    """
    ship(files.sparkSession)
    adapters = dict(ADAPTERS)  # those registered here, for executors too
    names = [f.strip().split(" ")[0] for f in "path,content_hash,size,modified_at,language,symbols,calls,extends,requires,error".split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_source(p, t or "", adapters) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist())]
            rows = lambda xs, kind: pa.array([[dict(zip([f.name for f in kind], r)) if isinstance(r, tuple) else r for r in x] for x in xs], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("path", "content_hash", "size", "modified_at")),
                    pa.array([f[0] for f in found], pa.string()),
                    rows([f[1].symbols for f in found], _SYMBOL),
                    rows([f[1].calls for f in found], _CALL),
                    rows([f[1].extends for f in found], _EXTEND),
                    rows([f[1].requires for f in found], _REQUIRE),
                    pa.array([f[2] for f in found], pa.string()),
                ],
                names,
            )

    return files.select("path", "text", "content_hash", "size", "modified_at").mapInArrow(run, SCHEMA)
