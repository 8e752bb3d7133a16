"""Source lines and symbol names as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a step comes from, in the order of steps on one line.
SOURCE_RANK = {"input": 0, "entrypoint": 1, "top-method": 1, "branch": 2, "assignment": 3, "state": 4, "call": 5, "callee": 6, "return": 7}
#: Caps of the report.
ENTRYPOINTS, FLOWS, STEPS, LABEL, HEADER_LINES = 21, 5, 16, 140, 8
#: The characters that are cut off the ends of lines.
BLANKS = " \t\x0b\f\r\n\xa0\ufeff"
#: How lines begin that steer the flow and so are no steps; `end` as a whole word only.
CONTROL = ("if", "elseif", "else if", "for", "while", "switch", "case", "function", "async function", "}")
#: Words before an assigned name, and how names end that stand for state.
DECLARATORS, STORES = ("const", "let", "var", "local"), ("ById", "ByKey", "Map", "Set")
#: What stands around the condition of a branching line, from the end of its head on.
_AROUND = {"then": r"\s+(.+?)\s+then\b", "brackets": r"\s*\((.+)\)", "colon": r"\s+(.+):"}
#: Branching lines, the first that fits counts: kind, how the line can begin,
#: its head, and what is around the condition.
BRANCHES = (
    ("elseif", ("elseif",), "elseif", "then"),
    ("if", ("if",), "if", "then"),
    ("elseif", ("else", "}"), r"(?:\}\s*)?else\s+if", "brackets"),
    ("if", ("if",), "if", "brackets"),
    ("switch", ("switch",), "switch", "brackets"),
    ("case", ("case",), "case", "colon"),
)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """Trimmed, with one space for each run of blanks."""
    return F.regexp_replace(trim(text), r"\s+", " ")


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "[.:]"), -1)


def owner(qualified: Column) -> Column:
    """What stands before the last : or . of a name, if anything does."""
    return F.regexp_extract(qualified, r"(?s)^(.+)[:.][^:.]*$", 1)


def id_name(symbol_id: Column) -> Column:
    """The qualified name in a symbol id; the id itself if it has none."""
    return F.when(F.size(F.split(symbol_id, "#")) >= 3, F.split_part(symbol_id, F.lit("#"), F.lit(3))).otherwise(symbol_id)


def id_location(symbol_id: Column) -> Column:
    """path:line of a symbol id; the id itself if it is malformed."""
    line = F.regexp_extract(symbol_id, r"#(\d+):[^#]*$", 1)
    return F.when(line != "", F.concat(F.split_part(symbol_id, F.lit("#"), F.lit(1)), F.lit(":"), line)).otherwise(symbol_id)


def lines(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """(file_path, line, code): every line of every text, numbered from 1."""
    parts = F.split(F.col(text), r"\r?\n")
    return files.select(F.col(path).alias("file_path"), F.posexplode(parts).alias("n", "code")).select("file_path", (F.col("n") + 1).cast("long").alias("line"), "code")


def _begins(line: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [line.startswith(w) for w in words])


def whole_word(line: Column, word: str) -> Column:
    """line starts with a word that ends there."""
    return line.startswith(word) & ~F.substr(line, F.lit(len(word) + 1), F.lit(1)).rlike(r"\w")


def before(text: Column, mark: str) -> Column:
    """What stands before the first mark; all of it if there is none."""
    return F.substring_index(text, mark, 1)


def after(text: Column, mark: str) -> Column:
    """What follows the first mark; null if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark)))


def conditional(line: Column) -> Column:
    """The question of `question ? one : other`, without a return before it; else null."""
    asked = before(line, "?")
    return F.when((asked != "") & after(line, "?").contains(":"), trim(F.regexp_replace(asked, r"^return\s+", "")))


def branch(line: Column) -> Column:
    """struct(kind, condition) of a trimmed branching line, the first form that fits; else null.

    A form is looked for only in lines that begin like it.
    """
    found = [(kind, F.when(_begins(line, starts), F.nullif(F.regexp_extract(line, f"^{head}{_AROUND[around]}", 1), F.lit("")))) for kind, starts, head, around in BRANCHES]
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), trim(c).alias("condition"))) for kind, c in [*found, ("conditional", conditional(line))]])


def summary(code: Column) -> Column:
    """Trimmed, without one closing ; or , and cut to 140 characters."""
    bare = trim(code)
    return F.substring(F.when(bare.endswith(";") | bare.endswith(","), trim(F.substr(bare, F.lit(1), F.length(bare) - 1))).otherwise(bare), 1, LABEL)


def is_control(line: Column) -> Column:
    return _begins(line, CONTROL) | whole_word(line, "end")


def called(line: Column) -> Column:
    """What stands before the first bracket, if that could be a name; else null."""
    name = F.rtrim(before(line, "("))
    return F.when(line.contains("(") & name.rlike(r"^[\w$.:]+$"), name)


def is_method(name: Column) -> Column:
    """A called name of the kind x.name or x:name; false for null."""
    return F.coalesce(name.rlike(r"^[\w$.]+[:.][\w$]+$"), F.lit(False))


def target(left: Column) -> Column:
    """What is assigned to, of what stands before the =; null if that is no target.

    A target is one word of name characters, brackets and quotes, after an optional
    declarator and before an optional type. A declarator's name alone is a target too.
    """
    return F.nullif(F.regexp_extract(left, rf"""^(?:(?:{'|'.join(DECLARATORS)})\s*)?([\w$.\[\]'"]+)\s*(?::[^({{]+)?$""", 1), F.lit(""))


def is_state(assigned: Column) -> Column:
    """The target belongs to an object, or its first word is named like a store."""
    word = F.regexp_extract(assigned, r"^\w+", 0)
    stores = reduce(Column.__or__, [word.endswith(s) & (F.length(word) > len(s)) for s in STORES])
    return _begins(assigned, ("self.", "this.")) | stores


def parameters(header: Column) -> Column:
    """Names in the first brackets of a header, without types and defaults."""
    inner = after(header, "(")
    closed = F.when(inner.contains(")"), before(inner, ")")).otherwise("")
    names = F.transform(F.split(F.coalesce(closed, F.lit("")), ","), lambda p: trim(F.regexp_extract(trim(p), "^[^?:=]*", 0)))
    return F.filter(names, lambda p: p != "")
