"""A tolerant JavaScript / TypeScript scanner.

There is no compiler here: the source is cut into tokens (with regular expressions,
templates and JSX told apart by what stands before), brackets are matched, and
declarations, calls, imports and inheritance are recognised by the tokens around them.
Broken code never raises.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from codeloom.sources.parsers.ir import Parsed, symbol

#: Words after which an opening parenthesis is no call, and a slash begins a pattern.
_WORDS = frozenset("return typeof instanceof in of new delete void throw case do else yield await if for while switch with catch function default extends as is keyof satisfies".split())
_MODIFIERS = frozenset("export default declare abstract async public private protected static readonly override accessor".split())
_MARK = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\?\?|==|!=|<=|>=|&&|\|\||\+\+|--|\*\*|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~!<>=?:;,.(){}\[\]@#]")
_NAME = re.compile(r"#?[^\W\d][\w$]*|#?\$[\w$]*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
#: Stands between code in templates or JSX and what is around it.
_APART = "\0"
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Token:
    kind: str  # name, number, string, template, regex, mark, jsx
    value: str
    start: int
    end: int
    match: int = -1
    line_before: bool = False


class _Scanner:
    """Tokens of a source; what templates and JSX hold in braces is scanned like the rest."""

    def __init__(self, source: str, jsx: bool) -> None:
        self.s, self.jsx = source, jsx
        self.tokens: list[Token] = []
        self.at = source.find("\n") if source.startswith("#!") and "\n" in source else 0
        self.broke = False

    def put(self, kind: str, start: int, end: int) -> None:
        self.tokens.append(Token(kind, self.s[start:end], start, end, -1, self.broke))
        self.broke = False
        self.at = end

    def operand_next(self) -> bool:
        """Whether an operand, not an operator, may follow the last token."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "name":
            return t.value in _WORDS
        if t.kind == "mark":
            return t.value not in (")", "]", "}", "++", "--")
        return False

    def run(self, until: str = "") -> None:
        """Scan to the end, or to the brace that closes the one before."""
        s, depth = self.s, 0
        while self.at < len(s):
            c = s[self.at]
            if c.isspace() or c == "\ufeff":
                self.broke |= c == "\n"
                self.at += 1
            elif s.startswith("//", self.at):
                end = s.find("\n", self.at)
                self.at = len(s) if end < 0 else end
            elif s.startswith("/*", self.at):
                end = s.find("*/", self.at + 2)
                self.broke |= "\n" in s[self.at : end if end >= 0 else len(s)]
                self.at = len(s) if end < 0 else end + 2
            elif c in "'\"":
                self.quoted(c)
            elif c == "`":
                self.template()
            elif (m := _NAME.match(s, self.at)) is not None:
                self.put("name", self.at, m.end())
            elif c.isdigit() or c == "." and s[self.at + 1 : self.at + 2].isdigit():
                self.put("number", self.at, max(self.at + 1, m.end() if (m := _NUMBER.match(s, self.at)) else 0))
            elif c == "/" and (self.operand_next() or self.after_brace()) and (m := _REGEX.match(s, self.at)) is not None:
                self.put("regex", self.at, m.end())
            elif c == "<" and self.jsx and self.operand_next() and self.element_begins():
                self.element()
            elif (m := _MARK.match(s, self.at)) is not None:
                if c == "}" and until and depth == 0:
                    return
                depth += (c == "{") - (c == "}")
                self.put("mark", self.at, m.end())
            else:
                self.at += 1

    def after_brace(self) -> bool:
        return bool(self.tokens) and self.tokens[-1].value == "}" and self.broke

    def quoted(self, quote: str) -> None:
        at = self.at + 1
        while at < len(self.s) and self.s[at] not in (quote, "\n"):
            at += 2 if self.s[at] == "\\" else 1
        self.put("string", self.at, min(len(self.s), at + 1))

    def template(self) -> None:
        """One token for a template; the expressions in it come after, each in braces."""
        s, start, at = self.s, self.at, self.at + 1
        holes = []
        while at < len(s) and s[at] != "`":
            if s[at] == "\\":
                at += 2
            elif s.startswith("${", at):
                inner = _Scanner(s, self.jsx)
                inner.at = at + 2
                inner.run("}")
                holes.append((at + 1, inner.tokens, inner.at))
                at = inner.at + 1
            else:
                at += 1
        self.put("template" if holes else "string", start, min(len(s), at + 1))
        end = self.at
        for first, tokens, last in holes:
            self.tokens += [Token("mark", _APART, first, first), *tokens, Token("mark", _APART, last, last)]
        if holes:
            self.tokens.append(Token("hole", "", end, end))

    def element_begins(self) -> bool:
        rest = self.s[self.at + 1 : self.at + 2]
        if rest == ">":
            return True
        m = _JSX_NAME.match(self.s, self.at + 1)
        if m is None:
            return False
        after = self.s[m.end() : m.end() + 24].lstrip()
        # <T,> and <T extends ...> begin type parameters of an arrow.
        return not after.startswith(",") and not re.match(r"extends\b", after)

    def element(self) -> None:
        """JSX: only what stands in braces is code."""
        s, start = self.s, self.at
        self.tokens.append(Token("mark", _APART, start, start))
        depth = 0
        while self.at < len(s):
            if s.startswith("</", self.at):
                end = s.find(">", self.at)
                self.at = len(s) if end < 0 else end + 1
                depth -= 1
            elif s[self.at] == "<":
                depth += 1
                self.at += 1
                if self.tag():
                    depth -= 1
            elif s[self.at] == "{":
                self.braced()
            else:
                self.at += 1
            if depth <= 0:
                break
        self.tokens.append(Token("jsx", "", start, self.at))

    def tag(self) -> bool:
        """After the opening angle up to the closing one; whether the element ends there."""
        s = self.s
        while self.at < len(s):
            c = s[self.at]
            if c == ">":
                self.at += 1
                return s[self.at - 2] == "/"
            if c in "'\"":
                end = s.find(c, self.at + 1)
                self.at = len(s) if end < 0 else end + 1
            elif c == "{":
                self.braced()
            else:
                self.at += 1
        return True

    def braced(self) -> None:
        inner = _Scanner(self.s, self.jsx)
        inner.at = self.at + 1
        inner.run("}")
        self.tokens += [*inner.tokens, Token("mark", _APART, inner.at, inner.at)]
        self.at = inner.at + 1


def _matched(tokens: list[Token]) -> None:
    open_: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.value in "([{":
            open_.append(i)
        elif t.value in _PAIRS:
            for depth in range(len(open_) - 1, max(-1, len(open_) - 4), -1):
                if tokens[open_[depth]].value == _PAIRS[t.value]:
                    j = open_[depth]
                    del open_[depth:]
                    t.match, tokens[j].match = j, i
                    break


def _static(text: str) -> str:
    """The value of a string literal."""
    simple = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
    body = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]

    def one(m: re.Match) -> str:
        x = m.group(1)
        if x[0] in "xu" and len(x) > 1:
            return chr(int(x[1:].strip("{}"), 16))
        return simple.get(x, x)

    return re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", one, body, flags=re.S)


def _callee(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"^this\.", "", text.strip()))


class _File:
    def __init__(self, path: str, source: str) -> None:
        self.path, self.s = path, source
        scanner = _Scanner(source, not path.endswith(".ts"))
        scanner.run()
        self.t = scanner.tokens
        _matched(self.t)
        self.breaks = [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", source))]
        self.out = Parsed(path)
        #: Spans of tokens that are types only, and class bodies as (open, close, name).
        self.types: list[tuple[int, int]] = []
        self.classes: list[tuple[int, int, str]] = []
        self.exported: set[str] = set()

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.breaks, at)
        return line, at - self.breaks[line - 1] + 1

    def v(self, i: int) -> str:
        """The value of a mark or name; nothing for literals and beyond the ends."""
        return self.t[i].value if 0 <= i < len(self.t) and self.t[i].kind in ("mark", "name") else ""

    def k(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def text(self, i: int, j: int) -> str:
        """The source of tokens i up to and without j."""
        return self.s[self.t[i].start : self.t[j - 1].end] if j > i else ""

    def first_modifier(self, i: int) -> int:
        """The place where a declaration at i begins with its modifiers and decorators."""
        while i > 0:
            if self.v(i - 1) in _MODIFIERS and self.v(i - 2) not in (".", "?."):
                i -= 1
            elif (d := self.decorator(i - 1)) is not None:
                i = d
            else:
                return i
        return i

    def decorator(self, i: int) -> int | None:
        """Where a decorator begins that ends at i."""
        if self.v(i) == ")" and self.t[i].match > 0:
            i = self.t[i].match - 1
        while self.k(i) == "name" and self.v(i - 1) == ".":
            i -= 2
        return i - 1 if self.k(i) == "name" and self.v(i - 1) == "@" else None

    def past_type(self, i: int, stops: str) -> int:
        """The place of the first of stops outside brackets from i on."""
        angle = 0
        while i < len(self.t):
            value = self.v(i)
            if angle <= 0 and value in stops.split():
                if not (value == "{" and self.v(i - 1) in (":", "|", "&", "=>", "<", ",", "is", "keyof", "extends")):
                    return i
            if value == ";" and angle <= 0:
                return i
            if value in ("(", "[", "{") and self.t[i].match > i:
                i = self.t[i].match
            elif value in (")", "]", "}"):
                return i
            elif value == "<":
                angle += 1
            elif value in (">", ">>", ">>>"):
                angle -= len(value)
            i += 1
        return i

    def past_angles(self, i: int) -> int:
        """Behind type parameters that open at i, or i."""
        if self.v(i) != "<":
            return i
        angle = 0
        while i < len(self.t):
            value = self.v(i)
            if value in ("(", "[", "{") and self.t[i].match > i:
                i = self.t[i].match
            angle += (value == "<") - (len(value) if value in (">", ">>", ">>>") else 0)
            i += 1
            if angle <= 0:
                return i
        return i

    def add(self, kind: str, name: str, qualified: str, first: int, last: int, exported: bool) -> None:
        start, end = self.t[first].start, self.t[min(last, len(self.t) - 1)].end
        line, column = self.place(start)
        end_line, end_column = self.place(end)
        signature = re.split(r"\r\n|\n|\r", self.s[start:end])[0].strip()
        self.out.symbols.append(symbol(self.path, kind, name, qualified, line, column, end_line, end_column, signature, not exported, exported))

    def is_exported(self, first: int, at: int, name: str) -> bool:
        return name in self.exported or any(self.v(i) == "export" for i in range(first, at))

    def parse(self) -> Parsed:
        self.read_exports()
        self.read_types()
        self.read_classes()
        self.read_functions()
        self.read_methods()
        self.read_calls()
        self.out.symbols.sort(key=lambda s: (s["start_line"], s["start_column"]))
        return self.out

    def top_level(self) -> list[int]:
        """Places outside all brackets."""
        out, i = [], 0
        while i < len(self.t):
            out.append(i)
            i = self.t[i].match if self.v(i) in ("(", "[", "{") and self.t[i].match > i else i + 1
        return out

    def read_exports(self) -> None:
        imports, exports = [], []
        for i in self.top_level():
            starts = self.v(i - 1) in ("", ";", "}") or self.t[i].line_before
            if self.v(i) == "import" and starts and self.v(i + 1) not in ("(", "."):
                source = i + 1
                while source < len(self.t) and self.k(source) != "string" and self.v(source) not in (";", "="):
                    source = self.t[source].match if self.v(source) == "{" and self.t[source].match > 0 else source + 1
                type_only = self.v(i + 1) == "type" and self.v(i + 2) not in ("from", ",", "=") or self.v(i + 1) == "type" and self.v(i + 2) == "from" and self.v(i + 3) == "from"
                if self.k(source) == "string" and not type_only:
                    imports.append((i, source))
            elif self.v(i) == "export" and starts:
                j = i + 1
                type_only = self.v(j) == "type" and self.v(j + 1) in ("{", "*")
                j += type_only
                if self.v(j) == "{" and self.t[j].match > 0:
                    end = self.t[j].match
                    if self.v(end + 1) == "from" and self.k(end + 2) == "string":
                        if not type_only:
                            exports.append((i, end + 2))
                    else:
                        self.exported |= self.exported_names(j + 1, end)
                elif self.v(j) == "*":
                    while j < len(self.t) and self.k(j) != "string" and self.v(j) != ";":
                        j += 1
                    if self.k(j) == "string" and not type_only:
                        exports.append((i, j))
                elif self.v(j) == "default" and self.k(j + 1) == "name" and self.v(j + 2) in ("", ";") or self.v(j) == "default" and j + 2 < len(self.t) and self.k(j + 1) == "name" and self.t[j + 2].line_before:
                    if self.v(j + 1) not in ("class", "function", "async", "abstract"):
                        self.exported.add(self.v(j + 1))
        for i, source in imports + exports:
            line, column = self.place(self.t[i].start)
            self.out.requires.append((self.path, _static(self.t[source].value), True, line, column))

    def exported_names(self, i: int, end: int) -> set[str]:
        """Names under which an export list gives out; `x as default` gives out x."""
        out = set()
        while i < end:
            j = i
            while j < end and self.v(j) != ",":
                j += 1
            names = [self.v(x) for x in range(i, j)]
            if names and names[0] == "type" and len(names) > 1 and names[1] != "as":
                names = names[1:]
            if names:
                out.add(names[0] if names[-1] == "default" else names[-1])
            i = j + 1
        return out

    def read_types(self) -> None:
        for i in range(len(self.t)):
            if self.v(i) == "interface" and self.k(i + 1) == "name" and self.v(i - 1) != ".":
                body = self.past_type(i + 2, "{")
                if self.v(body) == "{":
                    self.types.append((i, max(body, self.t[body].match)))
            elif self.v(i) == "type" and self.k(i + 1) == "name" and self.v(i + 2) in ("=", "<") and self.v(i - 1) != ".":
                at = self.past_angles(i + 2)
                if self.v(at) == "=":
                    end = at + 1
                    while end < len(self.t):
                        end = self.t[end].match + 1 if self.v(end) in ("(", "[", "{") and self.t[end].match > end else end + 1
                        joins = self.v(end) in ("|", "&", "=>", "extends", "?", ":", "[", "<", ">", ".", ",") or self.v(end - 1) in ("|", "&", "=>", "extends", "?", ":", "=", "keyof", "typeof", ".", ",", "<")
                        if end >= len(self.t) or self.v(end) in (";", "}") or self.t[end].line_before and not joins:
                            break
                    self.types.append((i, end - 1))
        self.types.sort()

    def in_type(self, i: int) -> bool:
        at = bisect_right(self.types, (i, 1 << 60)) - 1
        return at >= 0 and self.types[at][1] >= i

    def read_classes(self) -> None:
        for i in range(len(self.t)):
            if self.v(i) != "class" or self.v(i - 1) in (".", "?.") or self.v(i + 1) in (":", ",", "=", ")", "("):
                continue
            named = self.k(i + 1) == "name" and self.v(i + 1) not in ("extends", "implements")
            name = self.v(i + 1) if named else "default"
            first = self.first_modifier(i)
            before = self.v(first - 1)
            declared = any(self.v(x) == "export" for x in range(first, i)) or (named and (before in ("", ";", "{", "}", ")") or self.t[first].line_before and before not in ("=", "(", ",", "return", ":", "?", "=>", "&&", "||", "??", "[", "new")))
            at = self.past_angles(i + 1 + named)
            parent = None
            if self.v(at) == "extends":
                begin = at + 1
                at = begin
                while at < len(self.t) and self.v(at) not in ("{", "implements", "<"):
                    at = self.t[at].match + 1 if self.v(at) in ("(", "[") and self.t[at].match > at else at + 1
                parent = _callee(self.text(begin, at))
                at = self.past_angles(at)
            if self.v(at) == "implements":
                self.types.append((at, self.past_type(at + 1, "{") - 1))
                at = self.past_type(at + 1, "{")
            if self.v(at) != "{" or self.t[at].match < 0:
                continue
            self.classes.append((at, self.t[at].match, name if declared else ""))
            if declared:
                self.add("class", name, name, first, self.t[at].match, self.is_exported(first, i, name))
                if named and parent:
                    line, column = self.place(self.t[first].start)
                    self.out.extends.append((self.path, name, parent, line, column))
        self.types.sort()

    def owner(self, i: int) -> tuple[int, int, str] | None:
        """The nearest class declaration around i."""
        around = [c for c in self.classes if c[0] < i < c[1] and c[2]]
        return max(around, default=None)

    def after_parameters(self, i: int) -> int:
        """Behind a parameter list that opens at i and a return type: a body or an end."""
        end = self.t[i].match
        if end < 0:
            return i
        return self.past_type(end + 2, "{ => ; , )") if self.v(end + 1) == ":" else end + 1

    def read_functions(self) -> None:
        for i in range(len(self.t)):
            if self.v(i) != "function" or self.v(i - 1) in (".", "?.") or self.in_type(i):
                continue
            first = self.first_modifier(i)
            before = self.v(first - 1)
            at = i + 1 + (self.v(i + 1) == "*")
            named = self.k(at) == "name"
            exported = any(self.v(x) == "export" for x in range(first, i))
            statement = exported or named and (before in ("", ";", "{", "}", ")", "else", "do") or self.t[first].line_before and before not in ("=", "(", ",", "return", ":", "?", "=>", "&&", "||", "??", "[", "new", "!", "+", "void", "await", "typeof"))
            opens = self.past_angles(at + named)
            if not statement or self.v(opens) != "(":
                continue
            name = self.v(at) if named else "default"
            body = self.after_parameters(opens)
            last = self.t[body].match if self.v(body) == "{" and self.t[body].match > 0 else body if self.v(body) == ";" else body - 1
            self.add("function", name, name, first, last, self.is_exported(first, i, name))
        for i in range(len(self.t)):
            if self.v(i) in ("const", "let", "var") and self.v(i - 1) not in (".", "?.") and self.k(i + 1) in ("name", "mark") and not self.in_type(i):
                self.read_variables(i)

    def read_variables(self, i: int) -> None:
        """Declarations of one statement whose value is a function or an arrow."""
        first = self.first_modifier(i)
        found, at = [], i + 1
        while at < len(self.t):
            name = self.v(at) if self.k(at) == "name" else ""
            if self.v(at) in ("{", "[") and self.t[at].match > at:
                at = self.t[at].match
            at += 1
            if self.v(at) == "!":
                at += 1
            if self.v(at) == ":":
                at = self.past_type(at + 1, "= , ; of in")
            if self.v(at) != "=":
                if self.v(at) == ",":
                    at += 1
                    continue
                break
            value = at + 1
            end = self.expression_end(value)
            if name and self.is_function(value, end):
                found.append(name)
            at = end
            if self.v(at) != ",":
                break
            at += 1
        if not found:
            return
        last = at if self.v(at) == ";" else at - 1
        loose = self.v(i - 1) == "(" and self.v(i - 2) in ("for", "await")
        for name in found:
            if not loose:
                self.add("function", name, name, first, last, self.is_exported(first, i, name))

    def expression_end(self, i: int) -> int:
        """The place behind an expression that begins at i: a comma, an end, or a new line."""
        at = i
        while at < len(self.t):
            value = self.v(at)
            if value in (",", ";", ")", "]", "}"):
                return at
            if at > i and self.t[at].line_before and not self.joined(at):
                return at
            if value == "<" and self.v(at - 1) in ("=", "async") :
                at = self.past_angles(at)
                continue
            at = self.t[at].match + 1 if value in ("(", "[", "{") and self.t[at].match > at else at + 1
        return at

    def joined(self, at: int) -> bool:
        """Whether a new line before at doesn't end the expression."""
        before, here = self.v(at - 1), self.v(at)
        if self.k(at - 1) == "mark" and before not in (")", "]", "}", "++", "--", ";"):
            return True
        if before in _WORDS or self.k(at) == "mark" and here not in ("{", "++", "--", "@", "!", "~", "#"):
            return True
        return here in ("in", "of", "instanceof", "as", "satisfies")

    def is_function(self, i: int, end: int) -> bool:
        at = i + (self.v(i) == "async" and not self.v(i + 1) == "=>")
        if self.v(at) == "function":
            body = self.past_angles(at + 1 + (self.v(at + 1) == "*"))
            body = self.past_angles(body + 1) if self.k(body) == "name" else body
            body = self.after_parameters(body) if self.v(body) == "(" else body
            return self.v(body) == "{" and self.t[body].match + 1 >= end
        at = self.past_angles(at)
        if self.k(at) == "name" and self.v(at + 1) == "=>":
            return True
        return self.v(at) == "(" and self.v(self.after_parameters(at)) == "=>"

    def read_methods(self) -> None:
        """Names before parameter lists, in class bodies and object literals in classes."""
        self.method_opens: set[int] = set()
        bodies = {c[0]: c for c in self.classes}
        inside: list[int] = []
        for i, token in enumerate(self.t):
            while inside and self.t[inside[-1]].match < i:
                inside.pop()
            if token.kind == "mark" and token.value in ("{", "(", "[") and token.match > i:
                holder = inside[-1] if inside else -1
                inside.append(i)
                if token.value != "(" or holder < 0 or self.v(holder) != "{":
                    continue
                in_class = holder in bodies
                name_at = i - 1
                if self.v(name_at) in (">", ">>"):
                    back = self.angle_back(name_at)
                    name_at = back - 1 if back >= 0 else name_at
                optional = in_class and self.v(name_at) in ("?", "!")
                name_at -= optional
                if self.v(name_at) == "]" and self.t[name_at].match >= 0:
                    name_first = self.t[name_at].match
                elif self.k(name_at) in ("name", "string", "number"):
                    name_first = name_at
                else:
                    continue
                first = name_first
                accessor = False
                while self.v(first - 1) in _MODIFIERS or self.v(first - 1) in ("*", "get", "set"):
                    if self.v(first - 1) in ("get", "set"):
                        accessor = True
                    first -= 1
                first = self.first_modifier(first) if in_class else first
                before = self.v(first - 1)
                body = self.after_parameters(i)
                if in_class:
                    # A member begins after the body's brace, an end, another's body, or on a new line.
                    if not (first - 1 == holder or before in (";", "}") or self.t[first].line_before) or before in ("=", "=>", ":", "?", "+", "&&", "||", "(", ",", "."):
                        continue
                    if self.v(body) != "{" and not (self.v(body) in (";", "}") or body >= len(self.t) or self.t[body].line_before):
                        continue
                elif not (self.v(body) == "{" and (first - 1 == holder or before == ",") and self.v(name_at) not in ("if", "for", "while", "switch", "catch", "with", "function") and (before == "," or not self.t[body].line_before)):
                    continue
                self.method_opens.add(i)
                name = self.text(name_first, name_at + 1)
                owner = self.owner(i)
                if owner is None or accessor or in_class and name in ("constructor",):
                    continue
                last = self.t[body].match if self.v(body) == "{" and self.t[body].match > 0 else body if self.v(body) == ";" else body - 1
                head = next((s for s in self.out.symbols if s["kind"] == "class" and s["name"] == owner[2]), None)
                exported = owner[2] in self.exported or bool(head and head["is_exported"])
                self.add("method", name, f"{owner[2]}.{name}", first, last, exported)

    def angle_back(self, i: int) -> int:
        """Where the angle bracket opens that closes at i, if only a type stands between."""
        depth, at = 0, i
        while at >= 0 and i - at < 200:
            value = self.v(at)
            if value in (")", "]", "}") and self.t[at].match >= 0:
                at = self.t[at].match
            elif value in (">", ">>", ">>>"):
                depth += len(value)
            elif value == "<":
                depth -= 1
                if depth == 0:
                    return at
            elif value in (";", "(", "{", "&&", "||", "=", "==", "===", "+", "-"):
                return -1
            at -= 1
        return -1

    def chain_start(self, i: int) -> int:
        """Where the postfix expression begins that ends at i; -1 if there is none."""
        while i >= 0:
            value, kind = self.v(i), self.k(i)
            if value in (")", "]") and self.t[i].match >= 0:
                at = self.t[i].match
                before = at - 1
                if self.v(before) in (">", ">>") and (back := self.angle_back(before)) > 0 and self.k(back - 1) == "name":
                    before = back - 1
                if self.ends_operand(before) and not (value == ")" and self.v(before) in _WORDS):
                    i = before
                    continue
                start = at
            elif value == "!" and self.ends_operand(i - 1) and not self.t[i].line_before:
                i -= 1
                continue
            elif kind == "hole":
                depth = i
                while depth >= 0 and self.k(depth) != "template":
                    depth -= 1
                start = depth
                if self.ends_operand(depth - 1):
                    i = depth - 1
                    continue
            elif kind in ("name", "string", "number", "regex", "jsx"):
                if kind == "name" and value in _WORDS and self.v(i - 1) not in (".", "?."):
                    return -1
                start = i
                if kind == "string" and self.s[self.t[i].start] == "`" and self.ends_operand(i - 1):
                    i -= 1
                    continue
            else:
                return -1
            if self.v(start - 1) in (".", "?."):
                i = start - 2
                continue
            return start
        return -1

    def ends_operand(self, i: int) -> bool:
        kind, value = self.k(i), self.v(i)
        return kind in ("string", "jsx", "hole") or kind == "name" and (value not in _WORDS or self.v(i - 1) in (".", "?.")) or value in (")", "]")

    def read_calls(self) -> None:
        calls, news = [], []
        headers = {"if", "for", "while", "switch", "catch", "with"}
        for i, token in enumerate(self.t):
            if token.value != "(" or token.kind != "mark" or i in self.method_opens or self.in_type(i):
                continue
            end = i - 1
            if self.v(end) == "?.":
                end -= 1
            if self.v(end) in (">", ">>") and (back := self.angle_back(end)) > 0 and self.ends_operand(back - 1):
                end = back - 1
            if not self.ends_operand(end) or end < 0:
                continue
            if self.v(end) in headers and self.v(end - 1) not in (".", "?.") or self.v(end) == "await" and self.v(end - 1) == "for":
                continue
            if self.v(end) == ")" and self.v(self.t[end].match - 1) in headers and self.v(self.t[end].match - 2) not in (".", "?."):
                continue
            if self.v(end) == "async" and self.v(end - 1) != "." and token.match >= 0 and self.v(self.after_parameters(i)) == "=>":
                continue
            if self.k(end) == "name" and self.v(end - 1) in ("function", "*") and (self.v(end - 1) == "function" or self.v(end - 2) == "function"):
                continue
            if self.k(end) == "name" and self.v(end) == "constructor" and any(c[0] < i < c[1] for c in self.classes) and self.v(end - 1) not in (".", "?."):
                continue
            start = self.chain_start(end)
            if start < 0:
                continue
            if self.v(start - 1) == "new":
                # The first list after `new` is the constructor's; later ones are calls.
                first_open = self.new_list(start, i)
                if first_open == i:
                    news.append((start - 1, i, self.text(start, end + 1), token.match))
                    continue
                start -= 1
            calls.append((start, i, self.text(start, end + 1), token.match))
        for i, token in enumerate(self.t):  # `new X` without a list
            if token.value == "new" and token.kind == "name" and self.v(i - 1) not in (".", "?.") and self.k(i + 1) == "name":
                at = i + 1
                while self.v(at + 1) == "." and self.k(at + 2) == "name":
                    at += 2
                after = self.past_angles(at + 1) if self.v(at + 1) == "<" else at + 1
                if self.v(after) != "(" and self.v(at + 1) not in ("[", ":", "?.") and not self.in_type(i):
                    news.append((i, at + 1, self.text(i + 1, at + 1), -1))
        order = lambda c: (self.t[c[0]].start, -c[1])
        for group in (sorted(calls, key=order), sorted(news, key=order)):
            for start, opens, text, close in group:
                callee = _callee(text)
                line, column = self.place(self.t[start].start)
                if callee:
                    self.out.calls.append((self.path, callee, line, column))
                if group and callee in ("require", "import") and self.v(start) != "new" and close > opens + 1:
                    end = opens + 1
                    while end < close and self.v(end) != ",":
                        end = self.t[end].match + 1 if self.v(end) in ("(", "[", "{") and self.t[end].match > end else end + 1
                    argument = self.text(opens + 1, end)
                    static = end == opens + 2 and self.k(opens + 1) == "string"
                    module = _static(argument) if static else re.sub(r"\s+", " ", argument.strip())
                    self.out.requires.append((self.path, module, static, line, column))

    def new_list(self, start: int, i: int) -> int:
        """The first parenthesis of the chain from start that isn't a part of its operand."""
        at = start
        if self.v(at) == "(" and self.t[at].match >= 0:
            at = self.t[at].match
        at += 1
        while at < i:
            if self.v(at) == "(":
                return at
            at = self.t[at].match + 1 if self.v(at) == "[" and self.t[at].match > at else at + 1
        return i


def parse(path: str, source: str) -> Parsed:
    """Symbols, calls, extends and requires of one file."""
    return _File(path, source).parse()
