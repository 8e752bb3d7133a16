"""A tolerant Lua parser.

It builds a small syntax tree and reads symbols, calls, inheritance and requires off it.
Broken code never raises: a token that fits nowhere is skipped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from codeloom.sources.parsers.ir import Parsed, symbol

_KEYWORDS = frozenset("and break do else elseif end false for function goto if in local nil not or repeat return then true until while".split())
_TOKEN = re.compile(
    r"""(?P<blank>\s+)|(?P<long>--\[(?P<ceq>=*)\[.*?(?:\](?P=ceq)\]|\Z))|(?P<comment>--[^\n]*)
    |(?P<lstring>\[(?P<eq>=*)\[.*?(?:\](?P=eq)\]|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
    |(?P<name>[^\W\d]\w*)|(?P<number>0[xX][0-9a-fA-F.]+(?:[pP][+-]?\d+)?|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<mark>\.\.\.|\.\.|::|==|~=|<=|>=|//|<<|>>|[-+*/%^\#&~|<>=(){}\[\];:,.])|(?P<other>.)""",
    re.S | re.X,
)
_NAMES = ("identifier", "dot", "method")
_BINARY = frozenset("+ - * / // % ^ .. < <= > >= == ~= & | ~ << >> and or".split())
_UNARY = frozenset(("not", "#", "-", "~"))
_BLOCK_END = frozenset(("end", "else", "elseif", "until"))


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None


class _Parser:
    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str, int, int]] = []
        at = 2 if source.startswith("#!") else 0
        if at:
            at = source.find("\n") if "\n" in source else len(source)
        for m in _TOKEN.finditer(source, at):
            kind = m.lastgroup if m.lastgroup not in ("ceq", "eq") else "lstring"
            if m.group("long") is not None or kind in ("blank", "comment"):
                continue
            if m.group("lstring") is not None:
                kind = "string"
            value = m.group()
            if kind == "name" and value in _KEYWORDS:
                kind = "keyword"
            self.tokens.append((kind or "other", value, m.start(), m.end()))
        self.tokens.append(("eof", "", len(source), len(source)))
        self.at = 0

    def value(self, ahead: int = 0) -> str:
        kind, value, _, _ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return "" if kind in ("string", "eof") else value

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][0]

    def start(self) -> int:
        return self.tokens[self.at][2]

    def stop(self) -> int:
        return self.tokens[self.at - 1][3] if self.at else 0

    def take(self, value: str | None = None) -> bool:
        if self.kind() == "eof" or value is not None and self.value() != value:
            return False
        self.at += 1
        return True

    def node(self, kind: str, start: int, children: list[Node]) -> Node:
        out = Node(kind, start, max(start, self.stop()), children)
        for c in children:
            c.parent = out
        return out

    def chunk(self) -> Node:
        children: list[Node] = []
        while self.kind() != "eof":
            children += self.block()
            if self.kind() != "eof":
                self.at += 1  # a stray end
        return self.node("chunk", 0, children)

    def block(self) -> list[Node]:
        out = []
        while self.kind() != "eof" and not (self.kind() == "keyword" and self.value() in _BLOCK_END):
            before = self.at
            found = self.statement()
            if found is not None:
                out.append(found)
            if self.at == before:
                self.at += 1
        return out

    def statement(self) -> Node | None:
        start, value = self.start(), self.value() if self.kind() in ("keyword", "mark") else ""
        if value == "function":
            self.at += 1
            return self.declared(start)
        if value == "local":
            self.at += 1
            if self.take("function"):
                return self.declared(start)
            return self.local(start)
        if value == "if":
            self.at += 1
            children = [self.expression()]
            self.take("then")
            children += self.block()
            while self.value() in ("elseif", "else") and self.kind() == "keyword":
                if self.value() == "elseif":
                    self.at += 1
                    children.append(self.expression())
                    self.take("then")
                else:
                    self.at += 1
                children += self.block()
            self.take("end")
            return self.node("if", start, children)
        if value == "while":
            self.at += 1
            children = [self.expression()]
            self.take("do")
            return self.closed("while", start, children)
        if value == "for":
            self.at += 1
            children = []
            while self.kind() == "name":
                children.append(self.name())
                if not self.take(","):
                    break
            if self.take("=") or self.take("in"):
                children += self.expressions()
            self.take("do")
            return self.closed("for", start, children)
        if value == "do":
            self.at += 1
            return self.closed("do", start, [])
        if value == "repeat":
            self.at += 1
            children = self.block()
            if self.take("until"):
                children.append(self.expression())
            return self.node("repeat", start, children)
        if value == "return":
            self.at += 1
            children = self.expressions() if self.begins_expression() else []
            self.take(";")
            return self.node("return", start, children)
        if value == "goto":
            self.at += 1
            self.take()
            return None
        if value == "::":
            self.at += 1
            self.take()
            self.take("::")
            return None
        if value == "break" or not self.begins_expression():
            self.take()
            return None
        targets = [self.suffixed()]
        while self.take(","):
            targets.append(self.suffixed())
        if self.take("="):
            listed = self.node("targets", targets[0].start, targets)
            values = self.expressions()
            return self.node("assignment", start, [listed, self.node("values", values[0].start if values else start, values)])
        return targets[0] if len(targets) == 1 else self.node("targets", start, targets)

    def closed(self, kind: str, start: int, children: list[Node]) -> Node:
        children += self.block()
        self.take("end")
        return self.node(kind, start, children)

    def local(self, start: int) -> Node:
        first = self.start()
        targets = []
        while self.kind() == "name":
            targets.append(self.name())
            if self.value() == "<" and self.value(2) == ">":
                self.at += 3
            if not self.take(","):
                break
        listed = self.node("targets", first, targets)
        if not self.take("="):
            return self.node("local", start, [listed])
        values = self.expressions()
        inner = self.node("assignment", first, [listed, self.node("values", values[0].start if values else first, values)])
        return self.node("local", start, [inner])

    def declared(self, start: int) -> Node:
        children: list[Node] = []
        if self.kind() == "name":
            name = self.name()
            while self.value() in (".", ":") and self.kind(1) == "name":
                kind = "dot" if self.value() == "." else "method"
                self.at += 1
                name = self.node(kind, name.start, [name, self.name()])
            children.append(name)
        return self.body("function_declaration", start, children)

    def body(self, kind: str, start: int, children: list[Node]) -> Node:
        if self.take("("):
            while self.kind() not in ("eof", "keyword") and self.value() != ")":
                self.at += 1
            self.take(")")
        return self.closed(kind, start, children)

    def name(self) -> Node:
        start = self.start()
        self.at += 1
        return self.node("identifier", start, [])

    def begins_expression(self) -> bool:
        kind, value = self.kind(), self.value()
        return kind in ("name", "number", "string") or value in ("(", "{", "...", "function", "nil", "true", "false") or value in _UNARY

    def expressions(self) -> list[Node]:
        out = []
        while self.begins_expression():
            out.append(self.expression())
            if not self.take(","):
                break
        return out

    def expression(self) -> Node:
        start = self.start()
        operands = []
        while True:
            while self.value() in _UNARY:
                self.at += 1
            operands.append(self.operand())
            if self.value() not in _BINARY or self.kind() not in ("mark", "keyword"):
                break
            self.at += 1
        if len(operands) == 1 and operands[0].start == start:
            return operands[0]
        return self.node("operation", start, operands)

    def operand(self) -> Node:
        start, kind, value = self.start(), self.kind(), self.value()
        if value == "function" and kind == "keyword":
            self.at += 1
            return self.body("function", start, [])
        if kind == "string":
            self.at += 1
            text = self.node("string", start, [])
            return text
        if value == "{":
            return self.table()
        if kind == "name" or value == "(":
            return self.suffixed()
        if kind == "number" or value in ("...", "nil", "true", "false"):
            self.at += 1
            return self.node("value", start, [])
        return Node("missing", start, start)

    def suffixed(self) -> Node:
        start = self.start()
        if self.take("("):
            inner = self.expression()
            self.take(")")
            out = self.node("parentheses", start, [inner])
        elif self.kind() == "name":
            out = self.name()
        else:
            return self.operand()
        while True:
            value = self.value()
            if value == "." and self.kind(1) == "name":
                self.at += 1
                out = self.node("dot", start, [out, self.name()])
            elif value == ":" and self.kind(1) == "name":
                self.at += 1
                out = self.node("method", start, [out, self.name()])
            elif value == "[":
                self.at += 1
                inner = self.expression()
                self.take("]")
                out = self.node("bracket", start, [out, inner])
            elif value == "(":
                first = self.start()
                self.at += 1
                args = self.expressions()
                self.take(")")
                out = self.node("call", start, [out, self.node("arguments", first, args)])
            elif value == "{":
                first = self.start()
                out = self.node("call", start, [out, self.node("arguments", first, [self.table()])])
            elif self.kind() == "string":
                first = self.start()
                self.at += 1
                text = self.node("string", first, [])
                out = self.node("call", start, [out, self.node("arguments", first, [text])])
            else:
                return out

    def table(self) -> Node:
        start = self.start()
        self.at += 1
        fields = []
        while self.kind() != "eof" and self.value() != "}":
            first, before = self.start(), self.at
            if self.take("["):
                key = self.expression()
                self.take("]")
                self.take("=")
                fields.append(self.node("field", first, [key, self.expression()]))
            elif self.kind() == "name" and self.value(1) == "=":
                key = self.name()
                self.at += 1
                fields.append(self.node("field", first, [key, self.expression()]))
            elif self.begins_expression():
                fields.append(self.node("field", first, [self.expression()]))
            if not (self.take(",") or self.take(";")) and self.at == before:
                self.at += 1
        self.take("}")
        return self.node("table", start, fields)


def _walk(node: Node) -> list[Node]:
    """The node and all below, parents first."""
    out, open_ = [], [node]
    while open_:
        x = open_.pop()
        out.append(x)
        open_ += reversed(x.children)
    return out


def unquoted(text: str) -> str:
    """A string literal without its quotes or long brackets; escapes stay as written."""
    if text[:1] in ("'", '"') and text.endswith(text[0]) and len(text) > 1:
        return text[1:-1]
    found = re.fullmatch(r"\[(=*)\[(.*)\]\1\]", text, re.S)
    return found.group(2) if found else text


def parse(path: str, source: str) -> Parsed:
    """Symbols, calls, extends and requires of one file."""
    root = _Parser(source).chunk()
    lines = re.split(r"\r\n|\n|\r", source)
    breaks = [0, *(m.end() for m in re.finditer("\n", source))]
    out = Parsed(path)

    def place(at: int) -> tuple[int, int]:
        """Line from 1, column from 0."""
        low, high = 0, len(breaks)
        while low + 1 < high:
            middle = (low + high) // 2
            low, high = (middle, high) if breaks[middle] <= at else (low, middle)
        return low + 1, at - breaks[low]

    def text(node: Node) -> str:
        return source[node.start : node.end]

    def first_name(node: Node) -> str | None:
        """The text of the first part, if it is a name: of a call, its callee."""
        head = node.children[0] if node.children else None
        return text(head) if head is not None and head.kind in _NAMES else None

    def arguments(node: Node) -> list[Node]:
        return next((c.children for c in node.children if c.kind == "arguments"), [])

    def index_parent(value: Node) -> str | None:
        """What setmetatable(_, {__index = name}) inherits from."""
        if first_name(value) != "setmetatable" or len(arguments(value)) < 2:
            return None
        for f in _walk(arguments(value)[1]):
            if f.kind == "field" and f.children and text(f.children[0]) == "__index":
                return text(f.children[1]) if len(f.children) > 1 and f.children[1].kind in _NAMES else None
        return None

    def add(node: Node, kind: str, name: str, local: bool) -> None:
        line, column = place(node.start)
        end_line, end_column = place(node.end)
        signature = lines[line - 1].strip() if line <= len(lines) else text(node).strip()
        out.symbols.append(symbol(path, kind, re.split("[.:]", name)[-1] if kind in ("function", "method") else name, name, line, column + 1, end_line, end_column, signature, local, not local))

    for node in _walk(root):
        line, column = place(node.start)
        if node.kind == "function_declaration" and node.children and node.children[0].kind in _NAMES:
            name = text(node.children[0])
            add(node, "method" if re.search("[.:]", name) else "function", name, text(node).startswith("local function"))
        elif node.kind == "call":
            callee = first_name(node)
            if callee is not None:
                out.calls.append((path, callee, line, column + 1))
            if callee == "require" and arguments(node):
                given = arguments(node)[0]
                static = given.kind == "string"
                module = unquoted(text(given)) if static else re.sub(r"\s+", " ", text(given).strip())
                out.requires.append((path, module, static, line, column + 1))
        elif node.kind in ("assignment", "local") and not (node.kind == "assignment" and node.parent is not None and node.parent.kind == "local"):
            inner = node if node.kind == "assignment" else next((c for c in node.children if c.kind == "assignment"), None)
            if inner is None or not inner.children[0].children or not inner.children[1].children:
                continue
            target, value = inner.children[0].children[0], inner.children[1].children[0]
            name, base = text(target), index_parent(value)
            made = first_name(value) == "class"
            if made or base is not None:
                add(node, "class", name, node.kind == "local")
            elif node.kind == "assignment" and node.parent is root and place(target.start)[1] == 0 and value.kind == "table":
                add(node, "table", name, False)
            if made:
                given = arguments(value)
                parent = text(given[1]) if len(given) > 1 and given[1].kind in _NAMES else None
            else:
                parent = base
            if parent is not None and parent != name:
                out.extends.append((path, name, parent, line, column + 1))
    out.symbols.sort(key=lambda s: (s["start_line"], s["start_column"]))
    return out
