"""TOML: tables, pairs and values; what isn't one of them becomes an ERROR up to the end of its line."""

from __future__ import annotations

import re

from .base import Node, inner

_SPACE = re.compile(r"[ \t]+")
_NEWLINE = re.compile(r"[ \t]*\r?\n")
_COMMENT = re.compile(r"#[^\n\r]*")
_BARE = re.compile(r"[A-Za-z0-9_-]+")
_STRING = re.compile(r'"""(?:[^\\]|\\[\s\S])*?"{3,5}(?!")|\'\'\'[\s\S]*?\'{3,5}(?!\')|"(?:[^"\\\n]|\\[^\n])*"|\'[^\'\n]*\'')
_DATE = r"\d{4}-\d\d-\d\d"
_TIME = r"\d\d:\d\d:\d\d(?:\.\d+)?"
_VALUES = [
    ("offset_date_time", re.compile(rf"{_DATE}[Tt ]{_TIME}(?:[Zz]|[+-]\d\d:\d\d)")), ("local_date_time", re.compile(rf"{_DATE}[Tt ]{_TIME}")), ("local_date", re.compile(_DATE)), ("local_time", re.compile(_TIME)),
    ("float", re.compile(r"[+-]?(?:inf|nan|\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?|[eE][+-]?\d[\d_]*))")), ("integer", re.compile(r"0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|[+-]?\d[\d_]*")), ("boolean", re.compile("true|false")),
]
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[^\n]|\r?\n)")


class _Parser:
    def __init__(self, s: str):
        self.s, self.at = s, 0

    def eat(self, text: str) -> Node | None:
        if not self.s.startswith(text, self.at):
            return None
        self.at += len(text)
        return Node(text, self.at - len(text), self.at, named=False)

    def need(self, text: str, kids: list[Node]) -> None:
        kids.append(self.eat(text) or Node(text, self.at, self.at, named=False, missing=True))

    def space(self) -> None:
        if m := _SPACE.match(self.s, self.at):
            self.at = m.end()

    def blank(self, kids: list[Node]) -> None:
        """Spaces, line ends and comments."""
        while True:
            self.space()
            if m := _COMMENT.match(self.s, self.at):
                kids.append(Node("comment", m.start(), m.end()))
                self.at = m.end()
            elif m := _NEWLINE.match(self.s, self.at):
                self.at = m.end()
            elif self.s.startswith("\r", self.at):
                self.at += 1
            else:
                return

    def string(self) -> Node | None:
        m = _STRING.match(self.s, self.at)
        if m is None:
            return None
        self.at = m.end()
        kids = [Node("escape_sequence", e.start(), e.end()) for e in _ESCAPE.finditer(self.s, m.start() + 1, m.end() - 1)] if m[0][0] == '"' else []
        return Node("string", m.start(), m.end(), kids)

    def key(self) -> Node | None:
        left = None
        while True:
            if m := _BARE.match(self.s, self.at):
                self.at = m.end()
                part = Node("bare_key", m.start(), m.end())
            elif (part := self.string()) is not None:
                part.kind = "quoted_key"
            else:
                return left
            left = part if left is None else inner("dotted_key", [left, dot, part])
            here = self.at
            self.space()
            dot = self.eat(".")
            if dot is None:
                self.at = here
                return left
            self.space()

    def value(self) -> Node | None:
        """A value; arrays and inline tables that are open stand on a stack, so depth doesn't matter."""
        opened: list[list[Node]] = []
        pairs: list[list[Node]] = []  # of inline tables: what stands before the value
        while True:
            node: Node | None = None
            if self.s[self.at : self.at + 1] in ("[", "{"):
                opened.append([self.eat(self.s[self.at])])
            else:
                node = self.string()
                for kind, r in _VALUES if node is None else ():
                    if m := r.match(self.s, self.at):
                        node = Node(kind, m.start(), m.end())
                        self.at = m.end()
                        break
                if node is None:
                    node = Node("string", self.at, self.at, missing=True)
                if not opened:
                    return node
            while opened:
                own = opened[-1]
                array = own[0].kind == "["
                if node is not None:
                    own.append(node if array else inner("pair", [*pairs.pop(), node]))
                    node = None
                self.blank(own)
                if (comma := self.eat(",")) is not None:
                    own.append(comma)
                    self.blank(own)
                close = "]" if array else "}"
                end = self.at >= len(self.s) or self.s.startswith(close, self.at)
                stuck = not end and comma is None and own[-1].kind not in ("[", "{", "comment")
                if array and not end and not stuck:
                    break
                if not array and not end and not stuck and (k := self.key()) is not None:
                    self.space()
                    head = [k]
                    self.need("=", head)
                    self.space()
                    pairs.append(head)
                    break
                self.need(close, own)
                opened.pop()
                node = inner("array" if array else "inline_table", own)
                if not opened:
                    return node

    def rest(self, kids: list[Node]) -> None:
        """What is left of a line is an error, but a comment."""
        self.space()
        if m := re.compile(r"[^#\r\n][^\r\n]*").match(self.s, self.at):
            kids.append(Node("ERROR", m.start(), m.end()))
            self.at = m.end()

    def document(self) -> Node:
        root = Node("document", 0, len(self.s))
        table: Node | None = None
        while True:
            own: list[Node] = []
            self.blank(own)
            (table or root).children += own
            if table is not None:
                table.end = max(table.end, table.children[-1].end)
            if self.at >= len(self.s):
                break
            if self.s.startswith("[", self.at):
                double = self.s.startswith("[[", self.at)
                kids = [self.eat("[[" if double else "[")]
                self.space()
                k = self.key()
                kids.append(k or Node("bare_key", self.at, self.at, missing=True))
                self.space()
                self.need("]]" if double else "]", kids)
                table = inner("table_array_element" if double else "table", kids)
                root.children.append(table)
                self.rest(table.children)
            elif (k := self.key()) is not None:
                kids = [k]
                self.space()
                self.need("=", kids)
                self.space()
                kids.append(self.value())
                pair = inner("pair", kids)
                (table or root).children.append(pair)
                self.rest((table or root).children)
            else:
                self.rest((table or root).children)
        return root


def parse(data: bytes) -> Node:
    return _Parser(data.decode("latin-1")).document()
