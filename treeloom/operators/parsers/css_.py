"""CSS: rule sets, at-rules, selectors, declarations and values; nested rules too."""

from __future__ import annotations

import re

from .base import Node, inner, place_extras

_TOKEN = re.compile(
    r"(?P<ws>\s+)|(?P<comment>/\*[\s\S]*?(?:\*/|\Z))|(?P<str>\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)|(?P<at>@-?[A-Za-z_][\w-]*)|(?P<color>\#[0-9A-Za-z_\x80-\xff-]+)"
    r"|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?(?:%|[A-Za-z]+)?)|(?P<name>(?:--|-?[A-Za-z_\x80-\xff\\])(?:[\w\x80-\xff-]|\\.)*)|(?P<op>::|\|\||[~|^$*]?=|>=|<=|[{}()\[\]:;,.>+~*!/%&=<|-])|(?P<bad>.)",
    re.S,
)
_AT = {"@media": "media_statement", "@import": "import_statement", "@charset": "charset_statement", "@namespace": "namespace_statement", "@keyframes": "keyframes_statement", "@supports": "supports_statement"}
_NUMBER = re.compile(r"[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?")


class _Parser:
    def __init__(self, s: str):
        self.s, self.pos = s, 0
        self.comments: list[Node] = []
        self.toks: list[tuple[str, str, int, int, bool]] = []  # kind, text, begin, end, space before
        space = True
        for m in _TOKEN.finditer(s):
            if m.lastgroup == "comment":
                self.comments.append(Node("comment", m.start(), m.end()))
            elif m.lastgroup != "ws":
                self.toks.append((m.lastgroup, m[0], m.start(), m.end(), space))
            space = m.lastgroup in ("ws", "comment")
        self.toks.append(("eof", "", len(s), len(s), True))

    @property
    def kind(self) -> str:
        return self.toks[self.pos][0]

    @property
    def text(self) -> str:
        return self.toks[self.pos][1]

    def is_(self, *texts: str) -> bool:
        return self.kind != "str" and self.text in texts and self.kind != "eof"

    def leaf(self, kind: str | None = None) -> Node:
        _, t, a, b, _ = self.toks[self.pos]
        self.pos = min(self.pos + 1, len(self.toks) - 1)
        return Node(kind or t, a, b, named=kind is not None)

    def here(self) -> int:
        return self.toks[self.pos - 1][3] if self.pos else 0

    def need(self, text: str, kids: list[Node]) -> None:
        kids.append(self.leaf() if self.is_(text) else Node(text, self.here(), self.here(), named=False, missing=True))

    def error(self) -> Node:
        return inner("ERROR", [self.leaf()])

    def declares(self) -> bool:
        """Whether what begins here is a declaration: a name, a colon, and a ``;`` or ``}`` before any ``{``."""
        if self.kind != "name" or self.toks[self.pos + 1][1] != ":":
            return False
        for k, t, *_ in self.toks[self.pos + 2 :]:
            if k == "op" and t in ("{", ";", "}"):
                return t != "{"
        return True

    # Blocks that are open stand on a stack, so depth doesn't matter.
    def sheet(self) -> Node:
        root = Node("stylesheet", 0, len(self.s))
        opened: list[tuple[str, list[Node], list[Node]]] = []  # kind, children before the block, the block's own
        while True:
            into = opened[-1][2] if opened else root.children
            if self.kind == "eof" or opened and self.is_("}"):
                if not opened:
                    break
                kind, head, own = opened.pop()
                self.need("}", own)
                (opened[-1][2] if opened else root.children).append(inner(kind, [*head, inner("keyframe_block_list" if kind == "keyframes_statement" else "block", own)]))
            elif self.is_(";"):
                into.append(self.leaf())
            elif self.kind == "at":
                kind = _AT.get(self.text.lower(), "at_rule")
                head = [self.leaf("at_keyword" if kind == "at_rule" else None)]
                if kind == "keyframes_statement" and self.kind == "name":
                    head.append(self.leaf("keyframes_name"))
                while self.kind != "eof" and not self.is_("{", ";", "}"):
                    head += [self.leaf()] if self.is_(",") else [self.query()]
                if self.is_("{"):
                    opened.append((kind, head, [self.leaf()]))
                else:
                    self.need(";", head)
                    into.append(inner(kind, head))
            elif opened and self.declares():
                into.append(self.declaration())
            elif self.is_("}", ")", "]", "{"):
                into.append(self.error())
            else:
                frames = bool(opened) and opened[-1][0] == "keyframes_statement"
                head = [self.leaf("from" if self.is_("from") else "to" if self.is_("to") else "integer_value")] if frames and self.kind in ("name", "num") else [self.selectors()]
                while frames and self.is_(","):
                    head += [self.leaf(), self.leaf("integer_value")]
                if self.is_("{"):
                    opened.append(("keyframe_block" if frames else "rule_set", head, [self.leaf()]))
                else:
                    into.append(inner("ERROR", head))
        place_extras(root, self.comments)
        return root

    def query(self) -> Node:
        """A part of a media or supports query."""
        if self.is_("("):
            kids = [self.leaf()]
            if self.kind == "name" and self.toks[self.pos + 1][1] == ":":
                kids += [self.leaf("feature_name"), self.leaf()]
            while self.kind != "eof" and not self.is_(")", "{", "}", ";"):
                kids += [self.leaf()] if self.is_(",", "=", "<", ">", "<=", ">=", ":") else [self.value()]
            self.need(")", kids)
            return inner("feature_query" if len(kids) > 1 and kids[1].kind == "feature_name" else "parenthesized_query", kids)
        if self.is_("and", "or", "not", "only"):
            return self.leaf()
        return self.leaf("keyword_query") if self.kind == "name" and self.toks[self.pos + 1][1] != "(" else self.value()

    def declaration(self) -> Node:
        kids = [self.leaf("property_name"), self.leaf()]
        while self.kind != "eof" and not self.is_(";", "}"):
            if self.is_(","):
                kids.append(self.leaf())
            elif self.is_("!"):
                sub = [self.leaf()]
                if self.kind == "name":
                    sub.append(self.leaf())
                kids.append(inner("important", sub))
            else:
                kids.append(self.value())
        if self.is_(";"):
            kids.append(self.leaf())
        return inner("declaration", kids)

    def string(self) -> Node:
        _, t, a, b, _ = self.toks[self.pos]
        self.pos += 1
        closed = len(t) > 1 and t[-1] == t[0]
        end = b - 1 if closed else b
        kids = [Node(t[0], a, a + 1, named=False)]
        if end > a + 1:
            kids.append(Node("string_content", a + 1, end))
        kids.append(Node(t[0], end, b, named=False, missing=not closed))
        return Node("string_value", a, b, kids)

    def value(self) -> Node:
        if self.kind == "str":
            return self.string()
        if self.kind == "num":
            _, t, a, b, _ = self.toks[self.pos]
            self.pos += 1
            cut = a + _NUMBER.match(t).end()
            return Node("float_value" if "." in t[: cut - a] or "e" in t[: cut - a].lower() else "integer_value", a, b, [Node("unit", cut, b)] if cut < b else [])
        if self.kind == "color":
            return self.leaf("color_value")
        if self.kind == "name":
            node = self.leaf("plain_value")
            if self.is_("(") and not self.toks[self.pos][4]:
                node.kind = "function_name"
                return self.call(node)
            return node
        if self.is_("("):
            return self.call(None)
        if self.is_("*", "/", "+", "-", "%", ">", "<", "=", ".", ":", "~", "&"):
            return self.leaf()
        return self.error()

    def call(self, name: Node | None) -> Node:
        """Arguments in parentheses, nested ones on a stack."""
        opened: list[tuple[Node | None, list[Node]]] = [(name, [self.leaf()])]
        while True:
            own = opened[-1][1]
            if self.kind == "eof" or self.is_(")", ";", "}", "{"):
                name, own = opened.pop()
                self.need(")", own)
                node = inner("call_expression", [name, inner("arguments", own)]) if name is not None else inner("parenthesized_value", own)
                if not opened:
                    return node
                opened[-1][1].append(node)
            elif self.is_(","):
                own.append(self.leaf())
            elif self.is_("("):
                opened.append((None, [self.leaf()]))
            elif self.kind == "name" and self.toks[self.pos + 1][1] == "(" and not self.toks[self.pos + 1][4]:
                node = self.leaf("function_name")
                opened.append((node, [self.leaf()]))
            elif self.kind == "bad" or self.is_("]", "[", "|", "||", "!"):
                own.append(self.leaf())  # an address without quotes may hold anything
            else:
                own.append(self.value())

    def selectors(self) -> Node:
        kids: list[Node] = []
        while self.kind != "eof" and not self.is_("{", "}", ";"):
            if self.is_(","):
                kids.append(self.leaf())
            else:
                kids.append(self.selector())
        return inner("selectors", kids)

    def selector(self) -> Node:
        left: Node | None = None
        while self.kind != "eof" and not self.is_("{", "}", ";", ",", ")"):
            joint = None
            if self.is_(">", "+", "~"):
                joint = self.leaf()
            elif left is not None and self.toks[self.pos][4]:
                joint = "descendant"
            if joint is None:
                left = self.simple(left)
                continue
            if self.kind == "eof" or self.is_("{", "}", ";", ",", ")"):
                return inner("ERROR", [x for x in (left, joint) if isinstance(x, Node)])
            right = self.simple(None)
            while not self.toks[self.pos][4] and self.kind != "eof" and not self.is_("{", "}", ";", ",", ")", ">", "+", "~"):
                right = self.simple(right)
            what = {">": "child_selector", "+": "adjacent_sibling_selector", "~": "sibling_selector"}[joint.kind] if isinstance(joint, Node) else "descendant_selector"
            left = inner(what, [x for x in (left, joint, right) if isinstance(x, Node)])
        return left or self.error()

    def simple(self, on: Node | None) -> Node:
        """One simple selector, attached to what it narrows."""
        before = [on] if on is not None else []
        if self.kind == "name":
            return inner("ERROR", [on, self.leaf("tag_name")]) if on is not None else self.leaf("tag_name")
        if self.is_("*"):
            return inner("universal_selector", [*before, self.leaf()])
        if self.is_("&"):
            return inner("nesting_selector", [*before, self.leaf()])
        if self.kind == "color":
            a, b = self.toks[self.pos][2:4]
            self.pos += 1
            return inner("id_selector", [*before, Node("#", a, a + 1, named=False), Node("id_name", a + 1, b)])
        if self.is_(".") and self.toks[self.pos + 1][0] == "name":
            return inner("class_selector", [*before, self.leaf(), self.leaf("class_name")])
        if self.is_(":", "::") and self.toks[self.pos + 1][0] == "name":
            double = self.is_("::")
            kids = [*before, self.leaf(), self.leaf("tag_name" if double else "class_name")]
            if self.is_("("):
                own = [self.leaf()]
                while self.kind != "eof" and not self.is_(")", "{", "}"):
                    if self.is_(","):
                        own.append(self.leaf())
                    else:
                        own.append(self.value() if self.kind in ("num", "str") or self.is_("+", "-") or self.kind == "name" and self.toks[self.pos + 1][1] in (")", "+", "-", ",") and self.toks[self.pos][1] in ("odd", "even", "n", "ltr", "rtl") else self.selector())
                self.need(")", own)
                kids.append(inner("arguments", own))
            return inner("pseudo_element_selector" if double else "pseudo_class_selector", kids)
        if self.is_("["):
            kids = [*before, self.leaf()]
            if self.kind == "name":
                kids.append(self.leaf("attribute_name"))
            if self.is_("=", "~=", "|=", "^=", "$=", "*="):
                kids += [self.leaf(), self.value()]
                if self.kind == "name":
                    kids.append(self.leaf("plain_value"))
            self.need("]", kids)
            return inner("attribute_selector", kids)
        return inner("ERROR", [*before, self.leaf()])


def parse(data: bytes) -> Node:
    return _Parser(data.decode("latin-1")).sheet()
