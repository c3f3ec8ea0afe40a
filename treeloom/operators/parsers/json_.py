"""JSON: exact concrete syntax, comments allowed, tolerant of errors."""

from __future__ import annotations

import re

from .base import Node, place_extras

_TOKEN = re.compile(r'(?P<ws>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<str>"(?:[^"\\\n]|\\[\s\S])*"?)|(?P<num>-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_$][\w$]*)|(?P<op>[{}\[\]:,])|(?P<bad>.)', re.S)
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|.)", re.S)


def _string(text: str, start: int) -> Node:
    before = text[:-1]
    closed = len(text) > 1 and text[-1] == '"' and (len(before) - len(before.rstrip("\\"))) % 2 == 0
    end = start + len(text)
    kids = [Node('"', start, start + 1, named=False)]
    body_end = end - 1 if closed else end
    at = start + 1
    for m in _ESCAPE.finditer(text, 1, body_end - start):
        if start + m.start() > at:
            kids.append(Node("string_content", at, start + m.start()))
        kids.append(Node("escape_sequence", start + m.start(), start + m.end()))
        at = start + m.end()
    if body_end > at:
        kids.append(Node("string_content", at, body_end))
    kids.append(Node('"', body_end, end, named=False, missing=not closed))
    return Node("string", start, end, kids)


def parse(data: bytes) -> Node:
    s = data.decode("latin-1")
    toks, comments = [], []
    for m in _TOKEN.finditer(s):
        if m.lastgroup == "comment":
            comments.append(Node("comment", m.start(), m.end()))
        elif m.lastgroup != "ws":
            toks.append((m.lastgroup, m.group(), m.start(), m.end()))
    root = Node("document", 0, len(s))
    # Open containers, innermost last: [node, awaiting key / colon / value / comma]
    stack: list[list] = [[root, "value"]]

    def put(node: Node) -> None:
        top = stack[-1]
        if top[0].kind == "pair":
            top[0].children.append(node.at("value"))
            top[0].end = node.end
            stack.pop()
            stack[-1][0].children.append(top[0])
            stack[-1][1] = "comma"
        else:
            top[0].children.append(node)
            top[1] = "comma" if top[0].kind != "document" else "value"

    def error(tok) -> None:
        kids = stack[-1][0].children
        leaf = Node(tok[1], tok[2], tok[3], named=False) if tok[0] in ("op", "bad") else Node("string" if tok[0] == "str" else "number" if tok[0] == "num" else "identifier", tok[2], tok[3])
        if stack[-1][0].kind == "pair":
            kids.append(Node("ERROR", tok[2], tok[3], [leaf]))
        elif kids and kids[-1].kind == "ERROR":
            kids[-1].children.append(leaf)
            kids[-1].end = tok[3]
        else:
            kids.append(Node("ERROR", tok[2], tok[3], [leaf]))

    def close(end: int, token: str | None) -> None:
        """End the innermost container, with the token or a missing one."""
        node, state = stack.pop()
        if node.kind == "pair":  # a key without its value
            node.kind, node.end = "ERROR", node.children[-1].end
            stack[-1][0].children.append(node)
            return close(end, token)
        want = "}" if node.kind == "object" else "]"
        node.children.append(Node(want, end - 1 if token else end, end, named=False, missing=not token))
        node.end = end
        put(node)

    for kind, text, a, b in toks:
        node, state = stack[-1]
        if text in ("{", "[") and state == "value" and not (node.kind == "object"):
            stack.append([Node("object" if text == "{" else "array", a, b, [Node(text, a, b, named=False)]), "key" if text == "{" else "value"])
        elif text in ("}", "]"):
            want = "object" if text == "}" else "array"
            target = node.kind if node.kind != "pair" else stack[-2][0].kind
            if target == want:
                close(b, text)
            elif any(x[0].kind == want for x in stack):
                while stack[-1][0].kind != want:
                    close(a, None)
                close(b, text)
            else:
                error((kind, text, a, b))
        elif text == "," and node.kind in ("object", "array") and state == "comma":
            node.children.append(Node(",", a, b, named=False))
            stack[-1][1] = "key" if node.kind == "object" else "value"
        elif text == ":" and node.kind == "pair" and state == "colon":
            node.children.append(Node(":", a, b, named=False))
            node.end = b
            stack[-1][1] = "value"
        elif kind == "str" and node.kind == "object" and state == "key":
            stack.append([Node("pair", a, b, [_string(text, a).at("key")]), "colon"])
        elif kind == "num" and node.kind == "object" and state == "key":
            stack.append([Node("pair", a, b, [Node("number", a, b).at("key")]), "colon"])
        elif state == "value" and node.kind != "object" and (kind in ("str", "num") or text in ("true", "false", "null")):
            put(_string(text, a) if kind == "str" else Node("number" if kind == "num" else text, a, b))
        else:
            error((kind, text, a, b))
    end = toks[-1][3] if toks else 0
    while len(stack) > 1:
        close(end, None)
    place_extras(root, comments)
    return root
