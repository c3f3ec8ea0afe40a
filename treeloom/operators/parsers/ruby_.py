"""Ruby at the level of classes, modules, methods and calls."""

from __future__ import annotations

import re

from .base import Node, inner, place_extras

_TOKEN = re.compile(
    r"""(?P<nl>\n)|(?P<ws>[^\S\n]+)|(?P<comment>\#[^\n]*|(?m:^=begin\b[\s\S]*?^=end\b[^\n]*))|(?P<str>"(?:[^"\\]|\\[\s\S])*"?|'(?:[^'\\]|\\[\s\S])*'?)|(?P<sym>:[A-Za-z_]\w*[?!]?)|(?P<num>\d[\d_]*(?:\.\d+)?)|(?P<name>(?:@@?|\$)?[A-Za-z_\x80-\xff][\w\x80-\xff]*[?!]?)|(?P<op>=>|->|&\.|::|\*\*|<<|>>|<=>|===|==|!=|<=|>=|&&|\|\||\.\.\.?|[-+*/%&|^~!<>=?:;,.(){}\[\]])|(?P<bad>.)""",
    re.X,
)
_OPENERS = {"class", "module", "def", "begin", "case", "do", "if", "unless", "while", "until", "for"}
_KEYS = _OPENERS | set("end else elsif when then rescue ensure return yield and or not in self nil true false super break next redo retry alias undef defined".split())


def parse(data: bytes) -> Node:
    s = data.decode("latin-1")
    toks, comments = [], []
    for m in _TOKEN.finditer(s):
        if m.lastgroup == "comment":
            comments.append(Node("comment", m.start(), m.end()))
        elif m.lastgroup != "ws":
            toks.append((m.lastgroup, m[0], m.start(), m.end()))
    toks.append(("eof", "", len(s), len(s)))
    root = Node("program", 0, len(s))
    stack: list[tuple[Node, Node]] = [(root, root)]  # open node, and where statements go

    def leaf(i: int) -> Node:
        k, t, a, b = toks[i]
        if k == "str":
            closed = len(t) > 1 and t[-1] == t[0]
            e = b - 1 if closed else b
            return Node("string", a, b, [Node(t[0], a, a + 1, named=False)] + ([Node("string_content", a + 1, e)] if e > a + 1 else []) + [Node(t[0], e, b, named=False, missing=not closed)])
        if k == "num":
            return Node("float" if "." in t else "integer", a, b)
        if k == "sym":
            return Node("simple_symbol", a, b)
        if k == "name" and t in ("self", "nil", "true", "false", "super"):
            return Node(t, a, b)
        if k == "name" and t not in _KEYS:
            return Node("constant" if t[0].isupper() else "instance_variable" if t[0] == "@" else "identifier", a, b)
        return Node("ERROR", a, b, [Node(t, a, b, named=False)]) if k == "bad" else Node(t, a, b, named=False)

    i, depth, line = 0, [], []

    def flush() -> None:
        nonlocal line
        if line:
            names = [x for x in line if x.named]
            if len(line) == 1 and line[0].named:
                stack[-1][1].children.append(line[0])
            elif line[0].kind in ("identifier", "constant") and len(line) > 1 and line[1].kind in ("string", "simple_symbol", "(", "identifier", "constant", "integer"):
                args = line[1:]
                stack[-1][1].children.append(inner("call", [line[0].at("method"), inner("argument_list", args, "arguments")]))
            elif len(line) > 2 and line[1].kind == "=":
                stack[-1][1].children.append(inner("assignment", [line[0].at("left"), line[1], *line[2:]]))
            else:
                stack[-1][1].children.append(inner("call" if names else "ERROR", line))
        line = []

    while toks[i][0] != "eof":
        k, t, a, b = toks[i]
        fresh = not line
        if k == "nl" or t == ";" and k == "op":
            flush()
            i += 1
        elif k == "name" and t in ("class", "module", "def") and fresh:
            kids = [leaf(i)]
            i += 1
            if t == "class" and toks[i][1] == "<<":
                kids += [leaf(i), leaf(i + 1)]
                i += 2
            elif toks[i][0] in ("name", "op"):
                if t == "def" and toks[i + 1][1] == "." and toks[i][0] == "name":
                    kids += [leaf(i).at("object"), leaf(i + 1)]
                    i += 2
                node = leaf(i)
                node.named, node.field = True, "name"
                node.kind = "identifier" if t == "def" else "constant"
                kids.append(node)
                i += 1
            while toks[i][1] == "::" and t != "def":
                kids[-1] = inner("scope_resolution", [kids[-1].at("scope"), leaf(i), leaf(i + 1).at("name")], "name")
                i += 2
            if t == "def" and toks[i][1] == "=" and toks[i][2] == toks[i - 1][3]:
                kids[-1].end = toks[i][3]
                i += 1
            if t == "class" and toks[i][1] == "<":
                kids.append(inner("superclass", [leaf(i), leaf(i + 1)], "superclass"))
                i += 2
            if t == "def" and toks[i][1] == "(":
                sub, d = [], 0
                while toks[i][0] != "eof":
                    d += (toks[i][1] == "(") - (toks[i][1] == ")")
                    if toks[i][0] != "nl":
                        sub.append(leaf(i))
                    i += 1
                    if d == 0:
                        break
                kids.append(inner("method_parameters", sub, "parameters"))
            elif t == "def" and toks[i][0] != "nl":
                sub = []
                while toks[i][0] not in ("nl", "eof") and toks[i][1] not in (";", "="):
                    sub.append(leaf(i))
                    i += 1
                if sub:
                    kids.append(inner("method_parameters", sub, "parameters"))
            node = Node({"def": "singleton_method" if any(x.field == "object" for x in kids) else "method"}.get(t, t), a, kids[-1].end, kids)
            stack[-1][1].children.append(node)
            body = Node("body_statement", 0, 0, field="body")
            stack.append((node, body))
            depth.append("node")
        elif k == "name" and (t in ("begin", "case", "do") or t in ("if", "unless", "while", "until", "for") and (fresh or line[-1].kind == "=")):
            if t == "do" and depth and depth[-1] == "loop" and any(x.kind in ("while", "until", "for") for x in line):
                line.append(leaf(i))
                i += 1
                continue
            line.append(leaf(i))
            depth.append("loop" if t in ("while", "until", "for") else "block")
            i += 1
        elif k == "name" and t == "end":
            flush() if not (depth and depth[-1] != "node") else None
            if depth and depth[-1] == "node":
                depth.pop()
                node, body = stack.pop()
                if body.children:
                    body.start, body.end = body.children[0].start, body.children[-1].end
                    node.children.append(body)
                node.children.append(leaf(i))
                node.end = b
            elif depth:
                depth.pop()
                line.append(leaf(i))
            else:
                stack[-1][1].children.append(Node("ERROR", a, b, [leaf(i)]))
            i += 1
        else:
            line.append(leaf(i))
            i += 1
    flush()
    while len(stack) > 1:
        node, body = stack.pop()
        if body.children:
            body.start, body.end = body.children[0].start, body.children[-1].end
            node.children.append(body)
        end = node.children[-1].end
        node.children.append(Node("end", end, end, named=False, missing=True))
        node.end = end
    place_extras(root, comments)
    return root
