"""Python: statements, blocks and expressions; tolerant of errors."""

from __future__ import annotations

import re

from .base import Node, inner, place_extras

_TOKEN = re.compile(
    r"""(?P<ws>[ \t\f\r]+|\\\r?\n)|(?P<comment>\#[^\n]*)|(?P<nl>\n)
  |(?P<str>[rRbBfFuUtT]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?))
  |(?P<num>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJlL]?)
  |(?P<name>[A-Za-z_\x80-\xff][\w\x80-\xff]*)
  |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|<>|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:.;=])
  |(?P<bad>.)""",
    re.X | re.S,
)
KEYWORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_BINARY = {"or": 1, "and": 2, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10, "**": 12}
_COMPARE = {"<", ">", "==", ">=", "<=", "!=", "<>", "in", "is", "not"}
_AUGMENTED = {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}
_END = {"nl", "eof", "dedent"}


def _string(text: str, a: int) -> Node:
    q = re.match(r"[A-Za-z]*(\"\"\"|'''|\"|')", text)
    mark, begin = q[1], q.end()
    closed = len(text) >= begin + len(mark) and text.endswith(mark)
    stop = len(text) - len(mark) if closed else len(text)
    kids = [Node("string_start", a, a + begin)]
    at = begin
    if "f" in text[: q.start(1)].lower():
        depth, open_ = 0, 0
        content: list[tuple[str, int, int]] = []
        i = begin
        while i < stop:
            ch = text[i]
            if ch == "{" and depth == 0 and text[i + 1 : i + 2] == "{":
                i += 1
            elif ch == "{":
                if depth == 0:
                    open_ = i
                depth += 1
            elif ch == "}" and depth:
                depth -= 1
                if depth == 0:
                    content.append(("interpolation", open_, i + 1))
            i += 1
        for kind, x, y in content:
            if x > at:
                kids.append(Node("string_content", a + at, a + x))
            m = re.match(r"\{\s*([A-Za-z_]\w*)\s*(?=[}!:=.\[(])", text[x:y])
            body = [Node("{", a + x, a + x + 1, named=False)] + ([Node("identifier", a + x + m.start(1), a + x + m.end(1), field="expression")] if m else []) + [Node("}", a + y - 1, a + y, named=False)]
            kids.append(Node(kind, a + x, a + y, body))
            at = y
    if stop > at:
        kids.append(Node("string_content", a + at, a + stop))
    kids.append(Node("string_end", a + stop, a + len(text), missing=not closed))
    return Node("string", a, a + len(text), kids)


class _Parser:
    def __init__(self, s: str):
        self.s, self.comments = s, []
        self.toks: list[tuple[str, str, int, int]] = []
        self.pos = 0
        self._lex()

    def _lex(self) -> None:
        s, toks, depth, indents = self.s, self.toks, 0, [0]
        line_start, i, n = True, 0, len(self.s)
        while i < n:
            if line_start and not depth:
                m = re.compile(r"[ \t\f]*").match(s, i)
                rest = s[m.end() : m.end() + 1]
                if rest not in ("", "\n", "#", "\r"):
                    width = len(m[0].expandtabs(8))
                    if width > indents[-1]:
                        indents.append(width)
                        toks.append(("indent", "", m.end(), m.end()))
                    while width < indents[-1]:
                        indents.pop()
                        toks.append(("dedent", "", m.end(), m.end()))
                    line_start = False
                i = m.end()
                if i >= n:
                    break
            m = _TOKEN.match(s, i)
            k, t = m.lastgroup, m[0]
            if k == "comment":
                self.comments.append(Node("comment", m.start(), m.start() + len(t.rstrip("\r"))))
            elif k == "nl":
                # An open bracket ends where a line at column 0 begins a statement: it was never closed.
                if depth and re.match(r"(?:def|class|import|from|@|if|for|while|return|with|try|async)\b", s[i + 1 : i + 9]):
                    depth = 0
                if not depth:
                    if toks and toks[-1][0] not in ("nl", "indent", "dedent"):
                        toks.append(("nl", "", m.start(), m.start()))
                    line_start = True
            elif k != "ws":
                if t in "([{" and k == "op":
                    depth += 1
                elif t in ")]}" and k == "op":
                    depth = max(0, depth - 1)
                toks.append((k, t, m.start(), m.end()))
            i = m.end()
        if toks and toks[-1][0] not in ("nl", "dedent"):
            toks.append(("nl", "", n, n))
        for _ in indents[1:]:
            toks.append(("dedent", "", n, n))
        toks.append(("eof", "", n, n))

    # -- tokens

    @property
    def kind(self) -> str:
        return self.toks[self.pos][0]

    @property
    def text(self) -> str:
        return self.toks[self.pos][1]

    def leaf(self) -> Node:
        k, t, a, b = self.toks[self.pos]
        self.pos = min(self.pos + 1, len(self.toks) - 1)
        return Node(t, a, b, named=False)

    def is_(self, *texts: str) -> bool:
        return self.toks[self.pos][1] in texts and self.kind in ("op", "name")

    def here(self) -> int:
        """End of the last token that was taken."""
        return self.toks[self.pos - 1][3] if self.pos else 0

    def need(self, text: str, kids: list[Node]) -> bool:
        if self.is_(text):
            kids.append(self.leaf())
            return True
        kids.append(Node(text, self.here(), self.here(), named=False, missing=True))
        return False

    def name(self, kids: list[Node], field: str | None = None) -> None:
        if self.kind == "name" and self.text not in KEYWORDS:
            _, _, a, b = self.toks[self.pos]
            self.pos += 1
            kids.append(Node("identifier", a, b, field=field))
        else:
            kids.append(Node("identifier", self.here(), self.here(), field=field, missing=True))

    def skip_line(self, kids: list[Node]) -> None:
        """What is left of a line, as one ERROR."""
        bad = []
        while self.kind not in _END and not (self.is_(";")):
            k, t, a, b = self.toks[self.pos]
            bad.append(_string(t, a) if k == "str" else Node("identifier" if k == "name" and t not in KEYWORDS else t, a, b, named=k == "name" and t not in KEYWORDS))
            self.pos += 1
        if bad:
            kids.append(inner("ERROR", bad))

    # -- statements

    def module(self) -> Node:
        root = Node("module", 0, len(self.s))
        while self.kind != "eof":
            before = self.pos
            root.children += self.statement()
            if self.pos == before:
                self.pos += 1
        return root

    def statement(self) -> list[Node]:
        """The statements of one line, or one compound statement."""
        if self.kind in ("nl", "indent", "dedent"):
            self.pos += 1
            return []
        t = self.text if self.kind in ("name", "op") else ""
        compound = {"def": self.function, "class": self.class_, "if": self.if_, "for": self.for_, "while": self.while_, "try": self.try_, "with": self.with_, "@": self.decorated}
        if t == "async" and self.toks[self.pos + 1][1] in ("def", "for", "with"):
            mark = self.leaf()
            node = compound[self.text]()
            node.children.insert(0, mark)
            node.start = mark.start
            return [node]
        if t in compound:
            return [compound[t]()]
        out = []
        while True:
            before = self.pos
            node = self.simple()
            if node is not None:
                out.append(node)
            self.skip_line(out)
            if self.is_(";"):
                self.pos += 1
                if self.kind in _END:
                    break
                continue
            if self.pos == before and self.kind not in _END:
                self.pos += 1
                continue
            break
        if self.kind == "nl":
            self.pos += 1
        return out

    def block(self, kids: list[Node]) -> None:
        """The body after a colon: on the line, or indented below."""
        if self.is_(":") or not (kids[-1].children and kids[-1].children[-1].kind == "ERROR"):
            self.need(":", kids)
        if self.kind == "nl" and self.toks[self.pos + 1][0] == "indent":
            self.pos += 2
            body = []
            while self.kind not in ("dedent", "eof"):
                before = self.pos
                body += self.statement()
                if self.pos == before:
                    self.pos += 1
            if self.kind == "dedent":
                self.pos += 1
        elif self.kind in _END:
            if self.kind == "nl":
                self.pos += 1
            body = []
        else:
            body = self.statement()
        if body:
            kids.append(inner("block", body, "body"))
        else:
            kids.append(Node("block", self.here(), self.here(), field="body"))

    def function(self) -> Node:
        kids = [self.leaf()]
        self.name(kids, "name")
        self.type_parameters(kids)
        kids.append(self.parameters().at("parameters"))
        if self.is_("->"):
            kids.append(self.leaf())
            kids.append(self.type_().at("return_type"))
        self.recover(kids)
        self.block(kids)
        return inner("function_definition", kids)

    def recover(self, kids: list[Node]) -> None:
        if self.kind not in _END and not self.is_(":"):
            bad = []
            while self.kind not in _END and not self.is_(":"):
                k, t, a, b = self.toks[self.pos]
                bad.append(_string(t, a) if k == "str" else Node("identifier" if k == "name" else t, a, b, named=k == "name"))
                self.pos += 1
            kids.append(inner("ERROR", bad))

    def parameters(self, close: str = ")") -> Node:
        kids: list[Node] = []
        if close == ")" and not self.is_("("):
            return Node("parameters", self.here(), self.here(), missing=True)
        if close == ")":
            kids.append(self.leaf())
        while self.kind not in _END and not self.is_(close):
            if self.is_(","):
                kids.append(self.leaf())
            elif self.is_("*", "**"):
                star = self.leaf()
                if self.kind == "name" and self.text not in KEYWORDS:
                    sub = [star]
                    self.name(sub)
                    node = inner("list_splat_pattern" if star.kind == "*" else "dictionary_splat_pattern", sub)
                    if close == ")" and self.is_(":"):
                        node = inner("typed_parameter", [node, self.leaf(), self.type_().at("type")])
                    kids.append(node)
                else:
                    kids.append(inner("keyword_separator", [star]))
            elif self.is_("/"):
                kids.append(inner("positional_separator", [self.leaf()]))
            elif self.kind == "name" and self.text not in KEYWORDS:
                sub: list[Node] = []
                self.name(sub)
                typed = False
                if self.is_(":") and close == ")":
                    sub.append(self.leaf())
                    sub.append(self.type_().at("type"))
                    typed = True
                if self.is_("="):
                    sub[0].field = "name"
                    sub.append(self.leaf())
                    sub.append(self.expr(0).at("value"))
                    kids.append(inner("typed_default_parameter" if typed else "default_parameter", sub))
                else:
                    kids.append(inner("typed_parameter", sub) if typed else sub[0])
            else:
                bad = self.leaf()
                if kids and kids[-1].kind == "ERROR":
                    kids[-1].children.append(bad)
                    kids[-1].end = bad.end
                else:
                    kids.append(inner("ERROR", [bad]))
        if close == ")":
            if self.is_(")") or kids[-1].kind != "ERROR":  # one error is enough for an unclosed list
                self.need(")", kids)
            return inner("parameters", kids)
        return inner("lambda_parameters", kids) if kids else Node("lambda_parameters", self.here(), self.here())

    def type_parameters(self, kids: list[Node]) -> None:
        """``[T, U: bound = default, *Ts, **P]`` behind a name, if it is there."""
        if not self.is_("["):
            return
        own = [self.leaf()]
        while self.kind not in _END and not self.is_("]"):
            before = self.pos
            if self.is_(","):
                own.append(self.leaf())
                continue
            if self.is_("*", "**"):
                sub = [inner("splat_type", [self.leaf(), self.expr(0)])]
            else:
                sub = [self.type_()]
            if self.is_(":"):
                sub = [inner("constrained_type", [*sub, self.leaf(), self.type_()])]
            own.append(inner("type", sub) if sub[0].kind != "type" else sub[0])
            if self.is_("="):
                own += [self.leaf(), self.type_()]
            if self.pos == before:
                own.append(inner("ERROR", [self.leaf()]))
        self.need("]", own)
        kids.append(inner("type_parameter", own, "type_parameters"))

    def type_(self) -> Node:
        return inner("type", [self.expr(0)])

    def class_(self) -> Node:
        kids = [self.leaf()]
        self.name(kids, "name")
        self.type_parameters(kids)
        if self.is_("("):
            kids.append(self.arguments().at("superclasses"))
        self.recover(kids)
        self.block(kids)
        return inner("class_definition", kids)

    def decorated(self) -> Node:
        kids = []
        while self.is_("@"):
            sub = [self.leaf(), self.expr(0)]
            self.skip_line(sub)
            kids.append(inner("decorator", sub))
            if self.kind == "nl":
                self.pos += 1
        if self.is_("def", "class", "async"):
            kids.append(self.statement()[0].at("definition"))
        return inner("decorated_definition", kids)

    def clause(self, kind: str, kids: list[Node], field: str | None = None) -> Node:
        self.recover(kids)
        self.block(kids)
        return inner(kind, kids, field)

    def if_(self) -> Node:
        kids = [self.leaf(), self.expr(0).at("condition")]
        self.recover(kids)
        self.block(kids)
        kids[-1].field = "consequence"
        while self.is_("elif"):
            sub = [self.leaf(), self.expr(0).at("condition")]
            node = self.clause("elif_clause", sub, "alternative")
            node.children[-1].field = "consequence"
            kids.append(node)
        if self.is_("else"):
            kids.append(self.clause("else_clause", [self.leaf()], "alternative"))
        return inner("if_statement", kids)

    def tail(self, kids: list[Node]) -> None:
        if self.is_("else"):
            kids.append(self.clause("else_clause", [self.leaf()], "alternative"))

    def for_(self) -> Node:
        kids = [self.leaf(), self.targets().at("left")]
        self.need("in", kids)
        kids.append(self.expr_list().at("right"))
        self.recover(kids)
        self.block(kids)
        self.tail(kids)
        return inner("for_statement", kids)

    def targets(self) -> Node:
        first = self.expr(5)
        if not self.is_(","):
            return first
        kids = [first]
        while self.is_(","):
            kids.append(self.leaf())
            if not self.is_("in"):
                kids.append(self.expr(5))
        return inner("pattern_list", kids)

    def while_(self) -> Node:
        kids = [self.leaf(), self.expr(0).at("condition")]
        self.recover(kids)
        self.block(kids)
        self.tail(kids)
        return inner("while_statement", kids)

    def try_(self) -> Node:
        kids = [self.leaf()]
        self.block(kids)
        while self.is_("except", "else", "finally"):
            word = self.text
            sub = [self.leaf()]
            if word == "except":
                if self.is_("*"):
                    sub.append(self.leaf())
                if not self.is_(":"):
                    value = self.expr_list()
                    if self.is_("as"):
                        alias = [value, self.leaf(), inner("as_pattern_target", [self.expr(0)]).at("alias")]
                        value = inner("as_pattern", alias)
                    sub.append(value.at("value"))
            node = self.clause({"except": "except_clause", "else": "else_clause", "finally": "finally_clause"}[word], sub)
            if word != "else":
                node.children[-1].field = None
            kids.append(node)
        return inner("try_statement", kids)

    def with_(self) -> Node:
        kids = [self.leaf()]
        items = []
        while self.kind not in _END and not self.is_(":"):
            value = self.expr(0)
            if self.is_("as"):
                value = inner("as_pattern", [value, self.leaf(), inner("as_pattern_target", [self.expr(5)]).at("alias")])
            items.append(inner("with_item", [value.at("value")]))
            if not self.is_(","):
                break
            items.append(self.leaf())
        if items:
            kids.append(inner("with_clause", items))
        return self.clause("with_statement", kids)

    def simple(self) -> Node | None:
        t = self.text if self.kind == "name" else ""
        if t in ("import", "from"):
            return self.import_() if t == "import" else self.from_()
        if t in ("pass", "break", "continue"):
            return inner(f"{t}_statement", [self.leaf()])
        if t in ("return", "raise", "del", "assert", "global", "nonlocal"):
            kids = [self.leaf()]
            while self.kind not in _END and not self.is_(";"):
                if self.is_(",", "from"):
                    kids.append(self.leaf())
                    continue
                before = self.pos
                e = self.expr(0) if t == "assert" else self.expr_list()
                kids.append(e.at("cause") if kids[-1].kind == "from" else e)
                if self.pos == before or not self.is_(",", "from"):
                    break
            return inner({"del": "delete_statement"}.get(t, f"{t}_statement"), kids)
        left = self.expr_list()
        node = left
        if self.is_(":") and left.kind in ("identifier", "attribute", "subscript"):
            kids = [left.at("left"), self.leaf(), self.type_().at("type")]
            if self.is_("="):
                kids += [self.leaf(), self.expr_list().at("right")]
            node = inner("assignment", kids)
        elif self.is_("="):
            if left.kind == "expression_list":
                left.kind = "pattern_list"
            kids = [left.at("left"), self.leaf(), self.expr_list().at("right")]
            if self.is_("="):  # a = b = c nests to the right
                kids[2].field = None
                parts, ops = [left, kids[2]], [kids[1]]
                while self.is_("="):
                    ops.append(self.leaf())
                    parts.append(self.expr_list())
                node = parts.pop()
                while parts:
                    node = inner("assignment", [parts.pop().at("left"), ops.pop(), node.at("right")])
                node.field = None
            else:
                node = inner("assignment", kids)
        elif self.kind == "op" and self.text in _AUGMENTED:
            node = inner("augmented_assignment", [left.at("left"), self.leaf().at("operator"), self.expr_list().at("right")])
        return inner("expression_statement", [node])

    def dotted(self, field: str | None = None) -> Node:
        kids: list[Node] = []
        self.name(kids)
        while self.is_("."):
            kids.append(self.leaf())
            self.name(kids)
        return inner("dotted_name", kids, field)

    def aliased(self) -> Node:
        node = self.dotted()
        if self.is_("as"):
            kids = [node.at("name"), self.leaf()]
            self.name(kids, "alias")
            node = inner("aliased_import", kids)
        return node.at("name")

    def import_(self) -> Node:
        kids = [self.leaf(), self.aliased()]
        while self.is_(","):
            kids += [self.leaf(), self.aliased()]
        return inner("import_statement", kids)

    def from_(self) -> Node:
        kids = [self.leaf()]
        if self.is_(".", "..."):
            dots = []
            while self.is_(".", "..."):
                dots.append(self.leaf())
            rel = [inner("import_prefix", dots)]
            if self.kind == "name" and not self.is_("import"):
                rel.append(self.dotted())
            kids.append(inner("relative_import", rel, "module_name"))
        else:
            kids.append(self.dotted("module_name"))
        future = self.s[kids[1].start : kids[1].end] == "__future__"
        self.need("import", kids)
        if self.is_("*"):
            kids.append(inner("wildcard_import", [self.leaf()]))
        else:
            bracket = self.is_("(")
            if bracket:
                kids.append(self.leaf())
            while self.kind == "name":
                kids.append(self.aliased())
                if not self.is_(","):
                    break
                kids.append(self.leaf())
            if bracket:
                self.need(")", kids)
        return inner("future_import_statement" if future else "import_from_statement", kids)

    # -- expressions

    def expr_list(self) -> Node:
        first = self.expr(0)
        if not self.is_(","):
            return first
        kids = [first]
        while self.is_(","):
            kids.append(self.leaf())
            if self.kind in _END or self.is_("=", ")", "]", "}", ":", ";"):
                break
            kids.append(self.expr(0))
        return inner("expression_list", kids)

    def expr(self, level: int) -> Node:
        """An expression whose operators bind more tightly than ``level``."""
        if level == 0 and self.is_("lambda"):
            kids = [self.leaf()]
            if not self.is_(":"):
                kids.append(self.parameters(":").at("parameters"))
            self.need(":", kids)
            kids.append(self.expr(0).at("body"))
            return inner("lambda", kids)
        if level == 0 and self.is_("yield"):
            kids = [self.leaf()]
            if self.is_("from"):
                kids.append(self.leaf())
            if self.kind not in _END and not self.is_(")", "]", "}", ",", "="):
                kids.append(self.expr_list())
            return inner("yield", kids)
        if self.is_("not") and level < 4:
            left = inner("not_operator", [self.leaf(), self.expr(3).at("argument")])
        elif self.is_("-", "+", "~"):
            left = inner("unary_operator", [self.leaf().at("operator"), self.expr(11).at("argument")])
        elif self.is_("await"):
            left = inner("await", [self.leaf(), self.expr(13)])
        elif self.is_("*", "**"):
            star = self.leaf()
            left = inner("list_splat" if star.kind == "*" else "dictionary_splat", [star, self.expr(5)])
        else:
            left = self.postfix(self.atom())
        while True:
            t = self.text if self.kind in ("op", "name") else ""
            if t in _BINARY and _BINARY[t] > level:
                op = self.leaf().at("operator")
                right = self.expr(_BINARY[t] - (t == "**")).at("right")
                left = inner("boolean_operator" if t in ("or", "and") else "binary_operator", [left.at("left"), op, right])
            elif t in _COMPARE and level < 4 and not (t == "not" and self.toks[self.pos + 1][1] != "in"):
                kids = [left]
                while (t := self.text if self.kind in ("op", "name") else "") in _COMPARE and not (t == "not" and self.toks[self.pos + 1][1] != "in"):
                    op = self.leaf()
                    if op.kind == "not" or op.kind == "is" and self.is_("not"):
                        second = self.leaf()
                        op = Node(f"{op.kind} {second.kind}", op.start, second.end, named=False)
                    kids += [op.at("operators"), self.expr(4)]
                left = inner("comparison_operator", kids)
            elif t == "if" and level == 0:
                kids = [left, self.leaf(), self.expr(1)]
                self.need("else", kids)
                kids.append(self.expr(0))
                left = inner("conditional_expression", kids)
            elif t == ":=" and level == 0 and left.kind == "identifier":
                left = inner("named_expression", [left.at("name"), self.leaf(), self.expr(0).at("value")])
            else:
                return left

    def postfix(self, node: Node) -> Node:
        while True:
            if self.is_("("):
                node = inner("call", [node.at("function"), self.arguments().at("arguments")])
            elif self.is_("."):
                kids = [node.at("object"), self.leaf()]
                self.name(kids, "attribute")
                node = inner("attribute", kids)
            elif self.is_("["):
                kids = [node.at("value"), self.leaf()]
                while self.kind not in _END and not self.is_("]"):
                    if self.is_(","):
                        kids.append(self.leaf())
                        continue
                    before = self.pos
                    kids.append(self.slice().at("subscript"))
                    if self.pos == before:
                        break
                self.need("]", kids)
                node = inner("subscript", kids)
            else:
                return node

    def slice(self) -> Node:
        kids: list[Node] = []
        while self.kind not in _END and not self.is_("]", ","):
            before = self.pos
            kids.append(self.leaf() if self.is_(":") else self.expr(0))
            if self.pos == before:
                break
        if len(kids) == 1 and kids[0].kind != ":":
            return kids[0]
        return inner("slice", kids) if kids else Node("slice", self.here(), self.here())

    def arguments(self) -> Node:
        kids = [self.leaf()]
        while self.kind not in _END and not self.is_(")"):
            if self.is_(","):
                kids.append(self.leaf())
                continue
            before = self.pos
            if self.kind == "name" and self.text not in KEYWORDS and self.toks[self.pos + 1][1] == "=":
                sub: list[Node] = []
                self.name(sub, "name")
                sub += [self.leaf(), self.expr(0).at("value")]
                kids.append(inner("keyword_argument", sub))
            else:
                e = self.expr(0)
                if self.is_("for", "async"):
                    e = self.comprehension("generator_expression", [e])
                kids.append(e)
            if self.pos == before:
                kids.pop()
                kids.append(inner("ERROR", [self.leaf()]))
        self.need(")", kids)
        return inner("argument_list", kids)

    def comprehension(self, kind: str, kids: list[Node]) -> Node:
        kids[-1].field = "body"
        while self.is_("for", "async", "if"):
            if self.is_("if"):
                kids.append(inner("if_clause", [self.leaf(), self.expr(1)]))
            else:
                sub = [self.leaf()]
                if sub[0].kind == "async" and self.is_("for"):
                    sub.append(self.leaf())
                sub.append(self.targets().at("left"))
                self.need("in", sub)
                sub.append(self.expr(1).at("right"))
                kids.append(inner("for_in_clause", sub))
        return inner(kind, kids)

    def bracket(self, close: str) -> Node:
        kids = [self.leaf()]
        pairs = commas = 0
        comp = None
        while self.kind not in _END and not self.is_(close):
            if self.is_(","):
                commas += 1
                kids.append(self.leaf())
                continue
            before = self.pos
            e = self.expr(0)
            if close == "}" and self.is_(":"):
                e = inner("pair", [e.at("key"), self.leaf(), self.expr(0).at("value")])
                pairs += 1
            pairs += e.kind == "dictionary_splat"
            kids.append(e)
            if self.is_("for", "async"):
                comp = {")": "generator_expression", "]": "list_comprehension", "}": "dictionary_comprehension" if pairs else "set_comprehension"}[close]
                body = self.comprehension(comp, kids[1:])
                kids = kids[:1] + body.children
            if self.pos == before:
                kids.pop()
                kids.append(inner("ERROR", [self.leaf()]))
        self.need(close, kids)
        n = sum(k.named for k in kids)
        kind = comp or {"]": "list", "}": "dictionary" if pairs or not n else "set", ")": "tuple" if commas or not n else "parenthesized_expression"}[close]
        return inner(kind, kids)

    def atom(self) -> Node:
        k, t, a, b = self.toks[self.pos]
        if k == "str":
            parts = []
            while self.kind == "str":
                parts.append(_string(self.text, self.toks[self.pos][2]))
                self.pos += 1
            return parts[0] if len(parts) == 1 else inner("concatenated_string", parts)
        if k == "num":
            self.pos += 1
            return Node("float" if re.fullmatch(r"(?![0][xX]).*[.eEjJ].*", t) else "integer", a, b)
        if k == "name":
            if t in ("True", "False", "None"):
                self.pos += 1
                return Node(t.lower(), a, b)
            if t not in KEYWORDS:
                self.pos += 1
                return Node("identifier", a, b)
        if k == "op" and t in "([{":
            return self.bracket({"(": ")", "[": "]", "{": "}"}[t])
        if t == "...":
            self.pos += 1
            return Node("ellipsis", a, b)
        return Node("identifier", self.here(), self.here(), missing=True)


def parse(data: bytes) -> Node:
    p = _Parser(data.decode("latin-1"))
    root = p.module()
    place_extras(root, p.comments)
    return root
