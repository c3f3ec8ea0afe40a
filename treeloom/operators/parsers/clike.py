"""Languages with braces: JavaScript, TypeScript, TSX, Rust, Go, Java, Kotlin and C at the level of declarations.

Declarations, bodies, imports, exports, comments and names have the kinds and
fields of the public grammars. Expressions are read without precedence.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .base import Node, inner, place_extras

_STR = r'"(?:[^"\\\n]|\\[\s\S])*"?'
_OPS = r"(?P<op>=>|->|\.\.\.|\.\.=|\.\.|::|:=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.|<<=|>>>=|>>=|===|!==|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[-+*/%&|^~!<>=?:;,.(){}\[\]@\#$])"


def _lexer(string: str, extra: str = "") -> re.Pattern:
    return re.compile(
        rf"(?P<nl>\n)|(?P<ws>\s)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|{extra}(?P<str>{string})|(?P<num>0[xXbBoO][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?\w*)|(?P<name>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|{_OPS}|(?P<bad>.)"
    )


_JS_KEYS = "async await break case catch class const continue debugger default delete do else export extends finally for function get if import in instanceof let new of return set static super switch this throw try typeof var void while with yield"
_KEYS = {
    "javascript": _JS_KEYS, "typescript": _JS_KEYS + " interface enum implements abstract declare namespace readonly private public protected as", "tsx": _JS_KEYS + " interface enum implements abstract declare namespace readonly private public protected as",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert break case catch class const continue default do else enum extends final finally for if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while record",
    "kotlin": "as break class continue do else fun for if import in interface is object package return super this throw try typealias val var when while data sealed open abstract private public internal override enum companion",
    "c": "break case const continue default do else enum extern for goto if inline register return sizeof static struct switch typedef union volatile while",
}
_ROOT = {"javascript": "program", "typescript": "program", "tsx": "program", "rust": "source_file", "go": "source_file", "java": "program", "kotlin": "source_file", "c": "translation_unit"}
_BLOCK = {"javascript": "statement_block", "typescript": "statement_block", "tsx": "statement_block", "c": "compound_statement"}
_NEWLINE_ENDS = {"javascript", "typescript", "tsx", "go", "kotlin"}
_LEX = {
    **{k: _lexer(_STR + r"|'(?:[^'\\\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*`?") for k in ("javascript", "typescript", "tsx")},
    "rust": _lexer(r'b?r?"(?:[^"\\]|\\[\s\S])*"?|\x27(?:[^\x27\\\n]|\\.[^\x27]*)\x27'),
    "go": _lexer(_STR + r"|`[^`]*`?|'(?:[^'\\\n]|\\.)+'"),
    "java": _lexer(r'"""[\s\S]*?"""|' + _STR + r"|'(?:[^'\\\n]|\\.)+'"),
    "kotlin": _lexer(r'"""[\s\S]*?"""|' + _STR + r"|'(?:[^'\\\n]|\\.)+'"),
    "c": _lexer(_STR + r"|'(?:[^'\\\n]|\\.)+'", r"(?P<pre>(?m:^)[ \t]*\#[ \t]*\w+(?:[^\n\\]|\\\n)*)|"),
}
_BINARY = set("+ - * / % & | ^ < > == != === !== <= >= && || ?? << >> ** in instanceof as is .. ..=".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_JS = ("javascript", "typescript", "tsx")
#: What a case of a switch is called, and a default one.
_CASES = {**{x: ("switch_case", "switch_default") for x in _JS}, "go": ("expression_case", "default_case"), "java": ("switch_block_statement_group",) * 2, "c": ("case_statement",) * 2}
_ASSIGN = (":=", "=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=")


class _Parser:
    def __init__(self, s: str, lang: str):
        self.s, self.lang, self.keys = s, lang, set(_KEYS[lang].split())
        self.comments: list[Node] = []
        self.toks: list[tuple[str, str, int, int, bool]] = []
        new = True
        for m in _LEX[lang].finditer(s):
            k, t = m.lastgroup, m[0]
            if k == "nl":
                new = True
            elif k == "comment":
                self.comments.append(Node(self._comment_kind(t), m.start(), m.end() - (t.endswith("\r"))))
                new |= "\n" in t
            elif k != "ws":
                self.toks.append((k, t, m.start(), m.end(), new))
                new = False
        self.toks.append(("eof", "", len(s), len(s), True))
        self.pos = self.types = 0
        self.texts: list[Node] = []  # of elements: what looks like a comment in them is none

    def _comment_kind(self, t: str) -> str:
        if self.lang in ("rust", "java", "kotlin"):
            return "line_comment" if t.startswith("//") else "block_comment"
        return "comment"

    @property
    def kind(self) -> str:
        return self.toks[self.pos][0]

    @property
    def text(self) -> str:
        return self.toks[self.pos][1] if self.toks[self.pos][0] in ("op", "name", "bad") else ""

    def peek(self, k: int = 1) -> str:
        return self.toks[min(self.pos + k, len(self.toks) - 1)][1]

    def leaf(self) -> Node:
        _, t, a, b, _ = self.toks[self.pos]
        self.pos = min(self.pos + 1, len(self.toks) - 1)
        return Node(t, a, b, named=False)

    def here(self) -> int:
        return self.toks[self.pos - 1][3] if self.pos else 0

    def is_(self, *texts: str) -> bool:
        return self.text in texts and self.kind != "eof"

    def need(self, text: str, kids: list[Node]) -> None:
        kids.append(self.leaf() if self.is_(text) else Node(text, self.here(), self.here(), named=False, missing=True))

    def ident(self, kids: list[Node], kind: str = "identifier", field: str | None = "name") -> None:
        if self.kind == "name":
            _, _, a, b, _ = self.toks[self.pos]
            self.pos += 1
            kids.append(Node(kind, a, b, field=field))
        else:
            kids.append(Node(kind, self.here(), self.here(), field=field, missing=True))

    def seek(self, at: int) -> None:
        """Go on at a byte, lexing anew up to where the old tokens fit again."""
        i, new, fresh = self.pos, [], False
        known = {c.start for c in self.comments}
        while m := _LEX[self.lang].match(self.s, at):
            k, t, at = m.lastgroup, m[0], m.end()
            if k in ("nl", "ws"):
                fresh |= k == "nl"
                continue
            if k == "comment":
                if m.start() not in known:
                    self.comments.append(Node(self._comment_kind(t), m.start(), m.end() - t.endswith("\r")))
                continue
            while i < len(self.toks) - 1 and self.toks[i][2] < m.start():
                i += 1
            if self.toks[i][:3] == (k, t, m.start()):
                break
            new.append((k, t, m.start(), m.end(), fresh))
            fresh = False
        else:
            i = len(self.toks) - 1
        self.toks[self.pos : i] = new

    def fresh(self) -> bool:
        """Whether the current token begins a line."""
        return self.toks[self.pos][4]

    # -- structure

    def root(self) -> Node:
        root = Node(_ROOT[self.lang], 0, len(self.s))
        while self.kind != "eof":
            root.children += self.step(self.statement)
        return root

    def step(self, f) -> list[Node]:
        """What ``f`` gives; a token that it can't use becomes an ERROR."""
        before = self.pos
        got = f()
        if self.pos == before:
            k, t, a, b, _ = self.toks[self.pos]
            if k == "eof":
                return []
            self.pos += 1
            return [Node("ERROR", a, b, [Node(t, a, b, named=False)])]
        return got if isinstance(got, list) else [got] if got is not None else []

    def braces(self, kind: str, item, field: str | None = "body") -> Node:
        kids = [self.leaf()]
        while self.kind != "eof" and not self.is_("}"):
            kids += self.step(item)
        self.need("}", kids)
        return inner(kind, kids, field)

    def block(self, field: str | None = "body") -> Node:
        return self.braces(_BLOCK.get(self.lang, "block"), self.statement, field)

    def group(self, kind: str, field: str | None = None, item: str = "") -> Node:
        """Bracketed, comma-separated expressions (or parameters); missing where no bracket opens."""
        if self.text not in _CLOSE:
            return Node(kind, self.here(), self.here(), field=field, missing=True)
        close = _CLOSE[self.text]
        kids = [self.leaf()]
        while self.kind != "eof" and not self.is_(close):
            if self.is_("}", ")", "]"):
                break
            if self.is_(",", ";"):
                kids.append(self.leaf())
            elif item:
                kids += self.step(lambda: self.parameter(item, close))
            else:
                kids += self.step(lambda: self.expr((",", close), True))
        self.need(close, kids)
        return inner(kind, kids, field)

    def parameter(self, kind: str, close: str) -> Node | None:
        kids, depth = [], 0
        while self.kind != "eof" and not (depth == 0 and self.is_(",", close)):
            if self.is_("(", "[", "{"):
                kids.append(self.group("parenthesized" if self.is_("(") else "pattern"))
                continue
            if self.is_(":") and depth == 0 and self.lang in ("typescript", "tsx"):
                self.type_note(kids, (",", close, "="))
                continue
            depth += self.is_("<")
            depth -= self.is_(">") and depth > 0
            if self.is_(")", "}", "]"):
                break
            kids.append(self.primary() or self.leaf())
        if not kids:
            return None
        return kids[0] if len(kids) == 1 and kids[0].named else inner(kind, kids)

    def end(self, kids: list[Node]) -> None:
        if self.is_(";"):
            kids.append(self.leaf())

    def statement(self) -> Node | list[Node] | None:
        if self.kind == "pre":
            return self.preproc()
        if self.is_("{"):
            return self.block(None)
        if self.is_(";"):
            return inner("empty_statement", [self.leaf()])
        return getattr(self, "_js" if self.lang in _JS else f"_{self.lang}")()

    def control(self) -> Node | None:
        """if, for, while, return and the like, for all languages."""
        t = self.text
        if t in ("if", "for", "while", "switch", "match", "loop", "when", "do", "try", "unsafe", "select", "synchronized", "catch", "finally") and t in self.keys:
            kids = [self.leaf()]
            if self.is_("("):
                kids.append(self.group("parenthesized_expression", "condition"))
            stop = 0
            while self.kind != "eof" and not self.is_("{", "}", ";") and stop < 200 and not (kids[-1].kind == "parenthesized_expression"):
                kids += self.step(lambda: self.simple(("{", ";"), False))
                if self.is_(";"):
                    kids.append(self.leaf())
                stop += 1
            if self.is_("{") and t == "match" and self.lang == "rust":
                kids.append(self.braces("match_block", self.match_arm))
            elif self.is_("{"):
                kids.append(self.block("consequence" if t == "if" else "body"))
            elif kids[-1].kind == "parenthesized_expression" and self.kind != "eof" and not self.is_("}"):
                kids += self.step(self.statement)
            while self.is_("else", "catch", "finally") or t == "do" and self.is_("while"):
                if self.is_("else"):
                    sub = [self.leaf()]
                    sub += self.step(self.statement)
                    kids.append(inner("else_clause", sub, "alternative"))
                elif self.is_("while"):
                    kids += [self.leaf(), *self.step(lambda: self.expr((";",), True))]
                else:
                    sub = [self.leaf()]
                    if self.is_("("):
                        sub.append(self.group("catch_parameters"))
                    if self.is_("{"):
                        sub.append(self.block())
                    kids.append(inner(f"{sub[0].kind}_clause", sub))
            self.end(kids) if t == "do" else None
            return inner({"match": "match_expression", "loop": "loop_expression", "when": "when_expression"}.get(t, f"{t}_statement"), kids)
        if self.lang in _CASES and (t == "case" or t == "default" and self.peek() in (":", "->")):
            kids = [self.leaf()]
            if t == "case":
                kids += self.step(lambda: self.simple((":", "->"), True) if self.lang == "go" else self.listed((":", "->"), True))
            if self.is_("->"):
                kids.append(self.leaf())
                return inner("switch_rule", kids + self.step(self.statement))
            self.need(":", kids)
            while self.kind != "eof" and not self.is_("case", "default", "}"):
                kids += self.step(self.statement)
            return inner(_CASES[self.lang][t == "default"], kids)
        if t in ("return", "break", "continue", "throw", "goto", "defer", "go") and t in self.keys:
            kids = [self.leaf()]
            if not self.is_(";", "}") and self.kind != "eof" and not self.fresh():
                kids += self.step(lambda: self.listed((";",), False) if self.lang == "go" else self.expr((";",), False))
            self.end(kids)
            return inner(f"{t}_statement", kids)
        return None

    def expression_statement(self) -> Node | None:
        if self.is_("}", ")", "]") or self.kind == "eof":
            return None
        before = self.pos
        e = self.simple((";",), False)
        if e is None or self.pos == before:
            return None
        kids = [e]
        self.end(kids)
        return inner("expression_statement", kids)

    def listed(self, stops: tuple[str, ...], multiline: bool) -> Node | None:
        """Expressions with commas between them."""
        kids: list[Node] = []
        while (e := self.expr(stops, multiline)) is not None:
            kids.append(e)
            if not self.is_(","):
                break
            kids.append(self.leaf())
        return inner("expression_list", kids) if kids else None

    def simple(self, stops: tuple[str, ...], multiline: bool) -> Node | None:
        """A statement's expression; in Go it may be a list, or assign one to another."""
        if self.lang != "go":
            return self.expr(stops, multiline)
        left = self.listed((*stops, *_ASSIGN), multiline)
        if left is not None and self.is_(*_ASSIGN):
            what = "short_var_declaration" if self.is_(":=") else "assignment_statement"
            kids = [left.at("left"), self.leaf()]
            right = self.listed(stops, multiline)
            return inner(what, kids + ([right.at("right")] if right else []))
        return left.children[0] if left is not None and len(left.children) == 1 else left

    def match_arm(self) -> Node | None:
        kids: list[Node] = []
        while self.is_("#"):
            kids.append(inner("attribute_item", [self.leaf(), *([self.group("attribute")] if self.is_("[") else [])]))
        pattern: list[Node] = []
        while self.kind != "eof" and not self.is_("=>", "}"):
            if self.is_("(", "[", "{"):
                pattern.append(self.group("pattern"))
            elif self.is_(")", "]"):
                return None
            else:
                pattern.append(self.primary() or self.leaf())
        if not pattern:
            return None
        kids.append(inner("match_pattern", pattern, "pattern"))
        self.need("=>", kids)
        if self.is_("{"):
            kids.append(self.block(None).at("value"))
        else:
            kids += [x.at("value") for x in self.step(lambda: self.expr((",",), True))]
        if self.is_(","):
            kids.append(self.leaf())
        return inner("match_arm", kids)

    # -- expressions

    def string(self) -> Node:
        _, t, a, b, _ = self.toks[self.pos]
        self.pos += 1
        m = re.match(r'[A-Za-z]*("""|["\'`])', t)
        q = m[1]
        closed = len(t) >= m.end() + len(q) and t.endswith(q)
        stop = len(t) - len(q) if closed else len(t)
        tick = q == "`"
        kind = ("template_string" if tick else "string") if self.lang in _JS else "raw_string_literal" if tick else {"rust": "string_literal", "go": "interpreted_string_literal", "java": "string_literal", "c": "string_literal", "kotlin": "string_literal"}[self.lang] if q != "'" or self.lang in _JS else "character_literal"
        kids = [Node(t[: m.end()], a, a + m.end(), named=False)]
        if stop > m.end():
            kids.append(Node("string_fragment" if self.lang in _JS else "string_content", a + m.end(), a + stop))
        kids.append(Node(q, a + stop, b, named=False, missing=not closed))
        return Node(kind, a, b, kids)

    def primary(self) -> Node | None:
        k, t, a, b, _ = self.toks[self.pos]
        if k == "str":
            return self.string()
        if k == "num":
            self.pos += 1
            return Node({"javascript": "number", "typescript": "number", "tsx": "number", "c": "number_literal"}.get(self.lang, "float_literal" if "." in t else "integer_literal" if self.lang == "rust" else "int_literal" if self.lang == "go" else "decimal_integer_literal"), a, b)
        if k == "name":
            if t in ("true", "false", "null", "nil", "undefined", "this", "self", "super"):
                self.pos += 1
                return Node({"nil": "nil"}.get(t, t), a, b)
            if t in self.keys:
                return None
            self.pos += 1
            return Node("identifier", a, b)
        if t == "(":
            return self.group("parenthesized_expression")
        if t == "[":
            return self.group("array" if self.lang in _JS else "array_expression")
        return None

    def _arrow_ahead(self) -> bool:
        """Whether a ``(`` begins the parameters of an arrow function."""
        depth, i = 0, self.pos
        while i < len(self.toks) - 1:
            t = self.toks[i][1]
            depth += t in "([{" and t != ""
            depth -= t in ")]}" and t != ""
            i += 1
            if depth == 0:
                nxt = self.toks[i][1]
                return nxt == "=>" or nxt == ":" and any(x[1] == "=>" for x in self.toks[i : i + 12])
        return False

    def expr(self, stops: tuple[str, ...], multiline: bool) -> Node | None:
        """A chain of operands and operators up to a stop, a closing bracket or the end of the statement."""
        left = self.operand(stops)
        if left is None:
            return None
        while self.kind != "eof" and not self.is_(*stops) and not self.is_(")", "]", "}", ",", ";"):
            if not multiline and self.lang in _NEWLINE_ENDS and self.fresh() and not self.is_(".", "?.", "&&", "||", "?", "+", "??", "|"):
                break
            t = self.text
            if t == "=" or self.kind == "op" and t.endswith("=") and t not in ("==", "===", "!=", "!==", "<=", ">="):
                op = self.leaf()
                right = self.expr(stops, multiline)
                kids = [left.at("left"), op] + ([right.at("right")] if right else [])
                left = inner("short_var_declaration" if t == ":=" else "assignment_expression", kids)
            elif t in _BINARY:
                op = self.leaf().at("operator")
                right = self.operand(stops)
                kids = [left.at("left"), op, right.at("right") if right else Node("identifier", self.here(), self.here(), missing=True)]
                left = inner("binary_expression", kids)
            elif t == "?" and self.lang in (*_JS, "java", "c"):
                kids = [left.at("condition"), self.leaf()]
                kids += self.step(lambda: self.expr((":", *stops), True))
                if self.is_(":"):
                    kids.append(self.leaf())
                    kids += self.step(lambda: self.expr(stops, multiline))
                left = inner("ternary_expression", kids)
            elif t in ("++", "--", "!", "?"):
                left = inner("update_expression", [left, self.leaf()])
            elif t == ":":
                if self.lang == "javascript" and not left.kind == "identifier":
                    break
                kids = [left, self.leaf()]
                kids += self.step(lambda: self.expr(stops, multiline))
                left = inner("labeled", kids)
            elif self.kind in ("name", "str", "num") or t in ("{", "(", "[", "<", "=>", "->", "::", "&", "*", "@", "#"):
                nxt = self.operand(stops)
                if nxt is None:
                    break
                left = inner("juxtaposition", [left, nxt])
            else:
                bad = self.leaf()
                left = inner("juxtaposition", [left, Node("ERROR", bad.start, bad.end, [bad])])
        return left

    def operand(self, stops: tuple[str, ...]) -> Node | None:
        t = self.text
        if self.kind == "eof" or self.is_(*stops) or t in (")", "]", "}", ",", ";"):
            return None
        js = self.lang in _JS
        if t == "<" and not self.types and (self.lang == "typescript" or self.lang == "tsx" and self.peek(2) in (",", "extends")):
            kids = []
            self.skip_generics(kids)
            if not (self.is_("(") and self._arrow_ahead()):
                rest = self.operand(stops)
                return inner("type_assertion", kids + ([rest] if rest else []))
            kids.append(self.group("formal_parameters", "parameters", "required_parameter"))
            self.type_note(kids, ("=>",), "return_type")
            return self.arrow(kids, stops)
        if t == "<" and self.lang in ("javascript", "tsx") and not self.types and (self.toks[self.pos + 1][0] == "name" or self.peek() == ">"):
            return self.postfix(self.element(), stops)
        if js and (t == "function" or t == "async" and self.peek() == "function"):
            return self.js_function("function_expression", [])
        if js and t == "class":
            return self.js_class("class", [])
        if js and t == "(" and self._arrow_ahead():
            kids = [self.group("formal_parameters", "parameters", "required_parameter" if self.lang != "javascript" else "assignment_pattern")]
            self.type_note(kids, ("=>",), "return_type")
            return self.arrow(kids, stops)
        if js and self.kind == "name" and self.peek() == "=>":
            kids: list[Node] = []
            self.ident(kids, field="parameter")
            return self.arrow(kids, stops)
        if self.lang == "rust" and t in ("|", "||"):
            kids = [self.leaf()]
            if t == "|":
                while self.kind != "eof" and not self.is_("|", "}", ";"):
                    kids.append(self.group("pattern") if self.is_("(", "[") else self.primary() or self.leaf())
                self.need("|", kids)
            if self.is_("->"):
                self.until(kids, ("{",), "return_type")
            body = self.block(None) if self.is_("{") else self.expr(stops, True)
            return inner("closure_expression", kids + ([body.at("body")] if body else []))
        if t in ("-", "+", "!", "~", "&", "*", "**", "++", "--", "typeof", "await", "new", "delete", "void", "yield", "ref", "mut", "move", "dyn", "...", "..", "throw", "@", "#", "&&", "static", "const", "async", "in", "as", "case", "default", "func", "fun", "struct", "interface", "map", "chan", "enum", "where", "crate", "sizeof", "object", "range", "=>", "->", "::", "<", "is", "of", "let", "val", "var"):
            op = self.leaf()
            if t == "func" and self.is_("("):
                kids = [op, self.group("parameter_list", "parameters", "parameter_declaration")]
                while self.kind != "eof" and not self.is_("{", ";", ")", ",", "}") and not self.fresh():
                    kids.append(self.primary() or self.leaf())
                if self.is_("{"):
                    kids.append(self.block())
                return inner("func_literal", kids)
            rest = self.operand(stops)
            return inner("unary_expression", [op] + ([rest.at("argument")] if rest else []))
        if t == "{":
            return self.object_or_block()
        if self.kind == "bad" or t in ("@", "$", "#"):
            bad = self.leaf()
            return Node("ERROR", bad.start, bad.end, [bad])
        c = self.control() if t in ("if", "match", "loop", "when", "switch", "unsafe", "try") and not js else None
        node = c or self.primary()
        if node is None:
            if self.kind == "name":  # a keyword where an operand should be
                if js or self.lang in ("java", "go"):
                    bad = self.leaf()
                    return Node("ERROR", bad.start, bad.end, [bad])
                leaf = self.leaf()
                return Node("identifier", leaf.start, leaf.end)
            return None
        return self.postfix(node, stops)

    def postfix(self, node: Node, stops: tuple[str, ...]) -> Node:
        js = self.lang in _JS
        while self.kind != "eof":
            if self.is_(".", "?.", "::") and self.toks[self.pos + 1][0] in ("name", "num"):
                kids = [node.at("object"), self.leaf()]
                self.ident(kids, "property_identifier" if js else "field_identifier", "property") if self.kind == "name" else kids.append(self.primary())
                node = inner("member_expression" if js else {"go": "selector_expression", "java": "field_access", "kotlin": "navigation_expression"}.get(self.lang, "scoped_identifier" if kids[1].kind == "::" else "field_expression"), kids)
            elif self.is_("<") and self.lang in ("typescript", "tsx") and self._generics_ahead(("(", *(stops if "{" in stops else ()))):
                kids = [node.at("name")]
                self.skip_generics(kids, "type_arguments")
                node = inner("instantiation_expression", kids)
            elif self.is_(".") and self.lang == "go" and self.peek() == "(":
                kids = [node.at("operand"), self.leaf(), self.leaf()]
                self.until(kids, (")",), "type") if not self.is_("type") else kids.append(self.leaf())
                self.need(")", kids)
                node = inner("type_assertion_expression", kids)
            elif js and self.is_("?.") and self.peek() in ("(", "["):
                chain = inner("optional_chain", [self.leaf()], "optional_chain")
                node = inner("call_expression", [node.at("function"), chain, self.group("arguments", "arguments")]) if self.is_("(") else inner("subscript_expression", [node.at("object"), chain, self.group("index", "index")])
            elif self.is_("!") and self.lang == "rust" and self.peek() in ("(", "[", "{"):
                kids = [node.at("macro"), self.leaf()]
                kids.append(self.group("token_tree"))
                node = inner("macro_invocation", kids)
            elif self.is_("(") and not self.fresh():
                node = inner("method_invocation" if self.lang == "java" else "call_expression", [node.at("function"), self.group("arguments" if js or self.lang == "rust" else "argument_list", "arguments")])
            elif self.is_("[") and not self.fresh():
                node = inner("subscript_expression" if js or self.lang == "c" else "index_expression", [node.at("object"), self.group("index", "index")])
            elif self.kind == "str" and self.toks[self.pos][1].startswith("`") and js:
                node = inner("call_expression", [node.at("function"), self.string().at("arguments")])
            elif self.is_("{") and self.lang in ("rust", "go", "kotlin") and "{" not in stops and not self.fresh() and node.kind in ("identifier", "self", "call_expression", "scoped_identifier"):
                body = self.object_or_block()
                node = inner({"rust": "struct_expression", "go": "composite_literal"}.get(self.lang, "call_expression"), [node.at("name"), body.at("body")])
            else:
                return node
        return node

    def element_name(self, kids: list[Node], field: str | None, kind: str = "identifier") -> None:
        """A name with dots, colons or hyphens in it."""
        a = b = self.here() if self.kind != "name" else self.toks[self.pos][2]
        while self.kind == "name" or self.is_(".", "-", ":", "--"):
            b = self.toks[self.pos][3]
            self.pos += 1
            if self.toks[self.pos][2] != b:
                break
        kids.append(Node(kind, a, b, field=field, missing=a == b))

    def embedded(self) -> Node:
        """``{expression}``, ``{...spread}`` or ``{}``."""
        kids = [self.leaf()]
        while self.kind != "eof" and not self.is_("}"):
            kids += [self.leaf()] if self.is_(",") else self.step(lambda: self.expr((), True))
        self.need("}", kids)
        return inner("jsx_expression", kids)

    def element(self) -> Node:
        """An element with its text, or a fragment; text is read as it stands, tokens begin anew behind it."""
        opened: list[tuple[Node, list[Node]]] = []
        while True:
            kids = [self.leaf()]
            if not self.is_(">"):
                self.element_name(kids, "name")
                if self.is_("<"):
                    self.skip_generics(kids)
            while self.kind != "eof" and not self.is_(">", "/", "<", "/>"):
                if self.is_("{"):
                    kids.append(self.embedded())
                elif self.kind == "name":
                    sub: list[Node] = []
                    self.element_name(sub, None, "property_identifier")
                    if self.is_("="):
                        sub.append(self.leaf())
                        sub += [self.string()] if self.kind == "str" else [self.embedded()] if self.is_("{") else [self.element()] if self.is_("<") else []
                    kids.append(inner("jsx_attribute", sub, "attribute"))
                else:
                    bad = self.leaf()
                    kids.append(Node("ERROR", bad.start, bad.end, [bad]))
            closed = self.is_("/", "/>")
            if self.is_("/"):
                kids.append(self.leaf())
            if self.text.startswith(">") and self.kind == "op":  # what follows may be lexed as one with it
                a = self.toks[self.pos][2]
                kids.append(Node(">", a, a + 1, named=False))
                self.pos += 1
            else:
                self.need("/>" if self.is_("/>") else ">", kids)
            node: Node | None = inner("jsx_self_closing_element" if closed else "jsx_opening_element", kids)
            at = node.end
            if not closed:
                node.field = "open_tag"
                opened.append((node, [node]))
                node = None
            while opened:
                own = opened[-1][1]
                if node is not None:
                    own.append(node)
                    node = None
                stop = at
                while stop < len(self.s) and self.s[stop] not in "<{":
                    stop += 1
                if stop > at:
                    own.append(Node("jsx_text", at, stop))
                    self.texts.append(own[-1])
                self.seek(stop)
                if stop >= len(self.s) or self.kind == "eof":
                    own.append(Node("jsx_closing_element", stop, stop, field="close_tag", missing=True))
                elif self.is_("{"):
                    own.append(self.embedded())
                    at = own[-1].end
                    continue
                elif self.s.startswith("</", stop):
                    sub = [self.leaf()] if self.is_("</") else [self.leaf(), self.leaf()]
                    if self.kind == "name":
                        self.element_name(sub, "name")
                    if self.text.startswith(">") and self.kind == "op":
                        a = self.toks[self.pos][2]
                        sub.append(Node(">", a, a + 1, named=False))
                        self.pos += 1
                    else:
                        self.need(">", sub)
                    own.append(inner("jsx_closing_element", sub, "close_tag"))
                else:
                    break  # a child begins
                opened.pop()
                node = inner("jsx_element", own)
                at = node.end
            if not opened:
                self.seek(at)
                return node

    def arrow(self, kids: list[Node], stops: tuple[str, ...]) -> Node:
        kids.append(self.leaf())
        if self.is_("{"):
            kids.append(self.block())
        else:
            e = self.expr(stops, True)
            if e:
                kids.append(e.at("body"))
        return inner("arrow_function", kids)

    def object_or_block(self) -> Node:
        js = self.lang in _JS
        if js and self.types:
            return self.braces("object_type", self.ts_property, None)
        if not js and self.lang != "go" and not (self.lang == "rust" and (self.peek(2) in (":", ",") or self.peek() == "}")):
            return self.block(None)
        kids = [self.leaf()]
        while self.kind != "eof" and not self.is_("}"):
            if self.is_(",", ";"):
                kids.append(self.leaf())
                continue
            if js and self.toks[self.pos + 1][1] == "(" and self.kind == "name" or js and self.text in ("get", "set", "async") and self.toks[self.pos + 1][0] == "name":
                kids += self.step(self.js_member)
                continue
            if self.toks[self.pos + 1][1] == ":" and self.kind in ("name", "str", "num"):
                sub: list[Node] = []
                if self.kind == "name":
                    self.ident(sub, "property_identifier" if js else "field_identifier", "key" if js else "field")
                else:
                    sub.append(self.primary().at("key"))
                sub.append(self.leaf())
                v = self.expr((",", "}"), True)
                if v:
                    sub.append(v.at("value"))
                kids.append(inner("pair" if js else {"rust": "field_initializer", "go": "keyed_element"}[self.lang], sub))
                continue
            kids += self.step(lambda: self.expr((",", "}"), True))
        self.need("}", kids)
        return inner("object" if js else {"rust": "field_initializer_list", "go": "literal_value"}.get(self.lang, "block"), kids)

    def type_note(self, kids: list[Node], stops: tuple[str, ...], field: str = "type") -> None:
        """``: Type`` up to a stop."""
        if not self.is_(":"):
            return
        sub, depth = [self.leaf()], 0
        while self.kind != "eof" and not (depth == 0 and (self.is_(*stops) or self.is_(";", ",", ")", "}"))):
            if self.is_("{", "(", "["):
                if depth == 0 and self.is_("{") and "{" in stops:
                    break
                self.types += 1
                sub.append(self.braces("object_type", self.ts_property, None) if self.is_("{") and self.lang in _JS else self.group("object_type"))
                self.types -= 1
                continue
            if self.fresh() and depth == 0 and len(sub) > 1 and not self.is_("|", "&"):
                break
            depth += self.is_("<")
            depth -= self.is_(">")
            if self.kind == "name":
                a, b = self.toks[self.pos][2:4]
                t = self.toks[self.pos][1]
                self.pos += 1
                sub.append(Node("predefined_type" if t in ("string", "number", "boolean", "any", "void", "never", "unknown", "object") else "type_identifier", a, b))
            else:
                sub.append(self.primary() if self.kind in ("str", "num") else self.leaf())
        kids.append(inner("type_annotation", sub, field))

    # -- JavaScript and TypeScript

    def js_function(self, kind: str, kids: list[Node]) -> Node:
        while self.is_("async", "function", "*"):
            kids.append(self.leaf())
        if self.kind == "name" and not self.is_("function"):
            self.ident(kids)
        elif kind == "function_declaration":
            self.ident(kids)
        self.skip_generics(kids)
        if self.is_("("):
            kids.append(self.group("formal_parameters", "parameters", "assignment_pattern" if self.lang == "javascript" else "required_parameter"))
        else:
            kids.append(Node("formal_parameters", self.here(), self.here(), field="parameters", missing=True))
        self.type_note(kids, ("{",), "return_type")
        if self.is_("{"):
            kids.append(self.block())
        elif kind == "function_declaration" and self.lang != "javascript":
            self.end(kids)
            return inner("function_signature", kids)
        else:
            kids.append(Node("statement_block", self.here(), self.here(), field="body", missing=True))
        return inner(kind, kids)

    def skip_generics(self, kids: list[Node], kind: str = "type_parameters") -> None:
        if self.is_("<"):
            sub, depth = [], 0
            while self.kind != "eof":
                if self.lang in ("typescript", "tsx") and self.is_("{", "(", "["):
                    self.types += 1
                    sub.append(self.braces("object_type", self.ts_property, None) if self.is_("{") else self.group("tuple_type" if self.is_("[") else "parenthesized_type"))
                    self.types -= 1
                    continue
                depth += self.is_("<")
                depth -= self.is_(">")
                done = self.is_(">") and depth == 0
                if self.kind == "name":
                    self.ident(sub, "type_identifier", None)
                elif self.kind in ("str", "num"):
                    sub.append(self.primary())
                else:
                    sub.append(self.leaf())
                if done or self.is_("}", ";") or self.is_("{") and self.lang not in ("typescript", "tsx"):
                    break
            kids.append(inner(kind, sub, kind))

    def _generics_ahead(self, after: tuple[str, ...]) -> bool:
        """Whether a ``<`` opens type arguments: it closes over what types are made of, with one of ``after`` behind."""
        depth = 0
        for i in range(self.pos, min(self.pos + 200, len(self.toks) - 1)):
            k, t, *_ = self.toks[i]
            if k == "op" and t not in ("<", ">", ",", ".", "|", "&", "[", "]", "{", "}", ":", ";", "?", "=>", "(", ")"):
                return False
            depth += k == "op" and t in "<([{"
            depth -= k == "op" and t in ">)]}"
            if depth == 0:
                return t == ">" and self.toks[i + 1][1] in after
            if depth < 0:
                return False
        return False

    def js_class(self, kind: str, kids: list[Node]) -> Node:
        while self.is_("abstract", "class"):
            kids.append(self.leaf())
        if self.kind == "name" and not self.is_("extends", "implements"):
            self.ident(kids, "identifier" if self.lang == "javascript" else "type_identifier")
        elif kind == "class_declaration":
            self.ident(kids)
        self.skip_generics(kids)
        if self.is_("extends", "implements"):
            sub = []
            while self.kind != "eof" and not self.is_("{", "}", ";"):
                sub += [self.leaf()] if self.is_("extends", "implements", ",") else self.step(lambda: self.expr(("{", "implements", ","), True))
            kids.append(inner("class_heritage", sub))
        if self.is_("{"):
            kids.append(self.braces("class_body", self.js_member))
        else:
            kids.append(Node("class_body", self.here(), self.here(), field="body", missing=True))
        return inner(kind, kids)

    def js_member(self) -> Node | None:
        if self.is_(";"):
            return self.leaf()
        kids: list[Node] = []
        while self.is_("static", "async", "get", "set", "*", "readonly", "private", "public", "protected", "abstract", "override", "declare") and self.peek() not in ("(", "=", ";", ":", "?"):
            kids.append(self.leaf())
        if self.is_("@"):
            kids.append(inner("decorator", [self.leaf(), *self.step(lambda: self.operand(()))]))
            return kids[-1] if len(kids) == 1 else inner("decorator", kids)
        if self.is_("#"):
            a = self.leaf()
            self.ident(kids, "private_property_identifier")
            kids[-1].start = a.start
        elif self.kind == "name":
            self.ident(kids, "property_identifier")
        elif self.kind in ("str", "num"):
            kids.append(self.primary().at("name"))
        elif self.is_("["):
            kids.append(self.group("computed_property_name", "name"))
        else:
            return kids[0] if kids else None
        if self.is_("?", "!"):
            kids.append(self.leaf())
        self.skip_generics(kids)
        if self.is_("("):
            kids.append(self.group("formal_parameters", "parameters", "assignment_pattern" if self.lang == "javascript" else "required_parameter"))
            self.type_note(kids, ("{",), "return_type")
            if self.is_("{"):
                kids.append(self.block())
                return inner("method_definition", kids)
            self.end(kids)
            return inner("method_signature", kids)
        self.type_note(kids, ("=",))
        if self.is_("="):
            kids.append(self.leaf())
            v = self.expr((";",), False)
            if v:
                kids.append(v.at("value"))
        self.end(kids)
        return inner("field_definition" if self.lang == "javascript" else "public_field_definition", kids)

    def js_variables(self, kind: str) -> Node:
        kids = [self.leaf()]
        while self.kind != "eof":
            sub: list[Node] = []
            if self.is_("{", "["):
                sub.append(self.group("object_pattern" if self.is_("{") else "array_pattern", "name"))
            else:
                self.ident(sub)
            self.type_note(sub, ("=",))
            if self.is_("="):
                sub.append(self.leaf())
                v = self.expr((",", ";"), False)
                sub.append(v.at("value") if v else Node("identifier", self.here(), self.here(), missing=True))
            kids.append(inner("variable_declarator", sub))
            if not self.is_(","):
                break
            kids.append(self.leaf())
        self.end(kids)
        return inner(kind, kids)

    def _js(self) -> Node | list[Node] | None:
        t, ts = self.text, self.lang != "javascript"
        if self.kind == "name" and t not in self.keys and self.peek() == ":":
            kids = []
            self.ident(kids, "statement_identifier", "label")
            kids.append(self.leaf())
            return inner("labeled_statement", kids + [x.at("body") for x in self.step(self.statement)])
        if t == "import" and self.peek() not in ("(", "."):
            kids = [self.leaf()]
            while self.kind != "eof" and self.kind != "str" and not self.is_(";"):
                if self.is_("{"):
                    kids.append(inner("import_clause", [self.group("named_imports")]))
                elif self.kind == "name" and not self.is_("from", "as", "type"):
                    sub: list[Node] = []
                    self.ident(sub, field=None)
                    kids.append(inner("import_clause", sub))
                else:
                    kids.append(self.leaf())
            if self.kind == "str":
                kids.append(self.string().at("source"))
            else:
                kids.append(Node("string", self.here(), self.here(), field="source", missing=True))
            self.end(kids)
            return inner("import_statement", kids)
        if t == "export":
            kids = [self.leaf()]
            if self.is_("default"):
                kids.append(self.leaf())
                if self.is_("function", "async", "class", "abstract", "interface"):
                    kids += [x.at("declaration") for x in self.step(self._js)]
                else:
                    kids += [x.at("value") for x in self.step(lambda: self.expr((";",), False))]
                    self.end(kids)
                return inner("export_statement", kids)
            if self.is_("*", "{", "type") and not (self.is_("type") and self.toks[self.pos + 1][0] == "name"):
                if self.is_("*"):
                    kids.append(self.leaf())
                    if self.is_("as"):
                        sub = [self.leaf()]
                        self.ident(sub, field=None)
                        kids.append(inner("namespace_export", sub))
                else:
                    if self.is_("type"):
                        kids.append(self.leaf())
                    kids.append(self.group("export_clause"))
                if self.is_("from"):
                    kids.append(self.leaf())
                    if self.kind == "str":
                        kids.append(self.string().at("source"))
                self.end(kids)
                return inner("export_statement", kids)
            kids += [x.at("declaration") for x in self.step(self._js)]
            return inner("export_statement", kids)
        if t == "function" or t == "async" and self.peek() == "function":
            star = self.peek() == "*"
            return self.js_function("generator_function_declaration" if star else "function_declaration", [])
        if t == "class" or t == "abstract" and self.peek() == "class":
            return self.js_class("class_declaration" if t == "class" else "abstract_class_declaration", [])
        if t in ("const", "let") or t == "var":
            if t == "const" and self.peek() == "enum":
                return self.ts_enum([self.leaf()])
            return self.js_variables("variable_declaration" if t == "var" else "lexical_declaration")
        if ts and t == "interface" and self.toks[self.pos + 1][0] == "name":
            kids = [self.leaf()]
            self.ident(kids, "type_identifier")
            self.skip_generics(kids)
            if self.is_("extends"):
                sub = [self.leaf()]
                while self.kind != "eof" and not self.is_("{"):
                    sub += [self.leaf()] if self.is_(",") else self.step(lambda: self.expr(("{", ","), True))
                kids.append(inner("extends_type_clause", sub))
            if self.is_("{"):
                kids.append(self.braces("interface_body", self.ts_property))
            return inner("interface_declaration", kids)
        if ts and t == "type" and self.toks[self.pos + 1][0] == "name" and self.peek(2) in ("=", "<"):
            kids = [self.leaf()]
            self.ident(kids, "type_identifier")
            self.skip_generics(kids)
            if self.is_("="):
                kids.append(self.leaf())
                self.types += 1
                kids += [x.at("value") for x in self.step(lambda: self.expr((";",), False))]
                self.types -= 1
            self.end(kids)
            return inner("type_alias_declaration", kids)
        if ts and t == "enum":
            return self.ts_enum([])
        if ts and t == "declare":
            return inner("ambient_declaration", [self.leaf(), *self.step(self._js)])
        if ts and t in ("namespace", "module") and self.toks[self.pos + 1][0] in ("name", "str"):
            kids = [self.leaf()]
            self.ident(kids) if self.kind == "name" else kids.append(self.string().at("name"))
            if self.is_("{"):
                kids.append(self.block())
            return inner("internal_module", kids)
        return self.control() or self.expression_statement()

    def ts_property(self) -> Node | None:
        if self.is_(",", ";"):
            return self.leaf()
        return self.js_member()

    def ts_enum(self, kids: list[Node]) -> Node:
        kids.append(self.leaf())
        self.ident(kids)
        if self.is_("{"):
            kids.append(self.group("enum_body", "body"))
        return inner("enum_declaration", kids)

    # -- Rust

    def _rust(self) -> Node | list[Node] | None:
        kids: list[Node] = []
        if self.is_("#"):
            kids = [self.leaf()]
            if self.is_("!"):
                kids.append(self.leaf())
            if self.is_("["):
                kids.append(self.group("attribute"))
            return inner("attribute_item", kids)
        if self.is_("pub"):
            sub = [self.leaf()]
            if self.is_("("):
                sub.append(self.group("scope"))
            kids.append(inner("visibility_modifier", sub))
        while self.is_("async", "unsafe", "extern", "const") and self.peek() in ("fn", "unsafe", "extern", "impl", "trait") or self.is_("extern") and self.toks[self.pos + 1][0] == "str":
            kids.append(self.leaf())
            if self.kind == "str":
                kids.append(self.string())
        t = self.text
        if t == "fn":
            kids.append(self.leaf())
            self.ident(kids)
            self.skip_generics(kids)
            if self.is_("("):
                kids.append(self.group("parameters", "parameters", "parameter"))
            self.until(kids, ("{", ";"), "return_type")
            if self.is_("{"):
                kids.append(self.block())
            else:
                self.end(kids)
                return inner("function_signature_item", kids)
            return inner("function_item", kids)
        if t in ("struct", "enum", "union", "trait", "mod") and self.toks[self.pos + 1][0] == "name":
            kids.append(self.leaf())
            self.ident(kids, "identifier" if t == "mod" else "type_identifier")
            self.skip_generics(kids)
            if self.is_("("):
                kids.append(self.group("ordered_field_declaration_list", "body", "field"))
            self.until(kids, ("{", ";"), None)
            if self.is_("{"):
                kids.append(self.group("field_declaration_list" if t != "enum" else "enum_variant_list", "body", "field_declaration" if t != "enum" else "enum_variant") if t in ("struct", "enum", "union") else self.braces("declaration_list", self.statement))
            self.end(kids)
            return inner(f"{t}_item", kids)
        if t == "impl":
            kids.append(self.leaf())
            self.skip_generics(kids)
            names: list[Node] = []
            while self.kind != "eof" and not self.is_("{", ";"):
                if self.kind == "name" and self.text not in self.keys:
                    self.ident(names, "type_identifier", "trait" if any(x[1] == "for" for x in self.toks[self.pos : self.pos + 12] if x[1] in ("for", "{")) and self.text and "for" in [x[1] for x in self.toks[self.pos : self.pos + 12]][: next((i for i, x in enumerate(self.toks[self.pos : self.pos + 12]) if x[1] == "{"), 12)] else "type")
                    kids.append(names[-1])
                else:
                    kids.append(self.leaf())
            if self.is_("{"):
                kids.append(self.braces("declaration_list", self.statement))
            return inner("impl_item", kids)
        if t == "use" or t == "type" or t in ("const", "static") or t == "let":
            kids.append(self.leaf())
            if t == "use":
                self.until(kids, (";",), "argument", "use_path")
            else:
                while self.is_("mut", "ref"):
                    kids.append(self.leaf())
                if t == "let" and self.kind == "name" and self.peek() in ("{", "(", "::"):
                    sub: list[Node] = []
                    while self.kind != "eof" and not self.is_("=", ":", ";", "}"):
                        sub.append(self.group("pattern") if self.is_("(", "[", "{") else self.primary() or self.leaf())
                    kids.append(inner("struct_pattern" if sub[-1].children and sub[-1].children[0].kind == "{" else "tuple_struct_pattern", sub, "pattern"))
                elif self.kind == "name":
                    self.ident(kids, "type_identifier" if t == "type" else "identifier", "pattern" if t == "let" else "name")
                elif self.is_("(", "["):
                    kids.append(self.group("tuple_pattern", "pattern"))
                if self.is_(":"):
                    kids.append(self.leaf())
                    self.until(kids, ("=", ";"), "type", "type_identifier")
                if self.is_("="):
                    kids.append(self.leaf())
                    kids += [x.at("value") for x in self.step(lambda: self.expr((";", "else"), True))]
                if t == "let" and self.is_("else"):
                    kids += [self.leaf(), *([self.block("alternative")] if self.is_("{") else [])]
            self.end(kids)
            return inner({"use": "use_declaration", "type": "type_item", "let": "let_declaration"}.get(t, f"{t}_item"), kids)
        if kids:
            return inner("ERROR", kids)
        return self.control() or self.expression_statement()

    def until(self, kids: list[Node], stops: tuple[str, ...], field: str | None, kind: str = "type") -> None:
        """Everything up to a stop at depth 0 as one node."""
        sub, depth = [], 0
        while self.kind != "eof" and not (depth == 0 and (self.is_(*stops) or self.is_("}") and not any(x.kind == "{" for x in sub))):
            depth += self.is_("(", "[", "{")
            depth -= self.is_(")", "]", "}")
            if self.kind == "name" and self.text not in self.keys:
                self.ident(sub, "identifier", None)
            else:
                sub.append(self.primary() if self.kind in ("str", "num") else self.leaf())
        if sub:
            kids.append(sub[0].at(field) if len(sub) == 1 and sub[0].named else inner(kind, sub, field))

    # -- Go

    def _go(self) -> Node | list[Node] | None:
        t = self.text
        if t == "package":
            kids = [self.leaf()]
            self.ident(kids, "package_identifier", None)
            return inner("package_clause", kids)
        if t in ("import", "const", "var", "type"):
            kids = [self.leaf()]
            spec = {"import": self.go_import, "type": self.go_type, "const": lambda: self.go_spec("const_spec"), "var": lambda: self.go_spec("var_spec")}[t]
            if self.is_("("):
                sub = [self.leaf()]
                while self.kind != "eof" and not self.is_(")"):
                    sub += [self.leaf()] if self.is_(";") else self.step(spec)
                self.need(")", sub)
                if t in ("import", "var"):
                    kids.append(inner(f"{t}_spec_list", sub))
                else:
                    kids += sub
            else:
                kids += self.step(spec)
            self.end(kids)
            return inner(f"{t}_declaration", kids)
        if t == "func":
            kids = [self.leaf()]
            method = self.is_("(")
            if method:
                kids.append(self.group("parameter_list", "receiver", "parameter_declaration"))
            self.ident(kids, "field_identifier" if method else "identifier")
            self.skip_generics(kids)
            if self.is_("("):
                kids.append(self.group("parameter_list", "parameters", "parameter_declaration"))
            if not self.fresh():
                self.until(kids, ("{",), "result")
            if self.is_("{"):
                kids.append(self.block())
            return inner("method_declaration" if method else "function_declaration", kids)
        return self.control() or self.expression_statement()

    def go_import(self) -> Node | None:
        kids: list[Node] = []
        if self.kind == "name":
            self.ident(kids, "package_identifier")
        elif self.is_("."):
            kids.append(inner("dot", [self.leaf()], "name"))
        if self.kind == "str":
            kids.append(self.string().at("path"))
        return inner("import_spec", kids) if kids else None

    def go_spec(self, kind: str) -> Node | None:
        kids: list[Node] = []
        self.ident(kids)
        while self.is_(","):
            kids.append(self.leaf())
            self.ident(kids)
        if not self.is_("=", ")", ";") and not self.fresh():
            self.until_line(kids, ("=",), "type")
        if self.is_("="):
            kids.append(self.leaf())
            kids += [x.at("value") for x in self.step(lambda: self.listed((";",), False))]
        return inner(kind, kids)

    def until_line(self, kids: list[Node], stops: tuple[str, ...], field: str) -> None:
        sub: list[Node] = []
        while self.kind != "eof" and not self.is_(*stops) and not self.is_(")", "}", ";") and not (sub and self.fresh()):
            if self.is_("[", "("):
                sub.append(self.group("type_arguments"))
            elif self.kind == "name":
                self.ident(sub, "type_identifier", None)
            else:
                sub.append(self.leaf())
        if sub:
            kids.append(sub[0].at(field) if len(sub) == 1 else inner("type", sub, field))

    def go_type(self) -> Node | None:
        kids: list[Node] = []
        self.ident(kids, "type_identifier")
        alias = self.is_("=")
        if alias:
            kids.append(self.leaf())
        if self.is_("struct", "interface"):
            word = self.text
            sub = [self.leaf()]
            if self.is_("{"):
                body = [self.leaf()]
                while self.kind != "eof" and not self.is_("}"):
                    if self.is_(";"):
                        body.append(self.leaf())
                        continue
                    line: list[Node] = []
                    while self.kind != "eof" and not self.is_("}", ";") and not (line and self.fresh()):
                        if self.is_("(", "[", "{"):
                            line.append(self.group("parameter_list"))
                        elif self.kind == "name" and self.text not in self.keys:
                            self.ident(line, "type_identifier" if line else "field_identifier", "type" if line else "name")
                        else:
                            line.append(self.primary() if self.kind in ("str", "num") else self.leaf())
                    body.append(inner("field_declaration" if word == "struct" else "method_elem", line))
                self.need("}", body)
                sub += [inner("field_declaration_list", body)] if word == "struct" else body
            kids.append(inner(f"{word}_type", sub, "type"))
        else:
            self.until_line(kids, (), "type")
        return inner("type_alias" if alias else "type_spec", kids)

    # -- Java

    def scoped(self, kids: list[Node], star: bool = False) -> None:
        node: list[Node] = []
        self.ident(node, field=None)
        left = node[0]
        while self.is_(".") and self.toks[self.pos + 1][0] == "name":
            sub = [left.at("scope"), self.leaf()]
            self.ident(sub)
            left = inner("scoped_identifier", sub)
        kids.append(left)
        if star and self.is_(".") and self.peek() == "*":
            kids += [self.leaf(), inner("asterisk", [self.leaf()])]

    def _java(self) -> Node | list[Node] | None:
        return self.java_member(False)

    def java_member(self, inside: bool = True) -> Node | list[Node] | None:
        kids: list[Node] = []
        if self.is_("package") or self.is_("import"):
            word = self.text
            kids.append(self.leaf())
            if self.is_("static"):
                kids.append(self.leaf())
            self.scoped(kids, True)
            self.end(kids)
            return inner(f"{word}_declaration", kids)
        mods: list[Node] = []
        while self.is_("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "@", "sealed") and not (self.is_("@") and self.peek() == "interface") and not (self.is_("synchronized", "default") and self.peek() in ("(", ":")):
            if self.is_("@"):
                sub = [self.leaf()]
                self.ident(sub)
                if self.is_("("):
                    sub.append(self.group("annotation_argument_list", "arguments"))
                mods.append(inner("marker_annotation" if len(sub) == 2 else "annotation", sub))
            else:
                mods.append(self.leaf())
        if mods:
            kids.append(inner("modifiers", mods))
        if self.is_("class", "interface", "enum", "record") and self.toks[self.pos + 1][0] == "name":
            word = self.text
            kids.append(self.leaf())
            self.ident(kids)
            self.skip_generics(kids)
            if self.is_("("):
                kids.append(self.group("formal_parameters", "parameters", "formal_parameter"))
            self.until(kids, ("{",), None, "superclass")
            if self.is_("{"):
                kids.append(self.group("enum_body", "body") if word == "enum" else self.braces(f"{word}_body", self.java_member))
            return inner(f"{word}_declaration", kids)
        if not mods and not inside:
            c = self.control()
            if c:
                return c
        # Type name ( -> method; name ( -> constructor; Type name = or ; -> field or local variable.
        i, depth = self.pos, 0
        while self.toks[i][0] != "eof" and (self.toks[i][0] == "name" and self.toks[i][1] not in ("new", "return") or self.toks[i][1] in ("<", ">", ".", ",", "[", "]", "?", "&") or self.toks[i][1] in ("extends", "super")):
            depth += (self.toks[i][1] == "<") - (self.toks[i][1] == ">")
            if self.toks[i][1] == "," and not depth:
                break
            i += 1
        names = [j for j in range(self.pos, i) if self.toks[j][0] == "name"]
        last = self.toks[i - 1][0] == "name" if i > self.pos else False
        if names and last and self.toks[i][1] in ("(", "=", ";", ",", ":") and (i - self.pos > 1 and self.toks[i - 2][1] != "." or inside and self.toks[i][1] == "("):
            typed = i - self.pos > 1
            if typed:
                sub: list[Node] = []
                while self.pos < i - 1:
                    if self.kind == "name":
                        self.ident(sub, "void_type" if self.is_("void") else "integral_type" if self.text in ("int", "long", "short", "byte", "char") else "type_identifier", None)
                    else:
                        sub.append(self.leaf())
                kids.append(sub[0].at("type") if len(sub) == 1 else inner("generic_type", sub, "type"))
            if self.toks[i][1] == "(":
                self.ident(kids)
                kids.append(self.group("formal_parameters", "parameters", "formal_parameter"))
                self.until(kids, ("{", ";"), None, "throws")
                if self.is_("{"):
                    kids.append(self.block())
                else:
                    self.end(kids)
                return inner("method_declaration" if typed else "constructor_declaration", kids)
            while True:
                sub = []
                self.ident(sub)
                if self.is_("="):
                    sub.append(self.leaf())
                    sub += [x.at("value") for x in self.step(lambda: self.expr((",", ";"), True))]
                kids.append(inner("variable_declarator", sub, "declarator"))
                if not self.is_(","):
                    break
                kids.append(self.leaf())
            self.end(kids)
            return inner("field_declaration" if inside else "local_variable_declaration", kids)
        if self.is_("{"):
            return inner("static_initializer", [*kids, self.block(None)]) if kids else self.block(None)
        if kids:
            return inner("ERROR", kids)
        return self.expression_statement()

    # -- Kotlin

    def user_type(self, kids: list[Node], stops: tuple[str, ...]) -> None:
        before = len(kids)
        self.until_line(kids, stops, None)
        if len(kids) > before:
            kids[-1] = inner("user_type", [kids[-1]])

    def _kotlin(self) -> Node | list[Node] | None:
        kids: list[Node] = []
        if self.is_("package", "import"):
            word = self.text
            kids.append(self.leaf())
            sub: list[Node] = []
            self.ident(sub, "simple_identifier", None)
            while self.is_(".") and not self.fresh():
                sub.append(self.leaf())
                self.ident(sub, "simple_identifier", None) if not self.is_("*") else sub.append(self.leaf())
            kids.append(inner("identifier", sub))
            return inner("package_header" if word == "package" else "import_declaration", kids)
        mods = []
        while self.is_("data", "sealed", "open", "abstract", "private", "public", "internal", "override", "enum", "companion", "protected", "inline", "suspend", "@") and self.peek() not in ("=", "(", "."):
            mods.append(self.leaf())
            if mods[-1].kind == "@":
                self.ident(mods, "annotation", None)
        if mods:
            kids.append(inner("modifiers", mods))
        if self.is_("class", "interface", "object"):
            word = self.text
            kids.append(self.leaf())
            if self.kind == "name":
                self.ident(kids, "type_identifier", None)
            self.skip_generics(kids)
            if self.is_("("):
                kids.append(self.group("primary_constructor", None, "class_parameter"))
            if self.is_(":"):
                self.until_line(kids, ("{",), "delegation")
            if self.is_("{"):
                kids.append(self.braces("class_body", self.statement, None))
            return inner("object_declaration" if word == "object" else "class_declaration", kids)
        if self.is_("fun"):
            kids.append(self.leaf())
            self.skip_generics(kids)
            self.ident(kids, "simple_identifier", None)
            while self.is_("."):
                kids.append(self.leaf())
                self.ident(kids, "simple_identifier", None)
            if self.is_("("):
                kids.append(self.group("function_value_parameters", None, "parameter"))
            if self.is_(":"):
                kids.append(self.leaf())
                self.user_type(kids, ("=", "{"))
            if self.is_("="):
                kids.append(inner("function_body", [self.leaf(), *self.step(lambda: self.expr((";",), False))]))
            elif self.is_("{"):
                kids.append(inner("function_body", [self.block(None)]))
            return inner("function_declaration", kids)
        if self.is_("val", "var"):
            kids.append(self.leaf())
            sub = []
            self.ident(sub, "simple_identifier", None)
            if self.is_(":"):
                sub.append(self.leaf())
                self.user_type(sub, ("=",))
            kids.append(inner("variable_declaration", sub))
            if self.is_("="):
                kids.append(self.leaf())
                kids += self.step(lambda: self.expr((";",), False))
            return inner("property_declaration", kids)
        if kids:
            return inner("ERROR", kids)
        return self.control() or self.expression_statement()

    # -- C

    def preproc(self) -> Node:
        _, t, a, b, _ = self.toks[self.pos]
        self.pos += 1
        m = re.match(r"\s*#\s*(\w+)[ \t]*", t)
        a += len(t) - len(t.lstrip())
        word, rest = m[1], b - (len(t) - m.end())
        kids = [Node("#" + word, a, rest if rest <= b else b, named=False)]
        if word == "include":
            kids.append(Node("system_lib_string" if t[m.end() : m.end() + 1] == "<" else "string_literal", rest, b, field="path"))
            return Node("preproc_include", a, b, kids)
        if word == "define" and (n := re.match(r"\w+", t[m.end() :])):
            kids.append(Node("identifier", rest, rest + n.end(), field="name"))
            return Node("preproc_def", a, b, kids)
        return Node("preproc_call", a, b, kids)

    def _c(self) -> Node | list[Node] | None:
        c = self.control()
        if c:
            return c
        kids: list[Node] = []
        while self.is_("static", "extern", "inline", "const", "typedef", "register", "volatile"):
            kids.append(self.leaf())
        typedef = any(k.kind == "typedef" for k in kids)
        if self.is_("struct", "union", "enum"):
            word = self.text
            sub = [self.leaf()]
            if self.kind == "name":
                self.ident(sub, "type_identifier")
            if self.is_("{"):
                sub.append(self.group("enumerator_list", "body") if word == "enum" else self.braces("field_declaration_list", self._c))
            kids.append(inner(f"{word}_specifier", sub, "type"))
        else:
            i = self.pos
            while self.toks[i][0] == "name" and self.toks[i][1] not in self.keys or self.toks[i][1] == "*" and i > self.pos:
                i += 1
            if self.toks[i][1] not in ("(", "=", ";", ",", "[") or i - self.pos < 2 or self.toks[i - 1][0] != "name":
                return inner("ERROR", kids) if kids else self.expression_statement()
            while self.toks[self.pos + 1][0] == "name":
                prim = self.text in ("int", "char", "void", "float", "double", "long", "short", "unsigned", "signed", "bool", "size_t")
                self.ident(kids, "primitive_type" if prim else "type_identifier", "type")
                if self.is_("*"):
                    break
            if self.kind == "name" and self.peek() == "*":
                prim = self.text in ("int", "char", "void", "float", "double", "long", "short")
                self.ident(kids, "primitive_type" if prim else "type_identifier", "type")
        stars = []
        while self.is_("*"):
            stars.append(self.leaf())
        if self.is_(";") and not stars:
            self.end(kids)
            return kids[0] if len(kids) == 1 else inner(kids[-2].kind if len(kids) == 2 else "declaration", kids) if kids[0].kind.endswith("specifier") and False else inner("declaration", kids)
        name: list[Node] = []
        self.ident(name, "type_identifier" if typedef else "identifier", "declarator")
        node = name[0]
        if self.is_("("):
            node = inner("function_declarator", [node, self.group("parameter_list", "parameters", "parameter_declaration")], "declarator")
        while self.is_("["):
            node = inner("array_declarator", [node, self.group("size")], "declarator")
        if stars:
            node = inner("pointer_declarator", [*stars, node], "declarator")
        if self.is_("{"):
            return inner("function_definition", [*kids, node, self.block()])
        if self.is_("="):
            eq = self.leaf()
            v = self.object_or_init()
            node = inner("init_declarator", [node, eq] + ([v.at("value")] if v else []), "declarator")
        kids.append(node)
        while self.is_(","):
            kids.append(self.leaf())
            kids += self.step(lambda: self.expr((",", ";"), True))
        if self.is_(";"):
            kids.append(self.leaf())
        else:
            kids.append(Node(";", self.here(), self.here(), named=False, missing=True))
        return inner("type_definition" if typedef else "field_declaration" if False else "declaration", kids)

    def object_or_init(self) -> Node | None:
        if self.is_("{"):
            return self.group("initializer_list")
        return self.expr((",", ";"), True)


def parser_of(lang: str):
    def parse(data: bytes) -> Node:
        p = _Parser(data.decode("latin-1"), lang)
        root = p.root()
        if p.texts:
            begins = [x.start for x in p.texts]
            p.comments = sorted((c for c in p.comments if not ((k := bisect_right(begins, c.start)) and c.start < p.texts[k - 1].end)), key=lambda c: c.start)
        place_extras(root, p.comments)
        return root

    return parse
