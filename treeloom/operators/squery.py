"""S-expression patterns over trees.

Patterns are compiled on the driver (so a wrong one fails before any job) and
matched in the workers beside the parse: a match never leaves its document, so
only matches travel and nothing is joined. Supported: node kinds, nesting,
fields, captures, wildcards ``_`` and ``(_)``, anonymous ``"tokens"``, ``ERROR``
and ``MISSING``, alternations ``[...]``, groups, quantifiers ``? * +``, anchors
``.``, negated fields ``!f``, and the text predicates eq?, not-eq?, any-eq?,
match?, not-match?, any-match?, any-of? and not-any-of?; other predicates are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as default
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from treeloom.functions.registry import get_parser, resolve_alias
from treeloom.plans import schemas as S
from treeloom.plans.errors import QueryError

_TOKEN = re.compile(r"(?P<ws>\s+|;[^\n]*)|(?P<str>\"(?:[^\"\\]|\\.)*\")|(?P<cap>@[\w.\-]+)|(?P<pred>\#[\w.\-]+[?!])|(?P<name>[A-Za-z_][\w\-]*(?:/[A-Za-z_]\w*)?)|(?P<neg>![A-Za-z_]\w*)|(?P<op>[()\[\]:.?*+])|(?P<bad>.)", re.S)


@dataclass
class Pat:
    what: str  # node, token, any, named, alt, group
    name: str = ""
    field: str | None = None
    items: list = default(default_factory=list)  # Pat or "."
    without: list[str] = default(default_factory=list)
    captures: list[str] = default(default_factory=list)
    quant: str = ""
    missing: bool = False


@dataclass
class Compiled:
    patterns: list[Pat]
    predicates: list[list[tuple[str, list[tuple[str, str]]]]]
    capture_names: list[str]


class _Reader:
    def __init__(self, source: str):
        self.toks = []
        for m in _TOKEN.finditer(source):
            if m.lastgroup == "bad":
                raise QueryError(f"unexpected {m[0]!r} at {m.start()}")
            if m.lastgroup != "ws":
                self.toks.append((m.lastgroup, m[0], m.start()))
        self.pos = 0
        self.names: list[str] = []

    def peek(self) -> tuple[str, str]:
        return self.toks[self.pos][:2] if self.pos < len(self.toks) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end":
            raise QueryError("unexpected end of query")
        self.pos += 1
        return t

    def expect(self, text: str) -> None:
        k, t = self.take()
        if t != text:
            raise QueryError(f"expected {text!r}, found {t!r}")

    def query(self) -> Compiled:
        pats, preds = [], []
        while self.peek()[0] != "end":
            if self.peek()[1] == "." or self.peek()[0] in ("cap", "neg"):
                raise QueryError(f"unexpected {self.peek()[1]!r}")
            self.preds: list = []
            pats.append(self.pattern())
            preds.append(self.preds)
        for p in preds:
            for name, args in p:
                for k, v in args:
                    if k == "cap" and v not in self.names:
                        raise QueryError(f"predicate {name} names the unknown capture @{v}")
        return Compiled(pats, preds, self.names)

    def pattern(self, field: str | None = None) -> Pat:
        k, t = self.take()
        if k == "str":
            p = Pat("token", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), t[1:-1]))
        elif t == "[":
            p = Pat("alt")
            while self.peek()[1] != "]":
                p.items.append(self.item())
            self.take()
            if not p.items:
                raise QueryError("empty alternation")
        elif t == "(":
            k2, t2 = self.peek()
            if k2 == "pred":
                raise QueryError("a predicate must stand inside a pattern")
            if t2 in ("(", "[") or k2 == "str":
                p = Pat("group")
                self.children(p)
            else:
                k2, t2 = self.take()
                if k2 != "name":
                    raise QueryError(f"expected a node kind, found {t2!r}")
                if t2 == "_":
                    p = Pat("named")
                elif t2 == "MISSING":
                    p = Pat("node", missing=True)
                    if self.peek()[0] in ("name", "str"):
                        p.name = self.take()[1].strip('"')
                else:
                    p = Pat("node", t2.split("/")[-1])
                self.children(p)
        elif k == "name" and t == "_":
            p = Pat("any")
        else:
            raise QueryError(f"unexpected {t!r}")
        p.field = field
        while True:
            k, t = self.peek()
            if t in ("?", "*", "+") and not p.quant:
                self.take()
                p.quant = t
            elif k == "cap":
                self.take()
                p.captures.append(t[1:])
                if t[1:] not in self.names:
                    self.names.append(t[1:])
            else:
                return p

    def item(self) -> Pat:
        """A pattern, perhaps with its field."""
        k, t = self.peek()
        if k == "name" and self.pos + 1 < len(self.toks) and self.toks[self.pos + 1][1] == ":":
            self.pos += 2
            return self.pattern(t)
        return self.pattern()

    def children(self, p: Pat) -> None:
        while True:
            k, t = self.peek()
            if t == ")" and k == "op":
                self.take()
                return
            if k == "neg":
                p.without.append(self.take()[1][1:])
            elif t == "." and k == "op":
                self.take()
                p.items.append(".")
            elif t == "(" and self.pos + 1 < len(self.toks) and self.toks[self.pos + 1][0] == "pred":
                self.take()
                name = self.take()[1]
                args = []
                while self.peek()[1] != ")":
                    k, t = self.take()
                    if k not in ("cap", "str", "name"):
                        raise QueryError(f"unexpected {t!r} in {name}")
                    args.append((k, t[1:] if k == "cap" else re.sub(r"\\(.)", r"\1", t[1:-1]) if k == "str" else t))
                self.take()
                if name[1:] in ("match?", "not-match?", "any-match?", "any-not-match?"):
                    if len(args) != 2 or args[0][0] != "cap":
                        raise QueryError(f"{name} takes a capture and a pattern")
                    if re.search(r"\(\?[=!<]|\\[1-9]", args[1][1]):
                        raise QueryError(f"{name}: look-around and back-references aren't supported")
                    try:
                        re.compile(args[1][1])
                    except re.error as e:
                        raise QueryError(f"{name}: {e}") from e
                elif name[1:] in ("eq?", "not-eq?", "any-eq?", "any-of?", "not-any-of?") and (not args or args[0][0] != "cap"):
                    raise QueryError(f"{name} takes a capture first")
                self.preds.append((name[1:], args))
            elif k == "end":
                raise QueryError("unexpected end of query")
            else:
                p.items.append(self.item())


@lru_cache(1024)
def compile_query(language: str, source: str) -> Compiled:
    """Compiled patterns; QueryError for a wrong query, LanguageNotFound for a language without a parser."""
    get_parser(language)
    return _Reader(source).query()


class Matcher:
    """Matches of a compiled query in one document's nodes."""

    def __init__(self, c: dict[str, list], text: bytes):
        self.c, self.text = c, text
        n = len(c["kind"])
        self.kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            self.kids[c["parent_id"][i]].append(i)
        self.by_kind: dict[str, list[int]] = {}
        for i, k in enumerate(c["kind"]):
            self.by_kind.setdefault(k, []).append(i)

    def is_node(self, p: Pat, i: int) -> bool:
        c = self.c
        if p.field is not None and c["field_name"][i] != p.field:
            return False
        if p.what == "node":
            if p.missing:
                return c["is_missing"][i] and (not p.name or c["kind"][i] == p.name)
            return c["kind"][i] == p.name and c["is_named"][i]
        if p.what == "token":
            return c["kind"][i] == p.name and not c["is_named"][i]
        return p.what == "any" or p.what == "named" and c["is_named"][i]

    def one(self, p: Pat, i: int) -> Iterator[tuple]:
        """Captures of each way in which the pattern, its quantifier aside, matches node i."""
        if p.what == "alt":
            if p.field is not None and self.c["field_name"][i] != p.field:
                return
            for q in p.items:
                for caps in self.one(q, i):
                    yield tuple((x, i) for x in p.captures) + caps
            return
        if p.what == "group":
            items = [x for x in p.items if x != "."]
            if len(items) == 1:
                for caps in self.one(items[0], i):
                    yield tuple((x, i) for x in p.captures) + caps
            return
        if not self.is_node(p, i):
            return
        if any(self.c["field_name"][k] in p.without for k in self.kids[i]) if p.without else False:
            return
        own = tuple((x, i) for x in p.captures)
        if not p.items:
            yield own
            return
        for caps, _ in self.seq(p.items, 0, self.kids[i], 0, False):
            yield own + caps

    def seq(self, items: list, a: int, kids: list[int], k: int, tight: bool) -> Iterator[tuple[tuple, int]]:
        """Ways to match items[a:] in order within kids[k:]; ``tight``: the next must come at once."""
        named = self.c["is_named"]
        if a == len(items):
            if not tight or not any(named[x] for x in kids[k:]):
                yield (), k
            return
        p = items[a]
        if p == ".":
            yield from self.seq(items, a + 1, kids, k, True)
            return
        if p.what == "group" and len([x for x in p.items if x != "."]) != 1 and not p.quant:
            for caps, end in self.seq([*p.items, *items[a + 1 :]], 0, kids, k, tight):
                yield caps, end
            return
        if p.quant in ("*", "+", "?"):
            # Greedy: as many as can be, fewer only where what follows needs it.
            taken: list[tuple[tuple, int]] = []
            at, first_tight = k, tight
            while at < len(kids) and (p.quant != "?" or not taken):
                found = None
                for j in range(at, len(kids)):
                    got = next(self.one(p, kids[j]), None)
                    if got is not None:
                        found = (got, j + 1)
                        break
                    if (first_tight or taken and self._next_is_anchor(items, a)) and named[kids[j]]:
                        break
                if found is None:
                    break
                taken.append(found)
                at, first_tight = found[1], False
            least = 1 if p.quant == "+" else 0
            for n in range(len(taken), least - 1, -1):
                caps = tuple(x for g, _ in taken[:n] for x in g)
                some = False
                for rest, end in self.seq(items, a + 1, kids, taken[n - 1][1] if n else k, tight and n == 0):
                    some = True
                    yield caps + rest, end
                if some:
                    return
            return
        for j in range(k, len(kids)):
            for caps in self.one(p, kids[j]):
                for rest, end in self.seq(items, a + 1, kids, j + 1, False):
                    yield caps + rest, end
            if tight and named[kids[j]]:
                return

    @staticmethod
    def _next_is_anchor(items: list, a: int) -> bool:
        return a + 1 < len(items) and items[a + 1] == "."

    def texts(self, name: str, caps: tuple) -> list[str]:
        return [self.text[self.c["start_byte"][i] : self.c["end_byte"][i]].decode("utf-8", "replace") for x, i in caps if x == name]

    def passes(self, preds: list, caps: tuple) -> bool:
        for name, args in preds:
            if name.endswith("!") or not args or args[0][0] != "cap":
                continue
            mine = self.texts(args[0][1], caps)
            some = name.startswith("any-") and name != "any-of?"
            base = name.removeprefix("any-") if some else name
            if base in ("eq?", "not-eq?"):
                other = self.texts(args[1][1], caps) if args[1][0] == "cap" else None
                test = [(x == (other[min(k, len(other) - 1)] if other else None)) if other is not None else x == args[1][1] for k, x in enumerate(mine)]
            elif base in ("match?", "not-match?"):
                test = [re.search(args[1][1], x) is not None for x in mine]
            elif base in ("any-of?", "not-any-of?"):
                test = [x in {v for _, v in args[1:]} for x in mine]
            else:
                continue
            if base.startswith("not-"):
                test = [not t for t in test]
            if mine and not (any(test) if some else all(test)):
                return False
        return True

    def starts(self, p: Pat) -> Iterator[int]:
        kinds = self.root_kinds(p)
        if kinds is None:
            return iter(range(len(self.kids)))
        if len(kinds) == 1:
            return iter(self.by_kind.get(*kinds, ()))
        return iter(sorted(i for k in kinds for i in self.by_kind.get(k, ())))

    def root_kinds(self, p: Pat) -> set[str] | None:
        """Kinds of the nodes that a pattern can match at its root; None where they can be any."""
        if p.what in ("node", "token"):
            return None if p.missing else {p.name}
        items = [x for x in p.items if x != "."]
        if p.what == "alt" or p.what == "group" and len(items) == 1:
            each = [self.root_kinds(x) for x in items]
            return None if None in each else set().union(*each)
        return None

    def matches(self, q: Compiled) -> list[tuple[int, int, tuple]]:
        """(root node, pattern index, captures) in order of root, pattern and captures."""
        out = []
        for n, (p, preds) in enumerate(zip(q.patterns, q.predicates)):
            if p.what == "group" and len([x for x in p.items if x != "."]) != 1:
                for i in range(len(self.kids)):
                    kids = self.kids[i]
                    for k in range(len(kids)):
                        first = p.items[0]
                        if first == "." or next(self.one(first, kids[k]), None) is None:
                            continue
                        for caps, _ in self.seq([".", *p.items], 0, kids[k:], 0, False):
                            caps = tuple((x, kids[k]) for x in p.captures) + caps
                            if self.passes(preds, caps):
                                out.append((kids[k], n, caps))
                continue
            for i in self.starts(p):
                for caps in self.one(p, i):
                    if self.passes(preds, caps):
                        out.append((i, n, caps))
        seen, unique = set(), []
        for m in sorted(out, key=lambda m: (m[0], m[1])):
            if m not in seen:
                seen.add(m)
                unique.append(m)
        return unique


#: Columns of nodes that matching needs, and those with what matches tell of their nodes.
MATCHED = ("parent_id", "field_name", "kind", "is_named", "start_byte", "end_byte", "is_missing")
SHOWN = tuple(dict.fromkeys([*MATCHED, *(n for n, _ in S.NODE_FIELDS)]))
NODE = pa.struct([(n, {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}[t]) for n, t in S.NODE_FIELDS])


def node_struct(c: dict[str, list], i: int) -> dict:
    return {n: c[n][i] for n, _ in S.NODE_FIELDS}


_RUN = f"doc_id bigint, match_seq bigint, pattern_index bigint, captures array<{S.CAPTURE}>"
_RUN_ARROW = [("doc_id", pa.int64()), ("match_seq", pa.int64()), ("pattern_index", pa.int64()), ("captures", pa.list_(pa.struct([("name", pa.string()), ("node", NODE)])))]


def _run_rows(q: Compiled):
    def rows(d, _, raw, c):
        for k, (_root, n, caps) in enumerate(Matcher(c, raw).matches(q)):
            yield d, k, n, [{"name": x, "node": node_struct(c, i)} for x, i in caps]

    return rows


def run_query(sources: DataFrame, language: str, query: str) -> DataFrame:
    """(doc_id, match_seq, pattern_index, captures): every match in the sources of ``language``, in document order."""
    from .nodes import parsed

    q = compile_query(language, query)
    return parsed(of_language(sources, resolve_alias(language)), _RUN, _run_rows(q), _RUN_ARROW)


def run_query_on_trees(trees: DataFrame, language: str, query: str) -> DataFrame:
    """The same in trees (doc_id, language, raw, nodes) that have been parsed before; nothing is parsed again."""
    from pyspark.sql import functions as F

    from .nodes import from_trees

    q = compile_query(language, query)
    return from_trees(trees.where(F.col("language") == resolve_alias(language)), _RUN, _run_rows(q), _RUN_ARROW, SHOWN)


def of_language(sources: DataFrame, lang: str) -> DataFrame:
    """The sources of one language; all of them, taken to be in it, where they don't say."""
    from pyspark.sql import functions as F

    if "language" in sources.columns:
        return sources.where(resolve_alias(F.col("language")) == lang)
    return sources.withColumn("language", F.lit(lang))
