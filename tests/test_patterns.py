"""S-expression patterns, extraction and validation."""

import pytest

from treeloom.operators import extract, squery
from treeloom.operators.nodes import parse_one
from treeloom.plans.config import ExtractionPattern
from treeloom.plans.errors import ConfigError, LanguageNotFound, QueryError

PY = "def a():\n    pass\n\nclass B:\n    def c(self):\n        return 1\n\nx = f(1, 'two', 3)\n"


def found(query, text=PY, lang="python"):
    c, raw = parse_one(lang, text.encode()), text.encode()
    m = squery.Matcher(c, raw).matches(squery.compile_query(lang, query))
    return [[(x, raw[c["start_byte"][i] : c["end_byte"][i]].decode()) for x, i in caps] for _, _, caps in m]


@pytest.mark.parametrize("query,expected", [
    ("(function_definition name: (identifier) @n)", [["a"], ["c"]]),
    ("(class_definition body: (block (function_definition name: (identifier) @n)))", [["c"]]),
    ("[(function_definition name: (_) @n) (class_definition name: (_) @n)]", [["a"], ["B"], ["c"]]),
    ('((identifier) @n (#match? @n "^[A-Z]"))', [["B"]]),
    ('((identifier) @n (#any-of? @n "a" "c"))', [["a"], ["c"]]),
    ('((identifier) @n (#not-eq? @n "a") (#not-match? @n "^(B|self|c|x)$"))', [["f"]]),
    ("(argument_list . (_) @first)", [["1"]]),
    ("(argument_list (_) @last .)", [["3"]]),
    ("(argument_list (integer) @i)", [["1"], ["3"]]),
    ("(argument_list (integer) @a . (string) @b)", [["1", "'two'"]]),
    ("(argument_list (_)+ @all)", [["1", "'two'", "3"]]),
    ("(function_definition !return_type name: (identifier) @n)", [["a"], ["c"]]),
    ("(class_definition superclasses: (_)? @s name: (identifier) @n)", [["B"]]),
    ('"class" @k', [["class"]]),
    ("(call function: (identifier) @f arguments: (argument_list (string) @s))", [["f", "'two'"]]),
    ("((class_definition) @c . (expression_statement) @e)", [["class B:\n    def c(self):\n        return 1", "x = f(1, 'two', 3)"]]),
])
def test_matches(query, expected):
    assert [[t for _, t in m] for m in found(query)] == expected


def test_errors_and_missing():
    assert len(found("(MISSING) @m", "f(1\n")) == 1
    assert len(found("(ERROR) @e", "def f(1):\n  pass\n")) >= 1


@pytest.mark.parametrize("query", ["(((", "(a", "[", "[]", ")", "@x", "(a) (#eq? @b \"c\")", '((a) @x (#match? @x "("))', '((a) @x (#match? @x "(?=a)"))', "(a b"])
def test_bad_queries(query):
    with pytest.raises(QueryError):
        squery.compile_query("python", query)


def test_unknown_language():
    for lang in ("", "nonexistent_xyz", "cobol"):
        with pytest.raises(LanguageNotFound):
            squery.compile_query(lang, "(a)")


def sources(spark, *texts, lang="python"):
    return spark.createDataFrame([(i, lang, t) for i, t in enumerate(texts)], "doc_id long, language string, text string")


def test_extraction(spark):
    cfg = {"language": "python", "patterns": {
        "two": {"query": "(identifier) @n", "max_results": 2, "capture_output": "Text"}, "none": {"query": "(identifier) @n", "max_results": 0},
        "node": {"query": "(class_definition) @c", "capture_output": "Node", "child_fields": ["name", "superclasses"]}, "range": {"query": "(function_definition) @f", "byte_range": [0, 5]}, "far": {"query": "(module) @m", "byte_range": [9999, 99999]},
    }}
    got = {r.pattern_name: r for r in extract.extract_patterns(sources(spark, PY), cfg).collect()}
    assert got["two"].total_count == 6 and [m.captures[0].text for m in got["two"].matches] == ["a", "B"] and got["two"].matches[0].captures[0].node is None
    assert got["none"].matches == [] and got["none"].total_count == 6
    c = got["node"].matches[0].captures[0]
    assert c.text is None and c.node.kind == "class_definition" and c.child_fields == {"name": "B", "superclasses": None}
    assert got["range"].total_count == 1 and got["far"].total_count == 0
    assert set(extract.as_map(extract.extract_patterns(sources(spark, PY), cfg)).first().results) == set(got)


def test_validation():
    ok = extract.validate_extraction({"language": "python", "patterns": {"f": {"query": "(a) @x (b) @y", "child_fields": [""]}}})
    assert ok == {"valid": True, "patterns": {"f": {"valid": True, "capture_names": ["x", "y"], "pattern_count": 2, "warnings": ["empty child field name in pattern 'f'"], "errors": []}}}
    bad = extract.validate_extraction({"language": "python", "patterns": {"g": {"query": "(this_is_not_a_valid_node @x"}}})
    assert not bad["valid"] and bad["patterns"]["g"]["errors"]
    assert extract.validate_extraction({"language": "python", "patterns": {}})["valid"]
    with pytest.raises(QueryError):
        extract.validate_extraction({"language": "python", "patterns": {"g": {"query": "((("}}}, strict=True)
    with pytest.raises(QueryError, match="pattern 'g'"):
        extract.compile_extraction({"language": "python", "patterns": {"g": {"query": "((("}}})
    with pytest.raises(ConfigError):
        ExtractionPattern("(a)", capture_output="All")


def test_run_query_rows(spark):
    got = squery.run_query(sources(spark, PY, "y = 1\n"), "python", "(function_definition name: (identifier) @name)").orderBy("doc_id", "match_seq").collect()
    assert [(r.doc_id, r.match_seq, r.captures[0].name, r.captures[0].node.kind) for r in got] == [(0, 0, "name", "identifier"), (0, 1, "name", "identifier")]


@pytest.mark.parametrize("query, kinds", [("((tag_name) @n (#eq? @n \"b\"))", {"tag_name"}), ("[(start_tag (tag_name) @t) (text) @t \"<\" @t]", {"start_tag", "text", "<"}), ("[(text) (_)] @x", None), ("(MISSING) @m", None)])
def test_only_nodes_of_root_kinds_are_tried(monkeypatch, query, kinds):
    from treeloom.operators.squery import Matcher, compile_query

    raw = b"<p>a<br><b>c</b> d"
    c = parse_one("html", raw)
    q = compile_query("html", query)
    assert Matcher(c, raw).root_kinds(q.patterns[0]) == kinds
    tried = set(Matcher(c, raw).starts(q.patterns[0]))
    assert tried == {i for i, k in enumerate(c["kind"]) if kinds is None or k in kinds}
    found = Matcher(c, raw).matches(q)
    monkeypatch.setattr(Matcher, "root_kinds", lambda self, p: None)
    assert Matcher(c, raw).matches(q) == found
