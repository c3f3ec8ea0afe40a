"""A node table of some columns has the rows of the whole one, and nothing else leaves the parse."""

import pytest
from pyspark.sql import functions as F

from treeloom.operators.nodes import nodes
from treeloom.plans import queries

ROWS = [(1, "json", '{"a": [1, {"b": "x\\n"}],\n "c": }'), (2, "html", "<p>a<br>\n<b c=d>é</p>"), (3, "python", "def f(:\n  x = 1\n"), (4, "json", ""), (5, "cobol", "x"), (6, "json", None)]


@pytest.mark.parametrize("columns", [["kind"], ["depth", "is_error", "is_missing"], ["node_id", "start_byte", "end_byte"], ["parent_id", "start_row", "kind"], ["is_named", "field_name"]])
@pytest.mark.parametrize("kinds", [None, ["string", "ERROR", "element"]])
def test_some_columns(spark, columns, kinds):
    sources = spark.createDataFrame(ROWS, "doc_id long, language string, text string")
    some = nodes(sources, kinds=kinds, columns=columns)
    assert set(some.columns) == {"doc_id", *columns}
    whole = nodes(sources, kinds=kinds).select(*some.columns)
    assert some.dtypes == whole.dtypes
    assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.collect()))


def test_other_columns_are_refused(spark):
    sources = spark.createDataFrame(ROWS, "doc_id long, language string, text string")
    with pytest.raises(ValueError, match="columns"):
        nodes(sources, columns=["text"])


WANTED = {"json_traverse": {"node_id", "kind"}, "json_nodes_by_kind": {"kind"}, "json_extract_text": {"node_id", "start_byte", "end_byte"}, "json_error_flag": {"is_error", "is_missing"}, "json_tree_metrics": {"is_error", "is_missing", "depth"}, "json_contains_object": {"kind"}}


@pytest.mark.parametrize("name", WANTED)
def test_query_takes_what_it_needs(spark, small, monkeypatch, name):
    seen = []
    monkeypatch.setattr(queries, "nodes", lambda *a, **k: seen.append(nodes(*a, **k)) or seen[-1])
    queries.QUERIES[name](spark, small)
    assert set(seen[0].columns) == {"doc_id"} | WANTED[name]


def test_trees_of_some_columns(spark):
    """Patterns over trees that keep only what matching needs find what they find in whole trees, in documents without nodes too."""
    from treeloom.operators import extract, squery
    from treeloom.operators.nodes import trees

    sources = spark.createDataFrame([*ROWS, (7, "html", "<i>" * 300), (8, "html", "")], "doc_id long, language string, text string")
    some = trees(sources, columns=squery.MATCHED)
    assert {f.name for f in some.schema["nodes"].dataType.elementType} == set(squery.MATCHED)
    config = {"language": "html", "patterns": {"t": {"query": "[(start_tag (tag_name) @t) (attribute) @t (ERROR) @t]", "capture_output": "Text"}}}
    key = lambda r: r.doc_id
    got = sorted(extract.extract_from_trees(some.withColumn("nodes", F.when(F.col("doc_id") != 8, F.col("nodes"))), config).collect(), key=key)
    assert got == sorted(extract.extract_patterns(sources.where("doc_id != 8"), config).collect(), key=key)
    shown = trees(sources, columns=squery.SHOWN)
    q = "((tag_name) @n (#eq? @n \"b\"))"
    assert squery.run_query_on_trees(shown, "html", q).collect() == squery.run_query(sources, "html", q).collect() != []
    with pytest.raises(ValueError, match="columns"):
        trees(sources, columns=["nothing"])
