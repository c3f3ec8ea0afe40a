"""Detection, registry, metrics, chunks, process, sources, streaming, SQL functions, configuration."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeloom.functions import cache, detect, lines, registry
from treeloom.operators import chunk, intel, tree
from treeloom.operators.nodes import nodes, parse_errors, parse_one, trees
from treeloom.plans import api
from treeloom.plans.config import PackConfig, ProcessConfig, camel, convert_keys, snake
from treeloom.plans.errors import ConfigError, DownloadError, LanguageNotFound
from treeloom.sources import readers
from treeloom.streaming import stream


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("path,want", [("src/main.py", "python"), ("app.test.tsx", "tsx"), ("Makefile", None), (".gitignore", None), ("", None), ("a/b.RS", "rust"), ("dir.py/", "python"), ("x.", None), ("lib/server.go", "go"), (None, None)])
def test_path(spark, path, want):
    assert one(spark, detect.detect_language_from_path, path) == want


@pytest.mark.parametrize("text,want", [("#!/bin/bash\necho", "bash"), ("#!/usr/bin/env python3\n", "python"), ("#!/usr/bin/env -S python3.11", "python"), ("no shebang", None), ("", None), ("#!/usr/bin/env", None), ("#!", None), ("#!env node", "javascript"), ("#!/usr/bin/env FOO=1 python", None), ("#!/usr/bin/env Rscript", "r")])
def test_content(spark, text, want):
    assert one(spark, detect.detect_language_from_content, text) == want


@pytest.mark.parametrize("ext,want", [("py", "python"), ("PYI", "python"), ("", None), ("é", None), ("a" * 33, None)])
def test_extension(spark, ext, want):
    assert one(spark, detect.detect_language_from_extension, ext) == want


def test_ambiguity(spark):
    assert tuple(one(spark, detect.extension_ambiguity, "H")) == ("c", ["cpp", "objc"])
    assert one(spark, detect.extension_ambiguity, "py") is None


def test_sql_functions(spark):
    detect.register_functions(spark)
    r = spark.sql("SELECT detect_language_from_extension('RS') a, detect_language_from_path('x/y.py') b, detect_language_from_content('#!/usr/bin/env -S node') c, resolve_alias('shell') d, has_language('lisp') e, has_language('zz') f, detect_language_from_content('') g, extension_ambiguity('H').alternatives h").first()
    assert tuple(r) == ("rust", "python", "javascript", "bash", True, False, None, ["cpp", "objc"])
    assert spark.sql("SELECT kind FROM parse_nodes('[1]', 'json') WHERE is_named ORDER BY node_id").toPandas()["kind"].tolist() == ["document", "array", "number"]


def test_registry(spark):
    assert registry.language_count() >= 300 and registry.has_language("shell") and not registry.has_language("Shell") and not registry.has_language("")
    assert registry.list_languages("typescript") == ["typescript"]
    assert [r.language for r in registry.available_languages(spark).collect()] == registry.list_languages()
    for f in (registry.get_language, registry.get_parser):
        with pytest.raises(LanguageNotFound):
            f("nonexistent_xyz")
    with pytest.raises(LanguageNotFound):
        registry.get_parser("cobol")
    assert registry.info("shell")["language"] == "bash"
    assert registry.get_highlights_query("python") and registry.get_injections_query("javascript") and registry.get_locals_query("python") and registry.get_locals_query("zzz") is None
    for bad in ({"PY": "python"}, {"a.b": "python"}, {"x": "nope"}, {"": "python"}):
        with pytest.raises(ValueError):
            registry.check_tables(bad, {})
    with pytest.raises(ValueError):
        registry.check_tables({"h": "c"}, {"h": ("c", ["nope"])})


def test_added_parser(spark):
    from treeloom.operators.parsers.base import Node

    registry.register_parser("cobol", lambda b: Node("program", 0, len(b)))
    try:
        got = nodes(spark.createDataFrame([(1, "cobol", "abc")], "doc_id long, language string, text string")).collect()
        assert [(r.kind, r.end_byte) for r in got] == [("program", 3)]
    finally:
        registry._ADDED.clear()


@pytest.mark.parametrize("text,want", [("", (0, 0, 0, 0, 0)), ("a\n", (1, 1, 0, 0, 2)), ("a\r\n\r\n# b\n", (3, 1, 1, 1, 9)), ("\u00a0\n*p = 1\n//x", (3, 0, 2, 1, 13)), ("\n\n", (2, 0, 0, 2, 2)), ("é", (1, 1, 0, 0, 2))])
def test_lines(spark, text, want):
    assert tuple(one(spark, lines.line_metrics, text)) == want


PY = '# A comment\nimport os\nfrom pathlib import Path\n\ndef tally(rows):\n    """Count rows."""\n    return f\'n={rows}\'\n\nclass A:\n    def m(self):\n        pass\n'


def sources(spark, *texts, lang="python"):
    return spark.createDataFrame([(i, lang, t) for i, t in enumerate(texts)], "doc_id long, language string, text string")


def test_process(spark):
    r = api.process(sources(spark, PY), ProcessConfig("python").all().with_chunking(60)).first()
    assert r.metrics.total_lines == 11 and r.metrics.error_count == 0 and r.metrics.max_depth >= 4
    assert [(s.kind, s.name) for s in r.structure] == [("Function", "tally"), ("Class", "A"), ("Function", "m")]
    assert r.structure[2].parent_item_id == r.structure[1].item_id and r.structure[0].body_span is not None
    assert [i.source for i in r.imports] == ["import os", "from pathlib import Path"] and r.exports == []
    assert [(c.text, c.kind, c.associated_node) for c in r.comments] == [("# A comment", "Line", "import_statement")]
    assert [(d.text, d.associated_item) for d in r.docstrings] == [('"""Count rows."""', "tally")]
    assert [s.name for s in r.symbols] == ["tally", "A", "m"] and r.diagnostics == []
    assert "".join(c.content for c in r.chunks) == PY and all(len(c.content.encode()) <= 60 for c in r.chunks)
    assert r.chunks[0].start_line == 0 and r.chunks[-1].end_line == 11 and r.chunks[0].metadata.total_chunks == len(r.chunks)
    defaults = api.process(sources(spark, PY), {"language": "python"}).first()
    assert defaults.comments == [] and len(defaults.structure) == 3


def test_process_extractions_and_json(spark):
    cfg = {"language": "python", "extractions": {"functions": {"query": "(function_definition name: (identifier) @name)"}}}
    r = api.process(sources(spark, PY, ""), cfg)
    got = {x.doc_id: x for x in r.collect()}
    assert len(got[0].extractions["functions"].matches) == 2 and got[1].metrics.total_lines == 0
    j = json.loads(api.to_json(api.process(sources(spark, PY), {"language": "python"}), camel_case=True).first().json)
    assert "exports" not in j and j["metrics"]["totalLines"] == 11 and "bodySpan" in j["structure"][0]
    with pytest.raises(LanguageNotFound):
        api.process(sources(spark, PY), {"language": "nope"})


def test_row_errors(spark):
    rows = spark.createDataFrame([(1, "python", b"x = 1"), (2, "python", b"\xff\xfe"), (3, "zz", b"a"), (4, "cobol", b"a"), (5, "python", None)], "doc_id long, language string, text binary")
    assert {r.doc_id: r.error for r in parse_errors(rows).collect()} == {2: "not valid UTF-8", 3: "language not found: zz", 4: "language not found: cobol", 5: "no text"}
    assert {r.doc_id for r in nodes(rows).collect()} == {1}


def test_detected_language(spark):
    rows = spark.createDataFrame([(1, "a/b.py", "x = 1"), (2, "c", "#!/usr/bin/env ruby\nputs 1")], "doc_id long, path string, text string")
    assert {(r.doc_id, r.language) for r in trees(rows).collect()} == {(1, "python"), (2, "ruby")}


def test_tree_functions(spark):
    n = nodes(sources(spark, "x = 1\ny = 2\n", "f(\n")).persist()
    assert {r.doc_id: r.error_count for r in tree.error_count(n).collect()} == {0: 0, 1: 1}
    assert {r.doc_id: r.root_child_count for r in tree.root_child_count(n).collect()} == {0: 2, 1: 1}
    assert {r.doc_id: r.named_children_count for r in tree.named_children_count(n).collect()}[0] == 2
    assert [r.node_id for r in tree.find_nodes_by_type(n.where("doc_id = 0"), "=").orderBy("node_id").collect()] == [4, 9]
    below = tree.descendants(n, n.where("doc_id = 0 and kind = 'assignment'").select("doc_id", "node_id", "last_desc_id"))
    assert below.count() == 6
    assert [r.node_id for r in tree.traverse(n.where("doc_id = 0")).collect()] == list(range(11)[: n.where("doc_id = 0").count()])
    assert json.loads(tree.parse_result(sources(spark, "x"), "json").first().output)["has_errors"] is False
    m = tree.tree_metrics(n).where("doc_id = 0").first()
    assert m.node_count == n.where("doc_id = 0").count() and m.max_depth == 3
    bad = spark.createDataFrame([(0, 1, 3, 4), (1, 2, 0, 99)], "doc_id long, node_id long, start_byte long, end_byte long")
    assert {r.doc_id: r.text for r in tree.extract_text(bad, spark.createDataFrame([(0, "aéb"), (1, "x")], "doc_id long, text string")).collect()} == {0: "b", 1: None}


@given(st.text(alphabet=st.sampled_from(list("abé漢 \n")), max_size=300), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_chunk_invariants(text, most):
    raw = text.encode()
    for by in ({}, {1: [i for i in range(0, len(raw), 7) if raw[i : i + 1] and raw[i] & 0xC0 != 0x80]}):
        got = chunk.split_code(raw, by, most)
        assert [a for a, _ in got[1:]] == [b for _, b in got[:-1]]
        assert not raw or (got[0][0], got[-1][1]) == (0, len(raw))
        for a, b in got:
            assert b > a and (b - a <= most or len(raw[a:b].decode()) == 1)


def test_chunk_edges():
    assert chunk.split_code(b"", {}, 5) == [] and chunk.split_code(b"abc", {}, 0) == [] and chunk.split_code(b"abc", {}, 3) == [(0, 3)]
    c = parse_one("python", b"def f():\n    pass\n\ndef g():\n    pass\n")
    by = {}
    for d, s in zip(c["depth"], c["start_byte"]):
        if d:
            by.setdefault(d, []).append(s)
    assert chunk.split_code(b"def f():\n    pass\n\ndef g():\n    pass\n", by, 20) == [(0, 19), (19, 37)]


def test_rust_and_go_features(spark):
    rs = trees(sources(spark, "/** d */\nfn a() {}\n// x\n", lang="rust"))
    assert [(r.text, r.kind) for r in intel.feature_table(rs, "comments").orderBy("position").collect()] == [("/** d */", "Block"), ("// x", "Line")]
    js = trees(sources(spark, "/* x */ let a = 1;\n/** y */\n", lang="javascript"))
    assert [r.kind for r in intel.feature_table(js, "comments").orderBy("position").collect()] == ["Line", "Doc"]


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("x = 1\n")
    (tmp_path / "in" / "b.bin").write_bytes(b"\xff")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_sources(spark, str(tmp_path / "in")).collect()}
    assert got["a.py"].language == "python" and got["b.bin"].error and got["b.bin"].text is None
    assert readers.read_source(spark, str(tmp_path / "in" / "a.py")).first().text == "x = 1\n"
    readers.from_rows(spark, [(1, "python", PY), (2, "python", "y = 2\n")]).write.parquet(str(tmp_path / "src"))
    src = stream.read_stream(spark, str(tmp_path / "src"), "doc_id long, language string, text string")
    q = stream.run_stream(src, lambda s: api.process(s, ProcessConfig("python")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    readers.write_json(trees(src) if False else nodes(sources(spark, "x")), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_config(tmp_path):
    c = PackConfig("/c", ("python",), ("web",))
    c.save(tmp_path)
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert PackConfig.discover(tmp_path / "a" / "b") == c
    (tmp_path / "bad.toml").write_text("= 1")
    with pytest.raises(ConfigError):
        PackConfig.load(tmp_path / "bad.toml")
    assert snake("chunkMaxSize") == "chunk_max_size" and camel("chunk_max_size") == "chunkMaxSize" and convert_keys({"a_b": [{"c_d": 1}]}, camel) == {"aB": [{"cD": 1}]}
    assert ProcessConfig.of({"language": "python", "chunkMaxSize": 5}).chunk_max_size == 5
    p = ProcessConfig("python")
    assert p.all().chunk_max_size is None and not p.minimal().structure and p.folded(comments=True).comments and not p.folded(comments=True).structure and p.folded() == p


def test_cache(tmp_path):
    cache.init(PackConfig(str(tmp_path / "treeloom"), ("python",), ("data",)))
    assert cache.cache_dir() == tmp_path / "treeloom" and cache.download(["python"]) == 0 and cache.download_all() == 0 and "json" in cache.ensure_group("data") and cache.platform_key()
    (tmp_path / "treeloom").mkdir()
    cache.clean_cache()
    assert not (tmp_path / "treeloom").exists() and cache.downloaded_languages() == cache.manifest_languages()
    for f, a in ((cache.download, ["cobol"]), (cache.ensure_group, "none")):
        with pytest.raises(DownloadError):
            f(a)
    with pytest.raises(DownloadError):
        cache.init(PackConfig(None, ("zz",)))
    cache.configure(PackConfig())


def test_extraction_from_kept_trees(spark, tmp_path):
    """Patterns and queries give the same on trees that were written and read again as on sources."""
    from treeloom.operators import extract, squery
    from treeloom.operators.nodes import trees

    rows = [(1, "def a():\n    pass\n\nclass B:\n    def c(self): return 1\n", "python"), (2, "x = 1\n", "python"), (3, "{}", "json"), (4, None, "python"), (5, "", "python")]
    sources = spark.createDataFrame(rows, "doc_id long, text string, language string")
    trees(sources).write.parquet(str(tmp_path / "trees"))
    kept = spark.read.parquet(str(tmp_path / "trees"))
    config = {"language": "python", "patterns": {"f": {"query": "(function_definition name: (identifier) @n)", "max_results": 1}, "c": {"query": "(class_definition) @c", "child_fields": ["name"]}}}
    key = lambda r: str(r)
    assert sorted(extract.extract_from_trees(kept, config).collect(), key=key) == sorted(extract.extract_patterns(sources, config).collect(), key=key)
    q = "(identifier) @i"
    got = squery.run_query_on_trees(kept, "python", q).collect()
    assert got and sorted(got, key=key) == sorted(squery.run_query(sources, "python", q).collect(), key=key)


def test_chunks_of_prose_by_hand():
    """Texts without syntax, lines longer than a chunk and characters of several bytes included."""
    import random

    from treeloom.operators.chunk import split_code

    def by_hand(text, most):
        out, now = [], ""
        if len(text.encode()) <= most:
            return [text] if text else []
        for line in text.splitlines(keepends=True) if "\r" not in text else [text]:
            if len((now + line).encode()) > most and now:
                out.append(now)
                now = ""
            if len(line.encode()) > most:
                piece = ""
                for ch in line:
                    if piece and len((piece + ch).encode()) > most:
                        out.append(piece)
                        piece = ""
                    piece += ch
                out.append(piece)
            else:
                now += line
        return [*out, now] if now else out

    r = random.Random(4)
    for _ in range(500):
        text = "".join(r.choice(["a", "bc ", "é", "漢字", "\n", "\n", "word " * r.randrange(6)]) for _ in range(r.randrange(0, 60)))
        most = r.randrange(1, 40)
        raw = text.encode()
        assert [raw[a:b].decode() for a, b in split_code(raw, {}, most)] == by_hand(text, most)
