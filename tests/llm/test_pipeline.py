import inspect
import re
from pathlib import Path

import __spark_entry__ as entry_points
import corpus_pipeline

from treeloom.llm import decontam, langid, neardup, packing, queries, secretscan

from .test_decontam import edits, words
from .test_neardup import brute_groups


def test_stages(spark, small, docs, tmp_path):
    """Each stage gives what its operator says, and keeps the columns of documents."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_redaction", "best_fit_packing"]
    now = docs
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, small)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == docs.columns
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        left = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "language_id":
            bad = {r.doc_id for r in langid.identify(now, langid.train(now)).where("lang_id = 'und'").collect()}
            assert left == ids - bad
        elif name == "near_dedup":
            groups = brute_groups([(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()])
            gone = {i for least, v in groups.items() for i in v if i != least}
            assert gone and len(left ^ (ids - gone)) <= 0.02 * len(gone) and neardup.near_duplicates(out).count() == 0
        elif name == "decontamination":
            its = [words(r.text) for r in items.collect()]
            hit = set()
            for r in now.select("doc_id", "text").collect():
                w = words(r.text)
                have = set(w)
                if any(sum(x not in have for x in it) <= int(decontam.MAX_EDITS * len(it)) and edits(it, w) <= int(decontam.MAX_EDITS * len(it)) for it in its):
                    hit.add(r.doc_id)
            assert hit and left == ids - hit
        elif name == "secret_redaction":
            before = {r.doc_id: r.text for r in now.select("doc_id", "text").collect()}
            keys = {i: set(re.findall(r'(?:token|secret|password|api_key)\w* = "([0-9a-f]{32,})"', t)) for i, t in before.items()}
            after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
            assert not any(k in after[i] for i, v in keys.items() for k in v)
            assert left == ids and secretscan.scan(out).count() == 0 and sum(before[i] != after[i] for i in ids) <= 0.05 * len(ids)
        else:
            total = {r.doc_id: len(r.text.split()) for r in now.select("doc_id", "text").collect()}
            assert total == {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"n_tokens": "sum"}).toDF("doc_id", "n").collect()}
            assert left == ids and out.groupBy("bin_id").sum("n_tokens").where(f"`sum(n_tokens)` > {packing.CAPACITY}").count() == 0
        now = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, now.collect()))


def test_odd_documents(spark, odd, empty, small):
    """What each stage keeps of nulls, empty and long texts, copies and repeated rows, as its docstring says."""
    left = ["1", "10", "7", "8", "9", "None"]
    want = {"language_id": ["1", "10", "12", "2", "2", "3", "7", "8", "9", "None"], "near_dedup": left, "decontamination": left, "secret_redaction": left}
    for start in (odd, empty):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, small)
            assert now.columns == start.columns
            kept = sorted(str(r.doc_id) for r in now.select("doc_id").collect())
            assert kept == (want[name] if start is odd else []), name
        packed = sorted({r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, small).collect()})
        assert packed == ([1, 7, 8, 9, 10] if start is odd else [])


def test_all_queries_are_registered(spark, small):
    names = entry_points.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(names)


def test_import_errors_are_not_swallowed():
    for f in [Path(corpus_pipeline.__file__), *Path(inspect.getfile(queries)).parent.glob("*.py")]:
        assert "ImportError" not in f.read_text() and "ModuleNotFoundError" not in f.read_text()


def test_nothing_else_imports_llm():
    root = Path(corpus_pipeline.__file__).parent / "treeloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"(?:import|from)[^\n]*\bllm\b", f.read_text())
