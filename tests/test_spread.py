"""How many rows and bytes a task parses doesn't depend on how a table's files are cut."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from treeloom.plans import queries


@pytest.mark.parametrize("most", ["ROWS", "BYTES"])
def test_one_row_group(spark, tmp_path, monkeypatch, most):
    """A file of one row group, split by the scan into as many partitions as there are cores, of which one has all rows."""
    n = 4000
    pq.write_table(pa.table({"event_id": range(n), "props": [f'{{"k": {i}}}' for i in range(n)]}), str(tmp_path / "events.parquet"), row_group_size=n)
    monkeypatch.setattr(queries, most, 500)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        assert spark.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        parts = queries._events(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert sum(r.n for r in parts) == n
    assert max(r.n if most == "ROWS" else r.size for r in parts) < 1000


def test_no_rows(spark, tmp_path):
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "html": pa.array([], pa.string())}), str(tmp_path / "pages.parquet"))
    assert queries._pages(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["json_run_query_pairs", "json_udtf", "html_extract_from_trees", "html_predicates_negated", "json_traverse", "json_nodes_by_kind", "json_extract_text", "json_error_flag", "json_tree_metrics", "json_contains_object"])
def test_pieces_follow_rows(spark, small, monkeypatch, name):
    """Each query parses in as many pieces as its rows need, more than there are cores."""
    monkeypatch.setattr(queries, "ROWS", 2)
    rows = spark.read.parquet(f"{small}/{'pages' if name.startswith('html') else 'events'}.parquet").count()
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert f", {-(-rows // 2)}\n" in plan and rows // 2 > spark.sparkContext.defaultParallelism
