"""Tree inspection over the node table: plain filters and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.plans import schemas as S

from .nodes import slice_text, trees



def broken() -> Column:
    return F.col("is_error") | F.col("is_missing")


def node_info() -> Column:
    """A node's own properties as one struct."""
    return F.struct(*(F.col(n).cast(t).alias(n) for n, t in S.NODE_FIELDS))


def contains_node_type(table: DataFrame, kind: str) -> DataFrame:
    """(doc_id, found): whether a document has a node of the kind."""
    return table.groupBy("doc_id").agg(F.bool_or(F.col("kind") == kind).alias("found"))


def has_error_nodes(table: DataFrame) -> DataFrame:
    return table.groupBy("doc_id").agg(F.bool_or(broken()).alias("has_error_nodes"))


def error_count(table: DataFrame) -> DataFrame:
    return table.groupBy("doc_id").agg(F.count_if(broken()).alias("error_count"))


def root_node_info(table: DataFrame) -> DataFrame:
    """(doc_id, node): the root of each document."""
    return table.where("parent_id IS NULL").select("doc_id", node_info().alias("node"))


def root_child_count(table: DataFrame) -> DataFrame:
    return table.groupBy("doc_id").agg(F.count_if(F.col("parent_id") == 0).alias("root_child_count"))


def find_nodes_by_type(table: DataFrame, kind: str) -> DataFrame:
    """(doc_id, node_id, node) of the kind, anonymous ones too; order by node_id for document order."""
    return table.where(F.col("kind") == kind).select("doc_id", "node_id", node_info().alias("node"))


def named_children_info(table: DataFrame) -> DataFrame:
    """(doc_id, node_id, node): the root's named children."""
    return table.where("parent_id = 0 AND is_named").select("doc_id", "node_id", node_info().alias("node"))


def named_children_count(table: DataFrame) -> DataFrame:
    return table.groupBy("doc_id").agg(F.count_if((F.col("parent_id") == 0) & F.col("is_named")).alias("named_children_count"))


def tree_metrics(table: DataFrame) -> DataFrame:
    """(doc_id, node_count, error_count, max_depth); the root has depth 0, anonymous nodes count."""
    return table.groupBy("doc_id").agg(F.count("*").alias("node_count"), F.count_if(broken()).alias("error_count"), F.max("depth").alias("max_depth"))


def descendants(table: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Nodes below the nodes of ``ancestor`` (doc_id, node_id, last_desc_id): an interval of pre-order ranks."""
    a = ancestor.select("doc_id", F.col("node_id").alias("ancestor_id"), F.col("last_desc_id").alias("ancestor_last"))
    return table.join(a, "doc_id").where("node_id > ancestor_id AND node_id <= ancestor_last").drop("ancestor_last")


def traverse(table: DataFrame) -> DataFrame:
    """Nodes in pre-order within each document."""
    return table.repartition("doc_id").sortWithinPartitions("doc_id", "node_id")


def extract_text(table: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) from (doc_id, node_id, start_byte, end_byte); null for a range that isn't in the text."""
    s = sources.select("doc_id", F.col("text").alias("__source"))
    return table.join(s, "doc_id").select("doc_id", "node_id", slice_text("__source", F.col("start_byte"), F.col("end_byte")).alias("text"))


def tree_to_sexp(sources: DataFrame) -> DataFrame:
    """(doc_id, sexp): S-expression of the named nodes with field labels."""
    return trees(sources, want_sexp=True, want_nodes=False).select("doc_id", "sexp")


def parse_result(sources: DataFrame, format: str = "sexp") -> DataFrame:
    """(doc_id, output): S-expressions, or JSON of language, sexp and has_errors."""
    t = trees(sources, want_sexp=True, want_nodes=format != "sexp")
    if format == "sexp":
        return t.select("doc_id", F.col("sexp").alias("output"))
    errors = F.exists("nodes", lambda n: n.is_error | n.is_missing)
    return t.select("doc_id", F.to_json(F.struct("language", "sexp", errors.alias("has_errors"))).alias("output"))


