"""Schemas of results."""

from __future__ import annotations

SPAN = "struct<start_byte:bigint,end_byte:bigint,start_line:bigint,start_column:bigint,end_line:bigint,end_column:bigint>"
NODE_FIELDS = [
    ("kind", "string"), ("is_named", "boolean"), ("start_byte", "bigint"), ("end_byte", "bigint"), ("start_row", "bigint"), ("start_col", "bigint"),
    ("end_row", "bigint"), ("end_col", "bigint"), ("named_child_count", "bigint"), ("is_error", "boolean"), ("is_missing", "boolean"),
]
NODE_INFO = "struct<" + ",".join(f"{n}:{t}" for n, t in NODE_FIELDS) + ">"
#: One row for each node: pre-order rank, parent's rank, last rank of the subtree, places among siblings, depth.
TREE_FIELDS = [("node_id", "bigint"), ("parent_id", "bigint"), ("last_desc_id", "bigint"), ("sib_idx", "bigint"), ("named_sib_idx", "bigint"), ("depth", "bigint"), ("field_name", "string"), *NODE_FIELDS]
NODES = "doc_id bigint, language string, " + ", ".join(f"{n} {t}" for n, t in TREE_FIELDS) + ", text binary"
CAPTURE = f"struct<name:string,node:{NODE_INFO}>"
CAPTURE_RESULT = f"struct<name:string,node:{NODE_INFO},text:string,child_fields:map<string,string>,start_byte:bigint>"
CHUNK = (
    "struct<content:string,start_byte:bigint,end_byte:bigint,start_line:bigint,end_line:bigint,metadata:struct<language:string,chunk_index:bigint,total_chunks:bigint,node_types:array<string>,"
    "context_path:array<string>,symbols_defined:array<string>,comments:array<struct<text:string,kind:string,span:" + SPAN + ",associated_node:string>>,docstrings:array<string>,has_error_nodes:boolean>>"
)
