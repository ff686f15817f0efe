"""Schemas and enumerations of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

_span = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start_line", "start_col", "end_line", "end_col")])
_attrs = T.MapType(T.StringType(), T.StringType())

NODE = T.StructType(
    [T.StructField(n, T.StringType(), n not in ("id", "kind")) for n in ("id", "kind", "name", "fqn", "file_path", "language", "parent_id", "content_hash", "docstring", "role")]
    + [T.StructField("span", _span), T.StructField("is_test_file", T.BooleanType()), T.StructField("local_seq", T.IntegerType()), T.StructField("attrs", _attrs)]
)
EDGE = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("id", "kind", "source_id", "target_id")]
    + [T.StructField("span", _span), T.StructField("local_seq", T.IntegerType()), T.StructField("attrs", _attrs)]
)
REPOSITORY = T.StructType([T.StructField(n, T.StringType()) for n in ("repo_id", "name", "remote_url", "local_path", "default_branch")] + [T.StructField(n, T.TimestampType()) for n in ("created_at", "updated_at")])
SNAPSHOT = T.StructType([T.StructField(n, T.StringType()) for n in ("snapshot_id", "repo_id", "commit_hash", "branch_name")] + [T.StructField("created_at", T.TimestampType())])
CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("chunk_id", "repo_id", "snapshot_id", "file_path")]
    + [T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("kind", "fqn", "language", "visibility", "content", "content_hash", "summary")]
    + [T.StructField("importance", T.FloatType()), T.StructField("is_deleted", T.BooleanType()), T.StructField("attrs", _attrs), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)
DEPENDENCY = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "from_chunk_id", "to_chunk_id", "relationship")] + [T.StructField("confidence", T.FloatType()), T.StructField("created_at", T.TimestampType())])
FILE_METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "repo_id", "snapshot_id", "file_path", "content_hash")] + [T.StructField("last_analyzed", T.TimestampType())])
LEXICAL = T.StructType([T.StructField(n, T.StringType()) for n in ("content", "string_literals", "comments", "docstring", "file_path", "repo_id")] + [T.StructField("indexed_at", T.TimestampType())])
COMMIT = T.StructType([T.StructField("commit", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("path", T.StringType()), T.StructField("adds", T.LongType()), T.StructField("dels", T.LongType()), T.StructField("author", T.StringType())])
CONSTRAINT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("lhs", T.LongType()), T.StructField("rhs", T.LongType()), T.StructField("field", T.StringType())])

# Kinds of nodes and edges, chunk levels and effect severities of the data model.
NODE_KINDS = (
    "File", "Module", "Class", "Interface", "Function", "Method", "Variable", "Field", "Import", "Enum", "TypeAlias", "Lambda", "MethodReference",
    "TypeParameter", "Property", "Constant", "Export", "Expression", "Block", "Condition", "Loop", "TryCatch", "Type", "Signature", "CfgBlock",
    "ExternalModule", "ExternalFunction", "ExternalType", "Route", "Service", "Repository", "Config", "Job", "Middleware", "Summary", "Document",
    "TemplateDoc", "TemplateElement", "TemplateSlot", "TemplateDirective",
)
EDGE_KINDS = (
    "CONTAINS", "DEFINES", "CALLS", "READS", "WRITES", "REFERENCES", "IMPORTS", "INHERITS", "IMPLEMENTS", "REFERENCES_TYPE", "REFERENCES_SYMBOL",
    "DECORATES", "INSTANTIATES", "OVERRIDES", "USES", "READS_RESOURCE", "WRITES_RESOURCE", "THROWS", "ROUTE_TO", "USES_REPO", "CAPTURES", "ACCESSES",
    "SHADOWS", "CFG_NEXT", "CFG_BRANCH", "CFG_LOOP", "CFG_HANDLER", "ROUTE_HANDLER", "HANDLES_REQUEST", "USES_REPOSITORY", "MIDDLEWARE_NEXT",
    "DOCUMENTS", "REFERENCES_CODE", "DOCUMENTED_IN", "RENDERS", "BINDS", "ESCAPES", "CONTAINS_SLOT", "TEMPLATE_CHILD",
)
CHUNK_LEVELS = {"repo": 0, "project": 1, "module": 2, "file": 3, "class": 4, "function": 5}
