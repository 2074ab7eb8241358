"""Vocabularies and table layouts of the property graph."""

from __future__ import annotations

# Kinds of nodes.
KINDS = "file module package class struct interface enum enummember function method constructor field property variable constant import typeparameter route channel macro union typealias other".split()
# Relations of edges.
RELATIONS = "defines calls references imports implements of_type overrides has_method has_field data_flows changes_with similar_to requests notifies".split()
# Least confidence of each grade.
GRADES = {"heuristic": 1, "constrained": 85, "exact": 100}

SEMANTIC = ("calls", "references", "imports", "implements", "of_type", "overrides")
REFERENTIAL = (*SEMANTIC, "requests", "notifies")
CONTAINMENT = ("defines", "has_method", "has_field")
#: Kinds of the graph over the bundled tables, beside KINDS.
DOMAIN_KINDS = ("region", "nation", "customer", "supplier", "part", "order", "document", "page")
#: Properties that a query can read.
PROPERTIES = {"id": "int", "eid": "text", "name": "text", "path": "text", "kind": "text", "exported": "bool", "signature": "text", "in_degree": "int", "out_degree": "int", "scc_size": "int", "community": "int"}


# Layouts, as DDL.
NODES = "id bigint, eid string, kind string, name string, path string, signature string, exported boolean, content_hash string, span_start int, span_end int"
EDGES = "src bigint, dst bigint, rel string, confidence int"
EVIDENCE = "src bigint, dst bigint, name string, rel string, reason string, outcome string, confidence int, candidates int, span_start int, span_end int, alternatives array<bigint>"
DATAFLOW = "src bigint, dst bigint, arg_index int, param_index int, class string, expr string, span_start int, span_end int"
OBSERVED = "src bigint, dst bigint, cnt bigint"
FILES = "path string, text string, lang string, size bigint, error_nodes int, error_bytes bigint, digest string"
EMPTY = {"evidence": EVIDENCE, "dataflow": DATAFLOW, "observed": OBSERVED, "files": FILES}
