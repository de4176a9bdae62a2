"""Canonical schemas of graphs, texts and calls."""

NODES = (
    "node_id string, label string, level int, name string, description string, schema_type string, chunk_ids array<string>, "
    "members array<string>, node_role string, alias_of string, props map<string,string>"
)
EDGES = "edge_id long, src string, dst string, relation string, source_chunks array<string>"
CHUNKS = "chunk_id string, text string"
MAPPING = "dup string, canon string, method string, confidence double, rationale string"
END = "struct<label:string,properties:map<string,string>>"
TRIPLES = f"start_node {END}, relation string, end_node {END}"

#: Level of each label; any other label is level 2.
LEVELS = {"attribute": 1, "entity": 2, "keyword": 3, "community": 4}

#: Relations that connect aliases and structure, which semantic dedup leaves alone.
ALIAS_RELATIONS = ("等同于", "alias_of", "alias_includes", "also_known_as")
PROTECTED_RELATIONS = (*ALIAS_RELATIONS, "member_of", "represented_by", "kw_filter_by", "keyword_of")
