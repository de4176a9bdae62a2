"""Text forms of nodes, edges and chunks, and filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relations that are not shown.
HIDDEN_RELATIONS = ("represented_by", "kw_filter_by")
#: Properties that only keep books on aliases and merges.
BOOKKEEPING = ("node_role", "alias_of", "aliases", "head_dedup", "semantic_dedup")


def chunked(docs: DataFrame, size: int = 0, overlap: int = 0, titled: bool = True) -> DataFrame:
    """(chunk_id, doc_id, pos, text): one chunk a document, `title text`; with a size, pieces of that many
    characters that overlap. The id is the first 8 hex digits of the text's SHA-256, made unique by position."""
    whole = F.trim(F.concat_ws(" ", "title", "text")) if titled and "title" in docs.columns else F.col("text")
    rows = docs.select("doc_id", whole.alias("whole"))
    if size:
        step = max(1, size - overlap)
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("whole") - overlap), F.lit(step))
        rows = rows.select("doc_id", F.posexplode(F.transform(starts, lambda s: F.substr("whole", s, F.lit(size)))).alias("pos", "text"))
    else:
        rows = rows.select("doc_id", F.lit(0).alias("pos"), F.col("whole").alias("text"))
    return rows.select(F.concat(F.substring(F.sha2("text", 256), 1, 8), F.lit("_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("pos").cast("string")).alias("chunk_id"), "doc_id", "pos", "text")


def clean_text(text: Column | str, wide: bool = False) -> Column:
    """Letters, digits, white space and common marks; `wide` keeps those of formulas and code as well."""
    t = F.col(text) if isinstance(text, str) else text
    allowed = r".,;:!?()\[\]{}'\"%$&/+*=<>@#_|~^\\-" if wide else r".,;:!?()'\"-"
    kept = F.trim(F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}\s{allowed}]", ""))
    return F.when(F.trim(F.coalesce(t, F.lit(""))) == "", "[EMPTY_TEXT]").when(kept == "", "[EMPTY_AFTER_CLEANING]").otherwise(kept)


def valid_triples(triples: DataFrame, column: str = "triple") -> DataFrame:
    """Rows whose array has three parts or more, cut to three."""
    return triples.where(F.size(column) >= 3).withColumn(column, F.slice(column, 1, 3))


def main_entities(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("label") == "entity") & ~F.col("node_role").eqNullSafe("alias"))


def is_alias(role: Column | str = "node_role") -> Column:
    return (F.col(role) if isinstance(role, str) else role).eqNullSafe("alias")


def typed_nodes(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Nodes of these schema types, and entities without one; all nodes if no type is given."""
    if not types:
        return nodes
    return nodes.where(F.col("schema_type").isin(types) | (F.col("schema_type").isNull() & (F.col("label") == "entity")))


def has_text(text: Column | str) -> Column:
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (t != "") & ~t.startswith("[Error") & ~t.startswith("[Unknown")


def node_name(nodes: DataFrame) -> Column:
    return F.coalesce(F.when(nodes["name"] != "", nodes["name"]), nodes["node_id"])


def node_text(name: Column | str = "name", description: Column | str = "description", node_id: Column | str = "node_id") -> Column:
    t = F.trim(F.concat_ws(" ", name, description))
    i = F.col(node_id) if isinstance(node_id, str) else node_id
    return F.when(t == "", F.concat(F.lit("[Node: "), i, F.lit("]"))).otherwise(t)


def index_text(name: str = "name", description: str = "description") -> Column:
    some = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none"))
    return F.concat_ws(",", some(name), some(description))


def _extras(props: Column, hidden: tuple[str, ...]) -> Column:
    shown = F.map_filter(props, lambda k, v: ~k.isin(*hidden) & v.isNotNull() & (v != ""))
    return F.concat_ws(", ", F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))


def node_properties(props: str = "props") -> Column:
    """`[k: v, …]` without what other texts say already."""
    return F.concat(F.lit("["), _extras(F.col(props), ("name", "description", "properties", "label", "chunk id", "level")), F.lit("]"))


def describe_node(name: str = "name", props: str = "props", label: str = "label", node_id: str = "node_id", for_clustering: bool = False) -> Column:
    """`name (k: v, …) [label]`, less where parts are missing; for clustering without chunk id and label."""
    hidden = ("name", *BOOKKEEPING, *(("chunk id",) if for_clustering else ()))
    extras = _extras(F.col(props), hidden)
    n, lab = F.nullif(F.col(name), F.lit("")), F.nullif(F.col(label), F.lit(""))
    more = F.when(extras != "", F.concat(F.lit(" ("), extras, F.lit(")"))).otherwise("")
    end = F.lit("") if for_clustering else F.when(lab.isNotNull(), F.concat(F.lit(" ["), lab, F.lit("]"))).otherwise("")
    unnamed = F.when(extras != "", F.concat(F.coalesce(lab, F.lit("node")), F.lit(" ("), extras, F.lit(")"))).otherwise(F.concat(F.coalesce(lab, F.lit("node")), F.lit(":"), F.col(node_id)))
    return F.when(n.isNotNull(), F.concat(n, more, end)).otherwise(unnamed)


def short_node_text(name: str = "name", description: str = "description") -> Column:
    d = F.nullif(F.col(description), F.lit(""))
    return F.when(d.isNull(), F.col(name)).otherwise(F.concat_ws(" - ", name, description))


def community_text(members: str = "members") -> Column:
    """The first three members, and how many more there are."""
    m = F.col(members)
    return F.concat(F.concat_ws(", ", F.slice(m, 1, 3)), F.when(F.size(m) > 3, F.concat(F.lit(" and "), (F.size(m) - 3).cast("string"), F.lit(" more"))).otherwise(""))


def merged_chunk_ids(ids: Column | str) -> Column:
    """Sorted, distinct, without empty ones; none: null."""
    x = F.array_sort(F.array_distinct(F.filter(F.col(ids) if isinstance(ids, str) else ids, lambda v: v != "")))
    return F.when(F.size(x) > 0, x)


def shown_triples(edges: DataFrame, nodes: DataFrame, score: str | None = None) -> DataFrame:
    """(edge_id, text): `(head [props], relation, tail [props])` with the score if there is one, hidden relations left out."""
    end = nodes.select("node_id", F.concat_ws(" ", node_name(nodes), F.when(F.size(F.coalesce("props", F.create_map().cast("map<string,string>"))) > 0, node_properties())).alias("t"))
    h, t = end.select(F.col("node_id").alias("src"), F.col("t").alias("_h")), end.select(F.col("node_id").alias("dst"), F.col("t").alias("_t"))
    rows = edges.where(~F.col("relation").isin(*HIDDEN_RELATIONS)).join(h, "src").join(t, "dst")
    text = F.concat(F.lit("("), "_h", F.lit(", "), "relation", F.lit(", "), "_t", F.lit(")"))
    if score:
        text = F.concat(text, F.format_string(" [score: %.3f]", F.col(score).cast("double")))
    return rows.select("edge_id", text.alias("text"))


def report(nodes: DataFrame) -> DataFrame:
    """(level, text): the texts of each level's nodes, in order of id."""
    rows = nodes.select("level", F.struct("node_id", short_node_text().alias("t")).alias("x"))
    return rows.groupBy("level").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])).alias("text"))


def subgraph_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (text): the nodes of a small subgraph, then its edges, as lines in order of their ids. Edges whose ends
    are not among the nodes are left out."""
    name = nodes.select("node_id", node_name(nodes).alias("n"), "label")
    line = name.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("edge_id"), "node_id", F.concat(F.lit("- "), "n", F.lit(" ["), "label", F.lit("]")).alias("line"))
    ends = edges.join(name.select(F.col("node_id").alias("src"), F.col("n").alias("s")), "src").join(name.select(F.col("node_id").alias("dst"), F.col("n").alias("t")), "dst")
    arcs = ends.select(F.lit(1).alias("part"), "edge_id", F.lit("").alias("node_id"), F.concat(F.lit("- "), "s", F.lit(" -["), "relation", F.lit("]-> "), "t").alias("line"))
    every = line.unionByName(arcs).agg(F.array_sort(F.collect_list(F.struct("part", "edge_id", "node_id", "line"))).alias("x"))
    of = lambda k: F.transform(F.filter("x", lambda e: e["part"] == k), lambda e: e["line"])
    return every.select(F.concat_ws("\n", F.concat(F.array(F.lit("Nodes:")), of(0), F.array(F.lit("Edges:")), of(1))).alias("text"))
