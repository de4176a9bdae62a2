"""Graph operators on edge DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b); component is its smallest node.

    Alternating large-star and small-star (Kiveris et al. 2014): O(log n) rounds, each a grouped minimum
    with map-side combine and a join back on the node, which AQE can split when one node is in many edges.
    `store(df, name)` writes each round's edges where a lost executor cannot take them along.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = store(pairs, "edges0")
    seen = None
    for i in range(1, 200):
        # Large star: link each larger neighbour of a node to the smallest in its neighbourhood.
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: link a node's smaller neighbours, and itself, to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        pairs = store(small.where("a <> b").distinct(), f"edges{i}")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle after 199 rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def hops(edges: DataFrame, starts: DataFrame, k: int, store: Callable[[DataFrame, str], DataFrame], only: DataFrame | None = None) -> DataFrame:
    """(start, node_id, depth): nodes within k out-edges of each start, itself at depth 0, at their least depth.

    `only` (node_id) restricts the nodes that may be reached. Each round joins the frontier with the edges and
    drops what was reached before.
    """
    arcs = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("next")).distinct()
    if only is not None:
        arcs = arcs.join(only.select(F.col("node_id").alias("next")), "next", "left_semi")
    frontier = starts.select("start", F.col("start").alias("node_id")).distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, k + 1):
        found = frontier.join(arcs, "node_id").select("start", F.col("next").alias("node_id")).distinct()
        frontier = store(found.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti"), f"hop{depth}")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return seen


def neighbour_triples(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(start, edge_id, src, relation, dst): all edges into and out of the nodes reached from each start."""
    r = reached.select("start", "node_id")
    out = edges.join(r, F.col("src") == F.col("node_id"))
    into = edges.join(r, F.col("dst") == F.col("node_id"))
    return out.select("start", "edge_id", "src", "relation", "dst").union(into.select("start", "edge_id", "src", "relation", "dst")).distinct()


def keyword_paths(edges: DataFrame, texts: DataFrame, starts: DataFrame, keywords: list[str], depth: int = 2) -> DataFrame:
    """Edges (src, relation, dst) of paths of at most `depth` edges from the starts to a node whose text contains
    a keyword; of parallel edges the first. A path visits no node twice."""
    first = edges.groupBy("src", "dst").agg(F.min_by("relation", "edge_id").alias("relation"))
    words = F.array(*[F.lit(w.lower()) for w in keywords])
    hit = texts.select("node_id").where(F.exists(words, lambda w: F.lower(texts["text"]).contains(w)))
    paths = starts.select(F.array("node_id").alias("nodes"), F.array().cast("array<struct<src:string,relation:string,dst:string>>").alias("path"))
    out = None
    for _ in range(depth):
        last = paths.withColumn("src", F.element_at("nodes", -1)).join(first, "src").where(~F.array_contains("nodes", F.col("dst")))
        paths = last.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("path", F.array(F.struct("src", "relation", "dst"))).alias("path"))
        ended = paths.withColumn("node_id", F.element_at("nodes", -1)).join(hit, "node_id", "left_semi").select("path")
        out = ended if out is None else out.union(ended)
    return out.select(F.inline("path")).distinct()


def resolved(mapping: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(dup, canon) with chains followed to their ends by pointer doubling; identities are dropped.

    A cycle ends at its member with the largest position (mapping.pos if there, else the name), as if its entry
    had been the last to be processed.
    """
    pos = F.col("pos") if "pos" in mapping.columns else F.col("dup")
    m = mapping.where("dup <> canon").select("dup", "canon", pos.alias("pos")).groupBy("dup").agg(F.max_by("canon", "pos").alias("canon"), F.max("pos").alias("pos"))
    m = store(m, "map0")
    # Nodes on a cycle: their own successors after enough doublings come back to them.
    top = m.select("dup", F.col("canon").alias("at"), F.struct(F.col("pos"), F.col("dup")).alias("best"))
    seen = None
    for i in range(1, 64):
        nxt = top.select(F.col("dup").alias("at"), F.col("at").alias("_at"), F.col("best").alias("_best"))
        top = store(top.join(nxt, "at", "left").select("dup", F.coalesce("_at", "at").alias("at"), F.greatest("best", F.coalesce("_best", "best")).alias("best"), F.col("_at").isNull().alias("ended")), f"map{i}")
        now = tuple(top.agg(F.count_if("ended"), F.count("*")).first())
        if now[0] == now[1] or (now == seen and i > 1 and 2**i > now[1]):
            break
        seen = now
    ends = top.where("ended").select("dup", F.col("at").alias("canon"))
    loops = top.where("not ended").select("dup", F.col("at"))
    if loops.isEmpty():
        return ends.where("dup <> canon")
    # Every node that never ends lies on a cycle or leads into one; the cycle's own nodes are those reached.
    ring = loops.select(F.col("at").alias("dup")).distinct().join(m, "dup").select("dup", "canon", "pos")
    labels = connected_components(ring.select(F.col("dup").alias("a"), F.col("canon").alias("b")), lambda df, n: store(df, f"ring_{n}"))
    root = ring.join(labels, F.col("dup") == F.col("node")).groupBy("component").agg(F.max_by("dup", F.struct("pos", "dup")).alias("canon"))
    where = labels.join(root, "component").select(F.col("node").alias("at"), "canon")
    return ends.union(loops.join(where, "at").select("dup", "canon")).where("dup <> canon")


def combined_mappings(exact: DataFrame, semantic: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Exact and semantic (dup, canon) as one resolved mapping; for a node in both the semantic entry counts."""
    kept = exact.select("dup", "canon").join(semantic.select("dup"), "dup", "left_anti")
    return resolved(kept.unionByName(semantic.select("dup", "canon")), store)


def jaccard(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, jaccard), a < b: shared distinct out-neighbours among members(node_id), for pairs that share one."""
    n = members.select("node_id").distinct()
    arcs = edges.select("src", "dst").distinct()
    arcs = arcs.join(n, F.col("src") == F.col("node_id"), "left_semi").join(n, F.col("dst") == F.col("node_id"), "left_semi")
    size = arcs.groupBy("src").agg(F.count("*").alias("n"))
    pairs = arcs.select(F.col("src").alias("a"), "dst").join(arcs.select(F.col("src").alias("b"), "dst"), "dst").where("a < b")
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("inter"))
    both = both.join(size.select(F.col("src").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("src").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter") + 1e-9)).alias("jaccard"))


def triple_strings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, triple): `name relation name` of each node's out-edges, distinct, the first of parallel edges."""
    first = edges.groupBy("src", "dst").agg(F.min_by(F.coalesce("relation", F.lit("related_to")), "edge_id").alias("relation"))
    n = nodes.select("node_id", F.coalesce("name", "node_id").alias("name"))
    rows = first.join(n.select(F.col("node_id").alias("src"), F.col("name").alias("a")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("b")), "dst")
    return rows.select(F.col("src").alias("node_id"), F.concat_ws(" ", "a", "relation", "b").alias("triple")).distinct()


def issues(nodes: DataFrame, edges: DataFrame, alias_relations: tuple[str, ...] = ()) -> DataFrame:
    """(issue, id): orphans, self_loops, dangling_edges, missing_metadata; with alias relations also
    invalid_alias_nodes (not exactly one out-edge, or another one) and alias_chains."""
    n = nodes.select("node_id")
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    found = [
        n.join(ends, "node_id", "left_anti").select(F.lit("orphans").alias("issue"), F.col("node_id").alias("id")),
        edges.where("src = dst").select(F.lit("self_loops"), F.col("edge_id").cast("string")),
        edges.join(n, F.col("src") == F.col("node_id"), "left_anti").select(F.lit("dangling_edges"), F.col("edge_id").cast("string")),
        edges.join(n, F.col("dst") == F.col("node_id"), "left_anti").select(F.lit("dangling_edges"), F.col("edge_id").cast("string")),
        nodes.where("label is null or name is null or name = ''").select(F.lit("missing_metadata"), F.col("node_id")),
    ]
    if alias_relations:
        alias = nodes.where(F.col("node_role").eqNullSafe("alias")).select("node_id")
        out = edges.select(F.col("src").alias("node_id"), "relation", "dst")
        per = alias.join(out, "node_id", "left").groupBy("node_id").agg(F.count("relation").alias("n"), F.count_if(F.col("relation").isin(*alias_relations)).alias("ok"))
        found.append(per.where("n <> 1 or ok <> 1").select(F.lit("invalid_alias_nodes"), F.col("node_id")))
        chain = out.where(F.col("relation").isin(*alias_relations)).join(alias, "node_id", "left_semi").join(alias.select(F.col("node_id").alias("dst")), "dst", "left_semi")
        found.append(chain.select(F.lit("alias_chains"), F.col("node_id")))
    union = found[0]
    for f in found[1:]:
        union = union.union(f)
    return union.distinct()


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def alias_targets(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """(node_id, main): an alias's target by its alias edge, any other node itself."""
    first = edges.where(F.col("relation").isin(*relations)).groupBy("src").agg(F.min_by("dst", "edge_id").alias("dst"))
    out = nodes.select("node_id", "node_role").join(first, F.col("node_id") == F.col("src"), "left")
    return out.select("node_id", F.when(F.col("node_role").eqNullSafe("alias"), F.coalesce("dst", "node_id")).otherwise(F.col("node_id")).alias("main"))


def paths_to_root(mapping: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(dup, path, root, cyclic) of a mapping (dup, canon): the nodes met from each duplicate to its end, in order. A path
    that comes back to a node it has met ends there and is cyclic.

    Paths double in each round, so a chain of n nodes takes log n joins.
    """
    own = mapping.where("dup <> canon").groupBy("dup").agg(F.max("canon").alias("canon"))
    paths = store(own.select("dup", F.array("canon").alias("path")), "paths0")
    seen = None
    for i in range(1, 64):
        ahead = paths.select(F.col("dup").alias("_at"), F.col("path").alias("_more"))
        grown = paths.withColumn("_end", F.element_at("path", -1)).join(ahead, F.col("_end") == F.col("_at"), "left")
        whole = F.concat("path", F.coalesce("_more", F.array().cast("array<string>")))
        # up to the first node that stands on the path before, or is its start
        met = F.filter(F.sequence(F.lit(1), F.size("_all")), lambda k: (F.element_at("_all", k) == F.col("dup")) | (F.array_position("_all", F.element_at("_all", k)) < k))
        grown = grown.select("dup", whole.alias("_all")).withColumn("_cut", F.get(met, F.lit(0)))
        paths = store(grown.select("dup", F.when(F.col("_cut").isNull(), F.col("_all")).otherwise(F.expr("slice(_all, 1, _cut)")).alias("path"), F.col("_cut").isNotNull().alias("cyclic")), f"paths{i}")
        now = tuple(paths.agg(F.count_if("cyclic"), F.sum(F.size("path"))).first())
        if now == seen:
            return paths.select("dup", "path", F.element_at("path", -1).alias("root"), "cyclic")
        seen = now
    raise RuntimeError("paths did not end after 63 doublings")


def steps_to_root(mapping: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(dup, root, steps, cyclic) of a mapping (dup, canon): the end and the length of each path of paths_to_root().

    Only pointers and numbers of steps double, so a row stays as small as it is, however long the paths.
    """
    own = store(mapping.where("dup <> canon").groupBy("dup").agg(F.max("canon").alias("canon")), "own")
    whole = _doubled(own, store, "steps")
    ended = whole.where("ended").select("dup", F.col("at").alias("root"), "steps", F.lit(False).alias("cyclic"))
    loops = whole.where("not ended")
    if loops.isEmpty():
        return ended
    # After as many steps as there are such nodes each stands on its cycle, and each of a cycle's nodes is reached.
    ring = store(loops.select(F.col("at").alias("dup")).distinct().join(own, "dup"), "ring")
    labels = connected_components(ring.select(F.col("dup").alias("a"), F.col("canon").alias("b")), lambda df, n: store(df, f"ring_{n}"))
    rings = store(labels.join(labels.groupBy("component").agg(F.count("*").alias("n")), "component").select(F.col("node").alias("root"), "n"), "rings")
    round_ = rings.select(F.col("root").alias("dup"), "root", F.col("n").alias("steps"), F.lit(True).alias("cyclic"))
    tails = own.join(loops.select("dup"), "dup", "left_semi").join(ring.select("dup"), "dup", "left_anti")
    into = _doubled(store(tails, "tails"), store, "into").select("dup", F.col("at").alias("root"), "steps")
    return ended.union(round_).union(into.join(rings, "root").select("dup", "root", F.col("steps") + F.col("n"), F.lit(True)))


def _doubled(own: DataFrame, store: Callable[[DataFrame, str], DataFrame], name: str) -> DataFrame:
    """(dup, at, steps, ended) of a mapping (dup, canon) with one row a dup: the end of each chain and the steps to it; what
    has not ended runs in circles and has gone as many steps as there are such rows, or more."""
    is_dup = own.select(F.col("dup").alias("_dup"))
    now = own.join(is_dup, F.col("canon") == F.col("_dup"), "left")
    now = store(now.select("dup", F.col("canon").alias("at"), F.lit(1).cast("long").alias("steps"), F.col("_dup").isNull().alias("ended")), f"{name}0")
    left = -1
    for i in range(1, 64):
        before, left = left, now.where("not ended").count()
        if left == 0 or (left == before and 2 ** (i - 1) >= left):
            return now
        ahead = now.select(F.col("dup").alias("_dup"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("ended").alias("_ended"))
        more = now.where("not ended").join(ahead, F.col("at") == F.col("_dup")).select("dup", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_ended").alias("ended"))
        now = store(now.where("ended").union(more), f"{name}{i}")
    raise RuntimeError("chains did not end after 63 doublings")


def frequent_roots(mapping: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(dup, canon): each merge group represented by the node that stands in most of its pairs.

    A node is frequent if it stands in max(2, min(3, most - 1)) pairs or more, `most` being the largest number of
    any node. A group without one keeps the node that its pairs call canonical most often. Ties go to the node
    that is canonical more often, then to the smallest id.
    """
    pairs = store(mapping.where("dup <> canon").select("dup", "canon").distinct(), "pairs")
    ends = pairs.select(F.col("dup").alias("node"), F.lit(0).alias("c")).union(pairs.select("canon", F.lit(1)))
    count = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("c").alias("as_canon"))
    limit = count.agg(F.greatest(F.lit(2), F.least(F.lit(3), F.max("n") - 1)).alias("least"))
    labels = connected_components(pairs.select(F.col("dup").alias("a"), F.col("canon").alias("b")), store)
    rows = labels.join(count, "node").crossJoin(F.broadcast(limit))
    worth = F.when(F.col("n") >= F.col("least"), F.col("n")).otherwise(0)
    root = rows.groupBy("component").agg(F.min_by("node", F.struct(-worth, -F.col("as_canon"), F.col("node"))).alias("canon"))
    return labels.join(root, "component").where("node <> canon").select(F.col("node").alias("dup"), "canon")
