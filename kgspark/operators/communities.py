"""Communities: clustering of node vectors, structural refinement, keywords and super nodes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.graph import jaccard
from kgspark.operators.relational import best_per, degrees


def cluster_count(n: int) -> int:
    return min(max(2, n // 10), 200)


def kmeans(vectors: DataFrame, seed: int = 42) -> DataFrame:
    """(node_id, cluster) of rows (node_id, vec): k-means with n // 10 clusters, 2 at least and 200 at most; up to
    two nodes are one cluster."""
    n = vectors.count()
    if n <= 2:
        return vectors.select("node_id", F.lit(0).alias("cluster"))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("node_id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=cluster_count(n), seed=seed, maxIter=20).fit(rows)
    return model.transform(rows).select("node_id", F.col("prediction").alias("cluster"))


def average_link(vectors: np.ndarray, threshold: float, weights: np.ndarray | None = None) -> list[int]:
    """Labels of average-link clusters on cosine distance, merged while closer than 1 - threshold; numbered by
    first member. weights says how many equal vectors each row stands for.

    The mean distance of two clusters is 1 - the product of their mean unit vectors, so memory grows with the
    number of vectors, not with its square; each cluster keeps its nearest later one.
    """
    n = len(vectors)
    if n <= 1:
        return [0] * n
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = np.divide(vectors, length, out=np.zeros_like(vectors, dtype=float), where=length > 0)
    size = np.ones(n) if weights is None else np.array(weights, float)
    live, parent = np.ones(n, bool), np.arange(n)
    near, far = np.zeros(n, int), np.full(n, np.inf)

    def search(rows: np.ndarray) -> None:
        """The nearest live cluster after each of the rows, which are sorted."""
        for at in range(0, len(rows), 256):
            own = rows[at : at + 256]
            first = own[0]
            d = 1 - mean[own] @ mean[first:].T
            d[:, ~live[first:]] = np.inf
            d[np.arange(first, n)[None] <= own[:, None]] = np.inf
            near[own] = d.argmin(1)
            far[own] = d[np.arange(len(own)), near[own]]
            near[own] += first

    search(np.arange(n))
    while True:
        i = int(far.argmin())
        if not far[i] < 1 - threshold:
            break
        j = int(near[i])
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        live[j], far[j], parent[j] = False, np.inf, i
        search(np.flatnonzero(live & ((near == i) | (near == j) | (np.arange(n) == i))))
        d = 1 - mean[:i] @ mean[i]
        closer = live[:i] & ((d < far[:i]) | ((d == far[:i]) & (i < near[:i])))
        near[:i][closer], far[:i][closer] = i, d[closer]
    for k in range(n):  # a cluster's number is its first member's, which stands before it
        parent[k] = parent[parent[k]]
    number: dict[int, int] = {}
    return [number.setdefault(int(x), len(number)) for x in parent]


def average_link_groups(rows: DataFrame, threshold: float) -> DataFrame:
    """(grp, pos, cluster) of rows (grp, pos, vec). Equal vectors of a group are first counted together; one task
    clusters the distinct ones of a group, whatever their number, exactly as average_link says."""
    same = rows.groupBy("grp", "vec").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    keyed = rows.join(same.select("grp", "vec", "first"), ["grp", "vec"])
    return keyed.join(_linked(same, "first", threshold), ["grp", "first"]).select("grp", "pos", "cluster")


def average_link_kinds(rows: DataFrame, kinds: DataFrame, threshold: float) -> DataFrame:
    """(grp, kind, cluster) of rows (grp, pos, kind) whose vectors stand in a table (kind, vec), each once: the clusters
    of average_link_groups(), but only the distinct vectors of a group travel, not one with each row."""
    same = rows.groupBy("grp", "kind").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    return _linked(same.join(kinds.select("kind", "vec"), "kind"), "kind", threshold)


def _linked(same: DataFrame, key: str, threshold: float) -> DataFrame:
    """(grp, key, cluster) of the distinct vectors of each group (grp, key, vec, first, n)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("first")
        own = average_link(np.array(g["vec"].tolist(), float), threshold, g["n"].to_numpy())
        return pd.DataFrame({"grp": g["grp"], key: g[key], "cluster": own})

    kind = {c: same.schema[c].dataType.simpleString() for c in ("grp", key)}
    return same.groupBy("grp").applyInPandas(run, f"grp {kind['grp']}, {key} {kind[key]}, cluster int")


def single_link(vectors: np.ndarray, threshold: float) -> list[int]:
    """Labels of greedy clusters: each vector joins the first cluster that has a member with an inner product of at
    least threshold, or begins one."""
    labels: list[int] = []
    for i, v in enumerate(vectors):
        near = [labels[j] for j in np.flatnonzero(vectors[:i] @ v >= threshold)]
        labels.append(min(near) if near else max(labels, default=-1) + 1)
    return labels


def single_link_groups(rows: DataFrame, threshold: float) -> DataFrame:
    """(grp, pos, cluster) of rows (grp, pos, vec) by single_link() in order of pos; a group is one task's work."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        return pd.DataFrame({"grp": g["grp"], "pos": g["pos"], "cluster": single_link(np.array(g["vec"].tolist(), float), threshold)})

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("grp", "pos")}
    return rows.select("grp", "pos", "vec").groupBy("grp").applyInPandas(run, f"grp {kind['grp']}, pos {kind['pos']}, cluster int")


def fused(edges: DataFrame, centres: DataFrame, weight: float = 0.3) -> DataFrame:
    """(a, b, sim): weight * jaccard of out-neighbours + (1 - weight) * cosine, for pairs within a group (grp,
    node_id, vec); groups are bounded by the clustering that made them."""
    from kgspark.functions.vector import cosine

    pairs = centres.select("grp", F.col("node_id").alias("a"), F.col("vec").alias("va")).join(centres.select("grp", F.col("node_id").alias("b"), F.col("vec").alias("vb")), "grp").where("a < b")
    j = jaccard(edges, centres)
    return pairs.join(j, ["a", "b"], "left").select("grp", "a", "b", (weight * F.coalesce("jaccard", F.lit(0.0)) + (1 - weight) * cosine("va", "vb")).alias("sim"))


def greedy_pairs(pairs: list[tuple], sizes: dict, least: float = 0.5, most: int = 100) -> list[tuple]:
    """Pairs (sim, a, b) accepted best first: similar enough, not too large together, each item once."""
    used, out = set(), []
    for sim, a, b in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
        if sim >= least and sizes[a] + sizes[b] <= most and a not in used and b not in used:
            used |= {a, b}
            out.append((a, b))
    return out


def communities(edges: DataFrame, vectors: DataFrame, store: Callable[[DataFrame, str], DataFrame], weight: float = 0.3, least: float = 0.5, most: int = 100, seed: int = 42) -> DataFrame:
    """(node_id, community): k-means clusters; those of more than three nodes are split again and their parts
    merged in pairs by fused similarity of centres, best first. Communities are numbered by their first node."""
    top = store(kmeans(vectors, seed), "top")

    def refine(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node_id").reset_index(drop=True)
        n, x = len(g), np.array(g["vec"].tolist(), float)
        part = np.zeros(n, int)
        if n > 3:
            rng, k = np.random.default_rng(seed), min(n, cluster_count(n))
            centre = x[rng.choice(n, k, replace=False)]
            for _ in range(20):
                part = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1) if n * k * x.shape[1] < 5e7 else np.array([((v - centre) ** 2).sum(1).argmin() for v in x])
                centre = np.array([x[part == c].mean(0) if (part == c).any() else centre[c] for c in range(k)])
            near = [set(map(str, v)) for v in g["near"]]
            groups = [np.flatnonzero(part == c) for c in range(k)]
            unit = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
            out = [set().union(*(near[i] for i in m)) if len(m) else set() for m in groups]
            pairs = []
            for a in range(k):
                for b in range(a + 1, k):
                    if len(groups[a]) and len(groups[b]):
                        jac = len(out[a] & out[b]) / (len(out[a] | out[b]) + 1e-9)
                        pairs.append((weight * jac + (1 - weight) * float(unit[a] @ unit[b]), a, b))
            for a, b in greedy_pairs(pairs, {c: len(m) for c, m in enumerate(groups)}, least, most):
                part[part == b] = a
        return pd.DataFrame({"node_id": g["node_id"], "cluster": g["cluster"], "part": part})

    near = edges.groupBy(F.col("src").alias("node_id")).agg(F.collect_set("dst").alias("near"))
    rows = vectors.join(top, "node_id").join(near, "node_id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>")))
    split = store(rows.select("node_id", "cluster", "vec", "near").groupBy("cluster").applyInPandas(refine, "node_id string, cluster int, part int"), "split")
    first = split.groupBy("cluster", "part").agg(F.min("node_id").alias("first"))
    number = first.withColumn("community", F.row_number().over(Window.orderBy("first")) - 1)  # at most 200 * 200 rows
    return split.join(number, ["cluster", "part"]).select("node_id", "community")


def community_keywords(membership: DataFrame, edges: DataFrame, vectors: DataFrame, k: int = 5, weight: float = 0.3) -> DataFrame:
    """(community, node_id, score, rank): members by cosine to the community's mean and by degree relative to its largest."""
    from kgspark.functions.vector import centroids, cosine

    rows = membership.join(vectors, "node_id")
    mean = centroids(rows, "community").withColumnRenamed("vec", "mean")
    deg = degrees(edges).select("node_id", "degree")
    rows = rows.join(mean, "community").join(deg, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = rows.groupBy("community").agg(F.max("degree").alias("most"))
    rows = rows.join(top, "community").withColumn("score", weight * F.when(F.col("most") > 0, F.col("degree") / F.col("most")).otherwise(0.0) + (1 - weight) * cosine("vec", "mean"))
    return best_per(rows.select("community", "node_id", "score"), "community", [F.desc("score"), F.col("node_id")], k)


def super_nodes(membership: DataFrame, nodes: DataFrame, keywords: DataFrame, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows to add: community nodes (level 4) of two members or more, keyword nodes (level 3), and their edges
    (src, relation, dst). answers (community, name, summary) names communities; the rest get plain names."""
    named = membership.join(nodes.select("node_id", "name"), "node_id")
    groups = named.groupBy("community").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("members")).where("n >= 2")
    if answers is not None:
        groups = groups.join(answers.select("community", F.col("name").alias("_name"), "summary"), "community", "left")
    else:
        groups = groups.withColumn("_name", F.lit(None).cast("string")).withColumn("summary", F.lit(None).cast("string"))
    comm_id = F.concat(F.lit("comm_"), F.col("community").cast("string"))
    comm = groups.select(comm_id.alias("node_id"), F.lit("community").alias("label"), F.lit(4).alias("level"), F.coalesce("_name", F.concat(F.lit("Community_"), F.col("community").cast("string"))).alias("name"), F.coalesce("summary", F.format_string("Community of %d members", "n")).alias("description"), "members")
    kept = groups.select("community")
    word = keywords.join(kept, "community", "left_semi").join(nodes.select("node_id", "name"), "node_id")
    word_id = F.concat_ws("_", F.lit("kw"), comm_id, "node_id")
    kw = word.select(word_id.alias("node_id"), F.lit("keyword").alias("label"), F.lit(3).alias("level"), "name", F.lit("").alias("description"), F.array().cast("array<string>").alias("members"))
    edge = lambda df, s, r, d: df.select(s.alias("src"), F.lit(r).alias("relation"), d.alias("dst"))
    of = membership.join(kept, "community", "left_semi")
    edges = edge(of, F.col("node_id"), "member_of", comm_id)
    edges = edges.union(edge(word, F.col("node_id"), "represented_by", word_id)).union(edge(word, word_id, "keyword_of", comm_id)).union(edge(word, F.col("node_id"), "kw_filter_by", comm_id))
    return comm.unionByName(kw), edges


def naming_prompts(membership: DataFrame, nodes: DataFrame, centres: DataFrame, shown: int = 10, batch: int = 5) -> DataFrame:
    """(call_id, kind, prompt): communities in batches, each with its centre, first members and size, as JSON."""
    named = membership.join(nodes.select("node_id", "name"), "node_id")
    g = named.groupBy("community").agg(F.count("*").alias("size"), F.slice(F.array_sort(F.collect_list("name")), 1, shown).alias("members")).where("size >= 2")
    g = g.join(centres.select("community", F.col("name").alias("center")), "community", "left").withColumn("call_id", F.floor(F.col("community") / batch))
    item = F.struct(F.col("community").alias("id"), "center", "members", "size")
    return g.groupBy("call_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("prompt")).select("call_id", F.lit("community").alias("kind"), "prompt")
