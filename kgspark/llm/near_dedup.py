"""Near-duplicate components by banded min-max sketches, links confirmed on the full shingle sets.

1. Each text gives its shingle-set size, two 64-bit sums over the set and the band keys of its min-max
   sketch. Texts with equal sets form a class; only its smallest doc_id goes on.
2. Classes that share a band key meet in a bucket. Each bucket first compares all members with its
   smallest one (links of a star: linear in the bucket). Confirmed links are joined into components.
3. Buckets whose members still lie in different components are compared exactly: every member outside
   the bucket's largest component with every member, in blocks of at most about BLOCK by BLOCK texts
   dealt over tasks. A block is one matrix product over shared shingles and gives a spanning forest of
   its links, never its pairs. So no candidate is capped, and work falls to what the stars left open.
4. The links of 2 and 3 give the final components.

With 24 bands of 4 values (48 permutations) a pair of similarity 0.8 shares no band with probability
3e-6; higher similarities, less.

Defined results: null or empty texts, and those of white space only, have size 0, link with nothing and
are kept. Rows with a null doc_id are scored but never linked: component_id null, kept true. Rows that
repeat a doc_id are one document that has all its rows' links; each gives a result row. Empty tables give
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import join_by_weight, keep_rows, pick, shared_dir, slices, splitmix, stored
from kgspark.llm.minmax import band_keys, shingle_sets, sketches
from kgspark.operators.graph import connected_components

#: Texts of a block when all members of a bucket are compared; partners of a hub that make up one job.
BLOCK, STAR = 512, 64


def _set_sums(grams: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (splitmix(grams), splitmix(~grams)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        out.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
    return out[0], out[1]


def _sketched(k: int, perms: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            grams, off = shingle_sets(b.column(1), k)
            n = np.diff(off)
            one, two = _set_sums(grams, off)
            keys = band_keys(sketches(grams, off, perms), rows).view(np.int64)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(one), pa.array(two), bands], ["doc_id", "n", "s1", "s2", "bands"])

    return run


def _exact_links(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs (of a, of b) with 100 * intersection >= percent * union, as one matrix product."""
    sizes = np.array([len(x) for x in (*a, *b)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values, column, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    for at in range(0, int((count > 1).sum()), width):
        i, j = np.searchsorted(column, (at, at + width))
        dense = np.zeros((len(sizes), min(width, int(column[j - 1]) - at + 1 if j > i else 1)), np.float32)
        dense[owner[i:j], column[i:j] - at] = 1
        both += dense[: len(a)] @ dense[len(a) :].T
    union = sizes[: len(a), None] + sizes[None, len(a) :] - both
    return np.nonzero(100 * both >= percent * union)


def _job_links(k: int, percent: int):
    """Reads rows (job, role, id, s1, text) sorted by job and role; gives a spanning forest of each job's links."""

    def forest(a: dict, b: dict) -> list[tuple[int, int]]:
        ia, ib, parent, out = list(a), list(b), {}, []

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = p = parent.get(p, p)
                x = p
            return x

        for x, y in zip(*_exact_links(list(a.values()), list(b.values()), percent)):
            u, v = root(ia[x]), root(ib[y])
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((ia[x], ib[y]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, sides = None, ({}, {})

        def done():
            links = forest(*sides) if sides[0] and sides[1] else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in slices(batches):
            grams, off = shingle_sets(batch.column(4), k)
            one = _set_sums(grams, off)[0]
            for i, (key, role, doc, s1) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if key != job:
                    if job is not None:
                        yield done()
                    job, sides = key, ({}, {})
                if one[i] == s1:  # else another row of a repeated doc_id
                    sides[role][doc] = grams[off[i] : off[i + 1]].copy()
        if job is not None:
            yield done()

    return run


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, perms: int = 48, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    path = shared_dir(docs.sparkSession)
    save = lambda df, name: stored(df, f"{path}/{name}")
    texts = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sk = save(texts.mapInArrow(_sketched(k, perms, rows), "doc_id long, n long, s1 long, s2 long, bands array<long>"), "sketches")

    real = sk.where("n > 0 and doc_id is not null")
    classes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    spots = save(classes.select("rep", "s1", F.explode("bands").alias("key")), "spots")
    buckets = spots.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("hub")).where("m > 1")
    met = save(spots.join(buckets.select("key", "hub"), "key"), "met")
    sums = met.select(F.col("rep").alias("id"), "s1").distinct()

    def links(jobs: DataFrame, name: str) -> DataFrame:
        full = jobs.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select("job", "role", "id", "s1", "text")
        return save(full.repartition("job").sortWithinPartitions("job", "role").mapInArrow(_job_links(k, percent), "a long, b long"), name)

    # Stars: each member with the smallest of its bucket; partners of one hub are dealt into blocks.
    star = met.where("rep <> hub").select("hub", "rep", "s1").distinct()
    parts = star.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("long").alias("parts"))
    star = star.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    members = star.select(F.struct("hub", "part").alias("job"), F.lit(1).alias("role"), F.col("rep").alias("id"), "s1")
    hubs = star.select("hub", "part").distinct().join(sums, F.col("hub") == F.col("id"))
    hubs = hubs.select(F.struct("hub", "part").alias("job"), F.lit(0).alias("role"), "id", "s1")
    first = links(members.union(hubs), "links1")
    label = connected_components(first, lambda df, name: save(df, f"cc1/{name}"))

    # Buckets that still hold several components: those outside the largest one against all members.
    open_ = met.join(label, F.col("rep") == F.col("node"), "left").select("key", "rep", "s1", F.coalesce("component", "rep").alias("comp"))
    open_ = save(open_, "open")
    by = open_.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
    by = by.agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1 and m > 2")
    by = by.select("key", F.col("top.comp").alias("major"), F.ceil(F.col("m") / BLOCK).cast("long").alias("mb"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("long").alias("ub"))
    left = save(open_.join(by, "key"), "left")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    rest = left.where("comp <> major").select("key", deal("ub").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1)).alias("j"), F.lit(0).alias("role"), "rep", "s1")
    all_ = left.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ub") - 1)).alias("i"), deal("mb").alias("j"), F.lit(1).alias("role"), "rep", "s1")
    second = links(rest.union(all_).select(F.struct("key", "i", "j").alias("job"), "role", F.col("rep").alias("id"), "s1"), "links2")

    sizes = save(classes.select("s1", "s2", "rep", "size"), "sizes")
    placed = join_by_weight(real.select("doc_id", "s1", "s2"), sizes, ["s1", "s2"], "size", real.count()).groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.collect_set("rep").alias("reps"))
    placed = save(placed, "placed")
    twice = placed.where("lo <> hi").select(F.explode("reps").alias("a"), F.col("lo").alias("b"))
    label = connected_components(first.union(second).union(twice), lambda df, name: save(df, f"cc2/{name}"))
    ids = placed.join(label, F.col("lo") == F.col("node"), "left").select(F.col("doc_id").alias("_d"), F.coalesce("component", "lo").alias("component_id"))
    out = sk.select("doc_id", F.col("n").alias("n_shingles")).join(ids, F.col("doc_id") == F.col("_d"), "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the smallest doc_id; columns as they were."""
    verdict = near_groups(docs, k, percent).where("kept").select("doc_id").distinct()
    return keep_rows(docs, verdict)
