"""Exact dedup on a sharded cuckoo-filter index with insertion and deletion of live digests.

A text is known by its SHA-256 digest. Each shard (a hash partition of the digests) holds a cuckoo
filter whose slots point into content buckets: the full digest, a second independent 64-bit content
hash and the byte length. A filter hit is only a suspicion; it counts as a copy after all three agree
with the bucket. A filter that overflows is rebuilt at twice the size from the stored keys.

Copies collapse inside each input partition before anything is shuffled, so a group of copies that
holds a third of all rows sends one entry for each input partition; only ids and digests move.

Defined results: a null text counts as empty and equals other empty texts. Of equal texts the row with
the largest doc_id stays; a null doc_id is smaller than any. Rows repeated with the same doc_id and
text: one of them is kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.llm.common import join_by_weight, pick, shared_dir, stored

#: Entries of the index: op is 0 for stored ones, 1 for insertions, 2 for deletions.
ENTRY = "digest binary, other long, bytes long, keep_id long, keep_row long, copies long, op int"
_FIELDS = pa.schema([("digest", pa.binary()), ("other", pa.int64()), ("bytes", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("copies", pa.int64()), ("op", pa.int32())])
_SLOTS, _KICKS = 4, 200


class CuckooIndex:
    """A cuckoo filter (Fan et al. 2014) over content buckets kept in flat arrays, about 100 bytes an entry."""

    def __init__(self, buckets: int = 256):
        self.digests = bytearray()
        self.other, self.bytes, self.keep, self.row, self.copies = (array("q") for _ in range(5))
        self.known = bytearray()  # 1: keep is a real id, 0: null
        self.live = 0
        self._make(buckets)

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * buckets * _SLOTS))  # 0: free
        self.entry = array("L", bytes(array("L").itemsize * buckets * _SLOTS))

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _homes(self, digest: bytes) -> tuple[int, int, int]:
        p = self._print(digest)
        a = int.from_bytes(digest[8:16], "little") & self.mask
        return p, a, self._other_home(a, p)

    def _other_home(self, bucket: int, p: int) -> int:
        return bucket ^ ((p * 0x5BD1E995) & self.mask)

    def find(self, digest: bytes, other: int, size: int) -> int:
        """Number of the live entry with this content, or -1. A fingerprint hit is verified against the bucket."""
        p, a, b = self._homes(digest)
        for home in (a, b) if a != b else (a,):
            for s in range(home * _SLOTS, home * _SLOTS + _SLOTS):
                if self.prints[s] == p:
                    e = self.entry[s]
                    if self.digests[32 * e : 32 * e + 32] == digest and self.other[e] == other and self.bytes[e] == size:
                        return e
        return -1

    def _place(self, e: int) -> bool:
        digest = bytes(self.digests[32 * e : 32 * e + 32])
        p, a, b = self._homes(digest)
        for home in (a, b):
            for s in range(home * _SLOTS, home * _SLOTS + _SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.entry[s] = p, e
                    return True
        home = a
        for kick in range(_KICKS):
            s = home * _SLOTS + (kick * 7 + p) % _SLOTS
            p, self.prints[s] = self.prints[s], p
            e, self.entry[s] = self.entry[s], e
            home = self._other_home(home, p)
            for s in range(home * _SLOTS, home * _SLOTS + _SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.entry[s] = p, e
                    return True
        return False

    def _resize(self) -> None:
        """Rebuilds the filter from the stored keys, doubling until all of them fit."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._make(buckets)
            if all(self._place(e) for e in range(len(self.copies)) if self.copies[e] > 0):
                return

    def insert(self, digest: bytes, other: int, size: int, keep: int | None, copies: int, row: int = 0) -> None:
        """Adds copies of a text, the best of which has the id `keep` and stands in `row`; of equal ids the first row stays."""
        e = self.find(digest, other, size)
        if e >= 0:
            self.copies[e] += copies
            was = (self.known[e], self.keep[e], -self.row[e])
            if (int(keep is not None), keep or 0, -row) > was:
                self.keep[e], self.known[e], self.row[e] = keep or 0, keep is not None, row
            return
        self.digests += digest
        self.other.append(other)
        self.bytes.append(size)
        self.keep.append(0 if keep is None else keep)
        self.known.append(keep is not None)
        self.row.append(row)
        self.copies.append(copies)
        self.live += 1
        if self.live > 0.94 * _SLOTS * (self.mask + 1) or not self._place(len(self.copies) - 1):
            self._resize()

    def delete(self, digest: bytes, other: int, size: int) -> bool:
        """Takes the digest out of the filter and its bucket; its text is then unknown again."""
        e = self.find(digest, other, size)
        if e < 0:
            return False
        _, a, b = self._homes(digest)
        for home in (a, b):
            for s in range(home * _SLOTS, home * _SLOTS + _SLOTS):
                if self.prints[s] and self.entry[s] == e:
                    self.prints[s] = 0
        self.copies[e] = 0
        self.live -= 1
        return True

    def entries(self) -> Iterator[pa.RecordBatch]:
        rows = [e for e in range(len(self.copies)) if self.copies[e] > 0]
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bytes(self.digests[32 * e : 32 * e + 32]) for e in part], pa.binary()),
                    pa.array([self.other[e] for e in part], pa.int64()),
                    pa.array([self.bytes[e] for e in part], pa.int64()),
                    pa.array([self.keep[e] if self.known[e] else None for e in part], pa.int64()),
                    pa.array([self.row[e] for e in part], pa.int64()),
                    pa.array([self.copies[e] for e in part], pa.int64()),
                    pa.array([0] * len(part), pa.int32()),
                ],
                schema=_FIELDS,
            )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        for digest, other, size, keep, row, copies, op in zip(*(c.to_pylist() for c in b.columns)):
            if op == 2:
                index.delete(digest, other, size)
            else:
                index.insert(digest, other, size, keep, copies, row)
    yield from index.entries()


def _content(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.unhex(F.sha2(t, 256)).alias("digest"), F.xxhash64(t).alias("other"), F.octet_length(t).cast("long").alias("bytes")]


def digested(docs: DataFrame) -> DataFrame:
    """digest, other, bytes, doc_id and row, a number of its own, for each row of docs."""
    return pick(docs, "doc_id", "text").select(*_content(F.col("text")), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"))


def entries_of(rows: DataFrame, op: int = 1) -> DataFrame:
    """Index entries of digested rows, with copies collapsed within each input partition."""
    rows = rows.select("digest", "other", "bytes", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("copies"), F.lit(1).alias("op"))
    return rows.mapInArrow(_apply, ENTRY).withColumn("op", F.lit(op))


class ExactDedup:
    """An index of live texts in a folder that all executors share. Each change writes a new version."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.version = spark, path or shared_dir(spark), 0
        self.state: DataFrame | None = None

    def _change(self, ops: DataFrame) -> None:
        rows = ops if self.state is None else self.state.unionByName(ops)
        shards = rows.repartition("digest").sortWithinPartitions("op") if self.state is not None else rows.repartition("digest")
        self.version += 1
        self.state = stored(shards.mapInArrow(_apply, ENTRY), f"{self.path}/v{self.version}")

    def insert(self, docs: DataFrame) -> None:
        self.insert_digested(digested(docs))

    def insert_digested(self, rows: DataFrame) -> None:
        self._change(entries_of(rows))

    def delete(self, docs: DataFrame) -> None:
        """Makes the texts of docs unknown again, all copies of each."""
        self._change(entries_of(digested(docs), op=2))

    def live(self) -> DataFrame:
        """One row for each live text: digest, other, bytes, keep_id, keep_row, copies."""
        if self.state is None:
            return self.spark.createDataFrame([], ENTRY).drop("op")
        return self.state.drop("op")


def exact_groups(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    index = ExactDedup(docs.sparkSession)
    rows = stored(digested(docs), f"{index.path}/rows")
    index.insert_digested(rows)
    # Only groups with copies are joined to the rows, the largest by broadcast; a row that finds none stands alone.
    groups = index.live().where("copies > 1").select("digest", "keep_id", "keep_row", F.col("copies").alias("group_size"))
    found = join_by_weight(rows.select("digest", "doc_id", "row"), groups, ["digest"], "group_size", rows.count(), "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without the copies that go; all columns as they were.

    Rows repeated with one doc_id but different texts are told apart by the text; of rows with one doc_id and one
    text the one whose other columns come first as strings stays.
    """
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at, text = docs.columns.index("doc_id"), docs.columns.index("text")
    index = ExactDedup(docs.sparkSession)
    index.insert(docs)
    groups = index.live().where("copies > 1").select(F.col("digest").alias("_h"), F.col("keep_id").alias("_keep"), F.col("copies").alias("_copies"))
    marked = join_by_weight(flat.withColumn("_h", _content(F.col(f"_c{text}"))[0]), groups, ["_h"], "_copies", docs.count(), "left", merge=True)
    alone = marked.where(F.col("_copies").isNull())
    first = Window.partitionBy("_h").orderBy(*[F.col(f"_c{i}").cast("string") for i in range(len(docs.columns)) if i != text])
    best = marked.where(F.col("_copies").isNotNull() & F.col(f"_c{at}").eqNullSafe(F.col("_keep"))).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return alone.unionByName(best).select(*flat.columns).toDF(*docs.columns)
