"""Shared helpers: column picking, shared-folder storage, and vectorised word hashing.

Every operator reads only the columns it names, picked by position, so that extra columns of
any name (even `kept` or `TEXT`) pass through or are ignored without clashing.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Texts are hashed in slices of about this many bytes, which bounds the working arrays.
SLICE_BYTES = 1 << 21


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, chosen by exact name and position."""
    at = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])


def keep_rows(df: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of df whose doc_id stands in verdict(doc_id), with df's own columns in order.

    A null doc_id matches a null. verdict holds each doc_id once.
    """
    at = df.columns.index("doc_id")
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    ids = verdict.select(F.col("doc_id").alias("_k"))
    return flat.join(ids, flat[f"_c{at}"].eqNullSafe(ids["_k"]), "left_semi").toDF(*df.columns)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and all runs in one process (tests) is a folder of our own set; a
    cluster without it is refused, as its executors would write to different disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master}")
        base = f"file:///tmp/kgspark-checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kgspark-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that hold more than this share of all rows are joined by broadcast; there are at most HOT_KEYS of them.
HOT_KEYS = 4096


def join_by_weight(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", merge: bool = False) -> DataFrame:
    """rows joined with table (one row for each key; its column `weight` is how many of the `total` rows have the key).

    A key of more than total / HOT_KEYS rows would fill a task of its own in a shuffle. There are fewer than
    HOT_KEYS such keys, whatever the data, so they are broadcast; the rest is joined by a shuffle in which no
    key exceeds that share. Null keys match nothing. how is inner or left. merge asks for a merge join of the
    rest at any size, so that a small input takes the same plan as a large one.
    """
    hot = F.col(weight) * HOT_KEYS > total
    few, many = F.broadcast(table.where(hot)), table.where(~hot)
    many = many.hint("merge") if merge else many
    near = rows.join(few, on, "inner")
    far = rows.join(few.select(*on), on, "left_anti").join(many, on, how)
    return near.unionByName(far)


def discard(spark: SparkSession, *paths: str, shuffles: bool = True) -> None:
    """Deletes stored tables that nothing reads any more, and has the driver drop the shuffle files of finished jobs."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if shuffles:
        gc.collect()
        jvm.System.gc()


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Steele, Lea and Flood 2014), elementwise."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = 1 << 12
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_A, _TAB = np.uint8(65), np.uint8(9)
#: Words are hashed in stretches of about this many bytes.
_STRETCH = 1 << 15


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(seed) << np.uint64(40)
    return splitmix(np.arange(256, dtype=np.uint64) + base), splitmix(np.arange(_PLACES, dtype=np.uint64) + base + np.uint64(1 << 20)) | np.uint64(1)


_HASH = {seed: _tables(seed) for seed in (1, 2)}
for _letters, _ in _HASH.values():
    _letters[_IS_SPACE] = 0


class Words:
    """Words of a slice of texts, as byte ranges of one buffer.

    data: uint8 bytes; doc: offsets of the texts in data; start, end: byte range of each word;
    first: for each text the number of its first word, and one more entry for the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.doc = text_bytes(texts)
        if lower:  # A-Z by sums of bytes, which wrap around
            self.data = self.data + ((self.data - _A < 26).view(np.uint8) << 5)
        n = len(self.data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = (self.data != 32) & (self.data - _TAB > 4)
        before, after = word[:-2].copy(), word[2:].copy()
        inner = self.doc[1:-1]
        before[inner[inner < n]] = False
        after[inner[inner > 0] - 1] = False
        body = word[1:-1]
        self.start = np.flatnonzero(body & ~before)
        self.end = np.flatnonzero(body & ~after) + 1
        self.first = np.searchsorted(self.start, self.doc)
        self.length = self.end - self.start

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit multilinear hash of each word's bytes, finalised."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        letters, places = _HASH[seed]
        sums = np.empty(len(self.start), np.uint64)
        cuts = np.unique(np.searchsorted(self.start, np.arange(self.start[0], self.start[-1] + 1, _STRETCH)))
        for i, j in zip(cuts, np.append(cuts[1:], len(self.start))):  # short stretches, which stay in the caches
            start = self.start[i:j]
            begin, end = int(start[0]), int(self.start[j]) if j < len(self.start) else len(self.data)
            span = np.diff(np.append(start, end))
            place = np.arange(begin, end)
            place -= np.repeat(start, span)
            if int(span.max()) <= _PLACES:
                weight = places.take(place)
            else:
                weight = places[place % _PLACES]
                far = place >= _PLACES
                weight[far] = splitmix(place[far].astype(np.uint64)) | np.uint64(1)
            weight *= letters.take(self.data[begin:end])  # white space counts as 0
            sums[i:j] = np.add.reduceat(weight, start - begin)
        return splitmix(sums ^ (self.length.astype(np.uint64) << np.uint64(48)))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Record batches cut to about `most` bytes of text each; one text is never cut."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.diff(text_bytes(b.column(b.schema.get_field_index(column)))[1])
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of h, by doubling; len(h) - k + 1 of them, order matters."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    a, b = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157)
    part, done, power, size = None, 0, splitmix(h), 1
    while True:
        if k & size:
            if part is None:
                part, done = power, size
            else:
                m = len(h) - (done + size) + 1
                part, done = splitmix(part[:m] * a + power[done : done + m] * b + np.uint64(size)), done + size
        if size * 2 > k:
            return part
        m = len(power) - size
        power, size = splitmix(power[:m] * a + power[size : size + m] * b + np.uint64(size)), size * 2


def spread(first: np.ndarray, k: int) -> np.ndarray:
    """For texts given by first (as in Words), which starts of k-word windows stay inside one text."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    last = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    return at[at + k <= last]
