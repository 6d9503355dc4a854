"""What several corpus operators share: shared storage, words, hashing, components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MASK = (1 << 64) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset, as in local tests, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local_dir()
    return found.rstrip("/")


@functools.cache
def _local_dir() -> str:
    """One folder for each process that runs Spark locally without a shared one."""
    return "file://" + tempfile.mkdtemp(prefix="shared-")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: nothing before it is computed again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    except Exception:
        _delete(df.sparkSession, path)
        raise
    return written(df.sparkSession.read.schema(df.schema).parquet(path), path)


def written(df: DataFrame, path: str | None) -> DataFrame:
    """df with the place of the table that it reads, for discard."""
    df._written = path
    return df


def discard(df: DataFrame) -> None:
    """Delete the table that `cut` wrote for df. Only after another table has been written from it and nothing else will read it: a lost executor's work then begins at that one."""
    if path := getattr(df, "_written", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Have the driver drop what it no longer refers to, so that executors delete the shuffle files of written tables now and not at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; null or no :// gives ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def byte_rows(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one stays small; spare memory goes back after each batch."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
        del batch
        pa.default_memory_pool().release_unused()


def by_bytes(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have `most` bytes or fewer together, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


def words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case; none for null."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input changes about half of the output."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class WordHash(dict):
    """word -> stable 64-bit hash, remembered for up to `most` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), U64, len(found))


_word_hash = WordHash()


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `size` words.

    Fewer words give one shingle of all of them, no words none. Two different
    shingles share a 64-bit hash with a chance of 2**-64.
    """
    found = words(text)
    if not found:
        return np.empty(0, U64)
    h = _word_hash.of(found)
    width = min(size, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, U64)
    for i in range(width):
        out *= U64(0xA24BAED4963EE407)
        out += h[i : i + n]
    return np.unique(mix(out))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is its smallest node.

    Alternates large-star and small-star steps, each a minimum for each node with
    partial aggregation and a join that the adaptive planner may split, so a node
    with very many edges is never gathered in one task. Rounds end in written
    tables, until two equal ones follow each other; each is deleted after the next. Edges with a null are left out.
    """
    at = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").distinct(), name)
    seen = None
    while True:
        both = at.select(F.col("a").alias("u"), F.col("b").alias("v")).union(at.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        top = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(top, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(joined.select("a", F.col("m").alias("b"))).distinct()
        before, at = at, cut(small, name)
        discard(before)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return written(at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(at.select("b", "b").distinct()), at._written)
        seen = now
