"""N-gram Jaccard join over a count-vector R-tree.

1. Every document becomes the set of its shingle hashes; equal sets are one point.
   Each point is a vector of counts: how many shingles fall into each token group.
2. Root directory: the hash range is also cut into D + 1 parts, D being the most
   shingles by which linked sets of such a size may differ; so linked sets are
   equal in one part, and only points with an equal part meet. A document sends
   few 8-byte keys, not its text.
   Of parts that the same points hold one is enough.
3. Points that meet are bounded: the sum of the smaller coordinates is at least
   their overlap. Points that the bound lets link form blocks.
4. In a block, a bulk-loaded R-tree over the count vectors bounds each set against
   whole nodes and then points; what survives is compared shingle by shingle.
   Links are a spanning forest of each block: a pair that is connected already is
   skipped, so a group of copies gives links in proportion to its size.

No bucket has a cap: blocks of more than `tile` different sets are split in
tiles, and each pair of tiles is one task.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import U64, byte_rows, components, cut, discard, mix, release, shingle_set, small

GROUPS = 64
#: Bits of the filter of documents that share a key; 4 MB, whatever the input. More candidates than that let more texts pass, and the join drops those.
FILTER_BITS = 1 << 25


class Bands:
    """Ranges of set sizes, and in how many groups each cuts the hash range.

    Two sets of sizes a <= b link if |A & B| / |A | B| >= num / den, so they differ
    in at most (a + b)(den - num)/(den + num) shingles. Empty groups prove little
    and are common, so each band has `spare` more groups: a pair still shares a
    group with content unless both sets have more than `spare` empty ones; only
    such sets announce their empty groups too.
    """

    def __init__(self, num: int, den: int, ratio: float = 1.7):
        self.num, self.den, self.ratio, self.rows = num, den, ratio, [(1, 1, 1, 0)]

    def _more(self) -> None:
        lo = self.rows[-1][1] + 1
        hi = max(lo, int(lo * self.ratio))
        least = 2 * hi * (self.den - self.num) // (self.den + self.num) + 1
        empty = least * math.exp(-lo / least) if least > 1 else 0
        spare = math.ceil(empty + 3 * math.sqrt(empty))
        self.rows.append((lo, hi, least + spare, spare))

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, groups, spare) of each band that holds a possible larger partner."""
        most = n * self.den // self.num
        while self.rows[-1][1] < most:
            self._more()
        return [(k, p, s) for k, (lo, hi, p, s) in enumerate(self.rows) if lo <= most and hi >= n]


def group_keys(found: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the contents of a sorted set's token groups."""
    out = []
    mixed = mix(found ^ U64(0x5851F42D4C957F2D))
    for band, parts, spare in bands.of(len(found)):
        part = ((found >> U64(32)) * U64(parts)) >> U64(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        tag = U64((band * 0x2545F4914F6CDD1D) & ((1 << 64) - 1))
        key = np.add.reduceat(mixed, starts) + mix(part[starts] + tag)
        out.append(key)
        if parts - len(starts) > spare:
            out.append(mix(np.setdiff1d(np.arange(parts, dtype=U64), part[starts]) + tag) ^ U64(0x94D049BB133111EB))
    return mix(np.concatenate(out))


def key_rows(size: int, num: int, den: int):
    """Batches of (doc_id, text) -> rows (key, doc_id). Of equal sets in a batch the smallest doc_id sends keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in small(batches):
            ids = batch.column(0).to_pylist()
            texts = byte_rows(batch.column(1))
            keys, owners, sent = [np.empty(0, U64)], [np.empty(0, np.int64)], set()
            for k in sorted(range(len(ids)), key=ids.__getitem__):
                found = shingle_set(texts[k], size)
                mark = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if len(found) and mark not in sent:
                    sent.add(mark)
                    keys.append(group_keys(found, bands))
                    owners.append(np.full(len(keys[-1]), ids[k], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "doc_id"])

    return run


def counts_of(found: np.ndarray) -> np.ndarray:
    """Count vector of a set: a power of two of groups, so that a group holds 8 shingles or fewer on average."""
    groups = GROUPS
    while len(found) > 8 * groups:
        groups *= 2
    return np.bincount((found & U64(groups - 1)).astype(np.int64), minlength=groups)


def point_rows(size: int):
    """(doc_id, text) -> (doc_id, n, fp, counts): set size, digest of the whole set and count vector, both null for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_set(t, size) for t in byte_rows(batch.column(1))]
            fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            vectors = [counts_of(s).astype("<u2").tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(fps, pa.binary()), pa.array(vectors, pa.binary())], names=["doc_id", "n", "fp", "counts"])

    return run


def folded(vectors: list[bytes], groups: int) -> np.ndarray:
    """Count vectors as rows, with `groups` groups each."""
    out = np.empty((len(vectors), groups), np.int32)
    for k, v in enumerate(vectors):
        out[k] = np.frombuffer(v, "<u2").reshape(-1, groups).sum(axis=0)
    return out


_LOW8, _LOW16 = U64(0x00FF00FF00FF00FF), U64(0x0000FFFF0000FFFF)


def packed(points: np.ndarray) -> np.ndarray:
    """Points as bytes, eight to a word, if all counts fit and sums of 1024 groups stay in 16 bits; else as they are."""
    return points.astype(np.uint8) if len(points) and points.shape[1] <= 1024 and points.shape[1] % 8 == 0 and points.max() < 256 else points


def overlap_bounds(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the smaller coordinates of points a and b."""
    if points.dtype != np.uint8:
        return np.minimum(points[a], points[b]).sum(axis=1, dtype=np.int64)
    least = np.take(points, a, axis=0)
    words = np.minimum(least, np.take(points, b, axis=0), out=least).view(U64)
    pairs = (words & _LOW8) + ((words >> U64(8)) & _LOW8)  # four sums of two bytes in each word
    total = functools.reduce(np.add, (pairs[:, k] for k in range(pairs.shape[1])))
    total = (total & _LOW16) + ((total >> U64(16)) & _LOW16)
    return ((total & U64(0xFFFFFFFF)) + (total >> U64(32))).astype(np.int64)


def bounded_pairs(key: np.ndarray, doc: np.ndarray, n: np.ndarray, vectors: list[bytes], num: int, den: int) -> np.ndarray:
    """Edges (a, b) that connect what the overlap bound allows to link among rows of equal key; rows come by key."""
    first = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(first) - 1
    ends = np.r_[np.flatnonzero(first)[1:], len(key)]
    # points of a group are compared in as many token groups as its shortest vector has
    length = np.array([len(v) // 2 for v in vectors])
    shortest = np.minimum.reduceat(length, np.flatnonzero(first))[group]
    edges = []
    for groups in np.unique(shortest):
        rows = np.flatnonzero(shortest == groups)
        points = packed(folded([vectors[k] for k in rows], int(groups)))
        end = np.searchsorted(rows, ends[group[rows]])
        size, label = n[rows], np.arange(len(rows))
        left = np.arange(len(rows))
        step = 1
        while len(left := left[left + step < end[left]]):
            i = left[label[left] != label[left + step]]
            i = i[np.minimum(size[i], size[i + step]) * den >= num * np.maximum(size[i], size[i + step])]
            for low in range(0, len(i), 1 << 12):  # as many as stay in the processor's cache
                a = i[low : low + (1 << 12)]
                b = a + step
                ok = overlap_bounds(points, a, b) * (num + den) >= num * (size[a] + size[b])
                a, b = a[ok], b[ok]
                edges.append(np.stack([doc[rows[a]], doc[rows[b]]]))
                for x, y in zip(label[a].tolist(), label[b].tolist(), strict=True):
                    if x != y:  # rows of one label all lie in one key's run
                        lo, hi = min(x, y), max(x, y)
                        run = slice(lo, end[lo])
                        label[run][label[run] == hi] = lo
            step += 1
    found = np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.int64)
    return np.unique(found[:, found[0] != found[1]], axis=1)


def connecting(found: np.ndarray, parent: dict[int, int]) -> np.ndarray:
    """Of edges (a, b) those that connect what parent, which goes on from call to call, did not yet connect."""

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    keep = []
    for k, (a, b) in enumerate(zip(*found.tolist(), strict=True)):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return found[:, keep]


def bound_rows(num: int, den: int):
    """Rows (key, doc_id, n, counts) sorted by key -> edges. A key's rows may go over several batches.

    Near copies share many keys, so a task gives a forest over all its keys: fewer edges
    than it has documents, with the same components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        parent: dict[int, int] = {}

        def edges() -> pa.RecordBatch:
            rows = pa.Table.from_batches(kept)
            column = lambda k: rows.column(k).to_numpy()
            found = connecting(bounded_pairs(column(0), column(1), column(2), rows.column(3).to_pylist(), num, den), parent)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # where the last key, which may go on, begins
            if last or (kept and kept[-1].column(0)[-1].as_py() != key[0]):
                if last:
                    kept.append(batch.slice(0, last))
                yield edges()
                kept = []
            kept.append(batch.slice(last))
        if kept:
            yield edges()

    return run


def _holder_marks() -> list:
    """Numbers whose sums over a key's rows tell who holds it: how many, and 128 bits of hashes in four halves that do not overflow."""
    halves = []
    for seed in (1, 2):
        h = F.xxhash64("doc_id", F.lit(seed))
        halves += [h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32)]
    return [F.lit(1).cast("long"), *halves]


def _slot(doc_id):
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS))


def likely(docs: DataFrame, ids: DataFrame, then=None, schema: str = "doc_id long, text string") -> DataFrame:
    """docs (doc_id, text) that may be among ids (doc_id), or what `then` makes of them: most other texts need not be shuffled to find them out."""
    slot = ids.select(_slot("doc_id").alias("slot"))
    marks = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()
    filled = np.zeros(FILTER_BITS >> 6, U64)
    filled[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64).view(U64)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            found = (shared.value[at >> 6] >> (at & 63).astype(U64)) & U64(1)
            yield batch.select([0, 1]).filter(pa.array(found.astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(passed(batches)) if then else passed(batches)

    return docs.where("doc_id is not null").select("doc_id", "text", _slot(F.col("doc_id")).alias("slot")).mapInArrow(run, schema)


class CountTree:
    """R-tree over count vectors; bulk-loaded by size, then by the coordinate that varies most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        m = len(sizes)
        slab = fan * max(1, math.ceil(math.sqrt(math.ceil(m / fan))))
        order = np.argsort(sizes, kind="stable")
        for at in range(0, m, slab):
            part = order[at : at + slab]
            order[at : at + slab] = part[np.argsort(points[part, points[part].var(axis=0).argmax()], kind="stable")]
        self.order, self.fan = order, fan
        self.levels = [(points[order], sizes[order], sizes[order])]
        while len(self.levels[-1][1]) > fan:
            top, low, high = self.levels[-1]
            starts = np.arange(0, len(low), fan)
            self.levels.append((np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def near(self, point: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """Indices of points whose overlap bound with `point` allows a link."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            fits = (high[at] * den >= num * n) & (n * den >= num * low[at])
            at = at[fits]
            bound = np.minimum(top[at], point).sum(axis=1, dtype=np.int64)
            at = at[bound * (num + den) >= num * (n + low[at].astype(np.int64))]
            if depth:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


def forest(ids: list[int], sets: list[np.ndarray], side: list[int], num: int, den: int, both_sides: bool) -> list[tuple[int, int]]:
    """Links that connect what is connected. both_sides: only pairs of one on each side count."""
    m = len(ids)
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)
    vectors = [counts_of(s) for s in sets]
    points = folded([v.astype("<u2").tobytes() for v in vectors], min(map(len, vectors)))
    as_set = [frozenset(s.tolist()) for s in sets]
    links = []
    tree = CountTree(points, sizes) if m > 2 else None
    for i in range(m):
        near = tree.near(points[i], int(sizes[i]), num, den) if tree else range(m)
        for j in near:
            if j >= i or (both_sides and side[i] == side[j]) or root(i) == root(j):
                continue
            inner = len(as_set[i] & as_set[j])
            if den * inner >= num * (sizes[i] + sizes[j] - inner):
                parent[root(i)] = root(j)
                links.append((ids[i], ids[j]))
    return links


def block_links(size: int, num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        sets = [shingle_set(t, size) for t in rows["text"]]
        cross = bool((rows["i"] != rows["j"]).iloc[0])
        links = forest(rows["rep"].tolist(), sets, rows["mine"].tolist(), num, den, cross)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 9, den: int = 10, tile: int = 512) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles (long), component_id.

    Documents link if their shingle sets' similarity is num/den or more; component_id
    is the smallest doc_id that links reach. Null and blank texts have no shingles
    and link with nothing. Rows that share a doc_id are one document. A null
    doc_id has a null component. Other columns are not read. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    points = cut(docs.mapInArrow(point_rows(size), "doc_id long, n long, fp binary, counts binary"), "points")
    sets = points.where("fp is not null and doc_id is not null")
    reps = sets.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    members = sets.select("fp", "doc_id").join(reps, "fp").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # keys of the different sets, and of those the ones that several have
    rows = likely(docs, reps.select(F.col("rep").alias("doc_id")), key_rows(size, num, den), "key long, doc_id long")
    of_key = Window.partitionBy("key")
    meet = rows.select("key", "doc_id", (F.min("doc_id").over(of_key) < F.max("doc_id").over(of_key)).alias("_many")).where("_many")
    meet = cut(meet.select("key", "doc_id", *[F.sum(x).over(of_key).alias(f"held{k}") for k, x in enumerate(_holder_marks())]), "keys")
    release(docs.sparkSession)  # the keys' shuffle is the largest
    # two sets mostly share many keys; of keys that the same documents hold one is enough
    one = meet.groupBy(*[x for x in meet.columns if x.startswith("held")]).agg(F.min("key").alias("key"))
    dealt = meet.select("key", "doc_id").join(one.select("key"), "key", "left_semi")
    dealt = dealt.join(sets.select("doc_id", "n", "counts"), "doc_id").select("key", "doc_id", "n", "counts").repartition("key").sortWithinPartitions("key", "n", "doc_id")
    blocks = components(dealt.mapInArrow(bound_rows(num, den), "a long, b long"), "blocks")
    discard(meet)
    release(docs.sparkSession)
    # only now do texts move, and only those of sets that the bound lets link; equal sets meet too, which does no harm
    many = blocks.groupBy("component").count().withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
    tiled = blocks.join(many.select("component", "tiles"), "component").select(F.col("component").alias("block"), F.col("node").alias("rep"), "tiles")
    tiled = at_tiles = cut(tiled.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")), "tiled")
    discard(blocks)
    texts = likely(docs, tiled.select(F.col("rep").alias("doc_id"))).select(F.col("doc_id").alias("rep"), F.col("text").cast("binary").alias("text"))
    tiled = tiled.join(texts, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("block", "rep", "text", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    links = tiled.groupBy("block", "i", "j").applyInPandas(block_links(size, num, den), "a long, b long")
    found = components(links.union(members), "links")
    discard(at_tiles)
    own = points.select("doc_id", F.col("n").alias("n_shingles"))
    return own.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without the documents that are linked to one with a smaller doc_id.

    All columns stay as they are, whatever their names. Documents with no words or a
    null doc_id stay; rows that share the doc_id that stays all stay, as they are one
    document. Texts of any length are read whole. An empty table stays empty.
    """
    found = jaccard_components(docs, size, num, den)
    drop = found.where("component_id < doc_id").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_drop"], "left_anti")
