"""Benchmark decontamination by greedy string tiling.

A document and a benchmark text are cut into tiles: the longest match of tokens
that are not in a tile yet becomes one, again and again, down to `least` tokens.
The share of the benchmark text that lies in tiles shows a leak, also where its
passages were reordered. Candidates come from shared seeds of `least` tokens,
found by running Karp-Rabin hashes over the whole document.

Matches are held as runs along a diagonal, not as pairs of positions, and cut
where a tile takes some of them. So a repetitive text needs memory for its
diagonals only: document length times a few for each position of the benchmark
text where matches begin.

The benchmark is read in blocks of at most BLOCK_BYTES of text, whatever its
size; each block goes to the tasks, and every document meets every block.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import U64, byte_rows, mix, small

BLOCK_BYTES = 8 << 20
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BASE = U64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other than ASCII bytes; A-Z in lower case."""
    return text.translate(_TABLE).split() if text else []


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `width` ids."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), U64)
    for i in range(width):
        out = out * _BASE + ids[i : i + len(out)]
    return out


def runs(places: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches (start in the document, start in the goal, tokens) from seeds.

    places: for each window of the goal the sorted starts of equal windows in the document.
    """
    none = np.empty(0, np.int64)
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    at, length = none, none  # windows that match at the last position, and how many in a row
    for q, now in enumerate([*places, none]):
        if len(at):
            goes_on = np.isin(at + 1, now, assume_unique=True) if len(now) else np.zeros(len(at), bool)
            if not goes_on.all():
                n = length[~goes_on]
                out.append((at[~goes_on] - n + 1, q, n))
        new = np.ones(len(now), np.int64)
        if len(at) and len(now):
            k = np.searchsorted(at, now - 1)
            k[k == len(at)] = 0
            new += np.where(at[k] == now - 1, length[k], 0)
        at, length = now, new
    if not out:
        return none, none, none
    n = np.concatenate([n for *_, n in out])
    ends = np.concatenate([np.full(len(n), q) for _, q, n in out])
    return np.concatenate([p for p, *_ in out]), ends - n, n + (width - 1)


def _free_parts(p: np.ndarray, q: np.ndarray, n: np.ndarray, used_a: np.ndarray, used_b: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """What tiles left of runs: their parts of `least` tokens or more without a used one on either side."""
    bounds = []
    for used in (used_a, used_b):
        at = np.arange(len(used) + 1)
        taken = np.append(used, False)
        next_free = np.minimum.accumulate(np.where(taken, len(used), at)[::-1])[::-1]
        next_used = np.minimum.accumulate(np.where(taken, at, len(used))[::-1])[::-1]
        bounds.append((next_free, next_used))
    (free_a, used_from_a), (free_b, used_from_b) = bounds
    out = []
    while len(n):
        skip = np.maximum(free_a[p] - p, free_b[q] - q)
        moved = skip > 0
        p, q, n = p + skip, q + skip, n - skip
        keep = n >= least
        p, q, n, moved = p[keep], q[keep], n[keep], moved[keep]
        still = moved & (used_a[p] | used_b[q])  # one side is free now, the other may not be
        size = np.minimum(n, np.minimum(used_from_a[p] - p, used_from_b[q] - q))
        good = ~still & (size >= least)
        out.append((p[good], q[good], size[good]))
        size = np.where(still, 0, size)
        p, q, n = p + size, q + size, n - size
        keep = n >= least
        p, q, n = p[keep], q[keep], n[keep]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (p, q, n)


def tile(p: np.ndarray, q: np.ndarray, n: np.ndarray, doc_tokens: int, goal_tokens: int, least: int) -> tuple[int, int]:
    """Tokens of the goal in tiles, and how many tiles, from maximal matches (p, q, n).

    The longest match whose tokens are all free becomes a tile, again and again. Ties
    go to the one that begins first in the goal, then in the document.
    """
    used_a, used_b = np.zeros(doc_tokens, bool), np.zeros(goal_tokens, bool)
    by_length: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)

    def put(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(n, kind="stable")
        p, q, n = p[order], q[order], n[order]
        first = np.flatnonzero(np.append(True, n[1:] != n[:-1])) if len(n) else []
        for low, high in itertools.pairwise([*first, len(n)]):
            by_length[int(n[low])].append((p[low:high], q[low:high]))

    keep = n >= least
    put(p[keep], q[keep], n[keep])
    tiled = count = 0
    while by_length and tiled < goal_tokens:
        longest = max(by_length)
        p, q = (np.concatenate(x) for x in zip(*by_length.pop(longest), strict=True))
        order = np.lexsort((p, q))
        p, q = p[order], q[order]
        taken_a, taken_b = (np.append(0, np.cumsum(u)) for u in (used_a, used_b))
        whole = (taken_a[p + longest] == taken_a[p]) & (taken_b[q + longest] == taken_b[q])
        left = [(p[~whole], q[~whole])]
        p, q = p[whole], q[whole]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else []
        for low, high in itertools.pairwise([*first, len(q)]):  # of those that begin at one place of the goal one at most is taken
            at = int(q[low])
            if not used_b[at : at + longest].any():
                for k in range(low, high):
                    if not (used_a[p[k]] or used_a[p[k] + longest - 1] or used_a[p[k] : p[k] + longest].any()):
                        used_a[p[k] : p[k] + longest] = used_b[at : at + longest] = True
                        tiled += longest
                        count += 1
                        break
            left.append((p[low:high], q[low:high]))
        p, q = (np.concatenate(x) for x in zip(*left, strict=True))
        put(*_free_parts(p, q, np.full(len(p), longest), used_a, used_b, least))
    return tiled, count


class Tiler:
    """Finds texts of one benchmark block in documents."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], least: int, share: float):
        self.least, self.share = least, share
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for item, text in items:
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)]
            if found:
                self.items.append((item, np.array(found, np.int64)))
        self.codes = mix(np.arange(len(self.vocabulary) + 1, dtype=U64) + U64(1))
        # a seed is a window that some text has; its width is `least`, or that of a shorter text, which has to be there as a whole
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[set[int]]]] = {}
        self.of_item: list[tuple[int, np.ndarray]] = []  # width, and the seed of each window
        by_width: dict[int, dict[bytes, int]] = defaultdict(dict)
        holders: dict[int, list[set[int]]] = defaultdict(list)
        for k, (_, ids) in enumerate(self.items):
            width = min(least, len(ids))
            seen = by_width[width]
            mine = [seen.setdefault(ids[at : at + width].tobytes(), len(seen)) for at in range(len(ids) - width + 1)]
            holders[width].extend(set() for _ in range(len(seen) - len(holders[width])))
            for seed in mine:
                holders[width][seed].add(k)
            self.of_item.append((width, np.array(mine)))
        for width, seen in by_width.items():
            windows = np.frombuffer(b"".join(seen), np.int64).reshape(-1, width)
            keys = sum(self.codes[windows[:, i]] * _BASE ** U64(width - 1 - i) for i in range(width))
            order = np.argsort(keys, kind="stable")
            self.seeds[width] = (keys[order], order, windows, holders[width])

    def seeded(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that some benchmark text has, and which seeds they are: equal hashes first, then equal tokens."""
        keys, order, windows, _ = self.seeds[width]
        none = np.empty(0, np.int64)
        known = np.append(0, np.cumsum(ids > 0))
        starts = np.flatnonzero(known[width:] - known[: len(known) - width] == width) if len(ids) >= width else none
        if not len(starts):
            return none, none
        hashes = rolling(self.codes[ids], width)[starts]
        near = np.searchsorted(keys, hashes)
        at, seed = [none], [none]
        while len(starts):  # again only where different windows share a hash
            there = near < len(keys)
            there[there] = keys[near[there]] == hashes[there]
            starts, hashes, near = starts[there], hashes[there], near[there]
            found = order[near]
            same = np.ones(len(starts), bool)
            for i in range(width):
                same &= ids[starts + i] == windows[found, i]
            at.append(starts[same])
            seed.append(found[same])
            starts, hashes, near = starts[~same], hashes[~same], near[~same] + 1
        at, seed = np.concatenate(at), np.concatenate(seed)
        return at, seed

    def hits(self, text: bytes | None) -> list[tuple[int | None, float, int, int]]:
        """(item_id, share of the item in tiles, tokens in tiles, tiles) of each item over the threshold."""
        found = tokens(text)
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))
        out = []
        for width, (*_, holders) in self.seeds.items():
            at, seed = self.seeded(ids, width)
            if not len(at):
                continue
            order = np.lexsort((at, seed))
            at, seed = at[order], seed[order]
            present = np.unique(seed)
            none = at[:0]
            for k in set().union(*(holders[x] for x in present.tolist())):
                item, goal = self.items[k]
                mine = self.of_item[k][1]
                there = np.isin(mine, present)
                reach = np.zeros(len(goal) + 1, np.int64)
                reach[: len(mine)] += there
                reach[width : width + len(mine)] -= there
                if (reach.cumsum() > 0).sum() < self.share * len(goal):  # tiles lie within seeds
                    continue
                low, high = np.searchsorted(seed, mine), np.searchsorted(seed, mine, side="right")
                tiled, count = tile(*runs([at[a:b] if b > a else none for a, b in zip(low, high, strict=True)], width), len(ids), len(goal), width)
                if tiled >= self.share * len(goal):
                    out.append((item, tiled / len(goal), tiled, count))
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0))


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The benchmark (item_id, text), a bounded block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        text = row["text"].encode() if row["text"] else None
        if block and size + len(text or b"") > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text or b"")
    yield block


_tilers: dict[str, Tiler] = {}


def _tiler(shared, ident: str, least: int, share: float) -> Tiler:
    """One for each worker process and block, which ident names."""
    key = f"{ident} {least} {share}"
    if key not in _tilers:
        _tilers.clear()
        _tilers[key] = Tiler(shared.value, least, share)
    return _tilers[key]


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """One row for each document and benchmark text of which tiles cover `share` or more: doc_id, item_id, coverage, tiled, tiles.

    Clean documents have no row. Null and blank texts match nothing. A null doc_id
    or item_id stays null; repeated rows give repeated rows; empty tables give none.
    Texts of any
    length are read whole. Ties: see tile. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks(benchmark):
        shared, ident = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, ident=ident) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                hits = _tiler(shared, ident, least, share).hits
                found = [(d, *h) for d, t in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True) for h in hits(t)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "coverage", "tiled", "tiles"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, coverage double, tiled long, tiles long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """docs, in their columns, without those that leak a benchmark text; no shuffle.

    Null and blank texts stay; rows that repeat another stay or go with it; an empty
    benchmark leaves all, an empty table stays empty. Texts are read whole.
    """
    at = docs.columns.index("text")
    for block in blocks(benchmark):
        shared, ident = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, ident=ident) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                hits = _tiler(shared, ident, least, share).hits
                yield batch.filter(pa.array([not hits(t) for t in byte_rows(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
