"""Bounded-space online packing of token sequences.

Each task reads its documents once and keeps a fixed number of open windows. A
piece goes to the open window that it fits best. If it fits none, the fullest
window takes as much of it as it lacks, is emitted, and the rest of the piece
goes on; so emitted windows have no padding. What is open at the end of a task is
merged: into full windows in the task itself, and the last, partial window of
each task with those of other tasks. A sequence may be a power of two long, so
the last tokens of each merge are cut into such lengths and need no padding either.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import byte_rows, cut, small
from lumenframe.llm.tokens import encoder, forget

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
END = (1).to_bytes(4, "little")
#: How many tasks' leftovers one merge takes: at most MERGED windows of ids.
MERGED = 256

Piece = tuple[int | None, int, bytes, int]  # doc_id, start, ids, tokens of the document


def split(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


class Packer:
    """Windows of `size` tokens, at most `most` of them open."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.room: list[tuple[int, int]] = []  # (free tokens, slot), sorted
        self.open: dict[int, list[Piece]] = {}
        self.slots = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def put(self, piece: Piece) -> None:
        while len(piece[2]) >= 4 * self.size:
            head, piece = split(piece, self.size)
            self.emit([head])
        while n := len(piece[2]) // 4:
            k = bisect.bisect_left(self.room, (n, -1))
            if k < len(self.room):  # best fit
                free, slot = self.room.pop(k)
                self.open[slot].append(piece)
                if free == n:
                    self.emit(self.open.pop(slot))
                else:
                    bisect.insort(self.room, (free - n, slot))
                return
            if len(self.room) < self.most:
                self.open[self.slots] = [piece]
                bisect.insort(self.room, (self.size - n, self.slots))
                self.slots += 1
                return
            free, slot = self.room.pop(0)  # the fullest
            head, piece = split(piece, free)
            self.emit(self.open.pop(slot) + [head])

    def merge(self) -> list[Piece]:
        """Emit full windows from all open ones; returns the pieces of less than one window that are left."""
        left: list[Piece] = []
        have = 0
        for _, slot in self.room:
            for piece in self.open.pop(slot):
                while have + len(piece[2]) // 4 >= self.size:
                    head, piece = split(piece, self.size - have)
                    self.emit([*left, head])
                    left, have = [], 0
                if piece[2]:
                    left.append(piece)
                    have += len(piece[2]) // 4
        self.room = []
        return left

    def close(self, left: list[Piece]) -> None:
        """Emit pieces as sequences whose lengths are powers of two."""
        have = sum(len(p[2]) // 4 for p in left)
        while have:
            n = 1 << (have.bit_length() - 1)
            have -= n
            out = []
            while n:
                piece = left.pop(0)
                if len(piece[2]) // 4 > n:
                    piece, rest = split(piece, n)
                    left.insert(0, rest)
                out.append(piece)
                n -= len(piece[2]) // 4
            self.emit(out)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _packed(path: str, size: int, most: int):
    """(doc_id, text) -> rows of SCHEMA, and left: ids of a piece that is not placed yet (then sequence_id and offset give its order)."""
    names = [*FIELDS, "left"]
    kinds = [pa.int64()] * len(FIELDS) + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, ids = Packer(size, most, part << 32), encoder(path).ids

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in small(batches):
            for doc, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                coded = ids(text) + END
                packer.put((doc, 0, coded, len(coded) // 4))
            yield rows([(*r, None) for r in packer.taken()])
        left = packer.merge()
        yield rows([(*r, None) for r in packer.taken()] + [(doc, start, len(b) // 4, 0, total, part, k, b) for k, (doc, start, b, total) in enumerate(left)])

    return run


def _merged(size: int):
    """One merge's leftovers, as an Arrow table: ids and nulls stay what they are."""
    kinds = [pa.int64()] * len(FIELDS)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        forget()  # what is left has its ids already
        packer = Packer(size, 1, (1 << 62) + (key[0].as_py() << 32))
        for r in rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            packer.put((r["doc_id"], r["start"], r["left"], r["doc_tokens"]))
        packer.close(packer.merge())
        columns = list(zip(*packer.taken(), strict=True)) or [()] * len(FIELDS)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=FIELDS)

    return run


def pack(docs: DataFrame, path: str, size: int = 2048, most: int = 64) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and id 1, so a null or blank text is one token.
    Sequences hold `size` tokens or a power of two below, without padding. Which
    documents share one depends on how the table is split. A text longer than
    `size` goes on in the next windows, to its end. A null doc_id stays null and
    changes no other id; repeated rows are packed each. An empty table gives no
    rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(_packed(path, size, most), f"{SCHEMA}, left binary")
    # each task leaves less than one window; MERGED tasks' leftovers meet
    made = cut(made, "packed")
    rest = made.where("left is not null").withColumn("merge", F.floor(F.col("sequence_id") / MERGED).cast("long"))
    tail = rest.groupBy("merge").applyInArrow(_merged(size), SCHEMA)
    return made.where("left is null").select(*FIELDS).union(tail)
