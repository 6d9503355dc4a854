"""Log-likelihood of documents under a gated recurrent language model.

Words are counted over all training documents. Frequent words are the network's
own; they fall into classes of equal size, and the output is a softmax over
classes and one over the words of the class. Less frequent words fall into
classes by rank, in which they have their share of the counts; the last class
holds all rarer words and those that training has not seen. The output starts as
the words' frequencies, so training can only add what the context tells.

Texts are read twice: once to count, once to write each document as ranks in the
shared folder. Training and scoring read that table.

Training: truncated backpropagation over windows, with the state carried from one
window to the next. Every training document is learnt from in each pass, in a round
found by hashing; a corpus of few words has more passes. A round's documents are dealt
to trainers that work alone; their weights are averaged after it. No text goes to the
driver.

Scoring: whole documents, side by side by length; the state is carried through
all windows of a document, so its likelihood is complete.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import by_bytes, byte_rows, cut, small, words

END = b"\n"  # no word holds it
F32, F16 = np.float32, np.float16


@dataclass(frozen=True)
class Config:
    hidden: int = 16
    embedding: int = 16
    network_words: int = 4096
    class_words: int = 64
    head_words: int = 200_000  # words that every task knows, with their counts
    window: int = 32
    streams: int = 256  # texts side by side in training, at most
    steps: int = 300  # a trainer's aim in a round; with fewer words it has fewer texts side by side
    rounds: int = 2  # a pass learns from each training document in one of them
    pass_words: int = 2_000_000  # a smaller corpus has as many passes as reach this, up to most_passes
    most_passes: int = 4
    trainer_words: int = 2_000_000  # for each trainer and round
    most_trainers: int = 4096  # beyond, each trainer reads more
    rate: float = 0.02
    seed: int = 7

    def passes(self, total: int) -> int:
        return max(1, min(self.most_passes, math.ceil(self.pass_words / max(total, 1))))

    def trainers(self, total: int) -> int:
        return int(min(self.most_trainers, max(1, total // (max(self.rounds, 1) * self.trainer_words))))

    def side_by_side(self, total: int) -> int:
        """Streams of a trainer: few for few words, as more steps then help more than larger ones."""
        each = total / (max(self.rounds, 1) * self.trainers(total))
        return int(min(self.streams, max(16, each // (self.window * self.steps))))


@dataclass
class Head:
    """The frequent words: rank -> count, class, place in the class, input; and sums over all words."""

    ranks: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    config: Config
    rare_total: int = 0
    # by rank; the last two places are those of no word (-2) and of a rare one (-1)
    classes: np.ndarray = field(init=False)
    inputs: np.ndarray = field(init=False)
    fixed: np.ndarray = field(init=False)  # log10 share in a class; 0 for the network's words
    base: np.ndarray = field(init=False)  # log10 probability by counts; 0 for rare words

    def __post_init__(self):
        n, c = len(self.counts), self.config
        self.network = min(c.network_words, n)
        self.network_classes = math.ceil(self.network / c.class_words)
        rank = np.arange(n)
        by_rank = np.floor(np.log2(np.maximum(rank, 1) / max(1, self.network))).astype(np.int64)
        classes = np.where(rank < self.network, rank // c.class_words, self.network_classes + np.maximum(by_rank, 0))
        self.n_classes = int(classes.max()) + 2 if n else 1  # the last one is that of rare words
        self.n_inputs = self.network + self.n_classes - self.network_classes
        self.rare_distinct = self.distinct - n
        mass = np.bincount(classes, self.counts, self.n_classes) if n else np.zeros(1)
        self.rare_total = int(self.total - self.counts.sum())
        mass[-1] = max(self.rare_total, 1)
        self.mass = mass
        self.classes = np.append(classes, [0, self.n_classes - 1])
        self.inputs = np.append(np.where(rank < self.network, rank, self.network + classes - self.network_classes), [0, self.n_inputs - 1])
        self.fixed = np.append(np.where(rank < self.network, 0.0, np.log10(self.counts / mass[classes])), [0.0, 0.0])
        self.base = np.append(np.log10((self.counts + 1) / (self.total + self.distinct + 1)), [0.0, 0.0])
        self.first = self.ranks.get(END, -1)

    def coded(self, found: list[bytes]) -> np.ndarray:
        """Ranks of words, -1 for rare ones."""
        return np.fromiter(map(self.ranks.get, found, repeat(-1)), np.int32, len(found))

    @property
    def start(self) -> int:
        """Input before a document's first word: its end mark."""
        return int(self.inputs[self.first])


SHAPES = ("emb", "wx", "b", "u", "wc", "bc", "ww", "bw")


def initial(head: Head) -> dict[str, np.ndarray]:
    c = head.config
    rng = np.random.default_rng(c.seed)
    h, e, w = c.hidden, c.embedding, c.class_words
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(F32)
    inside = np.full(max(head.network_classes, 1) * w, 1e-9)
    inside[: head.network] = head.counts[: head.network]
    inside = inside.reshape(-1, w)
    return {
        "emb": normal(head.n_inputs, e, scale=0.3), "wx": normal(e, 3 * h, scale=e**-0.5), "b": np.zeros(3 * h, F32), "u": normal(h, 3 * h, scale=h**-0.5),
        "wc": np.zeros((h, head.n_classes), F32), "bc": np.log(head.mass / head.mass.sum()).astype(F32),
        "ww": np.zeros((len(inside), h, w), F32), "bw": np.log(inside / inside.sum(1, keepdims=True)).astype(F32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += F32(1)
    return np.reciprocal(x, out=x)


def _exp(logits: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """In place the exponentials of rows of logits, their sums, and what was taken off each row.

    States lie between -1 and 1, so weights and bias bound the logits. While they
    are far from what float32 can hold nothing is taken off, else each row's maximum.
    """
    off: np.ndarray | float = 0.0
    if len(logits) and float((np.abs(weights).sum(-2) + np.abs(bias)).max()) > 60:
        off = logits.max(axis=1)
        logits -= off[:, None]
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], F32), off


def step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step from inputs x (already multiplied) and states h; the new states first."""
    n = h.shape[1]
    hu = h @ u
    gates = _sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
    z, r = gates[:, :n], gates[:, n:]
    new = r * hu[:, 2 * n :]
    new += x[:, 2 * n :]
    np.tanh(new, out=new)
    out = h - new
    out *= z
    out += new
    return out, z, r, new, hu


class Within:
    """Rows in the order of their classes, so that each network class is one slice; and the logits of the class's words."""

    def __init__(self, states: np.ndarray, cls: np.ndarray, goal: np.ndarray, weights: dict[str, np.ndarray], classes: int):
        self.order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[self.order], np.arange(classes + 1))
        self.slices = [(k, slice(bounds[k], bounds[k + 1])) for k in range(classes) if bounds[k] < bounds[k + 1]]
        self.rows = self.order[: bounds[-1]]  # those of network classes
        words = weights["bw"].shape[1]
        self.place = goal[self.rows] - cls[self.rows] * words
        self.states = states[self.rows]
        self.logits = np.empty((len(self.rows), words), F32)
        for k, part in self.slices:
            np.matmul(self.states[part], weights["ww"][k], out=self.logits[part])
            self.logits[part] += weights["bw"][k]
        self.at = np.arange(len(self.rows))


class Trainer:
    """Truncated backpropagation with Adam, over streams of documents side by side."""

    def __init__(self, head: Head, weights: dict[str, np.ndarray], streams: int | None = None):
        self.head, self.c = head, head.config
        self.streams = streams or self.c.streams
        self.w = {k: v.copy() for k, v in weights.items()}
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.t = self.tokens = 0
        self.state = np.zeros((self.streams, self.c.hidden), F32)
        self.last = np.full(self.streams, head.first)
        self.queues: list[list[np.ndarray]] = [[] for _ in range(self.streams)]
        self.waiting = [0] * self.streams

    def add(self, ranks: np.ndarray) -> None:
        k = self.waiting.index(min(self.waiting))
        self.queues[k].append(ranks)
        self.waiting[k] += len(ranks)
        while min(self.waiting) >= self.c.window:
            self.train(self.c.window)

    def finish(self) -> None:
        """All that is left. A stream without words takes over the second half of the longest queue, so a long text is learnt from to its end."""
        while any(self.waiting):
            for k in range(self.streams):
                if not self.waiting[k]:
                    self.take_over(k)
            self.train(min(self.c.window, max(self.waiting)))

    def take_over(self, k: int) -> None:
        """Half of the longest queue for stream k, if that has more than a window. Its context is the word before; the state is not known there."""
        j = max(range(self.streams), key=self.waiting.__getitem__)
        if self.waiting[j] <= self.c.window:
            return
        left = np.concatenate(self.queues[j])
        at = len(left) // 2
        self.queues[j], self.queues[k] = [left[:at]], [left[at:]]
        self.waiting[j], self.waiting[k] = at, len(left) - at
        self.last[k], self.state[k] = left[at - 1], 0

    def train(self, n: int) -> None:
        """One window of n words of each stream; streams that have fewer are masked."""
        ranks = np.full((self.streams, n), -2, np.int32)
        for k, queue in enumerate(self.queues):
            got = 0
            while got < n and queue:
                part = queue[0][: n - got]
                ranks[k, got : got + len(part)] = part
                got += len(part)
                queue[0] = queue[0][len(part) :]
                if not len(queue[0]):
                    queue.pop(0)
            self.waiting[k] -= got
        before = np.concatenate([self.last[:, None], ranks[:, :-1]], 1)
        self.last = np.where(ranks[:, -1] == -2, self.last, ranks[:, -1])
        self.window(before.T, ranks.T)

    def window(self, before: np.ndarray, target: np.ndarray) -> None:
        w, head, (n, b), hid = self.w, self.head, before.shape, self.c.hidden
        live = target != -2
        keeps = (before != head.first).astype(F32)[:, :, None]  # 0 where a document begins: no state
        ins = head.inputs[before]
        emb = w["emb"][ins]
        x = emb @ w["wx"]
        x += w["b"]
        h = self.state
        steps, outs = [], np.empty((n, b, hid), F32)
        for t in range(n):
            h = h * keeps[t]
            new_h, z, r, new, hu = step(x[t], h, w["u"])
            steps.append((h, z, r, new, hu))
            h = outs[t] = new_h
        self.state = h
        flat, goal = outs[live], target[live]
        count = len(goal)
        if not count:
            return
        self.tokens += count
        cls = head.classes[goal]
        grads = {}
        p = flat @ w["wc"]
        p += w["bc"]
        p, total, _ = _exp(p, w["wc"], w["bc"])
        p *= (1 / (total * count))[:, None]
        p[np.arange(count), cls] -= F32(1 / count)
        grads["wc"], grads["bc"] = flat.T @ p, p.sum(0)
        dflat = p @ w["wc"].T
        grads["ww"], grads["bw"] = np.zeros_like(w["ww"]), np.zeros_like(w["bw"])
        inside = Within(flat, cls, goal, w, head.network_classes)
        q, total, _ = _exp(inside.logits, w["ww"], w["bw"])
        q *= (1 / (total * count))[:, None]
        q[inside.at, inside.place] -= F32(1 / count)
        back = np.empty_like(inside.states)
        for k, part in inside.slices:
            np.matmul(inside.states[part].T, q[part], out=grads["ww"][k])
            grads["bw"][k] = q[part].sum(0)
            np.matmul(q[part], w["ww"][k].T, out=back[part])
        dflat[inside.rows] += back
        douts = np.zeros((n, b, hid), F32)
        douts[live] = dflat
        dx = np.empty_like(x)
        du = np.zeros_like(w["u"])
        dh = np.zeros((b, hid), F32)
        dhu = np.empty((b, 3 * hid), F32)
        for t in range(n - 1, -1, -1):
            h, z, r, new, hu = steps[t]
            dh += douts[t]
            dz = h - new
            dz *= dh * z
            dz *= 1 - z
            dnew = dh - dh * z
            dnew *= 1 - new * new
            dr = dnew * r
            dhu[:, 2 * hid :] = dr
            dr *= hu[:, 2 * hid :]
            dr *= 1 - r
            dhu[:, :hid], dhu[:, hid : 2 * hid] = dz, dr
            dx[t, :, : 2 * hid], dx[t, :, 2 * hid :] = dhu[:, : 2 * hid], dnew
            du += h.T @ dhu
            dh *= z
            dh += dhu @ w["u"].T
            dh *= keeps[t]
        flat_dx = dx.reshape(-1, 3 * hid)
        grads["u"], grads["b"], grads["wx"] = du, flat_dx.sum(0), emb.reshape(-1, emb.shape[-1]).T @ flat_dx
        grads["emb"] = np.zeros_like(w["emb"])
        order = np.argsort(ins, axis=None, kind="stable")
        sorted_ins = ins.ravel()[order]
        starts = np.flatnonzero(np.append(True, sorted_ins[1:] != sorted_ins[:-1]))
        grads["emb"][sorted_ins[starts]] = np.add.reduceat((flat_dx @ w["wx"].T)[order], starts)
        self.adam(grads)

    def adam(self, grads: dict[str, np.ndarray]) -> None:
        norm = math.sqrt(sum(float(np.dot(g.ravel(), g.ravel())) for g in grads.values()))
        scale = F32(min(1.0, 1.0 / max(norm, 1e-12)))
        self.t += 1
        rate = self.c.rate * min(1.0, self.t / 10) * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            g *= scale
            m *= F32(0.9)
            m += F32(0.1) * g
            g *= g
            g *= F32(0.01)
            v *= F32(0.99)
            v += g
            np.sqrt(v, out=g)
            g += F32(1e-8)
            np.divide(m, g, out=g)
            g *= F32(rate)
            self.w[k] -= g


LOG10 = math.log(10)


class Scorer:
    """log10 probabilities of documents given as ranks, without what rare words have within their class."""

    def __init__(self, head: Head, weights: dict[str, np.ndarray], side_by_side: int = 512, window: int = 64):
        self.head, self.w, self.width, self.n = head, weights, side_by_side, window
        self.x = weights["emb"] @ weights["wx"] + weights["b"]
        # rare words have one count more each, and so has the unseen word, as in the base
        self.bc = weights["bc"].copy()
        self.bc[-1] += math.log((head.rare_total + head.rare_distinct + 1) / max(head.rare_total, 1))

    def window(self, states: np.ndarray, goal: np.ndarray, most: int = 8192) -> np.ndarray:
        """log10 probability of each goal, `most` at a time, which stay in the processor's cache."""
        return np.concatenate([self._some(states[k : k + most], goal[k : k + most]) for k in range(0, len(goal), most)])

    def _some(self, states: np.ndarray, goal: np.ndarray) -> np.ndarray:
        w, head = self.w, self.head
        cls = head.classes[goal]
        logits = states @ w["wc"]
        logits += self.bc
        out = logits[np.arange(len(goal)), cls].astype(np.float64)
        _, total, off = _exp(logits, w["wc"], self.bc)
        out -= np.log(total) + off
        inside = Within(states, cls, goal, w, head.network_classes)
        picked = inside.logits[inside.at, inside.place]
        _, total, off = _exp(inside.logits, w["ww"], w["bw"])
        out[inside.rows] += picked - np.log(total) - off
        out /= LOG10
        out += head.fixed[goal]
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(docs))
        longest_first = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
        for at in range(0, len(docs), self.width):
            self._side_by_side(docs, longest_first[at : at + self.width], out)
        return out

    def _side_by_side(self, docs: list[np.ndarray], part: list[int], out: np.ndarray) -> None:
        lengths = np.array([len(docs[k]) for k in part])
        h = np.zeros((len(part), self.head.config.hidden), F32)
        before = np.full(len(part), self.head.start)
        for begin in range(0, int(lengths[0]) if len(part) else 0, self.n):
            active = int((lengths > begin).sum())
            n = min(self.n, int(lengths[0]) - begin)
            ranks = np.full((active, n), -2, np.int32)
            for j in range(active):
                piece = docs[part[j]][begin : begin + n]
                ranks[j, : len(piece)] = piece
            ranks = np.ascontiguousarray(ranks.T)
            ins = np.concatenate([before[None, :active], self.head.inputs[ranks]])
            before[:active] = ins[-1]
            live = ranks != -2
            states = np.empty((n, active, h.shape[1]), F32)
            for t, a in enumerate(live.sum(1).tolist()):  # lengths descend: the first a go on
                h[:a] = states[t, :a] = step(self.x[ins[t, :a]], h[:a], self.w["u"])[0]
            owner = np.broadcast_to(np.arange(active), live.shape)[live]
            out[np.array(part)[:active]] += np.bincount(owner, self.window(states[live], ranks[live]), active)


def held_out(doc_id):
    """crc32 of the id as text, modulo 7, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c long) over all texts, each with its end mark. Tasks add up what they can hold before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in byte_rows(batch.column(0)):
                counts.update(words(text))
                counts[END] += 1
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, config: Config) -> tuple[Head, int]:
    """The head and its least count: words that occur twice or more, and so often that at most head_words do."""
    by_count = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    total = distinct = room = 0
    least, open_ = None, True
    for row in by_count.toLocalIterator():
        total += row["c"] * row["n"]
        distinct += row["n"]
        room += row["n"]
        open_ &= room <= config.head_words and row["c"] > 1
        least = row["c"] if open_ else least
    least = least or max(total, 2) + 1
    frequent = counts.where(F.col("c") >= least).toPandas()
    found = sorted(zip(frequent["c"].tolist(), map(bytes, frequent["word"]), strict=True), key=lambda x: (-x[0], x[1]))
    return Head({w: k for k, (_, w) in enumerate(found)}, np.array([c for c, _ in found], np.float64), total, distinct, config), least


_CHUNK = 1 << 14


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in SHAPES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(F32)
        at += like[k].size
    return out


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    """What trainers changed, averaged by the words that each learnt from, for one chunk of the weights."""
    share = rows["tokens"].to_numpy(float)
    values = sum(np.frombuffer(v, F16).astype(np.float64) * s for v, s in zip(rows["part"], share / share.sum(), strict=True))
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "some": [0], "tokens": [rows["tokens"].sum()], "part": [values.astype(F16).tobytes()]})


WEIGHTS = "chunk long, some long, tokens long, part binary"
#: Trainers whose weights meet in one task; their averages meet next.
MET = 64


def learn(coded: DataFrame, head: Head) -> tuple[dict[str, np.ndarray], int]:
    """Weights from the training documents (row, ranks), and the number of words learnt from in all passes.

    A trainer's documents come in the order of a hash of their row, so a run that is repeated learns the same.
    Trainers send what they changed, in half precision.
    """
    c, weights, tokens = head.config, initial(head), 0
    if not head.network:
        return weights, tokens
    spark = coded.sparkSession
    trainers, streams = c.trainers(head.total), c.side_by_side(head.total)
    shared_head = spark.sparkContext.broadcast(head)
    for pass_, round_ in itertools.product(range(c.passes(head.total)), range(c.rounds)):
        mine = coded.withColumn("_hash", F.xxhash64("row", F.lit(pass_))).where(F.pmod("_hash", F.lit(c.rounds)) == round_)
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            trainer = Trainer(shared_head.value, shared.value, streams)
            for batch in batches:
                for ranks in batch.column(0).to_pylist():
                    trainer.add(np.frombuffer(ranks, "<i4"))
            trainer.finish()
            if trainer.tokens:
                flat = (_flat(trainer.w) - _flat(shared.value)).astype(F16)
                parts = [flat[k : k + _CHUNK].tobytes() for k in range(0, len(flat), _CHUNK)]
                some = TaskContext.get().partitionId() // MET
                columns = [pa.array(range(len(parts)), pa.int64()), pa.array([some] * len(parts), pa.int64()), pa.array([trainer.tokens] * len(parts), pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "some", "tokens", "part"])

        dealt = mine.repartition(trainers, "_hash").sortWithinPartitions("_hash", "row")
        learnt = dealt.select("ranks").mapInArrow(run, WEIGHTS)
        if trainers > MET:
            learnt = learnt.groupBy("chunk", "some").applyInPandas(_average, WEIGHTS)
        averaged = sorted(learnt.groupBy("chunk").applyInPandas(_average, WEIGHTS).collect())
        if averaged:
            weights = _shaped(_flat(weights) + np.concatenate([np.frombuffer(r["part"], F16) for r in averaged]).astype(F32), weights)
            tokens += averaged[0]["tokens"]
        shared.unpersist()
    return weights, tokens


CODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, ranks binary, rare string"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
#: Bytes of texts that are coded at once: whole texts up to so many, or one longer text.
CODED_BYTES = 1 << 21
#: Words that are scored at once: whole documents up to so many, or one longer document.
AT_ONCE = 1 << 20


def code(rows: DataFrame, head) -> DataFrame:
    """Each row of (doc_id, held_out, text) as the ranks of its words, and the words that have none, as often as they occur; head: a broadcast Head."""
    names = [x.split()[0] for x in CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        base = head.value.base
        for batch in small(batches):
            for low, high in by_bytes(batch.column(2), CODED_BYTES):
                part = batch.slice(low, high - low)
                found = [[*words(text), END] for text in byte_rows(part.column(2))]
                ends = np.cumsum(list(map(len, found)))
                starts = ends - list(map(len, found))
                every = list(itertools.chain.from_iterable(found))
                ranks = head.value.coded(every)
                rare = np.flatnonzero(ranks < 0)
                of_doc = np.searchsorted(rare, np.append(starts, ends[-1]))
                spelt = [every[k] for k in rare.tolist()]
                data = ranks.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(at, at + len(found)), pa.int64()),
                        part.column(0),
                        part.column(1),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(ends - starts - np.diff(of_doc), pa.int64()),
                        pa.array(np.add.reduceat(base[ranks], starts), pa.float64()),
                        pa.array([data[4 * x : 4 * y] for x, y in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array([b" ".join(spelt[x:y]) or None for x, y in itertools.pairwise(of_doc)], pa.binary()).cast(pa.string()),
                    ],
                    names=names,
                )
                at += len(found)

    return rows.mapInArrow(run, CODED)


def score_rows(coded: DataFrame, shared) -> DataFrame:
    """CODED rows with their score: log10 probabilities but for what rare words have within their class. shared: a broadcast (Head, weights)."""
    ident = uuid.uuid4().hex
    kept = [x.split()[0] for x in SCORED.split(", ")][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ident not in _scorers:
            _scorers.clear()
            _scorers[ident] = Scorer(*shared.value)
        scorer = _scorers[ident]

        def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
            docs = [np.frombuffer(ranks.as_buffer(), "<i4") for ranks in batch.column(len(kept))]
            values = scorer.score(docs) if scorer.head.network else np.zeros(len(docs))
            return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(values, pa.float64())], names=[*kept, "score"])

        for batch in batches:
            ends = np.cumsum(batch.column(kept.index("n_tokens")).to_numpy())
            low = 0
            while low < batch.num_rows:
                before = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
                yield scored(batch.slice(low, high - low))
                low = high

    return coded.select(*kept, "ranks").mapInArrow(run, SCORED)


_scorers: dict[str, Scorer] = {}


def score_documents(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or blank text is its end mark alone. A null doc_id stays null and is
    trained on. Repeated rows are scored, and learnt from, each. Texts of any length
    are learnt from and scored to their end. An empty table gives no rows. Without
    training words each word has probability 1 in the base and in the model. As in
    the base, all unseen words are one word that was counted once more than never.
    Other columns are not read.
    """
    config = config or Config()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    counts = cut(count_words(rows.where(~F.col("held_out"))), "words")
    head, least = head_of(counts, config)
    context = docs.sparkSession.sparkContext
    coded = cut(code(rows.select("doc_id", "held_out", "text"), context.broadcast(head)), "coded")
    weights, _ = learn(coded.where(~F.col("held_out")).select("row", "ranks"), head)
    scores = cut(score_rows(coded, context.broadcast((head, weights))), "scores")
    each = coded.where("rare is not null").select("row", F.explode(F.split("rare", " ")).alias("word"))
    rare_counts = counts.where(F.col("c") < least).select(F.col("word").cast("string").alias("word"), "c")
    c = F.coalesce("c", F.lit(0))
    sums = each.join(rare_counts, "word", "left").groupBy("row").agg(
        F.count("c").alias("known_rare"),
        F.sum(F.log10(c + 1)).alias("logs"),
        F.count("*").alias("all_rare"),
    )
    logs, all_rare = F.coalesce("logs", F.lit(0.0)), F.coalesce("all_rare", F.lit(0))
    of_base, of_class = math.log10(head.total + head.distinct + 1), math.log10(head.rare_total + head.rare_distinct + 1)
    return scores.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - all_rare * of_base).alias("base_score"),
        (F.col("score") + logs - all_rare * of_class).alias("score"),
    )
