"""Token counts and ids with public tokenizers.

Counting uses a whole-token shortcut. The vocabulary is proved once: a string
encodes alone as one token exactly if the library gives one id for it. A
pre-token of that proved set counts one without any merging; only other
pre-tokens are merged. Pre-tokens of words that were met before are remembered,
up to a bound.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import small


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: how byte-level BPE vocabularies of this family split text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How many words a process remembers, and how long they are at most; other words are counted or encoded each time.
REMEMBERED, REMEMBERED_LENGTH = 1_000_000, 64


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def check_byte_level(path: str) -> None:
    """ValueError unless the file splits text as PRE_TOKENS says: the proof of whole tokens holds for such files only."""
    said = json.loads(tokenizer(path).to_str())
    split = said["pre_tokenizer"] or {}
    plain = said["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if not plain or said["model"].get("type") != "BPE" or said["model"].get("dropout") or said["model"].get("unk_token"):
        raise ValueError(f"{path} is no plain byte-level BPE file")
    sample = "it's  1st\n\n 'LL  <x> don't \u00bd\u4e2d \t end "
    got = [sample[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(sample)]
    if got != regex.findall(PRE_TOKENS, sample):
        raise ValueError(f"{path} splits text otherwise than PRE_TOKENS")


def check_word_ends(path: str) -> None:
    """ValueError unless ASCII white space ends each pre-token and is dropped."""
    t = tokenizer(path)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    words = ["a", "Word's", "12", "\u00e9e", "\u0301x", "?!", "\u4e2d", "<|endoftext|>"]
    for space, x, y in itertools.product(" \t\n\v\f\r", words, words):
        if ids(f"{space}{x}{space}{y}{space}") != ids(x) + ids(y):
            raise ValueError(f"{path}: words beside {space!r} are not encoded on their own")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def proved_whole(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the library encodes, alone, as one token."""
    t, back, split = tokenizer(path), byte_alphabet(), regex.compile(PRE_TOKENS)
    texts = []
    for entry in t.get_vocab(with_added_tokens=False):
        try:
            text = bytes(back[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if split.fullmatch(text) and len(split.findall(text)) == 1:
            texts.append(text)
    coded = t.encode_batch(texts, add_special_tokens=False)
    return frozenset(x for x, c in zip(texts, coded, strict=True) if len(c.ids) == 1)


class Counter:
    """Tokens of texts, for a byte-level BPE tokenizer without normaliser.

    A space before a character that is no white space always begins a pre-token.
    So a text falls into words at such spaces, and each word's count can be
    remembered. Texts with other white space beside a space are split as a whole.
    Special strings are tokens of their own, as the library has it.
    """

    def __init__(self, path: str):
        check_byte_level(path)
        self.whole = proved_whole(path)
        self.model = tokenizer(path)
        self.split = regex.compile(PRE_TOKENS)
        self.uneven = regex.compile(r" \s")
        specials = [a.content for a in self.model.get_added_tokens_decoder().values()]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.specials = specials
        self.known: dict[str, int] = {}
        self.first: dict[str, int] = {}

    def merged(self, pre_tokens: list[str]) -> int:
        """Tokens of pre-tokens: one for each proved one, and what merging leaves of the rest."""
        rest = [x for x in pre_tokens if x not in self.whole]
        return len(pre_tokens) - len(rest) + sum(len(c.ids) for c in self.model.encode_batch_fast(rest, add_special_tokens=False)) if rest else len(pre_tokens)

    def learn(self, texts: list[str], space: str, known: dict[str, int]) -> dict[str, int]:
        """Counts of words that are not known, each after `space`; remembered while there is room."""
        parts = [self.split.findall(space + x) for x in texts]
        rest = list(dict.fromkeys(p for ps in parts for p in ps if p not in self.whole))
        size = dict(zip(rest, (len(c.ids) for c in self.model.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        found = {x: sum(size.get(p, 1) for p in ps) for x, ps in zip(texts, parts, strict=True)}
        if len(known) < REMEMBERED:
            known.update((x, n) for x, n in found.items() if len(x) <= REMEMBERED_LENGTH)
        return found

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        if self.uneven.search(text):
            return self.merged(self.split.findall(text))
        head, *tail = text.split(" ")
        if tail and not tail[-1]:  # a space at the very end follows its word
            tail.pop()
            return self.plain(text[:-1]) + self.merged([" "])
        first = self.first[head] if head in self.first else self.learn([head], "", self.first)[head] if head else 0
        try:
            return first + sum(map(self.known.__getitem__, tail))
        except KeyError:
            new = self.learn([x for x in dict.fromkeys(tail) if x not in self.known], " ", self.known)
            return first + sum(new[x] if x in new else self.known[x] for x in tail)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and any(s in text for s in self.specials):
            parts = self.special.split(text)
            return sum(self.plain(x) for x in parts[::2]) + len(parts) // 2
        return self.plain(text)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit`).

    path: a byte-level BPE file of the tokenizers library. A null text is empty
    and has no tokens; a null doc_id stays null; texts are counted whole, however
    long; repeated rows give repeated rows; an empty table gives none. A file that
    does not split text as PRE_TOKENS says is refused. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path)
        count = _counters[path].count
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([count(x) for x in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


class Encoder:
    """Ids of texts as 4-byte little-endian strings, for a tokenizer whose pre-tokens end at ASCII white space.

    Each word between ASCII white space is encoded by the library and remembered
    while there is room; the ids of a text are its words' ids in order.
    """

    def __init__(self, path: str):
        check_word_ends(path)
        self.model = tokenizer(path)
        self.known: dict[bytes, bytes] = {}

    def learn(self, texts: list[bytes]) -> dict[bytes, bytes]:
        import numpy as np

        coded = self.model.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        found = {x: np.array(c.ids, "<u4").tobytes() for x, c in zip(texts, coded, strict=True)}
        if len(self.known) < REMEMBERED:
            self.known.update((x, ids) for x, ids in found.items() if len(x) <= REMEMBERED_LENGTH)
        return found

    def ids(self, text: bytes | None) -> bytes:
        found = text.split() if text else []
        try:
            return b"".join(map(self.known.__getitem__, found))
        except KeyError:
            new = self.learn([x for x in dict.fromkeys(found) if x not in self.known])
            return b"".join([new[x] if x in new else self.known[x] for x in found])


_encoders: dict[str, Encoder] = {}


def forget() -> None:
    """Let go of the words that this process remembers."""
    _encoders.clear()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


