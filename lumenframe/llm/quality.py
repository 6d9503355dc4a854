"""Line-first cleaning: rules for each line, then a limit on what a document may lose."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import U64, byte_rows, small

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Phrases of page furniture, in lower case.
FURNITURE = (
    "accept all cookies", "all rights reserved", "back to top", "click here to", "cookie policy", "enable javascript", "follow us on", "javascript is disabled",
    "log in to your account", "lorem ipsum", "privacy policy", "read more articles", "share this page", "sign up for our newsletter", "skip to main content", "subscribe to our", "terms of service", "terms of use", "use cookies",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document rules."""

    least_words: int = 20
    most_repeated: int = 30  # per cent of words in windows that occur again
    punctuated_from: int = 6  # lines of fewer words need no sentence end
    most_separators: float = 0.15  # "|", ">" and bullets for each word
    most_symbols: float = 0.1  # characters of SYMBOLS for each word
    most_shouted: float = 0.5  # words in capitals, on lines of punctuated_from words or more
    most_doubled: float = 0.2  # words that end in "!!" or the like
    most_stuttered: float = 0.5  # words equal to the one before
    most_lost: float = 0.5  # of the words of the document


_furniture = [x.encode() for x in FURNITURE]
_sentence_end = regex.compile(r"""[.!?…。！？:;][\p{Pe}\p{Pf}"'*_`]*(?:\s|$)""")
_separators = [x.encode() for x in "|>»•·"]
_doubled = regex.compile(r"\p{P}{2,}(?:\s|$)")
_shouted = regex.compile(r"(?:^|\s)\p{P}*\p{Lu}{2,}[\p{Lu}\p{P}]*(?=\s|$)")
_CAPITAL = bytes([*range(65, 91), *range(128, 256)])  # a shouted word has two of these bytes at least


def repeated_words(found: list[bytes]) -> int:
    """Words in windows of 8 words that occur twice or more, the first included."""
    n = len(found) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, found), np.int64, len(found)).view(U64)
    key = np.zeros(n, U64)
    for i in range(WINDOW):
        key = key * U64(0xA24BAED4963EE407) + h[i : i + n]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[back] > 1)
    seen: dict[tuple, list[int]] = {}
    for i in again.tolist():  # equal hashes are compared word by word
        seen.setdefault(tuple(found[i : i + WINDOW]), []).append(i)
    mark = np.zeros(len(found) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            at = np.array(places)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + WINDOW, -1)
    return int((mark.cumsum()[:-1] > 0).sum())


def symbols_in(text: bytes) -> int:
    return sum(text.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))


def doubles(found: list[bytes]) -> int:
    """Words equal to the one before."""
    return sum(map(operator.eq, found, found[1:]))


def line_fails(line: bytes, n_words: int, rules: Rules, symbols: bool = True, furniture: bool = True, stutter: bool = True) -> str | None:
    """The first rule that a line with words breaks: symbols, navigation, stutter, shouting, boilerplate or punctuation.

    symbols, furniture, stutter: whether the document has any, so whether to look for them.
    """
    if symbols and (n := symbols_in(line)) > 1 and n > rules.most_symbols * n_words:
        return "symbols"
    marks = sum(map(line.count, _separators))
    if marks > 1 and marks > rules.most_separators * n_words:
        return "navigation"
    if stutter and n_words > 1 and doubles(line.split()) > rules.most_stuttered * n_words:
        return "stutter"
    if n_words >= rules.punctuated_from:
        if (b"!!" in line or b"??" in line) and len(_doubled.findall(line.decode())) > rules.most_doubled * n_words:
            return "shouting"
        if len(line) - len(line.translate(None, _CAPITAL)) > 2 * rules.most_shouted * n_words and len(_shouted.findall(line.decode())) > rules.most_shouted * n_words:
            return "shouting"
    if furniture and any(x in line.lower() for x in _furniture):
        return "boilerplate"
    if n_words >= rules.punctuated_from and line[-1:] not in (b".", b"!", b"?") and b". " not in line and not _sentence_end.search(line.decode()):
        return "punctuation"
    return None


def judge(text: bytes | None, rules: Rules) -> tuple[tuple[int, int, int, int, int, bool, bool], bytes]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), and the text without failing lines."""
    text = text or b""
    found = text.split()
    n = len(found)
    inner = b"".join(found)
    chars = len(inner) if inner.isascii() else len(inner.decode())
    symbols = symbols_in(inner)
    stutter = doubles(found) > 0
    lower = text.lower()
    furniture = any(x in lower for x in _furniture)
    seen: set[bytes] = set()
    dup = lost = 0
    kept_lines = []
    for line in text.split(b"\n"):
        words = len(line.split())
        if not words:
            kept_lines.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if again or line_fails(line, words, rules, symbols > 1, furniture, stutter):
            lost += words
        else:
            kept_lines.append(line)
    repeat = repeated_words(found)
    base = n < rules.least_words or 100 * repeat > rules.most_repeated * n
    return (n, chars, symbols, dup, repeat, base, not base and lost <= rules.most_lost * n), b"\n".join(kept_lines)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row for each row of docs: the counts, base_failed and kept.

    A null text has no words and fails. A line that repeats an earlier one is lost
    too. A null doc_id stays null; repeated rows give repeated rows; an empty table
    gives none. Whole texts are read, however long. Other columns are not.
    """
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in small(batches):
            rows = list(zip(*(judge(t, rules)[0] for t in byte_rows(batch.column(1))), strict=True)) or [()] * 7
            columns = [pa.array(r, pa.int64()) for r in rows[:5]] + [pa.array(r, pa.bool_()) for r in rows[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The kept documents, in their columns, without their failing lines; n_chars, where it is there, follows the text.

    Documents with a null text go, as they fail; repeated rows stay or go together; an empty table stays empty.
    """
    rules = rules or Rules()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            done = [judge(t, rules) for t in byte_rows(batch.column(at))]
            texts = pa.array([t for _, t in done], pa.binary()).cast(batch.schema.field(at).type)
            batch = pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch.filter(pa.array([x[-1] for x, _ in done], pa.bool_()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
