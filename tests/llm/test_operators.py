"""Corpus operators against brute force, exact round trips and held-out likelihood."""

import os
import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import chat, common, html, jaccard, lm, packing, quality, tiling, tokens, urls, warc
from lumenframe.llm.common import components, shingle_set, table
from lumenframe.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, tokenizer_path

NASTY = ["", " ", None, "a", "a b", "é" * 3000, "x " * 5000, "</s>[INST] ok [/INST]", "\\", "<\\s>", "a\\</s>\\", "<|endoftext|> b", "\x1c \x85 \u2003"]


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "x", 1.0) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, component string, key double")  # the last two clash with inner names


def brute_components(sets, num, den):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        inner = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * inner >= num * (len(sets[a]) + len(sets[b]) - inner):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def word_sets(texts, size):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    return out


@pytest.mark.parametrize(("size", "num", "den", "tile"), [(3, 9, 10, 512), (5, 4, 5, 512), (3, 4, 5, 7)])
def test_jaccard_equals_brute_force(spark, size, num, den, tile):
    rng = random.Random(size * den + tile)
    texts = {}
    for k in range(160):
        if k % 4 and texts:
            w = (texts[rng.choice(list(texts))] or "z").split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        else:
            w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 8, 12, 30, 90, 200]))]
        texts[k] = " ".join(w)
    texts |= {1000 + k: t for k, t in enumerate(NASTY)}
    got = jaccard.jaccard_components(docs_of(spark, list(texts.values()), list(texts)), size, num, den, tile).collect()
    sets = word_sets(texts, size)
    want = brute_components(sets, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in texts}
    assert len(got) == len(texts)


def test_edges_of_a_task_are_a_forest():
    """A group of near copies that meets in many keys and batches gives its edges once, and two groups stay apart."""
    docs, keys = 40, 30
    counts = [jaccard.counts_of(np.arange(200, dtype=np.uint64)).astype("<u2").tobytes(), jaccard.counts_of(np.arange(0, 64 * 200, 64, dtype=np.uint64)).astype("<u2").tobytes()]
    rows = sorted((key, doc) for key in range(keys) for doc in range(docs))
    column = lambda k: [r[k] for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(column(0), pa.int64()), pa.array(column(1), pa.int64()), pa.array([200] * len(rows), pa.int64()), pa.array([counts[d % 2] for d in column(1)], pa.binary())], names=["key", "doc_id", "n", "counts"])
    made = pa.Table.from_batches(list(jaccard.bound_rows(9, 10)(batch.slice(k, 97) for k in range(0, len(rows), 97))))
    edges = list(zip(*(made.column(k).to_pylist() for k in "ab"), strict=True))
    assert len(edges) == docs - 2 and all(a % 2 == b % 2 for a, b in edges)
    reached = {0, 1}
    for _ in range(docs):
        reached |= {x for e in edges if reached & {*e} for x in e}
    assert reached == set(range(docs))


def test_jaccard_nulls_repeats_and_empty(spark):
    df = docs_of(spark, ["a b c d", "a b c d", "a b c d", None], [5, 5, None, 6])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
    assert got == [(-1, 2, None), (5, 2, 5), (5, 2, 5), (6, 0, 6)]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_keep_one_keeps_columns_and_clean_documents(spark):
    df = docs_of(spark, ["one two three four five six"] * 3 + ["other words here entirely now", None])
    out = jaccard.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 3, 4]


def test_overlap_bounds_of_packed_points():
    rng = np.random.default_rng(5)
    for points in (rng.integers(0, 256, (50, 64)), np.full((3, 1024), 255), rng.integers(0, 300, (20, 64)), rng.integers(0, 9, (5, 2048)), np.zeros((2, 64), int)):
        a, b = rng.integers(0, len(points), (2, 500))
        got = jaccard.overlap_bounds(jaccard.packed(points.astype(np.int32)), a, b)
        assert (got == np.minimum(points[a], points[b]).sum(axis=1)).all()


def test_group_keys_never_lose_a_pair():
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(4, 5)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        most = len(a) // 9
        drop = int(rng.integers(0, most + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, most + 1)), dtype=np.uint64)]))
        inner = len(np.intersect1d(a, b))
        if 5 * inner >= 4 * (len(a) + len(b) - inner):
            assert len(np.intersect1d(jaccard.group_keys(a, bands), jaccard.group_keys(b, bands)))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100 + k: 100 for k in range(40)}


def test_warc_round_trip(spark, sf_dir):
    rows = [(1, "http://a.b/c", "x"), (2, "http://a.b/c", "x"), (3, None, None), (4, None, ""), (4, None, ""), (None, "http://z", "x"), (7, "odd\turl\n", "é" * 50_000), (8, "HTTP://User@A.B:80/q?x#y", "\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").union(table(spark, sf_dir, "pages").selectExpr("page_id + 100", "url", "html"))
    got = warc.archive_round_trip(df).collect()
    source = df.collect()
    assert len(got) == len(source)
    last = {}
    for r in source:
        if r.page_id is not None:
            last[r.html or ""] = max(last.get(r.html or "", -1), r.page_id)
    want = Counter()
    for r in source:
        payload = (r.html or "").encode()
        ref = last[r.html or ""] if last.get(r.html or "") != r.page_id else None
        want[(r.page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if ref is None else "revisit", ref)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    few = warc.archive_round_trip(df).where("record_type = 'revisit'").count()
    assert few > 0


def test_warc_finds_each_record_of_one_key(spark):
    rows = [(k, "http://a.b/c", html_) for k in (1, None) for html_ in ("x", "longer", "x")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((k, len(h)) for k, _, h in rows)


def test_warc_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    archives = warc.write_archives(df, warc.shared_dir(spark) + "/least", least_bytes=3)
    assert {r.record_type for r in warc.read_archives(archives).collect()} == {"response"}


@pytest.mark.parametrize("most", [warc.BROADCAST_DIGESTS, 0])
def test_warc_lookup_over_all_archives(spark, sf_dir, monkeypatch, most):
    """Small blocks and archives, on both sides of the switch by size: every URL finds all of its captures."""
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    hot = [(5000 + k // 2, "http://hot.x/?q", f"hot {k % 7}") for k in range(300)]
    rows = [(1, "http://a.b/c", "x"), (1, "http://a.b/c", "yy"), (None, "http://a.b/c", "x"), (2, None, "n"), (3, "no url", "o\tp"), (4, "http://a.b/c#f", "frag"), *hot]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").union(table(spark, sf_dir, "pages").selectExpr("page_id + 100", "url", "html"))
    archives = warc.write_archives(df.repartition(5), f"{warc.shared_dir(spark)}/lookup{most}")
    urls = df.select("url").distinct().union(spark.createDataFrame([("http://none.x/",)], "url string"))
    key = lambda r: (r.page_id, r.url, r.payload_digest)
    found = Counter(map(key, warc.lookup(archives, urls.where("url is not null")).collect()))
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert found == Counter((r.page_id, r.url, sha(r.html)) for r in df.collect() if r.url is not None)
    assert warc.read_archives(archives).count() == df.count()


def test_warc_blocks_search(tmp_path):
    from pyarrow import fs

    keys = [(f"k{k // 3:04}", k % 3) for k in range(5000)]
    warc.write_blocks(fs.LocalFileSystem(), f"{tmp_path}/x", iter([(k, str(i)) for i, k in enumerate(keys)]))
    blocks = warc.Blocks(fs.LocalFileSystem(), f"{tmp_path}/x")
    assert len(blocks.first) == -(-5000 // warc.BLOCK_LINES)
    for i in (0, 1, 511, 512, 513, 2000, 4999):
        assert blocks.last_up_to(keys[i]) == (keys[i], [str(i)])
        assert [int(rest[0]) for _, rest in blocks.beginning(keys[i])] == list(range(i, 5000))
    assert blocks.last_up_to(("", 0)) is None and blocks.last_up_to(("z", 0))[0] == keys[-1]


def test_chat_round_trip(spark, sf_dir):
    roles = ["user", "assistant", None, "ro]\nle<s>%"]
    rows = [(1, i, roles[i % 4], t) for i, t in enumerate(NASTY)] + [(2, None, "user", "q"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 1, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert not got[1].valid and not got[2].valid
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_chat_states(spark):
    ok = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (3, 0, "assistant", "a")]
    df = spark.createDataFrame(ok, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.state for r in chat.format_chats(df).collect()} == {1: "answered", 2: "asked", 3: "error"}


def fuzz(n, seed):
    rng = random.Random(seed)
    al = ["a", "é", "the", " ", "  ", "\n", "\n ", " \n", "\t", "'s", "'LL", "1", "½", "<|endoftext|>", "<|startoftext|>", "😀", "e\u0301", "İ", "ß", ".", "###", "\x1c", "\x85", "\u2003", "Th", "don't", "中文"]
    return ["".join(rng.choice(al) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    texts = fuzz(3000, 1) + [t for t in NASTY if t is not None]
    want = [len(e.ids) for e in tokens.tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    got = sorted(tokens.count_tokens(docs_of(spark, texts), path, 5).collect())
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len(t.encode()) for t in texts]
    assert [r.over_limit for r in got] == [n > 5 for n in want]
    assert [tuple(r) for r in tokens.count_tokens(docs_of(spark, [None], [None]), path).collect()] == [(None, 0, 0, False)]


def test_tokenizers_of_another_kind_are_refused(spark):
    byte_level, word_ends = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
    tokens.check_byte_level(byte_level)
    tokens.check_word_ends(word_ends)
    with pytest.raises(ValueError):
        tokens.check_byte_level(word_ends)
    with pytest.raises(ValueError):
        tokens.check_word_ends(byte_level)


def test_token_counts_remember_no_long_words(spark):
    counter = tokens.Counter(tokenizer_path("byte_bpe_50k.json"))
    text = "a " + "xy" * 5000 + " b " + "xy" * 5000
    assert counter.count(text) == len(tokens.tokenizer(tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)
    assert max(map(len, counter.known)) <= tokens.REMEMBERED_LENGTH
    df = docs_of(spark, ["a"])
    assert tokens.count_tokens(df.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_is_whole_and_gapless(spark, sf_dir):
    path = tokenizer_path("word_bpe_49k.json")
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()] + NASTY + fuzz(200, 2)
    df = docs_of(spark, texts).repartition(5)
    coded = tokens.tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    ids = {k: np.array([*e.ids, 1], "<u4") for k, e in enumerate(coded)}
    pieces = packing.pack(df, path, 256, 8).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for k, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(ids[k][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[k])
    lengths = []
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        lengths.append(at)
    assert all(n <= 256 and n & (n - 1) == 0 for n in lengths)
    assert sum(n < 256 for n in lengths) <= 8


def test_packing_keeps_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    rows = [(big, "a b c"), (None, "d e"), (-big, None), (big, "a b c"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(df, tokenizer_path("word_bpe_49k.json")).collect()
    tokens_of = Counter()
    for r in got:
        tokens_of[r.doc_id] += r.length
    assert tokens_of == {big: 8, None: 4, -big: 1}
    assert packing.pack(df.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_quality_counts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        marked = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert quality.repeated_words(w) == len(marked)


def test_quality_checks_first_what_the_rules_imply():
    shout = b"READ THIS NOW FOR internationally acclaimed entertainment"
    assert quality.line_fails(shout, 7, quality.Rules()) == "shouting"
    assert quality.line_fails("ÀÉ ÈÊ ÎÔ ÛÇ entertainment acclaimed internationally".encode(), 7, quality.Rules()) == "shouting"
    assert quality.line_fails(b"Read This Now For internationally acclaimed entertainment.", 7, quality.Rules()) is None
    for text in (b"well well well", b"well well well\n\nthat is is all."):
        assert b"well" not in quality.judge(text, quality.Rules())[1]


def brute_quality(text):
    """The columns that the contract fixes, in plain terms."""
    space = " \t\n\v\f\r"
    ws, word = [], ""
    for ch in (text or "") + " ":
        if ch in space:
            ws, word = ws + [word] if word else ws, ""
        else:
            word += ch
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(space):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    marked = {j for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(ws) < 20 or 100 * len(marked) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked), failed


def test_quality_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    more = [t for t in NASTY if t is not None] + ["a b c d e f g h " * 3, "x\n\nx\n x\nx ", "\u2003# * \u00a0$"]
    for k, text in enumerate(more):
        texts[-1 - k] = text
    got = {r.doc_id: r for r in quality.quality(docs_of(spark, list(texts.values()), list(texts))).collect()}
    for k, text in texts.items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text)
        assert not (r.kept and r.base_failed)


def test_clashing_columns_stay(spark, sf_dir):
    """Extra columns with the operators' inner names: they stay where columns stay, and change no result."""
    names = "_drop key slot tiles range to own left merge fp rep bits hash row node component label number sha ref response suffix order c word".split()
    docs = table(spark, sf_dir, "documents").limit(60)
    docs = docs.withColumns({n: F.lit(f"extra {n}") for n in names})
    plain = docs.select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").withColumns({n: F.lit(1) for n in names})
    for stage in (quality.clean, jaccard.keep_one, lambda d: tiling.decontaminate(d, bench)):
        out = stage(docs)
        assert out.columns == docs.columns
        kept = out.collect()
        assert all(r[n] == f"extra {n}" for r in kept for n in names)
        assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in stage(plain).collect())
    for made in (jaccard.jaccard_components, quality.quality, lm.score_documents, lambda d: tiling.leaks(d, bench), lambda d: packing.pack(d, tokenizer_path("word_bpe_49k.json")), lambda d: tokens.count_tokens(d, tokenizer_path("byte_bpe_50k.json"))):
        assert made(docs.coalesce(1)).count() == made(plain.coalesce(1)).count()
    pages = table(spark, sf_dir, "pages").withColumns({n: F.lit(f"extra {n}") for n in names})
    for made in (warc.archive_round_trip, html.extract, lambda p: urls.filter_urls(p, URL_RULES)):
        assert made(pages).count() == pages.count()


def test_written_tables_are_deleted(spark, tmp_path, monkeypatch):
    """Components and the near-duplicate steps leave the tables that their result reads, and no others."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    components(spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long"), "chain").count()
    assert len(list(tmp_path.glob("chain-*"))) == 1
    jaccard.jaccard_components(docs_of(spark, ["a b c d e"] * 3 + ["a b c d e f g h"] * 2)).count()
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"chain", "points", "links"}
    with pytest.raises(Exception):
        common.cut(spark.range(3).select(F.raise_error(F.lit("x")).alias("a")), "failed")
    assert not list(tmp_path.glob("failed-*"))


def test_quality_keeps_clean_and_rejects_junk(spark):
    clean = " ".join(f"Sentence number {k} says something new about topic {k * 7}." for k in range(12))
    table_ = "\n".join(" | ".join(f"cell{k}{j}" for j in range(8)) for k in range(10))
    shout = " ".join(f"BUY{k}!! NOW{k}!!" for k in range(40))
    symbols = " ".join(f"word{k}###" for k in range(60))
    df = docs_of(spark, [clean, table_, shout, symbols, None, "short text.", clean.replace("S", "É")])
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert [got[k].kept for k in range(7)] == [True, False, False, False, False, False, True]
    assert [got[k].base_failed for k in range(7)] == [False, False, False, False, True, True, False]
    cleaned = quality.clean(docs_of(spark, [clean + "\nHome | About | News | Contact"])).collect()
    assert cleaned[0].text == clean
    assert quality.quality(df.limit(0)).count() == 0


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.quality(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where("not base_failed").toPandas()
    good = judged[judged.quality == 1]
    assert good.kept.mean() > 0.99
    assert (~judged[judged.quality == 0].kept).mean() > 0.9


def brute_tiles(doc, goal, least):
    used_a, used_b, tiled = [False] * len(doc), [False] * len(goal), 0
    while True:
        best, found = least - 1, None
        for q in range(len(goal)):
            for p in range(len(doc)):
                n = 0
                while p + n < len(doc) and q + n < len(goal) and doc[p + n] == goal[q + n] and not used_a[p + n] and not used_b[q + n]:
                    n += 1
                if n > best:
                    best, found = n, (p, q)
        if not found:
            return tiled
        p, q = found
        used_a[p : p + best] = [True] * best
        used_b[q : q + best] = [True] * best
        tiled += best


def test_tiling_equals_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        goal = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 25))]
        cut = rng.randrange(len(goal))
        doc = [rng.choice("xyzab") for _ in range(10)] + goal[cut:] + ["q"] * rng.randint(0, 3) + goal[:cut]
        tiler = tiling.Tiler([(1, " ".join(goal).encode())], 4, 0.3)
        want = brute_tiles(doc, goal, 4)
        got = tiler.hits(" ".join(doc).encode())
        assert (got[0][2] if got else 0) == (want if want >= 0.3 * len(goal) else 0)


def test_tiling_of_repetitive_texts_equals_brute_force():
    rng = random.Random(10)
    for k in range(300):
        goal = [rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randint(1, 18))]
        doc = [rng.choice("ab" if k % 2 else "abcx") for _ in range(rng.randint(0, 30))]
        least = rng.randint(1, 4)
        got = tiling.Tiler([(1, " ".join(goal).encode())], least, 0.01).hits(" ".join(doc).encode())
        want = brute_tiles(doc, goal, min(least, len(goal)))
        assert (got[0][2] if got else 0) == want


def test_tiling_many_texts_at_once():
    """Texts that share seeds, some shorter than a seed."""
    rng = random.Random(11)
    goals = [[rng.choice("abcdef") for _ in range(rng.randint(1, 20))] for _ in range(40)]
    tiler = tiling.Tiler([(k, " ".join(g).encode()) for k, g in enumerate(goals)], 3, 0.5)
    for _ in range(30):
        doc = [rng.choice("abcdefz") for _ in range(40)] + rng.choice(goals)
        got = {item: n for item, _, n, _ in tiler.hits(" ".join(doc).encode())}
        want = {k: brute_tiles(doc, g, min(3, len(g))) for k, g in enumerate(goals)}
        assert got == {k: n for k, n in want.items() if n >= 0.5 * len(goals[k])}


def test_tiling_of_long_repetitive_texts_is_bounded():
    import resource
    import time

    tiler = tiling.Tiler([(1, b"word " * 2000)], 5, 0.5)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert tiler.hits(b"word " * 100_000) == [(1, 1.0, 2000, 1)]
    assert time.time() - began < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
    mixed = tiling.Tiler([(1, (b"a " * 50 + b"b ") * 20)], 5, 0.5)
    assert mixed.hits(b"a " * 20_000)[0][2] == 1000


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards mix potent brews quietly"
    w = item.split()
    texts = ["clean text about nothing at all", f"Intro, {item.upper()}! and more", " ".join(w[8:] + ["and"] + w[:8]), " ".join(w[:6]), None, ""]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "tiny item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in tiling.leaks(docs_of(spark, texts), bench).collect()}
    assert got == {(1, 7), (2, 7)}
    kept = tiling.decontaminate(docs_of(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert tiling.leaks(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 20)
    bench = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(9))) for k in range(5)], "item_id long, text string")
    texts = [" ".join(f"i{k}w{j}" for j in range(9)) for k in range(5)]
    assert {(r.doc_id, r.item_id) for r in tiling.leaks(docs_of(spark, texts), bench).collect()} == {(k, k) for k in range(5)}
    assert tiling.decontaminate(docs_of(spark, texts), bench).count() == 0


def test_url_rules_and_parts(spark):
    rows = [(1, "http://a.example.org/es/5"), (2, "HTTP://EXAMPLE.ORG/en/12?x"), (3, "http://x.com/de/1"), (4, "http://com/fr/"), (5, "http://org?x"), (6, None), (7, "none"), (8, "http://notorg/"), (2, "HTTP://EXAMPLE.ORG/en/12?x"), (None, "a://b.org/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(((r.page_id or -1, r.host, r.path, r.rule) for r in urls.filter_urls(df, URL_RULES).collect()))
    assert got == sorted([(1, "a.example.org", "/es/5", "example.org/es/"), (2, "example.org", "/en/12", "example.org/en/1"), (2, "example.org", "/en/12", "example.org/en/1"), (3, "x.com", "/de/1", "com/de/"), (4, "com", "/fr/", "com/fr/"), (5, "org", "", None), (6, "", "", None), (7, "", "", None), (8, "notorg", "/", None), (-1, "b.org", "/", "org/")])
    assert urls.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_url_trees_on_held_out_urls():
    """Junk hosts with digits: trees fitted on two thirds judge the rest."""
    rng = random.Random(4)
    rows = []
    for k in range(1500):
        bad = k % 3 == 0
        host = f"{rng.choice(['cheap', 'win'])}-{rng.randrange(10**6)}.example.com" if bad else f"{rng.choice(['news', 'blog', 'docs'])}.example.org"
        rows.append((f"http://{host}/en/{rng.randrange(999)}", host, "/en/1", host[-3:], 10, int(bad), rng.randrange(1 << 60)))
    frame = pd.DataFrame(rows, columns=["url", "host", "path", "suffix", "suffix_urls", "label", "order"])
    trees, shares = urls.train(frame[:1000])
    found = trees.probability(urls.features(frame[1000:], shares)) >= 0.5
    assert (found == frame["label"][1000:].to_numpy(float)).mean() > 0.98


def test_url_query_equals_brute_force(spark):
    """Every page: parts and rules by plain string work, verdicts by walking each tree."""
    sf = "/root/testdata/sf0.01"
    pages = table(spark, sf, "pages")
    got = {r.page_id: r for r in QUERIES["op4_url_filter"](spark, sf).collect()}
    known = urls.labelled(pages.select("page_id", "url", "html"), urls.suffix_counts(pages))
    assert len(known) == pages.count() and set(known.junk) == {0, 1}
    trees, shares = urls.train(known)
    assert len(set(trees.feature[np.isfinite(trees.threshold)].tolist())) > 5
    suffixes = Counter(r.host.rsplit(".", 1)[-1] for r in got.values())

    def score(url, host, path):
        suffix = host.rsplit(".", 1)[-1]
        row = pd.DataFrame([(url, host, path, suffix, suffixes[suffix])], columns=["url", "host", "path", "suffix", "suffix_urls"])
        x = urls.features(row, shares)[0]
        total = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))

    for page in pages.collect():
        rest = page.url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, slash, path = rest.partition("/")
        host = host.lower()
        fits = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and (slash + path).startswith(r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        r = got[page.page_id]
        judged = score(page.url, host, slash + path)
        assert r.score == pytest.approx(judged)
        assert (r.host, r.path, r.rule, r.verdict) == (host, slash + path, rule, URL_RULES[rule] if rule else "block" if judged > 0.5 else "allow")
    free = [r for r in got.values() if r.rule is None]
    unwanted = [any(w in r.host for w in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")) for r in free]
    assert all(r.verdict == "block" for r, u in zip(free, unwanted, strict=True) if u) and any(unwanted)
    assert np.mean([r.verdict == "allow" for r, u in zip(free, unwanted, strict=True) if not u]) > 0.85


@pytest.mark.parametrize("most", [urls.BROADCAST_SUFFIXES, 0])
def test_url_filter_without_labels_and_beyond_the_bound(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_SUFFIXES", most)
    nothing = spark.createDataFrame([(1, None), (2, "no url"), (None, "")], "page_id long, url string")
    assert {(r.verdict, r.score) for r in urls.filter_urls(nothing, {}).collect()} == {("allow", 0.0)}
    many = spark.range(4000).selectExpr("id AS page_id", "concat('http://', if(id % 4 = 0, 'free-bets', 'news'), '.n', id % 50, '.x/', id) AS url", "'p' AS suffix", "1 AS label")
    known = urls.labelled(many.select("page_id", "url"), urls.suffix_counts(many), 500)
    assert 250 < len(known) <= 500
    got = urls.filter_urls(many, {}, fit_rows=500).collect()
    assert len(got) == 4000
    assert np.mean([(r.verdict == "block") == ("free-bets" in r.host) for r in got]) > 0.95


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_line_alignment_is_longest():
    rng = random.Random(8)
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 14))]
        mark = html.shared(a, b)
        kept = [x for x, m in zip(a, mark, strict=True) if m]
        at = iter(b)
        assert all(x in at for x in kept)
        assert len(kept) == lcs(a, b)


PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><div>Site menu line</div><script>var x='</p>';</script>{}<div>Shared tail &copy;</div></body></html>"


def test_html_differencing_without_marks(spark):
    rows = [(1, "http://h.x/a/1", PAGE.format("<p>One &amp; only<br>text</p><p>  two\n three </p>")), (2, "http://h.x/a/2", PAGE.format("<p>Other page</p>")), (3, "http://lone.x/", PAGE.format("<p>Alone</p>")), (4, None, None), (5, "http://c.x/1", "<p>same"), (6, "http://c.x/2", "<p>same")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {1: "One & only text\n\ntwo three", 2: "Other page", 3: "Site menu line\n\nAlone\n\nShared tail ©", 4: "", 5: "same", 6: "same"}


def test_html_is_the_same_for_any_number_of_ranges(spark):
    rng = np.random.default_rng(3)
    menu = "<p>Home</p><p>About us</p><p>Contact</p>"
    pages = [(k, f"http://{'hot' if k % 3 else f'h{k % 4}'}.example.org/{'abc'[k % 3]}/{rng.integers(20)}", f"{menu if k % 5 else ''}<p>Text {rng.integers(6)}</p><p>more {rng.integers(6)}</p>") for k in range(120)]
    pages += [(None, None, None), (500, None, menu), (500, None, menu + "<p>own</p>"), *pages[:3], (7, pages[7][1], "<p>other</p>" + menu)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    lines = [(p, u, h or "", *(("", "") if u is None else (u[7:].split("/")[0], u[7 + len(u[7:].split("/")[0]) :]))) for p, u, h in pages]
    order = sorted(lines, key=lambda r: (r[3], r[4], r[1] or "", -(1 << 63) if r[0] is None else r[0], r[2]))
    shared = lambda a, b: -1 if b is None or a[3] != b[3] else len(os.path.commonprefix([a[4], b[4]]))
    want = []
    for k, row in enumerate(order):
        before, after = order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None
        left, right = shared(row, before), shared(row, after)
        pair = before if left >= right and left >= 0 else after if right >= 0 else None
        want.append((row[0], row[1], html.main_text(html.page_lines(row[2]), html.page_lines(pair[2]) if pair else None)))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 5, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = [(r["page_id"], r["url"], r["text"]) for r in html.extract(docs).collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr)
        assert html.extract(docs.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_html_marked_article(spark):
    page = '<body><header>H</header><nav><li>m</nav><article><h1>T</h1><p><b>a&nbsp;b<p>c<div class="ad">buy</div><form><p>f</form><section id="comments"><p>no</section></article><aside>s</aside><footer>f</footer>'
    df = spark.createDataFrame([(1, "http://h/1", page), (2, "http://h/2", page)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(df).collect()} == {"T\n\na b\n\nc"}
    assert html.extract(df.limit(0)).count() == 0


def test_html_names_are_whole_and_spare_the_article(spark):
    """Furniture by class or id: whole names only, and never an element that holds the page's article."""
    text = lambda h: html.main_text(html.page_lines(h), None)
    assert text('<div class="layout with-sidebar"><article><p>own</article><p>aside</div>') == "own"
    assert text('<div class="sidebar"><p>links</p><article><p>own</p></article></div>') == "own"
    assert text('<div class="related"><article>teaser</article></div><article>own</article>') == "own"
    assert text('<article><div class="post-header"><h1>Title</h1></div><div class="related-work"><p>before us</div><div class="related">more</div></article>') == "Title\n\nbefore us"
    assert text("<article><p class=it's>one</p><p>two isn't</p><p title='a>b'>three</p></article>") == "one\n\ntwo isn't\n\nthree"
    assert text("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>") == "let x=1 be"
    assert text('<section id="comments"><article class="comment">no</article></section><article>yes</article>') == "yes"
    assert text('<aside><article>teaser</article></aside><p>own</p>') == "own"


def test_html_differencing_decides_without_an_article_element(spark):
    """A class name marks a teaser only: the main text is what the neighbour has not; a host's line goes also there where markup says nothing."""
    page = '<div>Host line</div><div class="story">Teaser {}</div><p>Main text {}</p><p>Host tail</p>'
    rows = [(k, f"http://h.x/a/{k}", page.format(k // 2, k)) for k in range(4)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Teaser {k // 2}\n\nMain text {k}" for k in range(4)}


class ArticleParser(HTMLParser):
    """The article of pages in the tables, by the standard library's parser: another way to the same text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = 0
        self.blocks = [[]]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        elif tag == "br":
            self.blocks[-1].append(" ")
        elif tag not in ("b", "a"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        if tag == "article":
            self.depth -= 1
        if tag not in ("b", "a"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1].append(data)

    @property
    def text(self):
        return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in self.blocks) if x)


def test_html_query_equals_another_parser(spark):
    sf = "/root/testdata/sf0.01"
    pages = table(spark, sf, "pages").collect()
    got = {r.page_id: r for r in QUERIES["op6_html_extract"](spark, sf).collect()}
    assert len(got) == len(pages)
    for page in pages:
        parser = ArticleParser()
        parser.feed(page.html)
        r = got[page.page_id]
        assert (r.url, r.text, r.n_chars) == (page.url, parser.text, len(parser.text))


def lm_words(df):
    """Words of each document, and counts and their sum over the training documents, by brute force."""
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in df.collect()}
    c = Counter()
    for k, w in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update(w)
    return texts, c, sum(c.values())


def test_lm_base_counts_and_gain(spark):
    """Held-out documents: training has to gain 0.2 for each token over the same network untrained and over the smoothed counts."""
    df = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in lm.score_documents(df).collect()}
    texts, c, total = lm_words(df)
    for k, w in texts.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in c for x in w), total, zlib.crc32(str(k).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (total + len(c) + 1)) for x in w))
    untrained = {r.doc_id: r.score for r in lm.score_documents(df, lm.Config(rounds=0)).collect()}
    held = [r for r in got.values() if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score - r.base_score for r in held) > 0.2 * n
    assert sum(r.score - untrained[r.doc_id] for r in held) > 0.2 * n


def test_lm_score_equals_brute_force(spark, sf_dir, monkeypatch):
    """The whole query's scores against one word after the other in plain formulas, with the weights that it learnt."""
    seen = {}

    def learn(coded, head):
        seen["head"], (seen["w"], tokens) = head, learnt(coded, head)
        return seen["w"], tokens

    learnt = lm.learn
    monkeypatch.setattr(lm, "learn", learn)
    config = lm.Config(hidden=5, embedding=4, network_words=300, class_words=32, head_words=900)
    df = table(spark, sf_dir, "documents").where("n_chars < 1500")
    got = {r.doc_id: r.score for r in lm.score_documents(df, config).collect()}
    texts, c, total = lm_words(df)
    head, w = seen["head"], {k: v.astype(float) for k, v in seen["w"].items()}
    known = sorted(c, key=lambda x: (-c[x], x))
    least = min(c[x] for x in head.ranks)
    ranks = {x: k for k, x in enumerate(known) if c[x] >= least}
    assert ranks == head.ranks and least > 1
    in_class = {}
    for x in known:
        in_class.setdefault(head.classes[ranks[x]] if x in ranks else head.n_classes - 1, []).append(x)
    rare = in_class[head.n_classes - 1]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    bias = w["bc"].copy()
    bias[-1] += np.log((sum(c[x] + 1 for x in rare) + 1) / sum(c[x] for x in rare))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n = config.hidden
    for k in list(texts)[:25]:
        h, last, score = np.zeros(n), b"\n", 0.0
        for x in texts[k]:
            at = ranks.get(last, -1)
            inp = at if 0 <= at < 300 else 300 + (head.classes[at] if at >= 0 else head.n_classes - 1) - head.network_classes
            e = w["emb"][inp] @ w["wx"] + w["b"]
            u = h @ w["u"]
            z, r = sigmoid(e[:n] + u[:n]), sigmoid(e[n : 2 * n] + u[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(e[2 * n :] + r * u[2 * n :])
            rank = ranks.get(x, -1)
            cls = head.classes[rank] if rank >= 0 else head.n_classes - 1
            p = soft(h @ w["wc"] + bias)[cls]
            if rank < 0:
                p *= (c[x] + 1) / (sum(c[y] + 1 for y in rare) + 1)
            elif rank < 300:
                p *= soft(h @ w["ww"][cls] + w["bw"][cls])[rank % 32]
            else:
                p *= c[x] / sum(c[y] for y in in_class[cls])
            score += np.log10(p)
            last = x
        assert got[k] == pytest.approx(score, rel=1e-3)


def test_lm_gradient():
    """The window's gradients against finite differences of the loss."""
    texts = [[b"a", b"b", b"\n"], [b"b", b"c", b"a", b"\n"]] * 6
    c = Counter(x for t in texts for x in t)
    order = sorted(c, key=lambda w: (-c[w], w))[:3]
    config = lm.Config(hidden=3, embedding=2, network_words=3, class_words=2, streams=2, window=4)
    head = lm.Head({w: k for k, w in enumerate(order)}, np.array([c[w] for w in order], float), sum(c.values()), len(c), config)
    rng = np.random.default_rng(0)
    weights = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in lm.initial(head).items()}
    before = np.array([[head.first, 0], [0, 1], [1, -1]])
    target = np.array([[0, 1], [1, -1], [-1, -2]])

    def loss(w):
        t = lm.Trainer(head, w)
        taken = {}
        t.adam = taken.update
        t.window(before, target)
        emb = w["emb"][head.inputs[before]] @ w["wx"] + w["b"]
        h, total = np.zeros((2, 3), np.float64), 0.0
        for s in range(3):
            h = np.where((before[s] == head.first)[:, None], 0, h)
            h = lm.step(emb[s].astype(np.float64), h, w["u"].astype(np.float64))[0]
            for b in range(2):
                if target[s, b] != -2:
                    k = head.classes[target[s, b]]
                    total -= log_softmax(h[b] @ w["wc"] + w["bc"])[k]
                    if k < head.network_classes:
                        total -= log_softmax(h[b] @ w["ww"][k] + w["bw"][k])[target[s, b] - 2 * k]
        return total / 5, taken

    log_softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    _, grads = loss(weights)
    for name in lm.SHAPES:
        at = tuple(int(rng.integers(0, n)) for n in weights[name].shape)
        up, low = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
        up[name][at] += 1e-2
        low[name][at] -= 1e-2
        assert grads[name][at] == pytest.approx((loss(up)[0] - loss(low)[0]) / 2e-2, abs=2e-3)


@pytest.mark.parametrize("lengths", [[5], [2000], [400, 3, 1, 900], [1] * 20, []])
def test_lm_learns_from_every_word(lengths):
    """Few texts, long texts and tails: each word is a target once, after the word before it."""
    head = lm.Head({b"\n": 0, b"a": 1, b"b": 2, b"c": 3}, np.array([50.0, 30, 20, 10]), 120, 9, lm.Config(hidden=4, embedding=3, network_words=4, class_words=2, streams=8, window=4))
    rng = np.random.default_rng(4)
    trainer = lm.Trainer(head, lm.initial(head))
    want, seen, window = Counter(), Counter(), trainer.window

    def watched(before, target):
        seen.update((x, y) for x, y in zip(before.ravel().tolist(), target.ravel().tolist()) if y != -2)
        window(before, target)

    trainer.window = watched
    for n in lengths:
        text = np.append(rng.integers(1, 4, n), 0)
        want.update(zip([0, *text.tolist()], text.tolist()))
        trainer.add(text)
    trainer.finish()
    assert trainer.tokens == sum(lengths) + len(lengths)
    assert seen == want


@pytest.mark.parametrize("passes", [1, 3])
def test_lm_learns_from_every_training_document(spark, sf_dir, passes):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(docs_of(spark, ["a b a", None, "c"], [None, 1, 1]).select("doc_id", "text"))
    training = docs.withColumn("held_out", lm.held_out(docs["doc_id"])).where("not held_out")
    config = lm.Config(most_passes=passes, trainer_words=2000)
    head, _ = lm.head_of(lm.count_words(training), config)
    assert config.trainers(head.total) > 1 and config.passes(head.total) == passes
    coded = lm.code(training.select("doc_id", "held_out", "text"), spark.sparkContext.broadcast(head))
    weights, tokens = lm.learn(coded, head)
    assert tokens == passes * head.total
    assert all(np.isfinite(x).all() for x in weights.values())


def test_lm_averages_many_trainers(spark, sf_dir, monkeypatch):
    """Trainers meet in groups first; the average is the same."""
    training = table(spark, sf_dir, "documents").withColumn("held_out", F.lit(False)).select("doc_id", "held_out", "text")
    config = lm.Config(hidden=4, embedding=4, network_words=256, rounds=1, most_passes=1, trainer_words=4000)
    head, _ = lm.head_of(lm.count_words(training), config)
    coded = lm.code(training, spark.sparkContext.broadcast(head))
    once = lm.learn(coded, head)
    monkeypatch.setattr(lm, "MET", 3)
    grouped = lm.learn(coded, head)
    assert config.trainers(head.total) > 3 and once[1] == grouped[1] == head.total
    for k in lm.SHAPES:
        assert np.allclose(once[0][k], grouped[0][k], atol=2e-3)


def test_lm_windows_carry_state():
    rng = np.random.default_rng(1)
    counts = np.array([50.0, 30, 20, 10])
    head = lm.Head({b"\n": 0, b"a": 1, b"b": 2, b"c": 3}, counts, 120, 9, lm.Config(hidden=4, embedding=3, network_words=4, class_words=2))
    weights = {k: (v + rng.standard_normal(v.shape) * 0.5).astype(np.float32) for k, v in lm.initial(head).items()}
    docs = [rng.integers(-1, 4, n) for n in (1, 70, 5, 200, 64)]
    long = lm.Scorer(head, weights, 3, 1000).score(docs)
    assert lm.Scorer(head, weights, 2, 16).score(docs) == pytest.approx(long, rel=1e-5)


def test_lm_edges(spark):
    df = docs_of(spark, [None, "a b a", "", ""], [1, None, 2, 2])
    assert sorted((r.doc_id or -1, r.n_tokens) for r in lm.score_documents(df).collect()) == [(-1, 4), (1, 1), (2, 1), (2, 1)]
    assert lm.score_documents(df.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rules = quality.Rules()
    left = {k: t.decode() for k, (r, t) in ((k, quality.judge(t.encode(), rules)) for k, t in docs.items()) if r[-1]}
    component = brute_components(word_sets(left, 5), 4, 5)
    left = {k: t for k, t in left.items() if component[k] == k}
    bench = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    words = {k: [x.decode() for x in tiling.tokens(t.encode())] for k, t in left.items()}
    goals = [[x.decode() for x in tiling.tokens(t.encode())] for _, t in bench]
    leaky = set()
    for k, w in words.items():
        text = f" {' '.join(w)} "
        for g in goals:
            if f" {' '.join(g)} " in text:
                leaky.add(k)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r.doc_id for r in got}
    assert kept <= set(left) - leaky
    assert all(tiling.Tiler([(i, t.encode()) for i, t in bench], 5, 0.5).hits(left[k].encode()) for k in set(left) - kept)
    path = tokenizer_path("word_bpe_49k.json")
    want = {k: len(e.ids) + 1 for k, e in zip(sorted(kept), tokens.tokenizer(path).encode_batch([left[k] for k in sorted(kept)], add_special_tokens=False), strict=True)}
    sums = Counter()
    for r in got:
        sums[r.doc_id] += r.length
    assert sums == want


def test_queries_are_registered():
    assert len([n for n in QUERIES if n.startswith("op")]) == 10 and "pipeline" in QUERIES
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_shingles_of_short_texts():
    assert [len(shingle_set(t, 3)) for t in (None, b"", b" ", b"a", b"a b", b"a b c", b"a b c d")] == [0, 0, 0, 1, 1, 1, 2]
