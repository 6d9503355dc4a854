"""URL filters: rules first, then gradient-boosted trees on lexical features.

The trees are trained from labelled URLs. A label has two sources, neither of them
a feature of the trees: a list of words that unwanted hosts use, and, where pages
have their html, whether the page's main text fails the quality rules. So a URL is
unwanted if its host is listed or its page is junk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lumenframe.llm import html, quality
from lumenframe.llm.common import cut, host_of, path_of, small

#: Words of host labels that mark a URL as unwanted.
UNWANTED = ("ads", "adult", "bets", "casino", "cheap", "pills", "porn", "spam", "track", "viagra", "warez", "xxx")
BROADCAST_SUFFIXES = 100_000
#: At most so many labelled rows fit the trees; they are chosen by hash.
FIT_ROWS = 20_000


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, like `net/`: its host and all subdomains, and the beginning of its path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


FEATURES = (
    "length", "host_length", "path_length", "query_length", "depth", "labels", "longest_label", "longest_segment", "hyphens", "dots", "digit_ratio", "host_digit_ratio", "digits",
    "entropy", "host_entropy", "path_entropy", "parameters", "longest_value", "fragment", "escapes", "upper_ratio", "vowel_ratio", "secure", "suffix_urls", "suffix_share",
)


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.unique(list(text), return_counts=True)[1] / len(text)
    return float(-(n * np.log2(n)).sum())


def features(rows: pd.DataFrame, shares: dict[str, float]) -> np.ndarray:
    """The features of rows of url, host, path, suffix, suffix_urls. shares: the share of unwanted URLs among the labelled ones of each suffix, and of all at ''."""
    out = np.zeros((len(rows), len(FEATURES)))
    for k, (url, host, path) in enumerate(zip(rows["url"].fillna(""), rows["host"], rows["path"], strict=True)):
        query = url.partition("?")[2].partition("#")[0]
        parameters = [x for x in query.split("&") if x]
        digits = sum(map(str.isdigit, url))
        out[k, :-2] = (
            len(url), len(host), len(path), len(query), path.count("/"), host.count(".") + 1, max(map(len, host.split("."))), max(map(len, path.split("/"))), host.count("-"), path.count("."),
            digits / max(1, len(url)), sum(map(str.isdigit, host)) / max(1, len(host)), digits, _entropy(url), _entropy(host), _entropy(path),
            len(parameters), max((len(x.partition("=")[2]) for x in parameters), default=0), len(url.partition("#")[2]), url.count("%"),
            sum(map(str.isupper, url)) / max(1, len(url)), sum(map(host.count, "aeiou")) / max(1, len(host)), url[:6].lower() == "https:",
        )
    out[:, -2] = np.log1p(rows["suffix_urls"].to_numpy(float))
    out[:, -1] = [shares.get(x, shares.get("", 0.5)) for x in rows["suffix"]]
    return out


def suffix_shares(rows: pd.DataFrame, weight: float = 20.0) -> dict[str, float]:
    """Share of label 1 for each suffix, drawn to that of all rows as by `weight` more rows."""
    mean = float(rows["label"].mean()) if len(rows) else 0.5
    found = rows.groupby("suffix")["label"].agg(["sum", "count"])
    return {k: float((s + weight * mean) / (n + weight)) for k, s, n in found.itertuples()} | {"": mean}


@dataclass
class Trees:
    """Boosted trees of fixed depth: features and thresholds by level order, and leaf values."""

    start: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            score += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, ridge: float = 1.0, least: int = 20) -> Trees:
    """Newton boosting of the logistic loss on binned features. Ties go to the first feature, then the lowest threshold. A leaf holds `least` rows or more."""
    n_inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = math.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():  # one class only: no tree
        return Trees(start, depth, np.zeros((0, n_inner), int), np.zeros((0, n_inner)), np.zeros((0, n_inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    score = np.full(len(y), start)
    forest = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(n_inner, int), np.full(n_inner, np.inf)
        at = np.zeros(len(y), int)
        for node in range(n_inner):
            inside = np.flatnonzero(at == node)
            best = 1e-9
            G, H = g[inside].sum(), h[inside].sum()
            cut = None
            for f, e in enumerate(edges if len(inside) > 1 else []):
                gs = np.bincount(binned[inside, f], g[inside], len(e) + 1).cumsum()[:-1]
                hs = np.bincount(binned[inside, f], h[inside], len(e) + 1).cumsum()[:-1]
                if len(gs):
                    rows = np.bincount(binned[inside, f], minlength=len(e) + 1).cumsum()[:-1]
                    gain = gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge)
                    gain[(rows < least) | (len(inside) - rows < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, cut = gain[k], (f, k)
            right = np.zeros(len(inside), int)
            if cut:
                feature[node], threshold[node] = cut[0], edges[cut[0]][cut[1]]
                right = (binned[inside, cut[0]] > cut[1]).astype(int)
            at[inside] = 2 * node + 1 + right
        place = at - n_inner
        leaf = -rate * np.bincount(place, g, n_inner + 1) / (np.bincount(place, h, n_inner + 1) + ridge)
        score += leaf[place]
        forest.append((feature, threshold, leaf))
    return Trees(start, depth, *map(np.array, zip(*forest, strict=True)))


def parts(urls: DataFrame) -> DataFrame:
    """urls (url, and others) with host, path and suffix."""
    rows = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return rows.withColumn("suffix", F.substring_index("host", ".", -1))


def suffix_counts(urls: DataFrame) -> DataFrame:
    """(suffix, suffix_urls) as a written table; up to BROADCAST_SUFFIXES of them reach every task, so that no row moves for a join. Beyond, the planner joins as it likes, with the same result."""
    counts = cut(parts(urls.select("url")).groupBy("suffix").agg(F.count("*").alias("suffix_urls")), "suffixes")
    return F.broadcast(counts) if counts.count() <= BROADCAST_SUFFIXES else counts


def listed(host: Column) -> Column:
    """1 if a word of a host label is in UNWANTED, else 0; null without a host."""
    parts = F.split(host, r"[.\-_]")
    return F.when(host == "", F.lit(None)).otherwise(F.arrays_overlap(parts, F.array(*map(F.lit, UNWANTED))).cast("int"))


def junk(rows: DataFrame) -> DataFrame:
    """rows (with html) without html, and with junk: 1 if the page's main text fails the quality rules, 0 if it passes, null without html."""
    schema = StructType([f for f in rows.schema.fields if f.name != "html"] + [StructField("junk", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = quality.Rules()
        for batch in small(batches, 256):
            pages = batch.column(batch.schema.get_field_index("html")).to_pylist()
            found = [None if h is None else int(not quality.judge(html.main_text(html.page_lines(h), None).encode(), rules)[0][-1]) for h in pages]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()) if f.name == "junk" else batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields], names=schema.names)

    return rows.mapInArrow(run, schema)


def labelled(pages: DataFrame, counts: DataFrame, fit_rows: int = FIT_ROWS) -> pd.DataFrame:
    """url, host, path, suffix, suffix_urls, label of at most fit_rows pages, by a hash of URL and id.

    label: 1 for pages of listed hosts and for junk pages, else 0. fit_rows bounds
    what reaches the driver: pages pass whose hash lies in the share that fit_rows is
    of all pages with a host, less a margin for chance.
    """
    with_host = parts(pages).where("host <> ''")
    total = with_host.count()
    share = min(1.0, max(fit_rows - 5 * math.sqrt(fit_rows), 1) / max(total, 1)) if total > fit_rows else 1.0
    order = F.xxhash64("url", "page_id")
    chosen = with_host.withColumn("order", order).where(F.pmod("order", F.lit(1 << 30)) < int(share * (1 << 30)))
    kept = ["url", "host", "path", "suffix", "order"]
    chosen = chosen.select(*kept, listed(F.col("host")).alias("listed"), *(["html"] if "html" in pages.columns else []))
    chosen = junk(chosen) if "html" in pages.columns else chosen.withColumn("junk", F.lit(0))
    found = chosen.join(counts, "suffix").select(*kept, "suffix_urls", F.greatest("listed", F.coalesce("junk", F.lit(0))).alias("label"), "junk").toPandas()
    return found.sort_values(["order", "url"], kind="stable").reset_index(drop=True)


FOLDS = 5


def train(rows: pd.DataFrame) -> tuple[Trees, dict[str, float]]:
    """Trees, and the suffixes' shares, from labelled rows in the order of their hash.

    In training a row's suffix share is that of the rows of the other folds, so no label is among its own features.
    """
    fold = (rows["order"] % FOLDS).to_numpy()
    x, y = np.zeros((len(rows), len(FEATURES))), rows["label"].to_numpy(float)
    for k in range(FOLDS):
        x[fold == k] = features(rows[fold == k], suffix_shares(rows[fold != k]))
    return fit(x, y), suffix_shares(rows)


def filter_urls(pages: DataFrame, rules: dict[str, str], threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of pages (page_id, url, and html, if there): page_id, host, path, rule, verdict, score.

    rules: rule -> allow or block. Where no rule fits, the trees judge: block if the
    score, their probability of unwanted, is over `threshold`. A null URL, or one
    without ://, has an empty host and path and is judged by the trees. URLs of any
    length are read whole. Repeated rows give repeated rows; a null page_id stays
    null; without a labelled URL all scores are 0, so all are allowed; if all labels
    are equal the score is near them. An empty table gives no rows. Other columns are not read.
    """
    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")]
    counts = suffix_counts(pages.select(*columns))
    rows = parts(pages.select(*columns)).join(counts, "suffix")
    with_html = pages.select(*columns, F.col("html").cast("string").alias("html")) if "html" in pages.columns else pages.select(*columns)
    known = labelled(with_html, counts, fit_rows)
    trees, shares = train(known) if len(known) else (None, {})
    shared = pages.sparkSession.sparkContext.broadcast((trees, shares))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, shares = shared.value
        for batch in batches:
            out = batch[["page_id", "host", "path", "rule"]].copy()
            out["score"] = trees.probability(features(batch, shares)) if trees else 0.0
            yield out

    ruled = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("page_id", F.col("page_id").cast("string"))  # pandas has no null in its integers
    scored = ruled.mapInPandas(score, "page_id string, host string, path string, rule string, score double")
    by_rule = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else F.create_map(F.lit(""), F.lit(""))
    verdict = F.coalesce(F.try_element_at(by_rule, F.col("rule")), F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return scored.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", verdict.alias("verdict"), "score")
