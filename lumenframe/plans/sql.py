"""Pieces of SQL that the oracle statements share."""

from __future__ import annotations

PLANES = "planes AS (SELECT vec_id, label, i - 1 AS pos, (i - 1) % 8 AS x, (i - 1) // 8 AS y, least(1.0, greatest(0.0, embedding[i]::DOUBLE + 0.5)) AS v FROM embeddings, range(1, 65) t(i))"
RGBA = (
    PLANES
    + ", bytes AS (SELECT vec_id, label, pos // 4 AS p, pos % 4 AS ch, floor(v * 255 + 0.5)::INT AS b FROM planes)"
    + ", rgba AS (SELECT vec_id, label, p, p % 4 AS x, p // 4 AS y, max(b) FILTER (WHERE ch = 0) AS r, max(b) FILTER (WHERE ch = 1) AS g, max(b) FILTER (WHERE ch = 2) AS b, max(b) FILTER (WHERE ch = 3) AS a FROM bytes GROUP BY vec_id, label, p)"
)
TALL = PLANES + ", tall AS (SELECT label, pos AS x, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, v FROM planes)"
RECTS = "rects AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS x, l_tax * 5 AS y, l_quantity / 100 AS w, (l_partkey % 50 + 1) / 100.0::DOUBLE AS h FROM lineitem)"
SIZES = "sizes AS (SELECT l_orderkey, l_linenumber, l_quantity::INT::BIGINT * 400 AS width, (l_partkey % 100 + 1) * 200 AS height FROM lineitem)"
JOBS = "jobs AS (SELECT user_id AS session, event_id AS job, event_type AS stage, value AS progress, ts, props FROM events)"
HISTORY = "history AS (SELECT user_id AS owner, event_id AS id, ts AS created FROM events)"
FILES = "files AS (SELECT page_id, url AS name, html, octet_length(encode(html)) AS n FROM pages)"


def micro(v: str) -> str:
    return f"floor(({v}) * 1000000.0 + 0.5)::BIGINT"


def clamp(v: str, lo: str, hi: str) -> str:
    return f"least({hi}, greatest({lo}, {v}))"


def byte_even(v: str) -> str:
    return f"round_even({clamp(v, '0.0', '255.0')}, 0)::INT"


def kernel(kind: str, x: str) -> str:
    d = f"abs({x})"
    return {
        "box": f"CASE WHEN {x} > -0.5 AND {x} <= 0.5 THEN 1.0 ELSE 0.0 END",
        "triangle": f"greatest(0.0, 1.0 - {d})",
        "bicubic": f"CASE WHEN {d} < 1 THEN 1.5*{d}*{d}*{d} - 2.5*{d}*{d} + 1 WHEN {d} < 2 THEN -0.5*{d}*{d}*{d} + 2.5*{d}*{d} - 4*{d} + 2 ELSE 0.0 END",
    }[kind]


def taps(name: str, n_in: int, n_out: int, kind: str) -> str:
    """A relation name(o, i, w)."""
    scale = n_in / n_out
    wide = max(1.0, scale)
    reach = {"box": 0.5, "triangle": 1.0, "bicubic": 2.0}[kind] * wide
    return (
        f"{name} AS (SELECT o, i, k / sum(k) OVER (PARTITION BY o) AS w FROM (SELECT o, i, {kernel(kind, f'((i - c + 0.5) / {wide}::DOUBLE)')}::DOUBLE AS k "
        f"FROM (SELECT o, (o + 0.5)::DOUBLE * {scale}::DOUBLE AS c FROM range({n_out}) t(o)), range({n_in}) u(i) WHERE i >= floor(c - {reach}::DOUBLE + 0.5) AND i < floor(c + {reach}::DOUBLE + 0.5)))"
    )


def resample(source: str, keys: str, n: tuple[int, int], to: tuple[int, int], kind: str, out: str = "res") -> str:
    """CTEs that end in `out`(keys, x, y, v)."""
    on = ", ".join(keys.split())
    return (
        f"{taps(out + '_cx', n[0], to[0], kind)}, {taps(out + '_cy', n[1], to[1], kind)}, "
        f"{out}_row AS (SELECT {on}, o AS x, y, sum(v * w) AS v FROM {source} JOIN {out}_cx ON x = i GROUP BY {on}, o, y), "
        f"{out} AS (SELECT {on}, x, o AS y, sum(v * w) AS v FROM {out}_row JOIN {out}_cy ON y = i GROUP BY {on}, x, o)"
    )


def blur(source: str, keys: str, radius: int, value: str = "v", out: str = "blurred", keep: str = "") -> str:
    """CTEs that end in `out`(keys, x, y, keep, v)."""
    on = ", ".join(keys.split())
    kept = f", {keep}" if keep else ""
    frame = f"ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return (
        f"{out}_h AS (SELECT {on}, x, y{kept}, avg({value}) OVER (PARTITION BY {on}, y ORDER BY x {frame}) AS v FROM {source}), "
        f"{out} AS (SELECT {on}, x, y{kept}, avg(v) OVER (PARTITION BY {on}, x ORDER BY y {frame}) AS v FROM {out}_h)"
    )
