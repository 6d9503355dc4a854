"""Queries of the scalar, job, history, file and part operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions import headers as H
from lumenframe.functions import names as N
from lumenframe.functions import sizing as S
from lumenframe.functions.numeric import clamp, micro, signed32, unsigned
from lumenframe.operators import jobs as J
from lumenframe.plans import sql as Q
from lumenframe.plans.registry import query
from lumenframe.sources import bindings as B

c = F.col
KEY = ["l_orderkey", "l_linenumber"]
K = "l_orderkey, l_linenumber"
NOW = "TIMESTAMP '2024-02-25 00:00:00'"


# --- rectangles -------------------------------------------------------------


def _rect_micro(df: DataFrame, r) -> DataFrame:
    return df.select(*KEY, r.alias("o")).select(*KEY, *[micro(c(f"o.{k}")).alias(k) for k in "xywh"])


def _clamped(x: str, y: str, w: str, h: str, least: str = "1e-6") -> str:
    cw, ch = Q.clamp(w, least, "1.0"), Q.clamp(h, least, "1.0")
    return f"{Q.clamp(x, '0.0', f'1 - {cw}')} AS x, {Q.clamp(y, '0.0', f'1 - {ch}')} AS y, {cw} AS w, {ch} AS h"


_OUT = f"SELECT {K}, {', '.join(f'{Q.micro(k)} AS {k}' for k in 'xywh')} FROM o"


@query(f"WITH {Q.RECTS} SELECT {K}, {Q.micro(Q.clamp('x', '0.25', '0.4'))} AS v FROM rects")
def g01_clamp(spark, sf_dir):
    return B.rects(spark, sf_dir).select(*KEY, micro(clamp(c("r.x"), 0.25, 0.4)).alias("v"))


@query(f"WITH {Q.RECTS} SELECT {K}, x <= 0.3 AND y <= 0.3 AND x + w >= 0.7 AND y + h >= 0.7 AS v, x <= 0.001 AND y <= 0.001 AND x + w >= 0.999 AND y + h >= 0.999 AS strict FROM rects")
def g02_whole(spark, sf_dir):
    return B.rects(spark, sf_dir).select(*KEY, G.whole(c("r"), 0.3).alias("v"), G.whole(c("r")).alias("strict"))


_INNER = "(0.2, 0.2, 0.1, 0.1), (0.0, 0.0, 1.0, 1.0), (0.1, 0.3, 0.2, 0.05)"


@query(f"WITH {Q.RECTS}, i(ix, iy, iw, ih) AS (SELECT col0::DOUBLE, col1::DOUBLE, col2::DOUBLE, col3::DOUBLE FROM (VALUES {_INNER})) SELECT {K}, {Q.micro('ix')} AS ix FROM rects JOIN i ON ix >= x - 0.0001 AND iy >= y - 0.0001 AND ix + iw <= x + w + 0.0001 AND iy + ih <= y + h + 0.0001")
def g03_j08_contains(spark, sf_dir):
    """A theta join with three constant rectangles: they are literals, so each row is tested in place."""
    inner = F.array(*[G.rect(*map(F.lit, r)) for r in ((0.2, 0.2, 0.1, 0.1), (0.0, 0.0, 1.0, 1.0), (0.1, 0.3, 0.2, 0.05))])
    both = B.rects(spark, sf_dir).withColumn("i", F.explode(inner))
    return both.where(G.contains(c("r"), c("i"))).select(*KEY, micro(c("i.x")).alias("ix"))


@query(f"WITH {Q.RECTS}, o AS (SELECT {K}, {_clamped('(0.2 - x) / w', '(0.3 - y) / h', '0.25 / w', '0.125 / h')} FROM rects) {_OUT}")
def g04_relative(spark, sf_dir):
    return _rect_micro(B.rects(spark, sf_dir), G.relative(c("r"), G.rect(F.lit(0.2), F.lit(0.3), F.lit(0.25), F.lit(0.125))))


@query(f"WITH {Q.RECTS}, o AS (SELECT {K}, {_clamped('x', 'y', 'w', 'h', '0.05')} FROM rects) {_OUT}")
def g05_clamped(spark, sf_dir):
    return _rect_micro(B.rects(spark, sf_dir), G.clamped(c("r"), 0.05))


@query(f"WITH {Q.RECTS}, o AS (SELECT {K}, {Q.clamp('x + 0.125', '0.0', '1 - w')} AS x, {Q.clamp('y - 0.25', '0.0', '1 - h')} AS y, w, h FROM rects) {_OUT}")
def g06_moved(spark, sf_dir):
    return _rect_micro(B.rects(spark, sf_dir), G.moved(c("r"), F.lit(0.125), F.lit(-0.25)))


def _resize_sql(corner: str, dx: float, dy: float, least: float, ratio: float | None) -> str:
    west, north = "w" in corner, "n" in corner
    w = Q.clamp(f"-(x + {dx} - (x + w))" if west else f"x + w + {dx} - x", "0.0", "rw")
    h = Q.clamp(f"-(y + {dy} - (y + h))" if north else f"y + h + {dy} - y", "0.0", "rh")
    base = f"a AS (SELECT *, {'x + w' if west else 'x'} AS ax, {'y + h' if north else 'y'} AS ay, {'x + w' if west else '1 - x'} AS rw, {'y + h' if north else '1 - y'} AS rh FROM rects), b AS (SELECT *, {w} AS w1, {h} AS h1 FROM a)"
    if ratio:
        base += f", d AS (SELECT * EXCLUDE (w1, h1), CASE WHEN w1 / {ratio} > h1 THEN w1 ELSE h1 * {ratio} END AS w1, CASE WHEN w1 / {ratio} > h1 THEN w1 / {ratio} ELSE h1 END AS h1 FROM b)"
        base += ", e AS (SELECT * EXCLUDE (w1, h1), w1 * s AS w1, h1 * s AS h1 FROM (SELECT *, least(1.0, CASE WHEN w1 <> 0 THEN rw / w1 END, CASE WHEN h1 <> 0 THEN rh / h1 END) AS s FROM d))"
        base += f", f AS (SELECT *, greatest(1.0, CASE WHEN w1 <> 0 THEN {least} / w1 END, CASE WHEN h1 <> 0 THEN {least} / h1 END) AS g FROM e), z AS (SELECT *, least(w1 * g, rw) AS w2, least(h1 * g, rh) AS h2 FROM f)"
    else:
        base += f", z AS (SELECT *, greatest(w1, least({least}, rw)) AS w2, greatest(h1, least({least}, rh)) AS h2 FROM b)"
    return f"WITH {Q.RECTS}, {base}, o AS (SELECT {K}, {'ax - w2' if west else 'ax'} AS x, {'ay - h2' if north else 'ay'} AS y, w2 AS w, h2 AS h FROM z) {_OUT}"


def _resize_query(name: str, corner: str, dx: float, dy: float, least: float, ratio: float | None):
    def run(spark, sf_dir):
        return _rect_micro(B.rects(spark, sf_dir), G.resized(c("r"), corner, F.lit(dx), F.lit(dy), least, ratio))

    run.__name__ = name
    query(_resize_sql(corner, dx, dy, least, ratio))(run)


for _corner in ("nw", "ne", "sw", "se"):
    _resize_query(f"g07_resize_{_corner}", _corner, 0.0625, -0.125, 0.05, None)
    _resize_query(f"g07_resize_{_corner}_ratio", _corner, -0.0625, 0.125, 0.05, 1.5)


def _fit_sql(x: str, y: str, w: str, h: str, ratio: str, source: str) -> str:
    return f"q AS (SELECT {K}, {x} + {w} / 2 AS cx, {y} + {h} / 2 AS cy, CASE WHEN {w} / {ratio} > {h} THEN {h} * {ratio} ELSE {w} END AS fw, CASE WHEN {w} / {ratio} > {h} THEN {h} ELSE {w} / {ratio} END AS fh FROM {source}), o AS (SELECT {K}, {_clamped('cx - fw / 2', 'cy - fh / 2', 'fw', 'fh')} FROM q)"


@query(f"WITH {Q.RECTS}, {_fit_sql('x', 'y', 'w', 'h', '0.75', 'rects')} {_OUT}")
def g08_fit_ratio(spark, sf_dir):
    return _rect_micro(B.rects(spark, sf_dir), G.fitted(c("r"), F.lit(0.75)))


@query(f"WITH {Q.RECTS}, t AS (SELECT {K}, {_clamped('x', 'y', 'w', 'h', '0.05')} FROM rects), {_fit_sql('x', 'y', 'w', 'h', '(1.0 / 1.6::DOUBLE)', 't')} {_OUT}")
def g15_opened(spark, sf_dir):
    return _rect_micro(B.rects(spark, sf_dir), G.opened(c("r"), 0.05, 1.0, F.lit(1.6)))


_X0, _Y0 = Q.clamp("floor(x * 640 + 0.5)", "0", "639"), Q.clamp("floor(y * 480 + 0.5)", "0", "479")
_X1, _Y1 = Q.clamp("floor((x + w) * 640 + 0.5)", f"{_X0} + 1", "640"), Q.clamp("floor((y + h) * 480 + 0.5)", f"{_Y0} + 1", "480")


@query(f"WITH {Q.RECTS} SELECT {K}, {_X0}::BIGINT AS x, {_Y0}::BIGINT AS y, ({_X1} - {_X0})::BIGINT AS w, ({_Y1} - {_Y0})::BIGINT AS h FROM rects")
def g09_pixels(spark, sf_dir):
    return B.rects(spark, sf_dir).select(*KEY, G.pixels(c("r"), F.lit(640), F.lit(480)).alias("p")).select(*KEY, *[c(f"p.{k}").cast("long").alias(k) for k in "xywh"])


@query(f"WITH {Q.RECTS} SELECT {K}, w > 0 AND h > 0 AND isfinite(x) AND isfinite(y) AND isfinite(w) AND isfinite(h) AS ok FROM rects")
def f11_valid_rect(spark, sf_dir):
    return B.rects(spark, sf_dir).select(*KEY, G.valid(c("r")).alias("ok"))


@query(f"WITH {Q.RECTS} SELECT {K}, abs(x - 0.25) < 0.0001 AND abs(y - 0.2) < 0.0001 AND abs(w - w) < 0.0001 AND abs(h - 0.5) < 0.0001 AS same FROM rects")
def f20_same_rect(spark, sf_dir):
    return B.rects(spark, sf_dir).select(*KEY, G.same(c("r"), G.rect(F.lit(0.25), F.lit(0.2), c("r.w"), F.lit(0.5))).alias("same"))


@query(f"WITH {Q.RECTS} SELECT {K}, {Q.micro('-x / w * 100')} AS l, {Q.micro('-y / h * 100')} AS t, {Q.micro('100 / w')} AS w, {Q.micro('100 / h')} AS h FROM rects")
def g16_placement(spark, sf_dir):
    return B.rects(spark, sf_dir).select(*KEY, G.placement(c("r")).alias("p")).select(*KEY, micro(c("p.left")).alias("l"), micro(c("p.top")).alias("t"), micro(c("p.width")).alias("w"), micro(c("p.height")).alias("h"))


# --- sizes ------------------------------------------------------------------

_HINTS = ("l_orderkey % 7 = 0", "l_orderkey % 3 = 0", "CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 8 WHEN 5 THEN 6 END", "l_orderkey % 11 = 0")
_IOS, _MOBILE, _MEM, _LOW = _HINTS
_RAW_OUT = f"CASE WHEN {_IOS} THEN 16777216 WHEN {_MOBILE} THEN CASE WHEN {_MEM} <= 3 THEN 12000000 ELSE 16000000 END WHEN {_MEM} <= 2 THEN 12000000 WHEN {_MEM} <= 4 THEN 24000000 WHEN {_MEM} >= 8 THEN 48000000 ELSE 36000000 END"
_LIMITS = f"limits AS (SELECT *, CASE WHEN {_IOS} THEN 50000000 WHEN {_MOBILE} THEN 64000000 ELSE 150000000 END::BIGINT AS max_input, CASE WHEN {_LOW} THEN least({_RAW_OUT}, 6000000) ELSE {_RAW_OUT} END::BIGINT AS max_output, CASE WHEN {_IOS} OR {_MOBILE} THEN 8192 ELSE 16384 END::BIGINT AS max_side FROM sizes)"


def _limited(spark, sf_dir) -> DataFrame:
    return B.sizes(spark, sf_dir).withColumn("lim", S.limits(*map(F.expr, _HINTS)))


@query(f"WITH {Q.SIZES}, {_LIMITS} SELECT {K}, max_input, max_output, max_side FROM limits")
def d01_d02_limits(spark, sf_dir):
    return _limited(spark, sf_dir).select(*KEY, "lim.*")


@query(f"WITH {Q.SIZES}, {_LIMITS}, s AS (SELECT *, least(1.0, sqrt(max_output / (width::DOUBLE * height)), max_side / greatest(width, height)::DOUBLE) AS k FROM limits) SELECT {K}, CASE WHEN k >= 1 THEN width ELSE greatest(1, floor(width * k)) END::BIGINT AS width, CASE WHEN k >= 1 THEN height ELSE greatest(1, floor(height * k)) END::BIGINT AS height, k < 1 AS scaled FROM s")
def d03_plan(spark, sf_dir):
    df = _limited(spark, sf_dir)
    return df.select(*KEY, S.plan(c("width"), c("height"), c("lim.max_output"), c("lim.max_side")).alias("p")).select(*KEY, "p.*")


@query(f"WITH {Q.SIZES} SELECT {K}, width * height * 10 + 160000000 AS bytes FROM sizes")
def d04_working_memory(spark, sf_dir):
    return B.sizes(spark, sf_dir).select(*KEY, S.working_memory(c("width"), c("height")).alias("bytes"))


_FIT = "least(1.0, 192.0::DOUBLE / greatest(width, height))"


@query(f"WITH {Q.SIZES} SELECT {K}, greatest(1, floor(width * {_FIT} + 0.5))::BIGINT AS width, greatest(1, floor(height * {_FIT} + 0.5))::BIGINT AS height FROM sizes")
def d05_fit_within(spark, sf_dir):
    return B.sizes(spark, sf_dir).select(*KEY, S.fit_within(c("width"), c("height"), 192).alias("p")).select(*KEY, "p.*")


@query(f"WITH {Q.SIZES}, s AS (SELECT *, greatest(1, ceil(sqrt(width * height / 2000000.0::DOUBLE)))::BIGINT AS s FROM sizes) SELECT {K}, s, greatest(1, floor(90.0::DOUBLE / s + 0.5))::BIGINT AS r1, greatest(1, floor(6.0::DOUBLE / s + 0.5))::BIGINT AS r2 FROM s")
def c18_working_grid(spark, sf_dir):
    return B.sizes(spark, sf_dir).select(*KEY, S.grid(c("width") * c("height")).alias("g")).select(*KEY, "g.*")


@query(f"WITH {Q.SIZES}, {_LIMITS} SELECT {K}, width * height > max_input AS too_large FROM limits")
def f09_too_large(spark, sf_dir):
    return _limited(spark, sf_dir).select(*KEY, S.too_large(c("width"), c("height"), c("lim")).alias("too_large"))


_ADMIT = "CASE WHEN l_orderkey % 97 = 0 THEN 'no-webassembly' WHEN l_orderkey % 13 = 0 THEN 'empty-file' WHEN width * height * 4 > 200000000 THEN 'file-too-large' WHEN l_linenumber = 7 THEN 'unsupported-format' WHEN width * height > max_input THEN 'too-many-pixels' END"


@query(f"WITH {Q.SIZES}, {_LIMITS} SELECT {K}, {_ADMIT} AS error FROM limits")
def f08_admission(spark, sf_dir):
    n = F.when(c("l_orderkey") % 13 == 0, 0).otherwise(c("width") * c("height") * 4)
    kind = F.when(c("l_linenumber") != 7, "png")
    missing = F.when(c("l_orderkey") % 97 == 0, "no-webassembly")
    return _limited(spark, sf_dir).select(*KEY, H.admission(F.lit("x"), n, kind, c("width"), c("height"), c("lim.max_input"), missing).alias("error"))


@query(f"WITH {Q.SIZES} SELECT {K}, width <> 4000 OR height <> 3000 AS scaled FROM sizes")
def x12_scaled(spark, sf_dir):
    return B.sizes(spark, sf_dir).select(*KEY, ((c("width") != 4000) | (c("height") != 3000)).alias("scaled"))


@query(f"WITH {Q.SIZES} SELECT l_linenumber, arg_max(width, (width * height, width)) AS width, max(width * height) AS area FROM sizes GROUP BY l_linenumber")
def a06_largest_area(spark, sf_dir):
    return B.sizes(spark, sf_dir).groupBy("l_linenumber").agg(F.max_by("width", F.struct((c("width") * c("height")).alias("a"), "width")).alias("width"), F.max(c("width") * c("height")).alias("area"))


# --- headers ----------------------------------------------------------------

_WHICH = "((width + height) / 200)::INT % 9"
_KIND = f"CASE {_WHICH} WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'bmp' WHEN 5 THEN 'avif' WHEN 6 THEN 'jpeg' WHEN 7 THEN 'heic' ELSE 'webp' END"
_TOLD = ", ".join(f"CASE {_WHICH} WHEN 4 THEN {v} & 16383 WHEN 8 THEN (({v} - 1) & 16383) + 1 ELSE {v} END AS {v}" for v in ("width", "height"))


@query(f"WITH {Q.SIZES} SELECT {K}, {_KIND} AS kind FROM sizes")
def f01_sniff(spark, sf_dir):
    return B.headers(B.sizes(spark, sf_dir)).select(*KEY, H.image_format(c("content")).alias("kind"))


def _sized_query(name: str, kinds: tuple[str, ...]):
    """Sizes of all files; files of other kinds have none."""

    def run(spark, sf_dir):
        rows = B.headers(B.sizes(spark, sf_dir)).withColumn("s", F.when(c("kind").isin(*kinds), H.image_size(c("content"), c("kind"))))
        return rows.select(*KEY, "s.*")

    run.__name__ = name
    listed = ", ".join(f"'{k}'" for k in kinds)
    query(f"WITH {Q.SIZES}, told AS (SELECT {K}, {_KIND} AS kind, {_TOLD} FROM sizes) SELECT {K}, CASE WHEN kind IN ({listed}) THEN width END AS width, CASE WHEN kind IN ({listed}) THEN height END AS height FROM told")(run)


for _name, _kinds in (("f02_png_size", ("png",)), ("f02_gif_size", ("gif",)), ("f02_bmp_size", ("bmp",)), ("f03_jpeg_size", ("jpeg",)), ("f04_webp_size", ("webp",)), ("f05_boxed_size", ("avif", "heic"))):
    _sized_query(_name, _kinds)


@query(f"WITH {Q.SIZES} SELECT {K}, {_KIND} AS format, {_TOLD} FROM sizes")
def f06_inspect(spark, sf_dir):
    rows = B.headers(B.sizes(spark, sf_dir)).select(*KEY, H.header(c("content")).alias("b")).withColumn("format", H.image_format(c("b")))
    return rows.select(*KEY, "format", H.image_size(c("b"), c("format")).alias("s")).select(*KEY, "format", "s.*")


_BYTES = "(width * 1000003 + height * 4099)"
_byte = lambda k: f"(({_BYTES} >> {8 * (7 - k)}) & 255)"


@query(f"""WITH {Q.SIZES} SELECT {K}, {_byte(4)} * 256 + {_byte(5)} AS be16, {_byte(4)} + {_byte(5)} * 256 AS le16, {_byte(5)} + {_byte(6)} * 256 + {_byte(7)} * 65536 AS le24,
    {_BYTES} % 4294967296 AS be32, CASE WHEN {_byte(7)} >= 128 THEN -4294967296 ELSE 0 END + {_byte(4)} + {_byte(5)} * 256 + {_byte(6)} * 65536 + {_byte(7)} * 16777216 AS signed_le32 FROM sizes""")
def x10_byte_readers(spark, sf_dir):
    """All readers on the eight bytes of a number of every row."""
    rows = B.sizes(spark, sf_dir).withColumn("b", F.unhex(F.lpad(F.hex(c("width") * 1000003 + c("height") * 4099), 16, "0")))
    read = {"be16": unsigned(c("b"), 4, 2), "le16": unsigned(c("b"), 4, 2, True), "le24": unsigned(c("b"), 5, 3, True), "be32": unsigned(c("b"), 4, 4), "signed_le32": signed32(unsigned(c("b"), 4, 4, True))}
    return rows.select(*KEY, *[v.alias(k) for k, v in read.items()])


# --- files and names --------------------------------------------------------


@query(f"WITH {Q.FILES} SELECT page_id, CASE WHEN page_id % 5 = 0 THEN TRUE ELSE regexp_matches(CASE WHEN page_id % 3 = 0 THEN name || '.JPG' ELSE name END, '(?i)\\.(jpe?g|png|webp|gif|bmp|avif|heic|heif)$') END AS image FROM files")
def f07_looks_like_image(spark, sf_dir):
    kind = F.when(c("page_id") % 5 == 0, "image/png").otherwise("")
    name = F.when(c("page_id") % 3 == 0, F.concat("name", F.lit(".JPG"))).otherwise(c("name"))
    return B.files(spark, sf_dir).select("page_id", H.looks_like_image(kind, name).alias("image"))


@query(f"WITH {Q.FILES} SELECT page_id, sha256(html) AS sha256, n FROM files")
def s14_x08_sha256(spark, sf_dir):
    return B.files(spark, sf_dir).select("page_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("n"))


@query(f"WITH {Q.FILES} SELECT page_id, least(n * 200, 524288)::BIGINT AS n, n * 200 > 524288 AS cut FROM files")
def s05_header_read(spark, sf_dir):
    """Files of 200 times each page's bytes, most of them longer than a header."""
    rows = B.files(spark, sf_dir).select("page_id", F.octet_length("content").alias("one"), F.encode(F.repeat(F.decode("content", "UTF-8"), F.lit(200)), "UTF-8").alias("content"))
    n = F.octet_length(H.header(c("content"))).cast("long")
    return rows.select("page_id", n.alias("n"), (n < c("one") * 200).alias("cut"))


_STRIP = [("'\\.[A-Za-z0-9]{1,5}$'", "''"), ("'[\\x00-\\x1f\\x7f]'", "'-'"), ("'[<>:\"/\\\\|?*]+'", "'-'"), ("'\\s+'", "'-'"), ("'-{2,}'", "'-'"), ("'^[-.\\s]+|[-.\\s]+$'", "''")]
_BASE = "regexp_replace(nfc_normalize(text), '^.*[\\\\/]', '', 's')"
for _pattern, _by in _STRIP:
    _BASE = f"regexp_replace({_BASE}, {_pattern}, {_by}, 'g')"
_BASE_SQL = f"WITH b AS (SELECT doc_id, {_BASE} AS b FROM documents), e AS (SELECT doc_id, CASE WHEN length(b) > 80 THEN regexp_replace(left(b, 80), '[-.\\s]+$', '') ELSE b END AS b FROM b), f AS (SELECT doc_id, CASE WHEN b = '' THEN 'image' ELSE b END AS b FROM e), g AS (SELECT doc_id, CASE WHEN regexp_matches(b, '{N.RESERVED}') THEN 'image-' || b ELSE b END AS base FROM f)"


def _bases(spark, sf_dir) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", N.base_name(N.nfc("text")).alias("base"))


@query(f"{_BASE_SQL} SELECT doc_id, base FROM g")
def x01_base_name(spark, sf_dir):
    return _bases(spark, sf_dir)


@query(f"{_BASE_SQL} SELECT doc_id, base || '-' || CASE doc_id % 4 WHEN 0 THEN 'background-removed' WHEN 1 THEN 'white-background' WHEN 2 THEN 'background-aabbcc' ELSE 'background-color' END || '.png' AS name FROM g")
def x02_output_name(spark, sf_dir):
    background = F.when(c("doc_id") % 4 == 1, "white").when(c("doc_id") % 4 == 2, "#AABBCC").when(c("doc_id") % 4 == 3, "#xyz")
    return _bases(spark, sf_dir).select("doc_id", N.output_name(c("base"), background).alias("name"))


@query("SELECT id, CASE WHEN id % 9 = 0 THEN 0 ELSE (id * 7919 % 16777216) >> 16 & 255 END::INT AS r, CASE WHEN id % 9 = 0 THEN 0 ELSE (id * 7919 % 16777216) >> 8 & 255 END::INT AS g, CASE WHEN id % 9 = 0 THEN 0 ELSE (id * 7919 % 16777216) & 255 END::INT AS b FROM range(3000) t(id)")
def x03_hex_colour(spark, sf_dir):
    text = F.concat(F.when(c("id") % 2 == 0, "#").otherwise(""), F.lower(F.lpad(F.hex(c("id") * 7919 % 16777216), 6, "0")), F.when(c("id") % 9 == 0, "x").otherwise(" "))
    return spark.range(3000).select("id", N.hex_colour(text).alias("k")).select("id", "k.*")


@query("SELECT event_id, CASE WHEN n < 10000000 THEN regexp_replace(format('{:.1f}', round(n / 1000000.0::DOUBLE, 1)), '\\.0$', '') ELSE format('{:,}', round(n / 1000000.0::DOUBLE, 0)::BIGINT) END || ' MB' AS en FROM (SELECT event_id, event_id * 49999 AS n FROM events)")
def x04_megabytes(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", N.megabytes(c("event_id") * 49999).alias("en"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'de' WHEN doc_id % 3 = 0 AND lang NOT IN ('de', 'en') THEN 'de' WHEN lang IN ('de', 'en') THEN lang ELSE 'en' END AS locale FROM documents")
def x06_locale(spark, sf_dir):
    override = F.when(c("doc_id") % 10 == 0, "de").when(c("doc_id") % 10 == 1, "fr")
    languages = F.when(c("doc_id") % 3 == 0, F.array(F.concat("lang", F.lit("-XX")), F.lit("DE-at"))).otherwise(F.array(F.upper("lang")))
    return B.table(spark, sf_dir, "documents").select("doc_id", N.locale_of(languages, override).alias("locale"))


@query("SELECT event_id, least(100, floor(value / 80.0 * 100))::INT AS percent FROM events")
def x11_percent(spark, sf_dir):
    return B.jobs(spark, sf_dir).select(c("job").alias("event_id"), N.percent(c("progress"), F.lit(80.0)).alias("percent"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 50, FALSE) AS ok FROM events")
def x14_marker_json(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return B.jobs(spark, sf_dir).select(c("job").alias("event_id"), k.alias("k"), F.coalesce(k.between(10, 50), F.lit(False)).alias("ok"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(d, '{N.OUT_OF_MEMORY}') THEN 'out-of-memory' ELSE 'decode-failed' END AS code FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'RangeError: Array buffer allocation failed' WHEN 1 THEN 'oom' WHEN 2 THEN 'roomy' ELSE url END AS d FROM pages)")
def f15_error_code(spark, sf_dir):
    d = F.when(c("page_id") % 4 == 0, "RangeError: Array buffer allocation failed").when(c("page_id") % 4 == 1, "oom").when(c("page_id") % 4 == 2, "roomy").otherwise(c("name"))
    return B.files(spark, sf_dir).select("page_id", N.error_code(d, "decode-failed").alias("code"))


@query("SELECT page_id, CASE WHEN page_id % 6 = 0 OR page_id % 4 = 1 THEN 'pass' WHEN page_id % 4 = 2 THEN 'asset' ELSE 'static' END AS route FROM pages")
def f21_route(spark, sf_dir):
    scope = "https://app.example.org/"
    url = F.concat(F.lit(scope), F.when(c("page_id") % 4 == 1, "models/").when(c("page_id") % 4 == 2, "assets/").otherwise("x/"), F.regexp_replace("name", "[^a-z]", ""))
    method = F.when(c("page_id") % 6 == 0, "POST").otherwise("GET")
    return B.files(spark, sf_dir).select("page_id", N.route(method, url, scope).alias("route"))


@query()
def s01_s12_s13_file_listing(spark, sf_dir):
    """The tables' own files as a source of files, folders within folders included; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(sf_dir)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "length").orderBy("name")


_PATHS = "paths AS (SELECT DISTINCT regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)"


@query(f"WITH {_PATHS} SELECT left(sha256(string_agg(path, chr(10) ORDER BY path)), 12) AS id, count(*) AS n FROM paths")
def t02_list_digest(spark, sf_dir):
    """One digest of all names: distinct first, so only names move; the list is as long as a build's file list."""
    path = F.regexp_extract("name", "^[^:]+://[^/]+(/[^?#]*)", 1)
    return B.files(spark, sf_dir).select(path.alias("path")).distinct().agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("path")), "\n"), 256), 1, 12).alias("id"), F.count("*").alias("n"))


@query("SELECT DISTINCT source FROM documents WHERE lang = 'fr' OR n_chars > 5000")
def u01_union_distinct(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.where("lang = 'fr'").select("source").union(docs.where("n_chars > 5000").select("source")).distinct()


@query("SELECT page_id FROM pages WHERE NOT (url LIKE '%.html' OR url LIKE '%#top' OR url LIKE '%/models/%')")
def u02_except(spark, sf_dir):
    return B.files(spark, sf_dir).where(~(c("name").endswith(".html") | c("name").endswith("#top") | c("name").contains("/models/"))).select("page_id")


@query("SELECT page_id FROM pages p WHERE url LIKE 'https://%' AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.page_id AND d.lang = 'en')")
def j05_stale_caches(spark, sf_dir):
    keep = B.table(spark, sf_dir, "documents").where("lang = 'en'").select(c("doc_id").alias("page_id"))
    return B.files(spark, sf_dir).where(c("name").startswith("https://")).join(keep, "page_id", "left_anti").select("page_id")


# --- parts ------------------------------------------------------------------

_PARTS = "parts AS (SELECT page_id, i::INT AS idx, (encode(html))[i * 1000 + 1 : i * 1000 + 1000] AS part FROM (SELECT page_id, html, unnest(range(0, greatest(1, ceil(octet_length(encode(html)) / 1000.0))::BIGINT)) AS i FROM pages)), sized AS (SELECT page_id, idx, octet_length(part)::INT AS size, sha256(part) AS sha256 FROM parts)"


def _pieces(spark, sf_dir) -> DataFrame:
    return J.parts(B.files(spark, sf_dir), "page_id", 1000)


@query(f"WITH {_PARTS} SELECT * FROM sized")
def k10_parts(spark, sf_dir):
    return _pieces(spark, sf_dir).drop("part")


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def a08_joined_parts(spark, sf_dir):
    return J.joined_parts(_pieces(spark, sf_dir), "page_id").select("page_id", F.sha2("content", 256).alias("sha256"))


@query(f"WITH {_PARTS} SELECT page_id, idx, sum(size) OVER (PARTITION BY page_id ORDER BY idx)::BIGINT AS loaded FROM sized")
def a09_running_total(spark, sf_dir):
    return _pieces(spark, sf_dir).select("page_id", "idx", F.sum("size").over(Window.partitionBy("page_id").orderBy("idx")).cast("long").alias("loaded"))


@query(f"WITH {_PARTS} SELECT page_id, idx, sha256 IN (SELECT sha256 FROM sized JOIN pages USING (page_id) WHERE url LIKE 'https://%') AS hit FROM sized")
def s10_j04_cached_parts(spark, sf_dir):
    """The cache holds the parts of secure pages."""
    secure = B.files(spark, sf_dir).where(c("name").startswith("https://"))
    return J.cached_parts(_pieces(spark, sf_dir), J.parts(secure, "page_id", 1000)).select("page_id", "idx", "hit")


@query(f"WITH {_PARTS} SELECT page_id, idx, size > 1000 AS too_large, size < 1000 AS too_small FROM sized")
def s09_exact_size(spark, sf_dir):
    return _pieces(spark, sf_dir).select("page_id", "idx", (c("size") > 1000).alias("too_large"), (c("size") < 1000).alias("too_small"))


@query("SELECT page_id, 'model-' || page_id || '-' || left(sha256(html), 16) AS cache FROM pages")
def x09_cache_name(spark, sf_dir):
    return B.files(spark, sf_dir).select("page_id", F.concat(F.lit("model-"), c("page_id").cast("string"), F.lit("-"), F.left(F.sha2("content", 256), F.lit(16))).alias("cache"))


# --- jobs -------------------------------------------------------------------


@query(f"WITH {Q.JOBS} SELECT session, max(job) AS job FROM jobs GROUP BY session")
def w04_w05_latest(spark, sf_dir):
    return J.latest_only(B.jobs(spark, sf_dir)).select("session", "job")


@query(f"WITH {Q.JOBS} SELECT session, job, job < max(job) OVER (PARTITION BY session) AS stale FROM jobs")
def f12_r12_stale(spark, sf_dir):
    return J.with_latest(B.jobs(spark, sf_dir)).select("session", "job", "stale")


@query(f"WITH {Q.JOBS} SELECT session, job FROM (SELECT *, max(job) OVER (PARTITION BY session) AS last FROM jobs) WHERE job = last AND NOT (stage = 'purchase')")
def r03_supersede_cancel(spark, sf_dir):
    """What is still worth working on: the latest job of each session, unless it is cancelled."""
    jobs = B.jobs(spark, sf_dir)
    return J.without_cancelled(J.latest_only(jobs), jobs.where("stage = 'purchase'")).select("session", "job")


@query(f"WITH {Q.JOBS} SELECT a.session, a.job FROM jobs a JOIN (SELECT session, max(job) AS job FROM jobs WHERE stage <> 'view' GROUP BY session) b USING (session, job)".replace("SELECT a.session, a.job", "SELECT session, job"))
def j01_j02_messages(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    waiting = jobs.where("stage <> 'view'").groupBy("session").agg(F.max("job").alias("job"))
    return jobs.join(waiting, ["session", "job"]).select("session", "job")


@query(f"WITH {Q.JOBS} SELECT j.job AS job, CASE WHEN r.job IS NULL THEN 'no-longer-available' ELSE 'ok' END AS status FROM jobs j LEFT JOIN (SELECT job FROM jobs WHERE progress > 50) r ON j.job = r.job")
def j03_result_or_error(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    done = jobs.where("progress > 50").select("job", F.lit("ok").alias("done"))
    return jobs.join(done, "job", "left").select("job", F.coalesce("done", F.lit("no-longer-available")).alias("status"))


@query(f"WITH {Q.JOBS}, l AS (SELECT session, max(job) AS job FROM jobs GROUP BY session) SELECT session, count(*) FILTER (WHERE job IN (SELECT job FROM l)) AS kept, count(*) FILTER (WHERE job NOT IN (SELECT job FROM l)) AS released FROM jobs GROUP BY session")
def j11_keep_release(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    last = jobs.groupBy("session").agg(F.max("job").alias("job"))
    kept = jobs.join(last, ["session", "job"], "left_semi").select("session", F.lit(1).alias("k"))
    gone = jobs.join(last, ["session", "job"], "left_anti").select("session", F.lit(0).alias("k"))
    return kept.union(gone).groupBy("session").agg(F.count_if(c("k") == 1).alias("kept"), F.count_if(c("k") == 0).alias("released"))


@query("SELECT event_id AS job, event_type IN ('click', 'error') AS retry FROM events")
def f14_retryable(spark, sf_dir):
    code = F.when(c("stage") == "click", "offline").when(c("stage") == "error", "unknown").otherwise("empty-file")
    return B.jobs(spark, sf_dir).select("job", code.isin(*N.RETRYABLE).alias("retry"))


@query(f"WITH {Q.JOBS} SELECT session, job FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY stage = 'click' DESC, job) AS k FROM jobs) WHERE k = 1")
def s04_t04_first_image(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("session").orderBy(F.desc(c("stage") == "click"), "job"))
    return B.jobs(spark, sf_dir).withColumn("k", k).where("k = 1").select("session", "job")


@query(f"WITH {Q.JOBS} SELECT session, job FROM (SELECT *, lag(stage) OVER (PARTITION BY session ORDER BY ts, job) AS p FROM jobs) WHERE p IS DISTINCT FROM stage")
def w07_on_change(spark, sf_dir):
    return J.changes(B.jobs(spark, sf_dir), "session", ["ts", "job"], c("stage")).select("session", "job")


_AT = "epoch_ms(ts) // 864000"


@query(f"""WITH RECURSIVE {Q.JOBS}, p AS (SELECT session, {_AT} AS ms, CASE WHEN stage < 'm' THEN 'a' ELSE 'b' END AS phase, progress AS loaded, 95.0::DOUBLE AS total FROM jobs),
    o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ms, phase, loaded) AS k FROM p),
    f AS (SELECT session, k, ms, phase, loaded, TRUE AS kept, ms AS last_at, phase AS last_phase FROM o WHERE k = 1
        UNION ALL SELECT o.session, o.k, o.ms, o.phase, o.loaded, NOT (o.phase = f.last_phase AND o.ms - f.last_at < 100 AND o.loaded < o.total),
            CASE WHEN o.phase = f.last_phase AND o.ms - f.last_at < 100 AND o.loaded < o.total THEN f.last_at ELSE o.ms END,
            CASE WHEN o.phase = f.last_phase AND o.ms - f.last_at < 100 AND o.loaded < o.total THEN f.last_phase ELSE o.phase END
        FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1)
    SELECT session, ms, phase, {Q.micro('loaded')} AS loaded FROM f WHERE kept""")
def w06_r07_throttle(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    at = F.floor(B.millis(jobs, "ts") / 864000).cast("long")
    rows = jobs.select("session", at.alias("at"), F.when(c("stage") < "m", "a").otherwise("b").alias("phase"), c("progress").alias("loaded"), F.lit(95.0).alias("total"))
    return J.throttled(rows).select("session", c("at").alias("ms"), "phase", micro(c("loaded")).alias("loaded"))


@query(f"WITH {Q.JOBS} SELECT job, ts <= {NOW} AND {NOW} - ts <= INTERVAL 1000 HOUR AS valid FROM jobs")
def r06_marker_age(spark, sf_dir):
    now = F.expr(f"TIMESTAMP_NTZ '{NOW[11:-1]}'")
    return B.jobs(spark, sf_dir).select("job", ((c("ts") <= now) & (c("ts") >= now - F.expr("interval 1000 hours"))).alias("valid"))


# --- history ----------------------------------------------------------------

_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created DESC, id DESC) AS rank FROM history)"


def _now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW[11:-1]}'")


@query(f"WITH {Q.HISTORY}, {_RANKED} SELECT owner, id, rank FROM ranked WHERE rank <= 12 AND {NOW} - created <= INTERVAL 30 DAY")
def w03_r05_retention(spark, sf_dir):
    return J.newest(B.history(spark, sf_dir), _now()).select("owner", "id", "rank")


@query(f"WITH {Q.HISTORY}, {_RANKED} SELECT owner, id, rank FROM ranked")
def s11_t01_history_list(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("created"), F.desc("id")))
    return B.history(spark, sf_dir).select("owner", "id", rank.alias("rank"))


@query(f"WITH {Q.HISTORY}, u AS (SELECT owner, id, CASE WHEN created < TIMESTAMP '2024-01-04 00:00:00' THEN created + INTERVAL 27 DAY ELSE created END AS created FROM history), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created DESC, id DESC) AS rank FROM u) SELECT owner, id, rank FROM r WHERE rank <= 12 AND {NOW} - created <= INTERVAL 30 DAY")
def k07_upsert(spark, sf_dir):
    old = B.history(spark, sf_dir)
    new = old.where("created < timestamp_ntz '2024-01-04 00:00:00'").withColumn("created", c("created") + F.expr("interval 27 days"))
    return J.newest(J.upserted(old, new), _now()).select("owner", "id", "rank")


# --- reducer ----------------------------------------------------------------

_TYPE = "CASE WHEN role = 'system' THEN 'model-ready' WHEN turn % 4 = 0 THEN 'select' WHEN role = 'assistant' THEN CASE length(text) % 4 WHEN 0 THEN 'stage' WHEN 1 THEN 'preview' WHEN 2 THEN 'png' ELSE 'model-error' END ELSE CASE length(text) % 4 WHEN 0 THEN 'cancel' WHEN 1 THEN 'job-error' WHEN 2 THEN 'stage' ELSE 'fallback' END END"
_JOB = "turn // 4 * 4"
_STAGE = "CASE length(text) % 3 WHEN 0 THEN 'decoding' WHEN 1 THEN 'waiting-for-model' ELSE 'inference' END"
_BUSY = "view IN ('loading-image', 'loading-model', 'processing')"
_FOLD = f"""RECURSIVE ev AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {_TYPE} AS type, {_JOB} AS j, {_STAGE} AS st FROM conversations),
    f AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 'idle' AS view, NULL::BIGINT AS job, FALSE AS png, 'unknown' AS model, FALSE AS fell FROM conversations
        UNION ALL SELECT conv_id, k, nv, CASE WHEN nv IN ('idle', 'cancelled') THEN NULL WHEN type = 'select' THEN j ELSE job END, CASE WHEN changed THEN FALSE WHEN type = 'png' AND cur AND view = 'complete' THEN TRUE ELSE png END,
            CASE type WHEN 'model-ready' THEN 'ready' WHEN 'model-error' THEN 'error' ELSE model END, fell OR type = 'fallback'
        FROM (SELECT *, CASE WHEN type = 'select' THEN 'loading-image' WHEN type = 'stage' AND cur AND {_BUSY} THEN CASE st WHEN 'decoding' THEN 'loading-image' WHEN 'waiting-for-model' THEN 'loading-model' ELSE 'processing' END
                WHEN type = 'preview' AND cur AND {_BUSY} THEN 'complete' WHEN type = 'job-error' AND cur THEN 'error' WHEN type = 'cancel' AND cur AND {_BUSY} THEN 'cancelled' WHEN type = 'model-error' AND {_BUSY} THEN 'error' ELSE view END AS nv,
                type = 'select' OR (type IN ('stage', 'preview', 'cancel') AND cur AND {_BUSY}) OR (type = 'job-error' AND cur) OR (type = 'model-error' AND {_BUSY}) AS changed
            FROM (SELECT f.conv_id, e.k, f.view, f.job, f.png, f.model, f.fell, e.type, e.j, e.st, coalesce(f.job = e.j, FALSE) AS cur FROM f JOIN ev e ON e.conv_id = f.conv_id AND e.k = f.k + 1)))"""


def _events(spark, sf_dir) -> DataFrame:
    rows = B.table(spark, sf_dir, "conversations")
    n = F.length("text")
    kind = F.expr(_TYPE.replace("//", "div"))
    return rows.select("conv_id", "turn", kind.alias("type"), (F.floor(c("turn") / 4) * 4).cast("long").alias("job"), F.when(n % 3 == 0, "decoding").when(n % 3 == 1, "waiting-for-model").otherwise("inference").alias("stage"))


@query(f"WITH {_FOLD} SELECT conv_id, view, job, png, model, fell AS fell_back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS z FROM f) WHERE z = 1")
def r01_reducer(spark, sf_dir):
    return J.folded(_events(spark, sf_dir), "conv_id", "turn").select("conv_id", "state.view", "state.job", "state.png", "state.model", "state.fell_back")


@query(f"WITH {_FOLD} SELECT conv_id, CASE WHEN {_BUSY} THEN 'image' WHEN model = 'loading' THEN 'model' END AS activity FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS z FROM f) WHERE z = 1")
def r04_activity(spark, sf_dir):
    return J.folded(_events(spark, sf_dir), "conv_id", "turn").select("conv_id", J.activity(c("state.view"), c("state.model")).alias("activity"))


@query(f"WITH {_FOLD} SELECT conv_id, count(*) FILTER (WHERE view IS DISTINCT FROM p) AS notified FROM (SELECT *, lag(view) OVER (PARTITION BY conv_id ORDER BY k) AS p FROM f) WHERE k > 0 GROUP BY conv_id")
def r16_notify_on_change(spark, sf_dir):
    """How often observers hear of a new view: the fold, with the last view and a counter beside the state."""
    row = F.struct(c("turn").alias("at"), "type", "job", "stage")
    logs = _events(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("log"))
    start = F.struct(J.start_state().alias("s"), F.lit(0).cast("long").alias("n"))

    def step(acc, e):
        new = J.reduced(acc["s"], e)
        return F.struct(new.alias("s"), (acc["n"] + F.when(new["view"] != acc["s"]["view"], 1).otherwise(0)).cast("long").alias("n"))

    return logs.select("conv_id", F.aggregate("log", start, step)["n"].alias("notified"))


@query(f"WITH {_FOLD} SELECT f.conv_id AS conv_id, count(*) FILTER (WHERE e.j = f.job) AS current, count(*) FILTER (WHERE e.j IS DISTINCT FROM f.job) AS other FROM f JOIN ev e ON e.conv_id = f.conv_id AND e.k = f.k + 1 GROUP BY f.conv_id")
def f13_current_events(spark, sf_dir):
    """How many events of each log are of the job that is on screen when they come."""
    row = F.struct(c("turn").alias("at"), "type", "job", "stage")
    logs = _events(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("log"))
    start = F.struct(J.start_state().alias("s"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, e: F.struct(J.reduced(acc["s"], e).alias("s"), (acc["n"] + J.is_current(acc["s"], e).cast("int")).cast("long").alias("n"))
    n = F.aggregate("log", start, step)["n"]
    return logs.select("conv_id", n.alias("current"), (F.size("log") - n).alias("other"))


_COMMAND = "CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'cancel' ELSE CASE WHEN value > 50 THEN 'start-over' ELSE 'retry' END END"


@query(f"""WITH RECURSIVE o AS (SELECT user_id AS session, event_id AS id, {_COMMAND} AS command, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT DISTINCT session, 0::BIGINT AS k, NULL::BIGINT AS job, FALSE AS busy, FALSE AS chosen, 0::BIGINT AS cancelled FROM o
        UNION ALL SELECT f.session, o.k, CASE WHEN starts THEN o.id WHEN o.command = 'start-over' OR (o.command = 'cancel' AND f.busy) THEN NULL ELSE f.job END,
            CASE WHEN starts THEN TRUE WHEN o.command IN ('start-over', 'cancel', 'done') THEN FALSE ELSE f.busy END,
            CASE o.command WHEN 'start' THEN TRUE WHEN 'start-over' THEN FALSE ELSE f.chosen END,
            f.cancelled + (f.busy AND (starts OR o.command IN ('cancel', 'start-over')))::INT
        FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1, LATERAL (SELECT o.command = 'start' OR (o.command = 'retry' AND f.chosen) AS starts))
    SELECT session, job, busy, cancelled FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY k DESC) AS z FROM f) WHERE z = 1""")
def r14_commands(spark, sf_dir):
    """Users' commands of each session: the job on screen, whether it runs, and how many running jobs commands have cancelled."""
    command = F.expr(_COMMAND.replace("event_type", "stage").replace("value", "progress"))
    return J.commanded(B.jobs(spark, sf_dir).select("session", "job", command.alias("command")))
